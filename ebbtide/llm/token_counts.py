"""Token counts by the whole-token shortcut.

Vocabulary strings that encode alone as one token are proven offline, once on the driver, and shipped
as a list; matching pre-tokens count directly and only the rest go through merges. White-space chunks
repeat, so a bounded memo holds their counts. Null or empty texts count zero; very long texts are
counted whole; repeated rows give repeated rows and equal texts equal counts (there are no ties to
break); an empty table gives none; other columns are not read.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import load, tidy
from .tokenids import counter, prove_whole, tokenizer_path


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of docs; a map without a shuffle."""
    proven = docs.sparkSession.sparkContext.broadcast(prove_whole(path))

    def run(batches):
        count = counter(path).trust(proven.value).many
        for big in batches:
            for s in range(0, big.num_rows, 256):
                b = big.slice(s, 256)
                texts = b.column(1).to_pylist()
                n = count(texts)
                size = [len(t.encode()) if t else 0 for t in texts]
                over = [k > limit for k in n]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), pa.array(size, pa.int64()), pa.array(n, pa.int64()), pa.array(over, pa.bool_())],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        tidy(run), "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def query(spark, sf_dir):
    return token_counts(load(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
