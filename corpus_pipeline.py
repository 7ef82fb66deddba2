"""Training-data pipeline: quality rules, near-duplicate removal, decontamination, packing.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next
stage's docs. The first three return the columns of documents; the last returns packed pieces.
Stages inherit their operators' treatment of nulls, empty texts, ties and repeated rows.
"""

from __future__ import annotations

from ebbtide.llm.common import load, written
from ebbtide.llm.decontaminate import clean
from ebbtide.llm.ngram_join import keep_one
from ebbtide.llm.packing import pack
from ebbtide.llm.quality_rules import keep_good
from ebbtide.llm.tokenids import tokenizer_path


def quality(spark, docs, sf_dir):
    return keep_good(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark, docs, sf_dir):
    return keep_one(docs)


def decontamination(spark, docs, sf_dir):
    return clean(docs, load(spark, sf_dir, "benchmark"))


def packing(spark, docs, sf_dir):
    return pack(docs, tokenizer_path("byte_bpe_50k.json"), with_ids=False)


STAGES = [
    ("quality_rules", quality),
    ("ngram_jaccard_join", near_duplicates),
    ("benchmark_decontamination", decontamination),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
