"""Fund compositions from report texts: the allocation block, its labels and weights, factors and quality.

Texts become rows of lines, so that blocks, first labels and sums are joins and aggregates; a document's
lines are never gathered.
"""

from __future__ import annotations

import json
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import settled

# Headings that open the allocation block and headings that end it.
ALLOCATION = (
    r"^(r[ée]partition\s+par\s+(?:classe|type|grande?\s+classe)s?\s+d.?actif|allocation\s+(?:d.?actifs?|par\s+classe|globale|strat[ée]gique)"
    r"|r[ée]partition\s+par\s+actif|structure\s+du\s+portefeuille|asset\s+allocation"
    r"|composition\s+(?:du\s+portefeuille|de\s+l.?actif|de\s+l.?actif\s+net))"
)
OTHER = (
    r"(r[ée]partition\s+(?:sectorielle|g[ée]ographique|par\s+(?:notation|maturit[ée]|devise|secteur|pays|zone))"
    r"|principales?\s+(?:positions|lignes|contributions?)|composition\s+et\s+indicateurs|contribution\s+[àa]\s+la\s+performance"
    r"|top\s*\d+|encours|caract[ée]ristiques|indicateurs\s+de\s+risque)"
)
# Words of asset classes, words of anything else, and words that begin a phrase.
CLASS_WORDS = (
    r"(action|equity|obligation|oblig\b|cr[ée]dit|dette|\bbond|taux\s+(?:fixe|variable)|mon[ée]taire|liquidit|tr[ée]sorerie|\bcash|immobil"
    r"|foncier|reit|scpi|opci|infrastructure|convertible|[ée]mergent|emerging|\bor\b|gold|m[ée]taux|mati[èe]res|commodit|diversifi"
    r"|multi.?asset|alternati|private\s+equity|non\s+cot[ée]|opcvm)"
)
EXCLUDED = (
    r"(exposition|sensibilit|couverture|actuariel|rendement|yield|duration|maturit|notation|nombre|[ée]metteur|contribution|perform|volatil"
    r"|\bratio|encours|sharpe|tracking|valeur\s+liquidative|capitalisation|\bfrais|\bter\b|s[rc]ri|objectif|emprunt|\bpays\s|\bbloc\s"
    r"|amérique|afrique|moyen.?orient|\blatam|\beema|franc\s+suisse|dollar|sterling|\byen\b|devise)"
)
PHRASE = r"^(dont|dans|des|de|du|en|et|le|la|les|un|une|ou|au|aux|par|pour|sur|avec|ce|ces|son|ses|leur)\b"
# A label before or after an unsigned percentage. NUMBER_FIRST takes the character before the number in
# place of a look-behind, which the engine of the tests' SQL lacks; the matches are the same.
LABEL_FIRST = r"([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ0-9 '’/&()\-]{2,44}?)\s+(\d{1,3}(?:[.,]\d{1,2})?)\s*%"
NUMBER_FIRST = r"(?:^|[^+\-\d.,%])(\d{1,3}(?:[.,]\d{1,2})?)\s*%\s+(?:en|de|d['’])?\s*([A-Za-zÀ-ÿ][A-Za-zÀ-ÿ '’/&\-]{2,44})"
# Parts of labels and their factors, in order of precedence.
FACTORS = (
    ("emergent", "EM"), ("émergent", "EM"), ("europe", "EUROPE"), ("immobil", "RE"), ("foncier", "RE"), ("real estate", "RE"), ("reit", "RE"),
    ("scpi", "RE"), ("infrastructure", "INFRA"), ("infra", "INFRA"), ("obligation", "BONDS"), ("oblig", "BONDS"), ("taux", "BONDS"),
    ("bond", "BONDS"), ("liquidit", "CASH"), ("monetaire", "CASH"), ("monétaire", "CASH"), ("tresorerie", "CASH"), ("trésorerie", "CASH"),
    ("cash", "CASH"), ("gold", "GOLD"), ("métaux précieux", "GOLD"), ("matieres", "COMMOD"), ("matières", "COMMOD"), ("action", "WORLD"),
    ("equity", "WORLD"),
)


# White space, word ends and letter case are those of Unicode, as texts hold no-break spaces and capital accents.
ANY_CASE, WORDS = "(?iU)", "(?U)"
BREAKS = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]"


def lines(texts: DataFrame) -> DataFrame:
    """(doc_id, i, line) of texts (doc_id, text), cut at every line or page break; null texts have no lines."""
    return texts.where("text is not null").select("doc_id", F.posexplode(F.split("text", BREAKS)).alias("i", "line"))


def scoped(rows: DataFrame, most: int = 60) -> DataFrame:
    """Lines of the allocation block of documents that have one, else all: up to `most` lines after the first heading, to the next section."""
    bare = F.regexp_replace("line", rf"{WORDS}^\s+|\s+$", "")
    head, other = bare.rlike(ANY_CASE + ALLOCATION), F.col("line").rlike(ANY_CASE + OTHER)
    start = rows.where(head).groupBy("doc_id").agg(F.min("i").alias("start"))
    j = rows.join(start, "doc_id", "left")
    stop = j.where(other & ~head & (F.col("i") > F.col("start")) & (F.col("i") <= F.col("start") + most)).groupBy("doc_id").agg(F.min("i").alias("stop"))
    inside = (F.col("i") > F.col("start")) & (F.col("i") <= F.col("start") + most) & (F.col("i") < F.coalesce("stop", F.lit(1 << 30))) & ~head
    return j.join(stop, "doc_id", "left").select("doc_id", "i", "line", F.col("start").isNotNull().alias("block"), inside.alias("inside")).where("not block or inside").drop("inside")


def label_of(raw: Column) -> Column:
    """White space as one space, without outer blanks, points, colons and hyphens, in lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(raw, r"^[ .:\-]+|[ .:\-]+$", ""), rf"{WORDS}\s+", " "))


def parsed(rows: DataFrame, class_only: bool = True) -> DataFrame:
    """(doc_id, label, w): the first weight of each admitted label; a line's first label and number count."""
    first = F.col("line").rlike(WORDS + LABEL_FIRST)
    get = lambda pattern, k: F.regexp_extract("line", WORDS + pattern, k)
    raw = F.when(first, get(LABEL_FIRST, 1)).otherwise(get(NUMBER_FIRST, 2))
    val = F.when(first, get(LABEL_FIRST, 2)).otherwise(get(NUMBER_FIRST, 1))
    found = rows.where(first | F.col("line").rlike(WORDS + NUMBER_FIRST)).select(
        "doc_id", "i", label_of(raw).alias("label"), F.regexp_replace(val, ",", ".").cast("double").alias("val")
    )
    ok = (F.col("label") != "") & (F.col("val") > 0) & (F.col("val") <= 100) & ~F.col("label").rlike(WORDS + EXCLUDED)
    if class_only:
        words = F.size(F.split(F.trim("label"), rf"{WORDS}\s+"))
        ok = ok & F.col("label").rlike(WORDS + CLASS_WORDS) & (words <= 4) & (F.length("label") <= 32) & ~F.col("label").rlike(WORDS + PHRASE)
    return found.where(ok).groupBy("doc_id", "label").agg((F.min_by("val", "i") / 100).alias("w"), F.min("i").alias("pos"))


def compositions(texts: DataFrame) -> DataFrame:
    return parsed(scoped(lines(texts)))


def quality(comp: DataFrame) -> DataFrame:
    """(doc_id, n, total, reliable): two labels at least, and a sum near one."""
    g = comp.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("w").alias("s"))
    return g.select("doc_id", "n", F.round("s", 4).alias("total"), ((F.col("n") >= 2) & F.col("s").between(0.85, 1.12)).alias("reliable"))


def factor(label: Column) -> Column:
    out = F.lit(None).cast("string")
    for part, name in reversed(FACTORS):
        out = F.when(label.contains(part), name).otherwise(out)
    return out


def basket(comp: DataFrame) -> DataFrame:
    """(doc_id, factor, w): weights by factor, scaled to one; labels of no factor drop out."""
    f = comp.withColumn("factor", factor(F.lower(F.trim("label")))).where("factor is not null")
    part = f.groupBy("doc_id", "factor").agg(F.sum("w").alias("w"))
    total = part.groupBy("doc_id").agg(F.sum("w").alias("t")).where("t > 0")
    return part.join(total, "doc_id").select("doc_id", "factor", (F.col("w") / F.col("t")).alias("w"))


# Keys that name a part and keys that weigh it.
NAME_KEYS = ("libelle", "libellé", "label", "nom", "name", "classe", "categorie", "category")
WEIGHT_KEYS = ("poids", "weight", "pct", "pourcentage", "percent", "valeur", "value", "part")


def weights_by_level(rows: DataFrame) -> DataFrame:
    """(doc_id, path, label, w) of JSON texts (doc_id, json), whatever they hold.

    Levels are taken one by one until none is left, each from the texts of the values within; a map keeps an
    object's order, and variants beside it the values' types.
    """
    node, found = rows.where("json is not null").select("doc_id", F.array().cast("array<int>").alias("path"), F.col("json").alias("s")), None
    while True:
        one, many = (F.when(F.ltrim("s").startswith(c), F.col("s")) for c in "{[")
        kind = lambda v: F.transform(v, lambda x: F.schema_of_variant(x))
        parsed_ = node.select(
            "doc_id", "path", F.from_json(one, "map<string,string>").alias("m"), F.from_json(one, "map<string,variant>").alias("mv"),
            F.from_json(many, "array<string>").alias("a"), F.from_json(many, "array<variant>").alias("av"),
        )
        values, kinds = F.coalesce(F.map_values("m"), F.col("a")), F.coalesce(kind(F.map_values("mv")), kind(F.col("av")))
        keys = F.transform(F.map_keys("m"), F.lower)
        cells = settled(parsed_.select("doc_id", "path", keys.alias("keys"), F.arrays_zip(values.alias("text"), kinds.alias("kind")).alias("cells")).where("cells is not null"), "json-level")

        def picked(names):
            key = F.get(F.filter("keys", lambda k: k.isin(*names)), 0)
            last = F.size("keys") - F.array_position(F.reverse("keys"), key)
            return F.when(key.isNotNull(), F.get("cells", last.cast("int")))

        weight = picked(WEIGHT_KEYS)
        number = weight["kind"].rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")
        w = F.when(number, weight["text"].try_cast("double")).when(weight["kind"] == "BOOLEAN", F.when(weight["text"] == "true", 1.0).otherwise(0.0))
        name = picked(NAME_KEYS)
        label = F.when(name.isNotNull(), F.coalesce(F.lower(F.regexp_replace(name["text"], rf"{WORDS}^\s+|\s+$", "")), F.lit("none")))
        got = cells.where("keys is not null").select("doc_id", "path", label.alias("label"), w.alias("w")).where("label is not null and w is not null")
        found = got if found is None else found.unionByName(got)
        inner = cells.select("doc_id", "path", F.posexplode("cells").alias("at", "c")).where(F.col("c.kind").rlike("^(OBJECT|ARRAY)"))
        if inner.isEmpty():
            break
        node = inner.select("doc_id", F.concat("path", F.array("at")).alias("path"), F.col("c.text").alias("s"))
    return found


def walker():
    """(walk through a text, the same over Arrow batches), made here so that tasks carry them to executors without this package."""

    class Number(str):
        """A number as it is written."""

    def odd(text: str):
        raise ValueError(text)

    def decoder():
        """Objects as pairs in their order, numbers as they are written."""
        return json.JSONDecoder(object_pairs_hook=tuple, parse_int=Number, parse_float=Number, parse_constant=odd).raw_decode

    def walk(text: str, decode=None) -> list[tuple[list[int], str | None, float]]:
        """(path, name, weight) of all objects with both; ValueError for what is left to weights_by_level: texts that are not
        plain JSON, keys given twice, and names other than texts and null."""
        decode = decode or decoder()
        body = text.lstrip(" ")
        if body[:1] not in ("{", "["):
            return []
        try:
            root, end = decode(body)
        except RecursionError:
            raise ValueError from None
        if body[end:].strip():
            raise ValueError
        out, stack = [], [((), root)]
        while stack:
            path, node = stack.pop()
            values = node
            if type(node) is tuple:
                keys, values = [k.lower() for k, _ in node], [v for _, v in node]
                if len(set(keys)) < len(keys):
                    raise ValueError
                name, weight = (next((v for k, v in zip(keys, values) if k in wanted), odd) for wanted in (NAME_KEYS, WEIGHT_KEYS))
                if name is not odd and type(weight) in (Number, bool):
                    if name is not None and type(name) is not str or math.isinf(float(weight)):
                        raise ValueError
                    (name or "").encode()  # half a pair is no text
                    out.append((list(path), name, float(weight)))
            stack += [((*path, i), v) for i, v in enumerate(values) if type(v) in (tuple, list)]
        return out

    def run(batches):
        decode = decoder()
        for b in batches:
            rows, left = [], []
            for r, text in enumerate(b.column(1).to_pylist()):
                try:
                    rows += [(r, *x) for x in walk(text, decode)]
                except ValueError:
                    left.append(r)
            at = pa.array([x[0] for x in rows] + left, pa.int64())
            none = [None] * len(left)
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(at), *(pa.array([x[i] for x in rows] + none, kind) for i, kind in ((1, pa.list_(pa.int32())), (2, pa.string()), (3, pa.float64()))),
                 pa.array([None] * len(rows) + b.column(1).take(pa.array(left, pa.int64())).to_pylist(), pa.string())],
                ["doc_id", "path", "name", "w", "json"],
            )

    return walk, run


def json_weights(rows: DataFrame) -> DataFrame:
    """(doc_id, label, w) of JSON texts (doc_id, json): every object at any depth with a name and a weight that is a number.

    An object's first key of either kind counts, in its own order and whatever its case; of equal keys the last
    value. A name that is an object or a list counts by its JSON text. Weights over 1.5 are per cent; others than 0 to 1.001 do not count, nor do texts that hold a number.
    True is 1, as it is where this comes from. Of a document's equal labels the first in its order counts. A text
    that is no JSON has none. One walk through a text
    finds all of these; texts that the walk leaves open go level by level.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()
    texts = rows.where("json is not null").select("doc_id", F.col("json").cast("string").alias("json"))
    each = settled(texts.mapInArrow(walker()[1], f"doc_id {kind}, path array<int>, name string, w double, json string"), "json-walk")
    label = F.coalesce(F.lower(F.regexp_replace("name", rf"{WORDS}^\s+|\s+$", "")), F.lit("none"))
    found, rest = each.where("json is null").select("doc_id", "path", label.alias("label"), "w"), each.where("json is not null").select("doc_id", "json")
    if not rest.isEmpty():
        found = found.unionByName(weights_by_level(rest))
    scaled = found.withColumn("w", F.when(F.col("w") > 1.5, F.col("w") / 100).otherwise(F.col("w")))
    return scaled.where("w > 0 and w <= 1.001").groupBy("doc_id", "label").agg(F.min_by("w", "path").alias("w"))


def longest_chart(charts: DataFrame) -> DataFrame:
    """(doc_id, date, value) of landed chart lists (doc_id, json): the points of each document's longest serial chart.

    A chart is an object with type `serial` and points `dataProvider` of which the first has the key y_0; of equally
    long charts the first counts. A point's x is its date as written, its y_0 the value; a null stays null.
    """
    kind = "array<struct<type:string,dataProvider:array<map<string,string>>>>"
    each = charts.select("doc_id", F.posexplode(F.from_json("json", kind)).alias("at", "c")).where(
        (F.col("c.type") == "serial") & F.map_contains_key(F.get("c.dataProvider", 0), F.lit("y_0"))
    )
    best = each.groupBy("doc_id").agg(F.min_by("c.dataProvider", F.struct(-F.size("c.dataProvider"), "at")).alias("points"))
    point = best.select("doc_id", F.explode("points").alias("p"))
    return point.select("doc_id", F.try_element_at("p", F.lit("x")).alias("date"), F.try_element_at("p", F.lit("y_0")).try_cast("double").alias("value"))
