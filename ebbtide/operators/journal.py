"""A journal of runs: records taken from nested results by path, numbered without gaps over appended files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import settled
from ..sources.store import is_there

# The portfolios and methods a record holds.
PORTFOLIOS = ("min_cdar", "hrp", "minvar_lw", "profil_prudent", "profil_equilibre", "profil_dynamique")
METHODS = ("min_cdar", "cdar_budget")
RECORD = "id long, source string, note string, hypothesis string, start string, end string, years double, n_assets long, params string, bench_cagr double, bench_maxdd double, " + ", ".join(
    [f"{p}_{m} double" for p in PORTFOLIOS for m in ("cagr", "maxdd", "calmar", "sharpe")]
    + [f"oos_{w}_{m} double" for w in METHODS for m in ("cagr", "maxdd", "calmar", "ratio")]
) + ", p50_multiple double, p95_maxdd double"


def extracted(results: DataFrame) -> DataFrame:
    """The flat record of each result (result JSON string, note, hypothesis); what a result lacks is null, a source `?`."""

    def at(path: str, kind: str = "double") -> Column:
        x = F.try_variant_get("v", f"$.{path}", kind)
        # A variant holds -0.0 as a decimal, which has no sign; the text has it.
        return F.when(x == 0, F.coalesce(F.get_json_object("result", f"$.{path}").try_cast("double"), x)).otherwise(x) if kind == "double" else x

    out = [F.coalesce(at("meta.source", "string"), F.lit("?")).alias("source"), F.coalesce("note", F.lit("")).alias("note"), F.coalesce("hypothesis", F.lit("")).alias("hypothesis")]
    out += [at(f"meta.{c}", k).alias(c) for c, k in (("start", "string"), ("end", "string"), ("years", "double"), ("n_assets", "long"))]
    out += [F.get_json_object("result", "$.params").alias("params")]
    out += [at(f"benchmark.in_sample.{c}").alias(f"bench_{n}") for c, n in (("cagr", "cagr"), ("max_drawdown", "maxdd"))]
    names = (("cagr", "cagr"), ("max_drawdown", "maxdd"), ("calmar", "calmar"), ("sharpe", "sharpe"))
    out += [at(f"portefeuilles.{p}.in_sample.{c}").alias(f"{p}_{n}") for p in PORTFOLIOS for c, n in names]
    for w in METHODS:
        out += [at(f"walk_forward.{w}.oos.{c}").alias(f"oos_{w}_{n}") for c, n in names[:3]]
        out.append(at(f"walk_forward.{w}.honnetete.ratio_realise_sur_promesse").alias(f"oos_{w}_ratio"))
    mc = "monte_carlo_equilibre"
    out += [at(f"{mc}.multiple_terminal.p50").alias("p50_multiple"), at(f"{mc}.max_drawdown.p95").alias("p95_maxdd")]
    order = [c for c in results.columns if c not in ("result", "note", "hypothesis")]
    return results.withColumn("v", F.try_parse_json("result")).select(*order, *out)


def numbered(rows: DataFrame, order: list[str], base: int = 0) -> DataFrame:
    """Rows with ids base + 1, base + 2, ... in an order: each range counts its own, one sum of a row a range places them."""
    ranged = settled(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_at")), "journal-rows")
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranged.join(F.broadcast(sizes.select("_part", before.alias("_before"))), "_part")
    k = F.row_number().over(Window.partitionBy("_part").orderBy("_at"))
    return placed.withColumn("id", F.lit(base) + F.col("_before") + k).drop("_part", "_at", "_before")


def append(spark, path: str, results: DataFrame, order: list[str]) -> DataFrame:
    """Append the records of results, in an order of columns they have besides, to the JSON lines at `path`; one writer at a time."""
    base = load(spark, path).agg(F.max("id")).first()[0] or 0
    columns = [c.split()[0] for c in RECORD.split(", ")]
    new = settled(numbered(extracted(results), order, base).select(*columns), "journal-new")
    new.write.mode("append").json(path)
    return new


def load(spark, path: str) -> DataFrame:
    return spark.read.schema(RECORD).json(path) if is_there(spark, path) else spark.createDataFrame([], RECORD)


def percent(x: Column) -> Column:
    """+1.2% of 0.012, halves of 1000 x as a double away from zero, -0.0% below zero; a dash for what is missing."""
    tenths = F.abs(x * 100) * 10
    # Doubles from 2^52 on are whole.
    whole = F.when(tenths < float(1 << 52), F.floor(tenths + 0.5).cast("double")).otherwise(tenths)
    return F.when(x.isNull() | F.isnan(x), "—").otherwise(F.format_string("%+.1f%%", F.signum(x) * whole / 10))


def ranked(journal: DataFrame) -> DataFrame:
    """(place, id, source, years, cagr, maxdd, calmar, bench, note) as shown, by the balanced profile's Calmar, a missing or zero one as -1."""
    calmar = F.coalesce(F.nullif("profil_equilibre_calmar", F.lit(0.0)), F.lit(-1.0))
    rows = numbered(journal.withColumn("_order", -calmar).withColumnRenamed("id", "run"), ["_order", "run"])
    return rows.select(
        F.col("id").alias("place"), F.col("run").alias("id"), F.substring("source", 1, 22).alias("source"), "years", percent(F.col("profil_equilibre_cagr")).alias("cagr"),
        percent(F.col("profil_equilibre_maxdd")).alias("maxdd"), F.col("profil_equilibre_calmar").alias("calmar"), percent(F.col("bench_maxdd")).alias("bench"),
        F.substring("note", 1, 40).alias("note"),
    )
