"""Every registered query with SQL gives the rows DuckDB gives."""

import duckdb
import pytest
from pyspark.sql import SparkSession

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def spark():
    return SparkSession.builder.master("local[4]").config("spark.sql.shuffle.partitions", "4").getOrCreate()


@pytest.mark.parametrize("name", sorted(E.core.ORACLE_SQL | E.more.ORACLE_SQL | E.funds.ORACLE_SQL | E.panels.ORACLE_SQL | E.batches.ORACLE_SQL))
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    want, got = con.sql(E.oracle_sql()[name]).df(), E.queries()[name](spark, SF).toPandas()
    cols = sorted(want.columns)
    assert sorted(got.columns) == cols

    def rows(df):
        def plain(c, v):
            if v is None or v != v:
                return None
            if isinstance(v, float):
                return round(v, 5) + 0.0
            return str(v)[:10] if c in ("week", "date", "start", "end", "lo", "hi", "last", "fetched_on") else v

        return sorted((tuple(plain(c, v) for c, v in zip(cols, r)) for r in df[cols].itertuples(index=False)), key=str)

    assert rows(got) == rows(want)
