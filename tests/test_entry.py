import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from litweave.plans import oracle, queries

DATA = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 9) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
@pytest.mark.parametrize("name", sorted(oracle.SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    df = queries.QUERIES[name](spark, DATA)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    r = con.execute(oracle.SQL[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(row[names.index(c)]) for c in cols]) for row in r.fetchall())


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")
def test_votes_stream(spark):
    from litweave.streaming import votes

    schema = spark.read.parquet(f"{DATA}/screen_decisions.parquet").schema
    s = votes.distinct_votes(votes.read_votes(spark, f"{DATA}/screen_decisions.parquet*", schema))
    q = s.writeStream.format("memory").queryName("votes").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("votes").count() == spark.read.parquet(f"{DATA}/screen_decisions.parquet").select("decision_id").distinct().count()
