"""All queries against their SQL, and a stream against a batch."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from keelson.operators import state
from keelson.plans import catalogue
from keelson.streaming import oplog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return c


def rows(columns, table):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    return sorted(repr(tuple(r[k] for k in order)) for r in table)


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query(spark, con, name):
    df = catalogue.QUERIES[name](spark, SF)
    got = df.collect()
    if name in catalogue.ORACLES:
        want = con.execute(catalogue.ORACLES[name])
        assert rows(df.columns, got) == rows([d[0] for d in want.description], want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() == 25
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_stream(spark, tmp_path):
    ops = catalogue.ops(spark, SF)
    ops.repartition(3).write.parquet(str(tmp_path / "log"))
    query = oplog.latest_stream(oplog.read_stream(spark, str(tmp_path / "log"))).writeStream.outputMode("complete").format("memory").queryName("latest").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("latest").exceptAll(state.latest(ops)).isEmpty() and spark.table("latest").count() == 75
    oplog.to_runs(oplog.read_stream(spark, str(tmp_path / "log")), str(tmp_path / "runs"), str(tmp_path / "ck")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "runs")).select("key").distinct().count() == 75
