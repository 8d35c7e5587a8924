"""Registered queries against their SQL in DuckDB, on small tables made here."""

import math
import random

import duckdb
import pytest

import __spark_entry__ as entry
from fluxweave import catalog


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng, d = random.Random(9), str(tmp_path_factory.mktemp("tables"))
    lineitem = [(i, float(rng.randint(1, 50)), rng.randint(0, 10) / 100, float(rng.randint(900, 90000)), rng.choice("ANR"), i * 7 % 9 / 100, i % 7 + 1) for i in range(1500)]
    spark.createDataFrame(lineitem, "l_orderkey long, l_quantity double, l_discount double, l_extendedprice double, l_returnflag string, l_tax double, l_linenumber int").write.parquet(f"{d}/lineitem.parquet")
    for name, p, n in (("customer", "c", 150), ("supplier", "s", 12)):
        rows = [(i, rng.randint(-99999, 999999) / 100) for i in range(1, n)]
        spark.createDataFrame(rows, f"{p}_{'cust' if p == 'c' else 'supp'}key long, {p}_acctbal double").write.parquet(f"{d}/{name}.parquet")
    spark.sql("SELECT timestamp_micros(1700000000000000 + id * 7919000000) AS ts FROM range(300)").selectExpr("cast(ts as timestamp_ntz) as ts").write.parquet(f"{d}/events.parquet")
    return d


def _plain(v):
    if v is None or isinstance(v, (bool, str)):
        return v
    return tuple(map(float, v)) if hasattr(v, "__len__") else float(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_against_sql(spark, folder, name):
    con = duckdb.connect()
    for t in ("lineitem", "customer", "supplier", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    got = catalog.QUERIES[name](spark, folder)
    cols = sorted(got.columns)
    want = con.sql(catalog.ORACLE_SQL[name])
    assert sorted(want.columns) == cols
    a = sorted((tuple(_plain(v) for v in r) for r in got.select(*cols).collect()), key=repr)
    b = sorted((tuple(_plain(v) for v in r) for r in want.select(*cols).fetchall()), key=repr)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert x == pytest.approx(y, abs=2e-6) if not any(isinstance(v, tuple) for v in x) else repr(x) == repr(y)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_others_give_finite_rows(spark, folder, name):
    rows = catalog.QUERIES[name](spark, folder).collect()
    assert rows
    for r in rows:
        for v in r:
            assert v is not None
            assert not isinstance(v, float) or math.isfinite(v)


def test_every_query_is_registered_once():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(catalog.QUERIES) <= set(entry.queries())
