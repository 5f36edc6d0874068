"""Every catalog query that has an equivalent in SQL gives the same rows as DuckDB."""

from __future__ import annotations

import duckdb
import pytest
from pyspark.sql import functions as F

from apiarium.operators import inherit
from apiarium.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def rows(frame) -> list[str]:
    frame = frame[sorted(frame.columns)].astype(object)
    return sorted(map(str, frame.where(frame.notna(), None).itertuples(index=False, name=None)))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_queries_without_sql(spark):
    for name in set(QUERIES) - set(ORACLES):
        assert QUERIES[name](spark, SF).count() > 0


def test_location_method_of_odd_keys(spark, tmp_path):
    """The first open order has key 0, a negative one or none; owners repeat, have no open order, or are null."""
    con = duckdb.connect()
    con.execute("""CREATE TABLE orders AS SELECT * FROM (VALUES (0, 1, 'O'), (3, 1, 'O'), (4, 1, 'F'), (0, 2, 'P'), (9, 2, 'O'), (10, 2, 'O'), (-3, 3, 'O'), (0, 3, 'O'), (15, 3, 'P'), (16, 4, 'F'), (21, 4, NULL),
        (0, NULL, 'O'), (22, NULL, 'O'), (NULL, 5, 'O'), (27, 5, 'P'), (5, 5, 'O'), (7, 6, 'O'), (8, 6, 'O')) t(o_orderkey, o_custkey, o_orderstatus)""")
    con.execute(f"COPY orders TO '{tmp_path}/orders.parquet' (FORMAT parquet)")
    got = QUERIES["location_method"](spark, str(tmp_path)).select("o_orderkey", "method").collect()
    want = con.execute(f"SELECT o_orderkey, method FROM ({ORACLES['location_method']})").fetchall()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert (3, "0") in [tuple(r) for r in got]


def test_first_methods_need_a_token(spark):
    members = spark.createDataFrame([("T", 1, True, 0), ("T", 2, False, 8), ("T", 3, True, 9), ("T", 4, True, 7), ("U", 5, True, 0)], "owner string, uid int, method boolean, token int")
    found = inherit.first_methods(members, owner="owner", uid="uid", is_method=F.col("method"), token=F.col("token"), order="uid")
    assert [tuple(r) for r in found.collect()] == [("T", 3)]
