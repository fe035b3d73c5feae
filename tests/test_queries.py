"""Every query that has an oracle against it, on the smallest tables."""

import math
import os

import duckdb
import pytest

from seqloom.plans import registry

registry.load()
SMOKE = os.environ.get("SEQLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SMOKE):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SMOKE}/{f}'")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return float(f"{v:.8g}") if v else 0.0
    return v


def rows(names, found):
    by = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([plain(r[i]) for i in by]) for r in found)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_oracle(spark, duck, name):
    df = registry.QUERIES[name](spark, SMOKE)
    want = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_rows(spark, name):
    df = registry.QUERIES[name](spark, SMOKE)
    found = df.collect()
    assert found
    for r in found:
        for key in ("same", "weights_same"):
            assert key not in df.columns or r[key]


def test_every_query_says_what_it_covers():
    assert set(registry.COVERS) == set(registry.QUERIES)
    assert all(registry.COVERS.values())


def test_partitions_do_not_matter(spark):
    name = "prefix_mean_predictor"
    one = sorted(registry.QUERIES[name](spark, SMOKE).collect())
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "1")
        assert sorted(registry.QUERIES[name](spark, SMOKE).collect()) == one
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
