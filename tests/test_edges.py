"""Every query on empty tables, and on tables with nulls, empty and long texts, ties and repeated rows."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from seqloom.operators import arrays
from seqloom.plans import registry

registry.load()
SMOKE = os.environ.get("SEQLOOM_TEST_DATA", "/root/testdata/sf0.001")


@pytest.fixture(autouse=True, scope="module")
def one_partition(spark):
    """These tables are a few rows: one task a stage will do."""
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.fixture(scope="module")
def empty(tmp_path_factory):
    d = tmp_path_factory.mktemp("empty")
    for f in os.listdir(SMOKE):
        pq.write_table(pq.read_table(f"{SMOKE}/{f}").slice(0, 0), d / f)
    return str(d)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    """A few rows of each table, one of them twice, and a row of nulls; texts that are empty, long, or of one symbol."""
    d = tmp_path_factory.mktemp("odd")
    for f in os.listdir(SMOKE):
        t = pq.read_table(f"{SMOKE}/{f}").slice(0, 12)
        rows = t.to_pylist()
        rows += [rows[0], dict.fromkeys(t.column_names)]
        if f in ("documents.parquet", "pages.parquet"):
            text = "text" if f[0] == "d" else "html"
            key = t.column_names[0]
            rows += [rows[0] | {key: 10**6 + k, text: x} for k, x in enumerate(("", " ", "\n\n", "é😀\0", "e" * 30_000, "<p>a < b</p>" * 500, "word. " * 4000))]
        pq.write_table(pa.Table.from_pylist(rows, t.schema), d / f)
    return str(d)


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_empty_tables(spark, empty, name):
    assert registry.QUERIES[name](spark, empty).count() <= 1 or name in LITERAL


#: queries over literals, which no table feeds
LITERAL = {"header_sniff", "detected_blocks", "jpeg_marker_index", "scalar_ilog", "logistic_table"}


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_odd_tables(spark, odd, name):
    registry.QUERIES[name](spark, odd).collect()


def test_arrays_by_hand():
    import numpy as np

    rows = pa.RecordBatch.from_pydict({"doc_id": [1, 2, 3, 4], "text": ["abcab", None, "", "ab"]})
    (own, cp, first), = arrays.symbol_blocks([rows])
    assert own.column("doc_id").to_pylist() == [1, 3, 4] and first.tolist() == [0, 5, 5, 7]
    at, key = arrays.contexts(cp, first, 2)
    assert at.tolist() == [2, 3, 4] and len(set(key.tolist())) == 3
    at, key = arrays.contexts(cp, first, 1)
    assert arrays.before(at, key, arrays.owner(first)[at]).tolist() == [-1, -1, -1, 1, -1]
    (a, b), n = arrays.counted([np.array([1, 1, 0]), np.array([7, 7, 2])])
    assert sorted(zip(a.tolist(), b.tolist(), n.tolist())) == [(0, 2, 1), (1, 7, 2)]
    assert arrays.symbols_of(np.array([0, arrays.NUL, 97])).to_pylist() == [None, "\0", "a"]


def test_contexts_of_many_symbols():
    """Alphabets too wide to pack fall back to numbering, exactly."""
    import numpy as np

    r = np.random.default_rng(0)
    cp = r.integers(0, 60_000, 5000).astype(np.uint32)
    cp[2500:] = cp[:2500]
    first = np.array([0, 5000])
    for order in (3, 5, 9):
        at, key = arrays.contexts(cp, first, order)
        seen = {}
        for i, k in zip(at.tolist(), key.tolist()):
            assert seen.setdefault(k, tuple(cp[i - order : i])) == tuple(cp[i - order : i])
        assert len(seen) == len({tuple(cp[i - order : i]) for i in at.tolist()})
