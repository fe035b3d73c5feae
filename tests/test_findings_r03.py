"""Round 3's findings: what held a shuffle by symbol, or a batch in memory, no longer does; results as the SQL's, on odd rows too."""

import os
import tracemalloc

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from test_queries import rows

from seqloom.operators import learners, media, transforms
from seqloom.plans import registry

registry.load()
SMOKE = os.environ.get("SEQLOOM_TEST_DATA", "/root/testdata/sf0.001")

#: queries that once numbered each symbol of a text by a window, or met texts by a join
NO_WINDOW = ["previous_words", "cross_doc_match", "dict_roundtrip", "number_merge", "codeword_context", "vocab_mask", "leaky_counter", "linear_extrapolation_error", "byte_above", "masked_contexts", "class_stream_collapsed", "indirect_context", "sparse_context", "bit_contexts", "column_since_newline", "interval_context", "distance_to_marks"]

TEXTS = ["", "a", "ab", "abc", "\n", "\n\n", "ab\ncd\n\nefg\n", "x\n\ny\nyz", "İKılſ aeiou AEIOU 123 é😀\0z", "é😀é😀é😀", "ΑΣ ΣΑ ÉÀ ΑΣ ΣΑ ÉÀ", "the lazy fly. the lazy fly! 12 34\t5", "Only ONE oNe 007  8 ly LY-ly", "a b c d e f g", "z b c d e f g", "\x07tab\there; now: then, ok?", None]


@pytest.fixture(scope="module")
def odd_texts(tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    n = len(TEXTS)
    pq.write_table(pa.table({"doc_id": pa.array([*range(n - 1), None], pa.int64()), "text": [*TEXTS[:-1], "no key, a b c d e f g"], "lang": ["en"] * n, "source": ["web"] * n, "n_chars": pa.array([len(t or "") for t in TEXTS], pa.int64())}), d / "documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{d}/documents.parquet'")
    return str(d), con


@pytest.mark.parametrize("name", NO_WINDOW)
def test_no_row_for_each_symbol(spark, odd_texts, name):
    d, con = odd_texts
    df = registry.QUERIES[name](spark, d)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "posexplode" not in plan
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(names, want.fetchall())


GRID = ["grid_neighbours", "grid_gradient_residual", "grid_runs", "rgb_decorrelate", "rgb_restore", "packed_pixel_runs"]


@pytest.mark.parametrize("name", GRID)
def test_samples_are_floats(spark, tmp_path, name):
    """A value just under a step is rounded onto it by a float's 24 bits, not by a double's."""
    r = np.random.default_rng(3)
    steps = (r.integers(0, 256, (8, 12)) - 128) / 64
    under = np.nextafter(steps.astype(np.float32), np.float32(-9))
    under[0, :3], under[1, :2] = [9e9, -9e9, np.nan], [np.inf, -np.inf]
    own = [x.tolist() for x in under]
    own[2][4] = None
    pq.write_table(pa.table({"vec_id": pa.array(range(8), pa.int64()), "embedding": pa.array(own, pa.list_(pa.float32())), "label": pa.array([0] * 8, pa.int32())}), tmp_path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(registry.ORACLES[name])
    names = [c[0] for c in want.description]
    assert rows(df.columns, [tuple(x) for x in df.collect()]) == rows(names, want.fetchall())


#: folds by user that once started Python for each user
MANY_USERS = ["model_costs", "lstm_cost"]


@pytest.mark.parametrize("name", MANY_USERS)
def test_users_step_together(spark, name):
    assert "FlatMapGroups" not in registry.QUERIES[name](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()


def test_costs_are_those_of_each_model():
    """Sequences of unlike lengths side by side cost what each costs alone."""
    r = np.random.default_rng(1)
    own = [(r.random(n) < p).astype(np.int64) for n, p in ((40, 0.5), (1, 0.5), (90, 0.1), (300, 0.8), (40, 0.95))]
    first = np.cumsum([0, *map(len, own)])
    found = learners.costs(list(learners.MODELS.values()), np.concatenate(own), first)
    want = [[learners.cost(make(), x.tolist()) for make in learners.MODELS.values()] for x in own]
    assert np.allclose(found, want, rtol=0, atol=1e-9)


def test_sequences_are_whole(monkeypatch):
    """Keys that go over batches and over what is held come whole, a null key too."""
    monkeypatch.setattr(learners, "HELD_ROWS", 4)
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 3, 3, 3, 0, None, None]
    batches = [pa.RecordBatch.from_pydict({"k": pa.array(keys[a : a + 3], pa.int64())}) for a in range(0, len(keys), 3)]
    found = [(rows.column("k").to_pylist()[a:b]) for rows, first in learners.sequences(iter(batches), "k") for a, b in zip(first, first[1:])]
    assert found == [[1] * 3, [2], [3] * 7, [0], [None] * 2]


def test_networks_learn_as_each_alone():
    r = np.random.default_rng(2)
    own = [r.integers(0, k, n) for n, k in ((45, 3), (1, 1), (70, 3), (21, 2))]
    kinds = np.array([len(np.unique(x)) for x in own])
    own = [np.unique(x, return_inverse=True)[1] for x in own]
    bits, same = learners.symbol_costs(np.concatenate(own), np.cumsum([0, *map(len, own)]), kinds)
    for x, k, found in zip(own, kinds.tolist(), bits[:, 0]):
        net, total = learners.Lstm(k), 0.0
        for s in x.tolist():
            total -= np.log2(net.predict()[s])
            net.update(s)
        assert abs(total - found) < 1e-8
    assert same.all()


def peak(work, text, n):
    """MB that Python takes at most over ``n`` texts of one batch."""
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(n), pa.int64()), "text": pa.array([text] * n, pa.string())})
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in work(iter([batch]))) == n
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_instructions_of_a_batch_are_not_held():
    assert peak(media.instruction_counts, "x & a" * 4000, 60) < 1


def test_trips_of_a_batch_are_not_held():
    assert peak(transforms.address_trips, "x & z" * 40_000, 60) < 4
