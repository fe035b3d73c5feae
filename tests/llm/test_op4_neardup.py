import random
import re

import numpy as np

from seqloom.llm import neardup as N


def plain(a, b):
    """Kept shingles of a full alignment over all of either."""
    m, n = len(a), len(b)
    d = [[i + j if not i or not j else 0 for j in range(n + 1)] for i in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            d[i][j] = min(d[i - 1][j - 1] + (a[i - 1] != b[j - 1]), d[i - 1][j] + 1, d[i][j - 1] + 1)
    i, j, run, kept = m, n, 0, 0
    while i or j:
        if i and j and d[i - 1][j - 1] + (a[i - 1] != b[j - 1]) <= d[i][j]:
            if a[i - 1] == b[j - 1]:
                run += 1
            else:
                kept, run = kept + max(0, run - 4), 0
            i, j = i - 1, j - 1
            continue
        kept, run = kept + max(0, run - 4), 0
        if i and d[i - 1][j] + 1 <= d[i][j]:
            i -= 1
        else:
            j -= 1
    kept += max(0, run - 4)
    return kept / (max(1, m - 4) + max(1, n - 4) - kept)


def edited(r, a, n):
    b = list(a)
    for _ in range(n):
        k, how = r.randrange(len(b)), r.random()
        if how < 0.5:
            b[k] = r.randrange(1, 500)
        elif how < 0.75:
            b[k:k] = [r.randrange(1, 500) for _ in range(r.randint(1, 6))]
        else:
            del b[k : k + r.randint(1, 5)]
        b = b or [1]
    return b


def test_banded_alignment():
    r, pairs = random.Random(5), []
    for _ in range(150):
        a = [r.randrange(1, 300) for _ in range(r.randint(5, 150))]
        pairs.append((a, edited(r, a, r.randint(0, max(1, len(a) // 20)))))
    found = N.similarities([(np.array(a, np.uint32), np.array(b, np.uint32)) for a, b in pairs])
    expected = np.array([plain(a, b) for a, b in pairs])
    assert (expected >= 0.8).sum() > 30
    assert ((found >= 0.8) == (expected >= 0.8)).mean() > 0.98


def test_sketches_follow_order():
    def one(ws):
        h = np.array(ws, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return N.order_minhash(*N.shingles(h, np.array([0, len(ws)])), sketches=200)[0]

    a = list(range(1, 200))
    assert (one(a) == one(a)).all()
    near, swapped = a[:100] + [999] + a[101:], a[100:] + a[:100]
    assert (one(a) == one(near)).mean() > 0.8
    assert 0.3 < (one(a) == one(swapped)).mean() < 0.7  # the same k-mers, half of the pairs in the other order
    assert (one([1] * 7) != one([1] * 6)).mean() > 0.3  # occurrences tell them apart


def documents(seed=1):
    r = random.Random(seed)
    rows, n = [], 0
    for _ in range(25):
        base = [r.randrange(1, 5000) for _ in range(r.randint(60, 200))]
        for _ in range(r.randint(1, 6)):
            rows.append((n, " ".join(f"w{x}" for x in edited(r, base, max(1, len(base) // 60)))))
            n += 1
        rows.append((n, rows[-1][1].upper() + "."))
        n += 1
    return rows


def test_classes_against_brute_force(spark):
    rows = documents()
    own = {i: re.findall(r"[a-z0-9]+", t.lower()) for i, t in rows}
    parent = {i: i for i in own}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in own:
        for j in own:
            if i < j and plain(own[i], own[j]) >= 0.8:
                parent[max(top(i), top(j))] = min(top(i), top(j))
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, class_id string")
    found = {r.doc_id: r for r in N.near_duplicates(docs).collect()}
    expected = {i: top(i) for i in own}
    same = lambda c: {(i, j) for i in c for j in c if i < j and c[i] == c[j]}
    got, want = same({i: r.class_id for i, r in found.items()}), same(expected)
    assert got == want
    assert {i for i, r in found.items() if r.kept} == {r.class_id for r in found.values()}
    assert {r.doc_id for r in N.keep_one(docs).collect()} == {r.class_id for r in found.values()}
    assert N.keep_one(docs).columns == docs.columns


def test_edges(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "..."), (4, "a b"), (5, "A  b!"), (5, "a b"), (None, "a b"), (6, "a b c"), (7, "x " * 30000), (8, "Été là"), (9, "été LÀ"), (None, "alone here")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = N.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    by = {r.doc_id: r.class_id for r in found if r.doc_id}
    assert by[1] == by[2] == by[3] == 1 and by[4] == by[5] == 4 and by[6] == 6 and by[8] == by[9] == 8
    assert sum(r.kept for r in found) == 6
    assert N.keep_one(docs).count() == 6
    monkeypatch.setattr(N, "BROADCAST_ROWS", 0)  # rows to drop that are too many to send
    assert N.keep_one(docs).count() == 6
    none = spark.createDataFrame([], "doc_id long, text string")
    assert N.near_duplicates(none).count() == 0 and N.keep_one(none).count() == 0


def crowd(seed=3):
    """Documents put together from a few shared passages, so that every bucket is crowded, each with a copy; and drifting copies."""
    r = random.Random(seed)
    passages = [[f"p{k}w{x}" for x in range(25)] for k in range(12)]
    made = {}
    while len(made) < 120:
        made.setdefault(tuple(sorted(r.sample(range(12), 6))))
    own = []
    for some in made:
        ws = [w for k in some for w in passages[k]]
        own.append(ws)
        own.append([*ws[:70], f"changed{len(own)}", *ws[71:]])
    ws = [f"d{x}" for x in range(200)]
    for k in range(40):
        ws = [*ws[: k * 5], f"drift{k}", *ws[k * 5 + 1 :]]
        own.append(ws)
    r.shuffle(own)
    return own


def test_crowded_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(N, "PART", 16)  # parts and cells of a bucket too
    own = crowd()
    number = {w: k for k, w in enumerate(sorted({w for ws in own for w in ws}))}
    coded = [np.array([number[w] for w in ws], np.uint32) for ws in own]
    pairs = [(i, j) for j in range(len(own)) for i in range(j)]
    label = list(range(len(own)))
    for (i, j), s in zip(pairs, N.similarities([(coded[i], coded[j]) for i, j in pairs])):
        if s >= N.SIMILARITY and label[i] != label[j]:
            low, high = sorted((label[i], label[j]))
            label = [low if x == high else x for x in label]
    assert len(set(label)) == 121
    docs = spark.createDataFrame([(i, " ".join(ws)) for i, ws in enumerate(own)], "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in N.near_duplicates(docs).collect()} == dict(enumerate(label))


def test_cells_name_every_pair_of_classes():
    r = np.random.default_rng(4)
    bins = r.integers(0, 3, (500, N.BINS)).astype(np.uint8) * (r.random((500, 1)) < 0.9).astype(np.uint8)
    bins[250:] = np.where(r.random((250, N.BINS)) < 0.8, bins[:250], bins[250:])
    n, label = r.integers(50, 80, 500), r.integers(0, 200, 500)
    node = r.permutation(5000)[:500]
    none = [[] for _ in node]
    earlier = r.integers(0, 3, (500, 2))
    for side in (np.zeros(500, int), np.arange(500) % 2):
        x, y, share = N.named_in(node, n, bins, label, side, none, earlier, 500)
        used = ((bins[:, None] > 0) | (bins > 0)).sum(2)
        alike = ((bins[:, None] == bins) & (bins > 0)).sum(2) / np.maximum(used, 1)
        on = (label[:, None] != label) & (np.minimum(n[:, None], n) >= N.SIMILARITY * np.maximum(n[:, None], n)) & (alike >= N.floor_of(np.maximum(used, 1), n[:, None], n))
        if side.any():
            on &= side[:, None] != side
        on &= (earlier[:, None] != earlier).all(2)
        both = {(min(a, b), max(a, b)) for a, b in zip(x.tolist(), y.tolist())}
        assert len(both) == len(x) and both == {(a, b) for a, b in zip(*(v.tolist() for v in np.nonzero(on))) if a < b}
        assert np.allclose(share, alike[x, y])
        # the same pairs come if each row names two at a time, until nobody is left
        tried, met = [[] for _ in node], set()
        for _ in range(200):
            x, y, _ = N.named_in(node, n, bins, label, side, tried, earlier, 2)
            if not len(x):
                break
            assert np.bincount(x).max() <= 2
            for a, b in zip(x.tolist(), y.tolist()):
                tried[a].append(int(node[b]))
                met.add((min(a, b), max(a, b)))
        assert met == both


def test_rows_grow_with_the_members(spark):
    """A round makes a few pairs a member, however large a group of near copies is."""
    r = np.random.default_rng(5)
    base = r.integers(1, 200, N.BINS)
    rows = [(7, 400, k, 100, np.where(r.random(N.BINS) < 0.1, 201, base).astype(np.uint8).tobytes(), k, None, []) for k in range(400)]
    df = spark.createDataFrame(rows, "bucket long, company long, node long, n_words int, bins binary, label long, tried array<long>, earlier array<long>")
    assert 0 < N.name_partners(df, 2).count() <= 800


def test_links_of_a_query_set(spark):
    """Every row whose id is divisible by 20 against all rows of a small table: each pair at 0.8 or more shares a class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    rows = [(x.doc_id, np.array([hash(w) % (1 << 32) for w in re.findall(r"[^\W_]+", (x.text or "").lower())], np.uint32)) for x in docs.collect()]
    found = {x.doc_id: x.class_id for x in N.near_duplicates(docs).collect()}
    queries = [x for x in rows if x[0] % 20 == 0 and len(x[1])]
    pairs = [(i, j, a, b) for i, a in queries for j, b in rows if i != j and len(b) and len(np.intersect1d(a, b)) >= 0.5 * max(len(np.unique(a)), len(np.unique(b)))]
    alike = N.similarities([(a, b) for _, _, a, b in pairs])
    linked = [(i, j) for (i, j, _, _), s in zip(pairs, alike) if s >= N.SIMILARITY]
    assert linked and all(found[i] == found[j] for i, j in linked)
