import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqloom.llm import eliasfano as E
from seqloom.llm import lm

WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.mark.parametrize("n,top", [(0, 1), (1, 1), (1, 1 << 60), (5, 3), (1000, 1 << 40), (30000, 1 << 63), (5000, 2000)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.sort(r.integers(0, top, n, dtype=np.uint64))
    e = E.EliasFano.build(v)
    assert (e.access(np.arange(n)) == v).all()
    q = np.concatenate([v, v + np.uint64(1), r.integers(0, top, 500, dtype=np.uint64), [0]]).astype(np.uint64)
    assert (e.successor(q) == np.searchsorted(v, q)).all()


def test_trie_in_a_mapping():
    r = np.random.default_rng(1)
    n = 20000
    c = np.sort(r.integers(0, 1 << 64, 3000, dtype=np.uint64))[np.sort(r.integers(0, 3000, n))]
    s = r.integers(0, 1 << 40, n, dtype=np.uint64)
    by = np.lexsort((s, c))
    c, s = c[by], s[by]
    p, b = r.random(n), r.random(len(np.unique(c)))
    level = E.mapped(E.TrieLevel.build(c, s, p, b))
    seen, back = level.find(c, s)
    assert np.abs(np.log10(E.SEEN.value(seen)) - np.log10(p)).max() < 0.02 and (back > 0).all()
    seen, back = level.find(c, s + np.uint64(1))
    assert not seen.any() and back.all()
    assert not level.find(c + np.uint64(1), s)[1].any()
    assert level.nbytes() < 12 * n


def brute(docs, order, prior):
    """Exact scores; only the trie's codes differ."""
    held = {k: i is not None and zlib.crc32(str(i).encode()) % 10 == 0 for k, (i, _) in enumerate(docs)}
    own = {}
    for k, (_, t) in enumerate(docs):
        t = "".join(chr(ord(x) + 32) if "A" <= x <= "Z" else x for x in t or "")
        own[k] = [*WORD.findall(t), None]
    grams = [Counter() for _ in range(order + 1)]
    totals = [Counter() for _ in range(order + 1)]
    for k, ws in own.items():
        if held[k]:
            continue
        for n in range(1, order + 1):
            padded = ["<s>"] * (n - 1) + ws
            for i in range(len(ws)):
                g = tuple(padded[i : i + n])
                grams[n][g] += 1
                totals[n][g[:-1]] += 1
    big_n, v = sum(grams[1].values()), len(grams[1])
    out = []
    for k, ws in own.items():
        base = score = 0.0
        for i, w in enumerate(ws):
            p = (grams[1][(w,)] + 0.1) / (big_n + 0.1 * (v + 1))
            base += math.log10(p)
            for n in range(2, order + 1):
                g = tuple((["<s>"] * (n - 1) + ws)[i : i + n])
                c = totals[n][g[:-1]]
                p = grams[n][g] / (c + prior) + prior / (c + prior) * p
            score += math.log10(p)
        out.append((docs[k][0], held[k], len(ws), sum(grams[1][(w,)] > 0 for w in ws), big_n, base, score))
    return out


def case():
    r = random.Random(6)
    words = ["The", "of", "river", "Été", "x,", "a\0b", "日本", "stone", "LIGHT"]
    docs = [(i, r.choice([" ", "\n", "\t "]).join(r.choice(words) for _ in range(r.randint(1, 30)))) for i in range(80)]
    docs += [(i, "the river of light runs to the stone") for i in range(100, 120)]
    return docs + [(200, None), (201, ""), (202, " \n"), (None, "the river"), (203, "w" * 3000), (5, "again the river"), (204, "the of " * 3000)]


@pytest.mark.parametrize("order,shard", [(2, 2_000_000), (2, 40), (3, 100), (4, 60)])
def test_against_brute_force(spark, order, shard):
    docs = case()
    df = spark.createDataFrame([(i, t, 1.0) for i, t in docs], "doc_id long, text string, score double")
    key = lambda r: (r[0] is None, r[0] or 0, r[2])
    found = sorted((tuple(r) for r in lm.score_documents(df, order, shard_words=shard).collect()), key=key)
    expected = sorted(brute(docs, order, lm.PRIOR), key=key)
    assert [f[:5] for f in found] == [e[:5] for e in expected]
    for f, e in zip(found, expected):
        assert math.isclose(f[5], e[5], rel_tol=1e-9)
        assert abs(f[6] - e[6]) < 0.018 * (order - 1) * f[2] and f[6] <= 0  # half a step of the codes a token and level
    repeated = [f for f in found if f[0] and 100 <= f[0] < 120]
    assert all(f[6] > f[5] for f in repeated)


def test_shards_do_not_matter(spark):
    """Hot contexts, which all shards hold a part of, score as they would in one shard."""
    df = spark.createDataFrame(case(), "doc_id long, text string")
    one = sorted(map(str, lm.score_documents(df, 3).collect()))
    assert sorted(map(str, lm.score_documents(df, 3, shard_words=50).collect())) == one


def test_empty(spark):
    assert lm.score_documents(spark.createDataFrame([], "doc_id long, text string")).count() == 0
