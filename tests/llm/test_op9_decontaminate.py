import hashlib
import random
import re

import numpy as np
import pyarrow as pa

from seqloom.llm import decontaminate as D
from seqloom.llm.columns import texts


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def digest(items):
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def brute(docs, items, window=8):
    seen = {}
    for item, text in items:
        ws = WORD.findall((text or "").translate(LOWER))
        for k in range(max(1, len(ws) - window + 1)) if ws else ():
            seen.setdefault(tuple(ws[k : k + window]), set()).add(str(item))
    out = []
    for doc, text in docs:
        ws = WORD.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(w) for w in seen}:
            for k in range(len(ws) - n + 1):
                own = seen.get(tuple(ws[k : k + n]))
                if own:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((doc, len(ws), len(hit), len(found), digest(found), len(found) >= 2))
    return out


def case(seed=0):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "Été", "x9", "a", "b", "c", "long-word", "日本"])
    items = [(i, " ".join(word() for _ in range(r.choice([1, 3, 8, 12])))) for i in range(12)] + [(12, None), (13, " .. "), (3, "the the the")]
    docs = []
    for i in range(60):
        own = [word() for _ in range(r.randint(0, 40))]
        if i % 3 == 0:
            own[5:5] = [r.choice(items)[1] or ""]
        docs.append((i, ", ".join(own).upper() if i % 5 == 0 else " ".join(own)))
    return docs + [(60, None), (61, ""), (61, ""), (None, "the the the")], items


def key(rows):
    return sorted(tuple(r) for r in rows if r[0] is not None), [tuple(r)[1:] for r in rows if r[0] is None]


def test_against_brute_force(spark):
    docs, items = case()
    d = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id long, text string, n_hit string")
    b = spark.createDataFrame(items, "item_id long, text string")
    expected = key(brute(docs, items))
    assert key(D.decontaminate(d, b).collect()) == expected
    several = D.decontaminate(d, b, block_windows=5)
    assert key(several.collect()) == expected
    for most in (D.BLOCK_WINDOWS, 5):
        clean = sorted(str(r.doc_id) for r in D.keep_clean(d, b, most).collect())
        assert clean == sorted(str(r[0]) for r in brute(docs, items) if not r[3])


def test_equal_rows_over_partitions(spark):
    """Segments of equal content stay apart, whatever the number of passes."""
    rows = [(1, "alpha beta gamma"), (2, "none of it")] * 4
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    items = [(1, "alpha beta"), (2, "beta gamma"), (3, "gamma")]
    b = spark.createDataFrame(items, "item_id long, text string")
    for most in (100, 1):
        assert key(D.decontaminate(d, b, block_windows=most).collect()) == key(brute(rows, items))


def test_passage_of_very_many_items(spark):
    items = [(i, "one passage that every item of this benchmark has") for i in range(300)]
    b = spark.createDataFrame(items, "item_id long, text string")
    docs = [(1, "x one passage that every item of this benchmark has"), (2, "one passage")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    assert key(D.decontaminate(d, b, block_windows=7).collect()) == key(brute(docs, items))


def test_long_text(spark):
    docs = [(1, "w " * 400_000 + "a b c d e f g h"), (2, "a b c d e f g h " * 3000)]
    items = [(1, "a b c d e f g h"), (2, "b c d e f g h a")]
    found = D.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert key(found.collect()) == key(brute(docs, items))


def test_search_near(spark):
    docs = [(1, "a b c d e f"), (2, "f a"), (3, "c x x x a b"), (3, "c x x x a b"), (None, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    queries = spark.createDataFrame([("q", "a c"), ("r", "F a"), ("s", "a nowhere"), ("t", "..")], "item_id string, text string")
    for most in (100, 1):
        index = D.stored(D.build_index(d), "postings")
        got = sorted((r.item, r.doc_id) for r in D.search_near(index, queries, 4, most).collect())
        assert got == [("q", 1), ("q", 3), ("q", 3), ("r", 2)]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    nothing = spark.createDataFrame([], "item_id long, text string")
    one = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert D.decontaminate(none, nothing).count() == 0
    assert [tuple(r)[:4] for r in D.decontaminate(one, nothing).collect()] == [(1, 2, 0, 0)]
    assert D.keep_clean(one, nothing).count() == 1


def test_near():
    s = D.Segment.build(*texts(pa.array(["a b c d e f", "f a", "c x x x a b"])))
    import xxhash

    number = lambda *ws: s.lookup(np.array([xxhash.xxh64_intdigest(w.encode()) for w in ws], np.uint64))
    assert s.docs_of(s.near(number("a", "c"), 2)).tolist() == [0]
    assert s.docs_of(s.near(number("a", "c"), 4)).tolist() == [0, 2]
    assert s.docs_of(s.near(number("a", "f"), 1)).tolist() == [1]
    assert len(s.near(number("a", "nowhere"), 9)) == 0
    back = D.Segment.of_row(s.row())
    assert (back.positions == s.positions).all() and (back.first == s.first).all()
