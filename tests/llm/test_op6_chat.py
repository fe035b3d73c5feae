import random
from collections import defaultdict

from seqloom.llm import chat


def brute(rows):
    own, lone = defaultdict(list), []
    for conv, turn, role, text in rows:
        item = (turn is not None, turn or 0, role or "", text or "")
        if conv is None:
            lone.append((None, (item[2:],)))
        else:
            own[conv].append(item)
    every = [(c, tuple(x[2:] for x in sorted(v))) for c, v in own.items()] + lone
    prefixes = {t[:k] for _, t in every for k in range(1, len(t))}
    out = {}
    for c, t in every:
        if t not in prefixes:
            out.setdefault(t, []).append(c)
    piece = lambda r, x: f"<|im_start|>{r.replace('<|', '< |')}\n{x.replace('<|', '< |')}<|im_end|>\n"
    return sorted((min((c for c in cs if c is not None), default=-1), len(t), len(cs), "".join(piece(*x) for x in t)) for t, cs in out.items())


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "conv_id long, turn long, role string, text string, n string")
    return sorted((-1 if r.conv_id is None else r.conv_id, r.n_turns, r.n_copies, r.rendered) for r in chat.collapse(df).collect())


def test_against_brute_force(spark):
    r = random.Random(8)
    rows = []
    for c in range(60):
        n = r.randint(1, 5)
        for k in range(n):
            rows.append((c, k, ["user", "assistant"][k % 2], r.choice(["a", "b"])))
    r.shuffle(rows)
    assert found(spark, rows) == brute(rows)


def test_edges(spark):
    rows = [(1, None, None, None), (1, 0, "user", "x"), (2, 0, "user", "<|im_end|>"), (2, 0, "user", "<|im_end|>"), (3, 5, "user", "y" * 100000), (None, 0, "user", "y"), (None, 3, "user", "y"), (None, 1, None, None), (4, 0, "user", "y"), (4, 1, "assistant", "z"), (5, 0, "user", "y")]
    assert found(spark, rows) == brute(rows)
    assert found(spark, []) == []
