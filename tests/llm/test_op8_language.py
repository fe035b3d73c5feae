import numpy as np
import pyarrow as pa

from seqloom.llm import language as L
from seqloom.llm.columns import texts

SAMPLES = {
    "en": "the house and the river with their three old friends were waiting for something that would never happen again",
    "fr": "la maison et la rivière avec leurs trois vieux amis attendaient quelque chose qui ne serait jamais arrivé",
    "de": "das haus und der fluss mit ihren drei alten freunden warteten auf etwas das niemals wieder geschehen würde",
}


def table(spark, n=90):
    rows = []
    for i in range(n):
        lang = list(SAMPLES)[i % 3]
        words = SAMPLES[lang].split()
        rows.append((i, " ".join(words[(i + k * 7) % len(words)] for k in range(12)), lang, "src"))
    rows += [(1000, None, "en", "s"), (1001, "", "fr", "s"), (1002, "12 !! 45", None, None), (1003, "ÉTÉ à la rivière", None, "s"), (1004, "— … 。", "de", None), (None, "the house", "en", "s"), (7, "the river", None, "s"), (1005, "haus" * 5000, "de", "s")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, score string")


def test_gradients():
    rng = np.random.default_rng(1)
    m = L.BiGru(["a", "b"], hidden=3)
    m.p = {k: v.astype(np.float64) for k, v in m.p.items()}  # exact differences need doubles
    x = rng.integers(97, 101, (4, 5))
    y, w = rng.integers(0, 3, 5), rng.random((4, 5)) * (rng.random((4, 5)) < 0.7)
    loss, g = m.gradients(x, y, w)
    for name, v in m.p.items():
        for _ in range(6):
            at = tuple(rng.integers(0, n) for n in v.shape)
            if name.startswith("x"):
                at = (at[0], int(x[0, 0]))
            old = v[at]
            v[at] = old + 1e-6
            up = m.gradients(x, y, w)[0]
            v[at] = old - 1e-6
            down = m.gradients(x, y, w)[0]
            v[at] = old
            assert abs((up - down) / 2e-6 - g[name][at]) < 1e-6
    assert loss > 0


def step(m, d, byte, h):
    """One gated recurrent step on one byte, spelled out."""
    k, s = m.hidden, lambda a: 1 / (1 + np.exp(-a))
    a, u = m.p[f"x{d}"][:, byte].astype(float), m.p[f"u{d}"].astype(float) @ h
    z, r = s(a[:k] + u[:k]), s(a[k : 2 * k] + u[k : 2 * k])
    new = np.tanh(a[2 * k :] + r * u[2 * k :])
    return z * h + (1 - z) * new


def brute(m, text):
    """Each position's probabilities, byte by byte, window by window."""
    data = bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode())
    out = np.zeros((len(data), len(m.classes) + 1))
    for start in range(0, len(data), L.CORE):
        own = [data[i] if 0 <= i < len(data) else 0 for i in range(start - L.CONTEXT, start + L.CORE + L.CONTEXT)]
        f, b, h = [], [], np.zeros(m.hidden)
        for byte in own:
            h = step(m, "f", byte, h)
            f.append(h)
        h = np.zeros(m.hidden)
        for byte in reversed(own):
            h = step(m, "b", byte, h)
            b.append(h)
        for t in range(min(L.CORE, len(data) - start)):
            both = np.concatenate([f[t + L.CONTEXT], b[len(own) - 1 - t - L.CONTEXT]])
            e = np.exp(m.p["w"].astype(float) @ both + m.p["b"])
            out[start + t] = e / e.sum()
    letter = np.array([c >= 128 or 97 <= c <= 122 for c in data], bool)
    return out, letter


def test_reading_is_the_recurrence(monkeypatch):
    monkeypatch.setattr(L, "BATCH", 3)
    m = L.BiGru(["a", "b", "c"], hidden=4, seed=3)
    docs = ["Hello, World! 42", "", "été " * 90, "x", "…", None, "abc " * 200]
    data, offsets = texts(pa.array(docs))
    total, labels = m.read(data, offsets)
    langs, score, known, _ = L.judge(m, data, offsets)
    for d, text in enumerate(docs):
        p, letter = brute(m, text or "")
        assert np.allclose(total[d, :4], p[letter].sum(0), atol=1e-3) and total[d, 4] == letter.sum()
        own = labels[offsets[d] : offsets[d + 1]]
        sure = np.sort(p, 1)[:, -1] - np.sort(p, 1)[:, -2] > 1e-5 if len(p) else np.zeros(0, bool)
        assert (own[sure] == p.argmax(1)[sure]).all()
        if any(c.isalpha() for c in text or ""):
            mean = p[letter].mean(0)
            assert langs[d] == m.classes[mean[:3].argmax()] and np.isclose(score[d], mean[:3].max() / mean[:3].sum(), atol=1e-5) and np.isclose(known[d], mean[:3].sum(), atol=1e-5)
        else:
            assert langs[d] == "und" and score[d] == 0
    spans = L.spans_of(labels, offsets, ["a", "b", "c", "und"]).to_pylist()
    for d in range(len(docs)):
        flat = [x["lang"] for x in spans[d] for _ in range(x["start"], x["end"])]
        assert flat == [["a", "b", "c", "und"][k] for k in labels[offsets[d] : offsets[d + 1]]]
        assert all(x["start"] < x["end"] for x in spans[d]) and all(x["end"] == y["start"] and x["lang"] != y["lang"] for x, y in zip(spans[d], spans[d][1:]))


def test_windows_hold_every_byte_once():
    data, offsets = texts(pa.array(["a" * 500, "", "b", "c" * L.CORE]))
    starts, ends, of = L.cut(offsets, L.CORE)
    x, inside = L.windows(data, offsets, starts, ends, of, L.CORE)
    assert inside.sum() == len(data) and sorted(np.concatenate([np.arange(a, b) for a, b in zip(starts, ends)])) == list(range(len(data)))
    assert (x[L.CONTEXT : L.CONTEXT + L.CORE][inside] != 0).all() and set(x[:, -1]) == {0, 99}


def test_rows(spark):
    docs = table(spark)
    found = {r.doc_id: r for r in L.predict(docs, L.train(docs)).collect()}
    right = [found[i].lang_pred == list(SAMPLES)[i % 3] for i in range(90) if found[i].held_out]
    assert len(right) > 10 and np.mean(right) > 0.9
    for i in (1000, 1001, 1002, 1004):
        assert found[i].lang_pred == "und" and found[i].score == 0
    assert found[1003].lang_pred == "fr" and found[1005].lang_pred == "de"
    assert all(0 <= r.score <= 1 for r in found.values()) and not found[None].held_out


def test_mixed_and_no_language(spark):
    """Offsets say where each language stands, and a text in none is rejected."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    model = L.train(docs)
    rows = [x for x in docs.where("length(text) between 600 and 3000").orderBy("doc_id").collect() if L.held_out([x.doc_id], 4, 2)[0]]
    en, de = (next(x.text for x in rows if x.lang == lang) for lang in ("en", "de"))
    r = np.random.default_rng(2)
    junk = " ".join("".join(chr(c) for c in r.integers(97, 123, 7)) for _ in range(60))
    own = spark.createDataFrame([(1, f"{en} {de}"), (2, junk), (3, en), (4, None), (5, "12 !!")], "doc_id long, text string")
    found = {x.doc_id: x for x in L.predict(own, model).collect()}
    half = len(en.encode())
    right = sum(min(x.end, half) - x.start for x in found[1].spans if x.lang == "en" and x.start < half) + sum(x.end - max(x.start, half) for x in found[1].spans if x.lang == "de" and x.end > half)
    assert right > 0.9 * len(f"{en} {de}".encode())
    assert found[2].known < 0.15 < found[3].known
    assert sorted(x.doc_id for x in L.keep_known(own, model, 0.15).collect()) == [1, 3]
    # held-out accuracy
    got = {x.doc_id: x.lang_pred for x in L.predict(docs, model).where("held_out").collect()}
    known = [(x.doc_id, x.lang) for x in docs.collect() if x.doc_id in got and x.lang]
    assert np.mean([got[i] == lang for i, lang in known]) > 0.97


def test_sample_is_bounded_and_of_all_texts(spark):
    rows = [(i, "same text " * 30, "en") for i in range(2000)] + [(5000 + i, f"other {i} words {i * 7} here", "fr") for i in range(2000)] + [(9000 + i, f"lang {i}", f"l{i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "'x' AS key", "1 AS window")
    found = L.training_windows(docs, 100, 30_000)
    count = {lang: sum(x == lang for x, _ in found) for lang in ("en", "fr")}
    assert count["en"] <= 7 and 50 < count["fr"] < 200  # copies count once
    assert len({lang for lang, _ in found}) > 200  # however many languages there are


def test_nothing_to_learn(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert L.train(none) is None and L.predict(none, None).count() == 0
    assert L.predict(spark.createDataFrame([(2, "the")], "doc_id long, text string"), None).first().lang_pred == "und"
