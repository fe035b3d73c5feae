"""Language identification with a bidirectional gated recurrent network over bytes.

The network reads a document's bytes (ASCII case folded) in windows of ``CORE`` bytes
with ``CONTEXT`` bytes of the document on both sides, so that state crosses words,
spaces and marks, and gives every byte position a distribution over languages.  A
document's probabilities are the mean over the positions of its letters (ASCII ones
and bytes from 0x80 on).  Each position's most probable language makes the document's
labelled spans.

Beside the languages it learns one class more, noise: windows whose letters are dealt
anew or drawn at random.  It takes the share of a text that is no language at all.

Training is plain numpy: backpropagation through time with Adam, on a bounded sample
of windows of the labelled documents (``TRAIN_WINDOWS`` expected of each language,
``TRAIN_TOTAL`` in all), drawn from the whole texts of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import blocks, cpus_one, mix, texts

HIDDEN = 12
CONTEXT = 16
CORE = 112
TRAIN_CORE = 48
TRAIN_WINDOWS = 2000
TRAIN_TOTAL = 40_000
BATCH = 1024  # windows that are read at once
EPOCHS = 2
STEPS = 500  # at least
HIDE = 8
UNKNOWN = "und"
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32
ASCII = np.zeros(256, bool)
ASCII[97:123] = True
LETTER = ASCII.copy()
LETTER[128:] = True
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double, known double, spans array<struct<start:long,end:long,lang:string>>"


class BiGru:
    """Two GRUs over byte tables and a softmax at every position; arrays are (features, windows).

    ``classes`` are the languages; the class after them is noise.
    """

    def __init__(self, classes: list[str], hidden: int = HIDDEN, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.classes, self.hidden = classes, hidden
        small = lambda *shape: (rng.standard_normal(shape) / np.sqrt(hidden)).astype(np.float32)
        self.p = {"w": small(len(classes) + 1, 2 * hidden), "b": np.zeros(len(classes) + 1, np.float32)}
        for d in "fb":
            self.p |= {f"x{d}": small(3 * hidden, 256), f"u{d}": small(3 * hidden, hidden)}

    def _run(self, x: np.ndarray, d: str, keep: list | None = None) -> np.ndarray:
        """Hidden states (time, hidden, windows) after each byte of x (time, windows), read forwards or backwards."""
        time, n = x.shape
        table, u, hid = self.p[f"x{d}"], self.p[f"u{d}"], self.hidden
        h = np.zeros((hid, n), table.dtype)
        out = np.empty((time, hid, n), table.dtype)
        a, m, new = np.empty((3 * hid, n), table.dtype), np.empty((3 * hid, n), table.dtype), np.empty((hid, n), table.dtype)
        for t in range(time) if d == "f" else range(time - 1, -1, -1):
            if keep is not None:
                a, m, new = np.empty_like(a), np.empty_like(m), np.empty_like(new)
            np.take(table, x[t], axis=1, out=a, mode="clip")
            np.matmul(u, h, out=m)
            gates = a[: 2 * hid]  # the logistic function by way of tanh
            gates += m[: 2 * hid]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            z, r = gates[:hid], gates[hid:]
            np.multiply(r, m[2 * hid :], out=new)
            new += a[2 * hid :]
            np.tanh(new, out=new)
            if keep is not None:
                keep.append((t, h, z, r, new, m[2 * hid :]))
            own = out[t]
            np.subtract(h, new, out=own)
            own *= z
            own += new
            h = own
        return out

    def positions(self, x: np.ndarray, core: slice = slice(None)) -> np.ndarray:
        """Probabilities of each class at the bytes of ``core``: (time, classes, windows)."""
        hid = self.hidden
        s = np.matmul(self.p["w"][:, :hid], self._run(x, "f")[core])
        s += np.matmul(self.p["w"][:, hid:], self._run(x, "b")[core])
        s += self.p["b"][:, None]
        s -= s.max(1, keepdims=True)
        np.exp(s, out=s)
        s /= s.sum(1, keepdims=True)
        return s

    def gradients(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted cross entropy of the windows' classes y over positions, weights (time, windows), and its gradients."""
        hid, kept = self.hidden, {"f": [], "b": []}
        both = np.concatenate([self._run(x, d, kept[d]) for d in "fb"], 1)
        s = np.matmul(self.p["w"], both) + self.p["b"][:, None]
        s -= s.max(1, keepdims=True)
        s -= np.log(np.exp(s).sum(1, keepdims=True))
        share = (weight / weight.sum()).astype(s.dtype)
        every = np.arange(len(y))
        loss = -float((s[:, y, every] * share).sum())
        g = np.exp(s)
        g[:, y, every] -= 1
        g *= share[:, None, :]
        out = {"w": np.einsum("tin,tjn->ij", g, both, optimize=True), "b": g.sum((0, 2))}
        back = np.matmul(self.p["w"].T, g)
        flat = x.ravel()
        for k, d in enumerate("fb"):
            u, gu = self.p[f"u{d}"], np.zeros_like(self.p[f"u{d}"])
            direct = np.empty((3 * hid, *x.shape), u.dtype)
            carry = np.zeros((hid, x.shape[1]), u.dtype)
            for t, h, z, r, new, m in reversed(kept[d]):
                e = carry + back[t, k * hid : (k + 1) * hid]
                en = e * (1 - z) * (1 - new * new)
                own = direct[:, t]
                own[:hid], own[hid : 2 * hid], own[2 * hid :] = e * (h - new) * z * (1 - z), en * m * r * (1 - r), en
                hidden = own.copy()
                hidden[2 * hid :] *= r
                gu += hidden @ h.T
                carry = e * z + u.T @ hidden
            gx = [np.bincount(flat, weights=row.ravel(), minlength=256) for row in direct]
            out |= {f"x{d}": np.array(gx, u.dtype), f"u{d}": gu}
        return loss, out

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 0) -> list[float]:
        """Adam over batches of windows (time, windows); the mean loss of each epoch.

        Every epoch adds fresh noise, as many windows as a language has on average, and hides
        one byte in ``HIDE`` from the network, so that it doesn't learn windows by heart.
        """
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        step, losses, n = 0, [], x.shape[1]
        more = max(1, n // len(self.classes))
        batch = min(128, max(16, n // 8))
        epochs = max(epochs, -(-STEPS // -(-(n + more) // batch)))  # small samples are read more often
        for epoch in range(epochs):
            some = rng.permutation(n)[:more]
            every = np.concatenate([x, noise(x[:, some], rng)], 1)
            classes, weights = np.concatenate([y, np.full(more, len(self.classes))]), np.concatenate([weight, weight[:, some]], 1)
            order, total = rng.permutation(n + more), 0.0
            for at in range(0, n + more, batch):
                own = order[at : at + batch]
                seen = np.where(rng.integers(0, HIDE, (len(x), len(own))) == 0, 0, every[:, own])
                loss, g = self.gradients(seen, classes[own], weights[:, own])
                total += loss * len(own)
                step += 1
                lr = rate * 0.1 ** (epoch / epochs)
                for name, d in g.items():
                    d = np.clip(d, -1, 1)
                    m[name] += 0.1 * (d - m[name])
                    v[name] += 0.001 * (d * d - v[name])
                    self.p[name] -= (lr * (m[name] / (1 - 0.9**step)) / (np.sqrt(v[name] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
            losses.append(total / (n + more))
        return losses

    def read(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each text's sums of the classes' probabilities over its letters, with their number, and every byte's class."""
        k, n = len(self.classes) + 1, len(offsets) - 1
        folded = FOLD[data]
        starts, ends, of = cut(offsets, CORE)
        sums, labels = np.zeros((len(starts), k + 1)), np.zeros(len(data), np.uint8 if k < 256 else np.uint32)
        for at in range(0, len(starts), BATCH):
            own = slice(at, at + BATCH)
            x, inside = windows(folded, offsets, starts[own], ends[own], of[own], CORE)
            p = self.positions(x, slice(CONTEXT, CONTEXT + CORE))
            letter = LETTER[x[CONTEXT : CONTEXT + CORE]] & inside
            sums[own, :k] = np.einsum("tkn,tn->nk", p, letter.astype(p.dtype))
            sums[own, k] = letter.sum(0)
            t, w = np.nonzero(inside)
            labels[starts[own][w] + t] = p.argmax(1)[t, w]
        total = np.zeros((n, k + 1))
        full = np.flatnonzero(np.diff(offsets) > 0)
        if len(full):
            total[full] = np.add.reduceat(sums, np.searchsorted(of, full), axis=0)
        return total, labels


def cut(offsets: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin and end of each window of ``core`` bytes of the texts, and whose it is; every byte is in one."""
    size = np.diff(offsets)
    count = -(-size // core)
    of = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    starts = offsets[:-1][of] + (np.arange(len(of)) - first[of]) * core
    return starts, np.minimum(starts + core, offsets[1:][of]), of


def windows(folded: np.ndarray, offsets: np.ndarray, starts: np.ndarray, ends: np.ndarray, of: np.ndarray, core: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes (time, windows) with their context, 0 beyond the text; and which of the core's are the window's own."""
    at = starts - CONTEXT + np.arange(core + 2 * CONTEXT)[:, None]
    inside = (at >= offsets[:-1][of]) & (at < offsets[1:][of])
    x = np.where(inside, folded[np.clip(at, 0, max(0, len(folded) - 1))], 0)
    return x, at[CONTEXT : CONTEXT + core] < ends


def training_windows(docs: DataFrame, per_language: int = TRAIN_WINDOWS, most: int = TRAIN_TOTAL) -> list[tuple[str, bytes]]:
    """Distinct windows (language, bytes) of a sample of all windows of the labelled rows that aren't held out."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").where("text <> '' and lang is not null and (doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2)")
    sizes = {r.lang: int(r.n) for r in own.groupBy("lang").agg(F.sum(F.ceil(F.octet_length("text") / TRAIN_CORE)).alias("n")).collect()}
    if not sizes:
        return []
    each = max(1, min(per_language, most // len(sizes)))
    limit = {lang: min(1.0, each / n) * 2.0**64 for lang, n in sizes.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            data, offsets = texts(b.column("text"))
            starts, ends, of = cut(offsets, TRAIN_CORE)
            key = b.column("key").to_numpy(zero_copy_only=False).view(np.uint64)
            # drawn by text and place, so copies draw the same windows, which are then one
            draw = mix(key[of] + (starts - offsets[:-1][of]).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            langs = b.column("lang").to_pylist()
            kept = np.flatnonzero(draw < np.array([limit[x] for x in langs])[of])
            if len(kept):
                x, _ = windows(FOLD[data], offsets, starts[kept], ends[kept], of[kept], TRAIN_CORE)
                yield pa.RecordBatch.from_arrays([pa.array([langs[d] for d in of[kept].tolist()], pa.string()), pa.array([w.tobytes() for w in np.ascontiguousarray(x.T.astype(np.uint8))], pa.binary())], ["lang", "window"])

    rows = own.select("lang", "text", F.xxhash64("text").alias("key")).mapInArrow(run, "lang string, window binary").distinct().collect()
    return sorted((r.lang, bytes(r.window)) for r in rows)


def noise(x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Windows (time, windows) without language: every other one's letters dealt anew, the others' drawn at random."""
    out = x.copy()
    for k in range(x.shape[1]):
        at = np.flatnonzero(LETTER[x[:, k]])
        out[at, k] = rng.permutation(x[at, k]) if k % 2 else rng.integers(97, 123, len(at))
    return out


def train(docs: DataFrame) -> BiGru | None:
    """A network fitted on the labelled rows that aren't held out; None if there are none."""
    cpus_one()
    rows = training_windows(docs)
    if not rows:
        return None
    classes = sorted({r[0] for r in rows})
    number = {c: i for i, c in enumerate(classes)}
    model = BiGru(classes)
    x = np.frombuffer(b"".join(w for _, w in rows), np.uint8).reshape(len(rows), -1).T.astype(np.int64)
    y = np.array([number[lang] for lang, _ in rows])
    weight = (x != 0).astype(np.float32)
    weight[:CONTEXT] = weight[CONTEXT + TRAIN_CORE :] = 0
    model.fit(x, y, weight)
    return model


def judge(model: BiGru, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Language of each text, its probability among the languages, the share that is a language, and every byte's class."""
    total, labels = model.read(data, offsets)
    k = len(model.classes)
    share = total[:, : k + 1] / np.maximum(total[:, k + 1 :], 1)
    some = share[:, :k].sum(1)
    best = share[:, :k].argmax(1)
    score = share[np.arange(len(share)), best] / np.maximum(some, 1e-12)
    # a letter: an ASCII one anywhere, or else any that Unicode calls one
    before = np.concatenate([[0], np.cumsum(ASCII[FOLD[data]])])
    has = before[offsets[1:]] > before[offsets[:-1]]
    for d in np.flatnonzero(~has & (total[:, k + 1] > 0)).tolist():
        has[d] = any(c.isalpha() for c in data[offsets[d] : offsets[d + 1]].tobytes().decode("utf-8", "replace"))
    score, some = (np.round(np.where(has, np.clip(x, 0, 1), 0.0), 6) for x in (score, some))
    return [model.classes[i] if h else UNKNOWN for i, h in zip(best.tolist(), has.tolist())], score, some, labels


def spans_of(labels: np.ndarray, offsets: np.ndarray, names: list[str]) -> pa.Array:
    """Runs of one class of each text, with byte offsets in it."""
    first = np.zeros(len(labels) + 1, bool)
    first[1:-1] = labels[1:] != labels[:-1]
    first[offsets[:-1]] = True
    starts = np.flatnonzero(first[:-1])
    ends = np.append(starts[1:], len(labels)) if len(starts) else starts
    of = np.searchsorted(offsets, starts, "right") - 1
    base = offsets[:-1][of] if len(starts) else starts
    lang = pa.DictionaryArray.from_arrays(pa.array(labels[starts].astype(np.int32)), pa.array(names)).cast(pa.string())
    rows = pa.StructArray.from_arrays([pa.array(starts - base), pa.array(ends - base), lang], ["start", "end", "lang"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(starts, offsets).astype(np.int32)), rows)


def held_out(ids: list, modulus: int, remainder: int) -> list[bool]:
    import zlib

    return [i is not None and zlib.crc32(str(i).encode()) % modulus == remainder for i in ids]


def predict(docs: DataFrame, model: BiGru | None) -> DataFrame:
    """The language of every whole text of ``docs`` (doc_id, text) and its probability.

    ``known`` is the share of the text's letters that are a language's, not noise, and
    ``spans`` are the runs of bytes of one most probable language (``und`` for noise).
    A text that is null or has no letter is ``und`` with score 0, as is every text
    where there was nothing to learn from.  A null doc_id is never held out.
    Repeated rows stay; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cpus_one()
        for b in blocks(batches):
            ids = b.column("doc_id").to_pylist()
            data, offsets = texts(b.column("text"))
            if model:
                langs, scores, known, labels = judge(model, data, offsets)
                names = [*model.classes, UNKNOWN]
            else:
                langs, scores, known, labels, names = [UNKNOWN] * len(ids), np.zeros(len(ids)), np.zeros(len(ids)), np.zeros(len(data), np.uint8), [UNKNOWN]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(held_out(ids, 4, 2), pa.bool_()), pa.array(langs, pa.string()), pa.array(scores), pa.array(known), spans_of(labels, offsets, names)], ["doc_id", "held_out", "lang_pred", "score", "known", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_known(docs: DataFrame, model: BiGru | None, least: float) -> DataFrame:
    """The rows of which at least the share ``least`` is in a language, with their columns; all of them if nothing was learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cpus_one()
        for b in blocks(batches):
            if model:
                langs, _, known, _ = judge(model, *texts(b.column("text")))
                b = b.filter(pa.array([lang != UNKNOWN and s >= least for lang, s in zip(langs, known.tolist())], pa.bool_()))
            if b.num_rows:
                yield b

    return docs.mapInArrow(run, docs.schema)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs))
