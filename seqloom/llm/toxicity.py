"""Toxicity: a linear-chain conditional random field over the words of a text.

Two states, clean and toxic.  A word is observed by what it is, by its first four and
six bytes, its last four, its length, and the words before and after it; each of these
that the training texts show often enough has a weight.  Forward-backward over every
word of the whole text gives each word's marginal, hence the offending spans.  The sum
of the marginals, the words expected to be toxic, makes the document's score by a
logistic curve.

Learning uses a bounded sample of the labelled rows (``TRAIN_ROWS`` expected of
each label), whole texts.  The labelled tokens come from the row labels: in toxic rows
those with a word, beginning or ending that stands in more distinct contexts (previous
and next word) of toxic rows than chance allows, so copies of one document count once;
none in clean rows.  The field is fitted to them, the toxic rows are labelled anew by
its marginals, which know the context too, and it is fitted again.  A step is one
distributed pass over the coded sample; the driver only gets the gradients' sum.

Chains are cut into chunks of ``CHUNK`` words whose 2 x 2 transfer matrices are
multiplied for all chunks at once, then chained; the result is that of the plain
recurrence, and the work grows with the words however long a text is.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import SCRATCH, blocks, cpus_one, drop_stored, fold_table, hash_words, mix, stored, texts, words
from seqloom.llm.language import held_out

TRAIN_ROWS = 4000
LEAST_CONTEXTS = 4
LEAST_Z = 3.5  # of a token's label
LEAST_RATIO = 2.0
FEATURE_Z = 2.0  # of a feature
STEPS = 10  # of each of the two fits
OTHER = -8.0  # where the weight of every word begins
CHUNK = 64
BLOCK = 2 << 20  # bytes of text whose words are chained at once
LEAST = 0.05  # of a marginal that counts towards a text's score: length alone is no evidence
RANKED = 3  # marginals of a text that its score looks at one by one, beside their sum
FAR = 30.0  # emissions beyond are as good as certain
TABLE = fold_table([*range(65, 91), *range(97, 123), *range(128, 256)])
KINDS = ("word", "begins4", "begins6", "ends4", "length", "before", "after")
SALT = [np.uint64(0x9E3779B97F4A7C15 * (k + 1) % (1 << 64)) for k in range(len(KINDS))]
SCHEMA = "doc_id long, held_out boolean, score double, predicted int, n_toxic long, expected_toxic double, spans array<struct<start:long,end:long>>"


def parts_of(word: bytes) -> tuple[bytes, bytes, bytes, bytes, bytes]:
    """What a word is observed by, but for its neighbours; an empty part isn't there."""
    n = len(word)
    return word, word[:4] if n > 4 else b"", word[:6] if n > 6 else b"", word[-4:] if n > 4 else b"", bytes([min(n, 20)])


def keys_of(dictionary: list[bytes]) -> np.ndarray:
    """The hashes (words, KINDS) of what distinct words are observed by, 0 for what isn't there."""
    import xxhash

    out = np.zeros((len(dictionary), len(KINDS)), np.uint64)
    for i, w in enumerate(dictionary):
        out[i, :5] = [xxhash.xxh64_intdigest(p) if p else 0 for p in parts_of(w)]
    out[:, 5] = out[:, 6] = out[:, 0]
    return np.where(out == 0, out, mix(out + np.array(SALT)) | np.uint64(1))


# ---------------------------------------------------------------- the chain


def chained(emit: np.ndarray, first: np.ndarray, trans: np.ndarray, start: np.ndarray, learn: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Marginals of the toxic state; to ``learn``, also pair marginals in all and log Z of the texts.

    Text d is words first[d] to first[d + 1]; ``emit`` is the toxic state's weight at each.
    """
    n, docs = len(emit), len(first) - 1
    marginal, pairs, log_z = np.zeros(n), np.zeros((2, 2)), np.zeros(docs)
    size = np.diff(first)
    full = np.flatnonzero(size > 0)
    if not len(full):
        return marginal, pairs, log_z
    # chunks, each of one text, the longer first: at each step the live ones are a prefix
    count = -(-size // CHUNK)
    of = np.repeat(np.arange(docs), count)
    begin = np.cumsum(count) - count
    rank = np.arange(len(of)) - begin[of]
    at = first[:-1][of] + rank * CHUNK
    length = np.minimum(CHUNK, first[1:][of] - at)
    order = np.argsort(-length, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    at, length, head = at[order], length[order], np.flatnonzero(rank[order] == 0)
    live = np.searchsorted(-length, -np.arange(CHUNK), "left")
    live = live[live > 0]
    e = np.exp(np.clip(emit, -FAR, FAR))
    toxic = e / (1 + e)
    (s00, s01), (s10, s11) = np.exp(trans - trans.max())
    own = np.exp(start - start.max())
    q = [toxic[at[:m] + k] for k, m in enumerate(live.tolist())]
    h0, h1 = own[0] * (1 - q[0][head]), own[1] * q[0][head]  # a text's first word comes from the start
    scale = h0 + h1
    h0, h1 = h0 / scale, h1 / scale
    # each chunk as a matrix, of which the first word's has equal rows
    a = np.zeros((4, len(at)))
    a[0] = a[3] = 1.0
    logs = np.zeros(len(at))
    for k, m in enumerate(live.tolist()):
        a00, a01, a10, a11 = a[:, :m]
        p = 1 - q[k]
        new = np.stack([(a00 * s00 + a01 * s10) * p, (a00 * s01 + a01 * s11) * q[k], (a10 * s00 + a11 * s10) * p, (a10 * s01 + a11 * s11) * q[k]])
        total = new.sum(0)
        a[:, :m] = new / total
        if learn:
            logs[:m] += np.log(total)
        if k == 0:
            a[0, head] = a[2, head] = h0
            a[1, head] = a[3, head] = h1
            logs[head] = np.log(scale)
    # through the chunks of each text, forwards and backwards
    into, out = np.full((2, len(at)), 0.5), np.ones((2, len(at)))
    state, running = np.full((2, docs), 0.5), np.zeros(docs)
    for r in range(int(count.max())):
        d = np.flatnonzero(count > r)
        c = place[begin[d] + r]
        into[:, c] = state[:, d]
        x, y = state[0, d] * a[0, c] + state[1, d] * a[2, c], state[0, d] * a[1, c] + state[1, d] * a[3, c]
        total = x + y
        state[0, d], state[1, d] = x / total, y / total
        running[d] += np.log(total) + logs[c]
    back = np.ones((2, docs))
    for r in range(int(count.max()) - 1, -1, -1):
        d = np.flatnonzero(count > r)
        c = place[begin[d] + r]
        out[:, c] = back[:, d]
        x, y = a[0, c] * back[0, d] + a[1, c] * back[1, d], a[2, c] * back[0, d] + a[3, c] * back[1, d]
        total = x + y
        back[0, d], back[1, d] = x / total, y / total
    # inside the chunks: forward states kept, then backwards over them
    f0, f1 = [into[0]], [into[1]]
    for k, m in enumerate(live.tolist()):
        x, y = f0[-1][:m], f1[-1][:m]
        x, y = (x * s00 + y * s10) * (1 - q[k]), (x * s01 + y * s11) * q[k]
        if k == 0:
            x[head], y[head] = h0, h1
        total = x + y
        f0.append(x / total)
        f1.append(y / total)
    b0, b1 = out
    for k in range(len(live) - 1, -1, -1):
        m = int(live[k])
        x, y = f0[k + 1] * b0[:m], f1[k + 1] * b1[:m]
        marginal[at[:m] + k] = y / (x + y)
        r0, r1 = (1 - q[k]) * b0[:m], q[k] * b1[:m]
        if learn:
            g0, g1 = f0[k][:m], f1[k][:m]
            pair = np.stack([g0 * s00 * r0, g0 * s01 * r1, g1 * s10 * r0, g1 * s11 * r1])
            pair /= pair.sum(0)
            if k == 0:
                pair[:, head] = 0
            pairs += pair.sum(1).reshape(2, 2)
        x, y = s00 * r0 + s01 * r1, s10 * r0 + s11 * r1
        total = x + y
        b0[:m], b1[:m] = x / total, y / total
    if learn:  # what the steps were divided by, and what emissions were
        log_z[full] = running[full] + trans.max() * (size[full] - 1) + start.max()
        log_z += by_text(np.log1p(e), first)
    return marginal, pairs, log_z


@dataclass
class Crf:
    """Weights for the toxic state (the clean one's are 0) and between states."""

    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))  # sorted hashes of features
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = OTHER
    trans: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: np.ndarray = field(default_factory=lambda: np.zeros(2))
    curve: np.ndarray = field(default_factory=lambda: np.zeros(2 + RANKED))  # weights of the document score
    fitted: bool = False

    def numbers(self, dictionary: list[bytes]) -> np.ndarray:
        """The features (words, KINDS) of distinct words; the number of features for none."""
        keys = keys_of(dictionary)
        if not len(self.keys):
            return np.zeros(keys.shape, np.int32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, at, len(self.keys)).astype(np.int32)

    def emissions(self, numbers: np.ndarray, codes: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The toxic state's weight at each word of a block of texts."""
        w = np.append(self.weights, 0.0)[numbers]
        out = (self.bias + w[:, :5].sum(1))[codes]
        before, after = neighbours(codes, doc)
        out[before] += w[codes[before - 1], 5]
        out[after] += w[codes[after + 1], 6]
        return out

    def read(self, data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        """Every word of a block of texts: where it stands, and its marginal."""
        codes, dictionary, doc, starts = words(data, offsets, TABLE)
        if not len(codes):
            return {"doc": doc, "marginal": np.zeros(0), "begin": starts, "end": starts}
        own = dictionary.to_pylist()
        marginal, _, _ = chained(self.emissions(self.numbers(own), codes, doc), doc, self.trans, self.start)
        begin = starts - np.repeat(offsets[:-1], np.diff(doc))
        return {"doc": doc, "marginal": marginal, "begin": begin, "end": begin + np.array([len(w) for w in own])[codes]}

    def score(self, marginal: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """The probability of the toxic label of each text, from its words' marginals."""
        if not self.fitted:
            return np.zeros(len(doc) - 1)
        x = np.clip(summary(marginal, doc) @ self.curve, -35, 35)
        return np.round(1 / (1 + np.exp(-x)), 6)


def expected_toxic(marginal: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """How many words of each text are expected to be toxic: the sum of the marginals of ``LEAST`` or more."""
    return by_text(np.where(marginal >= LEAST, marginal, 0.0), doc)


def summary(marginal: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """What a text's score is made of (texts, 2 + RANKED): 1, the log of the words expected to be toxic, the greatest marginals."""
    out = np.zeros((len(doc) - 1, 2 + RANKED))
    out[:, 0], out[:, 1] = 1.0, np.log(expected_toxic(marginal, doc) + 0.01)
    some = np.flatnonzero(marginal >= LEAST)
    of = np.searchsorted(doc, some, "right") - 1
    order = np.lexsort((-marginal[some], of))
    of, some = of[order], some[order]
    rank = np.arange(len(of)) - np.searchsorted(of, of)
    on = rank < RANKED
    out[of[on], 2 + rank[on]] = marginal[some[on]]
    return out


def neighbours(codes: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words that have one before them in their text, and those that have one after."""
    every = np.ones(len(codes), bool)
    before, after = every.copy(), every
    before[doc[:-1][doc[:-1] < len(codes)]] = False
    after[doc[1:][doc[1:] > 0] - 1] = False
    return np.flatnonzero(before), np.flatnonzero(after)


def by_text(values: np.ndarray, doc: np.ndarray) -> np.ndarray:
    return np.bincount(np.repeat(np.arange(len(doc) - 1), np.diff(doc)), weights=values, minlength=len(doc) - 1).astype(float)


# ---------------------------------------------------------------- learning


def training_rows(docs: DataFrame, labels: DataFrame, most: int = TRAIN_ROWS) -> DataFrame:
    """A sample (text, toxic, weight) of the labelled documents that aren't held out, ``most`` of each label expected.

    A document with several labels counts as toxic if any of them says so; of several rows
    with one doc_id one is taken.
    """
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("toxic in (0, 1) and doc_id is not null and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sizes = {r.toxic: r.n for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {t: min(1.0, most / n) for t, n in sizes.items()}
    keep = F.lit(False)
    weight = F.lit(1.0)
    for t, s in share.items():
        keep = keep | ((F.col("toxic") == t) & (F.expr("pmod(xxhash64(doc_id, 11), 1000000)") < int(s * 1_000_000)))
        weight = F.when(F.col("toxic") == t, 1 / s).otherwise(weight)
    sample = own.where(keep).withColumn("weight", weight)  # at most about two times ``most`` rows
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text is not null").join(F.broadcast(sample), "doc_id")
    return found.groupBy("doc_id").agg(F.max_by("text", F.xxhash64("text")).alias("text"), F.first("toxic").alias("toxic"), F.first("weight").alias("weight")).drop("doc_id")


def evidence(sample: DataFrame) -> list[tuple[bytes, int, float, float]]:
    """Parts of words (part, kind, log odds, z) that stand in more distinct contexts of toxic rows than of clean ones."""

    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            codes, dictionary, doc, _ = words(*texts(b.column("text")), TABLE)
            if not len(codes):
                continue
            h = hash_words(dictionary)[codes]
            left, right = np.zeros_like(h), np.zeros_like(h)
            before, after = neighbours(codes, doc)
            left[before], right[after] = h[before - 1], h[after + 1]
            toxic = np.repeat(np.array(b.column("toxic").to_pylist(), np.int32), np.diff(doc))
            context = mix(left * np.uint64(3) + mix(right)).view(np.int64)
            own = np.unique(np.rec.fromarrays([codes, context, toxic], names="code,context,toxic"))
            for at in range(0, len(own), 100_000):
                part = own[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([dictionary.take(pa.array(part.code)).cast(pa.binary()), pa.array(part.context), pa.array(part.toxic)], ["word", "context", "toxic"])

    each = sample.mapInArrow(contexts, "word binary, context long, toxic int").distinct()
    counts = each.groupBy("word").agg(F.sum("toxic").alias("c1"), F.sum(1 - F.col("toxic")).alias("c0"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, k, c1, c0) for w, c1, c0 in zip(*(b.column(c).to_pylist() for c in ("word", "c1", "c0"))) for k, p in enumerate(parts_of(w)) if p]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int32(), pa.int64(), pa.int64()))], ["part", "kind", "c1", "c0"])

    parts = stored(counts.mapInArrow(split, "part binary, kind int, c1 long, c0 long").groupBy("part", "kind").agg(F.sum("c1").alias("c1"), F.sum("c0").alias("c0")), "toxic-parts", True)
    n1, n0 = (float(x or 0) for x in parts.where("kind = 0").agg(F.sum("c1"), F.sum("c0")).first())
    if not n1:
        return []
    ratio = f"ln((c1 + 0.5) / (abs({n1} - c1) + 0.5)) - ln((c0 + 0.5) / (abs({n0} - c0) + 0.5))"
    known = parts.where(f"c1 >= {LEAST_CONTEXTS}").withColumn("ratio", F.expr(ratio)).withColumn("z", F.expr("ratio / sqrt(1 / (c1 + 0.5) + 1 / (c0 + 0.5))"))
    return sorted((bytes(r.part), int(r.kind), float(r.ratio), float(r.z)) for r in known.where(f"abs(z) >= {FEATURE_Z}").collect())


def code_rows(sample: DataFrame, keys: np.ndarray) -> DataFrame:
    """Blocks of the sample with words as codes and features as numbers."""
    crf = Crf(keys, np.zeros(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            codes, dictionary, doc, _ = words(*texts(b.column("text")), TABLE)
            numbers = crf.numbers(dictionary.to_pylist())
            columns = [codes.astype("<i4").tobytes(), numbers.astype("<i4").tobytes(), doc.astype("<i8").tobytes(), np.array(b.column("toxic").to_pylist(), "<i4").tobytes(), np.array(b.column("weight").to_pylist(), "<f8").tobytes()]
            yield pa.RecordBatch.from_arrays([pa.array([c], pa.binary()) for c in columns], ["codes", "numbers", "doc", "toxic", "weight"])

    return sample.mapInArrow(run, "codes binary, numbers binary, doc binary, toxic binary, weight binary")


def _coded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
    for b in batches:
        for i in range(b.num_rows):
            raw = [b.column(c)[i].as_py() for c in ("codes", "numbers", "doc", "toxic", "weight")]
            codes, numbers, doc, toxic, weight = (np.frombuffer(x, t) for x, t in zip(raw, ("<i4", "<i4", "<i8", "<i4", "<f8")))
            yield codes, numbers.reshape(-1, len(KINDS)), doc, toxic, weight


def token_labels(numbers: np.ndarray, codes: np.ndarray, doc: np.ndarray, toxic: np.ndarray, strong: np.ndarray, teacher: Crf | None) -> np.ndarray:
    """0 or 1 for each word: in toxic rows 1 where it has a strong feature, or where the teacher says so."""
    rows = np.repeat(toxic == 1, np.diff(doc))
    if teacher is None:
        return (np.append(strong, False)[numbers[:, :5]].any(1)[codes] & rows).astype(float)
    marginal, _, _ = chained(teacher.emissions(numbers, codes, doc), doc, teacher.trans, teacher.start)
    return ((marginal >= 0.5) & rows).astype(float)


def gradients(crf: Crf, numbers: np.ndarray, codes: np.ndarray, doc: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Negative log likelihood of the states y of a block of texts, and its gradient: bias, transitions, start, features."""
    emit = crf.emissions(numbers, codes, doc)
    marginal, pairs, log_z = chained(emit, doc, crf.trans, crf.start, True)
    heads = doc[:-1][np.diff(doc) > 0]
    before, _ = neighbours(codes, doc)
    state = y.astype(np.int64)
    gold = float((emit * y).sum() + crf.trans[state[before - 1], state[before]].sum() + crf.start[state[heads]].sum())
    trans = pairs.copy()
    np.add.at(trans, (state[before - 1], state[before]), -1)
    start = np.array([(1 - marginal[heads]).sum(), marginal[heads].sum()]) - np.bincount(state[heads], minlength=2)
    error = marginal - y
    own = np.bincount(codes, weights=error, minlength=len(numbers))
    left, right = np.zeros(len(numbers)), np.zeros(len(numbers))
    before, after = neighbours(codes, doc)
    left += np.bincount(codes[before - 1], weights=error[before], minlength=len(numbers))
    right += np.bincount(codes[after + 1], weights=error[after], minlength=len(numbers))
    each = np.stack([own] * 5 + [left, right], 1)
    features = np.bincount(numbers.ravel(), weights=each.ravel(), minlength=len(crf.keys) + 1)[: len(crf.keys)]
    return float(log_z.sum()) - gold, np.concatenate([[error.sum()], trans.ravel(), start, features])


def fit(crf: Crf, coded: DataFrame, strong: np.ndarray, teacher: Crf | None, steps: int = STEPS, rate: float = 1.0, penalty: float = 0.01) -> list[float]:
    """AdaGrad on the whole sample, a pass a step; the losses."""
    theta = np.concatenate([[crf.bias], crf.trans.ravel(), crf.start, crf.weights])
    begun, squares, losses = theta.copy(), np.full(len(theta), 1e-8), []

    def passed(own: Crf) -> tuple[float, np.ndarray]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            cpus_one()
            loss, total = 0.0, np.zeros(7 + len(own.keys))
            for codes, numbers, doc, toxic, _ in _coded(batches):
                if len(codes):
                    more, g = gradients(own, numbers, codes, doc, token_labels(numbers, codes, doc, toxic, strong, teacher))
                    loss, total = loss + more, total + g
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([total.tobytes()], pa.binary())], ["loss", "gradient"])

        rows = coded.mapInArrow(run, "loss double, gradient binary").collect()
        return sum(r.loss for r in rows), np.sum([np.frombuffer(r.gradient) for r in rows], axis=0)

    for k in range(steps):
        loss, g = passed(Crf(crf.keys, theta[7:], float(theta[0]), theta[1:5].reshape(2, 2), theta[5:7]))
        losses.append(loss)
        g = g + penalty * (theta - begun)
        squares += g * g
        theta = theta - rate * g / np.sqrt(squares)
    crf.bias, crf.trans, crf.start, crf.weights = float(theta[0]), theta[1:5].reshape(2, 2), theta[5:7], theta[7:]
    return losses


def fit_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Weighted logistic regression of y on the columns of x, slightly penalised, by Newton's method."""
    a, w = np.zeros(x.shape[1]), w / w.mean()
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -35, 35)))
        g = x.T @ ((p - y) * w) + 0.01 * a
        h = (x * (p * (1 - p) * w)[:, None]).T @ x + 0.01 * np.eye(len(a))
        step = np.clip(np.linalg.solve(h, g), -1, 1)
        a = a - step
        if np.abs(step).max() < 1e-9:
            break
    return a


def neighbour_keys(sample: DataFrame, keys: np.ndarray, strong: np.ndarray) -> np.ndarray:
    """Hashes of words that stand ``LEAST_CONTEXTS`` times or more before or after a labelled toxic word."""

    own = Crf(keys, np.zeros(len(keys)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            codes, dictionary, doc, _ = words(*texts(b.column("text")), TABLE)
            if not len(codes):
                continue
            named = dictionary.to_pylist()
            y = token_labels(own.numbers(named), codes, doc, np.array(b.column("toxic").to_pylist(), np.int32), strong, None)
            before, after = neighbours(codes, doc)
            every = keys_of(named)
            found = np.concatenate([every[codes[before - 1], 5][y[before] == 1], every[codes[after + 1], 6][y[after] == 1]])
            hashes, n = np.unique(found, return_counts=True)
            if len(hashes):
                yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], ["key", "n"])

    rows = sample.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(f"n >= {LEAST_CONTEXTS}").collect()
    return np.array(sorted(r.key for r in rows), np.int64).view(np.uint64)


def train(docs: DataFrame, labels: DataFrame) -> Crf:
    """A field fitted on the sample; without labelled rows, one that scores 0."""
    cpus_one()
    since = len(SCRATCH)
    sample = stored(training_rows(docs, labels), "toxic-sample")
    found = evidence(sample)
    import xxhash

    hashed = {int(mix(np.array([xxhash.xxh64_intdigest(part)], np.uint64) + SALT[kind])[0] | np.uint64(1)): (ratio, z) for part, kind, ratio, z in found}
    keys = np.array(sorted(hashed), np.uint64)
    strong = np.array([hashed[int(k)][0] >= LEAST_RATIO and hashed[int(k)][1] >= LEAST_Z for k in keys], bool)
    crf = Crf(keys)
    if strong.any():
        beside = np.setdiff1d(neighbour_keys(sample, keys, strong), keys)
        every = np.sort(np.concatenate([keys, beside]))
        at = np.searchsorted(every, keys)
        weights, sure = np.zeros(len(every)), np.zeros(len(every), bool)
        weights[at], sure[at] = [hashed[int(k)][0] for k in keys], strong
        coded = stored(code_rows(sample, every), "toxic-coded")
        crf = Crf(every, weights)
        fit(crf, coded, sure, None)
        teacher = Crf(every, crf.weights.copy(), crf.bias, crf.trans.copy(), crf.start.copy())
        fit(crf, coded, sure, teacher)

        def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for codes, numbers, doc, toxic, weight in _coded(batches):
                marginal = chained(crf.emissions(numbers, codes, doc), doc, crf.trans, crf.start)[0]
                yield pa.RecordBatch.from_arrays([pa.array(list(summary(marginal, doc))), pa.array(toxic), pa.array(weight)], ["x", "toxic", "weight"])

        rows = sorted(tuple(r) for r in coded.mapInArrow(summaries, "x array<double>, toxic int, weight double").collect())
        crf.curve = fit_curve(*(np.array(c, float) for c in zip(*rows)))
        crf.fitted = True
    drop_stored(docs.sparkSession, since)
    return crf


# ---------------------------------------------------------------- scoring


def score_texts(docs: DataFrame, crf: Crf) -> DataFrame:
    """The toxicity of every whole text of ``docs`` (doc_id, text).

    ``spans`` are the byte offsets of words whose marginal is 0.5 or more, ``n_toxic``
    their number and ``expected_toxic`` the sum of the marginals that count.  A null text
    scores as an empty one; a null doc_id is never held out; repeated rows stay; other
    columns are ignored.  Texts score the same wherever they stand.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cpus_one()
        for b in blocks(batches, limit=BLOCK):
            r = crf.read(*texts(b.column("text")))
            expected, score = np.round(expected_toxic(r["marginal"], r["doc"]), 6), crf.score(r["marginal"], r["doc"])
            sure = r["marginal"] >= 0.5
            n = by_text(sure, r["doc"]).astype(np.int64)
            spans = pa.StructArray.from_arrays([pa.array(r["begin"][sure].astype(np.int64)), pa.array(r["end"][sure].astype(np.int64))], ["start", "end"])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]).astype(np.int32)), spans)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(held_out(b.column("doc_id").to_pylist(), 5, 0), pa.bool_()), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(n), pa.array(expected), lists],
                ["doc_id", "held_out", "score", "predicted", "n_toxic", "expected_toxic", "spans"],
            )

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def keep_clean(docs: DataFrame, crf: Crf) -> DataFrame:
    """The rows that score under 0.5, with their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cpus_one()
        for b in blocks(batches, limit=BLOCK):
            r = crf.read(*texts(b.column("text")))
            b = b.filter(pa.array(crf.score(r["marginal"], r["doc"]) < 0.5))
            if b.num_rows:
                yield b

    return docs.mapInArrow(run, docs.schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_texts(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
