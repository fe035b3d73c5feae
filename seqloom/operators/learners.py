"""Learners: models that predict the next symbol, ensembles, calibration and coding cost.

Counting models are SQL.  Learners with weight feedback are one fold per document
or user in numpy, behind :class:`Model`; :func:`lifted` steps one through many users' sequences at once.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, table

# ---------------------------------------------------------------- counting models

NGRAM = """WITH t AS (SELECT doc_id, pos, ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2 FROM symbols WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
  n2 AS (SELECT c2, c1, ch, count(*) AS n FROM t WHERE c2 IS NOT NULL GROUP BY c2, c1, ch),
  n1 AS (SELECT c1, ch, count(*) AS n FROM t WHERE c1 IS NOT NULL GROUP BY c1, ch)"""
BACKOFF = """, k2 AS (SELECT c2, c1, sum(n) AS total, count(*) AS kinds FROM n2 GROUP BY c2, c1), k1 AS (SELECT c1, sum(n) AS total, count(*) AS kinds FROM n1 GROUP BY c1)
    SELECT n2.c2, n2.c1, n2.ch, n2.n, round((n2.n * 1.0e0) / (k2.total + k2.kinds) + (k2.kinds * 1.0e0) / (k2.total + k2.kinds) * (n1.n * 1.0e0) / (k1.total + k1.kinds), 8) AS p
    FROM n2 JOIN k2 ON n2.c2 = k2.c2 AND n2.c1 = k2.c1 JOIN n1 ON n1.c1 = n2.c1 AND n1.ch = n2.ch JOIN k1 ON k1.c1 = n2.c1"""


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(c2, c1, ch, n) of every symbol with one before it, c2 null where there's no second; counted in blocks, then summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        own, place = arrays.shown(cp), np.arange(len(cp)) - np.repeat(first[:-1], np.diff(first))
        at = np.flatnonzero(place >= 1)
        (c2, c1, ch), n = arrays.counted([np.where(place[at] >= 2, own[np.maximum(at - 2, 0)], 0), own[at - 1], own[at]])
        return {k: arrays.symbols_of(v) for k, v in (("c2", c2), ("c1", c1), ("ch", ch))} | {"n": n}

    each = arrays.map_symbols(docs, work, "c2 string, c1 string, ch string, n bigint")
    return each.groupBy("c2", "c1", "ch").agg(F.sum("n").alias("n"))


@query("ngram_backoff_score", "L19 L18 L20", NGRAM + BACKOFF)
def ngram_backoff_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-order probabilities that back off to the first order; what moves are the counts of blocks."""
    ngram_counts(table(spark, sf_dir, "documents")).createOrReplaceTempView("ngrams")
    return spark.sql("WITH n2 AS (SELECT * FROM ngrams WHERE c2 IS NOT NULL), n1 AS (SELECT c1, ch, sum(n) AS n FROM ngrams GROUP BY c1, ch)" + BACKOFF)




@query(
    "entropy_order0",
    "L18 IO15",
    """WITH c AS (SELECT doc_id, ch, count(*) AS n FROM symbols GROUP BY doc_id, ch), t AS (SELECT doc_id, sum(n) AS total, count(*) AS kinds FROM c GROUP BY doc_id)
    SELECT c.doc_id, cast(max(total) AS bigint) AS symbols, max(kinds) AS kinds, round(sum((n * 1.0e0) / total * log2(total / (n * 1.0e0))), 6) AS entropy FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id""",
)
def entropy_order0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a symbol of each text under its own counts; a row is done where it is read."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        total = np.diff(first)
        (of, _), n = arrays.counted([arrays.owner(first), cp])
        share = n / np.maximum(total, 1)[of]
        entropy = np.bincount(of, weights=-share * np.log2(share), minlength=len(total))
        on = total > 0
        return {"doc_id": rows.column("doc_id").filter(pa.array(on)), "symbols": total[on], "kinds": np.bincount(of, minlength=len(total))[on], "entropy": np.abs(entropy)[on]}

    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrays.map_symbols(docs, work, "doc_id bigint, symbols bigint, kinds bigint, entropy double", "doc_id").withColumn("entropy", F.round("entropy", 6))


def counts_by(docs: DataFrame, key: str, order: int) -> DataFrame:
    """({key}, c1, ch, n): how often each symbol stands (after c1, if order is 1) in the rows of a key; counted in blocks, then summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        names = rows.column(key).dictionary_encode()
        code = names.indices.fill_null(len(names.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
        own, place = arrays.shown(cp), np.arange(len(cp)) - np.repeat(first[:-1], np.diff(first))
        at = np.flatnonzero(place >= order)
        (k, c1, ch), n = arrays.counted([code[arrays.owner(first)[at]], own[at - 1] if order else np.zeros(len(at), np.int64), own[at]])
        back = pa.concat_arrays([names.dictionary, pa.nulls(1, names.dictionary.type)])
        return {key: back.take(pa.array(k)), "c1": arrays.symbols_of(c1), "ch": arrays.symbols_of(ch), "n": n}

    each = arrays.map_symbols(docs.withColumn(key, F.col(key).cast("string")), work, f"{key} string, c1 string, ch string, n bigint", key)
    return each.groupBy(key, "c1", "ch").agg(F.sum("n").alias("n"))


@query(
    "conditional_entropy_by_lang",
    "L18 A15",
    """WITH t AS (SELECT doc_id, pos, ch, lag(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS c1 FROM symbols), n AS (SELECT lang, c1, ch, count(*) AS n FROM t JOIN documents ON t.doc_id = documents.doc_id WHERE c1 IS NOT NULL GROUP BY lang, c1, ch),
    k AS (SELECT lang, c1, sum(n) AS total FROM n GROUP BY lang, c1), g AS (SELECT lang, sum(n) AS all_n FROM n GROUP BY lang)
    SELECT n.lang, cast(max(all_n) AS bigint) AS pairs, round(sum((n * 1.0e0) / all_n * log2(total / (n * 1.0e0))), 6) AS bits FROM n JOIN k ON n.lang = k.lang AND n.c1 = k.c1 JOIN g ON g.lang = n.lang GROUP BY n.lang""",
)
def conditional_entropy_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a symbol given the one before, by language; the language travels with its text."""
    n = counts_by(table(spark, sf_dir, "documents").where("lang is not null"), "lang", 1)
    total = n.groupBy("lang", "c1").agg(F.sum("n").alias("total"))
    every = n.groupBy("lang").agg(F.sum("n").alias("all_n"))
    share = F.col("n") / F.col("all_n")
    return n.join(total, ["lang", "c1"]).join(every, "lang").groupBy("lang").agg(F.max("all_n").alias("pairs"), F.round(F.sum(share * F.log2(F.col("total") / F.col("n"))), 6).alias("bits"))


PRIOR = "SELECT user_id, pos, CASE WHEN event_type = 'click' THEN 1.0e0 ELSE 0.0e0 END AS bit, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS ctx FROM series"
ESTIMATE = f"WITH t AS ({PRIOR}), e AS (SELECT user_id, pos, bit, ctx, coalesce(avg(bit) OVER (PARTITION BY user_id, ctx ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5e0) AS p1, coalesce(avg(bit) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5e0) AS p0 FROM t), l AS (SELECT user_id, pos, bit, ln(greatest(1e-4, least(1 - 1e-4, p1)) / (1 - greatest(1e-4, least(1 - 1e-4, p1)))) AS x1, ln(greatest(1e-4, least(1 - 1e-4, p0)) / (1 - greatest(1e-4, least(1 - 1e-4, p0)))) AS x0, p1, p0 FROM e)"
sql("calibration_bins", "L13 L15 L16", ESTIMATE + " SELECT cast(floor((greatest(-8.0e0, least(7.99e0, x1)) + 8) * 24 / 16) AS bigint) AS bin, count(*) AS n, round(avg(bit), 6) AS seen, round(avg(p1), 6) AS said FROM l GROUP BY 1")
sql("logit_average", "L7 L14 F8", ESTIMATE + " SELECT user_id, round(avg(1 / (1 + exp(-(x1 + x0) / 2))), 6) AS mean_p, cast(floor(avg(1 / (1 + exp(-(x1 + x0) / 2))) * 15) AS bigint) AS gate, round(avg(-log2(CASE WHEN bit > 0 THEN 1 / (1 + exp(-(x1 + x0) / 2)) ELSE 1 - 1 / (1 + exp(-(x1 + x0) / 2)) END)), 6) AS cost FROM l GROUP BY user_id")
sql("type_routed_average", "L14 L25", ESTIMATE + " SELECT user_id, round(avg(CASE WHEN pos % 2 = 0 THEN (3 * p1 + p0) / 4 ELSE (p1 + p0) / 2 END), 6) AS p, count(*) AS n FROM l GROUP BY user_id")


@query("crossentropy_by_source", "L18 L17 A1", "WITH t AS (SELECT doc_id, ch, count(*) AS n FROM symbols GROUP BY doc_id, ch), g AS (SELECT ch, sum(n) AS n, sum(sum(n)) OVER () AS total FROM t GROUP BY ch) SELECT source, cast(sum(t.n) AS bigint) AS symbols, round(sum(t.n * log2(total / (g.n * 1.0e0))) / sum(t.n), 6) AS bits FROM t JOIN g ON t.ch = g.ch JOIN documents ON t.doc_id = documents.doc_id GROUP BY source")
def crossentropy_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a symbol of each source under the counts of all; the source travels with its text."""
    n = counts_by(table(spark, sf_dir, "documents"), "source", 0)
    every = n.groupBy("ch").agg(F.sum("n").alias("all_n"))
    bits = F.log2(F.col("total") / F.col("all_n"))
    total = n.agg(F.sum("n")).first()[0] or 0
    own = n.join(every, "ch").withColumn("total", F.lit(total))
    return own.groupBy("source").agg(F.sum("n").alias("symbols"), F.round(F.sum(F.col("n") * bits) / F.sum("n"), 6).alias("bits"))


@query("linear_extrapolation_error", "L23", "SELECT doc_id, round(avg(abs(b - b1) * 1.0e0), 6) AS last_value, round(avg(abs(b - (2 * b1 - b2)) * 1.0e0), 6) AS line, round(avg(abs(b - (3 * b1 - 3 * b2 + b3)) * 1.0e0), 6) AS parabola FROM (SELECT doc_id, b, lag(b, 1) OVER w AS b1, lag(b, 2) OVER w AS b2, lag(b, 3) OVER w AS b3 FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY pos, k)) AS t WHERE b3 IS NOT NULL GROUP BY doc_id")
def linear_extrapolation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far three extrapolations are from each text's bytes; the errors are whole numbers and summed where the text is read."""

    def work(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        v, at = data.astype(np.int64), np.flatnonzero(arrays.places(first) >= 3)
        b, b1, b2, b3, of = v[at], v[at - 1], v[at - 2], v[at - 3], arrays.owner(first)[at]
        total = lambda e: np.bincount(of, weights=np.abs(e), minlength=len(first) - 1).astype(np.int64)
        n = np.bincount(of, minlength=len(first) - 1)
        return arrays.per_text(rows, n > 0, n=n, last_value=total(b - b1), line=total(b - (2 * b1 - b2)), parabola=total(b - (3 * b1 - 3 * b2 + b3)))

    names = ("last_value", "line", "parabola")
    each = arrays.map_bytes(arrays.documents(spark, sf_dir), work, "doc_id bigint, n bigint, last_value bigint, line bigint, parabola bigint", "doc_id")
    return each.groupBy("doc_id").agg(*[F.round(F.sum(k) / F.sum("n"), 6).alias(k) for k in names])


@query("mixer_dot_product", "L5 M24", "SELECT vec_id, round(list_sum([embedding[i] * (i % 7 - 3) / 10.0e0 for i in range(1, len(embedding) + 1)]), 4) AS dot FROM embeddings")
def mixer_dot_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A weight vector's product with each row's inputs, as a higher-order function."""
    product = F.zip_with("embedding", F.transform("embedding", lambda x, i: ((i + 1) % 7 - 3) / 10.0), lambda x, w: x.cast("double") * w)
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(F.aggregate(product, F.lit(0.0), lambda s, x: s + x), 4).alias("dot"))


# ---------------------------------------------------------------- folds


class Model:
    """Predicts a bit, then learns it."""

    def predict(self) -> float:
        raise NotImplementedError

    def update(self, bit: int) -> None:
        raise NotImplementedError


class ContextMean(Model):
    """A capped mean for each recent history of ``order`` bits."""

    def __init__(self, order: int, limit: int = 255):
        self.order, self.limit, self.state, self.ctx = order, limit, {}, 1

    def predict(self) -> float:
        return self.state.get(self.ctx, (0.5, 0))[0]

    def update(self, bit: int) -> None:
        p, n = self.state.get(self.ctx, (0.5, 0))
        self.state[self.ctx] = p + (bit - p) / (n + 1.5), min(n + 1, self.limit)
        self.ctx = ((self.ctx << 1) | bit) & ((1 << self.order) - 1) | (1 << self.order)


class Mixer(Model):
    """Weights chosen by a gate, a dot product of logits, an AdaGrad step on the error.

    Each weight's step shrinks with the root of its own squared gradients so far, and every
    step pulls the gate's weights a little towards an equal mix.  The gate is the last bit,
    or, ``by_failure``, how many of the last eight predictions were on the wrong side.
    Errors inside the ``dead`` band are good enough and change nothing.
    """

    def __init__(self, models: list[Model], gates: int = 1, rate: float = 0.05, pull: float = 1e-5, dead: float = 0.0, by_failure: bool = False):
        self.models, self.rate, self.pull, self.dead, self.by_failure = models, rate, pull, dead, by_failure
        self.even = 1.0 / max(1, len(models))
        self.weights = np.full((gates, len(models)), self.even)
        self.squares = np.ones((gates, len(models)))
        self.gate, self.inputs, self.p, self.failures = 0, np.zeros(len(models)), 0.5, 0

    def predict(self) -> float:
        p = np.clip([m.predict() for m in self.models], 1e-4, 1 - 1e-4)
        self.inputs = np.log(p / (1 - p))
        self.p = float(np.clip(1 / (1 + np.exp(-np.clip(self.weights[self.gate] @ self.inputs, -30, 30))), 1e-6, 1 - 1e-6))
        return self.p

    def update(self, bit: int) -> None:
        if abs(self.p - bit) >= self.dead:
            own = self.weights[self.gate]
            gradient = (self.p - bit) * self.inputs + self.pull * (own - self.even)
            self.squares[self.gate] += gradient**2
            own -= self.rate * gradient / np.sqrt(self.squares[self.gate])
        for m in self.models:
            m.update(bit)
        self.failures = (self.failures << 1 | int((self.p >= 0.5) != bool(bit))) & 255
        self.gate = min(self.failures.bit_count(), len(self.weights) - 1) if self.by_failure else bit % len(self.weights)


class IntegerMixer(Model):
    """A mixer in whole numbers alone: logits in 256ths, weights in 65,536ths, shifts for divisions.

    Two integer machines give the same predictions to the last bit, whatever their floats do.
    """

    UNIT, SHIFT = 256, 16  # of a logit; of a weight

    def __init__(self, models: list[Model], step: int = 14):
        self.models, self.step = models, step
        self.weights = [(1 << self.SHIFT) // max(1, len(models))] * len(models)
        #: probabilities (of 65,536) of the logits -12 to 12, and logits of the probabilities (of 4,096)
        self.squash = [round(65536 / (1 + np.exp(-x / self.UNIT))) for x in range(-12 * self.UNIT, 12 * self.UNIT + 1)]
        self.stretch = [round(self.UNIT * float(np.log((k + 0.5) / (4096 - k - 0.5)))) for k in range(4096)]
        self.inputs, self.p = [0] * len(models), 32768

    def predict(self) -> float:
        self.inputs = [self.stretch[min(4095, max(0, int(m.predict() * 4096)))] for m in self.models]
        dot = sum(w * x for w, x in zip(self.weights, self.inputs)) >> self.SHIFT
        self.p = self.squash[min(12 * self.UNIT, max(-12 * self.UNIT, dot)) + 12 * self.UNIT]
        return min(max(self.p, 1), 65535) / 65536

    def update(self, bit: int) -> None:
        error = (bit << 16) - self.p
        self.weights = [w + (x * error >> self.step) for w, x in zip(self.weights, self.inputs)]
        for m in self.models:
            m.update(bit)


class Layered(Model):
    """Two layers: mixers that see the models, each also the earlier mixers' outputs, and one over them."""

    def __init__(self, models: list[Model], mixers: int = 3):
        self.models, self.rate = models, 0.02
        self.first = [np.full(len(models) + k, 0.3) for k in range(mixers)]
        self.last = np.full(mixers, 1.0 / mixers)

    def predict(self) -> float:
        p = np.clip([m.predict() for m in self.models], 1e-4, 1 - 1e-4)
        self.x = list(np.log(p / (1 - p)))
        self.seen, self.out = [], []
        for w in self.first:
            x = np.array(self.x + self.out)
            self.seen.append(x)
            self.out.append(float(np.clip(w @ x, -12, 12)))
        self.p = float(np.clip(1 / (1 + np.exp(-np.clip(self.last @ np.array(self.out), -30, 30))), 1e-6, 1 - 1e-6))
        return self.p

    def update(self, bit: int) -> None:
        for w, x, y in zip(self.first, self.seen, self.out):
            w += self.rate * (bit - 1 / (1 + np.exp(-y))) * x
        self.last += self.rate * (bit - self.p) * np.array(self.out)
        for m in self.models:
            m.update(bit)


class Graph(Model):
    """Dynamic Markov coding: a state graph that clones a state reached often by one edge."""

    def __init__(self, threshold: float = 2.0, most: int = 20000):
        self.threshold, self.most = threshold, most
        self.reset()

    def reset(self) -> None:
        self.next, self.count, self.at = [[0, 0]], [[0.2, 0.2]], 0

    def predict(self) -> float:
        a, b = self.count[self.at]
        return b / (a + b)

    def update(self, bit: int) -> None:
        to = self.next[self.at][bit]
        edge = self.count[self.at][bit]
        inside = sum(self.count[to])
        if edge > self.threshold and inside - edge > self.threshold:
            share = edge / inside
            self.next.append(list(self.next[to]))
            self.count.append([c * share for c in self.count[to]])
            self.count[to] = [c * (1 - share) for c in self.count[to]]
            to = len(self.next) - 1
            self.next[self.at][bit] = to
        self.count[self.at][bit] += 1
        self.at = to
        if len(self.next) > self.most:
            self.reset()


class Average(Model):
    """Models in equal parts."""

    def __init__(self, models: list[Model]):
        self.models = models

    def predict(self) -> float:
        return sum(m.predict() for m in self.models) / len(self.models)

    def update(self, bit: int) -> None:
        for m in self.models:
            m.update(bit)


class Calibrated(Model):
    """A model whose logit is corrected by interpolating between bins that learn what came."""

    def __init__(self, model: Model, bins: int = 24):
        self.model, self.bins = model, bins
        edge = np.linspace(-8, 8, bins)
        self.table = 1 / (1 + np.exp(-edge))

    def predict(self) -> float:
        p = min(max(self.model.predict(), 1e-4), 1 - 1e-4)
        x = (np.clip(np.log(p / (1 - p)), -8, 7.999) + 8) * (self.bins - 1) / 16
        self.low, self.part = int(x), float(x - int(x))
        own = self.table[self.low] * (1 - self.part) + self.table[self.low + 1] * self.part
        return float((p + 3 * own) / 4)

    def update(self, bit: int) -> None:
        self.table[self.low] += 0.02 * (1 - self.part) * (bit - self.table[self.low])
        self.table[self.low + 1] += 0.02 * self.part * (bit - self.table[self.low + 1])
        self.model.update(bit)


def cost(model: Model, bits: list[int]) -> float:
    """Bits that an ideal coder spends on a sequence."""
    total = 0.0
    for b in bits:
        p = min(max(model.predict(), 1e-6), 1 - 1e-6)
        total -= float(np.log2(p if b else 1 - p))
        model.update(b)
    return total


def arithmetic_encode(model: Model, bits: list[int]) -> bytes:
    """A 32-bit carryless arithmetic code of a sequence under a model."""
    low, high, out = 0, 0xFFFFFFFF, bytearray()
    for b in bits:
        p = min(max(int(model.predict() * 65535), 1), 65534)
        middle = low + (high - low) * p // 65536
        if b:
            high = middle
        else:
            low = middle + 1
        while (low ^ high) >> 24 == 0:
            out.append(high >> 24)
            low, high = (low << 8) & 0xFFFFFFFF, ((high << 8) & 0xFFFFFFFF) | 255
        model.update(b)
    return bytes(out) + low.to_bytes(4, "big")


def arithmetic_decode(model: Model, data: bytes, n: int) -> list[int]:
    """The ``n`` bits of a code, under an equal model."""
    low, high, at, out = 0, 0xFFFFFFFF, 4, []
    x = int.from_bytes(data[:4].ljust(4, b"\0"), "big")
    for _ in range(n):
        p = min(max(int(model.predict() * 65535), 1), 65534)
        middle = low + (high - low) * p // 65536
        b = int(x <= middle)
        if b:
            high = middle
        else:
            low = middle + 1
        while (low ^ high) >> 24 == 0:
            low, high = (low << 8) & 0xFFFFFFFF, ((high << 8) & 0xFFFFFFFF) | 255
            x = ((x << 8) & 0xFFFFFFFF) | (data[at] if at < len(data) else 0)
            at += 1
        model.update(b)
        out.append(b)
    return out


MODELS = {
    "order0": lambda: ContextMean(0),
    "order2": lambda: ContextMean(2),
    "order6": lambda: ContextMean(6),
    "mixed": lambda: Mixer([ContextMean(k) for k in (0, 1, 2, 4, 6)], gates=2),
    "dead_band": lambda: Mixer([ContextMean(k) for k in (0, 1, 2, 4, 6)], dead=0.01),
    "by_failure": lambda: Mixer([ContextMean(k) for k in (0, 2, 4, 6)], gates=5, by_failure=True),
    "integer": lambda: IntegerMixer([ContextMean(k) for k in (0, 1, 2, 4, 6)]),
    "layered": lambda: Layered([ContextMean(k) for k in (0, 2, 4, 6)]),
    "graph": lambda: Graph(),
    "forest": lambda: Average([Graph(t) for t in (1.0, 2.0, 4.0, 8.0)]),
    "calibrated": lambda: Calibrated(Mixer([ContextMean(k) for k in (0, 2, 4)])),
}


# ---------------------------------------------------------------- many sequences side by side

HELD_ROWS = 1 << 20  # rows of whole keys that a worker holds
SIDE_ROWS, SIDE_KEYS = 1 << 18, 2048  # rows and keys that step together


def sequences(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows of whole keys, and where each key's begin, of rows that come sorted by key; about ``HELD_ROWS`` or one key."""

    def begins(rows: pa.Table) -> np.ndarray:
        own = rows.column(key).combine_chunks()
        null, value = own.is_null().to_numpy(zero_copy_only=False), own.fill_null(0).to_numpy(zero_copy_only=False)
        return np.concatenate([[0], np.flatnonzero((value[1:] != value[:-1]) | (null[1:] != null[:-1])) + 1])

    held, n, limit = [], 0, HELD_ROWS
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += batch.num_rows
        if n >= limit:
            rows = pa.Table.from_batches(held).combine_chunks()
            first = begins(rows)
            if first[-1]:
                yield rows.slice(0, first[-1]), first
            held, n = rows.slice(first[-1]).to_batches(), rows.num_rows - int(first[-1])
            limit = max(HELD_ROWS, 2 * n)
    if n:
        rows = pa.Table.from_batches(held).combine_chunks()
        yield rows, np.append(begins(rows), n)


def map_sequences(rows: DataFrame, key: str, order: list[str], work: Callable, schema: str) -> DataFrame:
    """``work(rows, begins)`` of whole keys' rows in order, many keys at a time, a dictionary of columns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, first in sequences(batches, key):
            out = work(own, first)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

    keep = [c for c in rows.columns if c not in order]
    near = rows.withColumn(key, F.col(key).cast("bigint")).repartition(key)
    return near.sortWithinPartitions(key, *[F.col(c).asc_nulls_last() for c in order]).select(*keep).mapInArrow(run, schema)


def sides(size: np.ndarray, most: int = SIDE_KEYS) -> Iterator[np.ndarray]:
    """Sequences to step together, the longest first."""
    order = np.argsort(-size, kind="stable")
    at = 0
    while at < len(order):
        end = at + max(1, min(most, SIDE_ROWS // max(1, int(size[order[at]]))))
        yield order[at:end]
        at = end


def laid_out(values: np.ndarray, first: np.ndarray, own: np.ndarray) -> Iterator[np.ndarray]:
    """At each step the values of those of the sequences ``own``, the longest first, that still go on."""
    begin, size = first[own], first[own + 1] - first[own]
    for t in range(int(size[0])):
        yield values[begin[: np.searchsorted(-size, -t)] + t]


class Means:
    """:class:`ContextMean` of many sequences; models that see the same one share it."""

    def __init__(self, like: ContextMean, users: int):
        self.order, self.limit, self.row = like.order, like.limit, np.arange(users)
        self.p, self.n = np.full((users, 2 << like.order), 0.5), np.zeros((users, 2 << like.order), np.int64)
        self.ctx, self.said = np.ones(users, np.int64), np.empty(0)

    def ready(self, a: int) -> None:
        self.said = self.p[self.row[:a], self.ctx[:a]]

    def predict(self, a: int) -> np.ndarray:
        return self.said

    def learn(self, bits: np.ndarray) -> None:
        """Nothing: :meth:`step` is called once, whoever shares it."""

    def step(self, bits: np.ndarray) -> None:
        at = self.row[: len(bits)], self.ctx[: len(bits)]
        n = self.n[at]
        self.p[at] = self.said + (bits - self.said) / (n + 1.5)
        self.n[at] = np.minimum(n + 1, self.limit)
        self.ctx[: len(bits)] = (self.ctx[: len(bits)] << 1 | bits) & ((1 << self.order) - 1) | (1 << self.order)


class ManyMixers:
    """:class:`Mixer` of many sequences."""

    def __init__(self, like: Mixer, users: int, models: list):
        self.like, self.models, self.row = like, models, np.arange(users)
        self.weights, self.squares = (np.repeat(x[None], users, 0) for x in (like.weights, like.squares))
        self.gate, self.failures = np.zeros((2, users), np.int64)

    def predict(self, a: int) -> np.ndarray:
        p = np.clip(np.stack([m.predict(a) for m in self.models], 1), 1e-4, 1 - 1e-4)
        self.inputs = np.log(p / (1 - p))
        dot = (self.weights[self.row[:a], self.gate[:a]] * self.inputs).sum(1)
        self.p = np.clip(1 / (1 + np.exp(-np.clip(dot, -30, 30))), 1e-6, 1 - 1e-6)
        return self.p

    def learn(self, bits: np.ndarray) -> None:
        a, error = len(bits), self.p - bits
        on = np.abs(error) >= self.like.dead
        at = self.row[:a][on], self.gate[:a][on]
        own = self.weights[at]
        gradient = error[on][:, None] * self.inputs[on] + self.like.pull * (own - self.like.even)
        self.squares[at] += gradient**2
        self.weights[at] = own - self.like.rate * gradient / np.sqrt(self.squares[at])
        for m in self.models:
            m.learn(bits)
        gates = len(self.like.weights)
        self.failures[:a] = (self.failures[:a] << 1 | ((self.p >= 0.5) != (bits > 0))) & 255
        self.gate[:a] = np.minimum(np.bitwise_count(self.failures[:a]), gates - 1) if self.like.by_failure else bits % gates


class ManyIntegers:
    """:class:`IntegerMixer` of many sequences."""

    def __init__(self, like: IntegerMixer, users: int, models: list):
        self.like, self.models = like, models
        self.weights = np.repeat(np.array([like.weights], np.int64), users, 0)
        self.squash, self.stretch = np.array(like.squash), np.array(like.stretch)

    def predict(self, a: int) -> np.ndarray:
        most = 12 * self.like.UNIT
        self.inputs = self.stretch[np.clip((np.stack([m.predict(a) for m in self.models], 1) * 4096).astype(np.int64), 0, 4095)]
        dot = (self.weights[:a] * self.inputs).sum(1) >> self.like.SHIFT
        self.p = self.squash[np.clip(dot, -most, most) + most]
        return np.clip(self.p, 1, 65535) / 65536

    def learn(self, bits: np.ndarray) -> None:
        self.weights[: len(bits)] += self.inputs * ((bits << 16) - self.p)[:, None] >> self.like.step
        for m in self.models:
            m.learn(bits)


class ManyLayered:
    """:class:`Layered` of many sequences."""

    def __init__(self, like: Layered, users: int, models: list):
        self.rate, self.models = like.rate, models
        self.first, self.last = [np.repeat(w[None], users, 0) for w in like.first], np.repeat(like.last[None], users, 0)

    def predict(self, a: int) -> np.ndarray:
        p = np.clip(np.stack([m.predict(a) for m in self.models], 1), 1e-4, 1 - 1e-4)
        x, self.seen, self.out = np.log(p / (1 - p)), [], []
        for w in self.first:
            self.seen.append(np.column_stack([x, *self.out]))
            self.out.append(np.clip((w[:a] * self.seen[-1]).sum(1), -12, 12))
        dot = (self.last[:a] * np.column_stack(self.out)).sum(1)
        self.p = np.clip(1 / (1 + np.exp(-np.clip(dot, -30, 30))), 1e-6, 1 - 1e-6)
        return self.p

    def learn(self, bits: np.ndarray) -> None:
        a = len(bits)
        for w, x, y in zip(self.first, self.seen, self.out):
            w[:a] += (self.rate * (bits - 1 / (1 + np.exp(-y))))[:, None] * x
        self.last[:a] += (self.rate * (bits - self.p))[:, None] * np.column_stack(self.out)
        for m in self.models:
            m.learn(bits)


class ManyAverages:
    """:class:`Average` of many sequences."""

    def __init__(self, models: list):
        self.models = models

    def predict(self, a: int) -> np.ndarray:
        return sum(m.predict(a) for m in self.models) / len(self.models)

    def learn(self, bits: np.ndarray) -> None:
        for m in self.models:
            m.learn(bits)


class ManyCalibrated:
    """:class:`Calibrated` of many sequences."""

    def __init__(self, like: Calibrated, users: int, model):
        self.bins, self.model, self.row = like.bins, model, np.arange(users)
        self.table = np.repeat(like.table[None], users, 0)

    def predict(self, a: int) -> np.ndarray:
        p = np.clip(self.model.predict(a), 1e-4, 1 - 1e-4)
        x = (np.clip(np.log(p / (1 - p)), -8, 7.999) + 8) * (self.bins - 1) / 16
        self.low = x.astype(np.int64)
        self.part = x - self.low
        row = self.row[:a]
        return (p + 3 * (self.table[row, self.low] * (1 - self.part) + self.table[row, self.low + 1] * self.part)) / 4

    def learn(self, bits: np.ndarray) -> None:
        row = self.row[: len(bits)]
        for at, part in ((self.low, 1 - self.part), (self.low + 1, self.part)):
            self.table[row, at] += 0.02 * part * (bits - self.table[row, at])
        self.model.learn(bits)


class Each:
    """Any other model, each sequence's own by itself."""

    def __init__(self, models: list[Model]):
        self.models = models

    def predict(self, a: int) -> np.ndarray:
        return np.array([m.predict() for m in self.models[:a]])

    def learn(self, bits: np.ndarray) -> None:
        for m, b in zip(self.models, bits.tolist()):
            m.update(b)


def lifted(make: Callable[[], Model], users: int, means: dict[tuple, Means]):
    """The model that ``make`` makes, for many sequences that step together; ``means`` are shared by all."""

    def lift(like: Model, path: Callable[[Model], Model]):
        if type(like) is ContextMean:
            return means.setdefault((like.order, like.limit), Means(like, users))
        if type(like) is Calibrated:
            return ManyCalibrated(like, users, lift(like.model, lambda m: path(m).model))
        kind = {Mixer: ManyMixers, IntegerMixer: ManyIntegers, Layered: ManyLayered, Average: ManyAverages}.get(type(like))
        if kind is None:
            return Each([path(make()) for _ in range(users)])
        inner = [lift(m, lambda x, k=k: path(x).models[k]) for k, m in enumerate(like.models)]
        return ManyAverages(inner) if kind is ManyAverages else kind(like, users, inner)

    return lift(make(), lambda m: m)


def costs(makes: list[Callable[[], Model]], bits: np.ndarray, first: np.ndarray) -> np.ndarray:
    """:func:`cost` of each sequence of ``bits`` (that begin at ``first``) under each model."""
    total = np.zeros((len(first) - 1, len(makes)))
    for own in sides(np.diff(first)):
        means: dict[tuple, Means] = {}
        models = [lifted(make, len(own), means) for make in makes]
        part = np.zeros((len(own), len(makes)))
        for b in laid_out(bits, first, own):
            a = len(b)
            for m in means.values():
                m.ready(a)
            for k, m in enumerate(models):
                p = np.clip(m.predict(a), 1e-6, 1 - 1e-6)
                part[:a, k] -= np.log2(np.where(b > 0, p, 1 - p))
                m.learn(b)
            for m in means.values():
                m.step(b)
        total[own] = part
    return total


def user_bits(rows: pd.DataFrame) -> list[int]:
    return (rows.sort_values(["ts", "event_id"])["value"].diff().fillna(0) > 0).astype(int).tolist()


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")


@query("model_costs", "L1 L5 L6 L11 L12 L13 L15 L16 L21 L22 ST1 U1 U2")
def model_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a step that each model spends on the rises and falls of each user's series; many users step together."""

    def work(rows: pa.Table, first: np.ndarray) -> dict:
        value, n = rows.column("value").to_numpy(), np.diff(first)
        rises = np.zeros(len(value), np.int64)
        with np.errstate(invalid="ignore"):
            rises[1:] = np.diff(value) > 0
        rises[first[:-1]] = 0
        bits = costs(list(MODELS.values()), rises, first) / n[:, None]
        user = np.repeat(np.arange(len(n)), len(MODELS))
        return {"user_id": rows.column("user_id").combine_chunks().take(pa.array(first[user])), "model": list(MODELS) * len(n), "n": n[user], "bits": [round(x, 6) for x in bits.ravel().tolist()]}

    return map_sequences(_events(spark, sf_dir), "user_id", ["ts", "event_id"], work, "user_id long, model string, n long, bits double")


@query("arithmetic_roundtrip", "L17 IO3 IO4")
def arithmetic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's bits coded and decoded under the mixed model."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits = user_bits(rows)
        data = arithmetic_encode(MODELS["mixed"](), bits)
        same = arithmetic_decode(MODELS["mixed"](), data, len(bits)) == bits
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(bits)], "coded_bytes": [len(data)], "same": [same]})

    return _events(spark, sf_dir).groupBy("user_id").applyInPandas(run, "user_id long, n long, coded_bytes long, same boolean")


class Lstm:
    """Layers of LSTM cells that predict a symbol: coupled gates, root-mean-square norm, truncated backpropagation, Adam.

    A layer reads the symbol (the first one) or the layer below, and its own last output;
    each gate's sum is divided by its root mean square, then scaled and moved.  The symbol's
    probabilities come from all layers' outputs.
    """

    GATES = "foc"  # what is kept, what is shown, what is written

    def __init__(self, symbols: int, cells: int = 8, layers: int = 2, horizon: int = 20, rate: float = 0.03, seed: int = 0):
        rng = np.random.default_rng(seed)
        self.n, self.h, self.layers, self.horizon, self.rate = symbols, cells, layers, horizon, rate
        self.w: dict[str, np.ndarray] = {"y": rng.normal(0, 0.3, (layers * cells + 1, symbols))}
        for k in range(layers):
            for g in self.GATES:
                self.w |= {f"{g}{k}": rng.normal(0, 0.3, ((cells if k else symbols) + cells + 1, cells)), f"scale_{g}{k}": np.ones(cells), f"move_{g}{k}": np.zeros(cells)}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        self.c, self.out = np.zeros((2, layers, cells))
        self.steps, self.tape, self.last = 0, [], 0

    def predict(self) -> np.ndarray:
        below = np.zeros(self.n)
        below[self.last] = 1
        own = []
        for k in range(self.layers):
            x = np.concatenate([below, self.out[k], [1.0]])
            gates = {}
            for g in self.GATES:
                a = x @ self.w[f"{g}{k}"]
                r = np.sqrt((a * a).mean() + 1e-5)
                z = a / r * self.w[f"scale_{g}{k}"] + self.w[f"move_{g}{k}"]
                gates[g] = (a, r, np.tanh(z) if g == "c" else 1 / (1 + np.exp(-z)))
            keep, show, new = (gates[g][2] for g in self.GATES)
            before = self.c[k].copy()
            self.c[k] = keep * before + (1 - keep) * new
            self.out[k] = show * np.tanh(self.c[k])
            own.append((x, gates, before, self.c[k].copy()))
            below = self.out[k].copy()
        h = np.append(self.out.ravel(), 1.0)
        y = h @ self.w["y"]
        p = np.exp(y - y.max())
        p /= p.sum()
        self.tape.append([own, h, p, 0])
        return p

    def gradients(self) -> dict[str, np.ndarray]:
        """Of the cost of the symbols on the tape, back to its beginning."""
        grad = {k: np.zeros_like(x) for k, x in self.w.items()}
        carry_out, carry_c = np.zeros((2, self.layers, self.h))
        for own, h, p, symbol in reversed(self.tape):
            dy = p.copy()
            dy[symbol] -= 1
            grad["y"] += np.outer(h, dy)
            shown = (self.w["y"][:-1] @ dy).reshape(self.layers, self.h)
            above = np.zeros(self.h)
            for k in range(self.layers - 1, -1, -1):
                x, gates, before, c = own[k]
                keep, show, new = (gates[g][2] for g in self.GATES)
                d, t = carry_out[k] + shown[k] + above, np.tanh(c)
                dc = carry_c[k] + d * show * (1 - t * t)
                inner = {"f": dc * (before - new) * keep * (1 - keep), "o": d * t * show * (1 - show), "c": dc * (1 - keep) * (1 - new * new)}
                dx = np.zeros_like(x)
                for g, dz in inner.items():
                    a, r, _ = gates[g]
                    grad[f"scale_{g}{k}"] += dz * a / r
                    grad[f"move_{g}{k}"] += dz
                    dn = dz * self.w[f"scale_{g}{k}"]
                    da = dn / r - a * (dn @ a) / (self.h * r**3)
                    grad[f"{g}{k}"] += np.outer(x, da)
                    dx += self.w[f"{g}{k}"] @ da
                carry_c[k] = dc * keep
                carry_out[k] = dx[-self.h - 1 : -1]
                above = dx[: self.h] if k else above
        return grad

    def update(self, symbol: int) -> None:
        self.tape[-1][-1] = symbol
        self.last = symbol
        if len(self.tape) < self.horizon:
            return
        grad = self.gradients()
        self.tape.clear()
        self.steps += 1
        for k, g in grad.items():
            g = np.clip(g, -10, 10)
            self.m[k] = 0.9 * self.m[k] + 0.1 * g
            self.v[k] = 0.999 * self.v[k] + 0.001 * g * g
            self.w[k] -= self.rate * (self.m[k] / (1 - 0.9**self.steps)) / (np.sqrt(self.v[k] / (1 - 0.999**self.steps)) + 1e-8)

    def save(self) -> bytes:
        """Weights and state as one file's bytes."""
        out = io.BytesIO()
        np.savez(out, c_state=self.c, out_state=self.out, last=self.last, **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, symbols: int, **shape: int) -> Lstm:
        """A network that goes on where the saved one was."""
        net, found = cls(symbols, **shape), np.load(io.BytesIO(data))
        net.w = {k: found[k] for k in net.w}
        net.c, net.out, net.last = found["c_state"].copy(), found["out_state"].copy(), int(found["last"])
        return net


class ManyLstms:
    """A network of :class:`Lstm` for each of many sequences of as many symbols; all step together, each learns alone."""

    GATES = Lstm.GATES

    def __init__(self, symbols: int, users: int, **shape: int):
        one = Lstm(symbols, **shape)
        self.n, self.h, self.layers, self.horizon, self.rate = one.n, one.h, one.layers, one.horizon, one.rate
        self.w = {k: np.repeat(x[None], users, 0) for k, x in one.w.items()}
        self.m, self.v = ({k: np.zeros_like(x) for k, x in self.w.items()} for _ in range(2))
        self.c, self.out = np.zeros((2, users, self.layers, self.h))
        self.steps, self.tape, self.last = 0, [], np.zeros(users, np.int64)

    def predict(self, a: int) -> np.ndarray:
        below = np.zeros((a, self.n))
        below[np.arange(a), self.last[:a]] = 1
        own, one = [], np.ones((a, 1))
        for k in range(self.layers):
            x = np.concatenate([below, self.out[:a, k], one], 1)
            gates = {}
            for g in self.GATES:
                y = np.matmul(x[:, None], self.w[f"{g}{k}"][:a])[:, 0]
                r = np.sqrt((y * y).mean(1, keepdims=True) + 1e-5)
                z = y / r * self.w[f"scale_{g}{k}"][:a] + self.w[f"move_{g}{k}"][:a]
                gates[g] = (y, r, np.tanh(z) if g == "c" else 1 / (1 + np.exp(-z)))
            keep, show, new = (gates[g][2] for g in self.GATES)
            before = self.c[:a, k].copy()
            c = keep * before + (1 - keep) * new
            below = show * np.tanh(c)
            self.c[:a, k], self.out[:a, k] = c, below
            own.append((x, gates, before, c))
        h = np.concatenate([self.out[:a].reshape(a, -1), one], 1)
        y = np.matmul(h[:, None], self.w["y"][:a])[:, 0]
        p = np.exp(y - y.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        self.tape.append([own, h, p, None])
        return p

    def gradients(self, a: int) -> dict[str, np.ndarray]:
        """Of the cost of the symbols on the tape, for the first ``a``, back to its beginning."""
        grad = {k: np.zeros((a, *x.shape[1:])) for k, x in self.w.items()}
        carry_out, carry_c = np.zeros((2, self.layers, a, self.h))
        for own, h, p, symbols in reversed(self.tape):
            dy = p[:a].copy()
            dy[np.arange(a), symbols[:a]] -= 1
            grad["y"] += h[:a, :, None] * dy[:, None]
            shown = np.matmul(self.w["y"][:a, :-1], dy[:, :, None])[:, :, 0].reshape(a, self.layers, self.h)
            above = np.zeros((a, self.h))
            for k in range(self.layers - 1, -1, -1):
                x, before, c = (v[:a] for v in (own[k][0], own[k][2], own[k][3]))
                gates = {g: tuple(v[:a] for v in own[k][1][g]) for g in self.GATES}
                keep, show, new = (gates[g][2] for g in self.GATES)
                d, t = carry_out[k] + shown[:, k] + above, np.tanh(c)
                dc = carry_c[k] + d * show * (1 - t * t)
                inner = {"f": dc * (before - new) * keep * (1 - keep), "o": d * t * show * (1 - show), "c": dc * (1 - keep) * (1 - new * new)}
                dx = np.zeros_like(x)
                for g, dz in inner.items():
                    y, r, _ = gates[g]
                    grad[f"scale_{g}{k}"] += dz * y / r
                    grad[f"move_{g}{k}"] += dz
                    dn = dz * self.w[f"scale_{g}{k}"][:a]
                    da = dn / r - y * (dn * y).sum(1, keepdims=True) / (self.h * r**3)
                    grad[f"{g}{k}"] += x[:, :, None] * da[:, None]
                    dx += np.matmul(self.w[f"{g}{k}"][:a], da[:, :, None])[:, :, 0]
                carry_c[k] = dc * keep
                carry_out[k] = dx[:, -self.h - 1 : -1]
                above = dx[:, : self.h] if k else above
        return grad

    def update(self, symbols: np.ndarray) -> None:
        a = len(symbols)
        self.tape[-1][-1] = symbols
        self.last[:a] = symbols
        if len(self.tape) < self.horizon:
            return
        grad = self.gradients(a)
        self.tape.clear()
        self.steps += 1
        for k, g in grad.items():
            g = np.clip(g, -10, 10)
            m, v = self.m[k][:a], self.v[k][:a]
            m[...] = 0.9 * m + 0.1 * g
            v[...] = 0.999 * v + 0.001 * g * g
            self.w[k][:a] -= self.rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.999**self.steps)) + 1e-8)

    def save(self) -> bytes:
        """All networks' weights and states as one file's bytes."""
        out = io.BytesIO()
        np.savez(out, c_state=self.c, out_state=self.out, last=self.last, **self.w)
        return out.getvalue()

    @classmethod
    def load(cls, data: bytes, symbols: int, **shape: int) -> ManyLstms:
        """Networks that go on where the saved ones were."""
        found = np.load(io.BytesIO(data))
        nets = cls(symbols, len(found["last"]), **shape)
        nets.w = {k: found[k] for k in nets.w}
        nets.c, nets.out, nets.last = found["c_state"].copy(), found["out_state"].copy(), found["last"].copy()
        return nets


NET_VALUES = 1 << 19  # weights of the networks that step together, or one network's


def symbol_costs(seq: np.ndarray, first: np.ndarray, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bits that an LSTM, symbol counts and their average spend on each sequence (of ``kinds`` symbols), and whether its saved network goes on the same."""
    bits, same = np.zeros((len(kinds), 3)), np.zeros(len(kinds), bool)
    for n in np.unique(kinds).tolist():
        every = np.flatnonzero(kinds == n)
        each = sum(x.size for x in Lstm(n).w.values())
        for side in sides(np.diff(first)[every], max(1, min(SIDE_KEYS, NET_VALUES // each))):
            own = every[side]
            nets, counts, part, row = ManyLstms(n, len(own)), np.ones((len(own), n)), np.zeros((len(own), 3)), np.arange(len(own))
            for s in laid_out(seq, first, own):
                a = len(s)
                p, q = nets.predict(a)[row[:a], s], counts[row[:a], s] / counts[:a].sum(1)
                part[:a] -= np.log2(np.stack([p, q, (p + q) / 2], 1))
                nets.update(s)
                counts[row[:a], s] += 1
            back = ManyLstms.load(nets.save(), n)
            bits[own], same[own] = part, (back.predict(len(own)) == nets.predict(len(own))).all(1)
    return bits, same


@query("lstm_cost", "L8 L9 L10 L24 IO19")
def lstm_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bits a step of a small LSTM, of symbol counts, and of their average, on each user's event types; a saved network goes on like the one it was saved from."""

    def work(rows: pa.Table, first: np.ndarray) -> dict:
        names = rows.column("event_type").combine_chunks().fill_null("").dictionary_encode()
        known, n = names.dictionary.to_pylist(), np.diff(first)
        rank = np.empty(len(known), np.int64)
        rank[sorted(range(len(known)), key=known.__getitem__)] = np.arange(len(known))
        found, seq = np.unique(arrays.owner(first) * len(known) + rank[names.indices.to_numpy()], return_inverse=True)
        kinds = np.bincount(found // len(known), minlength=len(n))
        bits, same = symbol_costs(seq - np.repeat(np.cumsum(kinds) - kinds, n), first, kinds)
        shown = {k: [round(x, 6) for x in v] for k, v in zip(("lstm", "counts", "average"), (bits / n[:, None]).T.tolist())}
        return {"user_id": rows.column("user_id").combine_chunks().take(pa.array(first[:-1])), "n": n} | shown | {"weights_same": same}

    return map_sequences(table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", ["ts", "event_id"], work, "user_id long, n long, lstm double, counts double, average double, weights_same boolean")


def gate_columns(symbol: Column, order1: Column, column: Column) -> dict[str, Column]:
    """Keys that choose a weight set, by name: each gate is a feature column."""
    return {"order0": symbol, "order1": order1, "column": F.least(column, F.lit(99)), "constant": F.lit(0)}
