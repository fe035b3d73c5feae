"""Adaptive statistics: prefix means, capped averages, run lengths, histories, counters, evidence."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, table

LIMIT = 30


def capped_mean(sorted_values: Column, limit: int = LIMIT, delta: float = 0.0, start: float = 0.5) -> Column:
    """The running estimate after an array of values in order: step 1 / (n + delta), n growing to ``limit``."""
    begin = F.struct(F.lit(start).alias("p"), F.lit(0).alias("n"))
    step = lambda s, x: F.struct((s["p"] + (x - s["p"]) / (s["n"] + 1 + delta)).alias("p"), F.least(s["n"] + 1, F.lit(limit - 1)).alias("n"))
    return F.aggregate(sorted_values, begin, step, lambda s: s["p"])


PREFIX = """SELECT doc_id, pos, c1, hit, coalesce(avg(hit) OVER (PARTITION BY doc_id, c1 ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.5e0) AS p FROM (
  SELECT doc_id, pos, lag(ch) OVER (PARTITION BY doc_id ORDER BY pos) AS c1, CASE WHEN ch = 'e' THEN 1.0e0 ELSE 0.0e0 END AS hit FROM symbols) AS t"""


@query("prefix_mean_predictor", "A1 A2 A8 A9 A10 A12 L4 M11", f"SELECT doc_id, round(avg(p), 6) AS mean_p, round(avg((p - hit) * (p - hit)), 6) AS brier, round(sum(-log2(greatest(1e-4, least(1 - 1e-4, CASE WHEN hit > 0 THEN p ELSE 1 - p END)))), 4) AS cost_bits FROM ({PREFIX}) AS s GROUP BY doc_id")
def prefix_mean_predictor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often an e has followed a symbol so far in its text, as a prediction of the next symbol; no shuffle."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        of, hit = arrays.owner(first), (cp == ord("e")).astype(float)
        kinds, codes = np.unique(cp, return_inverse=True)
        context = np.full(len(cp), len(kinds))
        context[1:] = codes[:-1]
        heads = first[:-1][np.diff(first) > 0]
        context[heads] = len(kinds)
        order = np.argsort(context.astype(np.uint16) if len(kinds) < 65535 else context, kind="stable")  # then by text, then by place
        fresh = np.ones(len(order), bool)
        fresh[1:] = (context[order[1:]] != context[order[:-1]]) | (of[order[1:]] != of[order[:-1]])
        begin = np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
        seen = np.arange(len(order)) - begin
        total = np.cumsum(hit[order]) - hit[order]
        p = np.empty(len(cp))
        p[order] = np.where(seen > 0, (total - total[begin]) / np.maximum(seen, 1), 0.5)
        cost = -np.log2(np.clip(np.where(hit > 0, p, 1 - p), 1e-4, 1 - 1e-4))
        n = np.diff(first)
        on = pa.array(n > 0)
        out = {"doc_id": rows.column("doc_id")} | {k: pa.array(arrays.sums(v, first) / np.maximum(n, 1) if k != "cost_bits" else arrays.sums(v, first)) for k, v in (("mean_p", p), ("brier", (p - hit) ** 2), ("cost_bits", cost))}
        return {k: v.filter(on) for k, v in out.items()}

    found = arrays.map_symbols(table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint")), work, "doc_id bigint, mean_p double, brier double, cost_bits double", "doc_id")
    return found.select("doc_id", F.round("mean_p", 6).alias("mean_p"), F.round("brier", 6).alias("brier"), F.round("cost_bits", 4).alias("cost_bits"))


@query(
    "ema30_per_user",
    "A1 A11 ST4 ST1",
    f"""SELECT user_id, round(list_reduce(list_prepend(struct_pack(p := 0.5e0, n := 0), list(struct_pack(p := CASE WHEN event_type = 'click' THEN 1.0e0 ELSE 0.0e0 END, n := 0) ORDER BY ts, event_id)),
      lambda a, x: struct_pack(p := a.p + (x.p - a.p) / (a.n + 1), n := least(a.n + 1, {LIMIT - 1}))).p, 6) AS p FROM events GROUP BY user_id""",
)
def ema30_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A capped running estimate of a binary event for each user, exact as a fold."""
    hit = F.when(F.col("event_type") == "click", 1.0).otherwise(0.0)
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id", hit.alias("y")))).alias("s"))
    return own.select("user_id", F.round(capped_mean(F.transform("s", lambda x: x["y"])), 6).alias("p"))


sql(
    "bit_history",
    "A3 A13 A16",
    """WITH t AS (SELECT user_id, pos, CASE WHEN event_type = 'click' THEN 1 ELSE 0 END AS bit, lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) AS ctx FROM series),
    h AS (SELECT user_id, pos, bit, ctx, coalesce(lag(bit, 1) OVER w, 0) + 2 * coalesce(lag(bit, 2) OVER w, 0) + 4 * coalesce(lag(bit, 3) OVER w, 0) AS history FROM t WINDOW w AS (PARTITION BY user_id, ctx ORDER BY pos))
    SELECT history, count(*) AS n, round(avg(bit * 1.0e0), 6) AS p FROM h GROUP BY history""",
)
sql(
    "run_length_map",
    "A5 A14 ST7 G2a",
    """WITH s AS (SELECT user_id, pos, event_type, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END AS fresh FROM series), i AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY pos) AS island FROM s)
    SELECT user_id, cast(island AS bigint) AS island, min(event_type) AS event_type, least(count(*), 127) AS run FROM i GROUP BY user_id, island""",
)
sql(
    "run_context_map",
    "A14 A15 A17",
    """WITH t AS (SELECT doc_id, pos, lw, lag(lw) OVER (PARTITION BY doc_id ORDER BY pos) AS ctx FROM words), r AS (SELECT doc_id, pos, ctx, lw, lag(lw) OVER (PARTITION BY doc_id, ctx ORDER BY pos) AS last_next FROM t)
    SELECT doc_id, count(*) AS n, count(last_next) AS known, count(CASE WHEN last_next = lw THEN 1 END) AS right_guess FROM r GROUP BY doc_id""",
)


def automaton(bits: np.ndarray, cap: int = 40) -> np.ndarray:
    """A bounded (n0, n1, last) history of bits: the opposite count is discounted when a bit surprises it."""
    out = np.empty((len(bits), 3), np.int64)
    n0 = n1 = last = 0
    for k, b in enumerate(bits):
        if b:
            n1, n0 = min(n1 + 1, cap), n0 if n0 <= 2 else 2 + (n0 - 2) // 2
        else:
            n0, n1 = min(n0 + 1, cap), n1 if n1 <= 2 else 2 + (n1 - 2) // 2
        last = int(b)
        out[k] = n0, n1, last
    return out


@query("bit_history_automaton", "A4 A6 A7 M12 U4")
def bit_history_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Final automaton state and the mean cost of its predictions, per user."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        bits = (rows.sort_values(["ts", "event_id"])["event_type"] == "click").to_numpy()
        states = automaton(bits)
        before = np.vstack([[0, 0, 0], states[:-1]])
        p = (before[:, 1] + 0.4) / (before[:, 0] + before[:, 1] + 0.8)
        cost = -np.log2(np.where(bits, p, 1 - p)).mean()
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n0": [states[-1, 0]], "n1": [states[-1, 1]], "mean_cost": [round(float(cost), 6)]})

    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandas(run, "user_id long, n0 long, n1 long, mean_cost double")


sql(
    "bracket_close_rate",
    "A18",
    """WITH t AS (SELECT page_id, pos, name, is_end, lead(name, 1) OVER w AS n1, lead(is_end, 1) OVER w AS e1, lead(name, 2) OVER w AS n2, lead(is_end, 2) OVER w AS e2, lead(name, 3) OVER w AS n3, lead(is_end, 3) OVER w AS e3 FROM tags WHERE NOT is_void WINDOW w AS (PARTITION BY page_id ORDER BY pos))
    SELECT name, count(*) AS opened, round(avg(CASE WHEN n1 = name AND e1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS closed_1, round(avg(CASE WHEN n2 = name AND e2 THEN 1.0e0 ELSE 0.0e0 END), 6) AS closed_2, round(avg(CASE WHEN n3 = name AND e3 THEN 1.0e0 ELSE 0.0e0 END), 6) AS closed_3 FROM t WHERE NOT is_end GROUP BY name""",
)
sql(
    "interval_bisection",
    "A19 L8 L20",
    """WITH c AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY doc_id, b), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT c.doc_id, round(sum(CASE WHEN b >= 128 THEN n ELSE 0 END) / (max(total) * 1.0e0), 6) AS p_bit7, round(sum(CASE WHEN b BETWEEN 64 AND 127 THEN n ELSE 0 END) / (greatest(1, sum(CASE WHEN b < 128 THEN n ELSE 0 END)) * 1.0e0), 6) AS p_bit6,
      max(n * 1000 + (255 - b)) % 1000 AS top_code, max(n) AS top_n FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id""",
)


@query(
    "vocab_mask",
    "A20",
    """WITH v AS (SELECT doc_id, b FROM bytes GROUP BY doc_id, b), g AS (SELECT b, count(*) AS n, sum(count(*)) OVER () AS total FROM bytes GROUP BY b)
    SELECT doc_id, count(*) AS possible, round(sum(n) / (max(total) * 1.0e0), 6) AS mass, round(log2(max(total) / (sum(n) * 1.0e0)), 6) AS saved_bits FROM v JOIN g ON v.b = g.b GROUP BY doc_id""",
)
def vocab_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What share of all bytes are of values that a text has: all bytes are counted in blocks, and each text's values are one array."""

    def count(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        n = np.bincount(data, minlength=256)
        return {"b": np.flatnonzero(n), "n": n[n > 0]}

    def values(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        docs = len(first) - 1
        seen = np.zeros((docs, 256), bool)
        seen[arrays.owner(first), data] = True
        size = seen.sum(1)
        own = pa.array(np.nonzero(seen)[1].astype(np.int16))
        return {"doc_id": rows.column("doc_id"), "v": pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), own)}

    docs = arrays.documents(spark, sf_dir).where("text <> ''")
    every = arrays.map_bytes(docs, count, "b bigint, n bigint").groupBy("b").agg(F.sum("n").alias("n"))
    # one row: how many of each of the 256 values there are
    table256 = every.agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"), F.sum("n").alias("total")).select("total", F.transform(F.sequence(F.lit(0), F.lit(255)), lambda b: F.coalesce(F.element_at("m", b.cast("bigint")), F.lit(0).cast("bigint"))).alias("n"))
    own = arrays.map_bytes(docs, values, "doc_id bigint, v array<smallint>", "doc_id").groupBy("doc_id").agg(F.array_distinct(F.flatten(F.collect_list("v"))).alias("v"))
    found = own.crossJoin(F.broadcast(table256)).select("doc_id", F.size("v").cast("bigint").alias("possible"), "total", F.expr("aggregate(v, 0L, (s, b) -> s + n[b])").alias("s"))
    return found.select("doc_id", "possible", F.round(F.col("s") / F.col("total"), 6).alias("mass"), F.round(F.log2(F.col("total") / F.col("s")), 6).alias("saved_bits"))


sql(
    "lang_evidence_last64",
    "A22 T9 ST6",
    """WITH r AS (SELECT doc_id, pos, CASE WHEN lw IN ('the', 'of', 'and', 'to', 'in', 'is', 'it', 'that') THEN 1 ELSE 0 END AS en, CASE WHEN lw IN ('le', 'la', 'de', 'et', 'les', 'des', 'que', 'un') THEN 1 ELSE 0 END AS fr, CASE WHEN lw IN ('der', 'die', 'und', 'das', 'den', 'mit', 'von', 'zu') THEN 1 ELSE 0 END AS de FROM words),
    s AS (SELECT doc_id, pos, sum(en) OVER w AS en, sum(fr) OVER w AS fr, sum(de) OVER w AS de FROM r WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 63 PRECEDING AND CURRENT ROW))
    SELECT doc_id, cast(max(en) AS bigint) AS en, cast(max(fr) AS bigint) AS fr, cast(max(de) AS bigint) AS de, CASE WHEN greatest(max(en), max(fr), max(de)) < 4 THEN 'unknown' WHEN max(en) >= max(fr) AND max(en) >= max(de) THEN 'en' WHEN max(fr) >= max(de) THEN 'fr' ELSE 'de' END AS found FROM s GROUP BY doc_id""",
)
sql(
    "paragraph_counters",
    "A23 M17",
    """SELECT doc_id, line_no, cast(length(line) - length(replace(line, '.', '')) AS bigint) AS statements, cast(length(line) - length(replace(line, '?', '')) AS bigint) AS questions, cast(length(line) - length(replace(line, '!', '')) AS bigint) AS exclamations,
      cast(length(line) - length(replace(line, ' ', '')) + 1 AS bigint) AS words FROM lines""",
)
sql(
    "miss_rate_last8",
    "A24 T11",
    """WITH t AS (SELECT user_id, pos, CASE WHEN lag(event_type) OVER (PARTITION BY user_id ORDER BY pos) = event_type THEN 0 ELSE 1 END AS miss FROM series)
    SELECT user_id, pos, cast(sum(miss) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS bigint) AS misses, sum(miss) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) >= 6 AS failing FROM t""",
)
sql("sliding_windows", "ST6 ST4", "SELECT user_id, pos, round(avg(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 11 PRECEDING AND CURRENT ROW), 6) AS mean12, round(max(value) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 31 PRECEDING AND CURRENT ROW), 6) AS max32 FROM series")
sql("regression_slope", "A26", "SELECT user_id, round(regr_slope(value, cast(pos AS double)), 6) AS slope, round(regr_intercept(value, cast(pos AS double)), 4) AS intercept, count(*) AS n FROM series GROUP BY user_id")


def online_least_squares(values: np.ndarray, taps: int = 8, decay: float = 0.998, every: int = 4, ridge: float = 1e-3) -> np.ndarray:
    """Predictions of each value from the ``taps`` before it: covariances with decay, solved by Cholesky every few steps."""
    cov, cross, weights = np.eye(taps) * ridge, np.zeros(taps), np.zeros(taps)
    history, out = np.zeros(taps), np.zeros(len(values))
    for k, v in enumerate(values):
        out[k] = weights @ history
        cov = decay * cov + np.outer(history, history)
        cross = decay * cross + history * v
        if k % every == every - 1:
            root = np.linalg.cholesky(cov + ridge * np.eye(taps))
            weights = np.linalg.solve(root.T, np.linalg.solve(root, cross))
        history = np.roll(history, 1)
        history[0] = v
    return out


@query("online_ols_residual", "A26 A27 L23 G6 G7")
def online_ols_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean absolute error of online least squares on each user's series, beside that of the last value."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        v = rows.sort_values(["ts", "event_id"])["value"].to_numpy(float)
        error = np.abs(v - online_least_squares(v)).mean()
        last = np.abs(np.diff(v, prepend=0)).mean()
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(v)], "ols_error": [round(float(error), 6)], "last_error": [round(float(last), 6)]})

    return table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value").groupBy("user_id").applyInPandas(run, "user_id long, n long, ols_error double, last_error double")


sql("context_table_size", "J10 ST5", "SELECT event_type AS ctx, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
