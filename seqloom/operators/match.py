"""Matching: the last place where a context stood before, and what followed it there."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, table

ORDERS = (5, 7, 9)


def last_match(cp: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places with ``order`` symbols before them, and the last place after the same symbols in their text, or -1."""
    at, key = arrays.contexts(cp, first, order)
    return at, arrays.before(at, key, arrays.owner(first)[at])


def _ctx(n: int) -> str:
    return " || ".join(f"lag(ch, {k}) OVER w" for k in range(n, 0, -1))


CONTEXT = "SELECT doc_id, pos, ch, {c} AS ctx FROM symbols WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"


@query("match_last_occurrence", "J1 J2 A25 M23", f"WITH t AS ({CONTEXT.format(c=_ctx(5))}), m AS (SELECT doc_id, pos, ch, lag(pos) OVER v AS before, lag(ch) OVER v AS guess FROM t WHERE ctx IS NOT NULL WINDOW v AS (PARTITION BY doc_id, ctx ORDER BY pos)) SELECT doc_id, count(*) AS n, count(before) AS matched, count(CASE WHEN guess = ch THEN 1 END) AS hits, coalesce(max(pos - before), 0) AS farthest FROM m GROUP BY doc_id")
def match_last_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last place where the same five symbols stood, found inside the document's array: no shuffle."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        at, back = last_match(cp, first, 5)
        of, docs = arrays.owner(first)[at], len(first) - 1
        known = back >= 0
        hits = known & (cp[np.maximum(back, 0)] == cp[at])
        far = np.zeros(docs, np.int64)
        np.maximum.at(far, of[known], (at - back)[known])
        n = np.bincount(of, minlength=docs)
        on = n > 0
        columns = {"n": n, "matched": np.bincount(of[known], minlength=docs), "hits": np.bincount(of[hits], minlength=docs), "farthest": far}
        return {"doc_id": rows.column("doc_id").filter(pa.array(on))} | {k: v[on] for k, v in columns.items()}

    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrays.map_symbols(docs, work, "doc_id bigint, n bigint, matched bigint, hits bigint, farthest bigint", "doc_id")


sql(
    "match_hit_rate_by_length",
    "J1 J3 A25 L13",
    """WITH t AS (SELECT doc_id, pos, lw, lag(lw, 1) OVER w AS w1, lag(lw, 2) OVER w AS w2, lag(lw, 3) OVER w AS w3 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    m AS (SELECT doc_id, pos, lw, w1, w2, w3, lag(lw) OVER v1 AS g1, lag(w2) OVER v1 AS p2, lag(w3) OVER v1 AS p3 FROM t WINDOW v1 AS (PARTITION BY doc_id, w1 ORDER BY pos))
    SELECT CASE WHEN p2 = w2 AND p3 = w3 THEN 3 WHEN p2 = w2 THEN 2 ELSE 1 END AS match_len, count(*) AS n, round(avg(CASE WHEN g1 = lw THEN 1.0e0 ELSE 0.0e0 END), 6) AS hit_rate FROM m WHERE g1 IS NOT NULL GROUP BY 1""",
)


@query(
    "longest_prior_match",
    "J3 J5",
    "WITH "
    + ", ".join(f"m{k} AS (SELECT doc_id, pos, lag(pos) OVER (PARTITION BY doc_id, ctx ORDER BY pos) AS b{k} FROM ({CONTEXT.format(c=_ctx(k))}) AS c WHERE ctx IS NOT NULL)" for k in ORDERS)
    + " SELECT m5.doc_id, count(*) AS n, count(b9) AS by9, count(b7) AS by7, count(b5) AS by5, cast(coalesce(sum(m5.pos - coalesce(b9, b7, b5)), 0) AS bigint) AS distance FROM m5 LEFT JOIN m7 ON m5.doc_id = m7.doc_id AND m5.pos = m7.pos LEFT JOIN m9 ON m5.doc_id = m9.doc_id AND m5.pos = m9.pos GROUP BY m5.doc_id",
)
def longest_prior_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longest of three context lengths that stood before wins; three lookups in one pass over the array."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        docs, of = len(first) - 1, arrays.owner(first)
        best = np.full(len(cp), -1, np.int64)
        columns = {}
        for k in ORDERS:  # the longer overwrite the shorter
            at, back = last_match(cp, first, k)
            known = back >= 0
            best[at[known]] = back[known]
            columns[f"by{k}"] = np.bincount(of[at[known]], minlength=docs)
            if k == ORDERS[0]:
                n = np.bincount(of[at], minlength=docs)
        known = best >= 0
        distance = np.bincount(of[known], weights=(np.arange(len(cp)) - best)[known], minlength=docs).astype(np.int64)
        on = n > 0
        every = {"n": n} | {f"by{k}": columns[f"by{k}"] for k in reversed(ORDERS)} | {"distance": distance}
        return {"doc_id": rows.column("doc_id").filter(pa.array(on))} | {k: v[on] for k, v in every.items()}

    docs = table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return arrays.map_symbols(docs, work, "doc_id bigint, n bigint, by9 bigint, by7 bigint, by5 bigint, distance bigint", "doc_id")


sql(
    "sparse_match",
    "J4 J6",
    """WITH t AS (SELECT doc_id, pos, lw, lag(lw, 2) OVER w AS s2, lag(lw, 3) OVER w AS s3 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    m AS (SELECT doc_id, lw, lag(lw) OVER (PARTITION BY doc_id, s2, s3 ORDER BY pos) AS guess FROM t WHERE s3 IS NOT NULL) SELECT doc_id, count(*) AS n, count(guess) AS matched, count(CASE WHEN guess = lw THEN 1 END) AS hits FROM m GROUP BY doc_id""",
)
sql(
    "match_candidates",
    "J5",
    """WITH t AS (SELECT doc_id, pos, lw, lag(lw, 1) OVER w || ' ' || lag(lw, 2) OVER w AS ctx FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    m AS (SELECT doc_id, pos, lw, lag(lw, 1) OVER v AS g1, lag(lw, 2) OVER v AS g2, lag(lw, 3) OVER v AS g3, lag(lw, 4) OVER v AS g4 FROM t WHERE ctx IS NOT NULL WINDOW v AS (PARTITION BY doc_id, ctx ORDER BY pos))
    SELECT doc_id, count(g1) AS one, count(g2) AS two, count(g4) AS four, count(CASE WHEN g1 = lw THEN 1 END) AS first_right, count(CASE WHEN g1 <> lw AND (g2 = lw OR g3 = lw OR g4 = lw) THEN 1 END) AS recovered FROM m GROUP BY doc_id""",
)
sql(
    "cross_doc_match",
    "J1 J2",
    """WITH t AS (SELECT doc_id, pos, lag(lw, 4) OVER w || ' ' || lag(lw, 3) OVER w || ' ' || lag(lw, 2) OVER w || ' ' || lag(lw, 1) OVER w || ' ' || lw AS gram FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
    d AS (SELECT gram, count(DISTINCT doc_id) AS docs, count(*) AS n FROM t WHERE gram IS NOT NULL GROUP BY gram)
    SELECT t.doc_id, count(*) AS grams, count(CASE WHEN docs > 1 THEN 1 END) AS elsewhere, round(avg(CASE WHEN docs > 1 THEN 1.0e0 ELSE 0.0e0 END), 6) AS redundancy FROM t JOIN d ON t.gram = d.gram GROUP BY t.doc_id""",
    spark_text=# a gram is met once, with the least and greatest of its documents: those equal, it stands in no other; for translate see previous_words
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(lower(translate(text, 'İΣ', 'iσ')), "[A-Za-z'\\u0080-\\uffff-]+", 0) AS l FROM documents),
    g AS (SELECT doc_id, explode(CASE WHEN size(l) >= 5 THEN transform(sequence(1, size(l) - 4), i -> array_join(slice(l, i, 5), ' ')) END) AS gram FROM w),
    d AS (SELECT gram, min(doc_id) AS lo, max(doc_id) AS hi, count(*) AS n, count(doc_id) AS keyed FROM g GROUP BY gram),
    a AS (SELECT doc_id, sum(n) AS alone FROM (SELECT inline(array(struct(lo AS doc_id, keyed AS n), struct(cast(NULL AS bigint) AS doc_id, n - keyed AS n))) FROM d WHERE lo <=> hi) AS x WHERE n > 0 GROUP BY doc_id),
    t AS (SELECT doc_id, sum(cast(size(l) - 4 AS bigint)) AS grams FROM w WHERE size(l) >= 5 GROUP BY doc_id)
    SELECT t.doc_id, grams, grams - coalesce(alone, 0) AS elsewhere, round((grams - coalesce(alone, 0)) / grams, 6) AS redundancy FROM t LEFT JOIN a ON t.doc_id <=> a.doc_id""",
)
sql("event_match", "J1 L3", "WITH t AS (SELECT user_id, pos, event_type, lag(event_type, 1) OVER w || lag(event_type, 2) OVER w AS ctx FROM series WINDOW w AS (PARTITION BY user_id ORDER BY pos)), m AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id, ctx ORDER BY pos) AS guess FROM t WHERE ctx IS NOT NULL) SELECT user_id, count(*) AS n, count(guess) AS known, count(CASE WHEN guess = event_type THEN 1 END) AS hits FROM m GROUP BY user_id")
