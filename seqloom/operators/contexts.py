"""Context features: n-gram, sparse, indirect, interval, bracket, column, word, distance and recency contexts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql, table, views

LAGS = "SELECT doc_id, pos, ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2, lag(ch, 3) OVER w AS c3 FROM symbols WINDOW w AS (PARTITION BY doc_id ORDER BY pos)"


def preceding(docs: DataFrame, order: int) -> DataFrame:
    """(doc_id, pos, ch, ctx): each symbol and the ``order`` before it, taken from the text itself without a window."""
    symbols = docs.select("doc_id", F.filter(F.split("text", ""), lambda x: x != "").alias("s"))
    # the array beside itself, moved by one to ``order`` places: no lambda, and no row that carries its document
    moved = [F.concat(F.array_repeat(F.lit(None).cast("string"), k), "s").alias(f"c{k}") for k in range(order, 0, -1)]
    beside = symbols.select("doc_id", "s", *moved)
    each = beside.select("doc_id", F.posexplode(F.arrays_zip("s", *[f"c{k}" for k in range(order, 0, -1)])).alias("pos", "x"))
    own = each.select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("x.s").alias("ch"), F.concat(*[F.col(f"x.c{k}") for k in range(order, 0, -1)]).alias("ctx"))
    return own.where("ctx is not null and ch is not null")


@query("order2_counts", "X1 X7 X9 X12 X25 A15 L4 U3", "SELECT c2 || c1 AS ctx, ch, count(*) AS n FROM (SELECT ch, lag(ch, 1) OVER w AS c1, lag(ch, 2) OVER w AS c2 FROM symbols WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) AS t WHERE c2 IS NOT NULL GROUP BY c2 || c1, ch")
def order2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each two symbols: blocks of documents are counted as arrays, and the counts summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        own, place = arrays.shown(cp), np.arange(len(cp)) - np.repeat(first[:-1], np.diff(first))
        at = np.flatnonzero(place >= 2)
        (c2, c1, ch), n = arrays.counted([own[at - 2], own[at - 1], own[at]])
        return {k: arrays.symbols_of(v) for k, v in (("c2", c2), ("c1", c1), ("ch", ch))} | {"n": n}

    each = arrays.map_symbols(table(spark, sf_dir, "documents"), work, "c2 string, c1 string, ch string, n bigint")
    return each.groupBy(F.concat("c2", "c1").alias("ctx"), "ch").agg(F.sum("n").alias("n"))


@query("sparse_context", "X2 X15", f"SELECT c1, c3, count(*) AS n, count(DISTINCT ch) AS next_symbols FROM ({LAGS}) AS t WHERE c3 IS NOT NULL GROUP BY c1, c3")
def sparse_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows the symbols one and three before: blocks are counted as arrays, and the counts summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        own, at = arrays.shown(cp), np.flatnonzero(arrays.places(first) >= 3)
        (c1, c3, ch), n = arrays.counted([own[at - 1], own[at - 3], own[at]])
        return {k: arrays.symbols_of(v) for k, v in (("c1", c1), ("c3", c3), ("ch", ch))} | {"n": n}

    each = arrays.map_symbols(table(spark, sf_dir, "documents"), work, "c1 string, c3 string, ch string, n bigint")
    return each.groupBy("c1", "c3", "ch").agg(F.sum("n").alias("n")).groupBy("c1", "c3").agg(F.sum("n").alias("n"), F.count("*").alias("next_symbols"))


@query(
    "indirect_context",
    "X3 X16 X17 L3 M8",
    f"""WITH t AS ({LAGS}), i AS (SELECT doc_id, pos, ch, c1, lag(ch, 1) OVER v AS after1, lag(ch, 2) OVER v AS after2 FROM t WINDOW v AS (PARTITION BY doc_id, c1 ORDER BY pos))
    SELECT doc_id, count(*) AS n, count(CASE WHEN after1 = ch THEN 1 END) AS agrees1, count(CASE WHEN after1 = ch AND after2 = ch THEN 1 END) AS agrees2, count(CASE WHEN after1 IS NULL THEN 1 END) AS fresh FROM i GROUP BY doc_id""",
)
def indirect_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What followed a symbol the last two times in its text, found by sorting a block's places by the symbol before."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        of, docs = arrays.owner(first), len(first) - 1
        context = np.zeros(len(cp), np.int64)
        context[1:] = cp[:-1].astype(np.int64) + 1
        context[arrays.places(first) == 0] = 0
        order = np.argsort(context, kind="stable")  # then by text, then by place
        own, key, text = cp[order], context[order], of[order]
        known, agrees1, agrees2 = (np.zeros(len(cp), bool) for _ in range(3))
        known[1:] = (key[1:] == key[:-1]) & (text[1:] == text[:-1])
        agrees1[1:] = known[1:] & (own[1:] == own[:-1])
        agrees2[2:] = agrees1[2:] & known[1:-1] & (own[2:] == own[:-2])
        count = lambda on: np.bincount(text[on], minlength=docs)
        n = np.diff(first)
        return arrays.per_text(rows, n > 0, n=n, agrees1=count(agrees1), agrees2=count(agrees2), fresh=count(~known))

    each = arrays.map_symbols(arrays.documents(spark, sf_dir), work, "doc_id bigint, n bigint, agrees1 bigint, agrees2 bigint, fresh bigint", "doc_id")
    return each.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("n", "agrees1", "agrees2", "fresh")])


CLASS2 = "CASE WHEN lower(ch) IN ('a', 'e', 'i', 'o', 'u') THEN 'v' WHEN lower(ch) BETWEEN 'a' AND 'z' THEN 'c' WHEN ch BETWEEN '0' AND '9' THEN 'd' WHEN cp <= 32 THEN 's' WHEN cp < 128 THEN 'p' ELSE 'h' END"


@query(
    "interval_context",
    "X4 X5 F15",
    f"""WITH t AS (SELECT doc_id, pos, ch, {CLASS2} AS k FROM symbols), l AS (SELECT ch, lag(k, 3) OVER w || lag(k, 2) OVER w || lag(k, 1) OVER w AS ctx FROM t WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
    SELECT ctx, ch, count(*) AS n FROM l WHERE ctx IS NOT NULL GROUP BY ctx, ch""",
)
def interval_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What follows each three classes of symbols: blocks are counted as arrays, and the counts summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        own, k, at = arrays.shown(cp), class2(cp).astype(np.int64), np.flatnonzero(arrays.places(first) >= 3)
        (trail, ch), n = arrays.counted([k[at - 3] * 36 + k[at - 2] * 6 + k[at - 1], own[at]])
        return {"ctx": pa.array(TRAILS).take(pa.array(trail)), "ch": arrays.symbols_of(ch), "n": n}

    each = arrays.map_symbols(table(spark, sf_dir, "documents"), work, "ctx string, ch string, n bigint")
    return each.groupBy("ctx", "ch").agg(F.sum("n").alias("n"))


KINDS = "vcdsph"
TRAILS = [a + b + c for a in KINDS for b in KINDS for c in KINDS]
STOPS = np.frombuffer(b".,;:!?", np.uint8)


def class2(cp: np.ndarray) -> np.ndarray:
    """What ``CLASS2`` says of code points, as indices of ``KINDS``; the two letters beyond ASCII are those whose lower case is within it."""
    letter = ((cp | 32) >= 97) & ((cp | 32) <= 122)
    out = np.select([np.isin(cp | 32, np.frombuffer(b"aeiou", np.uint8)) & letter, letter, (cp >= 48) & (cp <= 57), cp <= 32, cp < 128], [0, 1, 2, 3, 4], 5)
    out[cp == 0x130], out[cp == 0x212A] = 0, 1
    return out.astype(np.uint8)


DEPTH = "CASE WHEN ch IN ('(', '[', '{', '<') THEN 1 WHEN ch IN (')', ']', '}', '>') THEN -1 ELSE 0 END"
sql(
    "bracket_depth",
    "X6 X18",
    f"""WITH s AS (SELECT page_id, pos, CASE WHEN is_void THEN 0 WHEN is_end THEN -1 ELSE 1 END AS d FROM tags), r AS (SELECT page_id, pos, sum(d) OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM s)
    SELECT page_id, cast(max(depth) AS bigint) AS deepest, cast(min(depth) AS bigint) AS lowest, count(*) AS n FROM r GROUP BY page_id""",
)


@query(
    "column_since_newline",
    "X10",
    "SELECT doc_id, least(col, 99) AS col, count(*) AS n FROM (SELECT doc_id, pos - coalesce(max(CASE WHEN cp = 10 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) - 1 AS col FROM symbols) AS t GROUP BY doc_id, least(col, 99)",
)
def column_since_newline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns of each text's symbols, counted where the text is read."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        col = arrays.places(first) - arrays.last_before(cp == 10, first) - 1
        (of, col), n = arrays.counted([arrays.owner(first), np.minimum(col, 99)])
        return {"doc_id": rows.column("doc_id").take(pa.array(of)), "col": col, "n": n}

    each = arrays.map_symbols(arrays.documents(spark, sf_dir), work, "doc_id bigint, col bigint, n bigint", "doc_id")
    return each.groupBy("doc_id", "col").agg(F.sum("n").alias("n"))


sql(
    "previous_words",
    "X11 X19 M9 J2 L2",
    "SELECT w2, w1, lw, count(*) AS n FROM (SELECT lw, lag(lw, 1) OVER w AS w1, lag(lw, 2) OVER w AS w2 FROM words WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) AS t WHERE w2 IS NOT NULL GROUP BY w2, w1, lw",
    spark_text=# the array of words beside itself: no window over a document's words, and one string to group by; two letters whose lower case here would be more than that letter's alone
    r"""WITH w AS (SELECT regexp_extract_all(lower(translate(text, 'İΣ', 'iσ')), "[A-Za-z'\\u0080-\\uffff-]+", 0) AS l FROM documents),
    t AS (SELECT inline(arrays_zip(slice(l, 1, greatest(size(l) - 2, 0)), slice(l, 2, greatest(size(l) - 2, 0)), slice(l, 3, greatest(size(l) - 2, 0)))) AS (w2, w1, lw) FROM w)
    SELECT split_part(gram, ' ', 1) AS w2, split_part(gram, ' ', 2) AS w1, split_part(gram, ' ', 3) AS lw, n FROM (SELECT gram, count(*) AS n FROM (SELECT w2 || ' ' || w1 || ' ' || lw AS gram FROM t) AS g GROUP BY gram) AS c""",
)


@query(
    "distance_to_marks",
    "X14 T11",
    """SELECT doc_id, cast(sum(least(to_space, 255)) AS bigint) AS space_distance, cast(sum(least(to_line, 255)) AS bigint) AS line_distance, cast(sum(least(to_upper, 255)) AS bigint) AS upper_distance, max(least(to_punct, 255)) AS punct_distance FROM (
      SELECT doc_id, pos - coalesce(max(CASE WHEN cp = 32 THEN pos END) OVER w, 0) AS to_space, pos - coalesce(max(CASE WHEN cp = 10 THEN pos END) OVER w, 0) AS to_line, pos - coalesce(max(CASE WHEN ch BETWEEN 'A' AND 'Z' THEN pos END) OVER w, 0) AS to_upper,
        pos - coalesce(max(CASE WHEN ch IN ('.', ',', ';', ':', '!', '?') THEN pos END) OVER w, 0) AS to_punct FROM symbols WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) AS t GROUP BY doc_id""",
)
def distance_to_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each symbol is from the last space, line, capital and stop before it; no row for a symbol."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        place, n = arrays.places(first), np.diff(first)
        far = lambda marked: np.minimum(place - np.maximum(arrays.last_before(marked, first), 0), 255)
        total = {name: arrays.sums(far(marked), first).astype(np.int64) for name, marked in (("space_distance", cp == 32), ("line_distance", cp == 10), ("upper_distance", (cp >= 65) & (cp <= 90)))}
        punct = np.zeros(len(n), np.int64)
        punct[n > 0] = np.maximum.reduceat(far(np.isin(cp, STOPS)), first[:-1][n > 0]) if len(cp) else 0
        return arrays.per_text(rows, n > 0, **total, punct_distance=punct)

    each = arrays.map_symbols(arrays.documents(spark, sf_dir), work, "doc_id bigint, space_distance bigint, line_distance bigint, upper_distance bigint, punct_distance bigint", "doc_id")
    return each.groupBy("doc_id").agg(*[F.sum(k).alias(k) for k in ("space_distance", "line_distance", "upper_distance")], F.max("punct_distance").alias("punct_distance"))


@query("masked_contexts", "X15 J4", "SELECT cast(floor(c1 / 16) AS bigint) AS high1, cast(floor(c2 / 16) AS bigint) AS high2, b % 16 AS low, count(*) AS n FROM (SELECT b, lag(b, 1) OVER w AS c1, lag(b, 2) OVER w AS c2 FROM bytes WINDOW w AS (PARTITION BY doc_id ORDER BY pos, k)) AS t WHERE c2 IS NOT NULL GROUP BY 1, 2, 3")
def masked_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low halves of bytes by the high halves of the two before: blocks are counted as arrays, and the counts summed."""

    def work(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        at, b = np.flatnonzero(arrays.places(first) >= 2), data.astype(np.int64)
        (high1, high2, low), n = arrays.counted([b[at - 1] >> 4, b[at - 2] >> 4, b[at] & 15])
        return {"high1": high1, "high2": high2, "low": low, "n": n}

    each = arrays.map_bytes(table(spark, sf_dir, "documents"), work, "high1 bigint, high2 bigint, low bigint, n bigint")
    return each.groupBy("high1", "high2", "low").agg(F.sum("n").alias("n"))


@query(
    "byte_above",
    "X20 J9 M20",
    """WITH g AS (SELECT doc_id, line_no, col, ch FROM (SELECT doc_id, pos, ch, cp, coalesce(sum(CASE WHEN cp = 10 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS line_no,
      pos - coalesce(max(CASE WHEN cp = 10 THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS col FROM symbols) AS t WHERE cp <> 10)
    SELECT a.doc_id, count(*) AS pairs, count(CASE WHEN a.ch = b.ch THEN 1 END) AS same FROM g a JOIN g b ON a.doc_id = b.doc_id AND a.line_no = b.line_no + 1 AND a.col = b.col GROUP BY a.doc_id""",
)
def byte_above(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols that stand under one of the line before, and those equal to it: an index into the block's array, no join."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        of, docs, begins = arrays.owner(first), len(first) - 1, arrays.places(first) == 0
        begins[1:] |= cp[:-1] == 10
        line, starts = np.cumsum(begins) - 1, np.flatnonzero(begins)
        size = np.bincount(line[cp != 10], minlength=len(starts))
        at = np.flatnonzero((cp != 10) & (line > 0))
        above, col = line[at] - 1, at - starts[line[at]]
        on = (of[starts[above]] == of[at]) & (col < size[above])
        at, up = at[on], starts[above[on]] + col[on]
        pairs = np.bincount(of[at], minlength=docs)
        return arrays.per_text(rows, pairs > 0, pairs=pairs, same=np.bincount(of[at[cp[at] == cp[up]]], minlength=docs))

    each = arrays.map_symbols(arrays.documents(spark, sf_dir).where("doc_id is not null"), work, "doc_id bigint, pairs bigint, same bigint", "doc_id")
    return each.groupBy("doc_id").agg(F.sum("pairs").alias("pairs"), F.sum("same").alias("same"))


sql(
    "cell_above",
    "X22 M20",
    """WITH c AS (SELECT doc_id, line_no, i, cell FROM (SELECT doc_id, line_no, unnest(string_split(line, ' | ')) AS cell, unnest(range(0, len(string_split(line, ' | ')))) AS i FROM lines WHERE line LIKE '% | %') AS t)
    SELECT a.doc_id, count(*) AS cells, count(CASE WHEN length(a.cell) = length(b.cell) THEN 1 END) AS same_width, count(CASE WHEN substr(a.cell, 1, 1) = substr(b.cell, 1, 1) THEN 1 END) AS same_first FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.line_no = b.line_no + 1 AND a.i = b.i GROUP BY a.doc_id""",
    spark_text="""WITH c AS (SELECT doc_id, line_no, i, cell FROM lines LATERAL VIEW posexplode(split(line, ' [|] ')) AS i, cell WHERE line LIKE '% | %')
    SELECT a.doc_id, count(*) AS cells, count(CASE WHEN length(a.cell) = length(b.cell) THEN 1 END) AS same_width, count(CASE WHEN substr(a.cell, 1, 1) = substr(b.cell, 1, 1) THEN 1 END) AS same_first FROM c a JOIN c b ON a.doc_id = b.doc_id AND a.line_no = b.line_no + 1 AND a.i = b.i GROUP BY a.doc_id""",
)


@query(
    "class_stream_collapsed",
    "X23 F15",
    f"""WITH t AS (SELECT doc_id, pos, {CLASS2} AS k FROM symbols), c AS (SELECT doc_id, pos, k FROM (SELECT doc_id, pos, k, lag(k) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM t) AS u WHERE before IS NULL OR before <> k)
    SELECT a.k2 || a.k1 || a.k AS trail, count(*) AS n FROM (SELECT k, lag(k, 1) OVER w AS k1, lag(k, 2) OVER w AS k2 FROM c WINDOW w AS (PARTITION BY doc_id ORDER BY pos)) AS a WHERE k2 IS NOT NULL GROUP BY a.k2 || a.k1 || a.k""",
)
def class_stream_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes in a row are one; each three that follow each other are counted in blocks, and the counts summed."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        k, of, fresh = class2(cp).astype(np.int64), arrays.owner(first), arrays.places(first) == 0
        fresh[1:] |= k[1:] != k[:-1]
        k, of = k[fresh], of[fresh]
        (trail,), n = arrays.counted([(k[:-2] * 36 + k[1:-1] * 6 + k[2:])[of[:-2] == of[2:]]])
        return {"trail": pa.array(TRAILS).take(pa.array(trail)), "n": n}

    each = arrays.map_symbols(table(spark, sf_dir, "documents"), work, "trail string, n bigint")
    return each.groupBy("trail").agg(F.sum("n").alias("n"))


sql("scope_flags", "X24 S8", "WITH t AS (SELECT page_id, pos, name, is_end, sum(CASE WHEN name = 'p' AND NOT is_end THEN 1 WHEN name = 'p' AND is_end THEN -1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS in_p, sum(CASE WHEN name = 'nav' THEN CASE WHEN is_end THEN -1 ELSE 1 END ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS in_nav FROM tags) SELECT page_id, count(CASE WHEN in_p > 0 THEN 1 END) AS inside_p, count(CASE WHEN in_nav > 0 THEN 1 END) AS inside_nav, count(*) AS n FROM t GROUP BY page_id")
sql(
    "topic_words",
    "X26",
    """WITH t AS (SELECT doc_id, pos, tok, kind, lead(tok) OVER (PARTITION BY doc_id ORDER BY pos) AS after FROM tokens)
    SELECT doc_id, min_by(tok, pos) FILTER (WHERE kind = 'word') AS first_word, max_by(tok, pos) FILTER (WHERE kind = 'word' AND after IN (':', '|', '.')) AS last_before_stop, max_by(tok, pos) FILTER (WHERE kind = 'word' AND tok <> lower(tok)) AS last_capital FROM t GROUP BY doc_id""",
)
sql("word_recency", "X27 A21", "SELECT lw, count(*) AS n, min(gap) AS least, max(gap) AS most, round(avg(gap), 6) AS mean FROM (SELECT lw, pos - lag(pos) OVER (PARTITION BY doc_id, lw ORDER BY pos) AS gap FROM words) AS t WHERE gap IS NOT NULL GROUP BY lw")
sql("alphabetic_runs", "X28 X1", f"WITH s AS (SELECT doc_id, pos, CASE WHEN {CLASS2} IN ('v', 'c') THEN 0 ELSE 1 END AS breaks FROM symbols), i AS (SELECT *, sum(breaks) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s) SELECT doc_id, least(n, 15) AS run, count(*) AS runs FROM (SELECT doc_id, island, count(*) AS n FROM i WHERE breaks = 0 GROUP BY doc_id, island) AS t GROUP BY doc_id, least(n, 15)")


@query("bit_contexts", "X8 X13 M5 M6 ST2", """SELECT doc_id, bit_no, partial, count(*) AS n, cast(sum(bit) AS bigint) AS ones FROM (SELECT doc_id, j AS bit_no, cast(floor(b / {p8j}) AS bigint) + {p2j} AS partial, cast(floor(b / {p7j}) AS bigint) % 2 AS bit FROM bytes, (SELECT unnest(range(0, 8)) AS j) AS js) AS t GROUP BY doc_id, bit_no, partial""".format(p8j="power(2, 8 - j)", p7j="power(2, 7 - j)", p2j="cast(power(2, j) AS bigint)"))
def bit_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ones among the bits of each text's bytes by the bits before in the byte, from a count of its bytes."""

    def work(rows: pa.RecordBatch, data: np.ndarray, first: np.ndarray) -> dict:
        docs, out = len(first) - 1, []
        counts = np.bincount(arrays.owner(first) * 256 + data, minlength=256 * docs)
        for j in range(8):
            by_bit = counts.reshape(docs, 1 << j, 2, -1).sum(3)
            of, prefix = np.nonzero(by_bit.sum(2))
            out.append((of, np.full(len(of), j), prefix + (1 << j), by_bit[of, prefix].sum(1), by_bit[of, prefix, 1]))
        of, *columns = (np.concatenate(x) for x in zip(*out))
        return {"doc_id": rows.column("doc_id").take(pa.array(of))} | dict(zip(("bit_no", "partial", "n", "ones"), columns))

    each = arrays.map_bytes(arrays.documents(spark, sf_dir), work, "doc_id bigint, bit_no bigint, partial bigint, n bigint, ones bigint", "doc_id")
    return each.groupBy("doc_id", "bit_no", "partial").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))


@query("bracket_stack", "X6 X21")
def bracket_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The innermost open tag by a fold with a stack that ends pop if they match: pages by deepest stack and unclosed tags."""
    views(spark, sf_dir, "FROM tags")
    rows = spark.table("tags").where("NOT is_void").groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("pos", "name", "is_end"))).alias("t"))
    fold = """aggregate(t, named_struct('stack', cast(array() AS array<string>), 'deepest', 0, 'unmatched', 0L), (s, x) -> CASE
      WHEN NOT x.is_end THEN named_struct('stack', concat(array(x.name), s.stack), 'deepest', greatest(s.deepest, size(s.stack) + 1), 'unmatched', s.unmatched)
      WHEN array_position(s.stack, x.name) > 0 THEN named_struct('stack', slice(s.stack, cast(array_position(s.stack, x.name) + 1 AS int), greatest(size(s.stack), 1)), 'deepest', s.deepest, 'unmatched', s.unmatched + array_position(s.stack, x.name) - 1)
      ELSE named_struct('stack', s.stack, 'deepest', s.deepest, 'unmatched', s.unmatched + 1) END)"""
    return rows.select("page_id", F.expr(fold).alias("s")).select("page_id", F.col("s.deepest").cast("bigint").alias("deepest"), F.col("s.unmatched").alias("unmatched"), F.size("s.stack").cast("bigint").alias("left_open"))
