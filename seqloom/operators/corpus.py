"""Corpus operators: dumps split into articles, renumbered, reordered, packed and restored.

A dump here is made of the documents of each source: a page, its title, id, time
stamp, contributor, text lines and closing tags.  A source is a file; a running
number over it is taken in two steps (inside blocks of documents, then over blocks),
so no window holds a whole file's lines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.plans.registry import query, sql, table

BLOCK = 1000  # document ids of a block


def running_number(rows: DataFrame, file: str | list[str], key: str, flag: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with ``number``: the running sum of ``flag`` over (file, key), in two steps."""
    file = [file] if isinstance(file, str) else file
    own = rows.withColumn("block", F.floor(F.col(key) / block))
    inside = W.partitionBy(*file, "block").orderBy(key).rowsBetween(W.unboundedPreceding, 0)
    totals = own.groupBy(*file, "block").agg(F.sum(flag).alias("total"))
    before = W.partitionBy(*file).orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(*file, "block", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("offset"))
    return own.withColumn("here", F.sum(flag).over(inside)).join(offsets, [*file, "block"]).withColumn("number", (F.col("here") + F.col("offset")).cast("bigint")).drop("here", "offset", "block")


def ranked(rows: DataFrame, file: str, value: str, key: str) -> DataFrame:
    """``rows`` with ``pos``: their place in a file, the greater values first, then by key.

    The values of a file are counted, so that a window holds its distinct values only; rows
    of one value are numbered in blocks of keys.
    """
    counts = rows.groupBy(file, value).agg(F.count("*").alias("n"))
    above = W.partitionBy(file).orderBy(F.desc(value)).rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select(file, value, F.coalesce(F.sum("n").over(above), F.lit(0)).alias("above"))
    numbered = running_number(rows.withColumn("one", F.lit(1).cast("bigint")), [file, value], key, "one").drop("one")
    return numbered.join(offsets, [file, value]).withColumn("pos", (F.col("above") + F.col("number")).cast("bigint")).drop("above", "number")


def split_parts(lines: DataFrame, head: int, tail: int) -> DataFrame:
    """intro, main or coda of each line by its number in the document."""
    n = F.count("*").over(W.partitionBy("doc_id"))
    return lines.withColumn("part", F.when(F.col("line_no") < head, "intro").when(F.col("line_no") >= n - tail, "coda").otherwise("main"))


@query("split_three_ways", "C1 IO17", "WITH t AS (SELECT doc_id, line_no, line, count(*) OVER (PARTITION BY doc_id) AS n FROM lines) SELECT doc_id, CASE WHEN line_no < 2 THEN 'intro' WHEN line_no >= n - 2 THEN 'coda' ELSE 'main' END AS part, count(*) AS n, cast(sum(length(line)) AS bigint) AS chars FROM t GROUP BY 1, 2")
def split_three_ways(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return split_parts(lines, 2, 2).groupBy("doc_id", "part").agg(F.count("*").alias("n"), F.sum(F.length("line")).cast("bigint").alias("chars"))


REDIRECT = "(text LIKE 'The %' OR text LIKE 'Of %' OR text LIKE 'De %' OR text LIKE 'Der %' OR text LIKE 'To %')"
DUMP = """dump AS (SELECT source, doc_id, line_no, line FROM (
  SELECT source, doc_id, 0 AS line_no, '  <page>' AS line FROM documents UNION ALL SELECT source, doc_id, 1, '    <title>' || lang || ' ' || source || '</title>' FROM documents
  UNION ALL SELECT source, doc_id, 2, '    <id>' || cast(doc_id AS {string}) || '</id>' FROM documents UNION ALL SELECT source, doc_id, 1000000000, '  </page>' FROM documents
  UNION ALL SELECT documents.source, lines.doc_id, line_no + 3, line FROM lines JOIN documents ON lines.doc_id = documents.doc_id) AS u)"""
PARSE = """ SELECT source, doc_id, min(line_no) AS first_line, count(*) AS n_lines, min(CASE WHEN line LIKE '    <id>%' THEN cast({extract} AS bigint) END) AS id, max(CASE WHEN line LIKE '    <title>%' THEN {title} END) AS title FROM dump GROUP BY source, doc_id"""
sql(
    "article_split",
    "C2 C3 M15",
    "WITH " + DUMP.format(string="VARCHAR") + PARSE.format(extract="regexp_extract(line, '<id>([0-9]+)<', 1)", title="regexp_extract(line, '<title>(.*)</title>', 1)"),
    spark_text="WITH " + DUMP.format(string="STRING") + PARSE.format(extract="nullif(regexp_extract(line, '<id>([0-9]+)<', 1), '')", title="regexp_extract(line, '<title>(.*)</title>', 1)"),
)


@query("dense_renumber", "C4 C5 IO18", f"SELECT source, doc_id, {REDIRECT} AS redirect, cast(sum(CASE WHEN {REDIRECT} THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY doc_id) AS bigint) AS article_no, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page_no FROM documents")
def dense_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of a source by number, and articles that aren't redirects by a number of their own."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.expr(REDIRECT).alias("redirect"))
    docs = docs.withColumn("is_article", (~F.col("redirect")).cast("bigint")).withColumn("one", F.lit(1).cast("bigint"))
    articles = running_number(docs, "source", "doc_id", "is_article").withColumnRenamed("number", "article_no")
    pages = running_number(docs.select("source", "doc_id", "one"), "source", "doc_id", "one").select("source", "doc_id", F.col("number").alias("page_no"))
    return articles.join(pages, ["source", "doc_id"]).select("source", "doc_id", "redirect", "article_no", "page_no")


# The order: documents by length, those of a length that seven divides left out of the order file.
ORDER = "SELECT doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS pos FROM documents WHERE n_chars % 7 <> 0"


def in_order(docs: DataFrame) -> DataFrame:
    """The rows that the order file has, with their place in it."""
    return ranked(docs.where("n_chars % 7 <> 0"), "source", "n_chars", "doc_id")


@query("reorder_apply", "C6 C10 J8", f"WITH o AS ({ORDER}) SELECT d.source, d.doc_id, cast(o.pos AS bigint) AS pos, md5(d.text) AS digest FROM documents d JOIN o ON d.doc_id = o.doc_id")
def reorder_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places by length and id; the digest travels with its row."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars", F.md5("text").alias("digest"))
    return in_order(docs).select("source", "doc_id", "pos", "digest")


@query("antijoin_append", "C7 J8", f"WITH o AS ({ORDER}), rest AS (SELECT d.source, d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.doc_id = d.doc_id)) SELECT source, doc_id, cast(1000000000 + row_number() OVER (PARTITION BY source ORDER BY doc_id) AS bigint) AS pos FROM rest")
def antijoin_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the order file doesn't mention, numbered by id in blocks."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", "n_chars")
    rest = docs.join(docs.where("n_chars % 7 <> 0").select("doc_id"), "doc_id", "left_anti").withColumn("one", F.lit(1).cast("bigint"))
    return running_number(rest, "source", "doc_id", "one").select("source", "doc_id", (F.col("number") + 1000000000).alias("pos"))


@query("materialise_order", "C8 C9 C11", f"WITH o AS ({ORDER}), every AS (SELECT d.doc_id, coalesce(o.pos, 1000000000 + d.doc_id) AS pos FROM documents d LEFT JOIN o ON d.doc_id = o.doc_id) SELECT lines.doc_id, cast(pos AS bigint) AS pos, line_no, md5(line) AS digest FROM lines JOIN every ON lines.doc_id = every.doc_id")
def materialise_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of every document with its place: lines are digested where they are read, then meet the places."""
    docs = table(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.transform(F.split("text", "\n"), F.md5).alias("l")).where("l is not null")
    places = in_order(docs.select("source", "doc_id", "n_chars")).select("doc_id", "pos")
    every = lines.join(places, "doc_id", "left")
    return every.select("doc_id", F.coalesce("pos", F.col("doc_id") + 1000000000).cast("bigint").alias("pos"), F.posexplode("l").alias("line_no", "digest")).withColumn("line_no", F.col("line_no").cast("bigint"))


@query("restore_order", "C9", "WITH p AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY coalesce(n_chars, -1) DESC, doc_id) AS pos FROM documents), b AS (SELECT source, doc_id, pos, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS back FROM p) SELECT source, count(*) AS n, count(CASE WHEN pos <> back THEN 1 END) AS displaced, max(abs(pos - back)) AS farthest, cast(sum(pos * back) AS bigint) AS moment FROM b GROUP BY source")
def restore_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file put in order of length and back in order of id: how many rows that moves, and how far."""
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.coalesce("n_chars", F.lit(-1)).alias("n_chars"))
    placed = ranked(docs, "source", "n_chars", "doc_id").withColumn("one", F.lit(1).cast("bigint"))
    back = running_number(placed, "source", "doc_id", "one").withColumnRenamed("number", "back")
    far = F.abs(F.col("pos") - F.col("back"))
    return back.groupBy("source").agg(F.count("*").alias("n"), F.count(F.when(far > 0, 1)).alias("displaced"), F.max(far).alias("farthest"), F.sum(F.col("pos") * F.col("back")).cast("bigint").alias("moment"))


sql("concat_files", "C11 C22", "SELECT ordinal, count(*) AS items, cast(sum(size) AS bigint) AS size FROM (SELECT 0 AS ordinal, length(text) AS size FROM documents UNION ALL SELECT 1, length(html) FROM pages UNION ALL SELECT 2, length(text) FROM conversations) AS u GROUP BY ordinal")
sql(
    "header_stream_split",
    "C12 M16",
    """WITH t AS (SELECT conv_id, turn, role, text, max(CASE WHEN role = 'user' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS opened,
      max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn, role ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS closed FROM conversations)
    SELECT conv_id, CASE WHEN opened IS NOT NULL AND (closed IS NULL OR closed < opened) THEN 'side' ELSE 'main' END AS stream, count(*) AS turns, cast(sum(length(text)) AS bigint) AS chars FROM t GROUP BY 1, 2""",
)


@query("id_delta", "C13", "WITH d AS (SELECT source, doc_id, doc_id - coalesce(lag(doc_id) OVER (PARTITION BY source ORDER BY doc_id), 0) AS delta FROM documents) SELECT source, doc_id, delta, cast(sum(delta) OVER (PARTITION BY source ORDER BY doc_id) AS bigint) AS restored FROM d")
def id_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences of rising ids, and the ids again by a running sum, both in two steps.

    The first id of a block follows the last one of the block before.
    """
    docs = table(spark, sf_dir, "documents").select("source", "doc_id").withColumn("block", F.floor(F.col("doc_id") / BLOCK))
    lasts = docs.groupBy("source", "block").agg(F.max("doc_id").alias("last"))
    before = lasts.select("source", "block", F.lag("last").over(W.partitionBy("source").orderBy("block")).alias("last"))
    inside = F.lag("doc_id").over(W.partitionBy("source", "block").orderBy("doc_id"))
    own = docs.withColumn("inside", inside).join(before, ["source", "block"])
    delta = own.select("source", "doc_id", (F.col("doc_id") - F.coalesce("inside", "last", F.lit(0))).alias("delta"))
    return running_number(delta, "source", "doc_id", "delta").select("source", "doc_id", "delta", F.col("number").alias("restored"))


PACK = "SELECT event_id, cast(year(ts) - 2001 AS bigint) AS yy, cast(month(ts) * 31 + day(ts) - 32 AS bigint) AS md, cast(hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS bigint) AS sec, cast(floor((month(ts) * 31 + day(ts) - 32) / 31) + 1 AS bigint) AS month_back, cast((month(ts) * 31 + day(ts) - 32) % 31 + 1 AS bigint) AS day_back FROM events"
sql("timestamp_pack", "C14 F23", PACK)
sql("closing_tag_elision", "C15", "SELECT page_id, pos, tag, name, is_end, lead(is_end) OVER (PARTITION BY page_id ORDER BY pos) AND lead(name) OVER (PARTITION BY page_id ORDER BY pos) = name AND NOT is_end AS elides FROM tags")
sql("interlink_tail", "C16", "WITH t AS (SELECT doc_id, line_no, line, max(line_no) OVER (PARTITION BY doc_id) AS last_line FROM lines) SELECT doc_id, count(CASE WHEN line_no >= 4 AND line_no > last_line - 3 AND (line LIKE 'De %' OR line LIKE 'La %' OR line LIKE 'Der %') THEN 1 END) AS moved, count(*) AS n FROM t GROUP BY doc_id")
ONE = "replace(replace(replace(replace(html, '&amp;', '&'), '&quot;', '\"'), '&lt;', '<'), '&gt;', '>')"
TWO = "replace(replace(replace(replace(replace(replace(replace(replace(html, '&&quot;', '\"'), '&&nbsp;', '!'), '&&ndash;', '*'), '&&mdash;', '^'), '&&deg;', chr(176)), '&&times;', chr(215)), '&&lt;', '<'), '&&gt;', '>')"
sql("entity_unescape", "C17", f"SELECT page_id, md5({ONE}) AS digest, cast(length(html) - length({ONE}) AS bigint) AS saved FROM pages")
sql("entity_unescape_double", "C18", f"SELECT page_id, md5({TWO.replace('html', f'({ONE})')}) AS digest, cast(length({TWO.replace('html', f'({ONE})')}) AS bigint) AS n FROM pages".replace("chr(176)", "'°'").replace("chr(215)", "'×'"))
sql(
    "numeric_entities",
    "C19",
    "SELECT page_id, count(*) AS n, max(cast(regexp_extract(m, '[0-9]+', 0) AS bigint)) AS highest FROM (SELECT page_id, unnest(regexp_extract_all(html || ' &#' || (256 + page_id % 500) || ';', '&#[0-9]+;')) AS m FROM pages) AS t GROUP BY page_id",
    spark_text="SELECT page_id, count(*) AS n, max(cast(regexp_extract(m, '[0-9]+', 0) AS bigint)) AS highest FROM (SELECT page_id, explode(regexp_extract_all(concat(html, ' &#', 256 + page_id % 500, ';'), '&#[0-9]+;', 0)) AS m FROM pages) AS t GROUP BY page_id",
)
SWAP = "replace(replace(replace(replace(replace({x}, '&&&', chr(1)), '&&', chr(2)), '&', '&&'), chr(2), '&'), chr(1), '&&&')"
ONCE = SWAP.format(x="html")
sql("run_length_swap", "C20", f"SELECT page_id, md5({ONCE}) AS digest, {SWAP.format(x=ONCE)} = html AS involution FROM pages")
sql("ampersand_removal", "C21", "SELECT page_id, md5(regexp_replace(html, '&([\"<>])', '\\1', 'g')) AS digest FROM pages", spark_text="SELECT page_id, md5(regexp_replace(html, '&([\"<>])', '$1')) AS digest FROM pages")
