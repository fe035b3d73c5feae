"""Sources, segments, blocks, headers and reports: documents as framed byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import query, sql, table

SEGMENT = 1000  # symbols of a segment here; any size will do
VOCABULARY_FROM = 10_000  # bytes from which a document lists the bytes it has


def blocks(lines: DataFrame) -> DataFrame:
    """Runs of lines of one content type with their length and offset: (doc_id, block_no, type, start, len)."""
    from pyspark.sql import Window as W

    order = W.partitionBy("doc_id").orderBy("line_no")
    typed = lines.withColumn("type", F.when(F.col("line").rlike(r"\|"), "TABLE").when(F.col("line").rlike(r"[#$%&*]{3}"), "NOISE").otherwise("TEXT")).withColumn("len", F.length("line") + 1)
    fresh = typed.withColumn("fresh", (F.coalesce(F.lag("type").over(order), F.lit("")) != F.col("type")).cast("bigint"))
    runs = fresh.withColumn("block_no", F.sum("fresh").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = runs.groupBy("doc_id", "block_no", "type").agg(F.sum("len").cast("bigint").alias("len"), F.min("line_no").alias("first_line"))
    before = W.partitionBy("doc_id").orderBy("block_no").rowsBetween(W.unboundedPreceding, -1)
    return own.withColumn("start", F.coalesce(F.sum("len").over(before), F.lit(0)).cast("bigint"))


sql("doc_scan", "IO2 M1 M2", "SELECT doc_id, cast(octet_length(encode(coalesce(text, ''))) AS bigint) AS n_bytes, cast(length(coalesce(text, '')) AS bigint) AS n_chars FROM documents", spark_text="SELECT doc_id, cast(octet_length(encode(coalesce(text, ''), 'UTF-8')) AS bigint) AS n_bytes, cast(length(coalesce(text, '')) AS bigint) AS n_chars FROM documents")


@query(
    "segment_split",
    "IO8 M2",
    f"""SELECT doc_id, k AS seg_no, k * {SEGMENT} AS start, least({SEGMENT}, length(text) - k * {SEGMENT}) AS len, md5(substr(text, k * {SEGMENT} + 1, {SEGMENT})) AS digest
    FROM (SELECT doc_id, text, unnest(range(0, greatest(1, cast(ceil(length(text) / {SEGMENT}.0) AS BIGINT)))) AS k FROM documents)""",
)
def segment_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    each = docs.select("doc_id", "text", F.explode(F.expr(f"sequence(0L, greatest(0L, cast(ceil(length(text) / {SEGMENT}.0) AS bigint) - 1))")).alias("seg_no"))
    start = F.col("seg_no") * SEGMENT
    return each.select("doc_id", "seg_no", start.alias("start"), F.least(F.lit(SEGMENT).cast("bigint"), F.length("text") - start).alias("len"), F.md5(F.expr(f"substr(text, cast(seg_no * {SEGMENT} + 1 AS int), {SEGMENT})").cast("binary")).alias("digest"))


HEADER = """SELECT doc_id, n, flag, {byte0} AS b0, cast(floor(n / 16777216) AS bigint) % 256 AS b1, cast(floor(n / 65536) AS bigint) % 256 AS b2, cast(floor(n / 256) AS bigint) % 256 AS b3, n % 256 AS b4,
  (({byte0}) % 128) * 4294967296 + (cast(floor(n / 16777216) AS bigint) % 256) * 16777216 + (cast(floor(n / 65536) AS bigint) % 256) * 65536 + (cast(floor(n / 256) AS bigint) % 256) * 256 + n % 256 AS read_back
  FROM (SELECT doc_id, cast(length(text) AS bigint) AS n, CASE WHEN lang = 'en' THEN 128 ELSE 0 END AS flag FROM documents)"""
sql("header_codec", "IO9 IO10 M4", HEADER.format(byte0="cast(floor(n / 4294967296) AS bigint) % 128 + flag"))
_VOCABULARY = """WITH v AS (SELECT doc_id, b, count(*) AS n FROM bytes GROUP BY doc_id, b), o AS (SELECT doc_id, cast(sum(n) AS bigint) AS n_bytes, count(*) AS present, {listed} AS listed FROM v GROUP BY doc_id)
    SELECT doc_id, n_bytes, CASE WHEN n_bytes < {from_} THEN 256 ELSE present END AS vocabulary, CASE WHEN n_bytes < {from_} THEN NULL ELSE listed END AS listed FROM o"""
# the bytes that occur, in hexadecimal and in order, say what a bitmap of 256 bits does; short texts may use all
sql(
    "vocab_bitmap",
    "IO11 A20",
    _VOCABULARY.format(listed="string_agg(lpad(to_hex(b), 2, '0'), '' ORDER BY b)", from_=VOCABULARY_FROM),
    spark_text=_VOCABULARY.format(listed="array_join(array_sort(collect_list(lpad(hex(b), 2, '0'))), '')", from_=VOCABULARY_FROM),
)
BLOCKS = """typed AS (SELECT doc_id, line_no, CASE WHEN line LIKE '%|%' THEN 'TABLE' WHEN {m}(line, '[#$%&*]{{3}}') THEN 'NOISE' ELSE 'TEXT' END AS type, length(line) + 1 AS len FROM lines),
  fresh AS (SELECT *, CASE WHEN coalesce(lag(type) OVER (PARTITION BY doc_id ORDER BY line_no), '') <> type THEN 1 ELSE 0 END AS f FROM typed),
  runs AS (SELECT *, sum(f) OVER (PARTITION BY doc_id ORDER BY line_no) AS block_no FROM fresh),
  own AS (SELECT doc_id, cast(block_no AS bigint) AS block_no, type, cast(sum(len) AS bigint) AS len FROM runs GROUP BY doc_id, block_no, type)"""
DUCK_BLOCKS = BLOCKS.format(m="regexp_matches")


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


@query("block_frames", "IO6 IO12 M3 DT10", f"WITH {DUCK_BLOCKS} SELECT doc_id, block_no, type, len, cast(coalesce(sum(len) OVER (PARTITION BY doc_id ORDER BY block_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS bigint) AS start FROM own")
def block_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(_lines(spark, sf_dir)).select("doc_id", "block_no", "type", "len", "start")


@query("block_type_share", "IO7 IO13 IO14", f"WITH {DUCK_BLOCKS}, t AS (SELECT doc_id, type, sum(len) AS len FROM own GROUP BY doc_id, type), w AS (SELECT doc_id, sum(len) AS whole, sum(CASE WHEN type = 'TEXT' THEN len ELSE 0 END) AS text_len FROM t GROUP BY doc_id) SELECT t.doc_id, type, cast(len AS bigint) AS len, round(len / whole, 6) AS share, text_len / whole > 0.95 AS taken_as_text FROM t JOIN w ON t.doc_id = w.doc_id")
def block_type_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of each type; a document of more than 95 % text is taken as text whole."""
    from pyspark.sql import Window as W

    own = blocks(_lines(spark, sf_dir)).groupBy("doc_id", "type").agg(F.sum("len").cast("bigint").alias("len"))
    doc = W.partitionBy("doc_id")
    text = F.sum(F.when(F.col("type") == "TEXT", F.col("len")).otherwise(0)).over(doc) / F.sum("len").over(doc)
    return own.select("doc_id", "type", "len", F.round(F.col("len") / F.sum("len").over(doc), 6).alias("share"), (text > 0.95).alias("taken_as_text"))


sql(
    "size_report",
    "IO15 IO16 L18",
    """WITH c AS (SELECT doc_id, cp, count(*) AS n FROM symbols GROUP BY doc_id, cp), t AS (SELECT doc_id, sum(n) AS total FROM c GROUP BY doc_id)
    SELECT c.doc_id, cast(max(total) AS bigint) AS symbols_in, cast(ceil(sum(n * log2(total / (n * 1.0e0))) / 8 - 1e-9) AS bigint) AS bytes_out, round(sum(n * log2(total / (n * 1.0e0))) / max(total), 6) AS bits_per_symbol FROM c JOIN t ON c.doc_id = t.doc_id GROUP BY c.doc_id""",
)
