"""Scalar functions: bits, logarithms, logistic curves, hashes, classes, numbers and content flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import query, sql, table

# ---------------------------------------------------------------- columns


def byte_swap(x: Column) -> Column:
    """The four bytes of an unsigned 32-bit number in the other order."""
    byte = lambda k: F.floor(x / (256**k)).cast("bigint") % 256
    return byte(0) * 16777216 + byte(1) * 65536 + byte(2) * 256 + byte(3)


def ilog2(x: Column) -> Column:
    """floor(log2 x), 0 for 0 and less."""
    return F.when(x > 0, F.floor(F.log2(x)).cast("bigint")).otherwise(F.lit(0).cast("bigint"))


def logit(p: Column, least: float = 1e-4) -> Column:
    """ln(p / (1 - p)) of p held to [least, 1 - least]."""
    held = F.greatest(F.least(p, F.lit(1 - least)), F.lit(least))
    return F.log(held / (1 - held))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


# ---------------------------------------------------------------- queries


@query("scalar_bits", "F1 F2 F3 F19", "SELECT p_partkey, (p_partkey % 256) * 16777216 + (p_partkey // 256 % 256) * 65536 + (p_partkey // 65536 % 256) * 256 + p_partkey // 16777216 % 256 AS swapped, cast(bit_count(p_partkey) AS BIGINT) AS ones, CASE WHEN p_partkey > 0 THEN cast(floor(log2(p_partkey)) AS BIGINT) ELSE 0 END AS ilog2 FROM part")
def scalar_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", byte_swap(x).alias("swapped"), F.bit_count(x).cast("bigint").alias("ones"), ilog2(x).alias("ilog2"))


sql("scalar_ilog", "F4", "SELECT p_size, cast(round(16 * log2(p_size)) AS bigint) AS ilog, cast(round(16 * log2(floor(p_retailprice) + 1)) AS bigint) AS llog, count(*) AS n FROM part WHERE p_size > 0 GROUP BY p_size, cast(round(16 * log2(floor(p_retailprice) + 1)) AS bigint)")


@query(
    "logistic_table",
    "F5 F6 F7 F8 F9",
    """WITH t AS (SELECT p_partkey, greatest(least(p_size / 51.0e0, 1 - 1e-4), 1e-4) AS p FROM part)
    SELECT p_partkey, round(p, 6) AS p, round(ln(p / (1 - p)), 6) AS logit, round(1 / (1 + exp(-ln(p / (1 - p)))), 6) AS back, round(256 * ln(p / (1 - p)), 4) AS stretch,
      round(4096 / (1 + exp(-ln(p / (1 - p)))), 4) AS squash, round(log2((1 - p) / p), 6) AS cost_domain, cast(floor(1 + 4094 * p) AS BIGINT) AS p12, cast(floor(1 + 65534 * p) AS BIGINT) AS p16 FROM t""",
)
def logistic_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.greatest(F.least(F.col("p_size") / 51.0, F.lit(1 - 1e-4)), F.lit(1e-4))
    x = logit(F.col("q"))
    return (
        table(spark, sf_dir, "part")
        .select("p_partkey", p.alias("q"))
        .select(
            "p_partkey",
            F.round("q", 6).alias("p"),
            F.round(x, 6).alias("logit"),
            F.round(logistic(x), 6).alias("back"),
            F.round(256 * x, 4).alias("stretch"),
            F.round(4096 * logistic(x), 4).alias("squash"),
            F.round(F.log2((1 - F.col("q")) / F.col("q")), 6).alias("cost_domain"),
            F.floor(1 + 4094 * F.col("q")).cast("bigint").alias("p12"),
            F.floor(1 + 65534 * F.col("q")).cast("bigint").alias("p16"),
        )
    )


@query("context_hash_groups", "F10 F11 F12 M10", "SELECT l_returnflag, l_linestatus, l_linenumber, count(*) AS n, cast(1 AS BIGINT) AS keys FROM lineitem GROUP BY 1, 2, 3")
def context_hash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by a 64-bit hash of a context tuple: one key for each tuple."""
    own = table(spark, sf_dir, "lineitem").withColumn("key", F.xxhash64("l_returnflag", "l_linestatus", "l_linenumber"))
    return own.groupBy("l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"), F.countDistinct("key").alias("keys"))


CLASS = """CASE WHEN cp < 32 THEN 'control' WHEN cp = 32 THEN 'space' WHEN ch >= '0' AND ch <= '9' THEN 'digit' WHEN (ch >= 'a' AND ch <= 'z') THEN 'lower' WHEN (ch >= 'A' AND ch <= 'Z') THEN 'upper' WHEN cp < 128 THEN 'punct' ELSE 'high' END"""
sql("char_class_profile", "F13 F14 F15 F16 DT1", f"SELECT doc_id, {CLASS} AS class, count(*) AS n, cast(sum(CASE WHEN cp BETWEEN 9 AND 13 OR cp BETWEEN 32 AND 126 THEN 1 ELSE 0 END) AS bigint) AS ascii_text FROM symbols GROUP BY doc_id, {CLASS}")
sql(
    "case_and_affix_ops",
    "F17 F18",
    """SELECT word, lower(word) AS low, translate(word, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS up, length(word) AS n, CASE WHEN word LIKE 'th%' THEN 1 ELSE 0 END AS begins_th, CASE WHEN word LIKE '%ing' THEN substr(word, 1, length(word) - 3) || 'e' ELSE word END AS suffix_changed,
      substr(word, 1, 1) AS first_ch, substr(word, length(word), 1) AS last_ch, CASE WHEN lower(word) IN ('the', 'of', 'and', 'to') THEN 1 ELSE 0 END AS matches_any, count(*) AS uses FROM words GROUP BY word""",
)
sql(
    "utf8_profile",
    "F21 C23 M12",
    """SELECT doc_id, CASE WHEN b < 128 THEN 'ascii' WHEN b < 192 THEN 'continuation' WHEN b < 224 THEN 'lead2' WHEN b < 240 THEN 'lead3' ELSE 'lead4' END AS kind, count(*) AS n,
      cast(sum(CASE WHEN b >= 240 THEN 3 WHEN b >= 224 THEN 2 WHEN b >= 192 THEN 1 ELSE 0 END) AS bigint) AS announced FROM bytes GROUP BY 1, 2""",
)
sql(
    "number_parse_diff",
    "F22 F24 T13",
    r"""WITH n AS (SELECT doc_id, pos, cast(tok AS bigint) AS v FROM tokens WHERE kind = 'number' AND length(tok) <= 18),
    d AS (SELECT doc_id, pos, v, lag(v) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM n)
    SELECT doc_id, pos, v, coalesce(before, -1) AS before, coalesce(cast(sign(v - before) AS bigint), 0) AS direction, CASE WHEN v <> before THEN cast(floor(log2(abs(v - before))) AS bigint) ELSE -1 END AS log_step, coalesce(v = before + 1, false) AS as_expected FROM d""",
)
FLAGS = r"""max(CASE WHEN {m}(line, '(19|20)[0-9]{{2}}-[0-9]{{2}}-[0-9]{{2}}') THEN 1 ELSE 0 END) AS has_date, max(CASE WHEN {m}(line, '[0-9]{{1,2}}:[0-9]{{2}}') THEN 1 ELSE 0 END) AS has_time, max(CASE WHEN {m}(line, 'https?://|www[.]') THEN 1 ELSE 0 END) AS has_url,
  max(CASE WHEN {m}(line, '[0-9]{{1,3}}([.][0-9]{{1,3}}){{3}}') THEN 1 ELSE 0 END) AS has_ip, max(CASE WHEN {m}(line, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') THEN 1 ELSE 0 END) AS has_mail, max(CASE WHEN {m}(line, '^[0-9 .,]+$') THEN 1 ELSE 0 END) AS has_number_line,
  max(CASE WHEN {m}(line, 'ISBN|[0-9]{{13}}') THEN 1 ELSE 0 END) AS has_isbn, max(CASE WHEN {m}(line, '[0-9]+ ?°') THEN 1 ELSE 0 END) AS has_degrees"""
sql("content_flags", "F23 S2 M18", f"SELECT doc_id, {FLAGS.format(m='regexp_matches')} FROM lines GROUP BY doc_id", spark_text=f"SELECT doc_id, {FLAGS.format(m='regexp_like')} FROM lines GROUP BY doc_id")


@query(
    "quantisers",
    "F20",
    """SELECT l_orderkey, l_linenumber, greatest(0, least(255, cast(floor(l_extendedprice) AS BIGINT) // 100)) AS clipped, cast(round(16 * log2(floor(l_quantity) + 1)) AS BIGINT) AS log_qt,
    cast(round((ln(l_extendedprice) - ln(l_quantity)) / ln(2) * 4) AS BIGINT) AS log_mean_diff FROM lineitem""",
)
def quantisers(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, q = F.col("l_extendedprice"), F.col("l_quantity")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        F.greatest(F.lit(0).cast("bigint"), F.least(F.lit(255).cast("bigint"), F.expr("cast(floor(l_extendedprice) AS bigint) div 100"))).alias("clipped"),
        F.round(16 * F.log2(F.floor(q) + 1)).cast("bigint").alias("log_qt"),
        F.round((F.log(price) - F.log(q)) / F.log(F.lit(2.0)) * 4).cast("bigint").alias("log_mean_diff"),
    )


sql(
    "move_to_front_rank",
    "F25 J4",
    """WITH s AS (SELECT user_id, pos, event_type, lag(pos) OVER (PARTITION BY user_id, event_type ORDER BY pos) AS before FROM series)
    SELECT a.user_id, a.pos, a.event_type, count(DISTINCT b.event_type) AS rank FROM s a LEFT JOIN series b ON a.user_id = b.user_id AND b.pos > a.before AND b.pos < a.pos WHERE a.before IS NOT NULL GROUP BY a.user_id, a.pos, a.event_type""",
    spark_text="""SELECT user_id, i.pos, i.event_type, i.rank FROM (
      SELECT user_id, inline(aggregate(array_sort(collect_list(struct(pos, event_type))),
        named_struct('front', cast(array() AS array<string>), 'out', cast(array() AS array<struct<pos:bigint,event_type:string,rank:bigint>>)),
        (s, x) -> named_struct('front', concat(array(x.event_type), array_remove(s.front, x.event_type)),
          'out', CASE WHEN array_contains(s.front, x.event_type) THEN concat(s.out, array(named_struct('pos', x.pos, 'event_type', x.event_type, 'rank', cast(array_position(s.front, x.event_type) - 1 AS bigint)))) ELSE s.out END),
        s -> s.out)) AS (pos, event_type, rank) FROM series GROUP BY user_id) i""".replace("SELECT user_id, i.pos, i.event_type, i.rank FROM (", "SELECT * FROM (").replace(") i", ")"),
)


def uniform(key: str, seed: int) -> Column:
    """A number in [0, 1) that depends on a key column and a seed alone, wherever the row is read."""
    return F.conv(F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}"))), 1, 13), 16, 10).cast("double") / 2.0**52


@query("seeded_uniform", "F26", "SELECT count(*) AS n, round(avg(u), 6) AS mean, min(u) AS least, max(u) AS most FROM (SELECT cast(cast('0x' || substr(md5(cast(o_orderkey AS VARCHAR) || ':42'), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM orders) AS t")
def seeded_uniform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A seeded generator's mean and range over the orders."""
    return table(spark, sf_dir, "orders").select(uniform("o_orderkey", 42).alias("u")).agg(F.count("*").alias("n"), F.round(F.avg("u"), 6).alias("mean"), F.min("u").alias("least"), F.max("u").alias("most"))
