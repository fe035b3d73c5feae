"""Chat formatting: logged snapshots of growing conversations collapse before rendering.

A conversation's turns, in order, are a sequence.  The rolling hash of a prefix is
the exclusive or of its turns' position-labelled hashes (two of 64 bits), a running
window aggregate.  A conversation whose whole hash is a shorter prefix of another is
a snapshot of it: an anti-join takes it out.  Equal conversations are one.  What
stays is rendered with a turn template.  Everything is DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BEGIN, END = "<|im_start|>", "<|im_end|>\n"


def turns_of(conversations: DataFrame) -> DataFrame:
    """Numbered turns with rolling prefix hashes: conv_id, lone, idx, n, role, text, h1, h2.

    Turns are in order of turn, role and text, nulls first.  A row without a conv_id is
    a conversation of its own (lone), so such rows never gather.
    """
    c = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    whole = c.where("conv_id is not null").withColumn("idx", F.row_number().over(order))
    lone = c.where("conv_id is null").withColumn("idx", F.lit(1))

    def hashed(df: DataFrame) -> DataFrame:
        return df.withColumn("t1", F.xxhash64("idx", "role", "text")).withColumn("t2", F.xxhash64(F.lit("2"), "text", "role", "idx"))

    rolling = W.partitionBy("conv_id").orderBy("idx").rowsBetween(W.unboundedPreceding, W.currentRow)
    whole = hashed(whole).select("conv_id", F.lit(False).alias("lone"), "idx", F.count("*").over(W.partitionBy("conv_id")).alias("n"), "role", "text", F.expr("bit_xor(t1)").over(rolling).alias("h1"), F.expr("bit_xor(t2)").over(rolling).alias("h2"))
    lone = hashed(lone).select("conv_id", F.lit(True).alias("lone"), "idx", F.lit(1).cast("long").alias("n"), "role", "text", F.col("t1").alias("h1"), F.col("t2").alias("h2"))
    return whole.unionByName(lone)


def rendered(role: F.Column, text: F.Column) -> F.Column:
    """One turn; the marks' first characters inside a text are set apart."""
    apart = lambda c: F.replace(c, F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit(BEGIN), apart(role), F.lit("\n"), apart(text), F.lit(END))


def collapse(conversations: DataFrame) -> DataFrame:
    """The maximal conversations of (conv_id, turn, role, text), rendered.

    Returns conv_id (the least of equal conversations), n_turns, n_copies (equal
    conversations) and rendered.  Null roles and texts are empty; repeated rows are
    turns of their own; an empty table gives an empty one; other columns are ignored.
    """
    turns = turns_of(conversations)
    key = ["h1", "h2", "n"]
    # equal conversations first, so that a common one is a single row of the anti-join
    whole = turns.where("idx = n").groupBy(*key).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.max(F.when(F.col("lone"), F.struct("role", "text"))).alias("single"))
    prefixes = turns.where("idx < n").select("h1", "h2", F.col("idx").cast("long").alias("n")).distinct()
    kept = whole.join(prefixes, key, "left_anti")
    # turns of the kept conversations; those of lone rows only are in the row itself
    own = turns.where("not lone").select("conv_id", "idx", "role", "text")
    many = kept.where("conv_id is not null").select("conv_id", F.col("n").alias("n_turns"), "n_copies").join(own, "conv_id")
    many = many.groupBy("conv_id", "n_turns", "n_copies").agg(F.array_sort(F.collect_list(F.struct("idx", rendered(F.col("role"), F.col("text")).alias("piece")))).alias("pieces"))
    many = many.select("conv_id", "n_turns", "n_copies", F.concat_ws("", F.col("pieces.piece")).alias("rendered"))
    alone = kept.where("conv_id is null").select("conv_id", F.col("n").alias("n_turns"), "n_copies", rendered(F.col("single.role"), F.col("single.text")).alias("rendered"))
    return many.unionByName(alone)


def op6_chat_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collapse(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


OP6_SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS idx, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations
), c AS (
  SELECT conv_id, count(*) AS n, list(md5(role) || md5(text) ORDER BY idx) AS turns,
    string_agg('<|im_start|>' || replace(role, '<|', '< |') || chr(10) || replace(text, '<|', '< |') || '<|im_end|>' || chr(10), '' ORDER BY idx) AS rendered
  FROM t GROUP BY conv_id
), once AS (
  SELECT min(conv_id) AS conv_id, n, count(*) AS n_copies, turns, any_value(rendered) AS rendered FROM c GROUP BY n, turns
), prefixes AS (
  SELECT DISTINCT array_to_string(turns[1:k], ',') AS p FROM (SELECT turns, unnest(range(1, n)) AS k FROM c)
)
SELECT conv_id, n AS n_turns, n_copies, rendered FROM once WHERE array_to_string(turns, ',') NOT IN (SELECT p FROM prefixes)
"""
