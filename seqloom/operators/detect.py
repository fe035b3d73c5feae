"""Content-type detectors: text islands, leaky counters, executable hits and media headers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators import arrays
from seqloom.plans.registry import query, sql

sql(
    "text_islands",
    "DT2 ST7",
    """WITH s AS (SELECT doc_id, pos, ch, CASE WHEN cp BETWEEN 9 AND 13 OR cp BETWEEN 32 AND 126 THEN 0 ELSE 1 END AS breaks FROM symbols),
    i AS (SELECT doc_id, pos, ch, breaks, sum(breaks) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM s)
    SELECT doc_id, cast(island AS bigint) AS island, min(pos) AS start, count(*) AS len, cast(sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) AS bigint) AS spaces FROM i WHERE breaks = 0 GROUP BY doc_id, island HAVING count(*) > 500 AND sum(CASE WHEN ch = ' ' THEN 1 ELSE 0 END) >= 5""",
    # a text is split where it breaks: one row for each run, not for each symbol
    spark_text=r"""WITH s AS (SELECT doc_id, posexplode(split(text, '[^\\x09-\\x0D\\x20-\\x7E]', -1)) AS (island, run) FROM documents),
    l AS (SELECT doc_id, island, length(run) AS len, length(run) - length(replace(run, ' ', '')) AS spaces FROM s),
    p AS (SELECT doc_id, island, len, spaces, sum(len + 1) OVER (PARTITION BY doc_id ORDER BY island) - len - 1 AS start FROM l)
    SELECT doc_id, cast(island AS bigint) AS island, cast(start AS bigint) AS start, cast(len AS bigint) AS len, cast(spaces AS bigint) AS spaces FROM p WHERE len > 500 AND spaces >= 5""",
)


@query(
    "leaky_counter",
    "DT3",
    """WITH d AS (SELECT doc_id, pos, CASE WHEN cp BETWEEN 9 AND 13 OR cp BETWEEN 32 AND 126 THEN -2 ELSE 3 END AS d FROM symbols),
    r AS (SELECT doc_id, pos, cast(sum(d) OVER (PARTITION BY doc_id ORDER BY pos) AS bigint) AS s FROM d),
    m AS (SELECT doc_id, pos, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY pos)) AS level FROM r)
    SELECT doc_id, max(level) AS highest, min(CASE WHEN level > 300 THEN pos - 100 END) AS text_ends, count(CASE WHEN level > 0 THEN 1 END) AS above FROM m GROUP BY doc_id""",
)
def leaky_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A counter that rises with what is no text and leaks to 0, as running sums and least sums over a block."""

    def work(rows: pa.RecordBatch, cp: np.ndarray, first: np.ndarray) -> dict:
        of, n = arrays.owner(first), np.diff(first)
        plain = ((cp >= 9) & (cp <= 13)) | ((cp >= 32) & (cp <= 126))
        s = np.cumsum(np.where(plain, -2, 3))
        s -= np.concatenate([[0], s])[first[:-1]][of]  # the sums begin anew with each text
        away = of * (6 * int(n.max(initial=0)) + 6)  # and so do the least sums: each text's are below those of the ones before
        level = s - np.minimum(np.minimum.accumulate(s - away) + away, 0)
        on, highest, ends = n > 0, np.zeros(len(n), np.int64), np.full(len(n), -1)
        highest[on] = np.maximum.reduceat(level, first[:-1][on]) if len(cp) else 0
        over = np.flatnonzero(level > 300)[::-1]
        ends[of[over]] = arrays.places(first)[over]  # the first is put last
        shown = pa.array(ends[on] - 100, pa.int64(), mask=ends[on] < 0)
        return arrays.per_text(rows, on, highest=highest) | {"text_ends": shown, "above": np.bincount(of[level > 0], minlength=len(n))[on]}

    each = arrays.map_symbols(arrays.documents(spark, sf_dir), work, "doc_id bigint, highest bigint, text_ends bigint, above bigint", "doc_id")
    return each.groupBy("doc_id").agg(F.max("highest").alias("highest"), F.min("text_ends").alias("text_ends"), F.sum("above").alias("above"))


# Synthetic headers, in hexadecimal, as the fixtures have no media files.
HEADERS = [
    ("bmp24", "424D36000C000000000036000000280000000A0000001400000001001800000000000000000000"),
    ("bmp8", "424D36000C000000000036000000280000000A0000001400000001000800000000000000000000"),
    ("tga", "000002000000000000000000400080001800"),
    ("pgm", "50350A2320630A3320340A3235350A"),
    ("ppm", "50360A31302032300A3235350A"),
    ("pam", "50370A57494454482031300A484549474854203230"),
    ("wav", "524946462400000057415645666D7420100000000100020044AC000010B1020004001000"),
    ("dbase", "03790C1F0A00000041001F00"),
    ("jpeg", "FFD8FFE000104A464946"),
    ("tiff", "49492A0008000000"),
    ("text", "48656C6C6F2C20776F726C642E"),
]
_VALUES = ", ".join(f"('{n}', '{h}')" for n, h in HEADERS)


def _sniff(byte: str) -> str:
    def num(start: int, size: int) -> str:
        return "(" + " + ".join(byte.format(at=2 * (start + k) + 1) + f" * {256**k}" for k in range(size)) + ")"

    return f"""SELECT name, CASE
      WHEN h LIKE '424D%' AND {num(14, 4)} = 40 AND {num(28, 2)} = 24 THEN 'IMAGE24'
      WHEN h LIKE '424D%' THEN 'BMP_OTHER'
      WHEN h LIKE '52494646%' AND substr(h, 17, 8) = '57415645' THEN 'AUDIO'
      WHEN h LIKE 'FFD8FF%' THEN 'JPEG'
      WHEN h LIKE '49492A00%' OR h LIKE '4D4D002A%' THEN 'TIFF'
      WHEN h LIKE '5035%' THEN 'IMAGE8' WHEN h LIKE '5036%' THEN 'IMAGE24' WHEN h LIKE '5037%' THEN 'IMAGE32'
      WHEN h LIKE '03%' AND {num(2, 1)} BETWEEN 1 AND 12 AND {num(3, 1)} BETWEEN 1 AND 31 AND {num(8, 2)} > 32 AND {num(10, 2)} > 0 THEN 'DBASE'
      WHEN h LIKE '0000%' AND {num(2, 1)} = 2 AND {num(16, 1)} IN (24, 32) THEN 'IMAGE24'
      ELSE 'DEFAULT' END AS type,
      CASE WHEN h LIKE '424D%' THEN {num(18, 4)} WHEN h LIKE '0000%' THEN {num(12, 2)} WHEN h LIKE '52494646%' THEN {num(22, 2)} WHEN h LIKE '03%' THEN {num(10, 2)} ELSE 0 END AS info_a,
      CASE WHEN h LIKE '424D%' THEN {num(22, 4)} WHEN h LIKE '0000%' THEN {num(14, 2)} WHEN h LIKE '52494646%' THEN {num(24, 4)} WHEN h LIKE '03%' THEN {num(4, 4)} ELSE 0 END AS info_b
      FROM (SELECT name, rpad(h, 100, '0') AS h FROM (VALUES {_VALUES}) AS t(name, h))"""


sql("header_sniff", "DT4 DT6 DT7 DT8 DT9 DT11 DT12 DT13 S6 G5 G8 M21", _sniff("cast('0x' || substr(h, {at}, 2) AS bigint)"), spark_text=_sniff("cast(conv(substr(h, {at}, 2), 16, 10) AS bigint)"))

sql(
    "executable_hits",
    "DT5 G10a",
    """WITH c AS (SELECT user_id, pos, event_id % 251 AS rel, (event_id + pos) % 61 AS target FROM series),
    d AS (SELECT user_id, pos, pos - lag(pos) OVER (PARTITION BY user_id, target ORDER BY pos) AS by_target, pos - lag(pos) OVER (PARTITION BY user_id, rel ORDER BY pos) AS by_rel FROM c)
    SELECT user_id, count(*) AS calls, count(CASE WHEN by_target < coalesce(by_rel, 1000000) AND by_target < 2048 THEN 1 END) AS hits, count(CASE WHEN by_target < coalesce(by_rel, 1000000) AND by_target < 2048 THEN 1 END) >= 4 AS executable FROM d GROUP BY user_id""",
)


@query("detected_blocks", "DT10 U6", f"WITH s AS ({_sniff(chr(39).join(['cast(', '0x', ' || substr(h, {at}, 2) AS bigint)']))}) SELECT name, part, CASE WHEN part = 0 THEN 'HDR' ELSE type END AS block FROM s, (VALUES (0), (1)) AS p(part) WHERE type NOT IN ('DEFAULT', 'BMP_OTHER')")
def detected_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A found header gives two blocks: the header, then the data."""
    found = spark.sql(_sniff("cast(conv(substr(h, {at}, 2), 16, 10) AS bigint)")).where("type NOT IN ('DEFAULT', 'BMP_OTHER')")
    return found.select("name", F.posexplode(F.array(F.lit("HDR"), F.col("type"))).alias("part", "block"))
