"""Reversible block transforms: image decorrelation, packed-pixel runs, executable addresses, warm start."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.operators.dictionary import DICT
from seqloom.plans.registry import query, sql, table

TRIPLES = "SELECT y, cast(floor(x / 3) AS bigint) AS px, max(CASE WHEN x % 3 = 0 THEN p END) AS b, max(CASE WHEN x % 3 = 1 THEN p END) AS g, max(CASE WHEN x % 3 = 2 THEN p END) AS r FROM grid GROUP BY y, floor(x / 3)"
FORWARD = f"SELECT y, px, b, g, r, CASE WHEN r IS NULL THEN b ELSE g END AS o0, CASE WHEN r IS NULL THEN g ELSE (g - r + 256) % 256 END AS o1, CASE WHEN r IS NULL THEN NULL ELSE (g - b + 256) % 256 END AS o2 FROM ({TRIPLES}) AS t"

sql("identity_block", "BT1", "SELECT doc_id, text FROM documents")
sql("rgb_decorrelate", "BT2", f"SELECT y, px, b, coalesce(g, -1) AS g, coalesce(r, -1) AS r, o0, coalesce(o1, -1) AS o1, coalesce(o2, -1) AS o2 FROM ({FORWARD}) AS f")
sql("rgb_restore", "BT4", f"SELECT y, px, CASE WHEN o2 IS NULL THEN o0 ELSE (o0 - o2 + 256) % 256 END AS b, coalesce(CASE WHEN o2 IS NULL THEN o1 ELSE o0 END, -1) AS g, CASE WHEN o2 IS NULL THEN -1 ELSE (o0 - o1 + 256) % 256 END AS r, CASE WHEN o2 IS NULL THEN o0 ELSE (o0 - o2 + 256) % 256 END = b AS same FROM ({FORWARD}) AS f")
sql(
    "packed_pixel_runs",
    "BT3",
    """WITH s AS (SELECT y, x, CASE WHEN p % 8 = cast(floor(p / 32) AS bigint) % 8 THEN 0 ELSE 1 END AS breaks FROM grid), i AS (SELECT *, sum(breaks) OVER (PARTITION BY y ORDER BY x) AS island FROM s)
    SELECT y, min(x) AS start, count(*) AS run, count(*) >= 63 AS packed FROM i WHERE breaks = 0 GROUP BY y, island""",
)


_CALL = re.compile(rb"[\xe8\xe9]|\x0f[\x80-\x8f]")


def absolute_calls(data: bytes, undo: bool = False) -> bytes:
    """Relative CALL, JMP and Jcc operands as absolute ones, or back; any bytes come back.

    The four bytes after an operation are its operand and are never read as operations, so
    both ways meet the same places.  Displacements that lead into the data, [-at, size - at),
    become addresses [0, size); those that displaces, [size - at, size), take the room left
    below 0; all others stay.  That is one to one, so undoing it needs no marks.
    """
    out, size, at = bytearray(data), len(data), 0
    while (m := _CALL.search(out, at)) and m.end() + 4 <= size:
        here, at = m.end(), m.end() + 4  # displacements count from the next operation
        value = int.from_bytes(out[here:at], "little", signed=True)
        if -at <= value < size:
            if undo:
                value = value - at if value >= 0 else value + size
            else:
                value = value + at if value < size - at else value - size
            out[here:at] = value.to_bytes(4, "little", signed=True)
    return bytes(out)


def address_trips(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_bytes, changed, same) of (doc_id, text); one text's bytes are held at a time."""
    for rows in batches:
        own = []
        for text in rows.column("text"):
            data = (text.as_py() or "").encode().translate(_AS_CODE)
            coded = absolute_calls(data)
            own.append((len(data), int((np.frombuffer(coded, np.uint8) != np.frombuffer(data, np.uint8)).sum()), absolute_calls(coded, True) == data))
        yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), *[pa.array([x[k] for x in own], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.bool_()))]], ["doc_id", "n_bytes", "changed", "same"])


@query("executable_addresses", "BT5 BT6")
def executable_addresses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Round trip of documents' bytes, seen as code, through the address transform."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(address_trips, "doc_id long, n_bytes long, changed long, same boolean")


#: letters that stand for the bytes of calls, so that texts have some
_AS_CODE = bytes.maketrans(b"xzqk", b"\xe8\xe9\x00\xff")

sql(
    "warm_start_symbols",
    "BT9 ST3",
    f"WITH {DICT.replace('{m}', 'regexp_matches')} SELECT phase, count(*) AS items, cast(sum(n) AS bigint) AS symbols FROM (SELECT 0 AS phase, length(word) + 1 AS n FROM coded UNION ALL SELECT 1 AS phase, length(text) AS n FROM documents) AS u GROUP BY phase",
    spark_text=f"WITH {DICT.replace('{m}', 'regexp_like')} SELECT phase, count(*) AS items, cast(sum(n) AS bigint) AS symbols FROM (SELECT 0 AS phase, length(word) + 1 AS n FROM coded UNION ALL SELECT 1 AS phase, length(text) AS n FROM documents) AS u GROUP BY phase",
)


@query("codec_registry", "U6 IO1", "SELECT type, count(*) AS n FROM (SELECT CASE WHEN text LIKE '%|%' THEN 'TABLE' ELSE 'TEXT' END AS type FROM documents) GROUP BY type")
def codec_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents by the codec that a registry picks for them; each codec undoes itself."""
    codecs = {"TABLE": (lambda c: F.translate(c, "|", "\x01"), lambda c: F.translate(c, "\x01", "|")), "TEXT": (lambda c: c, lambda c: c)}
    typed = table(spark, sf_dir, "documents").withColumn("type", F.when(F.col("text").contains("|"), "TABLE").otherwise("TEXT"))
    back = F.coalesce(*[F.when(F.col("type") == t, decode(encode(F.col("text")))) for t, (encode, decode) in codecs.items()])
    return typed.where(back == F.col("text")).groupBy("type").agg(F.count("*").alias("n"))
