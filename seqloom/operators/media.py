"""Media analogues: grid neighbours and predictors, series extrapolation, prefix codes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from seqloom.operators.corpus import running_number
from seqloom.operators.detect import HEADERS
from seqloom.operators.grain import SAMPLE
from seqloom.plans.registry import query, sql, table

NEIGHBOURS = """WITH g AS (SELECT y, x, p, lag(p, 1) OVER r AS w, lag(p, 2) OVER r AS ww, lag(p, 1) OVER c AS n, lag(p, 2) OVER c AS nn, lag(p, 3) OVER c AS nnn FROM grid WINDOW r AS (PARTITION BY y ORDER BY x), c AS (PARTITION BY x ORDER BY y)),
  k AS (SELECT y, x, p, w, ww, n, nn, nnn, lag(n, 1) OVER r AS nw, lead(n, 1) OVER r AS ne FROM g WINDOW r AS (PARTITION BY y ORDER BY x))"""
STRIPE = 1024  # rows of the grid that one window holds


def grid_rows(vectors: DataFrame) -> DataFrame:
    """(y, p, n, nn, nnn): the samples of each row of the grid, and of the rows above it, as arrays.

    Rows are numbered in two steps and dealt to stripes, each of which also gets the last
    three rows of the one before; no window holds a column of the grid.
    """
    rows = vectors.select(F.col("vec_id").alias("y"), F.expr(f"transform(embedding, v -> {SAMPLE})").alias("p"), F.lit(1).cast("bigint").alias("one"), F.lit(0).alias("file"))
    numbered = running_number(rows, "file", "y", "one").select("y", "p", (F.col("number") - 1).alias("r"))
    own = numbered.withColumn("stripe", F.floor(F.col("r") / STRIPE))
    led = own.where(f"r % {STRIPE} >= {STRIPE - 3}").withColumn("stripe", F.col("stripe") + 1)
    at = W.partitionBy("stripe").orderBy("r")
    above = [F.lag("p", k).over(at).alias("n" * k) for k in (1, 2, 3)]
    return own.unionByName(led).select("y", "p", "r", "stripe", *above).where(f"stripe = floor(r / {STRIPE})").drop("r", "stripe")


def _total(column: str, drop_first: int = 0, drop_last: int = 0) -> Column:
    """The sum of an array without some of its ends, 0 for none."""
    part = F.slice(column, F.lit(1 + drop_first), F.greatest(F.size(column) - drop_first - drop_last, F.lit(0)))
    return F.coalesce(F.aggregate(part, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(0)).cast("bigint")


@query("grid_neighbours", "G3a J9 G1 G2 G3", NEIGHBOURS + " SELECT y, count(*) AS n, cast(coalesce(sum(w), 0) AS bigint) AS w, cast(coalesce(sum(n), 0) AS bigint) AS up, cast(coalesce(sum(nw), 0) AS bigint) AS nw, cast(coalesce(sum(ne), 0) AS bigint) AS ne, cast(coalesce(sum(ww), 0) AS bigint) AS ww, cast(coalesce(sum(nn), 0) AS bigint) AS nn FROM k GROUP BY y")
def grid_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the neighbours of each row's samples sum to; left and right are shifts of the row's own arrays."""
    rows = grid_rows(table(spark, sf_dir, "embeddings")).where("size(p) > 0")
    return rows.select("y", F.size("p").cast("bigint").alias("n"), _total("p", 0, 1).alias("w"), _total("n").alias("up"), _total("n", 0, 1).alias("nw"), _total("n", 1, 0).alias("ne"), _total("p", 0, 2).alias("ww"), _total("nn").alias("nn"))


@query(
    "grid_gradient_residual",
    "G3b G4",
    NEIGHBOURS
    + """ SELECT y, round(avg(abs(p - (w + n - nw)) * 1.0e0), 6) AS gradient, round(avg(abs(p - greatest(least(w + n - nw, greatest(w, n)), least(w, n))) * 1.0e0), 6) AS clamped, round(avg(abs(p - (3 * n - 3 * nn + nnn)) * 1.0e0), 6) AS polynomial, round(avg(abs(p - (w + ne) / 2.0e0)), 6) AS diagonal FROM k WHERE nw IS NOT NULL AND ne IS NOT NULL AND nnn IS NOT NULL GROUP BY y""",
)
def grid_gradient_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far four predictors are from each row's samples, from the row's arrays alone."""
    rows = grid_rows(table(spark, sf_dir, "embeddings")).where("nnn is not null and size(p) > 2")
    errors = """transform(sequence(1, size(p) - 2), x -> named_struct(
      'gradient', abs(p[x] - (p[x - 1] + n[x] - n[x - 1])), 'clamped', abs(p[x] - greatest(least(p[x - 1] + n[x] - n[x - 1], greatest(p[x - 1], n[x])), least(p[x - 1], n[x]))),
      'polynomial', abs(p[x] - (3 * n[x] - 3 * nn[x] + nnn[x])), 'diagonal', abs(p[x] - (p[x - 1] + n[x + 1]) / 2.0e0)))"""
    own = rows.select("y", F.expr(errors).alias("e"))
    mean = lambda name: F.round(F.expr(f"aggregate(e, 0.0D, (s, x) -> s + x.{name}) / size(e)"), 6).alias(name)
    return own.select("y", *[mean(k) for k in ("gradient", "clamped", "polynomial", "diagonal")])


sql("grid_runs", "G2a", "WITH s AS (SELECT y, x, p, CASE WHEN lag(floor(p / 16)) OVER (PARTITION BY y ORDER BY x) = floor(p / 16) THEN 0 ELSE 1 END AS fresh FROM grid), i AS (SELECT *, sum(fresh) OVER (PARTITION BY y ORDER BY x) AS island FROM s), r AS (SELECT y, island, count(*) AS run FROM i GROUP BY y, island) SELECT y, count(*) AS runs, max(run) AS longest FROM r GROUP BY y")
LAGS = "SELECT user_id, pos, value, lag(value, 1) OVER w AS a, lag(value, 2) OVER w AS b, lag(value, 3) OVER w AS c, lag(value, 4) OVER w AS d FROM series WINDOW w AS (PARTITION BY user_id ORDER BY pos)"
sql("poly_forecast_residual", "G6a L23 G6 G7", f"SELECT user_id, count(d) AS n, round(avg(abs(value - (2 * a - b))), 4) AS line, round(avg(abs(value - (3 * a - 3 * b + c))), 4) AS parabola, round(avg(abs(value - (4 * a - 6 * b + 4 * c - d))), 4) AS cubic FROM ({LAGS}) AS t WHERE d IS NOT NULL GROUP BY user_id")
sql("residual_energy", "G6b", f"WITH r AS (SELECT user_id, pos, value - (2 * a - b) AS e FROM ({LAGS}) AS t WHERE b IS NOT NULL) SELECT user_id, count(CASE WHEN abs(e) > 4 THEN 1 END) AS large, cast(floor(log2(1 + sum(e * e))) AS bigint) AS log_energy FROM r GROUP BY user_id")
sql(
    "canonical_huffman",
    "G9a",
    """WITH c AS (SELECT event_type, count(*) AS n, sum(count(*)) OVER () AS total FROM events GROUP BY event_type), l AS (SELECT event_type, n, cast(ceil(-log2(n / (total * 1.0e0)) - 1e-9) AS bigint) AS len FROM c),
    k AS (SELECT event_type, n, len, sum(power(2.0e0, -len)) OVER (ORDER BY len, event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l) SELECT event_type, n, len, cast(coalesce(before, 0) * power(2.0e0, len) AS bigint) AS code FROM k""",
)
sql("instruction_window", "G10a", "WITH v AS (SELECT user_id, pos, CASE WHEN event_type IN ('click', 'view') THEN 1 ELSE 0 END AS ok FROM series) SELECT user_id, pos, min(ok) OVER (PARTITION BY user_id ORDER BY pos ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) = 1 AND pos > 16 AS valid FROM v")


CODED = 1000  # symbols with a code of their own; the others are escaped and said in full


def huffman_codes(counts: dict[str | None, int]) -> dict[str | None, tuple[int, int]]:
    """Canonical prefix codes (value, length) of symbol counts; None is the escape, which any table has."""
    counts = {None: 1} | {s: n for s, n in counts.items() if n > 0}
    total, codes, code, last = sum(counts.values()), {}, 0, 0
    lengths = {s: max(1, (-(-total // n) - 1).bit_length()) for s, n in counts.items()}
    for s in sorted(lengths, key=lambda s: (lengths[s], s is not None, s or "")):
        code <<= lengths[s] - last
        codes[s], code, last = (code, lengths[s]), code + 1, lengths[s]
    return codes


def huffman_bits(symbols: list[str], codes: dict[str | None, tuple[int, int]]) -> str:
    """The bits of symbols; one without a code follows the escape as its length (32 bits) and bytes."""
    names = {s: f"{c:0{n}b}" for s, (c, n) in codes.items()}

    def full(s: str) -> str:
        raw = s.encode()
        return names[None] + f"{len(raw):032b}" + "".join(f"{x:08b}" for x in raw)

    return "".join(names[s] if s in names and s is not None else full(s) for s in symbols)


def huffman_decode(bits: str, codes: dict[str | None, tuple[int, int]]) -> list[str]:
    """Symbols of a bit string, one bit at a time."""
    names = {(f"{c:0{n}b}"): s for s, (c, n) in codes.items()}
    out, own, at = [], "", 0
    while at < len(bits):
        own += bits[at]
        at += 1
        if own in names:
            symbol, own = names[own], ""
            if symbol is None:
                size = int(bits[at : at + 32], 2)
                raw = bits[at + 32 : at + 32 + 8 * size]
                symbol, at = int(raw or "0", 2).to_bytes(size, "big").decode(), at + 32 + 8 * size
            out.append(symbol)
    return out


@query("huffman_roundtrip", "G9b G9")
def huffman_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event types of each user coded and decoded with a canonical prefix code of their counts; a null one reads as empty."""
    events = table(spark, sf_dir, "events").withColumn("event_type", F.coalesce("event_type", F.lit("")))
    counts = events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).first()[0] or 0
    most = {r.event_type: r.n for r in counts.orderBy(F.desc("n"), "event_type").limit(CODED).collect()}
    codes = huffman_codes(most | {None: max(1, total - sum(most.values()))})

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        own = rows.sort_values(["ts", "event_id"])["event_type"].tolist()
        bits = huffman_bits(own, codes)
        return pd.DataFrame({"user_id": [rows["user_id"].iloc[0]], "n": [len(own)], "bits": [len(bits)], "same": [huffman_decode(bits, codes) == own]})

    return events.select("user_id", "ts", "event_id", "event_type").groupBy("user_id").applyInPandas(run, "user_id long, n long, bits long, same boolean")


def jpeg_markers(data: bytes) -> list[tuple[int, int]]:
    """(place, marker) of the segments of a JPEG up to its scan."""
    out, at = [], 2
    if data[:2] != b"\xff\xd8":
        return []
    out.append((0, 0xD8))
    while at + 4 <= len(data) and data[at] == 0xFF:
        out.append((at, data[at + 1]))
        if data[at + 1] == 0xDA:
            break
        at += 2 + int.from_bytes(data[at + 2 : at + 4], "big")
    return out


_JPEG = "FFD8FFE00010" + "00" * 14 + "FFDB0004" + "0000" + "FFC00008" + "000000000000" + "FFC40004" + "0000" + "FFDA0004" + "0000"


@query("jpeg_marker_index", "G9c DT4")
def jpeg_marker_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The segment markers of synthetic headers."""
    rows = spark.createDataFrame([*HEADERS, ("jpeg_full", _JPEG)], "name string, h string")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [(n, at, m) for n, h in zip(b["name"], b["h"]) for at, m in jpeg_markers(bytes.fromhex(h))]
            yield pd.DataFrame(found, columns=["name", "place", "marker"])

    return rows.mapInPandas(run, "name string, place long, marker long")


# One-byte operations with a ModRM byte in the toy decoder's model of x86, and prefixes.
_PREFIXES = frozenset([0x26, 0x2E, 0x36, 0x3E, 0x66, 0x67, 0xF0, 0xF2, 0xF3])


def read_instructions(data: bytes) -> Iterator[tuple[int, int, bool]]:
    """(place, operation, has ModRM) by a small state machine: prefixes, operation, ModRM and SIB, displacement."""
    at = 0
    while at < len(data):
        start = at
        while at < len(data) and data[at] in _PREFIXES:
            at += 1
        if at >= len(data):
            break
        op = data[at]
        at += 1
        modrm = op < 0x40 and op % 8 < 4 or 0x80 <= op <= 0x8F
        if modrm and at < len(data):
            mod, rm = data[at] >> 6, data[at] & 7
            at += 1 + (mod < 3 and rm == 4) + (1 if mod == 1 else 4 if mod == 2 or (mod == 0 and rm == 5) else 0)
        elif op in (0xE8, 0xE9) or 0xB8 <= op <= 0xBF:
            at += 4
        elif 0x70 <= op <= 0x7F or op == 0xEB:
            at += 1
        yield start, op, modrm


def instructions(data: bytes) -> list[tuple[int, int, bool]]:
    """All that :func:`read_instructions` reads."""
    return list(read_instructions(data))


def instruction_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, instructions, with_modrm, prefixed) of (doc_id, text); no list of instructions is held."""
    for b in batches:
        own = []
        for text in b.column("text"):
            data = (text.as_py() or "").encode()
            n = modrms = prefixed = 0
            for at, _, modrm in read_instructions(data):
                n, modrms, prefixed = n + 1, modrms + modrm, prefixed + (data[at] in _PREFIXES)
            own.append((n, modrms, prefixed))
        yield pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()), *[pa.array([x[k] for x in own], pa.int64()) for k in range(3)]], ["doc_id", "instructions", "with_modrm", "prefixed"])


@query("instruction_parse", "G10 G10b")
def instruction_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents' bytes read as instructions: how many, and how many with ModRM."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").mapInArrow(instruction_counts, "doc_id long, instructions long, with_modrm long, prefixed long")
