"""Entry points: encode documents to an archive table, read it back, report.

An archive is a Parquet folder of rows (doc_id, flag, payload, n_bytes); payloads are
whole encoded texts.  ``analyze``, ``encode``, ``decode`` and ``segment`` are the
engine's modes.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import QUERIES, query, table

ARCHIVE = "doc_id long, flag int, payload binary, n_bytes long, dictionary long, digest string"


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text) of Parquet, or of any folder of files, each one a document."""
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.xxhash64("path").alias("doc_id"), F.decode("content", "UTF-8").alias("text"))


def encode(docs: DataFrame, gain: int = 50, dictionary: bytes = b"") -> DataFrame:
    """Archive rows of (doc_id, text): flag 1 if compressing saves ``gain`` bytes, else the bytes as they are.

    With a ``dictionary``, texts are compressed against it; its checksum (0 for none) and each
    text's digest go along.  A null text is kept as null with flag -1.
    """
    known = zlib.crc32(dictionary) if dictionary else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for text in b.column("text").to_pylist():
                if text is None:
                    rows.append((-1, None, 0))
                    continue
                raw = text.encode()
                packer = zlib.compressobj(6, zdict=dictionary) if dictionary else zlib.compressobj(6)
                small = packer.compress(raw) + packer.flush()
                rows.append((1, small, len(raw)) if len(small) <= len(raw) - gain else (0, raw, len(raw)))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64()), pa.array([known] * len(rows), pa.int64()), b.column("digest")],
                ["doc_id", "flag", "payload", "n_bytes", "dictionary", "digest"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.md5("text").alias("digest")).mapInArrow(run, ARCHIVE)


def decode(archive: DataFrame, dictionary: bytes = b"") -> DataFrame:
    """(doc_id, text, digest) of archive rows.

    Raises on a row whose length isn't the recorded one, and on rows made with another
    dictionary, or with one where none is given, or without one where there is one.
    """
    known = zlib.crc32(dictionary) if dictionary else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for flag, payload, n, made in zip(*(b.column(c).to_pylist() for c in ("flag", "payload", "n_bytes", "dictionary"))):
                if made != known:
                    raise ValueError("an archive made with another dictionary")
                opener = zlib.decompressobj(zdict=dictionary) if dictionary else zlib.decompressobj()
                raw = None if flag < 0 else opener.decompress(payload) + opener.flush() if flag else payload
                if raw is not None and len(raw) != n:
                    raise ValueError("an archive row of another length than recorded")
                out.append(None if raw is None else raw.decode())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string()), b.column("digest")], ["doc_id", "text", "digest"])

    return archive.mapInArrow(run, "doc_id long, text string, digest string")


def analyze(spark: SparkSession, sf_dir: str, name: str = "entropy_order0") -> DataFrame:
    """Any registered query by name."""
    return QUERIES[name](spark, sf_dir)


def segment(docs: DataFrame, size: int) -> DataFrame:
    """Pieces of at most ``size`` symbols: (doc_id, seg_no, segment)."""
    each = docs.select("doc_id", "text", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length("text") / size).cast("int") - 1))).alias("seg_no"))
    return each.select("doc_id", "seg_no", F.expr(f"substr(text, seg_no * {size} + 1, {size})").alias("segment"))


@query("archive_roundtrip", "IO1 IO3 IO4 IO5", "SELECT doc_id, cast(octet_length(encode(text)) AS BIGINT) AS n_bytes, true AS same FROM documents")
def archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents through the archive and back, held against the digests that went along."""
    dictionary = b" the of and to in that is was for with as on by"
    back = decode(encode(table(spark, sf_dir, "documents").select("doc_id", "text"), dictionary=dictionary), dictionary)
    return back.select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").eqNullSafe(F.col("digest")).alias("same"))


@query("segment_rejoin", "IO8 M2", "SELECT doc_id, greatest(1, cast(ceil(length(text) / 4096.0) AS BIGINT)) AS segments, md5(text) AS digest FROM documents")
def segment_rejoin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut into segments and put together again."""
    own = segment(table(spark, sf_dir, "documents"), 4096)
    joined = own.groupBy("doc_id").agg(F.count("*").alias("segments"), F.array_sort(F.collect_list(F.struct("seg_no", "segment"))).alias("s"))
    return joined.select("doc_id", "segments", F.md5(F.array_join(F.col("s.segment"), "").cast("binary")).alias("digest"))
