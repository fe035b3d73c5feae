"""Media columns: texts stored as lossless WebP samples and read back."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import webp
from seqloom.llm.columns import blocks, texts

ROW = webp.WIDTH
STRIP = webp.WIDTH * webp.FRAME_ROWS
SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def payload(text: bytes) -> bytes:
    """The text with spaces up to a positive multiple of a row."""
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW)


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """A WebP file of each payload (a positive multiple of 192 bytes long)."""
    pieces = [p[i : i + STRIP] for p in payloads for i in range(0, len(p), STRIP)]
    bounds = np.concatenate([[0], np.cumsum([len(p) for p in pieces], dtype=np.int64)])
    streams = webp.encode_frames(np.frombuffer(b"".join(pieces), np.uint8), bounds)
    files, at = [], 0
    for p in payloads:
        n = -(-len(p) // STRIP)
        files.append(webp.container(streams[at : at + n], [len(x) // ROW for x in pieces[at : at + n]]))
        at += n
    return files


def decode_payloads(files: list[bytes]) -> list[bytes]:
    """The samples of each file, row by row, frame after frame."""
    streams = [webp.streams_of(f) for f in files]
    frames = iter(webp.decode_frames([s for own in streams for s in own]))
    return [b"".join(next(frames).tobytes() for _ in own) for own in streams]


def features(samples: bytes) -> str:
    """Rows, mean sample, mean step along a row and a 64-bit map of bright columns."""
    x = np.frombuffer(samples, np.uint8).reshape(-1, ROW)
    steps = np.abs(np.diff(x.view(np.int8), axis=1)).view(np.uint8) if len(x) else np.zeros((0, ROW - 1), np.uint8)
    wide = x.reshape(len(x), 64, 3).sum((0, 2), dtype=np.int64)
    bright = int.from_bytes(np.packbits(wide * 64 > wide.sum()).tobytes(), "big")
    return f"rows={len(x)};mean={int(x.sum(dtype=np.int64)) * 1000 // x.size};step={int(steps.sum(dtype=np.int64)) * 1000 // max(1, steps.size)};map={bright:016x}"


def media_rows(ids: list, raw: list[bytes]) -> dict[str, list]:
    """The digest columns of a block; equal texts are stored once."""
    first: dict[bytes, int] = {}
    which = [first.setdefault(t, len(first)) for t in raw]
    padded = [payload(t) for t in first]
    files = encode_payloads(padded)
    rows = []
    for text, file, back in zip(first, files, decode_payloads(files), strict=True):
        rows.append((len(text), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(file), hashlib.sha256(file).hexdigest(), features(back)))
    names = ("n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
    return {"doc_id": ids} | {n: [rows[w][k] for w in which] for k, n in enumerate(names)}


def media_column(docs: DataFrame) -> DataFrame:
    """Store every whole text of ``docs`` (doc_id, text) as WebP, read it back, describe it.

    A null text is stored as an empty one (one row of spaces).  Rows stay apart
    even if they repeat; other columns are ignored.  An empty table gives an
    empty table.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
        for b in blocks(batches, limit=2 << 20):
            data, offsets = texts(b.column("text"))
            raw = data.tobytes()
            own = [raw[i:j] for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            yield pa.RecordBatch.from_pydict(media_rows(b.column("doc_id").to_pylist(), own), schema)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)


def op1_media_webp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_column(spark.read.parquet(f"{sf_dir}/documents.parquet"))
