"""Documents as arrays of symbols: what per-symbol operators do without a row for each symbol.

A block of whole documents becomes one array of code points, worked on with numpy where
the rows are read; nothing is shuffled but what a block has counted.  Blocks hold at most
``BLOCK_CHARS`` symbols, or one document, which bounds a worker's memory.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.plans.registry import table

BLOCK_CHARS = 2 << 20


def _blocks(column: pa.Array, size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Beginnings and ends of the blocks of rows whose sizes come to at most ``BLOCK_CHARS``, or of one row."""
    total = np.cumsum(size)
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(total, BLOCK_CHARS + (total[at - 1] if at else 0), "right")))
        yield at, end
        at = end


def symbol_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows with a text, their code points one after the other, and where each text's begin."""
    for batch in batches:
        batch = batch.filter(batch.column("text").is_valid())
        text = batch.column("text")
        size = pc.utf8_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end in _blocks(text, size):
            cp = np.frombuffer("".join(text.slice(at, end - at).to_pylist()).encode("utf-32-le", "surrogatepass"), "<u4")
            yield batch.slice(at, end - at), cp, np.concatenate([[0], np.cumsum(size[at:end])])


def byte_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """The same with each text's UTF-8 bytes."""
    for batch in batches:
        batch = batch.filter(batch.column("text").is_valid())
        text = batch.column("text").cast(pa.binary())
        size = pc.binary_length(text).to_numpy(zero_copy_only=False).astype(np.int64)
        for at, end in _blocks(text, size):
            data = np.frombuffer(b"".join(text.slice(at, end - at).to_pylist()), np.uint8)
            yield batch.slice(at, end - at), data, np.concatenate([[0], np.cumsum(size[at:end])])


def map_symbols(docs: DataFrame, work: Callable, schema: str, *keep: str, blocks: Callable = symbol_blocks) -> DataFrame:
    """``work(rows, code points, begins)`` of every block of ``docs`` (``keep``, text), a dictionary of columns each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, cp, first in blocks(batches):
            out = work(rows, cp, first)
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in out.values()], list(out))

    return docs.select(*keep, "text").mapInArrow(run, schema)


def map_bytes(docs: DataFrame, work: Callable, schema: str, *keep: str) -> DataFrame:
    """:func:`map_symbols` over UTF-8 bytes."""
    return map_symbols(docs, work, schema, *keep, blocks=byte_blocks)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents table, its key as a long."""
    return table(spark, sf_dir, "documents").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def places(first: np.ndarray) -> np.ndarray:
    """Each symbol's place in its text."""
    return np.arange(first[-1]) - np.repeat(first[:-1], np.diff(first))


def last_before(marked: np.ndarray, first: np.ndarray) -> np.ndarray:
    """For each symbol the place in its text of the last marked one before it, or -1."""
    begin = np.repeat(first[:-1], np.diff(first))
    last = np.full(len(marked), -1, np.int64)
    last[1:] = np.maximum.accumulate(np.where(marked, np.arange(len(marked)), -1))[:-1]
    return np.where(last >= begin, last - begin, -1)


def per_text(rows: pa.RecordBatch, on: np.ndarray, **columns: np.ndarray) -> dict:
    """The texts that are ``on``, by doc_id, with their values."""
    return {"doc_id": rows.column("doc_id").filter(pa.array(on))} | {k: v[on] for k, v in columns.items()}


def owner(first: np.ndarray) -> np.ndarray:
    """The text that each symbol is of."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    return np.bincount(owner(first), weights=values, minlength=len(first) - 1)


def contexts(cp: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Places that have ``order`` symbols before them in their text, and a number for those symbols, exact."""
    kinds, codes = np.unique(cp, return_inverse=True)
    width = max(1, int(len(kinds) - 1).bit_length())
    at = np.flatnonzero(np.arange(len(cp)) - np.repeat(first[:-1], np.diff(first)) >= order)
    key, bits = np.zeros(len(at), np.int64), 0
    for k in range(order, 0, -1):
        if bits + width > 62:  # so many that they don't fit: number those that occur
            some, key = np.unique(key, return_inverse=True)
            bits = max(1, int(len(some)).bit_length())
        key = key << width | codes[at - k]
        bits += width
    return at, key


def before(at: np.ndarray, key: np.ndarray, of: np.ndarray) -> np.ndarray:
    """For each place the last earlier one of equal key in its text, or -1; ``of`` is each place's text."""
    order = np.argsort(key, kind="stable")
    same = (key[order[1:]] == key[order[:-1]]) & (of[order[1:]] == of[order[:-1]])
    out = np.full(len(at), -1, np.int64)
    out[order[1:][same]] = at[order[:-1][same]]
    return out


def counted(columns: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of non-negative integer columns, and how often each occurs."""
    key, bits, widths = np.zeros(len(columns[0]), np.int64), 0, []
    for c in columns:
        widths.append(max(1, int(c.max()).bit_length()) if len(c) else 1)
        bits += widths[-1]
    if bits > 62:
        rows, n = np.unique(np.stack(columns, 1), axis=0, return_counts=True)
        return list(rows.T), n
    for c, w in zip(columns, widths):
        key = key << w | c.astype(np.int64)
    found, n = np.unique(key, return_counts=True)
    out = []
    for w in reversed(widths):
        out.append(found & ((1 << w) - 1))
        found = found >> w
    return out[::-1], n


def symbols_of(codes: np.ndarray) -> pa.Array:
    """Code points as one-symbol strings; 0 as null (a text's NUL is code 0x110000)."""
    kinds, which = np.unique(codes, return_inverse=True)
    names = pa.array([None if c == 0 else "\0" if c == NUL else chr(c) for c in kinds.tolist()], pa.string())
    return names.take(pa.array(which))


NUL = 0x110000


def shown(cp: np.ndarray) -> np.ndarray:
    """Code points for :func:`symbols_of`: 0 is free to stand for none."""
    return np.where(cp == 0, NUL, cp).astype(np.int64)
