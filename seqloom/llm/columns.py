"""Texts as byte arrays: what the vectorised operators share.

Operators here run in ``mapInArrow``.  A block of rows becomes one contiguous
byte array with offsets, work is done on whole blocks with numpy, and equal
words are found by Arrow's exact dictionary encoding.  Blocks hold at most
``BLOCK_BYTES`` of text (a longer single text is a block of its own), which
bounds the memory of a Python worker whatever the partition holds.
"""

from __future__ import annotations

import atexit
import ctypes
import os
import shutil
import tempfile
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import SparkSession

BLOCK_BYTES = 2 << 20

#: Spark's own defaults hold 10,000 rows or 64 MB of an Arrow batch, and 4,096 rows of a Parquet file, in each task at once
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": str(BLOCK_BYTES), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the session; a temporary one only where none is set and all runs on this machine."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
    own = tempfile.mkdtemp(prefix="seqloom-")
    atexit.register(shutil.rmtree, own, True)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def stored(df, name: str, narrow: bool = False, bucket: str | None = None):
    """Write ``df`` to a table in the shared folder and read it back: cuts lineage and
    survives lost executors.

    ``narrow`` rows go to four files a core at most.  With ``bucket`` the rows are dealt
    by that column, so that joins on it don't move them again.
    """
    import uuid

    spark = df.sparkSession
    own = f"{name}-{uuid.uuid4().hex}"
    path = f"{checkpoint_dir(spark).rstrip('/')}/{own}"
    if bucket:
        n = int(spark.conf.get("spark.sql.shuffle.partitions"))
        table = own.replace("-", "_")
        df.repartition(n, bucket).write.bucketBy(n, bucket).sortBy(bucket).option("path", path).saveAsTable(table)
        out = spark.table(table)
        out.schema  # resolved, so the name can go; the files stay
        spark.sql(f"DROP TABLE {table}")
    else:
        (df.coalesce(4 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
        out = spark.read.schema(df.schema).parquet(path)
    SCRATCH.append(path)
    return out


#: folders that :func:`stored` has made and nobody has dropped
SCRATCH: list[str] = []


def drop_stored(spark: SparkSession, since: int = 0, keep: int = 0) -> None:
    """Delete the folders made after the first ``since``, but for the last ``keep``: what read them has been written."""
    gone = SCRATCH[since : len(SCRATCH) - keep]
    conf = spark._jsc.hadoopConfiguration()
    for path in gone:
        own = spark._jvm.org.apache.hadoop.fs.Path(path)
        own.getFileSystem(conf).delete(own, True)
        SCRATCH.remove(path)


def small_batches(spark: SparkSession) -> list[str]:
    """Have Spark move rows in batches no larger than a block, where the session doesn't say how; returns the settings made.

    Whole texts make batches of tens of MB else, in the executor's JVM and again in its
    workers, and the JVM returns little of that.  Only the batches differ, never the rows.
    """
    made = [key for key in BATCHES if spark.conf.get(key, None) is None]
    for key in made:
        spark.conf.set(key, BATCHES[key])
    return made


def texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = column.buffers()
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def give_back() -> None:
    """Return freed memory to the system: workers outlive their tasks, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # another libc
        pass


def blocks(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in blocks of at most ``limit`` bytes of ``column``, or one row."""
    give_back()  # what the worker's task before this one has freed since
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = texts(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
            end = min(batch.num_rows, max(at + 1, end))
            yield batch.slice(at, end - at)
            at = end
    give_back()


def spans(mask: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True, cut at document offsets."""
    n = len(mask)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = mask.copy()
    first[1:] &= ~mask[:-1]
    cut = offsets[:-1][offsets[:-1] < n]
    first[cut] = mask[cut]
    last = mask.copy()
    last[:-1] &= ~mask[1:]
    ends = offsets[1:][offsets[1:] > 0] - 1
    last[ends] = mask[ends]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Words of every document of a block.

    ``table`` maps each byte to the byte that stands for it inside words, or to 0
    for a separator.  Returns the dictionary code of every word, the dictionary
    (binary), each document's first word (one more entry at the end), and each
    word's start byte.
    """
    mapped = table[data]
    mask = mapped != 0
    starts, ends = spans(mask, offsets)
    doc = np.searchsorted(starts, offsets)
    if len(starts) == 0:
        return np.zeros(0, np.int32), pa.array([], pa.large_binary()), doc, starts
    kept = np.ascontiguousarray(mapped[mask])
    bounds = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=bounds[1:])
    coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(kept)]).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, doc, starts


def hash_words(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each dictionary entry, the same in every process."""
    import xxhash

    return np.fromiter((xxhash.xxh64_intdigest(x) for x in dictionary.to_pylist()), np.uint64, len(dictionary))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (murmur style) over uint64 values."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def fold_table(word: Iterable[int]) -> np.ndarray:
    """Byte table for :func:`words`: bytes of ``word`` kept, A-Z lower-cased, others separators."""
    table = np.zeros(256, np.uint8)
    for b in word:
        table[b] = b + 32 if 65 <= b <= 90 else b
    return table


def cpus_one() -> None:
    """Keep numeric libraries to one thread inside a task."""
    for key in ("OMP_NUM_THREADS", "OPENBLAS_NUM_THREADS", "MKL_NUM_THREADS"):
        os.environ.setdefault(key, "1")
