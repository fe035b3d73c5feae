"""Benchmark decontamination with a distributed positional inverted index.

:func:`build_index` stores the postings of every token of a table: one row per
segment (a block of documents), in which the positions of each term follow each
other in order of term and position.  :func:`search_windows` looks phrases up in
every segment: it takes the postings of a phrase's rarest term, moves them by the
term's offset, and intersects them with those of the other terms, the rarer
first.  :func:`search_near` finds terms that stand near each other in the same way.

The test side is the benchmark's windows, a table of term hashes that Spark makes.
It is searched in blocks of a bounded number of windows (``BLOCK_WINDOWS``), one at a
time, so the driver and the tasks hold one block whatever the benchmark's size; a
benchmark of several blocks takes as many passes over the index.  Each pass writes the
runs of words that it hits, and the passes' runs are put together per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import SCRATCH, blocks, drop_stored, fold_table, hash_words, stored, texts, words

WINDOW = 8
CONTAMINATED = 2  # items
BLOCK_WINDOWS = 100_000
SEGMENT = 4 << 20  # bytes of text
TABLE = fold_table([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)])
INDEX_SCHEMA = "segment long, doc_ids array<long>, n_words binary, terms binary, first binary, positions binary"
GAP = 1  # positions between documents, so that no phrase runs from one to the next


def _order(codes: np.ndarray) -> np.ndarray:
    """A stable argsort of int32 codes by two passes over 16 bits."""
    low = np.argsort((codes & 0xFFFF).astype(np.uint16), kind="stable")
    if not len(codes) or codes.max() < 65536:
        return low
    return low[np.argsort((codes >> 16).astype(np.uint16)[low], kind="stable")]


class Segment:
    """Postings of a block: ``positions[first[t]:first[t + 1]]`` of ``terms[t]``."""

    def __init__(self, terms: np.ndarray, first: np.ndarray, positions: np.ndarray, n_words: np.ndarray):
        self.terms, self.first, self.positions, self.n_words = terms, first, positions, n_words
        n = np.concatenate([[0], np.cumsum(n_words.astype(np.int64))])
        #: position of each document's first word, and one past the last
        self.doc_at = n + GAP * np.arange(len(n))
        self.span = int(self.doc_at[-1]) + 1
        self._keys: np.ndarray | None = None

    @classmethod
    def build(cls, data: np.ndarray, offsets: np.ndarray) -> Segment:
        codes, dictionary, doc, _ = words(data, offsets, TABLE)
        n_words = np.diff(doc).astype(np.int32)
        hashes = hash_words(dictionary)
        rank = np.argsort(hashes)
        place = np.empty(len(rank), np.int32)
        place[rank] = np.arange(len(rank), dtype=np.int32)
        codes = place[codes] if len(codes) else codes.astype(np.int32)
        order = _order(codes)
        at = np.arange(len(codes), dtype=np.int64) + GAP * np.repeat(np.arange(len(n_words)), n_words)
        first = np.concatenate([[0], np.cumsum(np.bincount(codes, minlength=len(rank)))]).astype(np.int32)
        return cls(hashes[rank], first, at[order].astype(np.int32), n_words)

    def row(self) -> dict[str, bytes]:
        """As columns; positions as differences within a term."""
        gaps = np.diff(self.positions, prepend=np.int32(0)).astype(np.int32)
        heads = self.first[:-1]
        gaps[heads] = self.positions[heads]
        return {"n_words": self.n_words.astype("<i4").tobytes(), "terms": self.terms.astype("<u8").tobytes(), "first": self.first.astype("<i4").tobytes(), "positions": gaps.astype("<i4").tobytes()}

    @classmethod
    def of_row(cls, row: dict[str, bytes]) -> Segment:
        first = np.frombuffer(row["first"], "<i4")
        gaps = np.frombuffer(row["positions"], "<i4").astype(np.int64)
        run = np.cumsum(gaps)
        heads = first[:-1]
        before = np.zeros(len(gaps), np.int64)
        if len(heads):
            before = np.repeat(run[heads] - gaps[heads], np.diff(first))
        return cls(np.frombuffer(row["terms"], "<u8"), first, (run - before).astype(np.int32), np.frombuffer(row["n_words"], "<i4"))

    def lookup(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each term here, or -1."""
        if not len(self.terms):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.terms, hashes), len(self.terms) - 1)
        return np.where(self.terms[at] == hashes, at, -1)

    def _has(self, term: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each term stands at each position."""
        if self._keys is None:
            self._keys = np.repeat(np.arange(len(self.terms), dtype=np.int64) * self.span, np.diff(self.first)) + self.positions
        key = term * self.span + position
        at = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        return (self._keys[at] == key) & (position >= 0)

    def phrases(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Exact matches of windows (rows of term numbers of :meth:`lookup`): window and first position."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        live = np.flatnonzero((windows >= 0).all(1))
        if not len(live) or not windows.shape[1]:
            return none
        own = windows[live]
        size = np.diff(self.first)[own]
        by = np.argsort(size, axis=1, kind="stable")  # the rarest first
        rarest = np.take_along_axis(own, by[:, :1], 1)[:, 0]
        n = np.take_along_axis(size, by[:, :1], 1)[:, 0]
        found_w, found_p = [], []
        # blocks of windows, so that the candidates of common words stay bounded
        cuts = np.searchsorted(np.cumsum(n), np.arange(1 << 20, int(n.sum()) + (1 << 20), 1 << 20), "right")
        begin = 0
        for end in [*cuts.tolist(), len(live)]:
            end = max(end, begin + 1)
            if begin >= len(live):
                break
            part = slice(begin, min(end, len(live)))
            begin = part.stop
            k = n[part]
            which = np.repeat(np.arange(part.start, part.stop), k)
            start = np.repeat(self.first[rarest[part]] - (np.cumsum(k) - k), k) + np.arange(int(k.sum()))
            at = self.positions[start].astype(np.int64) - by[which, 0]
            for r in range(1, own.shape[1]):
                offset = by[which, r]
                on = self._has(own[which, offset], at + offset)
                which, at = which[on], at[on]
                if not len(which):
                    break
            found_w.append(live[which])
            found_p.append(at)
        return (np.concatenate(found_w), np.concatenate(found_p)) if found_w else none

    def near(self, terms: np.ndarray, slop: int) -> np.ndarray:
        """Positions of the rarest term that have every term within ``slop`` words, in any order."""
        if not len(terms) or (terms < 0).any():
            return np.zeros(0, np.int64)
        lists = sorted((self.positions[self.first[t] : self.first[t + 1]].astype(np.int64) for t in np.unique(terms)), key=len)
        at = lists[0]
        doc = np.searchsorted(self.doc_at, at, "right")
        low = np.maximum(at - slop, self.doc_at[doc - 1])
        high = np.minimum(at + slop, self.doc_at[doc] - GAP - 1)
        on = np.ones(len(at), bool)
        for other in lists[1:]:
            i = np.searchsorted(other, low)
            on &= (i < len(other)) & (other[np.minimum(i, len(other) - 1)] <= high)
        return at[on]

    def docs_of(self, positions: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_at, positions, "right") - 1


def window_table(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The windows (item, terms) of a benchmark (item_id, text), terms as hashes; a null id reads as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            codes, dictionary, doc, _ = words(*texts(b.column("text")), TABLE)
            hashes = hash_words(dictionary).view(np.int64)[codes] if len(codes) else np.zeros(0, np.int64)
            for item, i, j in zip(b.column("item").to_pylist(), doc[:-1].tolist(), doc[1:].tolist()):
                if i < j:
                    rows = np.lib.stride_tricks.sliding_window_view(hashes[i:j], min(window, j - i))
                    for at in range(0, len(rows), 10_000):
                        part = rows[at : at + 10_000]
                        offsets = pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1])
                        yield pa.RecordBatch.from_arrays([pa.array([item] * len(part), pa.string()), pa.ListArray.from_arrays(offsets, pa.array(part.ravel()))], ["item", "terms"])

    own = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    return own.mapInArrow(run, "item string, terms array<long>").distinct()


def window_blocks(table: DataFrame, most: int = BLOCK_WINDOWS) -> Iterator[Windows]:
    """A stored table of windows in blocks of about ``most``, one held at a time; an empty one gives one empty block.

    Blocks are dealt by window and item, so a window of very many items is in many of them.
    """
    k = max(1, -(-table.count() // most))
    for i in range(k):
        own = table if k == 1 else table.where(F.expr(f"pmod(xxhash64(item, terms), {k}) = {i}"))
        rows = own.toArrow()
        yield Windows(list(zip(rows.column("item").to_pylist(), rows.column("terms").to_pylist())))


class Windows:
    """A block of windows (item, hashes of its terms)."""

    def __init__(self, rows: list[tuple[str, list[int]]]):
        owners: dict[tuple[int, ...], set[str]] = {}
        for item, terms in rows:
            owners.setdefault(tuple(terms), set()).add(item)
        vocabulary = sorted({t for terms in owners for t in terms})
        number = {t: i for i, t in enumerate(vocabulary)}
        self.hashes = np.array(vocabulary, np.int64).view(np.uint64)
        self.groups = []  # windows of one length, and their items
        for n in sorted({len(terms) for terms in owners}):
            own = [terms for terms in owners if len(terms) == n]
            self.groups.append((n, np.array([[number[t] for t in terms] for terms in own], np.int64), [sorted(owners[terms]) for terms in own]))

    def search(self, segment: Segment) -> tuple[np.ndarray, dict[int, set[str]]]:
        """Which positions of a segment are hit, and the items found in each document."""
        longest = max((n for n, *_ in self.groups), default=0)
        hit = np.zeros(segment.span + longest + 1, np.int32)
        items: dict[int, set[str]] = {}
        here = segment.lookup(self.hashes)
        for n, rows, owners in self.groups:
            which, at = segment.phrases(here[rows])
            np.add.at(hit, at, 1)
            np.add.at(hit, at + n, -1)
            for d, w in zip(segment.docs_of(at).tolist(), which.tolist()):
                items.setdefault(d, set()).update(owners[w])
        return np.cumsum(hit)[: segment.span] > 0, items


def build_index(docs: DataFrame) -> DataFrame:
    """One row of postings per segment of ``docs`` (doc_id, text), every token of every row.

    ``segment`` is unique: the running id of its first row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=SEGMENT):
            row = Segment.build(*texts(b.column("text"))).row()
            columns = {"segment": [b.column("segment")[0].as_py()], "doc_ids": [b.column("doc_id").to_pylist()]} | {k: [v] for k, v in row.items()}
            yield pa.RecordBatch.from_pydict(columns, pa.schema([("segment", pa.int64()), ("doc_ids", pa.list_(pa.int64()))] + [(k, pa.binary()) for k in row]))

    return docs.select(F.monotonically_increasing_id().alias("segment"), F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, INDEX_SCHEMA)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list, Segment]]:
    for b in batches:
        for i in range(b.num_rows):
            row = {k: b.column(k)[i].as_py() for k in b.schema.names}
            yield row.pop("segment"), row.pop("doc_ids"), Segment.of_row(row)


def _hits(index: DataFrame, own: Windows) -> DataFrame:
    """The documents (segment, doc) in which windows occur: the runs of words inside them, and the items."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
        schema = pa.schema([("segment", pa.int64()), ("doc", pa.int32()), ("runs", pairs), ("items", pa.list_(pa.string()))])
        for name, _, s in _segments(batches):
            hit, items = own.search(s)
            found = sorted(items)
            runs = []
            for d in found:
                edge = np.flatnonzero(np.diff(np.concatenate([[False], hit[s.doc_at[d] : s.doc_at[d + 1] - GAP], [False]]).astype(np.int8)))
                runs.append([{"begin": i, "end": j} for i, j in edge.reshape(-1, 2).tolist()])
            if found:
                yield pa.RecordBatch.from_pydict({"segment": [name] * len(found), "doc": found, "runs": runs, "items": [sorted(items[d]) for d in found]}, schema)

    return index.mapInArrow(run, "segment long, doc int, runs array<struct<begin:long,end:long>>, items array<string>")


#: words in the union of runs: sorted by begin, each adds what lies past the ends so far
_UNION = "aggregate(array_sort(flatten(collect_list(runs))), named_struct('n', 0L, 'at', 0L), (s, r) -> named_struct('n', s.n + greatest(0L, r.end - greatest(r.begin, s.at)), 'at', greatest(s.at, r.end)), s -> s.n)"


def search_windows(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Every document of a stored index with the words and items found in it; the searches run at once.

    One row for each row indexed, whatever the number of passes.
    """
    since = len(SCRATCH)
    table = stored(window_table(benchmark, window), "windows", True)
    passes = [stored(_hits(index, own), "hits", True) for own in window_blocks(table, block_windows)]
    found = passes[0]
    for more in passes[1:]:
        found = found.unionByName(more)
    once = found.groupBy("segment", "doc").agg(F.expr(_UNION).alias("n_hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = stored(once.select("segment", "doc", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256")), "found", True)
    drop_stored(index.sparkSession, since, keep=1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n = np.frombuffer(b.column("n_words")[i].as_py(), "<i4").astype(np.int64)
                yield pa.RecordBatch.from_pydict({"segment": [b.column("segment")[i].as_py()] * len(n), "doc": np.arange(len(n), dtype=np.int32), "doc_id": b.column("doc_ids")[i].as_py(), "n_words": n}, pa.schema([("segment", pa.int64()), ("doc", pa.int32()), ("doc_id", pa.int64()), ("n_words", pa.int64())]))

    rows = index.select("segment", "doc_ids", "n_words").mapInArrow(count, "segment long, doc int, doc_id long, n_words long")
    n_items = F.coalesce("n_items", F.lit(0).cast("long"))
    return rows.join(hits, ["segment", "doc"], "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), n_items.alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), (n_items >= CONTAMINATED).alias("contaminated")
    )


def search_near(index: DataFrame, queries: DataFrame, slop: int, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """Proximity matches of ``queries`` (item_id, text) in an index: item, segment, doc, doc_id and position.

    A position is where the rarest of a query's words stands in the document, with every
    other one at most ``slop`` words away, in any order.  A query without words matches nothing.
    """
    table = stored(window_table(queries, 1 << 30), "queries", True)
    found = None
    for own in window_blocks(table, block_windows):

        def run(batches: Iterator[pa.RecordBatch], own: Windows = own) -> Iterator[pa.RecordBatch]:
            for name, ids, s in _segments(batches):
                here = s.lookup(own.hashes)
                rows = []
                for _, terms, owners in own.groups:
                    for row, items in zip(here[terms], owners):
                        at = s.near(row, slop)
                        for p, d in zip(at.tolist(), s.docs_of(at).tolist()):
                            rows += [(item, name, d, ids[d], p - int(s.doc_at[d])) for item in items]
                for at in range(0, len(rows), 10_000):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[at : at + 10_000]), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["item", "segment", "doc", "doc_id", "position"])

        each = stored(index.mapInArrow(run, "item string, segment long, doc int, doc_id long, position long"), "near")
        found = each if found is None else found.unionByName(each)
    return found


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """For every row of ``docs`` (doc_id, text): words, words inside a benchmark window, items found.

    The index is written to the shared folder, searched there and dropped.  A null or empty
    text has no words.  Repeated rows are rows of their own; repeated item ids
    count once; an empty benchmark finds nothing; other columns are ignored.
    """
    since = len(SCRATCH)
    index = stored(build_index(docs), "postings")
    found = stored(search_windows(index, benchmark, block_windows=block_windows), "matches")
    drop_stored(docs.sparkSession, since, keep=1)
    return found


def keep_clean(docs: DataFrame, benchmark: DataFrame, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The rows of ``docs`` in which no benchmark window occurs, with their columns.

    Each block of documents is indexed and searched where it is read; nothing is shuffled.
    What a block of windows leaves is written before the next one is looked for.
    """
    since = len(SCRATCH)
    found, last = None, None
    for own in window_blocks(stored(window_table(benchmark), "windows", True), block_windows):
        if found is not None:
            last = stored(found, "clean")

        def run(batches: Iterator[pa.RecordBatch], own: Windows = own) -> Iterator[pa.RecordBatch]:
            for b in blocks(batches):
                _, dirty = own.search(Segment.build(*texts(b.column("text"))))
                if len(dirty) < b.num_rows:
                    yield b.filter(pa.array([d not in dirty for d in range(b.num_rows)]))

        found = (docs if last is None else last).mapInArrow(run, docs.schema)
    drop_stored(docs.sparkSession, since, keep=0 if last is None else 1)
    return found


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM documents
), b AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM benchmark
), bw AS (
  SELECT DISTINCT item_id, least(8, len(ws)) AS m, array_to_string(ws[i:i + least(8, len(ws)) - 1], ' ') AS win
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 7, 1) + 1)) AS i FROM b WHERE len(ws) > 0)
), dw AS (
  SELECT doc_id, i, m, array_to_string(ws[i:i + m - 1], ' ') AS win
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM bw) WHERE len(ws) >= m)
), hits AS (
  SELECT doc_id, i, dw.m, item_id FROM dw JOIN bw ON dw.win = bw.win AND dw.m = bw.m
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(items.n, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""
