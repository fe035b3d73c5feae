"""Near-duplicates by order MinHash, verified by banded alignment.

Words are runs of letters and digits with case folded.  A document's k-mers are
its five-word shingles, each labelled with its occurrence number.  One of
``SKETCHES`` hash functions picks the ``PICKED`` labelled k-mers of least value and
keeps them in text order, so a sketch agrees for texts that share k-mers in the
same order: it follows edit similarity.

Documents of one word sequence are one node, whatever their number.  Nodes that
share a sketch meet in a bucket.  First each member is compared with the bucket's
most central node (the one with most company over all its buckets, as the source of
many copies has), which joins most copies to classes.  Then rounds follow over the
buckets that still have several classes.  In a round every member names its most alike
partners of other classes that it hasn't been compared with (of two classes the smaller
one's members do), the pairs are verified, and classes with a link become one.  A
bucket is done once nobody in it has anyone left to name, so no pair that could join
two classes goes untried, while a round makes a few pairs a member, not all pairs.  Two
nodes that share several sketches meet in the bucket of the first one only.  How
alike two nodes are is first read from a short digest of their k-mers and, in the
buckets that go on, from a longer one; who can't reach the threshold, by ``MARGIN``
standard deviations of that estimate, isn't named.  Crowded buckets are dealt to parts,
and each two parts meet in a cell of bounded size.

A pair is a link if a banded alignment of the two word sequences keeps at least
``SIMILARITY`` of their shingles: kept / (all of either), a shingle being kept if its
five words are aligned in one run.  Classes are the connected components of links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import SCRATCH, blocks, drop_stored, fold_table, give_back, hash_words, mix, stored, texts, words

SHINGLE = 5
SKETCHES = 12
PICKED = 2
SIMILARITY = 0.8
BINS = 64  # of the digest of k-mers by which pairs are sifted before alignment
FINE = 512  # of the digest in buckets that go on
MARGIN = 4.0  # standard deviations under the threshold: 3 in 100,000 links could be missed in one bucket
PART = 4096  # members of a part of a bucket, expected; two parts are a cell
ROWS = 256  # of a cell that are held against all its other rows at once
BROADCAST_ROWS = 1 << 20  # numbers (8 MB) of rows to drop
NAMED = 2  # partners that a member names in the first round; four times as many in each further one
BAND = 16
CELLS = 8 << 20  # of an alignment batch
TABLE = fold_table([*range(0x30, 0x3A), *range(65, 91), *range(97, 123), *range(128, 256)])
SKETCHED = "rid long, doc_id long, digest binary, n_words int, sketch array<long>, bins binary, words binary"
_P = np.uint64(0x9E3779B97F4A7C15)


def folded(data: np.ndarray) -> np.ndarray:
    """Bytes with the capital Latin-1 letters (after byte C3) in lower case too."""
    data = data.copy()
    if len(data) > 1:
        own = data[1:]
        own[(data[:-1] == 0xC3) & (own >= 0x80) & (own <= 0x9E) & (own != 0x97)] += 0x20
    return data


def shingles(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mer hashes of every document and where each document's begin.

    h has the words' hashes; a document of fewer words than a shingle has one, of all
    its words.
    """
    n = np.diff(doc)
    count = np.where(n == 0, 0, np.maximum(1, n - SHINGLE + 1))
    first = np.concatenate([[0], np.cumsum(count)])
    of = np.repeat(np.arange(len(n)), count)
    at = doc[:-1][of] + np.arange(first[-1]) - first[:-1][of]
    value = np.zeros(len(at), np.uint64)
    padded = np.concatenate([h, np.zeros(SHINGLE, np.uint64)])
    inside = np.minimum(n[of], SHINGLE)
    for k in range(SHINGLE):
        value = value * _P + np.where(k < inside, padded[at + k], np.uint64(0))
    value = mix(value + inside.astype(np.uint64))
    # occurrence numbers within a document
    key = value ^ mix(of.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    own = key[order]
    fresh = np.ones(len(own), bool)
    fresh[1:] = own[1:] != own[:-1]
    if not fresh.all():
        run = np.arange(len(own)) - np.maximum.accumulate(np.where(fresh, np.arange(len(own)), 0))
        number = np.zeros(len(own), np.uint64)
        number[order] = run.astype(np.uint64)
        value = np.where(number > 0, mix(value + number * np.uint64(0xD6E8FEB86659FD93)), value)
    return value, first


def order_minhash(value: np.ndarray, first: np.ndarray, sketches: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """Sketches (documents, sketches); rows of documents without k-mers are 0."""
    n = len(first) - 1
    out = np.zeros((n, sketches), np.uint64)
    full = np.flatnonzero(np.diff(first) > 0)
    if not len(full):
        return out
    begin, count = first[:-1][full], np.diff(first)[full]
    rng = np.random.default_rng(20240229)
    far = np.uint64(0xFFFFFFFFFFFFFFFF)
    for j in range(sketches):
        odd, add = (np.uint64(x) for x in rng.integers(0, 1 << 63, 2, dtype=np.uint64))
        v = (value ^ add) * (odd | np.uint64(1))
        v ^= v >> np.uint64(29)
        places = np.full((len(full), picked), -1, np.int64)
        for k in range(picked):
            least = np.minimum.reduceat(v, begin)
            hit = np.flatnonzero(v == np.repeat(least, count))
            which = np.searchsorted(begin, hit, "right") - 1
            places[which[::-1], k] = hit[::-1]  # the first of equal ones
            places[least == far, k] = -1  # fewer k-mers than are picked
            v[places[places[:, k] >= 0, k]] = far
        places.sort(axis=1)  # back to text order
        sketch = np.zeros(len(full), np.uint64)
        for k in range(picked):
            sketch = mix(sketch * _P + np.where(places[:, k] >= 0, value[places[:, k]], np.uint64(0)) + np.uint64(j))
        out[full, j] = sketch
    return out


def binned(value: np.ndarray, first: np.ndarray, bins: int = BINS) -> np.ndarray:
    """One byte of the least k-mer of each of ``bins`` bins (documents, bins), 0 for an empty bin."""
    n = len(first) - 1
    h = mix(value * np.uint64(0xA24BAED4963EE407))
    of = np.repeat(np.arange(n), np.diff(first))
    far = np.uint64(0xFFFFFFFFFFFFFFFF)
    bits = np.uint64(bins.bit_length() - 1)
    least = np.full(n * bins, far)
    np.minimum.at(least, of * bins + (h >> (np.uint64(64) - bits)).astype(np.int64), h & ((np.uint64(1) << (np.uint64(64) - bits)) - np.uint64(1)))
    return np.where(least == far, 0, 1 + mix(least) % np.uint64(255)).astype(np.uint8).reshape(n, bins)


def floor_of(used: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """The least share of common bins, of ``used``, at which texts of na and nb shingles may be a link.

    The bins are a sample of the shingles of either, so the estimate's variance shrinks as
    they hold more of them.
    """
    every = np.maximum((na + nb) / (1 + SIMILARITY), 1.0)
    left = np.clip(1 - used / every, 0.25, 1.0)
    return SIMILARITY - MARGIN * np.sqrt(SIMILARITY * (1 - SIMILARITY) * left / np.maximum(used, 1))


def sketch_rows(docs: DataFrame) -> DataFrame:
    """Digest, sketches, bins and word sequence (16-bit hashes) of every row of (rid, doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for b in blocks(batches):
            data, offsets = texts(b.column("text"))
            codes, dictionary, doc, _ = words(folded(data), offsets, TABLE)
            h = hash_words(dictionary)[codes] if len(codes) else np.zeros(0, np.uint64)
            kmers = shingles(h, doc)
            sketch, bins = order_minhash(*kmers), [x.tobytes() for x in binned(*kmers)]
            raw, cut = h.tobytes(), (doc * 8).tolist()
            digests = [xxhash.xxh3_128_digest(raw[i:j]) for i, j in zip(cut[:-1], cut[1:])]
            short, cut = h.astype(np.uint16).tobytes(), (doc * 2).tolist()
            blobs = [short[i:j] for i, j in zip(cut[:-1], cut[1:])]
            n = np.diff(doc)
            size = np.where(n > 0, SKETCHES, 0)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(sketch[n > 0].ravel().view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("doc_id"), pa.array(digests, pa.binary()), pa.array(n.astype(np.int32)), lists, pa.array(bins, pa.binary()), pa.array(blobs, pa.binary())], ["rid", "doc_id", "digest", "n_words", "sketch", "bins", "words"])

    return docs.mapInArrow(run, SKETCHED)


# ---------------------------------------------------------------- alignment


def _kept(a: np.ndarray, b: np.ndarray, la: np.ndarray, lb: np.ndarray, tails: np.ndarray, heads: np.ndarray, band: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles kept by unit-cost alignments of rows of a (n, m) and b, and whether a path touched the band.

    Row r has la[r] and lb[r] words, already without a common head (heads[r] words)
    and tail.  Cell (i, c) of the band stands for word j = i + c - band of b.
    """
    n, m = a.shape
    width = 2 * band + 1
    far = np.int32(1 << 28)
    padded = np.full((n, m + width + 1), np.uint32(0xFFFFFFFF))
    padded[:, band : band + min(b.shape[1], m + band + 1)] = b[:, : m + band + 1]
    steps = np.arange(width, dtype=np.int32)
    cost = np.empty((m + 1, n, width), np.int32)
    j0 = steps - band
    cost[0] = np.where(j0 >= 0, j0, far)[None, :]
    cost[0][j0[None, :] > lb[:, None]] = far
    for i in range(1, m + 1):
        before = cost[i - 1]
        differ = padded[:, i - 1 : i - 1 + width] != a[:, i - 1 : i]
        row = before + differ
        j = i + steps - band
        row[:, j < 1] = far
        row[:, :-1] = np.minimum(row[:, :-1], before[:, 1:] + 1)
        row[:, j < 0] = far
        if 0 <= band - i:
            row[:, band - i] = i
        row -= steps
        np.minimum.accumulate(row, axis=1, out=row)
        row += steps
        row[j[None, :] > lb[:, None]] = far
        cost[i] = np.minimum(row, far)
    every = np.arange(n)
    i, j = la.astype(np.int64).copy(), lb.astype(np.int64).copy()
    run, kept, touched = tails.astype(np.int64).copy(), np.zeros(n, np.int64), np.zeros(n, bool)
    live = every[(i > 0) | (j > 0)]
    while len(live):
        x, y = i[live], j[live]
        c = y - x + band
        touched[live] |= (c <= 0) | (c >= width - 1)
        here = cost[x, live, np.clip(c, 0, width - 1)]
        both = (x > 0) & (y > 0)
        same = both & (a[live, np.maximum(x - 1, 0)] == b[live, np.maximum(y - 1, 0)])
        up = np.where((x > 0) & (c + 1 < width), cost[np.maximum(x - 1, 0), live, np.clip(c + 1, 0, width - 1)] + 1, far)
        over = np.where(both, cost[np.maximum(x - 1, 0), live, np.clip(c, 0, width - 1)] + ~same, far)
        diagonal = both & (over <= here)
        upward = ~diagonal & (x > 0) & (up <= here)
        match = diagonal & same
        run[live[match]] += 1
        ended = live[~match]
        kept[ended] += np.maximum(run[ended] - SHINGLE + 1, 0)
        run[ended] = 0
        i[live] = x - (diagonal | upward)
        j[live] = y - (diagonal | ~upward)
        stuck = (j[live] < 0) | (i[live] < 0)
        i[live[stuck]] = j[live[stuck]] = 0
        live = live[(i[live] > 0) | (j[live] > 0)]
    run += heads
    kept += np.maximum(run - SHINGLE + 1, 0)
    return kept, touched


def similarities(pairs: list[tuple[np.ndarray, np.ndarray]], least: float = SIMILARITY) -> np.ndarray:
    """Kept shingles / (all of either) of pairs of word sequences, by banded alignment.

    Bands begin at BAND words beside the difference in length and double while a pair
    under ``least`` has a path along the edge, up to what any pair of that similarity
    needs.
    """
    out = np.zeros(len(pairs))
    todo = []
    for k, (a, b) in enumerate(pairs):
        la, lb = len(a), len(b)
        na, nb = max(1, la - SHINGLE + 1), max(1, lb - SHINGLE + 1)
        if min(na, nb) < least * max(na, nb) or not la or not lb:
            continue
        m = min(la, lb)
        differ = np.flatnonzero(a[:m] != b[:m])
        head = int(differ[0]) if len(differ) else m
        tail_room = m - head
        differ = np.flatnonzero(a[la - tail_room :][::-1] != b[lb - tail_room :][::-1]) if tail_room else np.zeros(0)
        tail = int(differ[0]) if len(differ) else tail_room
        if la == lb == head:
            out[k] = 1.0
            continue
        todo.append((k, a[head : la - tail], b[head : lb - tail], head, tail, na, nb, BAND))
    while todo:
        todo.sort(key=lambda t: (max(len(t[1]), len(t[2])), t[7]))
        again, at = [], 0
        while at < len(todo):
            end, cells = at, 0
            while end < len(todo) and (end == at or (end - at + 1) * (len(todo[end][1]) + 1) * (2 * _band(todo[end]) + 1) <= CELLS) and end - at < 1024:
                end += 1
            part = todo[at:end]
            at = end
            band = max(map(_band, part))
            ma, mb = max(len(t[1]) for t in part), max(len(t[2]) for t in part)
            a, b = np.full((len(part), max(1, ma)), np.uint32(0xFFFFFFFE)), np.full((len(part), max(1, mb)), np.uint32(0xFFFFFFFD))
            for r, t in enumerate(part):
                a[r, : len(t[1])], b[r, : len(t[2])] = t[1], t[2]
            la, lb = np.array([len(t[1]) for t in part]), np.array([len(t[2]) for t in part])
            kept, touched = _kept(a, b, la, lb, np.array([t[4] for t in part]), np.array([t[3] for t in part]), band)
            for r, t in enumerate(part):
                s = kept[r] / (t[5] + t[6] - kept[r])
                out[t[0]] = max(out[t[0]], s)
                # a kept share of ``least`` leaves room for so many inserted or deleted words
                most = int((1 - least) * max(t[5], t[6])) + SHINGLE
                if s < least and touched[r] and band < most:
                    again.append((*t[:7], max(t[7], band - abs(len(t[1]) - len(t[2]))) * 2))
        todo = again
    return out


def _band(t: tuple) -> int:
    return t[7] + abs(len(t[1]) - len(t[2]))


def sift(pairs: DataFrame) -> DataFrame:
    """Of pairs (a, b, na, nb, ba, bb) those that may be links, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for p in batches:
            ba, bb = (np.frombuffer(b"".join(p.column(c).to_pylist()), np.uint8).reshape(-1, BINS) for c in ("ba", "bb"))
            na, nb = (np.maximum(p.column(c).to_numpy(zero_copy_only=False) - SHINGLE + 1, 1) for c in ("na", "nb"))
            used = ((ba > 0) | (bb > 0)).sum(1)
            share = ((ba == bb) & (ba > 0)).sum(1) / np.maximum(used, 1)
            good = pa.array((share >= floor_of(used, na, nb)) & (np.minimum(na, nb) >= SIMILARITY * np.maximum(na, nb)))
            yield pa.RecordBatch.from_arrays([p.column("a").filter(good), p.column("b").filter(good)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long").distinct()


def named_in(node: np.ndarray, n: np.ndarray, bins: np.ndarray, label: np.ndarray, side: np.ndarray, tried: list[list[int]], earlier: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``top`` partners that each row of a cell names: rows, partners and how alike they are.

    Rows of two sides name rows of the other side, rows of one side any.  Of two rows of
    different classes, that of the class with fewer rows here names the other; ``tried`` has
    nodes that a row has been compared with, and both sides mind it.  ``earlier`` are the
    sketches (rows, sketches) before the bucket's: rows that share one meet there, not here.
    """
    names, of = np.unique(label, return_inverse=True)
    size = np.bincount(of)
    rank = np.lexsort((names, size)).argsort()[of]  # of a row's class
    order = np.argsort(node)
    row = np.repeat(np.arange(len(node)), [len(t) for t in tried])
    other = np.array([x for t in tried for x in t], np.int64)
    at = np.minimum(np.searchsorted(node[order], other), len(node) - 1)
    known = node[order][at] == other
    row, other = row[known], order[at[known]]
    row, other = np.concatenate([row, other]), np.concatenate([other, row])
    by = np.argsort(row, kind="stable")
    row, other = row[by], other[by]
    turned = np.ascontiguousarray(bins.T)
    none = (turned == 0).astype(np.float32)
    some_empty = none.any()
    two = side.min() != side.max()
    width, found = bins.shape[1], []
    todo = np.flatnonzero(rank < rank.max())  # nobody is left for the largest class to name
    for begin in range(0, len(todo), ROWS):
        i = todo[begin : begin + ROWS]
        same = np.zeros((len(i), len(node)), np.uint16)
        for k in range(width):
            same += bins[i, k : k + 1] == turned[k]
        empty = ((bins[i] == 0).astype(np.float32) @ none).astype(np.int16) if some_empty else np.int16(0)
        used = np.maximum(width - empty, 1)
        share = (same - empty) / used
        good = (rank[i][:, None] < rank) & (share >= floor_of(used, n[i][:, None], n))
        good &= np.minimum(n[i][:, None], n) >= SIMILARITY * np.maximum(n[i][:, None], n)
        if two:
            good &= side[i][:, None] != side
        for own in earlier.T:
            good &= own[i][:, None] != own
        a, b = np.searchsorted(row, i), np.searchsorted(row, i, "right")
        x = np.repeat(np.arange(len(i)), b - a)
        good[x, other[np.repeat(a - np.concatenate([[0], np.cumsum(b - a)[:-1]]), b - a) + np.arange(len(x))]] = False
        share = np.where(good, share, -1.0)
        if top < len(node):
            best = np.argpartition(-share, top - 1, axis=1)[:, :top]
        else:
            best = np.broadcast_to(np.arange(len(node)), share.shape)
        x, y = np.nonzero(np.take_along_axis(share, best, 1) >= 0)
        y = best[x, y]
        found.append((i[x], y, share[x, y]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    return tuple(np.concatenate(c) for c in zip(*found))


def name_partners(members: DataFrame, top: int) -> DataFrame:
    """What the members (bucket, company, node, n_words, bins, label, tried, earlier) of buckets name, as (bucket, a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cells: pa.Table) -> Iterator[pa.RecordBatch]:
            keys = np.stack([cells.column(c).to_numpy() for c in ("bucket", "low", "high")])
            cut = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            node, n, label, side = (cells.column(c).to_numpy() for c in ("node", "n_words", "label", "side"))
            raw, tried, earlier = (cells.column(c).to_pylist() for c in ("bins", "tried", "earlier"))
            n = np.maximum(n - SHINGLE + 1, 1)
            for i, j in zip([0, *cut.tolist()], [*cut.tolist(), len(node)]):
                if side[i:j].min() == side[i:j].max() and keys[1, i] != keys[2, i] or label[i:j].min() == label[i:j].max():
                    continue
                bins = np.frombuffer(b"".join(raw[i:j]), np.uint8).reshape(j - i, -1)
                x, y, _ = named_in(node[i:j], n[i:j], bins, label[i:j], side[i:j], [t or [] for t in tried[i:j]], np.array(earlier[i:j], np.int64).reshape(j - i, -1), top)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), keys[0, i])), pa.array(node[i:j][x]), pa.array(node[i:j][y])], ["bucket", "a", "b"])

        give_back()
        held: list[pa.RecordBatch] = []  # rows from the last cell's first on
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.stack([batch.column(c).to_numpy() for c in ("bucket", "low", "high")])
            begins = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1
            if last is not None and (keys[:, 0] != last).any():
                begins = np.concatenate([[0], begins])
            if len(begins):
                cut = int(begins[-1])
                ready = [*held, batch.slice(0, cut)] if cut else held
                if ready:
                    yield from pairs(pa.Table.from_batches(ready))
                held = []
                batch = batch.slice(cut)
            held.append(batch)
            last = keys[:, -1]
        if held:
            yield from pairs(pa.Table.from_batches(held))
        del held
        give_back()

    parts = F.ceil(F.col("company") / PART)
    dealt = members.withColumn("side", F.pmod(F.xxhash64("node"), parts).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), (parts - 1).cast("int"))))
    cells = dealt.select("bucket", F.least("side", "other").alias("low"), F.greatest("side", "other").alias("high"), "side", "node", "n_words", "bins", "label", "tried", "earlier")
    placed = cells.repartition("bucket", "low", "high").sortWithinPartitions("bucket", "low", "high", "node")
    return placed.mapInArrow(run, "bucket long, a long, b long")


def fine_digests(sequences: DataFrame) -> DataFrame:
    """(node, bins) of word sequences (node, words): the longer digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                raw = b.column("words").to_pylist()
                h = mix(np.frombuffer(b"".join(raw), np.uint16).astype(np.uint64) + np.uint64(1))
                doc = np.concatenate([[0], np.cumsum([len(x) // 2 for x in raw])])
                yield pa.RecordBatch.from_arrays([b.column("node"), pa.array([x.tobytes() for x in binned(*shingles(h, doc), FINE)], pa.binary())], ["node", "bins"])

    return sequences.mapInArrow(run, "node long, bins binary")


def verify(pairs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """Of pairs (a, b, wa, wb) those that are links, as (a, b)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        give_back()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                p = batch.slice(at, 512)
                own = [tuple(np.frombuffer(x, np.uint16).astype(np.uint32) for x in w) for w in zip(p.column("wa").to_pylist(), p.column("wb").to_pylist())]
                good = pa.array(similarities(own, least) >= least)
                yield pa.RecordBatch.from_arrays([p.column("a").filter(good), p.column("b").filter(good)], ["a", "b"])

    return pairs.mapInArrow(run, "a long, b long")


# ---------------------------------------------------------------- classes


def components(links: DataFrame) -> DataFrame:
    """The least node of each linked node's component, as (node, label).

    Each step takes the least label of a node's neighbours and then that label's own
    label, so long chains shorten by half.
    """
    both = stored(links.select(F.col("a").alias("node"), F.col("b").alias("other")).union(links.select("b", "a")), "links", True)
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels", True)
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").select("node", "label", F.lit(None).cast("long").alias("old"))
        every = near.unionByName(labels.select("node", "label", F.col("label").alias("old")))
        step = every.groupBy("node").agg(F.min("label").alias("label"), F.max("old").alias("old"))
        further = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(step.join(further, "label", "left").select("node", "old", F.least("label", F.coalesce("further", "label")).alias("label")), "labels", True)
        labels = new.select("node", "label")
        if new.where("old <> label").isEmpty():
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels of linked nodes once further links are there."""
    named = links.join(labels.toDF("a", "la"), "a", "left").join(labels.toDF("b", "lb"), "b", "left")
    across = named.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b")).where("a <> b").distinct()
    roots = components(across)
    old = labels.join(roots.toDF("label", "root"), "label", "left").select("node", F.coalesce("root", "label").alias("label"))
    return stored(old.unionByName(roots.join(labels, "node", "left_anti")), "labels", True)


def _centres(pool: DataFrame) -> DataFrame:
    """The most central member of each bucket of a pool."""
    best = F.max(F.struct("central", F.col("node").alias("centre"), F.col("n_words").alias("nc"), F.col("bins").alias("bc"))).alias("m")
    return pool.groupBy("bucket").agg(best).select("bucket", "m.centre", "m.nc", "m.bc")


_PAIR = ("node AS a", "centre AS b", "n_words AS na", "nc AS nb", "bins AS ba", "bc AS bb")


def links_of(sketched: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Verified links that join nodes (distinct word sequences) to classes, and the classes' labels."""
    own = nodes.where("n_words > 0").select("node", "n_words", "sketch", "bins")
    every = own.select("node", F.posexplode("sketch").alias("j", "value")).select("node", "j", F.xxhash64("j", "value").alias("bucket"))
    shared = every.groupBy("bucket").agg(F.count("*").alias("company")).where("company > 1")
    members = every.join(shared, "bucket")
    central = members.groupBy("node").agg(F.sum("company").alias("central"), F.collect_list(F.struct("bucket", "company", "j")).alias("buckets"))
    met = stored(central.join(own, "node").select("node", "central", "n_words", "bins", "sketch", "buckets"), "met")
    members = met.select(F.inline("buckets"), "node", "central", "n_words", "bins")
    # word sequences move once, to where all rounds' pairs come
    sequences = stored(sketched.select("rid", "words"), "sequences", bucket="rid")

    def checked(candidates: DataFrame) -> DataFrame:
        return stored(verify(candidates.join(sequences.toDF("a", "wa"), "a").join(sequences.toDF("b", "wb"), "b")), "verified", True)

    first = _centres(members)
    tried = stored(sift(members.join(first, "bucket").where("node <> centre").selectExpr(*_PAIR)), "candidates", True)
    links = checked(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    labels = components(links)
    top, active, own = NAMED, None, met
    while True:
        # the members of buckets that go on and have several classes
        named = own.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        placed = named.select(F.inline("buckets"), "label")
        if active is not None:
            placed = placed.join(active, "bucket", "left_semi")
        mixed = placed.groupBy("bucket").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least < most").select("bucket")
        known = named.join(tried.groupBy(F.col("a").alias("node")).agg(F.collect_set("b").alias("tried")), "node", "left")
        members = known.select(F.inline("buckets"), "node", "n_words", "bins", "label", "tried", "sketch").withColumn("earlier", F.slice("sketch", F.lit(1), F.col("j"))).drop("sketch").join(mixed, "bucket")
        found = stored(name_partners(members, top), "named", True)
        if found.isEmpty():
            return links, labels
        pairs = stored(found.select("a", "b").distinct(), "chosen", True)
        more = checked(pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
        if not more.isEmpty():
            links, labels = links.unionByName(more), merged(labels, more)
        tried, active = tried.unionByName(pairs), found.select("bucket").distinct()
        if top == NAMED:  # who goes on gets the longer digest
            on = met.select("node", F.inline("buckets")).join(active, "bucket", "left_semi").select("node").distinct()
            fine = stored(fine_digests(sequences.select(F.col("rid").alias("node"), "words").join(on, "node", "left_semi")), "fine", True)
            own = met.drop("bins").join(fine, "node")
        top *= 4


def near_classes(docs: DataFrame) -> DataFrame:
    """The class of every row of ``docs`` (rid, doc_id, text), rid being unique.

    Returns rid, doc_id, class_id (the least doc_id of the class), n_links (verified links
    of the row's text to different texts; pairs of one class needn't all be looked at), n_copies (rows of the same word sequence) and kept
    (true for one row of each class: the first by doc_id, then rid).
    """
    since = len(SCRATCH)
    sketched = stored(sketch_rows(docs.select("rid", F.col("doc_id").cast("long").alias("doc_id"), "text")), "sketched")
    head = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid"))
    # what has one digest has one word sequence, so any row's sketch will do
    any_row = [F.first(c).alias(c) for c in ("n_words", "sketch", "bins")]
    nodes = stored(sketched.groupBy("digest").agg(F.min("rid").alias("node"), head.alias("first"), F.count("*").alias("n_copies"), *any_row), "distinct")
    links, labels = links_of(sketched, nodes)
    nodes = nodes.select("digest", "node", "first", "n_copies")
    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    labelled = nodes.join(labels, "node", "left").join(degree, "node", "left").withColumn("label", F.coalesce("label", "node"))
    classes = labelled.groupBy("label").agg(F.min("first").alias("head"))
    known = labelled.join(classes, "label").select("digest", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "n_copies", "head")
    rows = sketched.select("rid", "doc_id", "digest").join(known, "digest")
    found = stored(rows.select("rid", "doc_id", F.col("head.doc_id").alias("class_id"), "n_links", "n_copies", (F.col("rid") == F.col("head.rid")).alias("kept")), "classes")
    drop_stored(docs.sparkSession, since, keep=1)
    return found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, class_id, n_links, n_copies and kept of every row of ``docs`` (doc_id, text).

    A null text is an empty one; texts without words are copies of each other.  A row
    without a doc_id takes part like any other; a class of such rows only has a null
    class_id.  Repeated rows are copies; other columns are ignored.
    """
    return near_classes(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")).drop("rid")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without those whose class keeps another, with their columns, whatever these are called."""
    columns = docs.columns
    rid = "rid"
    while rid in {c.lower() for c in columns}:
        rid += "_"
    held = stored(docs.select(F.monotonically_increasing_id().alias(rid), *columns), "numbered")
    losers = near_classes(held.select(F.col(rid).alias("rid"), "doc_id", "text")).where("not kept").select(F.col("rid").alias(rid))
    if losers.count() <= BROADCAST_ROWS:  # row numbers of bounded size go to the texts; beyond, both meet by number
        losers = F.broadcast(losers)
    return held.join(losers, rid, "left_anti").select(*columns)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
