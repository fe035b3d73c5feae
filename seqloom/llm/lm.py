"""Language-model scores from a sharded n-gram trie.

Counting and looking up work on blocks of documents, so that what moves is one
entry for each distinct n-gram of a block, not one for each token:

1. Blocks hold their texts as word numbers, with the sorted hashes of their words.
2. Words go to shards by range of hash; a shard sums the training counts and
   answers every block with the counts of its words.
3. For each order from 2 on, pairs (context, word) go to shards by context.  A shard
   sums them, builds an Elias-Fano trie level with quantised probabilities in a memory
   mapping, and answers every block's pairs from it.  The few contexts with more
   than a set share of all tokens are dealt to all shards by word; their totals, of
   which there can only be a bounded number, go along.
4. Blocks put the answers together.

The model interpolates: P(w | h) = c(h w) / (c(h) + m) + m / (c(h) + m) * P(w | shorter h),
down to (c(w) + 0.1) / (N + 0.1 (V + 1)).  Words are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqloom.llm.columns import SCRATCH, blocks, drop_stored, hash_words, mix, stored, texts, words
from seqloom.llm.eliasfano import BACKOFF, SEEN, TrieLevel, mapped
from seqloom.llm.language import held_out

ORDER = 2
PRIOR = 50.0  # m; held-out text of the small tables is likeliest between 10 and 50
BLOCK = 8 << 20
SHARD_WORDS = 2_000_000  # words or pairs that a shard gets, about
END, START = np.uint64(0x9AE16A3B2F90404F), np.uint64(0xC3A5C85C97CB3127)
TABLE = np.arange(256, dtype=np.uint8)
TABLE[65:91] += 32
TABLE[0] = 0xFF  # a zero byte is part of a word; no UTF-8 text has this one
TABLE[[0x20, *range(0x09, 0x0E)]] = 0
BLOCKS = "block long, doc_ids array<long>, held array<boolean>, n binary, tokens binary, hashes binary, counts binary, n_tokens long, n_train long, n_distinct long"
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
SUCCESSOR_BITS = 40


def squeeze(a: np.ndarray) -> bytes:
    """Unsigned integers, byte planes one after the other, compressed."""
    width = a.dtype.itemsize
    return zstandard.ZstdCompressor(1).compress(np.ascontiguousarray(a.view(np.uint8).reshape(-1, width).T).tobytes())


def expand(data: bytes, kind: type) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=1 << 31) if data else b"", np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(width, -1).T).reshape(-1).view(kind)


def block_rows(docs: DataFrame) -> DataFrame:
    """Blocks of (block, doc_id, text), block being a unique number of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, limit=BLOCK):
            ids = b.column("doc_id").to_pylist()
            held = held_out(ids, 10, 0)
            codes, dictionary, doc, _ = words(*texts(b.column("text")), TABLE)
            hashes = np.concatenate([hash_words(dictionary), [END]]).astype(np.uint64)
            n = np.diff(doc) + 1
            tokens = np.full(int(n.sum()), len(dictionary), np.int64)
            ends = np.cumsum(n) - 1
            inner = np.ones(len(tokens), bool)
            inner[ends] = False
            tokens[inner] = codes
            order = np.argsort(hashes)
            place = np.empty(len(order), np.int64)
            place[order] = np.arange(len(order))
            tokens = place[tokens]
            train = np.repeat(~np.array(held, bool), n)
            counts = np.bincount(tokens[train], minlength=len(order))
            yield pa.RecordBatch.from_pydict(
                {"block": [b.column("block")[0].as_py()], "doc_ids": [ids], "held": [held], "n": [squeeze(n.astype(np.uint32))], "tokens": [squeeze(tokens.astype(np.uint32))], "hashes": [hashes[order].tobytes()], "counts": [squeeze(counts.astype(np.uint32))], "n_tokens": [len(tokens)], "n_train": [int(train.sum())], "n_distinct": [len(order)]},
                pa.schema([("block", pa.int64()), ("doc_ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("n", pa.binary()), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64()), ("n_train", pa.int64()), ("n_distinct", pa.int64())]),
            )

    return docs.mapInArrow(run, BLOCKS)


# ---------------------------------------------------------------- words


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """The shard, in even ranges, of each hash."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _runs(sorted_shards: np.ndarray) -> list[tuple[int, int, int]]:
    """(shard, begin, end) of the shards that occur."""
    begin = np.flatnonzero(np.concatenate([[True], sorted_shards[1:] != sorted_shards[:-1]])) if len(sorted_shards) else np.zeros(0, np.int64)
    return list(zip(sorted_shards[begin].tolist(), begin.tolist(), [*begin[1:].tolist(), len(sorted_shards)]))


def word_counts(held: DataFrame, shards: int, hot: int) -> DataFrame:
    """For each block and shard the training counts of its words; rows of block -1 have
    a shard's number of distinct training words and its words of more than ``hot``."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                hashes, counts = np.frombuffer(b.column("hashes")[i].as_py(), np.uint64), expand(b.column("counts")[i].as_py(), np.uint32)
                own = _runs(_shard_of(hashes, shards))
                yield pa.RecordBatch.from_pydict({"shard": [s for s, *_ in own], "block": [b.column("block")[i].as_py()] * len(own), "keys": [hashes[j:k].tobytes() for _, j, k in own], "counts": [squeeze(counts[j:k]) for _, j, k in own]}, pa.schema([("shard", pa.int32()), ("block", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        keys = [np.frombuffer(k, np.uint64) for k in rows["keys"]]
        sizes = [len(k) for k in keys]
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        total = np.bincount(inverse, weights=np.concatenate([expand(c, np.uint32) for c in rows["counts"]]), minlength=len(every)).astype(np.int64)
        parts = np.split(total[inverse], np.cumsum(sizes)[:-1])
        much = np.flatnonzero(total > hot)
        out = {"block": [*rows["block"], -1], "shard": rows["shard"].iloc[0], "answer": [*(squeeze(p.astype(np.uint64)) for p in parts), b""], "distinct": [*([0] * len(parts)), int((total > 0).sum())], "hot": [*([[]] * len(parts)), [int(x) for x in np.stack([every[much].view(np.int64), total[much]], 1).ravel()]]}
        return pd.DataFrame(out)

    return held.select("block", "hashes", "counts").mapInArrow(deal, "shard int, block long, keys binary, counts binary").groupBy("shard").applyInPandas(answer, "block long, shard int, answer binary, distinct long, hot array<long>")


# ---------------------------------------------------------------- longer n-grams


def start_of(order: int) -> np.uint64:
    """The context of a text's first word at an order."""
    return START if order == 2 else mix(np.array([START ^ np.uint64(order)]))[0]


def longer(context: np.ndarray, successor: np.ndarray) -> np.ndarray:
    """The context that a context and its successor make for the next order."""
    return mix(context * np.uint64(3) + mix(successor))


class Pairs:
    """The distinct (context, word) pairs of a block, by order."""

    def __init__(self, tokens: np.ndarray, n: np.ndarray, hashes: np.ndarray, order: int):
        first = np.cumsum(n) - n
        vocabulary = len(hashes)
        before = np.empty(len(tokens), np.int64)
        before[1:] = tokens[:-1]
        before[first] = vocabulary
        names = np.append(hashes, START)
        context, contexts = before, names
        for k in range(2, order + 1):
            if k > 2:
                # one word more: a pair of the order before, or the start
                context = np.empty(len(tokens), np.int64)
                context[1:] = self.inverse[:-1]
                context[first] = len(self.context)
                contexts = np.append(longer(contexts[self.context], hashes[self.word] >> np.uint64(64 - SUCCESSOR_BITS)), start_of(k))
            key = context * np.int64(vocabulary) + tokens
            pairs, self.inverse = np.unique(key, return_inverse=True)
            self.context, self.word = pairs // vocabulary, pairs % vocabulary
        self.context_hash, self.successor = contexts[self.context], hashes[self.word] >> np.uint64(64 - SUCCESSOR_BITS)

    def shards(self, shards: int, hot: np.ndarray) -> np.ndarray:
        """Each pair's shard: by context, or for the hot contexts by context and word."""
        spread = mix(self.context_hash)
        if len(hot):
            much = np.isin(self.context_hash, hot)
            spread = np.where(much, mix(spread + (self.successor >> np.uint64(SUCCESSOR_BITS - 16))), spread)
        return _shard_of(spread, shards)


def _five(x: np.ndarray) -> bytes:
    """The low five bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _of_five(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(raw, np.uint8).reshape(-1, 5)
    return out.view("<u8").reshape(-1)


def pair_codes(held: DataFrame, order: int, shards: int, hot: list[tuple[int, int]], prior: float, much: int) -> DataFrame:
    """For each block and shard the codes of its pairs and of their contexts; rows of block -1
    have a shard's pairs of more than ``much``, as contexts of the next order with their totals."""
    known = {int(np.int64(h).view(np.uint64)): c for h, c in hot}
    hot_hashes = np.array(sorted(known), np.uint64)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                n, tokens = expand(b.column("n")[i].as_py(), np.uint32).astype(np.int64), expand(b.column("tokens")[i].as_py(), np.uint32).astype(np.int64)
                hashes = np.frombuffer(b.column("hashes")[i].as_py(), np.uint64)
                p = Pairs(tokens, n, hashes, order)
                train = np.repeat(~np.array(b.column("held")[i].as_py(), bool), n)
                counts = np.bincount(p.inverse[train], minlength=len(p.word))
                shard = p.shards(shards, hot_hashes)
                by = np.argsort(shard.astype(np.uint16) if shards < 65536 else shard, kind="stable")
                rows = []
                for s, j, k in _runs(shard[by]):  # only the shards that occur
                    own = by[j:k]
                    context = p.context_hash[own]
                    heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
                    rows.append((s, context[heads].tobytes(), squeeze(np.diff(np.append(heads, len(own))).astype(np.uint32)), _five(p.successor[own]), squeeze(counts[own].astype(np.uint32))))
                names = ("shard", "contexts", "runs", "successors", "counts")
                yield pa.RecordBatch.from_pydict({"block": [b.column("block")[i].as_py()] * len(rows)} | {k: [r[j] for r in rows] for j, k in enumerate(names)}, pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("contexts", pa.binary()), ("runs", pa.binary()), ("successors", pa.binary()), ("counts", pa.binary())]))

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        asked = [(np.repeat(np.frombuffer(c, np.uint64), expand(r, np.uint32)), _of_five(s)) for c, r, s in zip(rows["contexts"], rows["runs"], rows["successors"])]
        context, successor = (np.concatenate([a[k] for a in asked]) for k in (0, 1))
        counts = np.concatenate([expand(c, np.uint32) for c in rows["counts"]]).astype(np.int64)
        on = np.flatnonzero(counts)
        by = on[np.lexsort((successor[on], context[on]))]
        context, successor, counts = context[by], successor[by], counts[by]
        del by, on
        fresh = np.ones(len(context), bool)
        fresh[1:] = (context[1:] != context[:-1]) | (successor[1:] != successor[:-1])
        heads = np.flatnonzero(fresh)
        counts = np.add.reduceat(counts, heads) if len(heads) else counts
        context, successor = context[heads], successor[heads]
        starts = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else heads
        totals = np.add.reduceat(counts, starts).astype(float) if len(starts) else np.zeros(0)
        for i in np.flatnonzero(np.isin(context[starts], hot_hashes)).tolist():
            totals[i] = known[int(context[starts[i]])]
        each = np.repeat(totals, np.diff(np.append(starts, len(context))))
        level = TrieLevel.build(context, successor, counts / (each + prior), prior / (totals + prior))
        level = mapped(level)
        found = [level.find(*a) for a in asked]
        if len(hot_hashes):  # a shard needn't have any pair of a hot context that it's asked for
            backs = BACKOFF.of(prior / (np.array([known[int(h)] for h in hot_hashes], float) + prior))
            for (contexts, _), (_, back) in zip(asked, found):
                at = np.minimum(np.searchsorted(hot_hashes, contexts), len(hot_hashes) - 1)
                on = hot_hashes[at] == contexts
                back[on] = backs[at[on]]
        often = np.flatnonzero(counts > much)
        next_hot = [int(x) for x in np.stack([longer(context[often], successor[often]).view(np.int64), counts[often]], 1).ravel()]
        return pd.DataFrame({"block": [*rows["block"], -1], "shard": rows["shard"].iloc[0], "answer": [*(squeeze(np.concatenate(f)) for f in found), b""], "distinct": 0, "hot": [*([[]] * len(found)), next_hot]})

    dealt = held.select("block", "n", "tokens", "hashes", "held").mapInArrow(deal, "block long, shard int, contexts binary, runs binary, successors binary, counts binary")
    return dealt.groupBy("shard").applyInPandas(answer, "block long, shard int, answer binary, distinct long, hot array<long>")


# ---------------------------------------------------------------- scores


def score_documents(docs: DataFrame, order: int = ORDER, prior: float = PRIOR, shard_words: int = SHARD_WORDS) -> DataFrame:
    """Scores of every whole text of ``docs`` (doc_id, text), learned from the rows that aren't held out.

    A null text is an empty one: one token, the end.  A null doc_id isn't held out.
    Repeated rows are learned from and scored each; other columns are ignored; an empty
    table gives an empty table.
    """
    since = len(SCRATCH)
    held = stored(block_rows(docs.select(F.monotonically_increasing_id().alias("block"), F.col("doc_id").cast("long").alias("doc_id"), "text")), "blocks")
    size = held.agg(F.sum("n_tokens"), F.sum("n_train"), F.sum("n_distinct")).first()
    tokens, train, distinct = (int(x or 0) for x in size)
    word_shards, pair_shards = max(1, -(-distinct // shard_words)), max(1, -(-tokens // shard_words))
    much = max(1, train // (4 * pair_shards))  # at most 4 * pair_shards contexts of an order are that frequent
    counted = stored(word_counts(held, word_shards, much), "counts")

    def hot_of(found: DataFrame) -> list[tuple[int, int]]:
        flat = found.where("block = -1").agg(F.flatten(F.collect_list("hot"))).first()[0] or []
        return list(zip(flat[::2], flat[1::2]))

    vocabulary = int(counted.where("block = -1").agg(F.sum("distinct")).first()[0] or 0)
    hot = hot_of(counted)
    end, start = (int(h.astype(np.int64)) for h in (END, START))
    hot += [(start, c) for h, c in hot if h == end]  # there are as many starts as ends
    answers = counted.where("block >= 0").select("block", F.lit(1).alias("level"), "shard", "answer")
    every_hot: dict[int, np.ndarray] = {}
    for k in range(2, order + 1):
        every_hot[k] = np.array(sorted(int(np.int64(h).view(np.uint64)) for h, _ in hot), np.uint64)
        found = pair_codes(held, k, pair_shards, hot, prior, much)
        if k < order:  # the next order has to know this one's frequent pairs
            found = stored(found, "codes")
            starts = sum(c for h, c in hot if h == int(start_of(k).astype(np.int64)))
            hot = hot_of(found) + ([(int(start_of(k + 1).astype(np.int64)), starts)] if starts else [])
        answers = answers.unionByName(found.where("block >= 0").select("block", F.lit(k).alias("level"), "shard", "answer"))

    def put_together(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame(columns=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
        row = block.iloc[0]
        n, own = expand(row["n"], np.uint32).astype(np.int64), expand(row["tokens"], np.uint32).astype(np.int64)
        hashes = np.frombuffer(row["hashes"], np.uint64)
        by = {(level, s): a for level, s, a in zip(found["level"], found["shard"], found["answer"])}
        count = np.concatenate([expand(by[k], np.uint64) for k in sorted(by) if k[0] == 1]).astype(np.int64)
        base = (count + 0.1) / (train + 0.1 * (vocabulary + 1))
        p = base[own]
        for k in range(2, order + 1):
            pairs = Pairs(own, n, hashes, k)
            shard = pairs.shards(pair_shards, every_hot[k])
            order_of = np.argsort(shard, kind="stable")
            codes = np.concatenate([expand(by[own], np.uint8).reshape(2, -1) for own in sorted(by) if own[0] == k], axis=1)
            seen, back = np.empty(len(shard)), np.empty(len(shard))
            seen[order_of] = SEEN.value(codes[0])
            back[order_of] = np.where(codes[1] > 0, BACKOFF.value(codes[1]), 1.0)
            p = np.minimum(seen[pairs.inverse] + back[pairs.inverse] * p, 1.0)
        at = np.cumsum(n) - n
        total = lambda x: np.add.reduceat(x, at)  # noqa: E731  every document has its end, so no run is empty
        return pd.DataFrame({"doc_id": pd.array(row["doc_ids"], "Int64"), "held_out": row["held"], "n_tokens": n, "n_known": total((count[own] > 0).astype(np.int64)), "train_tokens": train, "base_score": total(np.log10(base[own])), "score": total(np.log10(p))})

    scored = stored(held.select("block", "doc_ids", "held", "n", "tokens", "hashes").groupBy("block").cogroup(answers.groupBy("block")).applyInPandas(put_together, RESULT), "scores")
    drop_stored(docs.sparkSession, since, keep=1)
    return scored


def op3_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
