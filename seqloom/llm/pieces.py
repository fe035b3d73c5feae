"""SentencePiece lattices in numpy.

A :class:`Pieces` holds the pieces of a model file.  Texts are cut where no piece
can lie (between two bytes that stand side by side in no piece), equal chunks
are solved once, and :meth:`Pieces.solve` fills the lattice of many chunks
together: chunks of equal length advance one position at a time, hashes of the
substrings that end there probe the sorted piece keys, and the best way in is
kept with its backpointer and its exact number of tokens.

* For a unigram model the best way in has the greatest sum of scores (Viterbi).
* For a BPE model exactly one last token is right at each prefix: the one that
  the merges would leave beside the last token of the shorter prefix.  Two tokens
  may stand side by side if, undoing their merges from the latest on, no merge
  across the border would have come earlier.  The lattice with that rule gives
  the merges' own segmentation, and the token count at every prefix.
"""

from __future__ import annotations

import struct
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa

from seqloom.llm.columns import texts

NORMAL, UNKNOWN, BYTE = 1, 2, 6
UNIGRAM, BPE = 1, 2
SPACE = "▁"
UNKNOWN_PENALTY = 10.0  # below the worst score, in unigram models
LONG, FEW = 200, 16  # chunks of more code points that so few share are solved one by one
_P = np.uint64(0x9E3779B97F4A7C15)
_FILTER = 20


def _fields(data: bytes):
    """(number, value) pairs of a serialised message."""
    at = 0

    def varint(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value, at

    while at < len(data):
        key, at = varint(at)
        kind = key & 7
        if kind == 0:
            value, at = varint(at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = struct.unpack("<f", data[at : at + 4])[0], at + 4
        elif kind == 2:
            n, at = varint(at)
            value, at = data[at : at + n], at + n
        else:
            raise ValueError("not a model file")
        yield key >> 3, value


class Pieces:
    def __init__(self, model: bytes, kind: int | None = None):
        self.strings, self.scores, self.types = [], [], []
        self.kind, self.byte_fallback, self.dummy_prefix, self.squeeze = UNIGRAM, False, True, True
        for number, value in _fields(model):
            if number == 1:
                piece = dict(_fields(value))
                self.strings.append(piece.get(1, b"").decode())
                self.scores.append(piece.get(2, 0.0))
                self.types.append(piece.get(3, NORMAL))
            elif number == 2:
                spec = dict(_fields(value))
                self.kind, self.byte_fallback = spec.get(3, UNIGRAM), bool(spec.get(35, 0))
            elif number == 3:
                spec = dict(_fields(value))
                if spec.get(2):
                    raise ValueError("only models without a character map")
                self.dummy_prefix, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        if kind is not None:
            self.kind = kind
        if self.kind not in (UNIGRAM, BPE):
            raise ValueError("only unigram and BPE models")
        self.unknown = self.types.index(UNKNOWN)
        self.byte_ids = np.full(256, self.unknown, np.int32)
        for i, t in enumerate(self.types):
            if t == BYTE:
                self.byte_ids[int(self.strings[i][1:-1], 16)] = i
        self._surface()
        self._index()
        self._borders()
        if self.kind == BPE:
            self._merges()
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}

    # ------------------------------------------------------------ tables

    def _surface(self) -> None:
        """The bytes each id stands for when decoded."""
        own = []
        for s, t in zip(self.strings, self.types):
            if t == BYTE:
                own.append(bytes([int(s[1:-1], 16)]))
            elif t == UNKNOWN:
                own.append(" ⁇ ".encode())
            elif t == NORMAL:
                own.append(s.replace(SPACE, " ").encode())
            else:
                own.append(b"")
        self.surface = np.frombuffer(b"".join(own), np.uint8)
        self.surface_at = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)

    def _index(self) -> None:
        """Sorted hash keys of the pieces by length, and a filter before them."""
        self.ids = {s: i for i, (s, t) in enumerate(zip(self.strings, self.types)) if t == NORMAL and s}
        self.longest = max(map(len, self.ids))
        self.powers = np.array([pow(int(_P), k, 1 << 64) for k in range(self.longest + 1)], np.uint64)
        keys: list[list[int]] = [[] for _ in range(self.longest + 1)]
        ids: list[list[int]] = [[] for _ in range(self.longest + 1)]
        for s, i in self.ids.items():
            h = 0
            for c in s:
                h = (h * int(_P) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
            keys[len(s)].append(h)
            ids[len(s)].append(i)
        self.filter = np.zeros((self.longest + 1, 1 << 16), bool)
        self.keys, self.key_ids = [], []
        for k in range(self.longest + 1):
            order = np.argsort(np.array(keys[k], np.uint64))
            self.keys.append(np.array(keys[k], np.uint64)[order])
            self.key_ids.append(np.array(ids[k], np.int32)[order])
            self.filter[k, self._slot(self.keys[k])] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)

    def _borders(self) -> None:
        """Which bytes may stand side by side inside a piece or a character."""
        inside = np.zeros((256, 256), bool)
        inside[:, 0x80:0xC0] = True
        for s in self.ids:
            b = s.replace(SPACE, " ").encode()
            for x, y in zip(b, b[1:]):
                inside[x, y] = True
        self.inside = inside.ravel()

    def _merges(self) -> None:
        """Rank and last merge of each piece, and what every two pieces would become."""
        order = sorted({self.scores[i] for i in self.ids.values()}, reverse=True)
        dense = {s: k for k, s in enumerate(order)}
        n = len(self.strings)
        rank = np.full(n + 1, -1, np.int64)  # -1: a single character, or the unknown one
        left, right = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
        reach = np.zeros(n, bool)
        joins: dict[tuple[int, int], int] = {}
        of = {s: dense[self.scores[i]] for s, i in self.ids.items()}
        for s, i in self.ids.items():
            if len(s) == 1:
                reach[i] = True
                continue
            for k in range(1, len(s)):
                a, b = self.ids.get(s[:k]), self.ids.get(s[k:])
                if a is not None and b is not None:
                    joins[a, b] = of[s]
            own, last = list(s), None
            while len(own) > 1:
                best = min(((of[own[k] + own[k + 1]], k) for k in range(len(own) - 1) if own[k] + own[k + 1] in of), default=None)
                if best is None:
                    break
                k = best[1]
                last = own[k], own[k + 1]
                own[k : k + 2] = [own[k] + own[k + 1]]
            if len(own) == 1 and all(x in self.ids for x in last):
                rank[i], left[i], right[i], reach[i] = of[s], self.ids[last[0]], self.ids[last[1]], True
        self.rank, self.left, self.right, self.reach = rank, left, right, reach
        pairs = np.array([a * n + b for a, b in joins], np.int64)
        order = np.argsort(pairs)
        self.pairs = pairs[order]
        self.pair_rank = np.array(list(joins.values()), np.int64)[order]
        self.pair_filter = np.zeros(1 << _FILTER, bool)
        self.pair_filter[self._pair_slot(self.pairs)] = True

    @staticmethod
    def _pair_slot(pairs: np.ndarray) -> np.ndarray:
        return (pairs.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - _FILTER)

    def beside(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges would leave tokens ``a`` and ``b`` side by side."""
        n = len(self.strings)
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), 1 << 40, np.int64)
        while len(live):
            pair = a * n + b
            known = np.flatnonzero(self.pair_filter[self._pair_slot(pair)] & (a < n) & (b < n))
            if len(known):
                at = np.minimum(np.searchsorted(self.pairs, pair[known]), len(self.pairs) - 1)
                early = (self.pairs[at] == pair[known]) & (self.pair_rank[at] < limit[known])
                if early.any():
                    good[live[known[early]]] = False
                    on = np.ones(len(live), bool)
                    on[known[early]] = False
                    live, a, b, limit = live[on], a[on], b[on], limit[on]
            ra, rb = self.rank[a], self.rank[b]
            first = ra > rb
            limit = np.where(first, ra, rb + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            on = first | (rb >= 0)
            if not on.all():
                live, a, b, limit = live[on], a[on], b[on], limit[on]
        return good

    # ------------------------------------------------------------ the lattice

    def solve(self, chunks: list[str]) -> list[tuple[bytes, bytes]]:
        """For each chunk (spaces as SPACE): its ids (int32) and the number of tokens of
        each of its prefixes by code points (int32)."""
        out: list[tuple[bytes, bytes]] = [(b"", b"")] * len(chunks)
        by: dict[int, list[int]] = {}
        for i, c in enumerate(chunks):
            by.setdefault(len(c), []).append(i)
        for length, which in by.items():
            if not length:
                continue
            if length > LONG and len(which) < FEW:  # nobody to advance with
                for i in which:
                    out[i] = self._alone(np.frombuffer(chunks[i].encode("utf-32-le"), np.uint32))
                continue
            step = max(1, (1 << 20) // length)
            for at in range(0, len(which), step):
                own = which[at : at + step]
                points = np.frombuffer("".join([chunks[i] for i in own]).encode("utf-32-le"), np.uint32).reshape(len(own), length)
                for i, x in zip(own, self._lattice(np.ascontiguousarray(points.T)), strict=True):
                    out[i] = x
        return out

    def _lattice(self, points: np.ndarray) -> list[tuple[bytes, bytes]]:
        length, n = points.shape
        hashes = np.zeros((length + 1, n), np.uint64)
        for j in range(length):
            hashes[j + 1] = hashes[j] * _P + (points[j].astype(np.uint64) + np.uint64(1))
        wide = np.ones((length, n), np.int32)
        if self.byte_fallback:
            wide += (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        none = len(self.strings)  # stands for a character that no piece has
        last = np.full((length + 1, n), none, np.int32)
        back = np.ones((length + 1, n), np.int16)
        count = np.zeros((length + 1, n), np.int32)
        if self.kind == BPE:
            for j in range(1, length + 1):
                left = np.arange(n)
                for k in range(min(j, self.longest), 0, -1):
                    which, ids = self._probe(hashes, j, k, left)
                    if len(which):
                        keep = self.reach[ids]
                        if j > k and keep.any():
                            keep[keep] = self.beside(last[j - k, which[keep]], ids[keep])
                        which, ids = which[keep], ids[keep]
                    if len(which):
                        last[j, which] = ids
                        back[j, which] = k
                        count[j, which] = count[j - k, which] + 1
                        if len(which) == len(left):
                            left = left[:0]
                            break
                        on = np.ones(n, bool)
                        on[which] = False
                        left = left[on[left]]
                if len(left):
                    count[j, left] = count[j - 1, left] + wide[j - 1, left]
        else:
            scores = np.array(self.scores)
            worst = min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
            best = np.full((length + 1, n), -np.inf)
            best[0] = 0
            every = np.arange(n)
            for j in range(1, length + 1):
                single = np.zeros(n, bool)
                for k in range(min(j, self.longest), 0, -1):
                    which, ids = self._probe(hashes, j, k, every)
                    if k == 1:
                        single[which] = True
                    value = best[j - k, which] + scores[ids]
                    more = value > best[j, which]
                    which, ids = which[more], ids[more]
                    best[j, which] = value[more]
                    last[j, which], back[j, which] = ids, k
                    count[j, which] = count[j - k, which] + 1
                value = best[j - 1] + worst
                more = np.flatnonzero(~single & (value > best[j]))
                best[j, more] = value[more]
                last[j, more], back[j, more] = none, 1
                count[j, more] = count[j - 1, more] + wide[j - 1, more]
        return self._paths(points, last, back, count)

    def _found(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The pieces of one chunk, by the place they end at and the longer first: place, length and id."""
        length = len(points)
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, _P, np.uint64)]))
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length, np.uint64(pow(int(_P), -1, 1 << 64)), np.uint64)]))
        # hashes of all prefixes at once: the sum of what each code point adds, brought to the prefix's own power
        hashes = np.concatenate([[np.uint64(0)], np.cumsum((points.astype(np.uint64) + np.uint64(1)) * inverse[1:])]) * power
        ends, sizes, ids = [], [], []
        for k in range(min(length, self.longest), 0, -1):
            if not len(self.keys[k]):
                continue
            h = hashes[k:] - hashes[:-k] * self.powers[k]
            likely = np.flatnonzero(self.filter[k][self._slot(h)])
            at = np.minimum(np.searchsorted(self.keys[k], h[likely]), len(self.keys[k]) - 1)
            hit = self.keys[k][at] == h[likely]
            own = self.key_ids[k][at[hit]]
            keep = self.reach[own] if self.kind == BPE else np.ones(len(own), bool)
            ends.append(likely[hit][keep] + k)
            sizes.append(np.full(int(keep.sum()), k, np.int32))
            ids.append(own[keep])
        end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
        order = np.argsort(end, kind="stable")
        return end[order], np.concatenate(sizes)[order] if ends else end, np.concatenate(ids)[order] if ends else end

    def _alone(self, points: np.ndarray) -> tuple[bytes, bytes]:
        """What :meth:`_lattice` gives, of one long chunk: its pieces are looked up at once, then it is walked."""
        length, none = len(points), len(self.strings)
        end, size, token = self._found(points)
        wide = np.ones(length, np.int32)
        if self.byte_fallback:
            wide += (points > 0x7F).astype(np.int32) + (points > 0x7FF) + (points > 0xFFFF)
        last, back, count = array("i", [none]) * (length + 1), array("i", [1]) * (length + 1), array("i", [0]) * (length + 1)
        beside: dict[int, bool] = {}
        bpe = self.kind == BPE
        best = array("d", [0.0]) * (1 if bpe else length + 1)
        worst = 0.0 if bpe else min(self.scores[i] for i in self.ids.values()) - UNKNOWN_PENALTY
        for begin in range(0, length, 1 << 16):
            stop = min(length, begin + (1 << 16))
            cut = np.searchsorted(end, np.arange(begin + 1, stop + 2)).tolist()
            base = cut[0]
            sizes, tokens, costs = size[base : cut[-1]].tolist(), token[base : cut[-1]].tolist(), wide[begin:stop].tolist()
            for j in range(begin + 1, stop + 1):
                a, b = cut[j - begin - 1] - base, cut[j - begin] - base
                if bpe:
                    for c in range(a, b):
                        k, t = sizes[c], tokens[c]
                        if k < j:
                            pair = last[j - k] * (none + 1) + t
                            good = beside.get(pair)
                            if good is None:
                                good = beside[pair] = bool(self.beside(np.array([last[j - k]]), np.array([t]))[0])
                            if not good:
                                continue
                        last[j], back[j], count[j] = t, k, count[j - k] + 1
                        break
                    else:
                        count[j] = count[j - 1] + costs[j - begin - 1]
                else:
                    top, single = -np.inf, False
                    for c in range(a, b):
                        k, t = sizes[c], tokens[c]
                        single = single or k == 1
                        value = best[j - k] + self.scores[t]
                        if value > top:
                            top, last[j], back[j], count[j] = value, t, k, count[j - k] + 1
                    value = best[j - 1] + worst
                    if not single and value > top:
                        top, last[j], back[j], count[j] = value, none, 1, count[j - 1] + costs[j - begin - 1]
                    best[j] = top
        ids, j = array("i"), length
        while j:
            if last[j] != none:
                ids.append(last[j])
            else:
                ids.extend(self.byte_ids[list(chr(points[j - 1]).encode())][::-1].tolist() if self.byte_fallback else [self.unknown])
            j -= back[j]
        ids.reverse()
        return ids.tobytes(), count[1:].tobytes()

    def _probe(self, hashes: np.ndarray, j: int, k: int, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of ``which``, the chunks with a piece of k code points that ends at j, and its id."""
        if len(which) == hashes.shape[1]:
            h = hashes[j] - hashes[j - k] * self.powers[k]
        else:
            h = hashes[j, which] - hashes[j - k, which] * self.powers[k]
        likely = np.flatnonzero(self.filter[k][self._slot(h)])
        if not len(likely):
            return which[:0], np.zeros(0, np.int32)
        h = h[likely]
        at = np.minimum(np.searchsorted(self.keys[k], h), len(self.keys[k]) - 1)
        hit = self.keys[k][at] == h
        return which[likely[hit]], self.key_ids[k][at[hit]]

    def _paths(self, points: np.ndarray, last: np.ndarray, back: np.ndarray, count: np.ndarray) -> list[tuple[bytes, bytes]]:
        """Follow the backpointers of all chunks together; unknown characters become bytes."""
        length, n = points.shape
        none = len(self.strings)
        total = count[length].astype(np.int64)
        end = np.cumsum(total)
        ids = np.zeros(int(end[-1]), np.int32)
        at, put, live = np.full(n, length), end.copy(), np.arange(n)
        while len(live):
            j, token = at[live], last[at[live], live]
            plain = token != none
            ids[put[live[plain]] - 1] = token[plain]
            put[live[plain]] -= 1
            for i in live[~plain].tolist():
                own = self.byte_ids[list(chr(points[at[i] - 1, i]).encode())] if self.byte_fallback else np.array([self.unknown], np.int32)
                put[i] -= len(own)
                ids[put[i] : put[i] + len(own)] = own
            at[live] = j - back[j, live]
            live = live[at[live] > 0]
        counts = np.ascontiguousarray(count[1:].T)
        begin = end - total
        return [(ids[a:b].tobytes(), c.tobytes()) for a, b, c in zip(begin.tolist(), end.tolist(), counts)]

    # ------------------------------------------------------------ texts

    def chunks(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """Code of every chunk of every document, the chunks, and each document's first."""
        raw = data.tobytes()
        if self.squeeze or SPACE.encode() in raw:
            own = [raw[i:j].replace(SPACE.encode(), b" ") for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if self.squeeze:
                own = [b" ".join(x for x in t.split(b" ") if x) for t in own]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype(np.int64)
            data = np.frombuffer(b"".join(own), np.uint8)
        full = np.diff(offsets) > 0
        if self.dummy_prefix:
            data = np.insert(data, offsets[:-1][full], 32)
            offsets = offsets + np.concatenate([[0], np.cumsum(full)])
        cut = np.ones(len(data) + 1, bool)
        if len(data):
            cut[1:-1] = ~self.inside[(data[:-1].astype(np.uint16) << 8) | data[1:]]
            cut[offsets] = True
        starts = np.flatnonzero(cut)
        if len(data) == 0:
            return np.zeros(0, np.int32), pa.array([], pa.large_binary()), np.zeros(len(offsets), np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]).dictionary_encode()
        return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary, np.searchsorted(starts, offsets)

    def solved(self, dictionary: pa.Array, most: int = 80_000) -> list[tuple[bytes, bytes]]:
        """The lattices of distinct chunks; those of earlier blocks are kept, up to ``most``."""
        own = dictionary.to_pylist()
        found = [self.cache.get(c) for c in own]
        new = [i for i, f in enumerate(found) if f is None]
        if new:
            if len(self.cache) + len(new) > most:
                self.cache.clear()
            for i, x in zip(new, self.solve([own[i].decode().replace(" ", SPACE) for i in new]), strict=True):
                found[i] = x
                if len(own[i]) <= 64:
                    self.cache[own[i]] = x
        return found

    def encode(self, texts_: list[str]) -> list[list[int]]:
        """The ids of each text, without begin or end."""
        ids, at = self.encode_block(*texts(pa.array(texts_, pa.large_string())))
        return [ids[i:j].tolist() for i, j in zip(at[:-1].tolist(), at[1:].tolist())]

    def encode_block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a block of texts, and where each text's begin."""
        codes, dictionary, doc = self.chunks(data, offsets)
        found = self.solved(dictionary)
        pool = np.frombuffer(b"".join(f[0] for f in found), np.int32)
        size = np.array([len(f[0]) // 4 for f in found], np.int64)
        first = np.cumsum(size) - size
        n = size[codes]
        begin = np.concatenate([[0], np.cumsum(n)])
        ids = pool[np.repeat(first[codes] - begin[:-1], n) + np.arange(begin[-1])]
        return ids, begin[doc]

    def prefix_counts(self, text: str) -> np.ndarray:
        """The number of tokens of text[:k], for every k from 0 on."""
        codes, dictionary, _ = self.chunks(*texts(pa.array([text], pa.large_string())))
        found = self.solved(dictionary)
        out, done = [np.zeros(1, np.int64)], 0
        for c in codes.tolist():
            own = np.frombuffer(found[c][1], np.int32)
            out.append(own + done)
            done += int(own[-1])
        counts = np.concatenate(out)
        if self.dummy_prefix and text:  # the first code point is the added space
            counts = np.concatenate([[0], counts[2:]])
        return counts

    def decode_block(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The text of each run of ids."""
        size = np.diff(self.surface_at)
        n = size[ids]
        begin = np.concatenate([[0], np.cumsum(n)])
        raw = self.surface[np.repeat(self.surface_at[ids] - begin[:-1], n) + np.arange(begin[-1])].tobytes()
        cut = begin[at].tolist()
        out = []
        for i, j in zip(cut[:-1], cut[1:]):
            own = raw[i:j].decode("utf-8", "replace")
            out.append(own[1:] if self.dummy_prefix and own.startswith(" ") else own)
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        flat = np.array([x for own in ids for x in own], np.int64)
        return self.decode_block(flat, np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64))


@lru_cache(2)
def load(model: bytes) -> Pieces:
    """The tables of a model, made once in a process."""
    return Pieces(model)


def model_bytes(path: str | None = None) -> bytes:
    """A model file as bytes, to send along with the tasks; the public 32k file if none is named."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    with open(path, "rb") as f:
        return f.read()
