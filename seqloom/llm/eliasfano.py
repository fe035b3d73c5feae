"""Elias-Fano sequences and an n-gram trie level in one memory mapping."""

from __future__ import annotations

import io
import json
import mmap
from typing import BinaryIO

import numpy as np

_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).sum(1).astype(np.int64)
#: place of the k-th one of a byte
_PLACE = np.full((256, 8), 8, np.int64)
for _b in range(256):
    _ones = [i for i in range(8) if _b >> i & 1]
    _PLACE[_b, : len(_ones)] = _ones


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """``width`` low bits of each value, one after the other, least significant first."""
    n = len(values)
    out = np.zeros((n * width + 63) // 64 + 2, np.uint64)
    if not width or not n:
        return out
    at = np.arange(n, dtype=np.int64) * width
    word, shift = at >> 6, (at & 63).astype(np.uint64)
    v = values.astype(np.uint64) & np.uint64((1 << width) - 1)
    np.bitwise_or.at(out, word, v << shift)
    over = (at & 63) + width > 64
    np.bitwise_or.at(out, word[over] + 1, v[over] >> (np.uint64(64) - shift[over]))
    return out


class EliasFano:
    """A rising sequence of unsigned integers: low bits packed, high bits in unary.

    ``arrays`` are plain numpy arrays, in memory or memory-mapped.
    """

    def __init__(self, n: int, width: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.n, self.width, self.low, self.high, self.ones = n, width, low, high, ones

    @classmethod
    def build(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        top = int(values[-1]) if n else 0
        width = max(0, (top // max(1, n)).bit_length() - 1)
        tall = (values >> np.uint64(width)).astype(np.int64)
        places = tall + np.arange(n)
        size = (int(places[-1]) if n else 0) + 2
        bits = np.zeros(-(-size // 64) * 64, np.uint8)
        bits[places] = 1
        high = np.packbits(bits, bitorder="little")
        # ones before each 64 bits
        ones = np.concatenate([[0], np.cumsum(_BITS[high].reshape(-1, 8).sum(1))]).astype(np.int64)
        return cls(n, width, _pack(values, width), high, ones)

    def arrays(self) -> dict[str, np.ndarray]:
        return {"low": self.low, "high": self.high, "ones": self.ones}

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), np.uint64)
        at = i * self.width
        word, shift = at >> 6, (at & 63).astype(np.uint64)
        v = self.low[word] >> shift
        over = (shift.astype(np.int64) + self.width) > 64
        if over.any():
            v[over] |= self.low[word[over] + 1] << (np.uint64(64) - shift[over])
        return v & np.uint64((1 << self.width) - 1)

    def _select(self, k: np.ndarray, ones: bool) -> np.ndarray:
        """The place of the k-th one (or zero) of the high bits; past the end, a place beyond all."""
        before = self.ones if ones else np.arange(len(self.ones), dtype=np.int64) * 64 - self.ones
        word = np.searchsorted(before, k, "right") - 1
        beyond = word >= len(self.ones) - 1
        word = np.minimum(word, len(self.ones) - 2)
        left = k - before[word]
        at = word * 8
        for _ in range(7):  # to the byte that has it
            own = self.high[at]
            here = _BITS[own] if ones else 8 - _BITS[own]
            on = left >= here
            left = np.where(on, left - here, left)
            at = at + on
            if not on.any():
                break
        own = self.high[at]
        place = at * 8 + _PLACE[own if ones else 255 - own, np.clip(left, 0, 7)]
        return np.where(beyond, np.int64(1 << 62), place)

    def access(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        i = np.asarray(i, np.int64)
        tall = (self._select(i, True) - i).astype(np.uint64)
        return (tall << np.uint64(self.width)) | self._low(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The first index whose value is at least x (n if there is none)."""
        x = np.asarray(x, np.uint64)
        if not self.n:
            return np.zeros(len(x), np.int64)
        tall = (x >> np.uint64(self.width)).astype(np.int64)
        # values of a lower high part come before the tall-th zero
        begin = np.where(tall > 0, self._select(np.maximum(tall - 1, 0), False) - (tall - 1), 0)
        end = self._select(tall, False) - tall
        begin, end = np.minimum(begin, self.n), np.minimum(end, self.n)
        want = x & np.uint64((1 << self.width) - 1)
        while True:
            open_ = np.flatnonzero(begin < end)
            if not len(open_):
                return begin
            middle = (begin[open_] + end[open_]) >> 1
            less = self._low(middle) < want[open_]
            begin[open_] = np.where(less, middle + 1, begin[open_])
            end[open_] = np.where(less, end[open_], middle)


# ---------------------------------------------------------------- the trie


class Codes:
    """Log10 probabilities in ``levels`` even steps down to ``floor``; code 0 is none."""

    def __init__(self, floor: float, levels: int = 255):
        self.floor, self.levels = floor, levels
        self.values = np.concatenate([[0.0], 10 ** np.linspace(floor, 0, levels)])

    def of(self, p: np.ndarray) -> np.ndarray:
        x = np.clip(np.log10(np.maximum(p, 1e-300)), self.floor, 0)
        return (1 + np.rint((x / -self.floor + 1) * (self.levels - 1))).astype(np.uint8)

    def value(self, code: np.ndarray) -> np.ndarray:
        return self.values[code]


SEEN, BACKOFF = Codes(-9.0), Codes(-9.0)


class TrieLevel:
    """Contexts and, for each, its successors, relative to the context.

    Context hashes and pointers rise and are kept in Elias-Fano form.  Successor ids
    (``succ_bits`` wide) are made to rise through the whole level by adding, for each
    context, what the contexts before it have used up; a lookup adds the context's
    base and searches the successor of the sum.
    """

    FIELDS = ("contexts", "pointers", "successors")

    def __init__(self, sequences: dict[str, EliasFano], seen: np.ndarray, backoff: np.ndarray):
        self.contexts, self.pointers, self.successors = (sequences[f] for f in self.FIELDS)
        self.seen, self.backoff = seen, backoff

    @classmethod
    def build(cls, context: np.ndarray, successor: np.ndarray, seen: np.ndarray, backoff: np.ndarray) -> TrieLevel:
        """``context`` and ``successor`` sorted and distinct as pairs; ``seen`` by pair, ``backoff`` by context."""
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(context) else np.zeros(0, np.int64)
        pointers = np.append(heads, len(context))
        last = successor[pointers[1:] - 1].astype(np.uint64) + np.uint64(1) if len(heads) else np.zeros(0, np.uint64)
        base = np.cumsum(last) - last
        rising = successor.astype(np.uint64) + np.repeat(base, np.diff(pointers))
        own = {"contexts": EliasFano.build(context[heads]), "pointers": EliasFano.build(pointers), "successors": EliasFano.build(rising)}
        return cls(own, SEEN.of(seen), BACKOFF.of(backoff))

    def save(self, out: BinaryIO) -> None:
        """One file: its head's size, a line of JSON, then the arrays on 8-byte borders."""
        arrays, about, at = [], {"n": {}, "width": {}, "at": {}}, 0
        for f in self.FIELDS:
            s = getattr(self, f)
            about["n"][f], about["width"][f] = s.n, s.width
            arrays += [(f"{f}.{k}", v) for k, v in s.arrays().items()]
        arrays += [("seen", self.seen), ("backoff", self.backoff)]
        for name, a in arrays:
            about["at"][name] = (at, a.dtype.str, len(a))
            at += -(-a.nbytes // 8) * 8
        head = json.dumps(about).encode()
        head += b" " * (-(len(head) + 9) % 8) + b"\n"
        out.write(len(head).to_bytes(8, "little") + head)
        for _, a in arrays:
            out.write(a.tobytes() + bytes(-a.nbytes % 8))

    @classmethod
    def open(cls, raw: np.ndarray) -> TrieLevel:
        """The level of a mapped file's bytes: only the pages that lookups touch are read."""
        size = int.from_bytes(raw[:8].tobytes(), "little")
        about = json.loads(raw[8 : 8 + size].tobytes())
        get = {}
        for name, (at, kind, n) in about["at"].items():
            start = 8 + size + at
            get[name] = raw[start : start + n * np.dtype(kind).itemsize].view(kind)
        own = {f: EliasFano(about["n"][f], about["width"][f], *(get[f"{f}.{k}"] for k in ("low", "high", "ones"))) for f in cls.FIELDS}
        return cls(own, get["seen"], get["backoff"])

    def find(self, context: np.ndarray, successor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the pairs and of their contexts' backoff; 0 where there is none."""
        n = self.contexts.n
        seen, backoff = np.zeros(len(context), np.uint8), np.zeros(len(context), np.uint8)
        if not n or not len(context):
            return seen, backoff
        # a run of one context is looked up once
        heads = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
        runs = np.diff(np.append(heads, len(context)))
        own = context[heads].astype(np.uint64)
        c = self.contexts.successor(own)
        known = np.flatnonzero(c < n)
        known = known[self.contexts.access(c[known]) == own[known]]
        begin, end = np.zeros(len(heads), np.int64), np.zeros(len(heads), np.int64)
        base, back = np.zeros(len(heads), np.uint64), np.zeros(len(heads), np.uint8)
        c = c[known]
        back[known] = self.backoff[c]
        begin[known], end[known] = self.pointers.access(c), self.pointers.access(c + 1)
        later = known[begin[known] > 0]
        base[later] = self.successors.access(begin[later] - 1) + np.uint64(1)
        backoff[:] = np.repeat(back, runs)
        begin, end = np.repeat(begin, runs), np.repeat(end, runs)
        want = np.repeat(base, runs) + successor.astype(np.uint64)
        at = self.successors.successor(want)
        inside = np.flatnonzero((at >= begin) & (at < end))
        inside = inside[self.successors.access(at[inside]) == want[inside]]
        seen[inside] = self.seen[at[inside]]
        return seen, backoff

    def nbytes(self) -> int:
        return sum(a.nbytes for f in self.FIELDS for a in getattr(self, f).arrays().values()) + self.seen.nbytes + self.backoff.nbytes


def mapped(level: TrieLevel) -> TrieLevel:
    """The level in a mapping of its own, outside any disk: it goes when the mapping does."""
    held = io.BytesIO()
    level.save(held)
    size = held.tell()
    own = mmap.mmap(-1, max(1, size))
    own[:size] = held.getbuffer()
    return TrieLevel.open(np.frombuffer(own, np.uint8, size))
