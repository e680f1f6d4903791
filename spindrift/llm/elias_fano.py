"""Elias-Fano coded sorted integers over memory-mapped arrays, with vectorised access and successor search."""

from __future__ import annotations

import json
import mmap
import sys

import numpy as np

U = np.uint64


def pack_low(values: np.ndarray, width: int) -> np.ndarray:
    """The low `width` bits of each value, end to end in 64-bit words."""
    n = len(values)
    words = np.zeros((n * width + 63) // 64 + 1, U)
    if not width or not n:
        return words
    low = values & U((1 << width) - 1)
    at = np.arange(n, dtype=np.int64) * width
    word, off = at >> 6, (at & 63).astype(U)
    first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
    words[word[first]] = np.bitwise_or.reduceat(low << off, first)
    over = np.flatnonzero(off.astype(np.int64) + width > 64)
    words[word[over] + 1] |= low[over] >> (U(64) - off[over])
    return words


def coded(values: np.ndarray, universe: int, prefix: str) -> dict[str, np.ndarray]:
    """Arrays of the sequence: values ascending, below `universe`. Low bits are packed, high bits in unary, with ranks of ones and zeros by word."""
    n = len(values)
    width = max(0, (max(1, universe) // max(1, n)).bit_length() - 1)
    high = (values >> U(width)).astype(np.int64)
    size = n + (int(high[-1]) if n else 0) + 2
    bits = np.zeros(-(-size // 64) * 64, np.uint8)
    bits[high + np.arange(n)] = 1
    words = np.packbits(bits, bitorder="little").view(U)
    ones = np.r_[0, np.cumsum(np.bitwise_count(words).astype(np.int64))]
    return {
        f"{prefix}.shape": np.array([n, width], np.int64),
        f"{prefix}.low": pack_low(values, width),
        f"{prefix}.high": words,
        f"{prefix}.ones": ones.astype(np.uint32),
        f"{prefix}.zeros": (64 * np.arange(len(ones)) - ones).astype(np.uint32),
    }


#: For each byte, the places of its ones.
IN_BYTE = np.zeros((256, 8), np.uint8)
for _byte in range(256):
    _ones = [i for i in range(8) if _byte >> i & 1]
    IN_BYTE[_byte, : len(_ones)] = _ones
IN_BYTE = IN_BYTE.ravel()
L, H = U(0x0101010101010101), U(0x8080808080808080)


def in_word(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the nth one (from 0) of each 64-bit word: the byte by sums over all bytes at once, the bit by table."""
    nth = nth.astype(U)
    s = words - ((words >> U(1)) & U(0x5555555555555555))
    s = (s & U(0x3333333333333333)) + ((s >> U(2)) & U(0x3333333333333333))
    s = ((s + (s >> U(4))) & U(0x0F0F0F0F0F0F0F0F)) * L  # ones up to each byte
    off = np.bitwise_count((((nth * L) | H) - s) & H).astype(U) << U(3)
    rest = nth - (((s << U(8)) >> off) & U(0xFF))
    byte = (words >> off) & U(0xFF)
    return off.astype(np.int64) + IN_BYTE[((byte << U(3)) | rest).astype(np.int64)]


class Sequence:
    """A coded sequence."""

    def __init__(self, arrays: dict[str, np.ndarray], prefix: str):
        self.n, self.width = (int(x) for x in arrays[f"{prefix}.shape"])
        self.low, self.high, self.ones, self.zeros = (arrays[f"{prefix}.{x}"] for x in ("low", "high", "ones", "zeros"))
        self.highest = 64 * len(self.high) - self.n

    def low_of(self, i: np.ndarray) -> np.ndarray:
        if not self.width:
            return np.zeros(len(i), U)
        at = i * self.width
        word, off = at >> 6, (at & 63).astype(U)
        got = self.low[word] >> off
        over = off.astype(np.int64) + self.width > 64
        got |= np.where(over, self.low[word + 1] << ((U(64) - off) & U(63)), U(0))
        return got & U((1 << self.width) - 1)

    def values(self, i: np.ndarray) -> np.ndarray:
        """Values at the places i, all within the sequence."""
        word = np.searchsorted(self.ones, i, "right") - 1
        place = 64 * word + in_word(self.high[word], i - self.ones[word])
        return ((place - i).astype(U) << U(self.width)) | self.low_of(i)

    def _before(self, high: np.ndarray) -> np.ndarray:
        """Number of values whose high part is below `high`."""
        out = np.zeros(len(high), np.int64)
        some = np.flatnonzero(high > 0)
        nth = np.minimum(high[some], self.highest) - 1  # the zero that ends the part before
        word = np.searchsorted(self.zeros, nth, "right") - 1
        place = 64 * word + in_word(~self.high[word], nth - self.zeros[word])
        out[some] = np.where(high[some] > self.highest, self.n, place - nth)
        return out

    def _bucket(self, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place of the values with this high part, and the place after them: as far as the ones go from there."""
        lo = self._before(high)
        at = np.minimum(lo + np.minimum(high, self.highest), 64 * len(self.high) - 1)
        word, off = at >> 6, (at & 63).astype(U)
        ahead = (self.high[word] >> off) | np.where(off > 0, self.high[np.minimum(word + 1, len(self.high) - 1)] << ((U(64) - off) & U(63)), U(0))
        run = np.bitwise_count(ahead & ~(ahead + U(1))).astype(np.int64)
        end = np.minimum(lo + run, self.n)
        far = np.flatnonzero(run >= 60)
        end[far] = self._before(high[far] + 1)
        return lo, end

    def _search(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Place of the first value that isn't below each x, the end of the values with x's high part, and x's low part."""
        lo, end = self._bucket(np.minimum(x >> U(self.width), U(1 << 62)).astype(np.int64))
        want = x & U((1 << self.width) - 1) if self.width else np.zeros(len(x), U)
        hi = end.copy()
        going = np.flatnonzero(lo < hi)
        while len(going):
            mid = (lo[going] + hi[going]) >> 1
            less = self.low_of(mid) < want[going]
            lo[going] = np.where(less, mid + 1, lo[going])
            hi[going] = np.where(less, hi[going], mid)
            going = going[lo[going] < hi[going]]
        return lo, end, want

    def successor(self, x: np.ndarray) -> np.ndarray:
        """Place of the first value that isn't below each x; the length, if there is none."""
        return self._search(x)[0]

    def find(self, x: np.ndarray) -> np.ndarray:
        """Place of each x, -1 if it isn't there: the successor, if it has x's high part and low part."""
        lo, end, want = self._search(x)
        out = np.full(len(x), -1, np.int64)
        inside = np.flatnonzero(lo < end)
        hit = inside[self.low_of(lo[inside]) == want[inside]]
        out[hit] = lo[hit]
        return out


def to_bytes(arrays: dict[str, np.ndarray]) -> bytes:
    """One file: a line of JSON that tells names, types and places, then the arrays, each at a multiple of 8 bytes."""
    head, at = {}, 0
    for name, a in arrays.items():
        head[name] = [a.dtype.str, len(a), at]
        at += -(-a.nbytes // 8) * 8
    line = json.dumps(head).encode()
    line += b" " * (-(len(line) + 1) % 8) + b"\n"
    return b"".join([line, *(x for a in arrays.values() for x in (a.tobytes(), b"\0" * (-a.nbytes % 8)))])


#: Maps keep no file open, where Python allows it: a worker has more of them than files it may open.
UNTRACKED = {"trackfd": False} if sys.version_info >= (3, 13) else {}


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory; nothing is read until it is used."""
    with open(path, "rb") as f:
        line = f.readline()
        data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **UNTRACKED)
    return {name: np.frombuffer(data, dtype, n, len(line) + at) for name, (dtype, n, at) in json.loads(line).items()}
