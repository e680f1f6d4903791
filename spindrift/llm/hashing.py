"""Hashes of all words of many texts at once."""

from __future__ import annotations

import numpy as np

U = np.uint64
IS_BLANK = np.zeros(256, bool)
IS_BLANK[[9, 10, 11, 12, 13, 32]] = True
#: Bytes that are hashed at a time; the arrays for that take some fifty times as much memory.
CHUNK = 1 << 19
BASES = (U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93))


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    h = (h ^ (h >> U(32))) * U(0xD6E8FEB86659FD93)
    return h ^ (h >> U(32))


def word_hashes(texts: list[str], prefix: int | None = None, bases: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of each word `[^\\x20\\x09-\\x0D]+` of all texts, A-Z in lower case, or of its first `prefix` bytes, and the words of each text.

    A word's bytes are the coefficients of polynomials modulo 2^64, at one or two odd `bases`, whose values are mixed.
    """
    data = [t.encode("utf-8", "surrogatepass").lower() for t in texts]
    a = np.frombuffer(b"\n".join(data) + b"\n", np.uint8)
    text_ends = np.cumsum([len(x) + 1 for x in data])
    hashes, starts, at = [], [], 0
    while at < len(a):
        end = _after_blank(a, at)
        own, places = _hashes(a[at:end], prefix, bases)
        hashes.append(own)
        starts.append(places + at)
        at = end
    if not hashes:
        return np.zeros(0, U), np.zeros(len(texts), np.int64)
    return np.concatenate(hashes), np.diff(np.searchsorted(np.concatenate(starts), np.r_[0, text_ends]))


def _after_blank(a: np.ndarray, at: int) -> int:
    """A place after a blank, about CHUNK bytes on; farther, if a word is longer."""
    while at < len(a):
        end = min(at + CHUNK, len(a))
        blanks = np.flatnonzero(IS_BLANK[a[at:end]])
        if len(blanks):
            return at + int(blanks[-1]) + 1
        at = end
    return len(a)


def _hashes(a: np.ndarray, prefix: int | None, bases: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of bytes that end with a blank, and where they start."""
    blank = IS_BLANK[a]
    starts = np.flatnonzero(~blank & np.r_[True, blank[:-1]])
    out = np.zeros(len(starts), U)
    if not len(starts):
        return out, starts
    ends = np.flatnonzero(blank & np.r_[False, ~blank[:-1]])
    sizes = ends - starts
    solid = a[~blank].astype(U) + U(1)
    first = np.cumsum(sizes) - sizes
    place = np.arange(len(solid)) - np.repeat(first, sizes)
    for base in BASES[:bases]:
        powers = np.cumprod(np.full(int(sizes.max()), base, U))
        if prefix:
            powers[prefix:] = 0
        out = mixed(out ^ np.add.reduceat(solid * powers[place], first))
    return out, starts
