"""Words, hashes and runs over whole Arrow batches of texts, as numpy arrays.

A batch is handled in slices of bounded bytes, so that the arrays stay small beside the texts.
A word's hash is its polynomial modulo two primes; modulo a power of two, some long words would share one
hash by their build alone, whatever the base. Hashes of several words mix the hashes of their halves.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text in one slice; a single longer text makes a slice of its own.
SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: The primes, with a base for each.
_FIELDS = [((1 << 31) - 1, 1_103_515_243), ((1 << 31) - 19, 1_812_433_253)]
_CODES = np.random.default_rng(20240601).permutation(1 << 11)[:256].astype(np.uint64) + np.uint64(1)
_NEXT = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@functools.lru_cache(2 * len(_FIELDS))
def _powers(field: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of a field's base and of its inverse, up to the n-th."""
    prime, base = _FIELDS[field]
    out = []
    for x in (base, pow(base, -1, prime)):
        powers = np.ones(n + 1, np.uint64)
        done = 1
        while done <= n:
            more = min(done, n + 1 - done)
            powers[done : done + more] = powers[:more] * np.uint64(pow(x, done, prime)) % np.uint64(prime)
            done += more
        out.append(powers)
    return out[0], out[1]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    n = len(data)
    out, codes = mix((end - start).astype(np.uint64)), _CODES[data]
    total = np.zeros(n + 1, np.uint64)
    for field, (prime, _) in enumerate(_FIELDS):
        up, down = _powers(field, 1 << max(20, (n - 1).bit_length()))
        p = np.uint64(prime)
        terms = codes * up[:n]
        if n > SLICE_BYTES:  # for fewer, codes of 11 bits and powers of 31 sum up to less than 2**64
            terms %= p
        np.cumsum(terms, out=total[1:])
        out = mix(out * _NEXT + (total[end] - total[start]) % p * down[start] % p)
    return out


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts of a string column on end, and each text's start, n + 1 values; null is empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type):
        kind = np.int64
    else:
        kind = np.int32
    if col.null_count:
        col = col.fill_null("")
    n = len(col)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, kind)[col.offset : col.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``limit`` bytes each, or one row."""
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


class Words:
    """The words of some texts: runs of bytes other than ASCII white space.

    ``start``, ``end``: places in ``data``; ``doc``: row of each word; ``first``: index of each row's
    first word, n + 1 values.
    """

    def __init__(self, data: np.ndarray, off: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.off = off
        n = len(data)
        solid = ~SPACE[data]
        begins = solid.copy()
        begins[1:] &= ~solid[:-1]
        inner = off[(off < n)]
        begins[inner] = solid[inner]
        ends = solid.copy()
        ends[:-1] &= ~solid[1:]
        last = off[off > 0] - 1
        ends[last] = solid[last]
        self.start = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, off)
        self.doc = np.repeat(np.arange(len(off) - 1), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        return span_hashes(self.data, self.start, self.end)


def grams(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each k consecutive values within a row, and the index of its first value."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    # Runs of 1, 2, 4, ... values; those whose sizes add up to k are joined from the left.
    run, size, out, taken = h, 1, None, 0
    while True:
        if k & size:
            out = mix(run[:n] + np.uint64(k)) if out is None else mix(out * _NEXT + run[taken : taken + n])
            taken += size
        if taken == k:
            break
        run, size = mix(run[:-size] * _NEXT + run[size:]), 2 * size
    at = np.flatnonzero(doc[:n] == doc[k - 1 :])
    return out[at], at
