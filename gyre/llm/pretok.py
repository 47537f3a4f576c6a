"""The cut of texts into pieces before the merges of a byte-level BPE vocabulary.

The pieces are the matches of the public pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

found for many texts at once: code points are classed as letter, number, white space or other, runs of
one class are pieces, and the exceptions of the pattern (a space before a run, the last of several white
spaces, contractions) move the edges.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np

OTHER, LETTER, NUMBER, SPACE = 0, 1, 2, 3
# The code points of Unicode's White_Space.
_WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]


@functools.cache
def classes() -> np.ndarray:
    """The class of every code point."""
    # Categories have two letters each, of which the first is asked.
    kinds = np.frombuffer("".join(map(unicodedata.category, map(chr, range(0x110000)))).encode(), np.uint8)[::2]
    out = np.zeros(0x110000, np.uint8)
    out[kinds == ord("L")] = LETTER
    out[kinds == ord("N")] = NUMBER
    out[_WHITE] = SPACE
    return out


def cut(texts: list[str]) -> tuple[list[str], np.ndarray]:
    """All pieces of the texts in order, and the index of each text's first piece, n + 1 values."""
    whole = "".join(texts)
    off = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=off[1:])
    n = len(whole)
    if not n:
        return [], np.zeros(len(texts) + 1, np.int64)
    cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = classes()[cp]
    opens = np.zeros(n, bool)
    opens[off[off < n]] = True
    start = opens.copy()
    start[1:] |= kind[1:] != kind[:-1]
    # A run after white space in the same text: a plain space joins it, any other white space stands alone.
    after = np.flatnonzero(start[1:] & ~opens[1:] & (kind[1:] != SPACE) & (kind[:-1] == SPACE)) + 1
    start[after - 1] = True
    start[after[cp[after - 1] == 32]] = False
    # Contractions: an apostrophe that opens a piece, then letters.
    at = np.flatnonzero((cp == 39) & start)
    if len(at):
        end = off[np.searchsorted(off, at, "right")]
        one = np.where(at + 1 < end, cp[np.minimum(at + 1, n - 1)], 0)
        two = np.where(at + 2 < end, cp[np.minimum(at + 2, n - 1)], 0)
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) & (two == ord("e"))) | ((one == ord("v")) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
        for which, size in ((short, 2), (long & ~short, 3)):
            i = at[which]
            start[i + 1] = False
            then, stop = i + size, end[which]
            then = then[then < stop]
            start[then[kind[then] == LETTER]] = True
    begin = np.flatnonzero(start)
    edges = begin.tolist()
    edges.append(n)
    return [whole[a:b] for a, b in zip(edges, edges[1:])], np.searchsorted(begin, off)
