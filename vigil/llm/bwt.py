"""Column-wise Burrows-Wheeler transform of a collection of byte strings.

Strings are read from their ends, one symbol of every string per round.  After
round r the transform covers all suffixes of up to r bytes; the next round's
suffixes are each string's last one with one byte in front, and their places
follow from the rank of that byte in the transform (LF mapping).  Inserting
them keeps the order, and once all columns are in, neighbours in the order are
the suffixes with the longest common prefixes.
"""

from __future__ import annotations

import numpy as np


def _insert(old: np.ndarray, keep: np.ndarray, at: np.ndarray, new) -> np.ndarray:
    out = np.empty(len(keep), old.dtype)
    out[keep] = old
    out[at] = new
    return out


def sorted_suffixes(data: np.ndarray, ends: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(string, start) of every suffix of at least ``least`` bytes, in the order of the suffixes.

    String i is data[ends[i]:ends[i + 1]]; bytes are compared as unsigned, byte 0 is shifted up by one
    so that 0 marks a string's front.
    """
    size = np.diff(ends)
    m = len(size)
    # 16-bit symbols: 0 = nothing in front, else byte + 1; 8 bits do when no byte is 255 (UTF-8 has none)
    sym = data.astype(np.uint16) + 1 if len(data) and data.max() == 255 else data + np.uint8(1)
    live = np.flatnonzero(size)                        # strings with a suffix still to come, in order of their last place
    bwt = np.zeros(m, sym.dtype)
    bwt[live] = sym[ends[1:][live] - 1]
    place = live.copy()                                # row of each live string's last suffix
    who = start = None
    for r in range(1, int(size.max(initial=0)) + 1):
        n = len(bwt)
        rank = np.empty(n, np.int64)
        rank[np.argsort(bwt, kind="stable")] = np.arange(n)
        new = rank[place] - np.count_nonzero(bwt == 0) + m
        order = np.argsort(new)
        live, at = live[order], new[order] + 0
        # old rows keep their order; rank already counts the new rows in front of each new one
        first = sym[np.minimum(ends[live] + size[live] - r - 1, len(sym) - 1)]
        front = np.where(size[live] > r, first, 0).astype(sym.dtype)
        keep = np.ones(n + len(live), bool)
        keep[at] = False
        bwt = _insert(bwt, keep, at, front)
        if r >= least:
            if who is None:
                who = np.full(n, -1, np.int32)
                start = np.zeros(n, np.int32)
            who = _insert(who, keep, at, live)
            start = _insert(start, keep, at, size[live] - r)
        more = size[live] > r
        live, place = live[more], at[more]
        if not len(live):
            break
    if who is None:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    rows = np.flatnonzero(who >= 0)
    return who[rows].astype(np.int64), start[rows].astype(np.int64)


def equal_prefix(data: np.ndarray, pos: np.ndarray, n: int) -> np.ndarray:
    """Whether the n bytes at pos[i] equal those at pos[i + 1] (every position has n bytes)."""
    same = np.arange(len(pos) - 1)
    words = np.ndarray((max(len(data) - 7, 0),), "<u8", np.ascontiguousarray(data), strides=(1,))
    for k in [*range(0, n - 7, 8), n - 8] if n >= 8 else ():
        same = same[words[pos[same] + k] == words[pos[same + 1] + k]]
    if n < 8:
        for k in range(n):
            same = same[data[pos[same] + k] == data[pos[same + 1] + k]]
    out = np.zeros(max(len(pos) - 1, 0), bool)
    out[same] = True
    return out
