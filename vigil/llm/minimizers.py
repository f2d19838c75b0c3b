"""Window minimizers of byte strings, vectorised.

Among the k-byte strings inside a window of ``window`` bytes the one with the
least hash (leftmost of equals) is the window's minimizer.  Equal windows have
it at the same place, so they can meet by its value alone.  Consecutive windows
mostly share one occurrence; such a run of windows is a *piece*.
"""

from __future__ import annotations

import numpy as np

from vigil.llm.text import _BYTES, mix, powers

_ORDER_BITS = 40


def gram_hash(buf: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k bytes."""
    n = len(buf) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    pw, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[0][buf] * pw[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * inv[:n])


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of every w consecutive values (prefix and suffix minima of blocks of w)."""
    n = len(x) - w + 1
    full = -(-len(x) // w) * w
    padded = np.concatenate([x, np.full(full - len(x), np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1:w - 1 + n])


def least_places(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the least of every w consecutive hashes, by their high bits and then by place.

    The low bits hold the place relative to a block; blocks overlap so that every window lies in one.
    """
    low = np.uint64((1 << 64 - _ORDER_BITS) - 1)
    most = int(low) + 1
    out = []
    for a in range(0, len(h) - w + 1, most - w + 1):
        part = h[a:a + most]
        key = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        out.append((sliding_min(key, w) & low).astype(np.int64) + a)
    return np.concatenate(out)


def pieces(buf: np.ndarray, offs: np.ndarray, window: int, k: int):
    """(hash, row, start, n, off) of every run of n windows sharing one minimizer occurrence, off bytes behind start in the row."""
    none = np.zeros(0, np.int64)
    if len(buf) < window:
        return none.astype(np.uint64), none, none, none, none
    h = gram_hash(buf, k)
    at = least_places(h, window - k + 1)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))[:len(at)]
    inside = np.arange(len(at)) + window <= offs[1:][row]            # windows never cross documents
    new = np.r_[True, (at[1:] != at[:-1]) | ~inside[:-1] | (row[1:] != row[:-1])]
    begin = np.flatnonzero(new & inside)
    closed = np.flatnonzero(np.r_[new[1:] | ~inside[1:], True] & inside)
    return h[at[begin]], row[begin], begin - offs[:-1][row[begin]], closed - begin + 1, at[begin] - begin
