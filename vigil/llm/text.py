"""Vectorised text kernels used inside Arrow tasks.

Everything works on one *slice*: the UTF-8 bytes of a few neighbouring rows
(about a megabyte, or one long text) as a numpy byte array plus row offsets.
Separators are ASCII in every operator, so byte-level classes equal
code-point classes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_MULT = np.uint64(0x9E3779B97F4A7C15)
_ODD = np.uint64(0xD6E8FEB86659FD93)
_INV = np.uint64(pow(int(_ODD), -1, 1 << 64))

SPACE = np.zeros(256, bool)                      # [\x20\x09-\x0D]
SPACE[[0x20, *range(0x09, 0x0E)]] = True
NOT_SPACE = ~SPACE
ALNUM = np.zeros(256, bool)                      # [^\x00-\x2F\x3A-\x60\x7B-\x7F] (after lower-casing A-Z)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x80:] = True
LOWER = np.arange(256, dtype=np.uint8)           # A-Z -> a-z, bytes of other letters untouched
LOWER[0x41:0x5B] += 32

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
#: One random 64-bit value per byte (and a second, independent table for 128-bit keys).
_BYTES = np.random.default_rng(20240601).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """ODD**i and ODD**-i modulo 2**64 for i < n (kept between calls)."""
    if len(_powers[0]) < n:
        size = max(n, 2 * len(_powers[0]))
        for i, base in enumerate((_ODD, _INV)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser: spreads every input bit over all 64."""
    h = h ^ (h >> np.uint64(32))
    h = h * _MULT
    h ^= h >> np.uint64(29)
    h = h * _ODD
    return h ^ (h >> np.uint64(32))


def slices(batch: pa.RecordBatch, column: str = "text", max_bytes: int = SLICE_BYTES) -> Iterator[tuple]:
    """Cut a batch into (first row, stop row, bytes, offsets); nulls are empty texts.

    A text longer than ``max_bytes`` gets a slice of its own and is whole.
    """
    arr = batch.column(column)
    n = len(arr)
    if not n:
        return
    if pa.types.is_binary(arr.type):
        arr = pc.fill_null(arr, b"") if arr.null_count else arr
    else:
        arr = pc.fill_null(arr, "") if arr.null_count else arr
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    bufs = arr.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[arr.offset:arr.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = int(np.searchsorted(offs, offs[i] + max_bytes, "right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends (exclusive) and, per row, the index of its first word (n + 1 entries)."""
    if not len(buf):
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(len(offs), np.int64)
    m = is_word[buf]
    edge = np.empty(len(m) + 1, bool)
    edge[0], edge[-1] = m[0], m[-1]
    np.not_equal(m[1:], m[:-1], out=edge[1:-1])
    marks = np.flatnonzero(edge)
    inner = np.unique(offs[1:-1])
    inner = inner[(inner > 0) & (inner < len(m))]
    inner = inner[m[inner] & m[inner - 1]]        # one word touches the row's end, the next the following start
    if len(inner):
        marks = np.sort(np.concatenate([marks, inner, inner]), kind="stable")
    starts, ends = marks[0::2], marks[1::2]
    return starts, ends, np.searchsorted(starts, offs)


def span_hash(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, table: int = 0) -> np.ndarray:
    """64-bit polynomial hash of buf[start:end] for every span (equal bytes, equal hash)."""
    pw, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_BYTES[table][buf] * pw[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts] + (ends - starts).astype(np.uint64))


def run_hash(values: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of n consecutive 64-bit values (len(values) - n + 1 of them)."""
    m = len(values) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    h = values[:m].copy()
    for i in range(1, n):
        h *= _ODD
        h += values[i:i + m]
    return mix(h)


def covered(starts: np.ndarray, length, size: int) -> np.ndarray:
    """Boolean mask of the positions inside any [start, start + length)."""
    d = np.zeros(size + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, size), -1)
    return np.cumsum(d[:-1]) > 0


def count_by_row(mask: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Number of set entries of ``mask`` in each [first[i], first[i+1])."""
    c = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def join_words(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[bytes, np.ndarray]:
    """The words as bytes, one blank behind each, and every word's start there (one entry more than words)."""
    size = ends - starts
    at = np.concatenate([[0], np.cumsum(size + 1)])
    out = np.full(at[-1], 0x20, np.uint8)
    n = np.arange(size.sum())
    before = np.cumsum(size) - size
    out[n + np.repeat(at[:-1] - before, size)] = buf[n + np.repeat(starts - before, size)]
    return out.tobytes(), at
