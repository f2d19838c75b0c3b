"""Nearest rows of two blocks by Manhattan distance: sums of smaller values on a grid of small integers leave few pairs to measure.

On a grid |a - b| = a + b - 2 min(a, b): a distance is two known sums and one sum of minima, in numbers of two bytes.  Clipping
to the grid's range makes no distance longer and rounding at most by what it moved both rows, so a pair whose distance on the
grid is beyond the k-th so far by more than that cannot be among the k nearest.  All other pairs are measured exactly: results
do not depend on the grid.  Rows meet along diagonals (query i and reference i + s), so every step runs over whole arrays.
"""

from __future__ import annotations

import numpy as np

#: Greatest sum of a row on the grid, allowance that passes every pair, and rounding of a row that is too coarse (all in steps of the grid).
_SUM, _ALL, _COARSE = 32_000, 32_500, 200
#: Queries that walk along the references together, and references that give the first bounds at most.
TILE, START = 8192, 1024
#: Rows of a block and of k that the grid is worth.
LEAST_ROWS, MOST_K = 1024, 64
#: Share of pairs that may pass the grid, measured on the first steps.
PASSED = 0.02
_MEASURED = 32_768           # pairs measured at once
_PENDING = 400_000           # pairs that wait to be measured, about
#: Steps whose passing pairs are read off together.
STEPS = 32


class Grid:
    """Steps of one width along every coordinate, between the outer values of a sample of the rows."""

    def __init__(self, *blocks: np.ndarray):
        sample = np.concatenate([x[::max(1, len(x) // 4096)] for x in blocks])
        self.low, self.high = np.quantile(sample, [0.005, 0.995], axis=0)
        self.top = _SUM // sample.shape[1]
        self.width = float((self.high - self.low).max()) / max(self.top, 1)

    def coded(self, x: np.ndarray):
        """(steps by coordinate, half their sum, half the rounding) of every row; None if the grid is too coarse."""
        if not (np.isfinite(self.width) and self.width > 0 and self.top > 1):
            return None
        y = np.clip(x, self.low, self.high)
        steps = np.clip(np.floor((y - self.low) / self.width), 0, self.top - 1)
        moved = np.abs(y - (self.low + self.width * (steps + 0.5))).sum(axis=1)
        moved += 8 * np.finfo(float).eps * x.shape[1] * max(np.abs(self.low).max(), np.abs(self.high).max())
        half = np.ceil(moved / self.width / 2 * (1 + 1e-9)) + 1
        if half.max(initial=0) > _COARSE / 2:
            return None
        return np.ascontiguousarray(steps.T.astype(np.int16)), (steps.sum(axis=1) // 2).astype(np.int16), half.astype(np.int16)

    def allowed(self, limit: np.ndarray) -> np.ndarray:
        """Half the distances in steps, rounded up; ``_ALL`` passes every pair."""
        return np.minimum(np.ceil(np.minimum(limit / self.width, 3.0 * _ALL) / 2 * (1 + 1e-9)) + 1, _ALL).astype(np.int16)


class _Minima:
    """Sums over the coordinates of the smaller of two rows' steps."""

    def __init__(self, own: np.ndarray):
        self.own = own
        self.buf = np.empty(own.shape, np.int16)
        self.out, self.adds, n = np.empty(own.shape[1], np.int16), [], len(own)
        while n > 16:                                                # halves first: the last rows stay in the cache
            h = n // 2
            self.adds.append((self.buf[:h], self.buf[n - h:n]))
            n -= h
        self.last = self.buf[:n]

    def __call__(self, other: np.ndarray) -> np.ndarray:
        np.minimum(self.own, other, out=self.buf)
        for a, b in self.adds:
            np.add(a, b, out=a)
        return np.add.reduce(self.last, axis=0, dtype=np.int16, out=self.out)


class _Side:
    """Rows of one block: steps, allowances, and the best pairs (own row, other row, distance) so far."""

    def __init__(self, x, ids, place, coded, k):
        self.x, self.ids, self.place, self.k = x, ids, place, k
        self.steps, half, moved = coded
        self.half = half - moved
        self.limit = np.full(len(x), np.inf)
        self.best = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def offer(self, i, j, d, places):
        from vigil.operators.neighbors import _rank
        near = d <= self.limit[i]
        i, j, d = [np.concatenate(c) for c in zip(self.best, (i[near], j[near], d[near]))]
        order = np.lexsort((places[j], d))
        order = order[np.argsort(i[order].astype(np.uint16) if len(self.x) <= 1 << 16 else i[order], kind="stable")]
        i, j, d = i[order], j[order], d[order]
        rank = _rank(i)
        top = rank < self.k
        self.best = i[top], j[top], d[top]
        last = rank == self.k - 1
        self.limit[i[last]] = np.minimum(self.limit[i[last]], d[last])


def _measured(x, y, i, j):
    """Exact distances of the rows i of x and j of y in pairs."""
    from vigil.operators.neighbors import _exact_pairs
    return np.concatenate([np.zeros(0), *[_exact_pairs(x[i[s:s + _MEASURED]], y[j[s:s + _MEASURED]], 1.0) for s in range(0, len(i), _MEASURED)]])


def _places(hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the few true values; rows are whole words."""
    word = np.flatnonzero(hits.view(np.uint64))
    w, b = np.nonzero(hits.reshape(-1, 8)[word])
    return np.divmod(word[w] * 8 + b, hits.shape[1])


def _wrapped(a: np.ndarray, n: int) -> np.ndarray:
    """``a`` and its first ``n`` - 1 entries again along the last axis: every run of n entries lies together."""
    return np.concatenate([a, np.take(a, np.arange(n - 1) % a.shape[-1], axis=-1)], axis=-1)


def _first_bounds(own: _Side, other: _Side, exclude_self: bool):
    """k-th distances among some rows of the other block."""
    some = np.unique(np.linspace(0, len(other.x) - 1, max(min(START, len(other.x) // 32), 4 * own.k)).astype(int))
    for s in range(0, len(own.x), TILE):
        at = np.arange(s, min(len(own.x), s + TILE))
        minima = _Minima(np.ascontiguousarray(own.steps[:, at]))
        steps, half = _wrapped(np.ascontiguousarray(other.steps[:, some]), len(at)), _wrapped(other.half[some], len(at))
        ids = _wrapped(other.ids[some], len(at)) if exclude_self else None
        far = np.empty((len(some), len(at)), np.int16)
        for t in range(len(some)):
            np.subtract(half[t:t + len(at)], minima(steps[:, t:t + len(at)]), out=far[t])
            if exclude_self:
                far[t][own.ids[at] == ids[t:t + len(at)]] = np.iinfo(np.int16).max
        nearest = np.argpartition(np.ascontiguousarray(far.T), own.k - 1, axis=1)[:, :own.k]
        j = some[(nearest + np.arange(len(at))[:, None]) % len(some)]
        d = _measured(own.x, other.x, np.repeat(at, own.k), j.ravel()).reshape(j.shape)
        if exclude_self:
            d[own.ids[at][:, None] == other.ids[j]] = np.inf
        own.limit[at] = d.max(axis=1)


def nearest(x: np.ndarray, y: np.ndarray, xid: np.ndarray, yid: np.ndarray, xplace: np.ndarray, yplace: np.ndarray, k: int,
            exclude_self: bool, both: bool = False, bounds: tuple | None = None):
    """[(row of x, row of y, distance)]: the k nearest rows of y to every row of x, ties to the smaller place, sorted by row and distance.

    ``both`` adds the same for the rows of y: every pair is met once.  ``bounds`` are distances beyond which the rows of x and
    of y need nothing (inf: unknown), else a few rows of the other block give the first ones.  None where a grid does not help (few rows, many
    neighbours, coordinates of very different scale, too many pairs alike): the caller measures in another way.
    """
    if min(len(x), len(y)) < LEAST_ROWS or k > MOST_K:
        return None
    grid = Grid(x, y)
    coded = grid.coded(x), grid.coded(y)
    if coded[0] is None or coded[1] is None:
        return None
    own, other = _Side(x, xid, xplace, coded[0], k), _Side(y, yid, yplace, coded[1], k)
    if bounds:
        own.limit, other.limit = bounds[0].copy(), bounds[1].copy()
    else:
        _first_bounds(own, other, exclude_self)
        if both:
            _first_bounds(other, own, exclude_self)
    n, passed = len(y), 0
    size = -(-len(x) // -(-len(x) // TILE))                              # tiles of one size
    for s in range(0, len(x), size):
        c = min(len(x), s + size) - s
        minima = _Minima(np.ascontiguousarray(own.steps[:, s:s + c]))
        steps, half = _wrapped(other.steps, c), _wrapped(other.half, c)
        mine, level, wide, hits = own.half[s:s + c], np.empty(c, np.int16), np.empty(c, np.int16), np.zeros((STEPS, c + -c % 8), bool)
        allow, theirs = grid.allowed(own.limit[s:s + c]), _wrapped(grid.allowed(other.limit), c) if both else None
        pending, waiting, due = [], 0, START
        for t in range(n):
            m = minima(steps[:, t:t + c])
            np.add(mine, half[t:t + c], out=level)
            np.subtract(level, np.maximum(allow, theirs[t:t + c], out=wide) if both else allow, out=level)
            np.greater_equal(m, level, out=hits[t % STEPS, :c])
            if (t + 1) % STEPS and t + 1 < n:
                continue
            step, i = _places(hits[:t % STEPS + 1])
            pending.append((i + s, (i + step + t - t % STEPS) % n))
            waiting += len(i)
            if waiting > _PENDING or t + 1 >= due or t + 1 == n:
                due, passed = 2 * due if t + 1 >= due else due, passed + waiting
                if s == 0 and t < START and passed > 10 * PASSED * c * (t + 1):
                    return None
                i, j = [np.concatenate(a) for a in zip(*pending)]
                if exclude_self:
                    there = own.ids[i] != other.ids[j]
                    i, j = i[there], j[there]
                d = _measured(x, y, i, j)
                own.offer(i, j, d, other.place)
                allow = grid.allowed(own.limit[s:s + c])
                if both:
                    other.offer(j, i, d, own.place)
                    theirs = _wrapped(grid.allowed(other.limit), c)
                pending, waiting = [], 0
    return [own.best, other.best] if both else [own.best]
