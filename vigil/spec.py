"""Typed descriptions of series tables and detector settings.

The reference addressed columns by position (last column = label) and read
JSON configs whose keys were partly ignored.  Here a series is described by
names, and every detector config is a frozen dataclass: an unknown key is an
error, and every random choice takes an explicit seed (H5).
"""

from __future__ import annotations

from dataclasses import dataclass, field, fields


@dataclass(frozen=True)
class SeriesSpec:
    """How to read a labelled series table.

    keys   -- columns naming the series (empty list = one series)
    order  -- total order inside a series; the last column must be unique
    values -- numeric channels (doubles) used as features
    label  -- 0/1 anomaly label column, or None
    rid    -- unique row id (tiebreak, and the key scores are attached by)
    """

    keys: tuple = ("series_id",)
    order: tuple = ("ts", "rid")
    values: tuple = ("value",)
    label: str | None = "is_anomaly"
    rid: str = "rid"
    row_key: tuple = ()       # columns identifying a row when ``rid`` alone does not

    def key_cols(self) -> tuple:
        return self.row_key or (self.rid,)


def from_dict(cls, conf: dict):
    """Build a config dataclass from a JSON-like dict; unknown keys raise."""
    names = {f.name for f in fields(cls)}
    bad = set(conf) - names
    if bad:
        raise KeyError(f"unknown {cls.__name__} keys: {sorted(bad)}")
    return cls(**conf)


@dataclass(frozen=True)
class KnnConfig:
    k: int = 5
    p: float = 2.0             # Minkowski order
    percentile: float = 99.0   # flag iff score > this percentile
    block_rows: int = 4096     # rows per neighbour block


@dataclass(frozen=True)
class LoopConfig:
    k: int = 20
    extent: int = 3


@dataclass(frozen=True)
class ForestConfig:
    n_trees: int = 100
    max_samples: float = 256   # rows per tree (<= 1.0 means a fraction of n)
    max_features: float = 1.0  # features per tree (<= 1.0 means a fraction)
    bootstrap: bool = False    # draw each tree's rows with replacement
    seed: int = 42


@dataclass(frozen=True)
class WindowConfig:
    window: int = 45
    horizon: int = 1
    block_rows: int = 1_000_000


@dataclass(frozen=True)
class ForecastConfig:
    window: int = 45
    horizon: int = 1           # baseline only; trained models predict one step
    model: str = "linear"      # linear (Huber) | squared | gbt | baseline (window mean)
    train_fraction: float = 0.75
    level: float = 0.7         # flag iff score > level
    block_rows: int = 1_000_000


@dataclass(frozen=True)
class ReconstructConfig:
    window: int = 24
    rank: int = 4
    train_fraction: float = 0.4
    level: float = 0.995


@dataclass(frozen=True)
class SweepConfig:
    step: float = 0.01
    inclusive: bool = True     # flag iff score >= t (False: score > t)


@dataclass(frozen=True)
class GridSpec:
    params: dict = field(default_factory=dict)
