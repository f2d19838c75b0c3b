"""Minimizers of texts longer than the places in a key."""

import numpy as np
import pytest

from vigil.llm import minimizers


@pytest.mark.parametrize("size", [100, 255, 256, 287, 288, 289, 5000])
def test_places_beyond_the_low_bits_of_a_key(monkeypatch, size):
    monkeypatch.setattr(minimizers, "_ORDER_BITS", 56)          # places up to 255
    buf = np.random.default_rng(size).integers(97, 100, size).astype(np.uint8)
    h = minimizers.gram_hash(buf, 32)
    w = 100 - 32 + 1
    want = [min(range(i, i + w), key=lambda p: (int(h[p]) >> 8, p)) for i in range(size - 99)]
    hash_, row, start, n, off = minimizers.pieces(buf, np.array([0, size]), 100, 32)
    assert (off >= 0).all() and (off < w).all() and n.sum() == size - 99
    assert np.repeat(start + off, n).tolist() == want and (hash_ == h[start + off]).all()


def test_copy_behind_16_mib_has_the_pieces_of_its_source():
    rng = np.random.default_rng(5)
    passage = rng.integers(97, 123, 400).astype(np.uint8)
    long = np.concatenate([rng.integers(97, 123, (1 << 24) + 1000).astype(np.uint8), passage])
    find = lambda b: minimizers.pieces(b, np.array([0, len(b)]), 100, 32)
    short, far = find(passage), find(long)
    assert (far[4] >= 0).all() and set(short[0].tolist()) <= set(far[0][-40:].tolist())
