"""A block's grams are taken in piece by piece."""

import tracemalloc

import numpy as np

from demandlake.llm import ctw


def test_taken_in_is_a_merge():
    rng = np.random.default_rng(0)
    k, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
    keys, counts = [], []
    for size in (0, 5, 300, 1, 0, 200):
        u, c = np.unique(rng.integers(0, 400, size), return_counts=True)
        keys.append(u)
        counts.append(c)
        k, n = ctw._taken_in(k, n, u, c)
    want = ctw._merge(keys, counts)
    assert (k == want[0]).all() and (n == want[1]).all()


def test_pieces_are_not_held(monkeypatch):
    monkeypatch.setattr(ctw, "PIECE_BYTES", 1 << 16)
    rng = np.random.default_rng(1)
    text = bytes(rng.integers(97, 123, 1 << 16, dtype=np.uint8)) + ctw.END
    bodies = [text] * 14
    tracemalloc.start()
    list(ctw.block_entries(bodies, [True] * len(bodies), 5))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 10 << 20  # 14 pieces of a megabyte each, and their merge, took 49 MB
