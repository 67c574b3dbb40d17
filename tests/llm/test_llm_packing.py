"""The packing program over histograms of any size."""

import time

import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from tickloom.llm import packing


def sequences(plan):
    return sum(n for _, n in plan)


def one_by_one(histogram, capacity):
    """Room left of each sequence when pieces are placed singly."""
    rooms = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fits = [r for r in rooms if r >= length]
            if fits:
                rooms.remove(min(fits))
            rooms.append((min(fits) if fits else capacity) - length)
    return sorted(rooms)


@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_best_fit_in_bundles(histogram):
    plan = packing.best_fit(histogram, 64)
    rooms = sorted(64 - sum(length * k for length, k in config) for config, n in plan for _ in range(n))
    assert rooms == one_by_one(histogram, 64)
    packed = {length: sum(n * dict(c).get(length, 0) for c, n in plan) for length in histogram}
    assert packed == histogram


def test_best_fit_does_not_grow_with_the_pieces():
    rng = np.random.default_rng(2)
    few = {int(k): int(n) for k, n in zip(range(1, 4097), rng.integers(1, 9, 4096), strict=True)}
    begin = time.process_time()
    assert sequences(packing.best_fit({k: n * 1_000_000 for k, n in few.items()}, 4096)) >= 1_000_000 * sum(k * n for k, n in few.items()) / 4096
    assert time.process_time() - begin < 60


def test_many_lengths_near_half_the_capacity():
    values, counts = np.unique(np.random.default_rng(1).integers(1800, 2300, 6000), return_counts=True)
    histogram = dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert len(histogram) > 400
    plan = packing.solve(histogram, 4096)
    assert all(sum(length * k for length, k in config) <= 4096 for config, _ in plan)
    assert {length: sum(n * dict(c).get(length, 0) for c, n in plan) for length in histogram} == histogram
    assert sequences(plan) <= sequences(packing.best_fit(histogram, 4096))


def test_pricing_that_ends_early_finds_the_best():
    rng = np.random.default_rng(4)
    for _ in range(60):
        lengths = np.sort(rng.choice(np.arange(1, 90), 60, replace=False))[::-1]
        prices = lengths * rng.choice([0.1, 0.5, 0.97, 1.0], 60)
        most = rng.integers(1, 4, 60)
        best = np.zeros(101)
        for length, price, n in zip(lengths, prices, most, strict=True):
            for _ in range(n):
                best[length:] = np.maximum(best[length:], best[:101 - length] + price)
        counts = packing.price_knapsack(lengths, prices, most, 100)
        assert (counts <= most).all() and counts @ lengths <= 100
        assert abs(counts @ prices - best[100]) < 1e-9
