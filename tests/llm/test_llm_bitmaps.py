"""Bitmaps of sets bound what they can have in common."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom.llm import blobs, jaccard
from tickloom.llm.components import components


@settings(deadline=None, max_examples=200)
@given(st.sets(st.integers(0, 5000), min_size=1, max_size=300), st.sets(st.integers(0, 5000), max_size=40))
def test_no_similar_pair_is_ruled_out(base, change):
    other = base ^ change
    if not other or 100 * len(base & other) < 80 * len(base | other):
        return
    a, b = (np.frombuffer(jaccard.bitmap(blobs.spread(np.array(sorted(s), "u8"))), "u8")[None] for s in (base, other))
    size = min(a.shape[1], b.shape[1])
    near = jaccard.may_link(jaccard.folded(a, size), np.array([len(base)]), jaccard.folded(b, size), np.array([len(other)]))
    assert near.tolist() == [True]


def test_dissimilar_sets_are_ruled_out():
    rng = np.random.default_rng(1)
    shared, own = rng.integers(0, 1 << 62, 300, "u8"), rng.integers(0, 1 << 62, (2, 300), "u8")
    a, b = (np.frombuffer(jaccard.bitmap(np.r_[shared, o]), "u8")[None] for o in own)
    assert not jaccard.may_link(a, np.array([600]), b, np.array([600]))[0]


def test_components_of_chains_and_rings(spark):
    links = [(i, i + 1) for i in range(0, 40)] + [(100, 102), (102, 101), (101, 100)] + [(200, 300), (300, 200)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {100: 100, 101: 100, 102: 100, 200: 200, 300: 200}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_long_lists_meet_in_parts(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "TOGETHER", 3)
    rng = np.random.default_rng(2)
    base = rng.integers(0, 1 << 62, 100, "u8")
    rows = [(1, i, i // 2, 100, jaccard.bitmap(base if i < 6 else rng.integers(0, 1 << 62, 100, "u8"))) for i in range(20)]
    open_ = spark.createDataFrame([r[:3] for r in rows], "sig long, cls long, component long")
    sets = spark.createDataFrame([(r[1], r[3], bytes(r[4])) for r in rows], "cls long, n long, bits binary")
    rows = jaccard.across(open_, sets, 8, most=100).collect()
    assert {(r["a"], r["b"]) for r in rows if r["sig"] is None} == {(a, b) for a in range(6) for b in range(a) if a // 2 != b // 2}
    assert all(r["sig"] is None for r in rows)
    monkeypatch.setattr(jaccard, "TOGETHER", 100)
    few = jaccard.across(open_, sets, 8, most=1).collect()
    assert {(r["a"] // 2, r["b"] // 2) for r in few if r["sig"] is None} == {(1, 0), (2, 0), (2, 1)}
    assert {r["sig"] for r in few} == {None, 1}
