"""Candidate pairs of spotsigs against plain loops."""

import itertools
import random

import pytest

from scrubwell.llm import spotsigs


@pytest.mark.parametrize("many", [2, 32])
def test_near_copies_meet_once(spark, monkeypatch, many):
    r = random.Random(8)
    sets = {m: set(range(20)) for m in range(40)} | {m: set(r.sample(range(1000, 1060), 9)) for m in range(40, 80)} | {m: set(r.sample(range(20), 3)) for m in range(80, 90)}
    roots = {m: m % 3 for m in range(30)} | {m: 40 for m in range(40, 50)}
    monkeypatch.setattr(spotsigs, "MANY", many)
    shared = spark.createDataFrame([(g, m, 100) for m, s in sets.items() for g in s], "g long, mark long, n int")
    sizes = spark.createDataFrame([(m, 100, [0] * 8) for m in sets], "mark long, n int, bits array<long>")
    known = spark.createDataFrame(list(roots.items()), "node long, root long")
    met = spotsigs.meetings(shared, sizes, known, 0.8).collect()
    expected = {(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] & sets[b] and roots.get(a, a) != roots.get(b, b)}
    assert {(x["a"], x["b"]) for x in met} == expected
    assert len([x for x in met if x["b"] < 40]) == len([p for p in expected if p[1] < 40])
    assert spotsigs.candidates(shared, sizes, known, 0.8).count() == len(expected)
