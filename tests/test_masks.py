"""Masked places of sequences: one row an id is sorted by no window, and sequences of one id are judged together."""

import hashlib

import pytest

from scrubwell.operators import relations


def plain(rows, whole, copies, most):
    found = []
    for key in {k for k, _ in rows}:
        own = [t for k, t in rows if k == key and t]
        for copy in range(copies):
            head = lambda s, i: i == 0 or not s[i].startswith("##")
            word = {i: sum(head(s, q) for s in own for q in range(min(i + 1, len(s)))) if whole else i for s in own for i in range(len(s))}
            h = {i: hashlib.md5(f"12345:{key}:{copy}:{w}".encode()).hexdigest() for i, w in word.items()}
            for s in own:
                n = min(most, max(1, int(len(s) * 0.15 + 0.5)))
                found += [(key, copy, i, t) for i, t in enumerate(s) if sum(h[q] <= h[i] for o in own for q in range(len(o))) <= n]
    return sorted(found)


@pytest.mark.parametrize("whole", [True, False])
def test_places_without_windows(spark, whole):
    rows = [(k, [f"{'##' if (i * k) % 3 == 1 else ''}t{i}" for i in range(k % 23)]) for k in range(40)] + [(7, ["a", "##b"]), (9, [f"t{i}" for i in range(20)])]
    got = relations.mask_positions(spark.createDataFrame(rows, "x long, tokens array<string>"), ["x"], "tokens", most=4, whole_words=whole)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(tuple(r) for r in got.collect()) == plain(rows, whole, 3, 4)
