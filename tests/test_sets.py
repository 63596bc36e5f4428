"""Overlap of groups, counted by the groups of each item or by candidates."""

import random

import pytest

from auditloom.operators import sets


@pytest.mark.parametrize("few", [64, 2])
def test_overlap_equals_brute_force(spark, monkeypatch, few):
    monkeypatch.setattr(sets, "FEW", few)
    rng = random.Random(3)
    rows = [(g, x) for g in range(8) for x in range(30) if rng.random() < 0.2 + 0.08 * g] + [(1, 5), (1, 5), (None, 3), (2, None)]
    df = spark.createDataFrame(rows, "g int, x int")
    held = {g: {x for a, x in rows if a == g and x is not None} for g in range(8)}
    want = {(a, b, len(held[a] & held[b])) for a in held for b in held if b < a and len(held[a] & held[b]) > 0.3 * len(held[a] | ({None} if a == 2 else set()))}
    out = sets.overlapping(df, "g", "x", 0.3)
    assert {(r.a, r.b, r.shared) for r in out.collect()} == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Aggregate [_g" in plan) == (few == 64)
