"""The search keeps only entries that the other side has, and numbers instead of digests for equal vectors."""

import math
import random

import pytest

from auditloom.operators import interpret, similarity


def test_classes_keep_shared_features_and_whole_norms(spark):
    rows = [(1, "x", 3.0), (1, "y", 4.0), (2, "x", 3.0), (2, "y", 4.0), (3, "y", 2.0), (4, "x", 3.0), (4, "z", 4.0)]
    left = spark.createDataFrame(rows, "id int, feature string, weight double")
    right = spark.createDataFrame([(7, "x", 1.0), (8, "w", 1.0)], "id int, feature string, weight double")
    ids, entries = similarity._classes(left, True, right)
    assert {(r.id, r.sig) for r in ids.collect()} == {(1, 1), (2, 1), (3, 3), (4, 1)}  # alike in what the other side has
    assert [(r.sig, r.feature, r.weight) for r in entries.collect()] == [(1, "x", 0.6)]
    got = {(r.a, r.b): r.sim for r in similarity.top_similar(left, right, 2).collect()}
    assert set(got) == {(a, b) for a in (1, 2, 3, 4) for b in (7, 8)}
    assert all(math.isclose(got[a, 7], 0.6) for a in (1, 2, 4)) and got[3, 7] == 0
    pairs = spark.createDataFrame([(1, 7), (3, 7), (4, 8), (4, 99)], "a int, b int")
    ranks = {(r.a, r.b): r["rank"] for r in similarity.ranks_of(left, right, pairs).collect()}
    assert ranks == {(1, 7): 1, (3, 7): 1, (4, 8): 2, (4, 99): 2}


@pytest.mark.parametrize("entries,limit", [(40, 64), (1 << 22, 64), (40, 0)])
def test_products_of_blocks_equal_plain_ranks(spark, monkeypatch, entries, limit):
    """Small blocks, one block, and the search by posting lists: copies, queries that share nothing, scores above 1."""
    monkeypatch.setattr(similarity, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(similarity, "BLOCKS", limit)
    monkeypatch.setattr(similarity, "SCORES", 50)
    rng = random.Random(5)
    some = lambda: {f"f{min(int(rng.paretovariate(0.6)), 60)}": float(rng.randrange(1, 4)) for _ in range(rng.randrange(1, 9))}
    right = {i: some() for i in range(60)} | {100 + i: {"f1": 1.0, "f2": 2.0} for i in range(9)}
    left = {i: some() for i in range(25)} | {90: {"nowhere": 2.0}}
    frame = lambda vs: spark.createDataFrame([(i, f, w) for i, v in vs.items() for f, w in v.items()], "id int, feature string, weight double")
    assert (similarity.block_count(similarity.packed(frame(right))) is None) == (limit == 0)
    for unit in (True, False):
        size = lambda v: math.sqrt(sum(w * w for w in v.values())) if unit else 1.0  # noqa: E731, B023
        want = set()
        for a, v in left.items():
            scores = [(-round(sum(w * r.get(f, 0.0) for f, w in v.items()) / (size(v) * size(r)), 9), b) for b, r in right.items()]
            want |= {(a, b, n + 1) for n, (_, b) in enumerate(sorted(scores)[:6])}
        got = {(r.a, r.b, r["rank"]) for r in similarity.top_similar(frame(left), frame(right), 6, unit).collect()}
        assert got == want


def test_block_holds_one_copy_per_place_and_passes_only_the_best(spark):
    """A library of copies goes into a block with k of them, and a query gives k rows whatever the size of the library."""
    right = spark.range(500).selectExpr("id", "'x' AS feature", "1.0D AS weight")
    kept = similarity.first_copies(similarity.packed(right), 3)
    assert sorted(r.id for r in kept.collect()) == [0, 1, 2]


def test_tokens_are_worked_out_once(spark):
    """No filter on the tokens is inferred below the repartition; texts without tokens have no entries."""
    texts = spark.createDataFrame([(1, "a b a"), (2, ""), (3, "c")], "id int, text string").repartition("id")
    texts = texts.selectExpr("id", "filter(split(text, ' '), t -> t <> '') AS tokens")
    out = similarity.tfidf(texts, spark.createDataFrame([(7, ["a"])], "id int, tokens array<string>"))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "size(" not in plan.split("Repartition")[-1]
    assert {(r.id, r.feature) for r in out.collect()} == {(1, "a"), (1, "b"), (3, "c")}


def test_hybrid_keeps_queries_of_either_side(spark):
    """A query may have entries in one side only, or none that a library knows; a technique may be in one library only."""
    frame = lambda rows: spark.createDataFrame(rows, "id int, feature string, weight double")
    main, aux = frame([(1, "x", 2.0), (2, "y", 1.0)]), frame([(2, "x", 1.0), (3, "x", 3.0), (3, "z", 4.0)])
    queries, aux_queries = frame([(10, "x", 5.0), (12, "u", 1.0)]), frame([(10, "x", 1.0), (11, "z", 1.0)])
    got = {(r.a, r["rank"]): (r.b, round(r.sim, 9)) for r in interpret.hybrid(queries, main, aux, aux_queries, 0.3, 2).collect()}
    assert got == {
        (10, 1): (1, 0.7), (10, 2): (2, 0.3), (11, 1): (3, 0.24), (11, 2): (1, 0.0), (12, 1): (1, 0.0), (12, 2): (2, 0.0),
    }


def test_blocks_go_to_no_more_parts_than_keep_the_cores_busy(spark):
    right = spark.range(50).selectExpr("id", "concat('f', id % 7) AS feature", "1.0D + id AS weight")
    library, cores = similarity.packed(right, False), spark.sparkContext.defaultParallelism
    assert similarity.top_products(library, library, 3, 1).rdd.getNumPartitions() == cores
    found = similarity.top_products(similarity.packed(right.limit(5), False), library, 3, 3 * cores)
    assert {(r.a, r.b, r["rank"]) for r in found.collect()} >= {(0, 49, 1), (0, 42, 2), (0, 35, 3), (1, 43, 1)}
