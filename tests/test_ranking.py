import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.operators import detect, ranking, similarity
from auditloom.operators.sets import overlapping


@pytest.mark.parametrize("partitions", [None, 1, 7])
def test_positions_in_one_huge_group(spark, partitions):
    rows = [("hot" if i % 3 else "cold", i % 7, i) for i in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, id int")
    got = ranking.ordered_positions(df, ["g"], [F.desc("v"), F.col("id")], "p", weight="v", before="b", partitions=partitions).collect()
    for group in ("hot", "cold"):
        want = sorted((r for r in rows if r[0] == group), key=lambda r: (-r[1], r[2]))
        mine = sorted((r for r in got if r.g == group), key=lambda r: r.p)
        assert [r.id for r in mine] == [r[2] for r in want]
        assert [r.b for r in mine] == list(np.cumsum([0] + [r[1] for r in want])[:-1])


def test_percentiles_match_numpy(spark):
    rng = random.Random(3)
    rows = [(i % 2, round(rng.random() * 5, 1)) for i in range(201)]
    df = spark.createDataFrame(rows, "g int, x double")
    got = {r.g: (r.a, r.b) for r in ranking.exact_percentiles(df, ["g"], "x", {"a": 0.95, "b": 0.5}).collect()}
    for g in (0, 1):
        xs = [x for k, x in rows if k == g]
        assert got[g] == pytest.approx((np.percentile(xs, 95), np.percentile(xs, 50)))


def test_salted_join_equals_plain_join(spark):
    big = spark.createDataFrame([("hot" if i % 4 else f"k{i}", i) for i in range(400)], "k string, i int")
    lookup = spark.createDataFrame([("hot", 1), ("k0", 2), ("k4", 3)], "k string, v int")
    for how in ("inner", "left"):
        salted = ranking.salted_join(big, lookup, ["k"], how, salts=8, at_least=50)
        assert sorted(salted.collect(), key=str) == sorted(big.join(lookup, ["k"], how).collect(), key=str)
    assert ranking.hot_keys(big, ["k"], at_least=50) == [("hot",)]


def test_auc_with_ties_and_single_class(spark):
    rows = [(1, 0.9, 1), (1, 0.5, 1), (1, 0.5, 0), (1, 0.1, 0), (2, 0.3, 0), (2, 0.4, 0)]
    df = spark.createDataFrame(rows, "g int, s double, y int")
    got = detect.auc(df, ["g"], "s", "y").collect()
    assert [(r.g, r.auc) for r in got] == [(1, pytest.approx((1 + 1 + 0.5 + 1) / 4))]


def _vectors(rng, n, features):
    return {f"v{i}": {f"f{rng.randrange(features)}": float(rng.randrange(1, 5)) for _ in range(6)} | {"common": 3.0} for i in range(n)}


def test_similarity_join_equals_brute_force(spark):
    rng = random.Random(11)
    left, right = _vectors(rng, 25, 12), _vectors(rng, 20, 12)
    right["v0"] = dict(left["v3"])  # copies on both sides
    left["v4"] = dict(left["v3"])
    frame = lambda vs: spark.createDataFrame([(i, f, w) for i, v in vs.items() for f, w in v.items()], "id string, feature string, weight double")

    def cos(a, b):
        na, nb = (sum(x * x for x in v.values()) ** 0.5 for v in (a, b))
        return sum(w * b.get(f, 0.0) for f, w in a.items()) / (na * nb)

    for floor in (0.0, 0.3, 0.8):
        got = {(r.a, r.b): round(r.sim, 9) for r in similarity.similar_pairs(frame(left), frame(right), floor).collect()}
        want = {(i, j): round(cos(a, b), 9) for i, a in left.items() for j, b in right.items() if cos(a, b) >= floor}
        assert got == want


def _plain_top(left, right, k):
    out = {}
    for i, a in left.items():
        na = sum(x * x for x in a.values()) ** 0.5
        scores = []
        for j, b in right.items():
            dot, nb = sum(w * b.get(f, 0.0) for f, w in a.items()), sum(x * x for x in b.values()) ** 0.5
            scores.append((-round(dot / (na * nb), 9) + 0.0, j))
        out[i] = [(j, r + 1) for r, (s, j) in enumerate(sorted(scores)[:k])]
    return out


@pytest.mark.parametrize("short", [0, 1024])
def test_top_k_needs_no_floor(spark, short, monkeypatch):
    monkeypatch.setattr(similarity, "SHORT", short)
    monkeypatch.setattr(similarity, "OWN", 0 if short == 0 else 32)
    rng = random.Random(12)
    frame = lambda vs: spark.createDataFrame([(i, f, w) for i, v in vs.items() for f, w in v.items()], "id string, feature string, weight double")
    zipf = lambda n: {f"f{min(int(rng.paretovariate(0.5)), 400)}": float(rng.randrange(1, 5)) for _ in range(n)}
    left = {f"q{i:03}": zipf(rng.randrange(1, 25)) for i in range(60)} | {"alone": {"nowhere": 1.0}}
    right = {f"r{i:03}": zipf(rng.randrange(1, 12)) for i in range(150)}
    right |= {f"s{i:03}": dict(right["r003"]) for i in range(30)}  # copies fill a whole top
    left["copy"] = dict(right["r003"])
    for k in (4, 25):
        got = {}
        for r in similarity.top_similar(frame(left), frame(right), k).collect():
            got.setdefault(r.a, []).append((r.b, r["rank"]))
        assert {a: sorted(x, key=lambda t: t[1]) for a, x in got.items()} == _plain_top(left, right, k)
    ranks = {(r.a, r.b): r["rank"] for r in similarity.ranks_of(frame(left), frame(right), spark.createDataFrame([(a, b) for a in left for b in ("r000", "r007", "s004")], "a string, b string")).collect()}
    for a in left:
        order = dict(_plain_top({a: left[a]}, right, len(right))[a])
        scores = {b: similarity_of(left[a], right[b]) for b in right}
        for b in ("r000", "r007", "s004"):
            assert ranks[a, b] == 1 + sum(s > scores[b] for s in scores.values()) and order[b] >= ranks[a, b]
    assert similarity.top_similar(frame(left), frame(right).limit(0), 3).count() == 0


def similarity_of(a, b):
    na, nb = (sum(x * x for x in v.values()) ** 0.5 for v in (a, b))
    return round(sum(w * b.get(f, 0.0) for f, w in a.items()) / (na * nb), 9)


def test_top_k_opens_few_lists(spark):
    """Every vector has ten common features and a few rare ones: the common lists are not opened for all pairs."""
    rng = random.Random(13)
    group = lambda i: {f"g{i % 30}-{j}": 3.0 for j in range(6)} | {f"common{j}": 0.2 * rng.random() for j in range(10)}
    rows = [(i, f, w) for i in range(600) for f, w in group(i).items()]
    frame = spark.createDataFrame(rows, "id int, feature string, weight double").repartition(8).cache()
    _, entries = similarity._classes(frame, True)
    postings = similarity._postings(entries)
    bounded = similarity._bounded(similarity._listed(entries, postings), postings).cache()
    tau = similarity._threshold(bounded, postings, 5)
    found = similarity._search(bounded, postings, tau, 5)
    assert tau.count() == 600 and tau.agg(F.min("tau")).first()[0] > 0.9
    kept = bounded.join(tau, "a").filter("rest >= tau - 2e-9").join(postings.groupBy("feature").agg(F.count(F.lit(1)).alias("n")), "feature")
    assert kept.agg(F.sum("n")).first()[0] < 0.5 * 600 * 600
    assert found.count() < 0.08 * 600 * 600


def test_overlap_equals_brute_force(spark):
    rng = random.Random(5)
    sets = {g: {rng.randrange(12) for _ in range(rng.randrange(1, 9))} for g in range(15)}
    df = spark.createDataFrame([(g, x) for g, s in sets.items() for x in s], "g int, x int")
    got = {(r.a, r.b, r.shared) for r in overlapping(df, "g", "x", 0.5).collect()}
    assert got == {(a, b, len(sets[a] & sets[b])) for a in sets for b in sets if b < a and len(sets[a] & sets[b]) > 0.5 * len(sets[a])}


def test_step_and_moving_average(spark):
    rows = [("s", i, [float(i % 3 + 1), 1.0]) for i in range(9)]
    df = spark.createDataFrame(rows, "split string, snapshot_id int, vec array<double>")
    s = detect.step_deviation(detect.with_index(df, ["split"], [F.col("snapshot_id")]), ["split"], "vec", "l2")
    steps = [r.step_dev for r in s.orderBy("idx").collect()]
    xs = np.array([r[2] for r in rows])
    assert steps == pytest.approx([0.0, *np.linalg.norm(xs[1:] - xs[:-1], axis=1)])
    smooth = [r.smooth for r in detect.moving_average(s, ["split"], "step_dev", 3).orderBy("idx").collect()]
    assert smooth == pytest.approx(np.convolve(steps, np.ones(3) / 3, mode="same"))
    with pytest.raises(ValueError):
        detect.moving_average(s, ["split"], "step_dev", 4)


def test_short_group_is_padded_once(spark):
    df = spark.createDataFrame([("s", 1, [1.0]), ("s", 2, [2.0])], "split string, idx int, vec array<double>")
    rows = detect.sequences(df, ["split"], "vec", 4, 1).collect()
    assert [(r.sequence, r.target) for r in rows] == [([[1.0], [2.0], [0.0], [0.0]], [2.0])]
