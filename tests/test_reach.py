"""Sources, ancestors and clusters against closures computed in plain Python."""

import random
from collections import defaultdict

import pytest

from auditloom.operators import graph, reach


def closure(edges):
    """node -> all nodes with a path of at least one edge to it."""
    parents = defaultdict(set)
    for a, b in edges:
        parents[b].add(a)
    out = {}
    for n in {x for e in edges for x in e}:
        seen, todo = set(), list(parents[n])
        while todo:
            x = todo.pop()
            if x not in seen:
                seen.add(x)
                todo += parents[x]
        out[n] = seen
    return out


def sources(edges):
    up = closure(edges)
    comp = {n: min({m for m in up[n] if n in up[m]} | {n}) for n in up}
    roots = {comp[n] for n in up if all(comp[m] == comp[n] for m in up[n])}
    return {(n, comp[m]) for n in up for m in up[n] if comp[m] in roots}


def shapes():
    rnd = random.Random(2)
    chain = [(f"n{i}", f"n{i + 1}") for i in range(40)]
    star = [("hub", f"s{i}") for i in range(60)]
    ring = [(f"r{i}", f"r{(i + 1) % 7}") for i in range(7)] + [("r3", "out"), ("out", "out2"), ("x", "out2")]
    diamond = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("z", "e"), ("e", "f"), ("self", "self"), ("self", "g"), ("lone", "lone")]
    late = [("9", "1"), ("1", "3"), ("3", "1"), ("3", "2"), ("2", "0")]
    out = [chain, star, ring, diamond, late]
    for _ in range(3):
        out.append([(f"v{rnd.randrange(25)}", f"v{rnd.randrange(25)}") for _ in range(rnd.choice((15, 25, 40)))])
    return out


@pytest.fixture(scope="module")
def graphs(spark):
    every = shapes()
    rows = [(i, a, b) for i, e in enumerate(every) for a, b in e + e[:2]]
    return every, spark.createDataFrame(rows, "snapshot_id long, src string, dst string").cache()


def test_source_sets_equal_closures(graphs):
    every, table = graphs
    got = defaultdict(set)
    rows = reach.source_sets(table).collect()
    for r in rows:
        got[r.snapshot_id].add((r.node, r.source))
    assert len(rows) == sum(map(len, got.values()))
    for i, e in enumerate(every):
        assert got[i] == sources(e)
    assert len(got[0]) == 40 and len(got[1]) == 60  # a chain and a star have one source a node


def test_ancestors_of_asked_nodes(spark, graphs):
    every, table = graphs
    asked = spark.createDataFrame([(0, "n7"), (1, "s3"), (2, "out2"), (3, "f"), (4, "2"), (4, "none")], "snapshot_id long, node string")
    got = {(r.snapshot_id, r.node, r.ancestor) for r in reach.ancestors(table, asked).collect()}
    assert got == {(i, n, a) for i, n in ((0, "n7"), (1, "s3"), (2, "out2"), (3, "f"), (4, "2")) for a in closure(every[i])[n]}


def test_clusters_by_shared_ancestors(spark):
    tree = [("init", "sh"), ("sh", "a"), ("sh", "b"), ("other", "c"), ("a", "deep")]
    use = [(p, "f1") for p in ("a", "b", "c", "deep", "init")] + [("f2", "c"), ("deep", "f2")]
    kinds = {n: "SUBJECT_PROCESS" for e in tree for n in e} | {"f1": "FILE_OBJECT_BLOCK", "f2": "FILE_OBJECT_BLOCK"}
    nodes = spark.createDataFrame([(1, n, t) for n, t in kinds.items()], "snapshot_id long, name string, type string")
    edges = spark.createDataFrame([(1, a, b) for a, b in tree + use], "snapshot_id long, src string, dst string")
    got = {(r.resource, r.process): (r.cluster, r.cluster_size) for r in graph.accessor_clusters(nodes, edges).collect()}
    # through deep -> f2 -> c the process c descends from init, too
    assert got == {("f1", p): ("a", 4) for p in ("a", "b", "c", "deep")} | {("f1", "init"): ("init", 1)} | {("f2", p): ("c", 2) for p in ("c", "deep")}
