import random

import pytest
from pyspark.sql import functions as F

from auditloom.operators import reach, graph, wl


def edge_df(spark, pairs, snapshot=1, action="EVENT_READ"):
    rows = [(snapshot, a, b, [action], action) for a, b in pairs]
    return spark.createDataFrame(rows, "snapshot_id long, src string, dst string, actions array<string>, actions_str string")


TOY = [("P0", "S"), ("P1", "S"), ("P4", "P1"), ("P4", "P2"), ("F", "P3"), ("F", "P2"), ("P0", "F"), ("F", "P1")]
TYPES = {"S": "NETFLOW_OBJECT", "F": "FILE_OBJECT_BLOCK"}


def toy_nodes(spark):
    names = sorted({x for e in TOY for x in e})
    rows = [(1, n, TYPES.get(n, "SUBJECT_PROCESS"), n, int(n == "P3"), 1) for n in names]
    return spark.createDataFrame(rows, "snapshot_id long, name string, type string, prop string, label int, frequency long")


def brute_ego(pairs, center, r, cap):
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    hop, frontier = {center: 0}, [center]
    for h in range(1, r + 1):
        frontier = [y for x in frontier for y in near.get(x, ())]
        for y in frontier:
            hop.setdefault(y, h)
    return sorted(((h, n) for n, h in hop.items()))[:cap]


@pytest.mark.parametrize("cap", [1, 3, 6, 50])
def test_ego_with_hub_equals_brute_force(spark, cap):
    rng = random.Random(cap)
    pairs = [("hub", f"n{i:02d}") for i in range(30)] + [(f"n{rng.randrange(30):02d}", f"m{rng.randrange(10)}") for _ in range(25)]
    pairs += [("hub", "hub")]
    names = sorted({x for p in pairs for x in p})
    centers = spark.createDataFrame([(1, n) for n in names], "snapshot_id long, center string")
    got = {}
    for r in graph.ego(edge_df(spark, pairs), centers, 2, cap).collect():
        got.setdefault(r.center, []).append((r.hop, r.node))
    assert {c: sorted(v) for c, v in got.items()} == {c: brute_ego(pairs, c, 2, cap) for c in names}


def test_ego_edges_equal_induced(spark):
    e = edge_df(spark, TOY)
    centers = spark.createDataFrame([(1, "P0"), (1, "P3")], "snapshot_id long, center string")
    egos = graph.ego(e, centers, 1, 10)
    members = {}
    for r in egos.collect():
        members.setdefault(r.center, set()).add(r.node)
    got = {(r.center, r.src, r.dst) for r in graph.ego_edges(e, egos).collect()}
    assert got == {(c, a, b) for c, m in members.items() for a, b in TOY if a in m and b in m}


def test_components_of_long_chain_and_star(spark):
    chain = [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(70)]
    star = [("z", f"s{i}") for i in range(20)]
    comps = {r.node: r.component for r in graph.components(edge_df(spark, chain + star + [("x", "x")])).collect()}
    assert {comps[n] for n in comps if n.startswith("c")} == {"c000"}
    assert {comps[n] for n in comps if n.startswith("s")} == {"s0"} and comps["z"] == "s0"
    assert comps["x"] == "x"


def test_ancestors_and_clusters_on_toy_graph(spark):
    e, n = edge_df(spark, TOY), toy_nodes(spark)
    targets = n.select("snapshot_id", F.col("name").alias("node"))
    got = {}
    for r in reach.ancestors(e, targets).collect():
        got.setdefault(r.node, set()).add(r.ancestor)
    assert got["P1"] == {"P4", "F", "P0"} and got["P3"] == {"F", "P0"} and "P0" not in got
    clusters = {(r.resource, r.process): r.cluster for r in graph.accessor_clusters(n, e).collect()}
    assert clusters[("S", "P0")] == "P0" and clusters[("S", "P1")] == "P1"
    assert {clusters[("F", p)] for p in ("P1", "P2", "P3")} == {"P1"} and clusters[("F", "P0")] == "P0"
    weights = {(r.resource, r.process): r.weight for r in graph.resource_weights(graph.accessor_clusters(n, e)).collect()}
    assert weights[("F", "P1")] == pytest.approx(0.3) and weights[("F", "P0")] == pytest.approx(0.1)


def test_process_weights_on_toy_graph(spark):
    w = {(r.src, r.dst): r.weight for r in graph.process_weights(toy_nodes(spark), edge_df(spark, TOY)).collect()}
    # P4-P2-F-P1 and P4-P1-F-P2 both hold a resource within four nodes
    assert w == {("P4", "P1"): pytest.approx(0.5), ("P4", "P2"): pytest.approx(0.5)}


def test_simple_paths_equal_brute_force(spark):
    near = {}
    for a, b in TOY:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)

    def walk(path, goal, left):
        if path[-1] == goal:
            yield tuple(path)
        elif left:
            for nxt in near[path[-1]]:
                if nxt not in path:
                    yield from walk([*path, nxt], goal, left - 1)

    pairs = spark.createDataFrame([(1, "P0", "P2"), (1, "P4", "P3")], "snapshot_id long, a string, b string")
    got = {tuple(r.path) for r in graph.simple_paths(edge_df(spark, TOY), pairs, 4).collect()}
    assert got == set(walk(["P0"], "P2", 4)) | set(walk(["P4"], "P3", 4))


def test_source_sink_paths(spark):
    rows = graph.source_sink_paths(edge_df(spark, [("a", "b"), ("b", "c"), ("a", "c"), ("c", "d")]), 4).collect()
    assert {">".join(r.path) for r in rows} == {"a>b>c>d", "a>c>d"}


def test_wl_is_invariant_and_kernel_bounds(spark):
    e1 = edge_df(spark, TOY, 1)
    renamed = {n: f"r{i}" for i, n in enumerate(sorted({x for e in TOY for x in e}, reverse=True))}
    e2 = edge_df(spark, [(renamed[a], renamed[b]) for a, b in reversed(TOY)], 2)
    labels = [(1, n, TYPES.get(n, "P")) for n in renamed] + [(2, renamed[n], TYPES.get(n, "P")) for n in renamed]
    start = spark.createDataFrame(labels, "snapshot_id long, node string, label string")
    hist = wl.wl_histogram(wl.wl_labels(start, e1.unionByName(e2), 3)).collect()
    one = {(r.iter, r.label): r.cnt for r in hist if r.snapshot_id == 1}
    two = {(r.iter, r.label): r.cnt for r in hist if r.snapshot_id == 2}
    assert one == two and sum(one.values()) == 4 * len(renamed)
    vec = wl.as_vectors(spark.createDataFrame(hist), F.col("snapshot_id"))
    pairs = spark.createDataFrame([(1, 1), (1, 2), (2, 1)], "a long, b long")
    sims = {(r.a, r.b): r.sim for r in wl.wl_kernel(vec, vec, pairs).collect()}
    assert all(s == pytest.approx(1.0) for s in sims.values())


def test_communities_cover_and_split(spark):
    clique = lambda p: [(f"{p}{i}", f"{p}{j}") for i in range(6) for j in range(i)]
    e = edge_df(spark, clique("a") + clique("b") + [("a0", "b0")])
    members = graph.communities(e, limit=50)
    groups = {}
    for r in members.collect():
        groups.setdefault(r.community_id, set()).add(r.node[0])
    assert len(groups) == 2 and all(len(g) == 1 for g in groups.values())
    assert graph.modularity(e, members).collect()[0].modularity > 0.3


def test_results_do_not_depend_on_partitioning(spark):
    e = edge_df(spark, TOY)
    centers = spark.createDataFrame([(1, "P0"), (1, "P4")], "snapshot_id long, center string")
    runs = []
    for parts in ("1", "40"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        runs.append(sorted(graph.ego(e.repartition(int(parts)), centers.repartition(int(parts)), 2, 4).collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert runs[0] == runs[1]


def test_path_halves_start_at_the_end_with_fewer_walks(spark):
    """A user next to hubs asks for a path to a small node: the hubs' neighbours are not followed from the users."""
    links = [(f"user{i}", f"hub{h}") for i in range(40) for h in range(3)] + [(f"user{i}", "goal") for i in range(2)]
    adj = graph.adjacency(edge_df(spark, links))
    pairs = spark.createDataFrame([(1, f"user{i}", "goal") for i in range(40)], "snapshot_id long, a string, b string")
    assert graph.longer_end(adj, pairs) == "b"
    halves = graph.half_paths(adj, pairs.selectExpr("snapshot_id", "b as end"), 2)
    assert halves.count() == 1 + 2 + 2 * 3
    turned = pairs.selectExpr("snapshot_id", "b as a", "a as b")
    assert graph.longer_end(adj, turned) == "a"
    one = {tuple(r.path) for r in graph.simple_paths(edge_df(spark, links), pairs, 3).collect()}
    two = {tuple(reversed(r.path)) for r in graph.simple_paths(edge_df(spark, links), turned, 3).collect()}
    # a direct edge, or over a hub and one of the other users next to the goal
    assert one == two and len(one) == 2 + 2 * 3 * 1 + 38 * 3 * 2


def shuffled_rows(df):
    """Rows that the exchanges of a query wrote, after running it."""
    df.collect()
    plans, rows = [df._jdf.queryExecution().executedPlan()], 0
    while plans:
        node = plans.pop()
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            plans.append(node.executedPlan())
        elif kind.endswith("QueryStageExec"):
            plans.append(node.plan())
        else:
            if kind == "ShuffleExchangeExec":
                rows += node.metrics().apply("shuffleRecordsWritten").value()
            plans += [node.children().apply(i) for i in range(node.children().size())]
    return rows


def test_ego_moves_one_row_per_center(spark):
    """What a hub adds is found once, not for each of its neighbours; a neighbour does not find itself again."""
    pairs = [(f"u{i:03d}", f"k{i % 4}") for i in range(400)]
    centers = spark.createDataFrame([(1, f"u{i:03d}") for i in range(400)], "snapshot_id long, center string")
    out = graph.ego(edge_df(spark, pairs), centers, 2, 64)
    got = {}
    for r in out.collect():
        got.setdefault(r.center, []).append((r.hop, r.node))
    assert {c: sorted(v) for c, v in got.items()} == {f"u{i:03d}": brute_ego(pairs, f"u{i:03d}", 2, 64) for i in range(400)}
    assert shuffled_rows(out) < 10 * 400


def test_ego_hashes_no_links(spark):
    """Links reach the limited lists without a hashed set of all of them, also where both directions are given."""
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("c", "d")]
    centers = spark.createDataFrame([(1, x) for x in "abcd"], "snapshot_id long, center string")
    out = graph.ego(edge_df(spark, pairs), centers, 2, 3)
    got = {}
    for r in out.collect():
        got.setdefault(r.center, []).append((r.hop, r.node))
    assert {c: sorted(x) for c, x in got.items()} == {c: brute_ego(pairs, c, 2, 3) for c in "abcd"}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert not any("Aggregate" in line and "nbr" in line and "collect_set" not in line for line in plan.splitlines())


def test_communities_read_the_edges_once_and_agree_with_plain_propagation(spark):
    import random
    from collections import Counter, defaultdict

    def propagate(near, rounds):
        label = {v: v for v in near}
        for _ in range(rounds):
            votes = {v: Counter([label[u] for u in near[v]] + [label[v]]) for v in near}
            label = {v: min(c, key=lambda x: (-c[x], x)) for v, c in votes.items()}
        return label

    chance = random.Random(3)
    pairs = {tuple(sorted(chance.sample([f"n{i}" for i in range(60)], 2))) for _ in range(75)}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    label = {v: (x,) for v, x in propagate(near, 5).items()}
    for _ in range(2):
        sizes = Counter(label.values())
        big = {v for v in near if sizes[label[v]] > 6}
        inner = {v: {u for u in near[v] if label[u] == label[v]} for v in big}
        again = propagate({v: us for v, us in inner.items() if us}, 5)
        label = {v: (*x, again[v]) if v in again else x for v, x in label.items()}
    groups = defaultdict(set)
    for v, x in label.items():
        groups[x].add(v)
    wanted = sorted((sorted(g) for g in groups.values() if len(g) > 1), key=lambda g: g[0])

    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    e = edge_df(spark, sorted(pairs)).withColumn("src", F.udf(seen)("src"))
    found = defaultdict(list)
    for r in graph.communities(e, limit=6).orderBy("node").collect():
        found[r.community_id].append(r.node)
    assert [found[i + 1] for i in range(len(found))] == wanted
    assert read.value <= 3 * len(pairs)


def test_process_weights_agree_with_all_short_paths_and_expand_ends_once(spark):
    import random
    import re
    from collections import defaultdict

    chance = random.Random(5)
    procs, files = [f"p{i}" for i in range(9)], [f"f{i}" for i in range(6)]
    links = {(a, b) for a, b in ((chance.choice(procs), chance.choice(procs + files)) for _ in range(34)) if a != b}
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)

    def loop(s, t):
        if any(a in files and t in near[a] for a in near[s]):
            return 3
        inner = ((a, b) for a in near[s] - {t} for b in near[a] - {s, t} if t in near[b])
        return 4 if any(a in files or b in files for a, b in inner) else None

    wanted = {(s, t): loop(s, t) for s, t in links if t in procs}
    assert {3, 4, None} <= set(wanted.values())
    kinds = [(1, x, "SUBJECT_PROCESS" if x in procs else "FILE_OBJECT_BLOCK") for x in procs + files]
    nodes = spark.createDataFrame(kinds, "snapshot_id long, name string, type string")
    weights = graph.process_weights(nodes, edge_df(spark, sorted(links)))
    assert {(r.src, r.dst): r.loop for r in weights.collect()} == wanted
    # the last inner node is looked for once for all pairs with the same a and t
    assert "aggregate [snapshot_id, a, t], [snapshot_id, a, t, min(b)" in re.sub(r"#\d+L?|'", "", weights._jdf.queryExecution().optimizedPlan().toString()).lower()


def test_two_hop_counts_are_whole(spark):
    rng = random.Random(3)
    pairs = [("hub", f"u{i:03d}") for i in range(150)] + [("a", "b"), ("b", "c"), ("c", "a"), ("d", "d"), ("x", "y")]
    pairs += [(f"n{rng.randrange(30)}", f"n{rng.randrange(30)}") for _ in range(60)] + [("u000", "n1"), ("u001", "n1"), ("u002", "u003")]
    near = {}
    for a, b in pairs:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want = sum(len({y for x in near[c] for y in near[x]} - near[c] - {c}) for c in near)
    assert want > 64 * 150  # more than egos of 64 nodes hold
    assert [r.n_pairs for r in graph.two_hop_counts(edge_df(spark, pairs)).collect()] == [want]
    assert graph.two_hop_counts(edge_df(spark, [("x", "y"), ("d", "d")])).collect() == []


def test_two_hop_query_and_its_sql_have_no_limit():
    from auditloom.plans import load_all
    from auditloom.plans.registry import ORACLES

    load_all()
    assert "rk <=" not in ORACLES["jn8_two_hop_counts"]
    assert "rk <= 8" in ORACLES["gr1_ego"]
