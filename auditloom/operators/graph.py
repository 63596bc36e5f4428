"""Graph operators on node and edge tables.

``edges(snapshot_id, src, dst, actions, actions_str, ...)``; every operator works on all snapshots at
once, keyed by ``snapshot_id`` (or any other graph key given by ``by``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.operators.ranking import hot_keys, ordered_positions, salted_join, top_per_group
from auditloom.operators.reach import source_sets
from auditloom.session import cut, stored

GRAPH = ["snapshot_id"]


def doubled(edges: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Both directions of every edge as ``node, nbr`` (a self-loop appears twice), from one scan."""
    keep = [c for c in edges.columns if c not in ("src", "dst")]
    ends = F.array(
        F.struct(F.col("src").alias("node"), F.col("dst").alias("nbr")),
        F.struct(F.col("dst").alias("node"), F.col("src").alias("nbr")),
    )
    return edges.select(*keep, F.inline(ends))


def adjacency(edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Distinct undirected neighbours without self-loops."""
    return doubled(edges).filter(F.col("node") != F.col("nbr")).select(*by, "node", "nbr").distinct()


def degrees(edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Total degree (a self-loop counts twice) and its min-max norm inside each graph."""
    deg = doubled(edges).groupBy(*by, "node").agg(F.count(F.lit(1)).alias("degree"))
    span = deg.groupBy(*by).agg(F.min("degree").alias("_lo"), F.max("degree").alias("_hi"))
    width = F.col("_hi") - F.col("_lo")
    normed = F.when(width == 0, F.lit(0.0)).otherwise((F.col("degree") - F.col("_lo")) / width)
    return deg.join(span, by).withColumn("degree_norm", normed).drop("_lo", "_hi")


# ---- neighbourhoods -----------------------------------------------------------------------------
def ego(edges: DataFrame, centers: DataFrame, r: int = 2, max_nodes: int | None = 32, by: list[str] = GRAPH) -> DataFrame:
    """Nodes within ``r`` hops of each center, at most ``max_nodes`` by (hop, name).

    A neighbour list is cut to its first ``max_nodes`` names before the joins. That loses nothing: an ego
    that is not full yet has fewer than ``max_nodes`` nodes, so each neighbour it still needs is among
    the first ``max_nodes`` of some list. An ego stays one row of names until the end, and what a hop can add is
    found once for all centers with the same outermost nodes: the first ``max_nodes`` names around these hold
    all that any such ego still needs, whatever it has seen. Full egos take no part.
    """
    if max_nodes is None:
        return _whole_ego(edges, centers, r, by)
    # the rank of a name leaves edges in both directions for the set, so that links move once and are never hashed
    place = F.dense_rank().over(W.partitionBy(*by, "node").orderBy("nbr"))
    near = doubled(edges.select(*by, "src", "dst")).filter(F.col("node") != F.col("nbr")).withColumn("_r", place).filter(F.col("_r") <= max_nodes)
    near = near.groupBy(*by, "node").agg(F.sort_array(F.collect_set("nbr")).alias("near"))
    seen = centers.select(*by, "center").distinct()
    seen = seen.withColumns({"seen": F.array("center"), "hops": F.array(F.lit(0)), "outer": F.array("center")})
    for hop in range(1, r + 1):
        if hop == 1:
            found = near.select(*by, F.array("node").alias("outer"), F.col("near").alias("more"))
        else:
            groups = seen.filter((F.size("seen") < max_nodes) & (F.size("outer") > 0)).select(*by, "outer").distinct()
            around = groups.select(*by, "outer", F.explode("outer").alias("node")).join(near, [*by, "node"])
            names = F.array_sort(F.array_distinct(F.flatten(F.collect_list("near"))))
            found = around.groupBy(*by, "outer").agg(F.slice(names, 1, max_nodes).alias("more"))
        fresh = F.array_except(F.coalesce("more", F.slice("seen", 1, 0)), "seen")
        fresh = F.slice(fresh, F.lit(1), F.greatest(F.lit(max_nodes) - F.size("seen"), F.lit(0)))
        seen = seen.join(found, [*by, "outer"], "left").withColumn("outer", fresh).drop("more")
        seen = seen.withColumns({"seen": F.concat("seen", "outer"), "hops": F.concat("hops", F.array_repeat(F.lit(hop), F.size("outer")))})
    return seen.select(*by, "center", F.inline(F.arrays_zip(F.col("seen").alias("node"), F.col("hops").alias("hop"))))


def _whole_ego(edges: DataFrame, centers: DataFrame, r: int, by: list[str]) -> DataFrame:
    adj = adjacency(edges, by)
    seen = centers.select(*by, "center", F.col("center").alias("node"), F.lit(0).alias("hop"))
    for hop in range(1, r + 1):
        frontier = seen.filter(F.col("hop") == hop - 1)
        grown = frontier.join(adj, [*by, "node"]).select(*by, "center", F.col("nbr").alias("node"), F.lit(hop).alias("hop"))
        seen = seen.unionByName(grown).groupBy(*by, "center", "node").agg(F.min("hop").alias("hop"))
    return seen


def two_hop_counts(edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """``n_pairs`` of each graph: (center, node) whose distance is exactly 2, all of them; graphs without such a pair are missing.

    Nodes with the same neighbours form a class: any two of it are such a pair, and what holds for one of it holds for all. So
    pairs are listed between the first nodes of classes only and count by the sizes of both; the leaves of a hub are one row.
    """
    links = stored(adjacency(edges, by), "links")
    # a set of neighbours by its size, ends and two sums that do not depend on order
    marks = [F.count(F.lit(1)), F.min("nbr"), F.max("nbr"), *(F.bit_xor(F.xxhash64(F.lit(i), "nbr")) for i in (1, 2))]
    marks = [x.alias(f"_m{i}") for i, x in enumerate(marks)]
    sets = links.groupBy(*by, "node").agg(*marks)
    classes = sets.groupBy(*by, *(f"_m{i}" for i in range(len(marks)))).agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("_n"))
    classes = stored(classes.select(*by, "node", "_n"), "classes")
    inside = classes.withColumn("n_pairs", F.col("_n") * (F.col("_n") - 1)).select(*by, "n_pairs")
    firsts = links.join(classes, [*by, "node"]).join(classes.select(*by, F.col("node").alias("nbr")), [*by, "nbr"], "left_semi")
    firsts = stored(firsts.select(*by, "node", "nbr", "_n"), "class-links")
    one, other = (firsts.select(*by, "nbr", F.col("node").alias(x), F.col("_n").alias(f"_{x}")) for x in ("a", "b"))
    met = one.join(other, [*by, "nbr"]).filter("a < b").select(*by, "a", "b", (F.col("_a") * F.col("_b") * 2).alias("n_pairs")).distinct()
    apart = met.join(firsts.select(*by, F.col("node").alias("a"), F.col("nbr").alias("b")), [*by, "a", "b"], "left_anti")
    counts = inside.unionByName(apart.select(*by, "n_pairs")).groupBy(*by).agg(F.sum("n_pairs").alias("n_pairs"))
    return counts.filter("n_pairs > 0")


def induced(edges: DataFrame, members: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Edges with both ends in the member table ``by, node``: two left-semi joins."""
    keys = members.select(*by, "node").distinct()
    inside = edges.join(keys.withColumnRenamed("node", "src"), [*by, "src"], "left_semi")
    return inside.join(keys.withColumnRenamed("node", "dst"), [*by, "dst"], "left_semi")


def ego_edges(edges: DataFrame, egos: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Edges inside each ego, with its ``center``.

    Each edge is attached to its end of lower degree before the join with the egos, so an ego that
    contains a hub does not read all edges of the hub.
    """
    deg = degrees(edges, by).select(*by, "node", "degree")
    src_deg = deg.select(*by, F.col("node").alias("src"), F.col("degree").alias("_ds"))
    dst_deg = deg.select(*by, F.col("node").alias("dst"), F.col("degree").alias("_dd"))
    sized = edges.join(src_deg, [*by, "src"]).join(dst_deg, [*by, "dst"])
    low_src = F.col("_ds") <= F.col("_dd")
    owned = sized.withColumn("node", F.when(low_src, F.col("src")).otherwise(F.col("dst"))).withColumn(
        "_other", F.when(low_src, F.col("dst")).otherwise(F.col("src"))
    )
    members = egos.select(*by, "center", "node").distinct()
    touched = owned.join(members, [*by, "node"])
    inside = touched.join(members.withColumnRenamed("node", "_other"), [*by, "center", "_other"], "left_semi")
    return inside.drop("node", "_other", "_ds", "_dd")


def ego_labels(egos: DataFrame, nodes: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """1 when any node of the ego is labelled."""
    marks = nodes.select(*by, F.col("name").alias("node"), "label")
    return egos.join(marks, [*by, "node"]).groupBy(*by, "center").agg(F.max("label").alias("label"))


def contamination(egos: DataFrame, nodes: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Benign centers with and without an attack node in their ego, by node type of the center."""
    hit = ego_labels(egos, nodes, by).withColumnRenamed("label", "attacked")
    centers = nodes.filter("label = 0").select(*by, F.col("name").alias("center"), "type")
    joined = centers.join(hit, [*by, "center"])
    return joined.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_centers"), F.sum("attacked").alias("n_with_attack")
    )


def hops_from(edges: DataFrame, sources: DataFrame, max_hops: int, by: list[str] = GRAPH) -> DataFrame:
    """Undirected distance of every reached node from the nearest source, up to ``max_hops``."""
    adj = adjacency(edges, by)
    seen = sources.select(*by, "node", F.lit(0).alias("hop")).distinct()
    for hop in range(1, max_hops + 1):
        frontier = seen.filter(F.col("hop") == hop - 1)
        grown = adj.join(frontier.select(*by, "node"), [*by, "node"], "left_semi")
        grown = grown.select(*by, F.col("nbr").alias("node"), F.lit(hop).alias("hop")).distinct()
        seen = seen.unionByName(grown).groupBy(*by, "node").agg(F.min("hop").alias("hop"))
    return seen


def context_triples(nodes: DataFrame, edges: DataFrame, centers: DataFrame, r: int = 2, by: list[str] = GRAPH) -> DataFrame:
    """``<type:prop, action, type:prop>`` of the edge that first reaches each node within ``r`` hops."""
    both = edges.withColumn("edge", F.struct("src", "dst", "actions_str")).select(*by, "src", "dst", "edge")
    links = doubled(both).filter(F.col("node") != F.col("nbr"))
    found = centers.select(*by, "center", F.col("center").alias("node"), F.lit(0).alias("hop"))
    edge_type = both.schema["edge"].dataType.simpleString()
    found = found.withColumn("edge", F.lit(None).cast(edge_type))
    for hop in range(1, r + 1):
        frontier = found.filter(F.col("hop") == hop - 1).drop("edge", "hop")
        grown = frontier.join(links, [*by, "node"]).groupBy(*by, "center", F.col("nbr").alias("node")).agg(
            F.min(F.struct(F.col("node").alias("via"), "edge")).alias("_m")
        )
        fresh = grown.join(found.select(*by, "center", "node"), [*by, "center", "node"], "left_anti")
        fresh = fresh.select(*by, "center", "node", F.lit(hop).alias("hop"), F.col("_m.edge").alias("edge"))
        found = found.unionByName(fresh)
    reached = found.filter("hop > 0").select(*by, "center", "node", "hop", "edge.*")
    for end in ("src", "dst"):
        side = nodes.select(*by, F.col("name").alias(end), F.concat("type", F.lit(":"), F.substring("prop", 1, 48)).alias(f"_{end}"))
        reached = reached.join(side, [*by, end])
    text = F.concat(F.lit("<"), "_src", F.lit(", "), "actions_str", F.lit(", "), "_dst", F.lit(">"))
    return reached.select(*by, "center", "hop", "node", text.alias("triple"))


# ---- reachability -------------------------------------------------------------------------------
def components(edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Connected components: smallest name per component as ``component``.

    Each round takes the smallest label among the neighbours and then the label of that label, so long
    chains shrink quickly. Rounds are cut by a checkpoint and stop when no label changed.
    """
    adj = cut(adjacency(edges, by).unionByName(edges.select(*by, F.col("src").alias("node"), F.col("src").alias("nbr"))).distinct())
    hot = hot_keys(adj, [*by, "nbr"])
    labels = cut(adj.groupBy(*by, "node").agg(F.min("nbr").alias("component")))
    changed = 1
    while changed:
        lookup = labels.select(*by, F.col("node").alias("nbr"), F.col("component").alias("_c"))
        seen = salted_join(adj, lookup, [*by, "nbr"], hot=hot)
        near = seen.groupBy(*by, "node").agg(F.min("_c").alias("_m"))
        stepped = labels.join(near, [*by, "node"]).select(
            *by, "node", F.col("component").alias("_old"), F.least("component", "_m").alias("_new")
        )
        jump = labels.select(*by, F.col("node").alias("_new"), F.col("component").alias("_j"))
        # the label of a giant component is a hot key here
        moved = salted_join(cut(stepped), jump, [*by, "_new"], "left").select(
            *by, "node", "_old", F.least("_new", F.coalesce("_j", "_new")).alias("component")
        )
        moved = cut(moved)
        changed = moved.filter(F.col("_old") != F.col("component")).count()
        labels = moved.drop("_old")
    return labels


def process_components(nodes: DataFrame, edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Component of every process node."""
    procs = nodes.filter(F.col("type") == V.PROCESS_TYPE).select(*by, F.col("name").alias("node"))
    return components(edges, by).join(procs, [*by, "node"], "left_semi")


def related(pairs: DataFrame, comps: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """1 when both ends of a pair lie in the same component."""
    a = comps.select(*by, F.col("node").alias("a"), F.col("component").alias("_ca"))
    b = comps.select(*by, F.col("node").alias("b"), F.col("component").alias("_cb"))
    joined = pairs.join(a, [*by, "a"], "left").join(b, [*by, "b"], "left")
    same = F.coalesce((F.col("_ca") == F.col("_cb")).cast("int"), F.lit(0))
    return joined.withColumn("related", same).drop("_ca", "_cb")


def accessors(nodes: DataFrame, edges: DataFrame, by: list[str] = GRAPH, resources: tuple = V.RESOURCE_TYPES) -> DataFrame:
    """``resource, process`` for every process with an edge to or from a resource node."""
    kind = nodes.select(*by, "name", "type")
    a = kind.select(*by, F.col("name").alias("src"), F.col("type").alias("_ts"))
    b = kind.select(*by, F.col("name").alias("dst"), F.col("type").alias("_td"))
    typed = edges.select(*by, "src", "dst").join(a, [*by, "src"]).join(b, [*by, "dst"])
    out = (F.col("_ts") == V.PROCESS_TYPE) & F.col("_td").isin(*resources)
    back = (F.col("_td") == V.PROCESS_TYPE) & F.col("_ts").isin(*resources)
    pair = F.when(out, F.struct(F.col("dst").alias("resource"), F.col("src").alias("process"))).when(
        back, F.struct(F.col("src").alias("resource"), F.col("dst").alias("process"))
    )
    return typed.withColumn("_p", pair).filter(F.col("_p").isNotNull()).select(*by, "_p.*").distinct()


def accessor_clusters(nodes: DataFrame, edges: DataFrame, by: list[str] = GRAPH, resources: tuple = V.RESOURCE_TYPES):
    """Accessors of one resource that share an ancestor, directly or through others: ``cluster``.

    Two processes share an ancestor if they share a source of the graph, so the links are those to sources: in a forest one
    for each process, whatever its depth. Clusters are components of these links; no pairs of accessors are built.
    """
    access = cut(accessors(nodes, edges, by, resources))
    links = access.join(source_sets(edges, by).withColumnRenamed("node", "process"), [*by, "process"])
    shared = links.select(
        *by, "resource", F.concat(F.lit("p:"), "process").alias("src"), F.concat(F.lit("a:"), "source").alias("dst")
    )
    comps = components(shared, [*by, "resource"]).filter(F.col("node").startswith("p:"))
    comps = comps.select(*by, "resource", F.expr("substring(node, 3)").alias("process"), "component")
    members = access.join(comps, [*by, "resource", "process"], "left")
    members = members.withColumn("component", F.coalesce("component", F.concat(F.lit("p:"), "process")))
    first = members.groupBy(*by, "resource", "component").agg(
        F.min("process").alias("cluster"), F.count(F.lit(1)).alias("cluster_size")
    )
    return members.join(first, [*by, "resource", "component"]).drop("component")


def resource_weights(clusters: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Weight of each resource-process edge: its cluster size over the sum of sizes at the resource."""
    sums = clusters.groupBy(*by, "resource").agg(F.sum("cluster_size").alias("_total"))
    weight = F.col("cluster_size") / F.col("_total")
    return clusters.join(sums, [*by, "resource"]).withColumn("weight", weight).drop("_total")


def process_weights(
    nodes: DataFrame, edges: DataFrame, by: list[str] = GRAPH, resources: tuple = V.RESOURCE_TYPES, boost: float = 5.0
) -> DataFrame:
    """Weights of process-process edges, normalised per source.

    An edge whose ends are also linked by a short path over a resource (three nodes, or four nodes with a
    resource among the inner two) gets 1 + boost / nodes-on-path, any other edge 1.
    """
    kind = nodes.select(*by, F.col("name").alias("node"), "type")
    adj = cut(adjacency(edges, by))
    deg = adj.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("_d"))
    typed = stored(adj.join(kind.withColumnRenamed("node", "nbr"), [*by, "nbr"]), "typed-links")
    is_resource = F.col("type").isin(*resources)
    procs = kind.filter(F.col("type") == V.PROCESS_TYPE).select(*by, "node")
    pairs = edges.filter(F.col("src") != F.col("dst")).select(*by, "src", "dst").distinct()
    pairs = pairs.join(procs.withColumnRenamed("node", "src"), [*by, "src"], "left_semi")
    pairs = cut(pairs.join(procs.withColumnRenamed("node", "dst"), [*by, "dst"], "left_semi"))
    # the end with fewer neighbours is expanded, the other end is only tested
    sized = pairs.join(deg.select(*by, F.col("node").alias("src"), F.col("_d").alias("_ds")), [*by, "src"])
    sized = sized.join(deg.select(*by, F.col("node").alias("dst"), F.col("_d").alias("_dd")), [*by, "dst"])
    low = F.col("_ds") <= F.col("_dd")
    oriented = sized.select(
        *by, "src", "dst", F.when(low, F.col("src")).otherwise(F.col("dst")).alias("s"),
        F.when(low, F.col("dst")).otherwise(F.col("src")).alias("t"),
    )
    step = typed.select(*by, F.col("node").alias("s"), F.col("nbr").alias("a"), is_resource.alias("_ra"))
    first = stored(oriented.join(step, [*by, "s"]).filter(F.col("a") != F.col("t")), "first-steps")
    closes = adj.select(*by, F.col("node").alias("a"), F.col("nbr").alias("t"))
    three = first.filter("_ra").join(closes, [*by, "a", "t"], "left_semi").select(*by, "src", "dst", F.lit(3).alias("loop")).distinct()
    three = stored(three, "loops-of-three")
    open_pairs = stored(first.join(three.select(*by, "src", "dst"), [*by, "src", "dst"], "left_anti"), "open-pairs")
    # the last inner node is a neighbour of both a and t, whatever s is but s itself: two such nodes of a and t tell it for all pairs
    # with that a and t, and again the end with fewer neighbours is expanded
    size = lambda end: deg.select(*by, F.col("node").alias(end), F.col("_d").alias(f"_d{end}"))
    inner = open_pairs.select(*by, "a", "t", "_ra").distinct().join(size("a"), [*by, "a"]).join(size("t"), [*by, "t"])
    narrow = F.col("_da") <= F.col("_dt")
    inner = inner.select(
        *by, "a", "t", "_ra", F.when(narrow, F.col("a")).otherwise(F.col("t")).alias("x"),
        F.when(narrow, F.col("t")).otherwise(F.col("a")).alias("y"),
    )
    second = typed.select(*by, F.col("node").alias("x"), F.col("nbr").alias("b"), is_resource.alias("_rb"))
    longer = inner.join(second, [*by, "x"]).filter(F.col("_ra") | F.col("_rb")).select(*by, "a", "t", "b", "y")
    ends = adj.select(*by, F.col("node").alias("b"), F.col("nbr").alias("y"))
    met = longer.join(ends, [*by, "b", "y"], "left_semi").groupBy(*by, "a", "t").agg(F.min("b").alias("_lo"), F.max("b").alias("_hi"))
    four = open_pairs.join(met, [*by, "a", "t"]).filter((F.col("_lo") != F.col("s")) | (F.col("_hi") != F.col("s")))
    four = four.select(*by, "src", "dst", F.lit(4).alias("loop"))
    loops = three.unionByName(four).groupBy(*by, "src", "dst").agg(F.min("loop").alias("loop"))
    raw = pairs.join(loops, [*by, "src", "dst"], "left").withColumn(
        "_w", F.when(F.col("loop").isNull(), F.lit(1.0)).otherwise(1.0 + F.lit(boost) / F.col("loop"))
    )
    totals = raw.groupBy(*by, "src").agg(F.sum("_w").alias("_t"))
    return raw.join(totals, [*by, "src"]).withColumn("weight", F.col("_w") / F.col("_t")).drop("_w", "_t")


def half_paths(adj: DataFrame, ends: DataFrame, hops: int, by: list[str] = GRAPH) -> DataFrame:
    """Simple paths of 0 to ``hops`` edges from each of ``ends(end)``: ``end, mid, half, n``, where ``half`` starts at the end."""
    step = ends.select(*by, "end", F.col("end").alias("mid"), F.array("end").alias("half"), F.lit(0).alias("n")).distinct()
    found = step
    links = adj.withColumnRenamed("node", "mid")
    for hop in range(1, hops + 1):
        step = step.join(links, [*by, "mid"]).filter(~F.array_contains("half", F.col("nbr")))
        step = step.select(*by, "end", F.col("nbr").alias("mid"), F.concat("half", F.array("nbr")).alias("half"), F.lit(hop).alias("n"))
        found = found.unionByName(step)
    return found


def longer_end(adj: DataFrame, pairs: DataFrame, by: list[str] = GRAPH) -> str:
    """The end of the pairs, ``a`` or ``b``, whose distinct nodes have fewer walks of two edges: the longer halves start there."""
    deg = adj.groupBy(*by, F.col("node").alias("nbr")).agg(F.count(F.lit(1)).alias("_d"))
    walks = adj.join(deg, [*by, "nbr"]).groupBy(*by, "node").agg(F.sum("_d").alias("_w"))
    ends = pairs.select(*by, F.explode(F.array(*[F.struct(F.lit(e).alias("end"), F.col(e).alias("node")) for e in ("a", "b")])).alias("_e"))
    sums = ends.select(*by, "_e.*").distinct().join(walks, [*by, "node"]).groupBy("end").agg(F.sum("_w").alias("_w"))
    cost = {r["end"]: r["_w"] for r in sums.collect()}
    return "a" if cost.get("a", 0) < cost.get("b", 0) else "b"


def simple_paths(edges: DataFrame, pairs: DataFrame, max_hops: int, by: list[str] = GRAPH) -> DataFrame:
    """Undirected simple paths of at most ``max_hops`` edges from ``a`` to ``b``: ``path`` array.

    A path is put together from two halves that meet in one node, the longer by at most one edge. Halves belong to a node and not
    to a pair, so those of a node with many pairs are found once, and the longer ones start at the ends with fewer of them.
    """
    adj = cut(adjacency(edges, by))
    asked = cut(pairs.select(*by, "a", "b").distinct())
    done = asked.filter("a = b").select(*by, "a", "b", F.array("a").alias("path"))
    asked = asked.filter("a <> b")
    far = longer_end(adj, asked, by)
    near = "b" if far == "a" else "a"
    halves = lambda end, hops: half_paths(adj, asked.select(*by, F.col(end).alias("end")), hops, by)
    short = halves(near, max_hops // 2).select(*by, F.col("end").alias(near), "mid", F.col("half").alias("_s"), F.col("n").alias("_ns"))
    long = halves(far, (max_hops + 1) // 2).select(*by, F.col("end").alias(far), "mid", F.col("half").alias("_l"), F.col("n").alias("_nl"))
    met = asked.join(short, [*by, near]).join(long, [*by, far, "mid"])
    met = met.filter((F.col("_nl") - F.col("_ns")).isin(0, 1) & (F.col("_nl") > 0))
    met = met.filter(F.size(F.array_intersect("_s", "_l")) == 1)
    first, last = ("_s", "_l") if near == "a" else ("_l", "_s")
    rest = F.reverse(F.col(last))
    path = F.concat(first, F.slice(rest, 2, F.greatest(F.size(rest) - 1, F.lit(0))))
    return done.unionByName(met.select(*by, "a", "b", path.alias("path")))


def source_sink_paths(edges: DataFrame, max_hops: int, by: list[str] = GRAPH) -> DataFrame:
    """Directed simple paths from nodes without incoming to nodes without outgoing edges."""
    links = edges.filter(F.col("src") != F.col("dst")).select(*by, "src", "dst").distinct()
    outs = links.select(*by, F.col("src").alias("node")).distinct()
    ins = links.select(*by, F.col("dst").alias("node")).distinct()
    paths = outs.join(ins, [*by, "node"], "left_anti").withColumn("path", F.array("node"))
    done = None
    for _ in range(max_hops):
        step = paths.join(links.withColumnRenamed("src", "node"), [*by, "node"])
        step = step.filter(~F.array_contains("path", F.col("dst")))
        step = step.select(*by, F.col("dst").alias("node"), F.concat("path", F.array("dst")).alias("path"))
        ended = step.join(outs, [*by, "node"], "left_anti").select(*by, "path")
        done = ended if done is None else done.unionByName(ended)
        paths = step.join(outs, [*by, "node"], "left_semi")
    return done


def score_paths(paths: DataFrame, edges: DataFrame, shapes: DataFrame, m: int, by: list[str] = GRAPH) -> DataFrame:
    """Top ``m`` paths per graph by mean degree plus rarity (1 / graphs that contain the same path).

    ``shapes(path_text, freq)`` holds how often a path occurs in the reference graphs.
    """
    deg = degrees(edges, by).select(*by, "node", "degree")
    keyed = paths.withColumn("path_text", F.array_join("path", ">"))
    steps = keyed.select(*by, "path_text", F.explode("path").alias("node")).join(deg, [*by, "node"])
    bridge = steps.groupBy(*by, "path_text").agg(F.avg("degree").alias("bridge"))
    scored = bridge.join(shapes, "path_text", "left")
    rarity = 1.0 / F.greatest(F.coalesce("freq", F.lit(1)), F.lit(1))
    scored = scored.withColumn("rarity", rarity).withColumn("score", 0.5 * F.col("bridge") + 0.5 * F.col("rarity"))
    return top_per_group(scored.drop("freq"), by, [F.desc(F.round("score", 9)), F.col("path_text")], m)


# ---- communities --------------------------------------------------------------------------------
def numbered_links(edges: DataFrame, by: list[str] = GRAPH) -> tuple[DataFrame, DataFrame]:
    """(``by, node, id``: nodes with a neighbour, numbered from 1 in order of graph and name; ``node, nbr``: the numbers of
    distinct undirected neighbours in both directions). Rows of two numbers are moved and sorted far faster than names."""
    pairs = edges.filter(F.col("src") != F.col("dst")).select(*by, F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"))
    pairs = stored(pairs.distinct(), "pairs")
    nodes = stored(pairs.select(*by, F.explode(F.array("a", "b")).alias("node")).distinct(), "linked-nodes")
    nodes = stored(ordered_positions(nodes, [], [*(F.col(c) for c in by), F.col("node")], "id"), "numbers")
    number = lambda end: nodes.select(*by, F.col("node").alias(end), F.col("id").alias(f"_{end}"))
    ends = salted_join(salted_join(pairs, number("a"), [*by, "a"]), number("b"), [*by, "b"])
    both = F.array(F.struct(F.col("_a").alias("node"), F.col("_b").alias("nbr")), F.struct(F.col("_b").alias("node"), F.col("_a").alias("nbr")))
    return nodes, stored(ends.select(F.inline(both)), "links")


def _propagate(links: DataFrame, rounds: int, largest: int) -> DataFrame:
    """Synchronous label propagation over distinct ``node, nbr`` numbers up to ``largest``: each node takes the most frequent
    label around it (own label counts once, ties go to the smallest label)."""
    # in the first round all labels around a node differ
    labels = links.groupBy("node").agg(F.min("nbr").alias("_m")).select("node", F.least("node", "_m").alias("community"))
    if not rounds:
        return cut(labels.select("node", F.col("node").alias("community")))
    labels = cut(labels)
    hot = hot_keys(links, ["nbr"])
    bits = largest.bit_length()
    if 2 * bits + 1 <= 63:  # the number of votes and the label fit into one number
        most = F.max(F.shiftleft("n", bits) - F.col("community"))
        best = (F.shiftleft(F.shiftright(F.col("_c") - 1, bits) + 1, bits) - F.col("_c")).alias("community")
    else:
        most = F.min_by("community", F.struct(-F.col("n"), F.col("community")))
        best = F.col("_c").alias("community")
    for _ in range(rounds - 1):
        lookup = labels.select(F.col("node").alias("nbr"), "community")
        votes = salted_join(links, lookup, ["nbr"], hot=hot).select("node", "community").unionByName(labels)
        votes = votes.groupBy("node", "community").agg(F.count(F.lit(1)).alias("n"))
        labels = cut(votes.groupBy("node").agg(most.alias("_c")).select("node", best))
    return labels


def communities(edges: DataFrame, by: list[str] = GRAPH, limit: int = 500, depth: int = 2, min_size: int = 2, rounds: int = 5):
    """Communities by label propagation; groups above ``limit`` are split again inside, up to ``depth`` times.

    Groups below ``min_size`` are dropped and the rest numbered per graph by their smallest member.
    """
    nodes, links = numbered_links(edges, by)
    largest = nodes.count()
    labels = _propagate(links, rounds, largest)
    for level in range(depth):
        sizes = labels.groupBy("community").agg(F.count(F.lit(1)).alias("_n"))
        big = cut(sizes.filter(F.col("_n") > limit).select("community"))
        if big.isEmpty():
            break
        large = cut(labels.join(big, "community", "left_semi"))
        a = large.select("node", F.col("community").alias("_a"))
        b = large.select(F.col("node").alias("nbr"), F.col("community").alias("_b"))
        inner = salted_join(salted_join(links, a, ["node"]), b, ["nbr"]).filter(F.col("_a") == F.col("_b"))
        again = _propagate(stored(inner.select("node", "nbr"), "inner-links"), rounds, largest)
        # a new label is a node of the group that was split; every level has numbers of its own
        again = again.select("node", (F.col("community") + (level + 1) * largest).alias("_new"))
        labels = cut(labels.join(again, "node", "left").select("node", F.coalesce("_new", "community").alias("community")))
    sized = labels.groupBy("community").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("_first"))
    kept = sized.filter(F.col("size") >= min_size)
    kept = kept.join(nodes.select(*by, F.col("id").alias("_first")), "_first")
    numbered = ordered_positions(kept, by, [F.col("_first")], "community_id").select("community", "size", "community_id")
    members = labels.join(numbered, "community").select(F.col("node").alias("id"), "size", "community_id")
    return stored(nodes.join(members, "id").select(*by, "node", "size", "community_id"), "communities")


def community_snapshots(edges: DataFrame, members: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Edges whose ends lie in the same community, with its number."""
    a = members.select(*by, F.col("node").alias("src"), "community_id")
    b = members.select(*by, F.col("node").alias("dst"), F.col("community_id").alias("_b"))
    joined = edges.join(a, [*by, "src"]).join(b, [*by, "dst"])
    return joined.filter(F.col("community_id") == F.col("_b")).drop("_b")


def modularity(edges: DataFrame, members: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """Modularity of the communities of each graph (undirected, unit weights)."""
    adj = stored(adjacency(edges, by), "adjacency")
    a = members.select(*by, "node", F.col("community_id").alias("_a"))
    b = members.select(*by, F.col("node").alias("nbr"), F.col("community_id").alias("_b"))
    joined = adj.join(a, [*by, "node"], "left").join(b, [*by, "nbr"], "left")
    per = joined.groupBy(*by, "_a").agg(
        F.count_if(F.col("_a") == F.col("_b")).alias("_in"), F.count(F.lit(1)).alias("_deg")
    )
    totals = adj.groupBy(*by).agg(F.count(F.lit(1)).alias("_m2"))
    share = F.col("_in") / F.col("_m2") - (F.col("_deg") / F.col("_m2")) * (F.col("_deg") / F.col("_m2"))
    known = per.join(totals, by).filter(F.col("_a").isNotNull())
    return known.groupBy(*by).agg(F.sum(share).alias("modularity"), F.count(F.lit(1)).alias("n_communities"))


# ---- neighbour aggregation ------------------------------------------------------------------------
def typed_sums(edges: DataFrame, vectors: DataFrame, dim: int, by: list[str] = GRAPH) -> DataFrame:
    """Own vector followed by the sum of neighbour vectors per edge category (process, file, net, memory)."""
    from auditloom.functions import vectors as X
    from auditloom.functions.text import edge_category

    links = doubled(edges.select(*by, "src", "dst", edge_category(F.col("actions")).alias("category")))
    seen = salted_join(links, vectors.select(*by, F.col("name").alias("nbr"), "vec"), [*by, "nbr"])
    sums = X.sum_vector(seen, [*by, "node", "category"], "vec", dim, "s")
    packed = sums.groupBy(*by, "node").agg(F.map_from_entries(F.collect_list(F.struct("category", "s"))).alias("_m"))
    joined = vectors.select(*by, "name", "vec").join(packed.withColumnRenamed("node", "name"), [*by, "name"], "left")
    zero = X.zeros(dim)
    parts = [F.coalesce(F.try_element_at("_m", F.lit(c)), zero) for c in sorted(set(V.EDGE_CATEGORIES.values()))]
    return joined.select(*by, "name", F.concat("vec", *parts).alias("vec"))


def neighbour_mean(edges: DataFrame, vectors: DataFrame, dim: int, by: list[str] = GRAPH, weight: str | None = None):
    """Mean of the vectors of incoming neighbours, optionally weighted by a column of the sender."""
    from auditloom.functions import vectors as X

    cols = [*by, F.col("name").alias("src"), "vec"] + ([F.col(weight).cast("double").alias("_w")] if weight else [])
    seen = salted_join(edges.select(*by, "src", "dst"), vectors.select(*cols), [*by, "src"])
    means = X.mean_vector(seen, [*by, "dst"], "vec", dim, "mean", "_w" if weight else None)
    joined = vectors.select(*by, "name").join(means.withColumnRenamed("dst", "name"), [*by, "name"], "left")
    return joined.withColumn("mean", F.coalesce("mean", X.zeros(dim)))

