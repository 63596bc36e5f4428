"""Reachability on directed graphs without the closure.

Two nodes share an ancestor exactly if they share an ancestor in a source: a strongly connected component that nothing else
leads to. So instead of all ancestors a node carries its sources, which is one in a forest however deep it is.
``source_sets`` finds the source components by one step of colouring (the smallest ancestor of every node, then what leads
back to it), contracts them, follows nodes with a single parent by pointer jumping, and carries sets of sources only along
the few nodes where several parents meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.operators.ranking import hot_keys, salted_join
from auditloom.session import cut

GRAPH = ["snapshot_id"]


def _all_of(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def smallest_ancestors(links: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """``node, label``: the smallest name among a node and all that lead to it.

    Besides the labels of its parents a node takes the label of its label, which is an ancestor, too; so long chains need few
    rounds.
    """
    ends = F.array("src", "dst")
    labels = cut(links.select(*by, F.explode(ends).alias("node")).distinct().withColumn("label", F.col("node")))
    hot = hot_keys(links, [*by, "src"])
    changed = 1
    while changed:
        lookup = labels.select(*by, F.col("node").alias("src"), F.col("label").alias("_l"))
        near = salted_join(links, lookup, [*by, "src"], hot=hot).groupBy(*by, F.col("dst").alias("node")).agg(F.min("_l").alias("_m"))
        stepped = cut(labels.join(near, [*by, "node"], "left").select(*by, "node", F.col("label").alias("_old"), F.least("label", F.coalesce("_m", "label")).alias("_new")))
        jump = labels.select(*by, F.col("node").alias("_new"), F.col("label").alias("_j"))
        moved = cut(salted_join(stepped, jump, [*by, "_new"], "left").select(*by, "node", "_old", F.least("_new", F.coalesce("_j", "_new")).alias("label")))
        changed = moved.filter("_old <> label").count()
        labels = moved.drop("_old")
    return labels


def source_components(links: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """``node, comp``: nodes of a source component share its smallest name; other nodes may stand alone.

    Every source component is the set of nodes that are reached from their smallest ancestor and lead back to it.
    """
    labels = smallest_ancestors(links, by)
    a = labels.select(*by, F.col("node").alias("src"), F.col("label").alias("_a"))
    b = labels.select(*by, F.col("node").alias("dst"), F.col("label").alias("_b"))
    inner = cut(links.join(a, [*by, "src"]).join(b, [*by, "dst"]).filter("_a = _b").select(*by, "src", "dst", F.col("_a").alias("comp")))
    frontier = labels.filter("node = label").select(*by, "node", F.col("label").alias("comp"))
    found = []
    while True:
        frontier = cut(frontier)
        if frontier.isEmpty():
            break
        found.append(frontier)
        back = inner.join(frontier.withColumnRenamed("node", "dst"), [*by, "dst", "comp"]).select(*by, F.col("src").alias("node"), "comp").distinct()
        frontier = back.join(_all_of(found), [*by, "node", "comp"], "left_anti")
    return _all_of(found) if found else labels.select(*by, "node", F.col("label").alias("comp")).limit(0)


def _followed(parents: DataFrame, by: list[str]) -> DataFrame:
    """``node, rep``: where the single parents of nodes end; ``parents`` has ``node, parent`` and no cycle of single parents."""
    single = parents.groupBy(*by, "node").agg(F.count(F.lit(1)).alias("_n"), F.min("parent").alias("rep")).filter("_n = 1").drop("_n")
    rep = cut(single)
    while True:
        ahead = rep.select(*by, F.col("node").alias("rep"), F.col("rep").alias("_next"))
        moved = cut(rep.join(ahead, [*by, "rep"], "left").select(*by, "node", F.coalesce("_next", "rep").alias("rep"), F.col("_next").isNotNull().alias("_moved")))
        rep = moved.drop("_moved")
        if moved.filter("_moved").isEmpty():
            return rep


def _replaced(df: DataFrame, column: str, rep: DataFrame, by: list[str]) -> DataFrame:
    lookup = rep.select(*by, F.col("node").alias(column), F.col("rep").alias("_rep"))
    return df.join(lookup, [*by, column], "left").withColumn(column, F.coalesce("_rep", column)).drop("_rep")


def source_sets(edges: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """``node, source``: the source components with a path of at least one edge to the node."""
    loops = edges.filter("src = dst").select(*by, F.col("src").alias("node")).distinct()
    links = cut(edges.filter("src <> dst").select(*by, "src", "dst").distinct())
    comps = cut(source_components(links, by))

    def comp_of(df: DataFrame, column: str) -> DataFrame:
        return _replaced(df, column, comps.withColumnRenamed("comp", "rep"), by)

    merged = comp_of(comp_of(links, "src"), "dst")
    inside = merged.filter("src = dst").select(*by, F.col("src").alias("node")).unionByName(comp_of(loops, "node")).distinct()
    parents = cut(merged.filter("src <> dst").select(*by, F.col("dst").alias("node"), F.col("src").alias("parent")).distinct())
    everything = links.select(*by, F.explode(F.array("src", "dst")).alias("node")).unionByName(loops).distinct().withColumn("rep", F.col("node"))
    reps = comp_of(everything, "rep")
    # nodes with one parent have its sources; where that leaves a node with one parent, go on
    while True:
        rep = _followed(parents, by)
        if rep.isEmpty():
            break
        reps = cut(_replaced(reps, "rep", rep, by))
        joins = parents.join(rep.select(*by, "node"), [*by, "node"], "left_anti")
        parents = cut(_replaced(joins, "parent", rep, by).filter("node <> parent").select(*by, "node", "parent").distinct())
    # what is left has several parents, or none and is a source
    meets = parents.select(*by, "node").distinct()
    frontier = parents.join(meets.withColumnRenamed("node", "parent"), [*by, "parent"], "left_anti").select(*by, "node", F.col("parent").alias("source"))
    steps = cut(parents.join(meets.withColumnRenamed("node", "parent"), [*by, "parent"], "left_semi"))
    found = []
    while True:
        frontier = cut(frontier.distinct())
        if frontier.isEmpty():
            break
        found.append(frontier)
        ahead = steps.join(frontier.select(*by, F.col("node").alias("parent"), "source"), [*by, "parent"]).select(*by, "node", "source").distinct()
        frontier = ahead.join(_all_of(found), [*by, "node", "source"], "left_anti")
    many = reps.join(_all_of(found).withColumnRenamed("node", "rep"), [*by, "rep"]).select(*by, "node", "source") if found else None
    one = reps.join(meets.withColumnRenamed("node", "rep"), [*by, "rep"], "left_anti")
    # a source's own nodes have an ancestor only if it has an edge inside
    comp = comps.select(*by, "node", F.col("comp").alias("_comp"))
    own = one.join(comp, [*by, "node"], "left").withColumn("_comp", F.coalesce("_comp", "node"))
    own = own.join(inside.select(*by, F.col("node").alias("rep"), F.lit(True).alias("_cycle")), [*by, "rep"], "left")
    own = own.filter((F.col("_comp") != F.col("rep")) | F.col("_cycle")).select(*by, "node", F.col("rep").alias("source"))
    return own if many is None else own.unionByName(many)


def ancestors(edges: DataFrame, targets: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    """All transitive predecessors of the asked nodes: ``node, ancestor``. Each round writes its new pairs only."""
    parents = cut(edges.select(*by, F.col("dst").alias("_child"), F.col("src").alias("ancestor")).distinct())
    first = targets.select(*by, "node").distinct().withColumn("_child", F.col("node"))
    frontier = first.join(parents, [*by, "_child"]).select(*by, "node", "ancestor").distinct()
    found = []
    while True:
        frontier = cut(frontier)
        found.append(frontier)
        if frontier.isEmpty():
            return _all_of(found)
        step = frontier.withColumnRenamed("ancestor", "_child").join(parents, [*by, "_child"])
        frontier = step.select(*by, "node", "ancestor").distinct().join(_all_of(found), [*by, "node", "ancestor"], "left_anti")
