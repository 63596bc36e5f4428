"""Weisfeiler-Leman labels, histograms, kernel and rooted-subgraph counts.

The multiset of neighbour labels is folded into order-free md5 sums (see ``hashing.multiset_sums``)
instead of a sorted list: equal multisets get equal labels, and a hub's neighbours are combined map-side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.hashing import hash60, multiset_sums, short_label
from auditloom.functions.text import basename, is_file, is_network, is_process
from auditloom.operators.graph import doubled
from auditloom.operators.ranking import hot_keys, salted_join, top_per_group
from auditloom.operators.similarity import similar_pairs, top_similar
from auditloom.session import cut

GRAPH = ["snapshot_id"]
# fixed value: characters stripped around a property text
_WRAP = "{ '\"}"


def initial_label(node_type: Column, prop: Column) -> Column:
    """'type|coarse': command name, leading directories, port, or the start of the text."""
    kind = F.lower(F.coalesce(node_type, F.lit("UNK")))
    text = F.coalesce(F.trim(prop), F.lit(""))
    word = F.regexp_extract(F.split(text, ",")[0], r"(\S+)", 1)
    command = F.when(word.contains("/"), basename(F.rtrim(word, F.lit("/")))).otherwise(word)
    process = F.substring(F.when(command == "", "UNK").otherwise(command), 1, 16)
    path = F.btrim(text, F.lit(_WRAP))
    segments = F.slice(F.split(path, "/"), 1, 4)
    file = F.when(segments[0] != "", F.array_join(segments, "/")).otherwise(F.substring(path, 1, 24))
    parts = F.split(path, ",")
    port = (
        F.when(F.size(parts) >= 4, F.concat(F.lit("port:"), F.trim(F.get(parts, F.lit(3)))))
        .when(F.size(parts) >= 2, F.concat(F.lit("port:"), F.trim(F.get(parts, F.lit(1)))))
        .otherwise("net")
    )
    other = F.when(text == "", "UNK").otherwise(F.substring(text, 1, 12))
    coarse = (
        F.when(is_process(kind), process).when(is_file(kind), file).when(is_network(kind), port).otherwise(other)
    )
    return F.concat(kind, F.lit("|"), coarse)


def sample_nodes(nodes: DataFrame, by: list[str], max_nodes: int, seed: int = 0, name: str = "name") -> DataFrame:
    """Uniform hash sample of at most ``max_nodes`` nodes per graph."""
    return top_per_group(nodes, by, [hash60(F.col(name), seed), F.col(name)], max_nodes, "_r").drop("_r")


def wl_labels(labels: DataFrame, edges: DataFrame, h: int, by: list[str] = GRAPH) -> DataFrame:
    """``by, node, iter, label`` for rounds 0..h.

    ``labels(by, node, label)`` are the initial labels; only edges between these nodes count.
    """
    links = cut(doubled(edges.select(*by, "src", "dst", "actions_str")))
    hot = hot_keys(links, [*by, "nbr"])
    current = cut(labels.select(*by, "node", "label"))
    out = current.withColumn("iter", F.lit(0))
    for step in range(1, h + 1):
        lookup = current.select(*by, F.col("node").alias("nbr"), F.col("label").alias("_nl"))
        around = salted_join(links, lookup, [*by, "nbr"], hot=hot)
        text = F.concat("actions_str", F.lit(":"), "_nl")
        folded = around.groupBy(*by, "node").agg(multiset_sums(text).alias("_m"))
        joined = current.join(folded, [*by, "node"], "left")
        whole = F.concat_ws("|", "label", F.coalesce("_m", F.lit("none")))
        current = cut(joined.select(*by, "node", short_label(whole).alias("label")))
        out = out.unionByName(current.withColumn("iter", F.lit(step)))
    return out


def wl_histogram(labels: DataFrame, by: list[str] = GRAPH) -> DataFrame:
    return labels.groupBy(*by, "iter", "label").agg(F.count(F.lit(1)).alias("cnt"))


def as_vectors(hist: DataFrame, graph_id: Column) -> DataFrame:
    """Histogram as ``id, feature, weight`` rows for the similarity joins."""
    feature = F.concat(F.col("iter").cast("string"), F.lit("#"), "label")
    return hist.select(graph_id.alias("id"), feature.alias("feature"), F.col("cnt").cast("double").alias("weight"))


def wl_kernel(left: DataFrame, right: DataFrame, pairs: DataFrame) -> DataFrame:
    """Normalised kernel of given pairs ``a, b`` (0 when nothing is shared)."""
    norms_a = left.groupBy(F.col("id").alias("a")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_na"))
    norms_b = right.groupBy(F.col("id").alias("b")).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("_nb"))
    a = left.select(F.col("id").alias("a"), "feature", F.col("weight").alias("_wa"))
    b = right.select(F.col("id").alias("b"), "feature", F.col("weight").alias("_wb"))
    dots = pairs.join(a, "a").join(b, ["b", "feature"]).groupBy("a", "b").agg(F.sum(F.col("_wa") * F.col("_wb")).alias("_dot"))
    joined = pairs.join(norms_a, "a").join(norms_b, "b").join(dots, ["a", "b"], "left")
    sim = F.coalesce(F.col("_dot") / (F.col("_na") * F.col("_nb")), F.lit(0.0))
    return joined.select("a", "b", sim.alias("sim"))


def most_similar(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """Top ``k`` right graphs per left graph by the kernel."""
    return top_similar(left, right, k)


def pairs_above(left: DataFrame, right: DataFrame, min_sim: float) -> DataFrame:
    return similar_pairs(left, right, min_sim)


def rooted_counts(nodes: DataFrame, edges: DataFrame, depth: int = 2, by: list[str] = GRAPH) -> DataFrame:
    """Frequency-weighted counts of rooted subgraphs of depth 0..depth: ``by, depth, rsg, weight``.

    Depth 0 is the node name; deeper subgraphs are hashed each round.
    """
    start = nodes.select(*by, F.col("name").alias("node"), F.col("name").alias("label"))
    labels = wl_labels(start, edges, depth, by)
    weights = nodes.select(*by, F.col("name").alias("node"), "frequency")
    joined = labels.join(weights, [*by, "node"])
    return joined.groupBy(*by, F.col("iter").alias("depth"), F.col("label").alias("rsg")).agg(
        F.sum("frequency").alias("weight")
    )
