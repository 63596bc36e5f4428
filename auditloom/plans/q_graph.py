"""Graph operators on the hourly snapshots and on the supplier-part graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import features, graph, reach, wl
from auditloom.plans import views as v
from auditloom.plans.registry import query

ADJ = """adj AS (SELECT DISTINCT snapshot_id, node, nbr FROM (SELECT snapshot_id, src AS node, dst AS nbr FROM edges
  UNION ALL SELECT snapshot_id, dst, src FROM edges) WHERE node <> nbr)"""


def ego_sql(cap: int | None, centers: str = "SELECT snapshot_id, name AS center FROM nodes", name: str = "ego") -> str:
    return f"""{name}_c AS ({centers}),
{name}_h1 AS (SELECT c.snapshot_id, c.center, a.nbr AS node FROM {name}_c c JOIN adj a ON a.snapshot_id = c.snapshot_id AND a.node = c.center),
{name}_all AS (SELECT snapshot_id, center, center AS node, 0 AS hop FROM {name}_c
  UNION ALL SELECT snapshot_id, center, node, 1 FROM {name}_h1
  UNION ALL SELECT DISTINCT h.snapshot_id, h.center, a.nbr, 2 FROM {name}_h1 h JOIN adj a ON a.snapshot_id = h.snapshot_id AND a.node = h.node),
{name} AS (SELECT snapshot_id, center, node, hop FROM (
  SELECT *, row_number() OVER (PARTITION BY snapshot_id, center ORDER BY hop, node) AS rk FROM (
    SELECT snapshot_id, center, node, min(hop) AS hop FROM {name}_all GROUP BY 1, 2, 3)){"" if cap is None else f" WHERE rk <= {cap}"})"""


def all_centers(nodes):
    return nodes.select("snapshot_id", F.col("name").alias("center"))


CAP = 8


def egos(spark, sf):
    return graph.ego(v.edges(spark, sf), all_centers(v.nodes(spark, sf)), 2, CAP)


@query("gr1_ego", v.with_ctes(v.GRAPH, ADJ, ego_sql(CAP), "SELECT snapshot_id, center, node, hop FROM ego"))
def gr1_ego(spark, sf):
    return egos(spark, sf)


BIG = """edges AS (SELECT DISTINCT 1 AS snapshot_id, 's' || l_suppkey AS src, 'p' || l_partkey AS dst FROM lineitem)"""


def big_graph(spark, sf):
    li = v.table(spark, sf, "lineitem")
    return li.select(
        F.lit(1).alias("snapshot_id"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst")
    ).distinct()


@query(
    "gr1_ego_hubs",
    v.with_ctes(BIG, ADJ, ego_sql(32, "SELECT DISTINCT snapshot_id, src AS center FROM edges"), "SELECT center, node, hop FROM ego"),
)
def gr1_ego_hubs(spark, sf):
    """Every supplier is a hub over its parts."""
    e = big_graph(spark, sf)
    centers = e.select("snapshot_id", F.col("src").alias("center")).distinct()
    return graph.ego(e, centers, 2, 32).select("center", "node", "hop")


@query(
    "jn8_two_hop_counts",
    v.with_ctes(
        v.GRAPH,
        ADJ,
        ego_sql(None),
        "SELECT snapshot_id, count(*) AS n_pairs FROM ego WHERE hop = 2 GROUP BY 1",
    ),
)
def jn8_two_hop_counts(spark, sf):
    """All pairs of nodes at distance 2, without a limit on the size of an ego."""
    return graph.two_hop_counts(v.edges(spark, sf)).select("snapshot_id", "n_pairs")


@query(
    "gr2_induced_subgraph",
    v.with_ctes(
        v.GRAPH,
        """SELECT e.snapshot_id, e.src, e.dst, e.actions_str FROM edges e
           JOIN nodes a ON a.snapshot_id = e.snapshot_id AND a.name = e.src AND a.type = 'SUBJECT_PROCESS'
           JOIN nodes b ON b.snapshot_id = e.snapshot_id AND b.name = e.dst AND b.type = 'SUBJECT_PROCESS'""",
    ),
)
def gr2_induced_subgraph(spark, sf):
    procs = v.nodes(spark, sf).filter("type = 'SUBJECT_PROCESS'").select("snapshot_id", F.col("name").alias("node"))
    return graph.induced(v.edges(spark, sf), procs).select("snapshot_id", "src", "dst", "actions_str")


EGO_EDGES = """ego_e AS (SELECT a.snapshot_id, a.center, e.src, e.dst, e.actions_str FROM edges e
  JOIN ego a ON a.snapshot_id = e.snapshot_id AND a.node = e.src
  JOIN ego b ON b.snapshot_id = e.snapshot_id AND b.node = e.dst AND b.center = a.center)"""


@query(
    "gr2_ego_edges",
    v.with_ctes(v.GRAPH, ADJ, ego_sql(CAP), EGO_EDGES, "SELECT snapshot_id, center, src, dst, actions_str FROM ego_e"),
)
def gr2_ego_edges(spark, sf):
    return graph.ego_edges(v.edges(spark, sf), egos(spark, sf)).select("snapshot_id", "center", "src", "dst", "actions_str")


@query(
    "gr3_ego_label",
    v.with_ctes(
        v.GRAPH,
        ADJ,
        ego_sql(CAP),
        """SELECT g.snapshot_id, g.center, max(n.label) AS label FROM ego g JOIN nodes n ON n.snapshot_id = g.snapshot_id AND n.name = g.node
           GROUP BY 1, 2""",
    ),
)
def gr3_ego_label(spark, sf):
    return graph.ego_labels(egos(spark, sf), v.nodes(spark, sf))


@query(
    "gr4_contamination",
    v.with_ctes(
        v.GRAPH,
        ADJ,
        ego_sql(CAP),
        """h AS (SELECT g.snapshot_id, g.center, max(n.label) AS hit FROM ego g JOIN nodes n ON n.snapshot_id = g.snapshot_id
             AND n.name = g.node GROUP BY 1, 2)""",
        """SELECT n.type, count(*) AS n_centers, sum(hit)::BIGINT AS n_with_attack FROM h JOIN nodes n ON n.snapshot_id = h.snapshot_id
           AND n.name = h.center WHERE n.label = 0 GROUP BY 1""",
    ),
)
def gr4_contamination(spark, sf):
    return graph.contamination(egos(spark, sf), v.nodes(spark, sf))


HOPS = """s0 AS (SELECT snapshot_id, name AS node FROM nodes WHERE label = 1),
s1 AS (SELECT DISTINCT a.snapshot_id, a.nbr AS node FROM s0 JOIN adj a ON a.snapshot_id = s0.snapshot_id AND a.node = s0.node),
s2 AS (SELECT DISTINCT a.snapshot_id, a.nbr AS node FROM s1 JOIN adj a ON a.snapshot_id = s1.snapshot_id AND a.node = s1.node),
s3 AS (SELECT DISTINCT a.snapshot_id, a.nbr AS node FROM s2 JOIN adj a ON a.snapshot_id = s2.snapshot_id AND a.node = s2.node),
hops AS (SELECT snapshot_id, node, min(hop) AS hop FROM (SELECT *, 0 AS hop FROM s0 UNION ALL SELECT *, 1 FROM s1
  UNION ALL SELECT *, 2 FROM s2 UNION ALL SELECT *, 3 FROM s3) GROUP BY 1, 2)"""


@query("gr5_hops_to_attack", v.with_ctes(v.GRAPH, ADJ, HOPS, "SELECT snapshot_id, node, hop FROM hops WHERE hop > 0"))
def gr5_hops_to_attack(spark, sf):
    sources = v.nodes(spark, sf).filter("label = 1").select("snapshot_id", F.col("name").alias("node"))
    return graph.hops_from(v.edges(spark, sf), sources, 3).filter("hop > 0")


DEG = """deg AS (SELECT snapshot_id, node, count(*) AS degree FROM (SELECT snapshot_id, src AS node FROM edges
  UNION ALL SELECT snapshot_id, dst FROM edges) GROUP BY 1, 2)"""


@query(
    "gr6_degree_norm",
    v.with_ctes(
        v.GRAPH,
        DEG,
        """SELECT snapshot_id, node, degree, round(CASE WHEN max(degree) OVER w = min(degree) OVER w THEN 0 ELSE
             (degree - min(degree) OVER w)::DOUBLE / (max(degree) OVER w - min(degree) OVER w) END, 6) AS degree_norm
           FROM deg WINDOW w AS (PARTITION BY snapshot_id)""",
    ),
)
def gr6_degree_norm(spark, sf):
    return graph.degrees(v.edges(spark, sf)).withColumn("degree_norm", F.round("degree_norm", 6))


@query(
    "gr7_context_triples",
    v.with_ctes(
        v.GRAPH,
        """lk AS (SELECT snapshot_id, src AS node, dst AS nbr, src, dst, actions_str FROM edges WHERE src <> dst
             UNION ALL SELECT snapshot_id, dst, src, src, dst, actions_str FROM edges WHERE src <> dst),
           c AS (SELECT snapshot_id, label_id AS center FROM lab JOIN nodes ON name = label_id),
           t1 AS (SELECT snapshot_id, center, nbr AS node, src, dst, actions_str FROM (
             SELECT c.center, l.*, row_number() OVER (PARTITION BY c.snapshot_id, c.center, l.nbr ORDER BY l.node, l.src, l.dst) AS rk
             FROM c JOIN lk l ON l.snapshot_id = c.snapshot_id AND l.node = c.center) WHERE rk = 1),
           t2 AS (SELECT snapshot_id, center, nbr AS node, src, dst, actions_str FROM (
             SELECT c.center, l.*, row_number() OVER (PARTITION BY c.snapshot_id, c.center, l.nbr ORDER BY l.node, l.src, l.dst) AS rk
             FROM t1 c JOIN lk l ON l.snapshot_id = c.snapshot_id AND l.node = c.node WHERE l.nbr <> c.center AND NOT EXISTS (
               SELECT 1 FROM t1 x WHERE x.snapshot_id = c.snapshot_id AND x.center = c.center AND x.node = l.nbr)) WHERE rk = 1),
           t AS (SELECT *, 1 AS hop FROM t1 UNION ALL SELECT *, 2 FROM t2)""",
        """SELECT t.snapshot_id, t.center, t.hop, t.node, '<' || a.type || ':' || substring(a.prop, 1, 48) || ', ' || t.actions_str || ', ' ||
             b.type || ':' || substring(b.prop, 1, 48) || '>' AS triple
           FROM t JOIN nodes a ON a.snapshot_id = t.snapshot_id AND a.name = t.src
           JOIN nodes b ON b.snapshot_id = t.snapshot_id AND b.name = t.dst""",
    ),
)
def gr7_context_triples(spark, sf):
    nodes = v.nodes(spark, sf)
    centers = nodes.filter("label = 1").select("snapshot_id", F.col("name").alias("center"))
    return graph.context_triples(nodes, v.edges(spark, sf), centers, 2)


COMP = """reach AS (SELECT DISTINCT snapshot_id, node, node AS root FROM adj
  UNION SELECT r.snapshot_id, a.nbr, r.root FROM reach r JOIN adj a ON a.snapshot_id = r.snapshot_id AND a.node = r.node),
comp AS (SELECT snapshot_id, node, min(root) AS component FROM reach GROUP BY 1, 2)"""


def recursive(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


@query(
    "gr8_components",
    recursive(
        v.GRAPH,
        ADJ,
        COMP,
        """SELECT c.snapshot_id, c.node, c.component FROM comp c JOIN nodes n ON n.snapshot_id = c.snapshot_id AND n.name = c.node
           WHERE n.type = 'SUBJECT_PROCESS'
           UNION ALL SELECT n.snapshot_id, n.name, n.name FROM nodes n WHERE n.type = 'SUBJECT_PROCESS' AND NOT EXISTS (
             SELECT 1 FROM adj a WHERE a.snapshot_id = n.snapshot_id AND a.node = n.name)""",
    ),
)
def gr8_components(spark, sf):
    return graph.process_components(v.nodes(spark, sf), v.edges(spark, sf))


@query(
    "gr8_star_components",
    """SELECT 'c' || o_custkey AS component, 1 + count(DISTINCT o_orderkey) AS n FROM orders GROUP BY 1""",
)
def gr8_star_components(spark, sf):
    """Customer-order graph as one graph: every component is a star around its customer."""
    o = v.table(spark, sf, "orders")
    e = o.select(F.lit(1).alias("snapshot_id"), F.concat(F.lit("o"), "o_orderkey").alias("src"), F.concat(F.lit("c"), "o_custkey").alias("dst"))
    return graph.components(e).groupBy("component").agg(F.count(F.lit(1)).alias("n"))


ANC = """anc AS (SELECT DISTINCT e.snapshot_id, n.name AS node, e.src AS ancestor FROM nodes n JOIN edges e
    ON e.snapshot_id = n.snapshot_id AND e.dst = n.name WHERE n.type = 'SUBJECT_PROCESS'
  UNION SELECT a.snapshot_id, a.node, e.src FROM anc a JOIN edges e ON e.snapshot_id = a.snapshot_id AND e.dst = a.ancestor)"""


@query("gr9_ancestors", recursive(v.GRAPH, ANC, "SELECT snapshot_id, node, ancestor FROM anc"))
def gr9_ancestors(spark, sf):
    procs = v.nodes(spark, sf).filter("type = 'SUBJECT_PROCESS'").select("snapshot_id", F.col("name").alias("node"))
    return reach.ancestors(v.edges(spark, sf), procs)


CLUSTERS = """acc AS (SELECT DISTINCT e.snapshot_id, e.dst AS resource, e.src AS process FROM edges e
    JOIN nodes a ON a.snapshot_id = e.snapshot_id AND a.name = e.src AND a.type = 'SUBJECT_PROCESS'
    JOIN nodes b ON b.snapshot_id = e.snapshot_id AND b.name = e.dst AND b.type = 'FILE_OBJECT_BLOCK'),
share AS (SELECT DISTINCT x.snapshot_id, x.resource, x.process AS a, y.process AS b FROM acc x
    JOIN anc p ON p.snapshot_id = x.snapshot_id AND p.node = x.process
    JOIN anc q ON q.snapshot_id = x.snapshot_id AND q.ancestor = p.ancestor
    JOIN acc y ON y.snapshot_id = x.snapshot_id AND y.resource = x.resource AND y.process = q.node),
grp AS (SELECT snapshot_id, resource, process AS node, process AS root FROM acc
  UNION SELECT g.snapshot_id, g.resource, s.b, g.root FROM grp g JOIN share s ON s.snapshot_id = g.snapshot_id
    AND s.resource = g.resource AND s.a = g.node),
clus AS (SELECT snapshot_id, resource, node AS process, min(root) AS cluster FROM grp GROUP BY 1, 2, 3),
sized AS (SELECT *, count(*) OVER (PARTITION BY snapshot_id, resource, cluster) AS cluster_size FROM clus)"""


@query("gr10_accessor_clusters", recursive(v.GRAPH, ANC, CLUSTERS, "SELECT snapshot_id, resource, process, cluster, cluster_size FROM sized"))
def gr10_accessor_clusters(spark, sf):
    return graph.accessor_clusters(v.nodes(spark, sf), v.edges(spark, sf))


@query(
    "gr11_resource_weights",
    recursive(
        v.GRAPH,
        ANC,
        CLUSTERS,
        """SELECT snapshot_id, resource, process, round(cluster_size::DOUBLE / sum(cluster_size) OVER (PARTITION BY snapshot_id, resource), 6)
             AS weight FROM sized""",
    ),
)
def gr11_resource_weights(spark, sf):
    w = graph.resource_weights(graph.accessor_clusters(v.nodes(spark, sf), v.edges(spark, sf)))
    return w.select("snapshot_id", "resource", "process", F.round("weight", 6).alias("weight"))


@query(
    "gr12_process_weights",
    v.with_ctes(
        v.DAY_GRAPH,
        ADJ,
        """pe AS (SELECT DISTINCT e.snapshot_id, e.src, e.dst FROM edges e
             JOIN nodes a ON a.snapshot_id = e.snapshot_id AND a.name = e.src AND a.type = 'SUBJECT_PROCESS'
             JOIN nodes b ON b.snapshot_id = e.snapshot_id AND b.name = e.dst AND b.type = 'SUBJECT_PROCESS' WHERE e.src <> e.dst),
           ta AS (SELECT a.*, CASE WHEN n.type = 'FILE_OBJECT_BLOCK' THEN 1 ELSE 0 END AS res FROM adj a
             JOIN nodes n ON n.snapshot_id = a.snapshot_id AND n.name = a.nbr),
           lp AS (SELECT p.snapshot_id, p.src, p.dst, 3 AS loop FROM pe p JOIN ta x ON x.snapshot_id = p.snapshot_id AND x.node = p.src AND x.res = 1
               JOIN adj y ON y.snapshot_id = p.snapshot_id AND y.node = x.nbr AND y.nbr = p.dst
             UNION ALL SELECT p.snapshot_id, p.src, p.dst, 4 FROM pe p JOIN ta x ON x.snapshot_id = p.snapshot_id AND x.node = p.src
               JOIN ta y ON y.snapshot_id = p.snapshot_id AND y.node = x.nbr JOIN adj z ON z.snapshot_id = p.snapshot_id AND z.node = y.nbr
               AND z.nbr = p.dst WHERE x.nbr <> p.dst AND y.nbr <> p.src AND y.nbr <> p.dst AND (x.res = 1 OR y.res = 1)),
           ww AS (SELECT p.snapshot_id, p.src, p.dst, min(loop) AS loop FROM pe p LEFT JOIN lp l ON l.snapshot_id = p.snapshot_id
             AND l.src = p.src AND l.dst = p.dst GROUP BY 1, 2, 3),
           wr AS (SELECT *, CASE WHEN loop IS NULL THEN 1.0 ELSE 1 + 5.0 / loop END AS w FROM ww)""",
        """SELECT snapshot_id, src, dst, coalesce(loop, 0) AS loop, round((w / sum(w) OVER (PARTITION BY snapshot_id, src))::DOUBLE, 6)
             AS weight FROM wr""",
    ),
)
def gr12_process_weights(spark, sf):
    w = graph.process_weights(v.daily_nodes(spark, sf), v.daily_edges(spark, sf))
    return w.select("snapshot_id", "src", "dst", F.coalesce("loop", F.lit(0)).alias("loop"), F.round("weight", 6).alias("weight"))


@query(
    "gr13_simple_paths",
    v.with_ctes(
        v.DAY_GRAPH,
        ADJ,
        """pr AS (SELECT DISTINCT e.snapshot_id, e.src AS a, e.dst AS b FROM edges e WHERE e.dst LIKE 'u%' AND e.src <> e.dst)""",
        """SELECT p.snapshot_id, p.a, p.b, p.a || '>' || p.b AS path FROM pr p
           UNION ALL SELECT p.snapshot_id, p.a, p.b, p.a || '>' || x.nbr || '>' || p.b FROM pr p JOIN adj x ON x.snapshot_id = p.snapshot_id
             AND x.node = p.a JOIN adj y ON y.snapshot_id = p.snapshot_id AND y.node = x.nbr AND y.nbr = p.b WHERE x.nbr <> p.b
           UNION ALL SELECT p.snapshot_id, p.a, p.b, p.a || '>' || x.nbr || '>' || y.nbr || '>' || p.b FROM pr p
             JOIN adj x ON x.snapshot_id = p.snapshot_id AND x.node = p.a JOIN adj y ON y.snapshot_id = p.snapshot_id AND y.node = x.nbr
             JOIN adj z ON z.snapshot_id = p.snapshot_id AND z.node = y.nbr AND z.nbr = p.b
             WHERE x.nbr <> p.b AND y.nbr <> p.a AND y.nbr <> p.b""",
    ),
)
def gr13_simple_paths(spark, sf):
    e = v.daily_edges(spark, sf)
    pairs = e.filter(F.col("dst").startswith("u") & (F.col("src") != F.col("dst"))).select(
        "snapshot_id", F.col("src").alias("a"), F.col("dst").alias("b")
    )
    out = graph.simple_paths(e, pairs.distinct(), 3)
    return out.select("snapshot_id", "a", "b", F.array_join("path", ">").alias("path"))


@query(
    "gr14_related",
    recursive(
        v.GRAPH,
        ADJ,
        COMP,
        """pr AS (SELECT snapshot_id, min(name) OVER (PARTITION BY snapshot_id) AS a, name AS b FROM nodes WHERE type = 'SUBJECT_PROCESS')""",
        """SELECT p.snapshot_id, p.a, p.b, CASE WHEN x.component = y.component THEN 1 ELSE 0 END AS related FROM pr p
           LEFT JOIN comp x ON x.snapshot_id = p.snapshot_id AND x.node = p.a LEFT JOIN comp y ON y.snapshot_id = p.snapshot_id AND y.node = p.b""",
    ),
)
def gr14_related(spark, sf):
    n = v.nodes(spark, sf)
    procs = n.filter("type = 'SUBJECT_PROCESS'").select("snapshot_id", F.col("name").alias("b"))
    first = procs.groupBy("snapshot_id").agg(F.min("b").alias("a"))
    pairs = procs.join(first, "snapshot_id")
    return graph.related(pairs, graph.components(v.edges(spark, sf)))


@query("gr15_communities")
def gr15_communities(spark, sf):
    e = v.edges(spark, sf)
    return graph.modularity(e, graph.communities(e, limit=12)).withColumn("modularity", F.round("modularity", 6))


@query("gr16_community_snapshots")
def gr16_community_snapshots(spark, sf):
    e = v.edges(spark, sf)
    inside = graph.community_snapshots(e, graph.communities(e, limit=12))
    return inside.groupBy("snapshot_id", "community_id").agg(F.count(F.lit(1)).alias("n_edges"))


# ---- WL -----------------------------------------------------------------------------------------
INIT_SQL = """lower(type) || '|' || CASE
  WHEN contains(lower(type), 'process') OR contains(lower(type), 'subject') THEN
    substring(CASE WHEN w = '' THEN 'UNK' WHEN contains(w, '/') THEN regexp_extract(rtrim(w, '/'), '[^/]*$') ELSE w END, 1, 16)
  WHEN contains(lower(type), 'file') THEN CASE WHEN split_part(prop, '/', 1) <> '' THEN array_to_string(string_split(prop, '/')[1:4], '/')
    ELSE substring(prop, 1, 24) END
  ELSE CASE WHEN len(string_split(prop, ',')) >= 4 THEN 'port:' || trim(split_part(prop, ',', 4))
    WHEN len(string_split(prop, ',')) >= 2 THEN 'port:' || trim(split_part(prop, ',', 2)) ELSE 'net' END END"""


def wl_sql(start: str, rounds: int = 2) -> str:
    """CTEs l0..lN (snapshot_id, node, label) of the hashed refinement."""
    parts = [
        """lk AS (SELECT snapshot_id, src AS node, dst AS nbr, actions_str FROM edges
             UNION ALL SELECT snapshot_id, dst, src, actions_str FROM edges)""",
        f"l0 AS ({start})",
    ]
    for i in range(1, rounds + 1):
        parts.append(
            f"""l{i} AS (SELECT l.snapshot_id, l.node, substring(md5(l.label || '|' || coalesce(s.m, 'none')), 1, 16)
                  AS label FROM l{i - 1} l LEFT JOIN (
                  SELECT snapshot_id, node, sum(('0x' || substring(md5(t), 1, 8))::BIGINT)::BIGINT || '|' ||
                    sum(('0x' || substring(md5(t), 9, 8))::BIGINT)::BIGINT || '|' ||
                    sum(('0x' || substring(md5(t), 17, 8))::BIGINT)::BIGINT AS m FROM (
                    SELECT k.snapshot_id, k.node, k.actions_str || ':' || n.label AS t FROM lk k JOIN l{i - 1} n
                      ON n.snapshot_id = k.snapshot_id AND n.node = k.nbr) GROUP BY 1, 2) s
                  ON s.snapshot_id = l.snapshot_id AND s.node = l.node)"""
        )
    union = " UNION ALL ".join(f"SELECT snapshot_id, node, {i} AS iter, label FROM l{i}" for i in range(rounds + 1))
    parts.append(f"wl AS ({union})")
    return ",\n".join(parts)


START = f"""SELECT snapshot_id, name AS node, {INIT_SQL} AS label FROM (
  SELECT *, regexp_extract(split_part(prop, ',', 1), '\\S+') AS w FROM nodes)"""
WL = wl_sql(START)
HIST = "hist AS (SELECT snapshot_id, iter, label, count(*) AS cnt FROM wl GROUP BY 1, 2, 3)"


def wl_hist(spark, sf):
    n = v.nodes(spark, sf)
    start = n.select("snapshot_id", F.col("name").alias("node"), wl.initial_label(F.col("type"), F.col("prop")).alias("label"))
    return wl.wl_histogram(wl.wl_labels(start, v.edges(spark, sf), 2))


@query("gr17_wl_histogram", v.with_ctes(v.GRAPH, WL, HIST, "SELECT snapshot_id, iter, label, cnt FROM hist"))
def gr17_wl_histogram(spark, sf):
    return wl_hist(spark, sf)


NORMS = "nrm AS (SELECT snapshot_id, sqrt(sum(cnt * cnt)) AS n FROM hist GROUP BY 1)"


@query(
    "gr18_wl_kernel",
    v.with_ctes(
        v.GRAPH,
        WL,
        HIST,
        NORMS,
        """SELECT a.snapshot_id AS a, b.snapshot_id AS b, round(coalesce(d.dot, 0) / (a.n * b.n), 6) AS sim FROM nrm a
           JOIN nrm b ON b.snapshot_id = a.snapshot_id + 1
           LEFT JOIN (SELECT x.snapshot_id, sum(x.cnt * y.cnt) AS dot FROM hist x JOIN hist y ON y.snapshot_id = x.snapshot_id + 1
             AND x.iter = y.iter AND x.label = y.label GROUP BY 1) d ON d.snapshot_id = a.snapshot_id""",
    ),
)
def gr18_wl_kernel(spark, sf):
    vec = wl.as_vectors(wl_hist(spark, sf), F.col("snapshot_id"))
    ids = vec.select(F.col("id").alias("a")).distinct()
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    return wl.wl_kernel(vec, vec, pairs).withColumn("sim", F.round("sim", 6))


SIDES = """side AS (SELECT snapshot_id, max(label) AS label FROM nodes GROUP BY 1),
ben AS (SELECT h.*, n.n FROM hist h JOIN nrm n USING (snapshot_id) JOIN side s USING (snapshot_id) WHERE s.label = 0 AND snapshot_id < 473808),
att AS (SELECT h.*, n.n FROM hist h JOIN nrm n USING (snapshot_id) JOIN side s USING (snapshot_id) WHERE s.label = 1 AND snapshot_id >= 473808)"""


def benign_attack(spark, sf):
    nodes = v.nodes(spark, sf)
    marks = nodes.groupBy("snapshot_id").agg(F.max("label").alias("_l"))
    joined = wl_hist(spark, sf).join(marks, "snapshot_id")
    early = F.col("snapshot_id") < v.SPLIT_HOUR
    ben = joined.filter((F.col("_l") == 0) & early)
    att = joined.filter((F.col("_l") == 1) & ~early)
    return wl.as_vectors(ben, F.col("snapshot_id")), wl.as_vectors(att, F.col("snapshot_id"))


ALL_SIMS = """al AS (SELECT a, b, coalesce(sim, 0) AS sim FROM (SELECT DISTINCT snapshot_id AS a FROM ben) CROSS JOIN (SELECT DISTINCT snapshot_id AS b FROM att)
  LEFT JOIN sims USING (a, b))"""


@query(
    "gr19_wl_topk",
    v.with_ctes(
        v.GRAPH,
        WL,
        HIST,
        NORMS,
        SIDES,
        """sims AS (SELECT a.snapshot_id AS a, b.snapshot_id AS b, sum(a.cnt * b.cnt) / (max(a.n) * max(b.n)) AS sim FROM ben a
             JOIN att b ON a.iter = b.iter AND a.label = b.label GROUP BY 1, 2)""",
        ALL_SIMS,
        """SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b)::INT AS rank
             FROM al) WHERE rank <= 5""",
    ),
)
def gr19_wl_topk(spark, sf):
    ben, att = benign_attack(spark, sf)
    return wl.most_similar(ben, att, 5).withColumn("sim", F.round("sim", 6))


@query(
    "jn6_similarity_join",
    v.with_ctes(
        v.GRAPH,
        WL,
        HIST,
        NORMS,
        SIDES,
        """sims AS (SELECT a.snapshot_id AS a, b.snapshot_id AS b, sum(a.cnt * b.cnt) / (max(a.n) * max(b.n)) AS sim FROM ben a
             JOIN att b ON a.iter = b.iter AND a.label = b.label GROUP BY 1, 2)""",
        ALL_SIMS,
        """SELECT a, b, round(sim, 6) AS sim, rank FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(sim, 9) DESC, b)::INT AS rank
             FROM al) WHERE rank <= 20""",
    ),
)
def jn6_similarity_join(spark, sf):
    """For every benign snapshot its 20 most similar attack snapshots."""
    ben, att = benign_attack(spark, sf)
    return wl.most_similar(ben, att, 20).withColumn("sim", F.round("sim", 6))


RSG = wl_sql("SELECT snapshot_id, name AS node, name AS label FROM nodes")
RSG_COUNTS = """rsg AS (SELECT w.snapshot_id, w.iter AS depth, w.label AS rsg, sum(n.frequency)::BIGINT AS weight FROM wl w
  JOIN nodes n ON n.snapshot_id = w.snapshot_id AND n.name = w.node GROUP BY 1, 2, 3)"""


@query("gr20_rooted_subgraphs", v.with_ctes(v.GRAPH, RSG, RSG_COUNTS, "SELECT snapshot_id, depth, rsg, weight FROM rsg"))
def gr20_rooted_subgraphs(spark, sf):
    return wl.rooted_counts(v.nodes(spark, sf), v.edges(spark, sf), 2)


@query(
    "fe5_graph_document",
    v.with_ctes(
        v.GRAPH,
        RSG,
        RSG_COUNTS,
        """k AS (SELECT snapshot_id, depth || '#' || rsg AS rsg, weight FROM rsg),
           df AS (SELECT rsg, count(*) AS df FROM k GROUP BY 1), nn AS (SELECT count(DISTINCT snapshot_id) AS n FROM k)""",
        "SELECT snapshot_id, rsg, round(ln(1 + weight) * (ln((n + 1.0) / (df + 1.0)) + 1), 6) AS weight FROM k JOIN df USING (rsg), nn",
    ),
)
def fe5_graph_document(spark, sf):
    counts = wl.rooted_counts(v.nodes(spark, sf), v.edges(spark, sf), 2)
    return features.rsg_document(counts).withColumn("weight", F.round("weight", 6))


# ---- neighbour vectors ----------------------------------------------------------------------------
NV = """nv AS (SELECT n.snapshot_id, n.name, unnest(range(64)) AS i, unnest(e.embedding)::DOUBLE AS x FROM nodes n JOIN embeddings e
  ON e.vec_id = CASE WHEN n.name LIKE 'u%' THEN substring(n.name, 2)::BIGINT ELSE 300 + substring(n.name, 2)::BIGINT END)"""


def node_keys(spark, sf):
    """Nodes with the number of their vector, by the number in their name, and the vectors by these: ``key, vec``."""
    number = F.expr("substring(name, 2)").cast("bigint")
    key = F.when(F.col("name").startswith("u"), number).otherwise(300 + number)
    table = v.vectors(spark, sf).select(F.col("vec_id").alias("key"), "vec")
    return v.nodes(spark, sf).select("snapshot_id", "name", key.alias("key")), table


def node_vectors(spark, sf):
    """Vector of a node by the number in its name."""
    keys, table = node_keys(spark, sf)
    return keys.join(table, "key").drop("key")


def vec_digest(df, keys, vec="vec"):
    """Three numbers that identify a long vector: its sum, square sum and position-weighted sum."""
    from auditloom.functions import vectors as X

    weighted = F.aggregate(F.transform(vec, lambda x, i: x * i), F.lit(0.0), lambda a, x: a + x)
    return df.select(
        *keys, F.round(X.total(F.col(vec)), 6).alias("s"), F.round(X.dot(vec, vec), 6).alias("q"), F.round(weighted, 5).alias("w"),
        F.size(vec).cast("bigint").alias("n"),
    )


CAT_OF = """CASE regexp_extract(e.actions_str, 'EVENT_(READ|WRITE|OPEN|FORK|SENDTO)', 1) WHEN 'FORK' THEN 0 WHEN 'SENDTO' THEN 2 ELSE 1 END"""


@query(
    "gr21_typed_sums",
    v.with_ctes(
        v.GRAPH,
        NV,
        f"""lc AS (SELECT e.snapshot_id, e.src AS node, e.dst AS nbr, {CAT_OF} AS cat FROM edges e
              UNION ALL SELECT e.snapshot_id, e.dst, e.src, {CAT_OF} FROM edges e),
            agg AS (SELECT snapshot_id, name, i, x FROM nv
              UNION ALL SELECT l.snapshot_id, l.node, 64 * (l.cat + 1) + nv.i, sum(nv.x) FROM lc l JOIN nv ON nv.snapshot_id = l.snapshot_id
                AND nv.name = l.nbr GROUP BY 1, 2, 3)""",
        """SELECT a.snapshot_id, a.name, round(sum(a.x), 6) AS s, round(sum(a.x * a.x), 6) AS q, round(sum(a.x * a.i), 5) AS w, 320::BIGINT AS n
           FROM agg a JOIN (SELECT DISTINCT snapshot_id, name FROM nv) k USING (snapshot_id, name) GROUP BY 1, 2""",
    ),
)
def gr21_typed_sums(spark, sf):
    out = graph.typed_sums(v.edges(spark, sf), node_vectors(spark, sf), v.DIM)
    return vec_digest(out, ["snapshot_id", "name"])


@query(
    "gr22_neighbour_mean",
    v.with_ctes(
        v.GRAPH,
        NV,
        """m AS (SELECT e.snapshot_id, e.dst AS name, nv.i, sum(nv.x * n.frequency) / sum(n.frequency) AS x FROM edges e
             JOIN nv ON nv.snapshot_id = e.snapshot_id AND nv.name = e.src JOIN nodes n ON n.snapshot_id = e.snapshot_id AND n.name = e.src
             GROUP BY 1, 2, 3)""",
        """SELECT k.snapshot_id, k.name, round(coalesce(sum(m.x), 0), 6) AS s, round(coalesce(sum(m.x * m.x), 0), 6) AS q,
             round(coalesce(sum(m.x * m.i), 0), 5) AS w, 64::BIGINT AS n FROM (SELECT DISTINCT snapshot_id, name FROM nv) k
           LEFT JOIN m USING (snapshot_id, name) GROUP BY 1, 2""",
    ),
)
def gr22_neighbour_mean(spark, sf):
    vec = node_vectors(spark, sf).join(v.nodes(spark, sf).select("snapshot_id", "name", "frequency"), ["snapshot_id", "name"])
    out = graph.neighbour_mean(v.edges(spark, sf), vec, v.DIM, weight="frequency")
    return vec_digest(out, ["snapshot_id", "name"], "mean")


@query(
    "gr23_path_scores",
    recursive(
        v.GRAPH,
        DEG,
        """dl AS (SELECT DISTINCT snapshot_id, src, dst FROM edges WHERE src <> dst),
           pth AS (SELECT DISTINCT d.snapshot_id, d.src AS node, [d.src] AS path, 0 AS len FROM dl d WHERE NOT EXISTS (
               SELECT 1 FROM dl x WHERE x.snapshot_id = d.snapshot_id AND x.dst = d.src)
             UNION ALL SELECT p.snapshot_id, d.dst, list_append(p.path, d.dst), p.len + 1 FROM pth p JOIN dl d
               ON d.snapshot_id = p.snapshot_id AND d.src = p.node WHERE p.len < 4 AND NOT list_contains(p.path, d.dst)),
           fin AS (SELECT p.snapshot_id, p.path, array_to_string(p.path, '>') AS path_text FROM pth p WHERE p.len > 0 AND NOT EXISTS (
             SELECT 1 FROM dl x WHERE x.snapshot_id = p.snapshot_id AND x.src = p.node)),
           fr AS (SELECT path_text, count(DISTINCT snapshot_id) AS freq FROM fin WHERE snapshot_id < 473808 GROUP BY 1),
           st AS (SELECT snapshot_id, path_text, unnest(path) AS node FROM fin),
           br AS (SELECT s.snapshot_id, s.path_text, avg(d.degree) AS bridge FROM st s JOIN deg d USING (snapshot_id, node) GROUP BY 1, 2),
           sc AS (SELECT b.*, 1.0 / greatest(coalesce(f.freq, 1), 1) AS rarity FROM br b LEFT JOIN fr f USING (path_text))""",
        """SELECT snapshot_id, path_text, round(bridge, 6) AS bridge, round(rarity, 6)::DOUBLE AS rarity, rank FROM (SELECT *, row_number() OVER (
             PARTITION BY snapshot_id ORDER BY round(0.5 * bridge + 0.5 * rarity, 9) DESC, path_text)::INT AS rank FROM sc) WHERE rank <= 3""",
    ),
)
def gr23_path_scores(spark, sf):
    e = v.edges(spark, sf)
    paths = graph.source_sink_paths(e, 4)
    shapes = paths.filter(F.col("snapshot_id") < v.SPLIT_HOUR).groupBy(F.array_join("path", ">").alias("path_text")).agg(
        F.countDistinct("snapshot_id").alias("freq")
    )
    out = graph.score_paths(paths, e, shapes, 3)
    return out.select("snapshot_id", "path_text", F.round("bridge", 6).alias("bridge"), F.round("rarity", 6).alias("rarity"), "rank")
