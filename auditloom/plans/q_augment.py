"""Training-set builders on the hourly snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions import text as T
from auditloom.operators import augment, graph, wl
from auditloom.plans import q_features as fe
from auditloom.plans import q_graph as g
from auditloom.plans import views as v
from auditloom.plans.q_events import CORPUS
from auditloom.plans.q_vectors import H
from auditloom.plans.registry import query
from auditloom.session import cut

KEY = ["snapshot_id", "name"]
UNIT60 = "1152921504606846976.0"


def draw(*parts: str) -> str:
    return f"({H(*parts)} / {UNIT60})"


KEEP = """SELECT snapshot_id, src, dst, actions_str FROM (SELECT *, max(CASE WHEN d > p THEN 1 ELSE 0 END) OVER (PARTITION BY snapshot_id) AS anyk,
  row_number() OVER (PARTITION BY snapshot_id ORDER BY d DESC, src DESC, dst DESC) AS rk FROM ds) WHERE d > p OR (anyk = 0 AND rk = 1)"""
DROP_UNIFORM = f"ds AS (SELECT *, {draw('snapshot_id', 'src', 'dst', '1')} AS d, 0.2 AS p FROM edges)"
NORM_DEG = """nd AS (SELECT snapshot_id, node, CASE WHEN max(degree) OVER w = min(degree) OVER w THEN 0 ELSE
  (degree - min(degree) OVER w)::DOUBLE / (max(degree) OVER w - min(degree) OVER w) END AS dn FROM deg WINDOW w AS (PARTITION BY snapshot_id))"""
DROP_DEGREE = f"""ds AS (SELECT e.*, {draw('e.snapshot_id', 'e.src', 'e.dst', '1')} AS d, least(greatest(0.4 * 0.5 * (a.dn + b.dn), 0), 1) AS p
  FROM edges e JOIN nd a ON a.snapshot_id = e.snapshot_id AND a.node = e.src JOIN nd b ON b.snapshot_id = e.snapshot_id AND b.node = e.dst)"""


@query("au1_drop_edges", v.with_ctes(v.GRAPH, DROP_UNIFORM, KEEP))
def au1_drop_edges(spark, sf):
    return augment.drop_edges(v.edges(spark, sf), 0.2, 1).select("snapshot_id", "src", "dst", "actions_str")


@query(
    "au2_mask_features",
    v.with_ctes(
        v.GRAPH,
        g.NV,
        f"m AS (SELECT snapshot_id, name, i, CASE WHEN {draw('snapshot_id', 'name', 'i', '2')} < 0.2 THEN 0 ELSE x END AS x FROM nv)",
        f"SELECT snapshot_id, name, {fe.DIGEST} FROM m GROUP BY 1, 2",
    ),
)
def au2_mask_features(spark, sf):
    out = augment.mask_features(g.node_vectors(spark, sf), "vec", KEY, 0.2, 2)
    return g.vec_digest(out, KEY)


@query("au3_drop_by_degree", v.with_ctes(v.GRAPH, g.DEG, NORM_DEG, DROP_DEGREE, KEEP))
def au3_drop_by_degree(spark, sf):
    return augment.drop_edges_by_degree(v.edges(spark, sf), 0.4, 1).select("snapshot_id", "src", "dst", "actions_str")


@query(
    "au4_mask_by_degree",
    v.with_ctes(
        v.GRAPH,
        g.DEG,
        NORM_DEG,
        DROP_DEGREE,
        f"kept AS ({KEEP})",
        g.NV,
        """kd AS (SELECT snapshot_id, node, count(*) AS degree FROM (SELECT snapshot_id, src AS node FROM kept
             UNION ALL SELECT snapshot_id, dst FROM kept) GROUP BY 1, 2),
           sd AS (SELECT k.snapshot_id, k.name, coalesce(d.degree, 0) AS degree FROM (SELECT DISTINCT snapshot_id, name FROM nv) k
             LEFT JOIN kd d ON d.snapshot_id = k.snapshot_id AND d.node = k.name),
           pn AS (SELECT snapshot_id, name, 0.3 * (1 - CASE WHEN max(degree) OVER w = min(degree) OVER w THEN 0 ELSE
             (degree - min(degree) OVER w)::DOUBLE / (max(degree) OVER w - min(degree) OVER w) END) AS p FROM sd
             WINDOW w AS (PARTITION BY snapshot_id))""",
        f"""m AS (SELECT nv.snapshot_id, nv.name, i, CASE WHEN {draw('nv.snapshot_id', 'nv.name', 'i', '2')} < p THEN 0 ELSE x END AS x
              FROM nv JOIN pn ON pn.snapshot_id = nv.snapshot_id AND pn.name = nv.name)""",
        f"SELECT snapshot_id, name, {fe.DIGEST} FROM m GROUP BY 1, 2",
    ),
)
def au4_mask_by_degree(spark, sf):
    kept = augment.drop_edges_by_degree(v.edges(spark, sf), 0.4, 1)
    return g.vec_digest(augment.mask_features_by_degree(g.node_vectors(spark, sf), kept, 0.3, 2), KEY)


def sides(spark, sf):
    """(benign, attack) node vectors: attack snapshots hold a labelled node."""
    marks = v.nodes(spark, sf).groupBy("snapshot_id").agg(F.max("label").alias("_l"))
    vec = g.node_vectors(spark, sf).join(marks, "snapshot_id")
    return vec.filter("_l = 0").drop("_l"), vec.filter("_l = 1").drop("_l")


SIDE = """side AS (SELECT snapshot_id, max(label) AS l FROM nodes GROUP BY 1),
nk AS (SELECT n.snapshot_id, n.name, s.l FROM nodes n JOIN side s USING (snapshot_id) JOIN embeddings e ON e.vec_id =
  CASE WHEN n.name LIKE 'u%' THEN substring(n.name, 2)::BIGINT ELSE 300 + substring(n.name, 2)::BIGINT END)"""


@query(
    "au5_inject_features",
    v.with_ctes(
        v.GRAPH,
        SIDE,
        f"""atk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {H('snapshot_id', 'name', '3')}, name) AS pos,
              count(*) OVER (PARTITION BY snapshot_id) AS n FROM nk WHERE l = 1),
            pl AS (SELECT snapshot_id AS ps, name AS pn, row_number() OVER (ORDER BY {H('snapshot_id', 'name', '3')}, snapshot_id, name) - 1 AS idx
              FROM nk WHERE l = 0),
            pc AS (SELECT count(*) AS c FROM pl),
            pk AS (SELECT a.snapshot_id, a.name, CASE WHEN pos <= greatest(1, floor(n * 0.3)) THEN 1 ELSE 0 END AS replaced,
              {H('a.snapshot_id', 'a.name', '4')} % c AS idx FROM atk a, pc)""",
        g.NV,
        f"""d AS (SELECT k.snapshot_id, k.name, k.replaced, nv.i, nv.x FROM pk k JOIN nv ON k.replaced = 0 AND nv.snapshot_id = k.snapshot_id
              AND nv.name = k.name
              UNION ALL SELECT k.snapshot_id, k.name, k.replaced, nv.i, nv.x FROM pk k JOIN pl ON k.replaced = 1 AND pl.idx = k.idx
                JOIN nv ON nv.snapshot_id = pl.ps AND nv.name = pl.pn)""",
        f"SELECT snapshot_id, name, replaced, {fe.DIGEST} FROM d GROUP BY 1, 2, 3",
    ),
)
def au5_inject_features(spark, sf):
    benign, attack = sides(spark, sf)
    return g.vec_digest(augment.inject_features(attack, benign, 0.3, 3), [*KEY, "replaced"])


@query(
    "au5_inject_edges",
    v.with_ctes(
        v.GRAPH,
        f"""ni AS (SELECT snapshot_id, name, row_number() OVER (PARTITION BY snapshot_id ORDER BY name) AS i, count(*) OVER (PARTITION BY snapshot_id)
              AS n FROM nodes),
            wk AS (SELECT e.snapshot_id, greatest(1, floor(count(*) * 0.2))::BIGINT AS k FROM edges e GROUP BY 1),
            dr AS (SELECT w.snapshot_id, unnest(range(1, k + 1)) AS draw, n FROM wk w JOIN (SELECT DISTINCT snapshot_id, n FROM ni) x USING (snapshot_id)),
            pk AS (SELECT *, {H('snapshot_id', 'draw', '7')} % n + 1 AS s, {H('snapshot_id', 'draw', '8')} % n + 1 AS d FROM dr),
            mk AS (SELECT p.snapshot_id, p.draw, a.name AS src, b.name AS dst FROM pk p JOIN ni a ON a.snapshot_id = p.snapshot_id AND a.i = p.s
              JOIN ni b ON b.snapshot_id = p.snapshot_id AND b.i = p.d)""",
        """SELECT snapshot_id, draw::INT AS draw, src, dst FROM mk UNION ALL SELECT snapshot_id, draw::INT, dst, src FROM mk""",
    ),
)
def au5_inject_edges(spark, sf):
    return augment.inject_edges(v.nodes(spark, sf), v.edges(spark, sf), 0.2, 7)


@query(
    "au6_corrupt_tokens",
    v.with_ctes(
        v.GRAPH,
        g.NV,
        fe.WORDS,
        f"""pool AS (SELECT origin, prop, row_number() OVER (ORDER BY {H('origin', '5')}, origin) - 1 AS idx, count(*) OVER () AS c FROM (
              SELECT snapshot_id || '/' || name AS origin, prop FROM nodes WHERE label = 1)),
            hit AS (SELECT snapshot_id, name FROM (SELECT DISTINCT snapshot_id, name FROM nv) WHERE {draw('snapshot_id', 'name', '5')} < 0.3),
            dr AS (SELECT snapshot_id, name, unnest(range(1, 3)) AS j FROM hit),
            pk AS (SELECT d.snapshot_id, d.name, p.prop FROM dr d JOIN pool p ON p.idx = {H('d.snapshot_id', 'd.name', 'd.j', '6')} % p.c),
            tk AS (SELECT snapshot_id, name, unnest({fe.TOK}) AS token FROM pk),
            mn AS (SELECT snapshot_id, name, i, avg(x) AS x FROM tk JOIN wv USING (token) GROUP BY 1, 2, 3),
            un AS (SELECT snapshot_id, name, i, x / (sqrt(sum(x * x) OVER (PARTITION BY snapshot_id, name)) + 1e-12) AS x FROM mn),
            al AS (SELECT v.snapshot_id, v.name, v.i, CASE WHEN h.name IS NULL THEN v.x ELSE coalesce(u.x, 0) END AS x,
                CASE WHEN h.name IS NULL THEN 0 ELSE 1 END AS corrupted
              FROM nv v LEFT JOIN hit h ON h.snapshot_id = v.snapshot_id AND h.name = v.name
              LEFT JOIN un u ON u.snapshot_id = v.snapshot_id AND u.name = v.name AND u.i = v.i)""",
        f"SELECT snapshot_id, name, corrupted, {fe.DIGEST} FROM al GROUP BY 1, 2, 3",
    ),
)
def au6_corrupt_tokens(spark, sf):
    marked = v.nodes(spark, sf).filter("label = 1")
    pool = marked.select(F.concat_ws("/", "snapshot_id", "name").alias("origin"), T.property_tokens(F.col("prop")).alias("tokens"))
    out = augment.corrupt_with_tokens(g.node_vectors(spark, sf), pool, fe.words(spark, sf), v.DIM, 0.3, 2, 5)
    return g.vec_digest(out, [*KEY, "corrupted"])


FUSED = f"""{g.ego_sql(g.CAP)}, {g.EGO_EDGES},
en AS (SELECT e.snapshot_id || '/' || e.center AS ego_id, e.node, e.snapshot_id, e.center,
    row_number() OVER (PARTITION BY e.snapshot_id, e.center ORDER BY hop, node) - 1 AS pos, max(n.label) OVER (PARTITION BY e.snapshot_id, e.center) AS l
  FROM ego e JOIN nodes n ON n.snapshot_id = e.snapshot_id AND n.name = e.node),
ee AS (SELECT a.ego_id, a.l, a.pos AS src_pos, b.pos AS dst_pos FROM ego_e x JOIN en a ON a.snapshot_id = x.snapshot_id AND a.center = x.center
  AND a.node = x.src JOIN en b ON b.snapshot_id = x.snapshot_id AND b.center = x.center AND b.node = x.dst),
bn AS (SELECT ego_id, count(*) AS n_benign FROM en WHERE l = 0 GROUP BY 1),
bp AS (SELECT ego_id AS benign_id, n_benign, row_number() OVER (ORDER BY {H('ego_id', '9')}, ego_id) - 1 AS idx, count(*) OVER () AS c FROM bn),
an AS (SELECT ego_id, count(*) AS n_attack FROM en WHERE l = 1 GROUP BY 1),
pln AS (SELECT a.ego_id, a.n_attack, b.benign_id, b.n_benign, least(greatest(1, round_even(b.n_benign * 0.5, 0)::BIGINT), b.n_benign) AS k
  FROM an a JOIN bp b ON b.idx = {H('a.ego_id', '10')} % b.c),
pl2 AS (SELECT *, greatest(1, least(least(k, n_attack), 8, round_even(least(k, n_attack) * 0.2, 0)::BIGINT)) AS n_cross FROM pln)"""


def _ego_tables(spark, sf):
    from pyspark.sql import Window as W

    egos = cut(g.egos(spark, sf))
    labels = graph.ego_labels(egos, v.nodes(spark, sf))
    order = W.partitionBy("snapshot_id", "center").orderBy("hop", "node")  # at most CAP rows per ego
    pos = egos.withColumn("pos", (F.row_number().over(order) - 1).cast("bigint")).withColumn("ego_id", F.concat_ws("/", "snapshot_id", "center"))
    pos = cut(pos.join(labels, ["snapshot_id", "center"]))
    inside = graph.ego_edges(v.edges(spark, sf), egos)
    a = pos.select("snapshot_id", "center", F.col("node").alias("src"), F.col("pos").alias("src_pos"), "ego_id", "label")
    b = pos.select("snapshot_id", "center", F.col("node").alias("dst"), F.col("pos").alias("dst_pos"))
    links = inside.join(a, ["snapshot_id", "center", "src"]).join(b, ["snapshot_id", "center", "dst"])
    return pos, cut(links.select("ego_id", "label", "src_pos", "dst_pos"))


@query(
    "au7_fused_negatives",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        FUSED,
        f"""nn AS (SELECT p.ego_id, 'benign' AS part, e.pos FROM pl2 p JOIN en e ON e.ego_id = p.benign_id AND e.pos < p.k
              UNION ALL SELECT p.ego_id, 'attack', e.pos + p.k FROM pl2 p JOIN en e ON e.ego_id = p.ego_id),
            cr AS (SELECT ego_id, unnest(range(1, n_cross + 1)) AS j, k, n_attack FROM pl2),
            cx AS (SELECT ego_id, {H('ego_id', 'j', '11')} % k AS p, {H('ego_id', 'j', '12')} % n_attack + k AS q FROM cr),
            ne AS (SELECT p.ego_id, 'benign' AS part, e.src_pos, e.dst_pos FROM pl2 p JOIN ee e ON e.ego_id = p.benign_id AND e.src_pos < p.k
                AND e.dst_pos < p.k
              UNION ALL SELECT p.ego_id, 'attack', e.src_pos + p.k, e.dst_pos + p.k FROM pl2 p JOIN ee e ON e.ego_id = p.ego_id
              UNION ALL SELECT ego_id, 'cross', p, q FROM cx UNION ALL SELECT ego_id, 'cross', q, p FROM cx)""",
        """SELECT ego_id, 'node' AS kind, part, count(*) AS n, sum(pos)::BIGINT AS a, 0::BIGINT AS b FROM nn GROUP BY 1, 2, 3
           UNION ALL SELECT ego_id, 'edge', part, count(*), sum(src_pos)::BIGINT, sum(dst_pos)::BIGINT FROM ne GROUP BY 1, 2, 3""",
    ),
)
def au7_fused_negatives(spark, sf):
    pos, links = _ego_tables(spark, sf)
    nodes, edges = augment.fused_negatives(
        pos.filter("label = 0").select("ego_id", "pos"), links.filter("label = 0"),
        pos.filter("label = 1").select("ego_id", "pos"), links.filter("label = 1"), 9,
    )
    n = nodes.groupBy("ego_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("pos").alias("a"), F.lit(0).cast("bigint").alias("b"))
    e = edges.groupBy("ego_id", "part").agg(F.count(F.lit(1)).alias("n"), F.sum("src_pos").alias("a"), F.sum("dst_pos").alias("b"))
    return n.withColumn("kind", F.lit("node")).unionByName(e.withColumn("kind", F.lit("edge")))


# ---- region replacement ------------------------------------------------------------------------
MAP = """sd AS (SELECT snapshot_id, max(label) AS l FROM nodes GROUP BY 1),
rn AS (SELECT n.snapshot_id, n.name, s.l, row_number() OVER (PARTITION BY n.snapshot_id ORDER BY n.name) AS i FROM nodes n JOIN sd s USING (snapshot_id)
  WHERE n.type = 'SUBJECT_PROCESS'),
pr AS (SELECT b.snapshot_id || '~' || a.snapshot_id AS pair_id, b.snapshot_id AS bs, a.snapshot_id AS "as" FROM sd b JOIN sd a
  ON a.snapshot_id = b.snapshot_id + 1 AND b.l = 0 AND a.l = 1),
mp AS (SELECT p.pair_id, x.name AS b_node, y.name AS a_node FROM pr p JOIN rn x ON x.snapshot_id = p.bs JOIN rn y ON y.snapshot_id = p."as"
  AND y.i = x.i WHERE x.i <= 5)"""


def _replacement(spark, sf):
    """Each clean snapshot before an attack snapshot takes its first five processes."""
    from auditloom.operators.ranking import top_per_group

    nodes, edges = cut(v.nodes(spark, sf)), cut(v.edges(spark, sf))
    marks = nodes.groupBy("snapshot_id").agg(F.max("label").alias("l"))
    pairs = marks.filter("l = 0").select(F.col("snapshot_id").alias("bs"), (F.col("snapshot_id") + 1).alias("as")).join(
        marks.filter("l = 1").select(F.col("snapshot_id").alias("as")), "as"
    )
    pairs = cut(pairs.withColumn("pair_id", F.concat_ws("~", "bs", "as")))
    procs = top_per_group(nodes.filter("type = 'SUBJECT_PROCESS'"), ["snapshot_id"], [F.col("name")], 5, "i")
    b = procs.select(F.col("snapshot_id").alias("bs"), "i", F.col("name").alias("b_node"))
    a = procs.select(F.col("snapshot_id").alias("as"), "i", F.col("name").alias("a_node"))
    mapping = pairs.join(b, "bs").join(a, ["as", "i"]).select("pair_id", "a_node", "b_node")
    facts = ["name", "type", "prop", "frequency", "label"]
    side = lambda t, s, cols: pairs.join(t.withColumnRenamed("snapshot_id", s), s).select("pair_id", *cols)
    links = ["src", "dst", "actions_str"]
    new_nodes = augment.replace_nodes(side(nodes, "bs", facts), side(nodes, "as", facts), mapping)
    new_edges = augment.replace_edges(side(edges, "bs", links), side(edges, "as", links), mapping)
    return pairs, new_nodes, new_edges


REPL_NODES = """rpn AS (SELECT p.pair_id, n.name, coalesce(t.type, n.type) AS type, coalesce(t.prop, n.prop) AS prop,
    coalesce(t.frequency, n.frequency) AS frequency, coalesce(t.label, n.label) AS label, CASE WHEN t.name IS NULL THEN 0 ELSE 1 END AS replaced
  FROM pr p JOIN nodes n ON n.snapshot_id = p.bs LEFT JOIN mp m ON m.pair_id = p.pair_id AND m.b_node = n.name
  LEFT JOIN nodes t ON t.snapshot_id = p."as" AND t.name = m.a_node)"""
REPL_EDGES = """rpe AS (SELECT p.pair_id, e.src, e.dst, e.actions_str FROM pr p JOIN edges e ON e.snapshot_id = p.bs
    LEFT JOIN mp x ON x.pair_id = p.pair_id AND x.b_node = e.src LEFT JOIN mp y ON y.pair_id = p.pair_id AND y.b_node = e.dst
    WHERE x.b_node IS NULL OR y.b_node IS NULL
  UNION ALL SELECT p.pair_id, x.b_node, y.b_node, e.actions_str FROM pr p JOIN edges e ON e.snapshot_id = p."as"
    JOIN mp x ON x.pair_id = p.pair_id AND x.a_node = e.src JOIN mp y ON y.pair_id = p.pair_id AND y.a_node = e.dst)"""


@query("au9_replaced_nodes", v.with_ctes(v.GRAPH, MAP, REPL_NODES, "SELECT pair_id, name, type, prop, frequency, label, replaced FROM rpn"))
def au9_replaced_nodes(spark, sf):
    return _replacement(spark, sf)[1]


@query("au9_replaced_edges", v.with_ctes(v.GRAPH, MAP, REPL_EDGES, "SELECT pair_id, src, dst, actions_str FROM rpe"))
def au9_replaced_edges(spark, sf):
    return _replacement(spark, sf)[2]


# ---- tags ---------------------------------------------------------------------------------------
CMD_SQL = """pp AS (SELECT DISTINCT prop, trim(split_part(prop, ',', 1)) AS cmd FROM nodes WHERE type = 'SUBJECT_PROCESS'),
pw AS (SELECT DISTINCT prop, unnest(string_split(cmd, ' ')) AS w, unnest(range(len(string_split(cmd, ' ')))) AS i FROM pp WHERE cmd <> ''),
kn AS (SELECT p.prop, max(CASE WHEN i = 0 AND c.item IS NOT NULL THEN 1 ELSE 0 END) AS ck,
  coalesce(min(CASE WHEN i > 0 THEN CASE WHEN c.item IS NULL THEN 0 ELSE 1 END END), 0) AS ak, max(CASE WHEN i = 0 THEN w END) AS c0,
  coalesce(string_agg(CASE WHEN i > 0 THEN w END, ' ' ORDER BY i), '') AS args
  FROM pw p LEFT JOIN corpus c ON c.item = p.w AND c.kind = CASE WHEN i = 0 THEN 'command' ELSE 'argument' END GROUP BY 1)"""


@query(
    "au12_strategy_tags",
    v.with_ctes(
        v.GRAPH,
        CORPUS,
        CMD_SQL,
        """SELECT n.snapshot_id, n.name, CASE WHEN n.type <> 'SUBJECT_PROCESS' THEN 'replacement' WHEN ck = 1 AND ak = 1 THEN 'rewriting'
             WHEN ck = 1 THEN 'replacement' ELSE 'extension' END AS strategy FROM nodes n LEFT JOIN kn k ON k.prop = n.prop
           WHERE n.snapshot_id >= 473808""",
    ),
)
def au12_strategy_tags(spark, sf):
    n = v.nodes(spark, sf)
    corpus = augment.benign_corpus(n.filter(F.col("snapshot_id") < v.SPLIT_HOUR))
    return augment.strategy_tags(n.filter(F.col("snapshot_id") >= v.SPLIT_HOUR), corpus).select("snapshot_id", "name", "strategy")


@query(
    "au13_novel_parts",
    v.with_ctes(
        v.GRAPH,
        CORPUS,
        CMD_SQL,
        """SELECT prop, CASE WHEN ck = 0 THEN c0 || CASE WHEN args <> '' THEN ' ' || args ELSE '' END WHEN ak = 0 AND args <> '' THEN args ELSE ''
             END AS novel, trim(CASE WHEN ck = 1 THEN c0 ELSE '' END || CASE WHEN ak = 1 AND args <> '' THEN ' ' || args ELSE '' END) AS known
           FROM kn""",
    ),
)
def au13_novel_parts(spark, sf):
    n = v.nodes(spark, sf)
    corpus = augment.benign_corpus(n.filter(F.col("snapshot_id") < v.SPLIT_HOUR))
    return augment.novel_parts(n, corpus).select("prop", "novel", "known")


def _oct(i: int) -> str:
    return f"({H('snapshot_id', 'name', '6', str(i))} % 191 + 10)::VARCHAR"


_ADDR = lambda s: " || '.' || ".join(_oct(s + i) for i in range(4))


@query(
    "au14_substitute_attributes",
    v.with_ctes(
        v.GRAPH,
        f"""nn AS (SELECT snapshot_id, name, type, prop, CASE WHEN frequency >= 2 THEN 1 ELSE 0 END AS label FROM nodes),
            fl AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY {H('f', '6')}, f) - 1 AS idx, count(*) OVER (PARTITION BY snapshot_id)
              AS c FROM (SELECT DISTINCT snapshot_id, prop AS f FROM nn WHERE type = 'FILE_OBJECT_BLOCK' AND label <> 1 AND prop <> '')),
            pk AS (SELECT n.*, f.f FROM nn n LEFT JOIN fl f ON f.snapshot_id = n.snapshot_id AND f.idx = {H('n.snapshot_id', 'n.name', '6')} % f.c)""",
        f"""SELECT snapshot_id, name, CASE WHEN label = 1 AND type = 'FILE_OBJECT_BLOCK' THEN coalesce(f, {v._sql_pick(
            ('/tmp/data.log', '/var/log/syslog', '/etc/hosts'), H('snapshot_id', 'name', '6') + ' % 3')})
          WHEN label = 1 AND type = 'NetFlowObject' THEN {_ADDR(1)} || ',' || {v._sql_pick(('1024', '2048', '4096', '8080'),
            H('snapshot_id', 'name', '6', '20') + ' % 4')} || ',' || {_ADDR(10)} || ',' || {v._sql_pick(
            ('80', '443', '8080', '22', '53', '8443'), H('snapshot_id', 'name', '6', '21') + ' % 6')} ELSE prop END AS prop FROM pk""",
    ),
)
def au14_substitute_attributes(spark, sf):
    n = v.nodes(spark, sf).withColumn("label", (F.col("frequency") >= 2).cast("int"))
    return augment.substitute_attributes(n, 6).select("snapshot_id", "name", "prop")


# ---- verification ----------------------------------------------------------------------------------
@query(
    "au15_verification",
    v.with_ctes(
        v.GRAPH,
        g.WL,
        g.HIST,
        g.NORMS,
        """bd AS (SELECT DISTINCT e.snapshot_id FROM edges e JOIN nodes a ON a.snapshot_id = e.snapshot_id AND a.name = e.src
             JOIN nodes b ON b.snapshot_id = e.snapshot_id AND b.name = e.dst WHERE (a.label = 1 OR b.label = 1)
             AND contains(e.actions_str, 'EVENT_OPEN') AND contains(lower(a.type), 'process')),
           sm AS (SELECT a.snapshot_id, coalesce(d.dot, 0) / (a.n * b.n) AS sim FROM nrm a JOIN nrm b ON b.snapshot_id = a.snapshot_id + 1
             LEFT JOIN (SELECT x.snapshot_id, sum(x.cnt * y.cnt) AS dot FROM hist x JOIN hist y ON y.snapshot_id = x.snapshot_id + 1
               AND x.iter = y.iter AND x.label = y.label GROUP BY 1) d ON d.snapshot_id = a.snapshot_id)""",
        """SELECT n.snapshot_id, concat_ws(',', CASE WHEN b.snapshot_id IS NOT NULL THEN 'imperceptibility' END,
             CASE WHEN s.sim IS NULL OR s.sim < 0.3 OR s.sim > 0.95 THEN 'hardness' END) AS failed,
             CASE WHEN b.snapshot_id IS NULL AND s.sim BETWEEN 0.3 AND 0.95 THEN 1 ELSE 0 END AS passed
           FROM nrm n LEFT JOIN bd b ON b.snapshot_id = n.snapshot_id LEFT JOIN sm s ON s.snapshot_id = n.snapshot_id""",
    ),
)
def au15_verification(spark, sf):
    """Opening a file counts as a noticeable operation here, labelled nodes as replaced; the anchor is the next hour."""
    nodes = v.nodes(spark, sf).withColumn("replaced", F.col("label"))
    edges = v.edges(spark, sf).withColumn("actions_str", F.replace("actions_str", F.lit("EVENT_OPEN"), F.lit("notify")))
    bad = augment.noticeable(nodes, edges, ["snapshot_id"])
    sims = _next_hour_sim(spark, sf)
    candidates = nodes.select("snapshot_id").distinct()
    return augment.verified(candidates, bad, sims, ["snapshot_id"]).select("snapshot_id", "failed", "passed")


def _next_hour_sim(spark, sf):
    vec = wl.as_vectors(g.wl_hist(spark, sf), F.col("snapshot_id"))
    ids = vec.select(F.col("id").alias("a")).distinct()
    pairs = ids.join(ids.select((F.col("a") - 1).alias("a"), F.col("a").alias("b")), "a")
    return wl.wl_kernel(vec, vec, pairs).select(F.col("a").alias("snapshot_id"), "sim")


def _like(col: str, words) -> str:
    return " OR ".join(f"contains({col}, '{w}')" for w in words)


@query(
    "au16_quality_report",
    v.with_ctes(
        v.GRAPH,
        r"""orig AS (SELECT DISTINCT prop FROM nodes WHERE label = 1 AND snapshot_id < 473808),
            mut AS (SELECT snapshot_id, CASE snapshot_id % 4 WHEN 0 THEN prop WHEN 1 THEN prop || ' (deleted)' WHEN 2 THEN 'strategy=' || prop
              ELSE '/tmp/memtrace' END AS prop FROM nodes WHERE type = 'SUBJECT_PROCESS' AND frequency >= 1)""",
        rf"""SELECT m.snapshot_id, count(*) AS n, count(o.prop) AS unchanged,
              count(*) FILTER (WHERE len(string_split(m.prop, ',')) >= 3 AND regexp_matches(m.prop, ',\s*\d+\s*(,|$)')) AS format_ok,
              count(*) FILTER (WHERE {_like('m.prop', V.LEAKED_KEYS)}) AS leaks,
              count(*) FILTER (WHERE {_like('m.prop', V.ATTACK_KEYWORDS)}) AS keyword_kept,
              count(*) FILTER (WHERE {_like('m.prop', V.ATTACK_PATTERNS)}) AS pattern_kept
            FROM mut m LEFT JOIN orig o ON o.prop = m.prop GROUP BY 1""",
    ),
)
def au16_quality_report(spark, sf):
    n = v.nodes(spark, sf)
    kind = F.col("snapshot_id") % 4
    changed = (
        F.when(kind == 0, F.col("prop"))
        .when(kind == 1, F.concat("prop", F.lit(" (deleted)")))
        .when(kind == 2, F.concat(F.lit("strategy="), "prop"))
        .otherwise("/tmp/memtrace")
    )
    originals = n.filter((F.col("label") == 1) & (F.col("snapshot_id") < v.SPLIT_HOUR))
    mutants = n.withColumn("prop", changed).withColumn("label", F.lit(1))
    return augment.quality_report(mutants, originals, ["snapshot_id"])


@query("au17_strategy_presets")
def au17_strategy_presets(spark, sf):
    """Edges and non-zero components left by each strategy on all attack snapshots."""
    benign, attack = [cut(t) for t in sides(spark, sf)]
    marks = attack.select("snapshot_id").distinct()
    edges = cut(v.edges(spark, sf).join(marks, "snapshot_id", "left_semi"))
    rows = []
    for strategy in augment.PRESETS:
        vec, kept = augment.apply_preset(strategy, attack, edges, benign, 13)
        n_edges = kept.groupBy().agg(F.count(F.lit(1)).alias("n_edges")).scalar()
        left = F.size(F.filter("vec", lambda x: x != 0))
        rows.append(vec.groupBy().agg(F.count(F.lit(1)).alias("n_nodes"), F.sum(left).alias("n_values")).select(
            F.lit(strategy).alias("strategy"), "n_nodes", "n_values", n_edges.alias("n_edges")
        ))
    return augment.presets(spark).join(reduce(lambda a, b: a.unionByName(b), rows), "strategy")


EGO_LAB = """el AS (SELECT e.snapshot_id, e.center, max(n.label) AS l FROM ego e JOIN nodes n ON n.snapshot_id = e.snapshot_id AND n.name = e.node
  GROUP BY 1, 2)"""


@query(
    "au18_robustness_set",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        g.ego_sql(g.CAP),
        EGO_LAB,
        f"""bs AS (SELECT *, row_number() OVER (ORDER BY {H('snapshot_id', 'center', '3')}, snapshot_id, center) AS pos FROM el WHERE l = 0)""",
        """SELECT snapshot_id, center, 1 AS label FROM el WHERE l = 1
           UNION ALL SELECT snapshot_id, center, 0 FROM bs WHERE pos <= least((SELECT count(*) FROM el WHERE l = 1) * 2, 3000)""",
    ),
)
def au18_robustness_set(spark, sf):
    labels = cut(graph.ego_labels(g.egos(spark, sf), v.nodes(spark, sf)))
    return augment.robustness_set(labels.filter("label = 1"), labels.filter("label = 0"), ["snapshot_id", "center"], 3, ratio=2)


@query(
    "au19_pool_sample",
    v.with_ctes(
        v.GRAPH,
        f"""pl AS (SELECT snapshot_id, name, row_number() OVER (ORDER BY {H('snapshot_id', 'name', '2')}, snapshot_id, name) - 1 AS idx,
              count(*) OVER () AS c FROM nodes WHERE label = 1)""",
        "SELECT p.snapshot_id, p.name, d.draw FROM (SELECT unnest(range(300)) AS draw) d JOIN pl p ON p.idx = d.draw % p.c",
    ),
)
def au19_pool_sample(spark, sf):
    pool = v.nodes(spark, sf).filter("label = 1").select(*KEY)
    return augment.pool_sample(pool, KEY, 300, 2)


@query(
    "snk4_case_export",
    v.with_ctes(
        v.GRAPH,
        g.ADJ,
        g.ego_sql(16, "SELECT snapshot_id, name AS center FROM nodes WHERE label = 1"),
        g.EGO_EDGES,
        """SELECT n.snapshot_id, n.center, n.n_nodes, coalesce(e.n_edges, 0) AS n_edges FROM (
             SELECT snapshot_id, center, count(*) AS n_nodes FROM ego GROUP BY 1, 2) n LEFT JOIN (
             SELECT snapshot_id, center, count(*) AS n_edges FROM ego_e GROUP BY 1, 2) e USING (snapshot_id, center)""",
    ),
)
def snk4_case_export(spark, sf):
    """Cases with their ego nodes and edges nested, written and read back."""
    from auditloom.session import scratch_path
    from auditloom.sources import sinks

    nodes = v.nodes(spark, sf)
    centers = nodes.filter("label = 1").select("snapshot_id", F.col("name").alias("center"))
    egos = graph.ego(v.edges(spark, sf), centers, 2, 16)
    facts = egos.join(nodes.select("snapshot_id", F.col("name").alias("node"), "type", "prop"), ["snapshot_id", "node"])
    rows = sinks.case_rows(centers, facts, graph.ego_edges(v.edges(spark, sf), egos))
    path = scratch_path(spark, "cases")
    sinks.write_cases(rows, path)
    schema = f"snapshot_id bigint, center string, nodes {rows.schema['nodes'].dataType.simpleString()}, edges {rows.schema['edges'].dataType.simpleString()}"
    back = spark.read.schema(schema).json(path)
    return back.select("snapshot_id", "center", F.size("nodes").alias("n_nodes"), F.coalesce(F.size("edges"), F.lit(0)).alias("n_edges"))
