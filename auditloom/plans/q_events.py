"""Projections, joins, aggregations and set operations on events, nodes and edges."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions import text as T
from auditloom.operators import events as ev_ops
from auditloom.operators import metrics, ranking, snapshots
from auditloom.plans import views as v
from auditloom.plans.registry import query


@query(
    "prj2_resolved_properties",
    v.with_ctes(v.GRAPH, "SELECT snapshot_id, name, prop FROM node_props"),
)
def prj2_resolved_properties(spark, sf):
    return snapshots.node_properties(v.hourly(spark, sf), v.entities(spark, sf))


@query(
    "prj3_merge_entities",
    """SELECT uuid, kind, arg_min(props, source_file) AS props FROM (
         SELECT uuid, kind, source_file, max(props) AS props FROM (
           SELECT 'e' || (l_partkey % 500) AS uuid, l_returnflag AS kind, 'file' || l_linenumber AS source_file,
             l_shipdate::DATE::VARCHAR || '-' || l_suppkey AS props FROM lineitem)
         GROUP BY 1, 2, 3) GROUP BY 1, 2""",
)
def prj3_merge_entities(spark, sf):
    li = v.table(spark, sf, "lineitem")
    ents = li.select(
        F.concat(F.lit("e"), F.col("l_partkey") % 500).alias("uuid"),
        F.col("l_returnflag").alias("kind"),
        F.concat(F.lit("file"), "l_linenumber").alias("source_file"),
        F.concat(F.date_format("l_shipdate", "yyyy-MM-dd"), F.lit("-"), "l_suppkey").alias("props"),
        F.lit("").alias("record_key"),
    )
    return ev_ops.merge_entities(ents)


@query("prj4_label_exact", v.with_ctes(v.GRAPH, "SELECT snapshot_id, name, label FROM nodes"))
def prj4_label_exact(spark, sf):
    ends = snapshots.roles(v.hourly(spark, sf)).select("snapshot_id", "name").distinct()
    return ev_ops.label_exact(ends, v.labelled_entities(spark, sf)).select("snapshot_id", "name", "label")


SUBLABELS = """sub AS (SELECT DISTINCT 'f' || p_size AS t FROM part UNION SELECT DISTINCT '.' || s_nationkey || '.0.1' FROM supplier)"""


def _sub_labels(spark, sf):
    part, supplier = v.table(spark, sf, "part"), v.table(spark, sf, "supplier")
    a = part.select(F.concat(F.lit("f"), "p_size").alias("label_id"))
    b = supplier.select(F.concat(F.lit("."), "s_nationkey", F.lit(".0.1")).alias("label_id"))
    return a.union(b).distinct()


@query(
    "prj5_label_substring",
    v.with_ctes(
        v.ENT,
        SUBLABELS,
        """SELECT e.name, max(CASE WHEN s.t IS NULL THEN 0 ELSE 1 END) AS label
           FROM (SELECT DISTINCT props AS name FROM ent) e LEFT JOIN sub s ON contains(e.name, s.t) GROUP BY 1""",
    ),
)
def prj5_label_substring(spark, sf):
    names = v.entities(spark, sf).select(F.col("props").alias("name")).distinct()
    return ev_ops.label_substring(names, _sub_labels(spark, sf)).select("name", "label")


@query(
    "jn5_contains_join",
    v.with_ctes(
        v.ENT,
        SUBLABELS,
        """SELECT e.name, s.t AS label_id FROM (SELECT DISTINCT props AS name FROM ent) e JOIN sub s
           ON contains(e.name, s.t)""",
    ),
)
def jn5_contains_join(spark, sf):
    names = v.entities(spark, sf).select(F.col("props").alias("name"))
    return ev_ops.contains_join(names, "name", _sub_labels(spark, sf), "label_id")


BAD = "bad AS (SELECT DISTINCT 'k' || s_suppkey AS id FROM supplier WHERE s_acctbal < 2000)"


def _bad(spark, sf):
    s = v.table(spark, sf, "supplier").filter("s_acctbal < 2000")
    return s.select(F.concat(F.lit("k"), "s_suppkey").alias("label_id"))


@query(
    "prj6_drop_labelled_edges",
    v.with_ctes(
        v.EV,
        BAD,
        """SELECT event_id, actor_id, object_id FROM ev WHERE actor_id NOT IN (SELECT id FROM bad)
           AND object_id NOT IN (SELECT id FROM bad)""",
    ),
)
def prj6_drop_labelled_edges(spark, sf):
    return ev_ops.drop_labelled_edges(v.audit_events(spark, sf), _bad(spark, sf)).select("event_id", "actor_id", "object_id")


@query(
    "jn4_benign_pool",
    v.with_ctes(
        v.EV, v.LAB, "SELECT DISTINCT actor_id AS name FROM ev WHERE actor_id NOT IN (SELECT label_id FROM lab)"
    ),
)
def jn4_benign_pool(spark, sf):
    actors = v.audit_events(spark, sf).select(F.col("actor_id").alias("name")).distinct()
    marks = v.labelled_entities(spark, sf).select(F.col("label_id").alias("name"))
    return actors.join(marks, "name", "left_anti")


@query(
    "prj7_redact_events",
    v.with_ctes(
        v.GRAPH,
        r"""SELECT prop, regexp_replace(prop, '(^|[^A-Za-z0-9_])EVENT\S*', '\1REDACTED', 'g') AS redacted, count(*) AS n
            FROM node_props GROUP BY 1, 2""",
    ),
)
def prj7_redact_events(spark, sf):
    props = snapshots.node_properties(v.hourly(spark, sf), v.entities(spark, sf))
    return props.groupBy("prop", T.redact_events(F.col("prop")).alias("redacted")).agg(F.count(F.lit(1)).alias("n"))


CATEGORY_SQL = """CASE regexp_extract(actions_str, 'EVENT_(READ|WRITE|OPEN|FORK|SENDTO)', 1) WHEN 'FORK' THEN 0
  WHEN 'SENDTO' THEN 2 ELSE 1 END"""


@query(
    "prj8_edge_category",
    v.with_ctes(v.GRAPH, f"SELECT snapshot_id, src, dst, actions_str, {CATEGORY_SQL} AS category FROM edges"),
)
def prj8_edge_category(spark, sf):
    e = v.edges(spark, sf)
    return e.select("snapshot_id", "src", "dst", "actions_str", T.edge_category(F.col("actions")).alias("category"))


@query(
    "prj9_undirected_edges",
    v.with_ctes(
        v.GRAPH, "SELECT snapshot_id, src, dst FROM edges UNION ALL SELECT snapshot_id, dst, src FROM edges"
    ),
)
def prj9_undirected_edges(spark, sf):
    from auditloom.operators.graph import doubled

    return doubled(v.edges(spark, sf)).select("snapshot_id", F.col("node").alias("src"), F.col("nbr").alias("dst"))


@query(
    "prj10_text_triples",
    v.with_ctes(
        v.GRAPH,
        """SELECT e.snapshot_id, a.prop AS head, e.actions_str AS relation, b.prop AS tail FROM edges e
           JOIN nodes a ON e.snapshot_id = a.snapshot_id AND e.src = a.name
           JOIN nodes b ON e.snapshot_id = b.snapshot_id AND e.dst = b.name""",
    ),
)
def prj10_text_triples(spark, sf):
    from auditloom.operators.features import text_triples

    return text_triples(v.nodes(spark, sf), v.edges(spark, sf)).select("snapshot_id", "head", "relation", "tail")


@query("prj11_first_property", v.with_ctes(v.GRAPH, "SELECT snapshot_id, name, prop FROM nodes"))
def prj11_first_property(spark, sf):
    return v.nodes(spark, sf).select("snapshot_id", "name", F.col("properties")[0].alias("prop"))


@query(
    "prj12_property_fields",
    v.with_ctes(
        v.ENT,
        """SELECT uuid, kind, trim(split_part(props, ',', 1)) AS f1, trim(split_part(props, ',', 2)) AS f2,
             trim(split_part(props, ',', 3)) AS f3, CASE WHEN kind = 'net' THEN trim(split_part(props, ',', 4)) ELSE '' END AS f4
           FROM ent WHERE kind <> 'file'""",
    ),
)
def prj12_property_fields(spark, sf):
    e = v.entities(spark, sf).filter(F.col("kind") != "file")
    p, n = T.process_fields(F.col("props")), T.network_fields(F.col("props"))
    net = F.col("kind") == "net"
    cols = [F.when(net, n[i]).otherwise(p[i] if i < 3 else F.lit("")).alias(f"f{i + 1}") for i in range(4)]
    return e.select("uuid", "kind", *cols)


# ---- joins --------------------------------------------------------------------------------------
RAW = """raw AS (
  SELECT actor_id, object_id, action, ts_us, exec, path FROM ev WHERE event_id % 5 <> 0
  UNION ALL SELECT actor_id, object_id, action, ts_us, exec, path FROM ev WHERE event_id % 10 = 1
  UNION ALL SELECT actor_id, object_id || 'z', action, ts_us, exec, path FROM ev WHERE event_id % 2 = 0)"""


def _raw(spark, sf):
    e = v.audit_events(spark, sf)
    cols = ["actor_id", "object_id", "action", "ts_us", "exec", "path"]
    other = e.withColumn("object_id", F.concat("object_id", F.lit("z")))
    return (
        e.filter("event_id % 5 <> 0").select(*cols)
        .unionByName(e.filter("event_id % 10 = 1").select(*cols))
        .unionByName(other.filter("event_id % 2 = 0").select(*cols))
    )


@query(
    "jn1_event_join",
    v.with_ctes(
        v.EV,
        RAW,
        """SELECT DISTINCT e.actor_id, e.actor_type, e.object_id, e.object_type, e.action, e.ts_us, r.exec, r.path
           FROM ev e JOIN raw r ON e.actor_id = r.actor_id AND e.object_id = r.object_id AND e.action = r.action
           AND e.ts_us = r.ts_us""",
    ),
)
def jn1_event_join(spark, sf):
    e = v.audit_events(spark, sf).select("actor_id", "actor_type", "object_id", "object_type", "action", "ts_us")
    return ev_ops.join_raw_events(e, _raw(spark, sf))


@query(
    "jn2_known_events",
    v.with_ctes(
        v.EV,
        RAW,
        """SELECT action, count(*) AS n, min(ts_us) AS first_us FROM raw r WHERE EXISTS (SELECT 1 FROM ev e
             WHERE e.actor_id = r.actor_id AND e.object_id = r.object_id AND e.action = r.action AND e.ts_us = r.ts_us)
           GROUP BY 1""",
    ),
)
def jn2_known_events(spark, sf):
    kept = ev_ops.keep_known_events(_raw(spark, sf), v.audit_events(spark, sf))
    return kept.groupBy("action").agg(F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"))


@query(
    "jn3_dimension_lookup",
    v.with_ctes(
        v.EV,
        v.ENT,
        f"""SELECT e.event_id, {v.case_sql('e.action', V.EVENT_VERBS)} AS verb,
              {v.case_sql('e.object_type', V.TYPE_NOUNS, 'e.object_type')} AS noun, coalesce(b.props, '') AS props
            FROM ev e LEFT JOIN best_ent b ON e.object_id = b.name""",
    ),
)
def jn3_dimension_lookup(spark, sf):
    e = v.audit_events(spark, sf).withColumn("name", F.col("object_id"))
    best = ev_ops.preferred_entities(v.entities(spark, sf))
    joined = ranking.salted_join(e, best, ["name"], "left")
    return joined.select(
        "event_id", T.event_verb(F.col("action")).alias("verb"), T.type_noun(F.col("object_type")).alias("noun"),
        F.coalesce("props", F.lit("")).alias("props"),
    )


# ---- aggregations -------------------------------------------------------------------------------
@query(
    "ag1_node_aggregate",
    v.with_ctes(v.GRAPH, "SELECT snapshot_id, name, type, frequency, last_ts, properties, label FROM nodes"),
)
def ag1_node_aggregate(spark, sf):
    n = v.nodes(spark, sf)
    return n.select(
        "snapshot_id", "name", "type", "frequency", "last_ts", F.array_join("properties", "|").alias("properties"), "label"
    )


@query("ag2_edge_aggregate", v.with_ctes(v.GRAPH, "SELECT snapshot_id, src, dst, actions_str, last_ts FROM edges"))
def ag2_edge_aggregate(spark, sf):
    return v.edges(spark, sf).drop("actions")


CHUNKS = """chunks AS (SELECT * EXCLUDE (snapshot_id), (row_number() OVER (PARTITION BY object_type ORDER BY ts_us, event_id) - 1)
  // 100 AS snapshot_id FROM ev)"""


def _chunks(spark, sf):
    return snapshots.count_chunks(v.audit_events(spark, sf), 100, ["object_type"])


@query(
    "ag3_multigraph_nodes",
    v.with_ctes(
        v.EV,
        """chunks AS (SELECT event_id, ts_us, actor_id, actor_type, object_id, object_type,
             (row_number() OVER (ORDER BY ts_us, event_id) - 1) // 100 AS snapshot_id FROM ev)""",
        """ends AS (SELECT snapshot_id, actor_id AS name, actor_type AS type, ts_us * 2 AS k FROM chunks
             UNION ALL SELECT snapshot_id, object_id, object_type, ts_us * 2 + 1 FROM chunks)""",
        "SELECT snapshot_id, name, count(*) AS frequency, arg_min(type, k) AS type FROM ends GROUP BY 1, 2",
    ),
)
def ag3_multigraph_nodes(spark, sf):
    return snapshots.multigraph_nodes(snapshots.count_chunks(v.audit_events(spark, sf), 100))


@query(
    "ag4_new_edges",
    v.with_ctes(v.EV, "SELECT DISTINCT snapshot_id, actor_id AS src, object_id AS dst, action FROM ev"),
)
def ag4_new_edges(spark, sf):
    return snapshots.new_edges(v.hourly(spark, sf))


@query(
    "ag5_first_actions",
    v.with_ctes(
        v.EV,
        """SELECT snapshot_id, actor_id AS src, object_id AS dst, arg_min(action, ts_us) AS action, min(ts_us) AS first_ts
           FROM ev GROUP BY 1, 2, 3""",
    ),
)
def ag5_first_actions(spark, sf):
    return snapshots.first_actions(v.hourly(spark, sf))


@query(
    "ag7_type_distribution",
    v.with_ctes(
        v.GRAPH,
        "SELECT snapshot_id, type, count(*) AS n_nodes, sum(label)::BIGINT AS n_malicious FROM nodes GROUP BY 1, 2",
    ),
)
def ag7_type_distribution(spark, sf):
    return snapshots.type_distribution(v.nodes(spark, sf))


@query(
    "ag8_throughput",
    v.with_ctes(
        v.EV,
        """SELECT ts_us // 60000000 AS snapshot_id, count(*) AS n_edges, round(count(*) / 60.0, 6)::DOUBLE AS edges_per_second
           FROM ev GROUP BY 1""",
    ),
)
def ag8_throughput(spark, sf):
    out = snapshots.throughput(snapshots.tumbling(v.audit_events(spark, sf)))
    return out.withColumn("edges_per_second", F.round("edges_per_second", 6))


CORPUS = """procs AS (SELECT DISTINCT prop, trim(split_part(prop, ',', 1)) AS cmd FROM nodes
  WHERE type = 'SUBJECT_PROCESS' AND snapshot_id < 473808),
words AS (SELECT DISTINCT unnest(string_split(cmd, ' ')) AS w, unnest(range(len(string_split(cmd, ' ')))) AS i FROM procs),
corpus AS (
  SELECT DISTINCT 'command' AS kind, w AS item FROM words WHERE i = 0 AND w <> ''
  UNION SELECT DISTINCT 'argument', w FROM words WHERE i > 0 AND w <> ''
  UNION SELECT DISTINCT 'file', prop FROM nodes WHERE type LIKE '%FILE%' AND snapshot_id < 473808 AND prop <> '')"""


@query("ag9_benign_corpus", v.with_ctes(v.GRAPH, CORPUS, "SELECT kind, item FROM corpus"))
def ag9_benign_corpus(spark, sf):
    from auditloom.operators.augment import benign_corpus

    return benign_corpus(v.nodes(spark, sf).filter(F.col("snapshot_id") < v.SPLIT_HOUR))


@query(
    "ag10_profiles",
    v.with_ctes(
        v.GRAPH,
        """SELECT DISTINCT 'entity' AS kind, n.prop AS key, e.actions_str AS seen
           FROM edges e JOIN nodes n ON e.snapshot_id = n.snapshot_id AND e.src = n.name
           UNION ALL SELECT DISTINCT 'type', lower(type), prop FROM nodes""",
    ),
)
def ag10_profiles(spark, sf):
    from auditloom.operators.augment import profiles

    ops, attrs = profiles(v.nodes(spark, sf), v.edges(spark, sf))
    a = ops.select(F.lit("entity").alias("kind"), F.col("prop").alias("key"), F.col("operation").alias("seen"))
    return a.unionByName(attrs.select(F.lit("type").alias("kind"), F.col("type").alias("key"), F.col("prop").alias("seen")))


@query(
    "ag11_common_tokens",
    v.with_ctes(
        v.GRAPH,
        r"""SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all(prop, '[A-Za-z0-9_\-./:\\]+')) AS token
            FROM nodes WHERE label = 1) GROUP BY 1 ORDER BY n DESC, token LIMIT 10""",
    ),
)
def ag11_common_tokens(spark, sf):
    from auditloom.operators.features import common_tokens

    return common_tokens(v.nodes(spark, sf).filter("label = 1"), "prop", 10)


@query(
    "ag12_origin_share",
    v.with_ctes(
        v.GRAPH,
        """SELECT snapshot_id, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share
           FROM nodes WHERE label = 1 GROUP BY 1""",
    ),
)
def ag12_origin_share(spark, sf):
    from auditloom.operators.augment import origin_share

    return origin_share(v.nodes(spark, sf).filter("label = 1"), "snapshot_id").withColumn("share", F.round("share", 6))


# ---- evaluation roll-ups -------------------------------------------------------------------------
def doc_preds(spark, sf):
    """Truth and prediction from the document labels; strategy and data set from the document."""
    docs = v.table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    lab = v.table(spark, sf, "labels")
    return lab.join(docs, "doc_id").select(
        F.col("doc_id").alias("entity"), (F.col("doc_id") % 20).alias("snapshot_id"), F.col("lang").alias("strategy"),
        F.col("source").alias("dataset"), F.col("toxic").alias("y_true"), (1 - F.col("quality")).alias("y_pred"), "n_chars",
    )


DOC = """dp AS (SELECT l.doc_id AS entity, l.doc_id % 20 AS snapshot_id, d.lang AS strategy, d.source AS dataset,
  l.toxic AS y_true, 1 - l.quality AS y_pred, d.n_chars FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""
COUNTS = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp, count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp,
  count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn, count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn"""
RATIOS = """round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 6) AS fpr"""


@query(
    "ag14_any_positive",
    v.with_ctes(DOC, "SELECT snapshot_id, max(y_true) AS y_true, max(y_pred) AS y_pred FROM dp GROUP BY 1"),
)
def ag14_any_positive(spark, sf):
    return metrics.any_positive(doc_preds(spark, sf), ["snapshot_id"])


@query(
    "ag15_metrics_by_strategy",
    v.with_ctes(DOC, f"SELECT strategy, tp, fp, tn, fn, {RATIOS} FROM (SELECT strategy, {COUNTS} FROM dp GROUP BY 1)"),
)
def ag15_metrics_by_strategy(spark, sf):
    return metrics.evaluate(doc_preds(spark, sf), ["strategy"])


def details(spark, sf):
    """Status of every document under each method (the language), per scene (the source)."""
    p = doc_preds(spark, sf)
    status = F.when(F.col("n_chars") < 300, "unmapped").when(F.col("y_true") == F.col("y_pred"), "correct").otherwise("incorrect")
    return p.select("entity", F.col("strategy").alias("method"), F.col("dataset").alias("scene"), status.alias("status"))


DETAILS = """det AS (SELECT entity, strategy AS method, dataset AS scene, CASE WHEN n_chars < 300 THEN 'unmapped'
  WHEN y_true = y_pred THEN 'correct' ELSE 'incorrect' END AS status FROM dp)"""


@query(
    "ag16_status_shares",
    v.with_ctes(
        DOC,
        DETAILS,
        """SELECT method, scene, correct, incorrect, unmapped, total, round(100.0 * correct / total, 1)::DOUBLE AS correct_pct,
             round(100.0 * incorrect / total, 1)::DOUBLE AS incorrect_pct, round(100.0 * unmapped / total, 1)::DOUBLE AS unmapped_pct
           FROM (SELECT method, scene, count(*) FILTER (WHERE status = 'correct') AS correct,
             count(*) FILTER (WHERE status = 'incorrect') AS incorrect, count(*) FILTER (WHERE status = 'unmapped') AS unmapped,
             count(*) AS total FROM det GROUP BY ROLLUP (method, scene))""",
    ),
)
def ag16_status_shares(spark, sf):
    return metrics.status_shares(details(spark, sf), ["method", "scene"])


@query(
    "ag17_false_positives",
    v.with_ctes(
        v.GRAPH,
        """pr AS (SELECT snapshot_id, type, prop, label, CASE WHEN frequency >= 2 THEN 1 ELSE 0 END AS y_pred FROM nodes)""",
        """SELECT type, count(*) FILTER (WHERE y_pred = 1 AND label = 0) AS n_fp, count(*) FILTER (WHERE label = 0) AS n_benign,
             round(coalesce(count(*) FILTER (WHERE y_pred = 1 AND label = 0)::DOUBLE / nullif(count(*) FILTER (WHERE label = 0), 0), 0), 6)
               AS fp_rate FROM pr GROUP BY 1""",
    ),
)
def ag17_false_positives(spark, sf):
    n = v.nodes(spark, sf).withColumn("y_pred", (F.col("frequency") >= 2).cast("int"))
    fp, benign = F.count_if((F.col("y_pred") == 1) & (F.col("label") == 0)), F.count_if(F.col("label") == 0)
    rate = F.round(metrics.guarded(fp, benign), 6)
    return n.groupBy("type").agg(fp.alias("n_fp"), benign.alias("n_benign"), rate.alias("fp_rate"))


@query(
    "ag17_fp_heavy_snapshots",
    v.with_ctes(
        v.GRAPH,
        """SELECT snapshot_id, count(*) AS n_fp FROM nodes WHERE label = 0 AND frequency >= 2 GROUP BY 1
           ORDER BY n_fp DESC, snapshot_id LIMIT 10""",
    ),
)
def ag17_fp_heavy_snapshots(spark, sf):
    fp = v.nodes(spark, sf).filter("label = 0 AND frequency >= 2")
    return fp.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n_fp")).orderBy(F.desc("n_fp"), "snapshot_id").limit(10)


@query(
    "ag17_fp_common_properties",
    v.with_ctes(
        v.GRAPH,
        """SELECT substring(prop, 1, 30) AS prop, count(*) AS n_fp FROM nodes WHERE label = 0 AND frequency >= 2 GROUP BY 1
           ORDER BY n_fp DESC, 1 LIMIT 10""",
    ),
)
def ag17_fp_common_properties(spark, sf):
    fp = v.nodes(spark, sf).filter("label = 0 AND frequency >= 2")
    counts = fp.groupBy(F.substring("prop", 1, 30).alias("prop")).agg(F.count(F.lit(1)).alias("n_fp"))
    return counts.orderBy(F.desc("n_fp"), "prop").limit(10)


@query(
    "ag18_shared_descriptions",
    """SELECT md5(text) AS digest, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM documents
       GROUP BY text HAVING count(*) > 1""",
)
def ag18_shared_descriptions(spark, sf):
    """Groups are keyed by a digest, so long texts are not shuffled."""
    docs = v.table(spark, sf, "documents").select(F.md5("text").alias("digest"), "doc_id")
    return docs.groupBy("digest").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")
    ).filter("n > 1")


@query(
    "ag19_usage_rollup",
    """SELECT role, count(*) AS calls, count(DISTINCT conv_id) AS n_snapshots, sum(length(text))::BIGINT AS total_tokens,
         sum(turn)::BIGINT AS total_latency, round(sum(length(text))::DOUBLE / count(DISTINCT conv_id), 6) AS tokens_per_snapshot,
         round(sum(turn)::DOUBLE / count(DISTINCT conv_id), 6) AS latency_per_snapshot FROM conversations GROUP BY 1""",
)
def ag19_usage_rollup(spark, sf):
    calls = v.table(spark, sf, "conversations").select("role", "conv_id", F.length("text").alias("tokens"), F.col("turn").alias("latency"))
    out = metrics.usage_rollup(calls, ["role"], "conv_id")
    return out.withColumns({c: F.round(c, 6) for c in ("tokens_per_snapshot", "latency_per_snapshot")})


@query(
    "ag20_micro_average",
    v.with_ctes(
        DOC,
        f"""c AS (SELECT strategy, dataset, {COUNTS} FROM dp GROUP BY 1, 2)""",
        """s AS (SELECT strategy, sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(tn)::BIGINT AS tn, sum(fn)::BIGINT AS fn
             FROM c GROUP BY 1)""",
        f"SELECT strategy, tp, fp, tn, fn, {RATIOS} FROM s",
    ),
)
def ag20_micro_average(spark, sf):
    return metrics.micro_average(metrics.confusion(doc_preds(spark, sf), ["strategy", "dataset"]), ["strategy"])


@query(
    "ag25_metric_change",
    v.with_ctes(
        DOC,
        f"""m AS (SELECT strategy, half, tp, fp, tn, fn, {RATIOS} FROM (
             SELECT strategy, entity % 2 AS half, {COUNTS} FROM dp GROUP BY 1, 2))""",
        """SELECT a.strategy, a.recall AS recall_base, b.recall AS recall_other, round(a.recall - b.recall, 6) AS recall_drop
           FROM m a JOIN m b ON a.strategy = b.strategy AND a.half = 0 AND b.half = 1""",
    ),
)
def ag25_metric_change(spark, sf):
    p = doc_preds(spark, sf)
    return metrics.metric_change(p.filter("entity % 2 = 0"), p.filter("entity % 2 = 1"), ["strategy"])


# ---- sets ---------------------------------------------------------------------------------------
@query(
    "st1_concat_distinct",
    v.with_ctes(
        v.EV,
        """SELECT actor_id, object_id, action FROM ev WHERE snapshot_id < 473808
           UNION SELECT actor_id, object_id, action FROM ev WHERE snapshot_id >= 473600""",
    ),
)
def st1_concat_distinct(spark, sf):
    e = v.hourly(spark, sf)
    cols = ["actor_id", "object_id", "action"]
    return ev_ops.concat_distinct(
        e.filter(F.col("snapshot_id") < v.SPLIT_HOUR).select(*cols), e.filter("snapshot_id >= 473600").select(*cols)
    )


@query(
    "st5_method_differences",
    v.with_ctes(
        DOC,
        """det AS (SELECT entity, 'A' AS method, CASE WHEN y_true = y_pred THEN 'correct' ELSE 'incorrect' END AS status FROM dp
             UNION ALL SELECT entity, 'B', CASE WHEN n_chars > 800 THEN 'correct' ELSE 'incorrect' END FROM dp)""",
        """SELECT a.entity, CASE WHEN b.status = 'correct' THEN 'gain' ELSE 'loss' END AS change
           FROM det a JOIN det b ON a.entity = b.entity AND a.method = 'A' AND b.method = 'B' WHERE a.status <> b.status""",
    ),
)
def st5_method_differences(spark, sf):
    return metrics.method_differences(_two_methods(spark, sf), "A", "B")


def _two_methods(spark, sf):
    p = doc_preds(spark, sf)
    flag = lambda c: F.when(c, "correct").otherwise("incorrect").alias("status")
    a = p.select("entity", F.lit("A").alias("method"), flag(F.col("y_true") == F.col("y_pred")))
    return a.unionByName(p.select("entity", F.lit("B").alias("method"), flag(F.col("n_chars") > 800)))


@query(
    "st5_only_right",
    v.with_ctes(DOC, "SELECT entity FROM dp WHERE n_chars > 800 AND y_true <> y_pred"),
)
def st5_only_right(spark, sf):
    return metrics.only_right(_two_methods(spark, sf), "B")


@query(
    "st6_replicate",
    v.with_ctes(v.EV, "SELECT action, copy, count(*) AS n FROM ev, (SELECT unnest(range(3))::INT AS copy) GROUP BY 1, 2"),
)
def st6_replicate(spark, sf):
    factor = ev_ops.replication_factor("3KB", 1024)
    copies = ev_ops.replicate(v.audit_events(spark, sf), factor)
    return copies.groupBy("action", "copy").agg(F.count(F.lit(1)).alias("n"))
