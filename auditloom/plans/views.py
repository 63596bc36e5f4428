"""Views over the given tables in the shape the operators expect, in Spark and in SQL.

``events`` becomes audit events (users are processes, the JSON key is the object), ``part``,
``supplier`` and ``customer`` become entity records, ``embeddings`` become node or snapshot vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
SPLIT_HOUR = 473_352 + 19 * 24  # 2024-01-20 00:00 in hours since 1970: earlier is benign, later evaluation
LABELLED = ("u3", "u7")

ACTIONS = {
    "click": "EVENT_READ",
    "view": "EVENT_OPEN",
    "purchase": "EVENT_SENDTO",
    "signup": "EVENT_FORK",
    "error": "EVENT_WRITE",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def audit_events(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "events")
    key = F.get_json_object("props", "$.k")
    kind = F.col("event_type")
    action = F.coalesce(*[F.when(kind == k, F.lit(v)) for k, v in ACTIONS.items()])
    return raw.select(
        "event_id",
        F.concat(F.lit("u"), "user_id").alias("actor_id"),
        F.lit("SUBJECT_PROCESS").alias("actor_type"),
        F.concat(F.when(kind == "signup", "u").otherwise("k"), key).alias("object_id"),
        F.when(kind == "signup", "SUBJECT_PROCESS")
        .when(kind == "purchase", "NetFlowObject")
        .otherwise("FILE_OBJECT_BLOCK")
        .alias("object_type"),
        action.alias("action"),
        F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"),
        F.concat(F.lit("proc"), F.col("user_id") % 7).alias("exec"),
        F.when(F.col("event_id") % 3 == 0, "").otherwise(F.concat(F.lit("/data/"), key)).alias("path"),
        "value",
    )


EV = """ev AS (
  SELECT event_id, 'u' || user_id AS actor_id, 'SUBJECT_PROCESS' AS actor_type,
    (CASE WHEN event_type = 'signup' THEN 'u' ELSE 'k' END) || json_extract_string(props, '$.k') AS object_id,
    CASE event_type WHEN 'signup' THEN 'SUBJECT_PROCESS' WHEN 'purchase' THEN 'NetFlowObject'
      ELSE 'FILE_OBJECT_BLOCK' END AS object_type,
    CASE event_type WHEN 'click' THEN 'EVENT_READ' WHEN 'view' THEN 'EVENT_OPEN' WHEN 'purchase' THEN 'EVENT_SENDTO'
      WHEN 'signup' THEN 'EVENT_FORK' WHEN 'error' THEN 'EVENT_WRITE' END AS action,
    epoch_us(ts) AS ts_us, 'proc' || (user_id % 7) AS exec,
    CASE WHEN event_id % 3 = 0 THEN '' ELSE '/data/' || json_extract_string(props, '$.k') END AS path, value,
    epoch_us(ts) // 3600000000 AS snapshot_id
  FROM events)"""


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import tumbling

    return tumbling(audit_events(spark, sf), HOUR_US)


FILE_DIRS = ("/etc/", "/tmp/", "/usr/bin/", "/var/log/", "/home/u/", "/proc/", "/opt/")
FILE_SUFFIXES = (".so", ".conf", ".log", "", ".py", ".dat")
COMMANDS = {
    "AUTOMOBILE": "bash",
    "BUILDING": "python3",
    "FURNITURE": "sshd",
    "HOUSEHOLD": "rundll32",
    "MACHINERY": "nginx",
}


def _pick(values, index):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def entities(spark: SparkSession, sf: str) -> DataFrame:
    """``uuid, kind, props``: files from part, network flows from supplier, processes from customer."""
    part = table(spark, sf, "part")
    files = part.select(
        F.concat(F.lit("k"), "p_partkey").alias("uuid"),
        F.lit("file").alias("kind"),
        F.concat(
            _pick(FILE_DIRS, F.col("p_size") % 7), F.lit("f"), "p_partkey", _pick(FILE_SUFFIXES, F.col("p_partkey") % 6)
        ).alias("props"),
    )
    supplier = table(spark, sf, "supplier")
    port = _pick(("80", "443", "25", "22", "5432"), F.col("s_suppkey") % 5)
    flows = supplier.filter(F.col("s_acctbal") > 4000).select(
        F.concat(F.lit("k"), "s_suppkey").alias("uuid"),
        F.lit("net").alias("kind"),
        F.concat(
            F.lit("10."), "s_nationkey", F.lit(".0.1,"), F.col("s_suppkey") + 1024, F.lit(",172.16.0."),
            F.col("s_suppkey") % 250, F.lit(","), port,
        ).alias("props"),
    )
    customer = table(spark, sf, "customer")
    command = F.coalesce(*[F.when(F.col("c_mktsegment") == k, F.lit(v)) for k, v in COMMANDS.items()])
    path = F.concat(F.lit("/usr/bin/"), command)
    procs = customer.filter(F.col("c_acctbal") > 0).select(
        F.concat(F.lit("u"), "c_custkey").alias("uuid"),
        F.lit("subject").alias("kind"),
        F.concat(path, F.lit(" -n "), "c_nationkey", F.lit(","), "c_custkey", F.lit(","), path).alias("props"),
    )
    return files.unionByName(flows).unionByName(procs)


def _sql_pick(values, index: str) -> str:
    arms = " ".join(f"WHEN {i} THEN '{v}'" for i, v in enumerate(values))
    return f"(CASE {index} {arms} END)"


ENT = f"""ent AS (
  SELECT 'k' || p_partkey AS uuid, 'file' AS kind,
    {_sql_pick(FILE_DIRS, 'p_size % 7')} || 'f' || p_partkey || {_sql_pick(FILE_SUFFIXES, 'p_partkey % 6')} AS props
  FROM part
  UNION ALL SELECT 'k' || s_suppkey, 'net', '10.' || s_nationkey || '.0.1,' || (s_suppkey + 1024) || ',172.16.0.' ||
    (s_suppkey % 250) || ',' || {_sql_pick(('80', '443', '25', '22', '5432'), 's_suppkey % 5')}
  FROM supplier WHERE s_acctbal > 4000
  UNION ALL SELECT 'u' || c_custkey, 'subject', '/usr/bin/' || cmd || ' -n ' || c_nationkey || ',' || c_custkey ||
    ',/usr/bin/' || cmd
  FROM (SELECT *, CASE c_mktsegment {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in COMMANDS.items())} END AS cmd
        FROM customer) WHERE c_acctbal > 0),
best_ent AS (
  SELECT uuid AS name, arg_min(props, CASE kind WHEN 'net' THEN 0 WHEN 'file' THEN 1 ELSE 2 END) AS props
  FROM ent WHERE props <> '' GROUP BY uuid)"""


def labelled_entities(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled processes, found among the users of the events table."""
    users = table(spark, sf, "events").select(F.concat(F.lit("u"), "user_id").alias("label_id")).distinct()
    return users.filter(F.col("label_id").isin(*LABELLED))


LAB = "lab AS (SELECT DISTINCT 'u' || user_id AS label_id FROM events WHERE user_id IN (3, 7))"

ROLES = """roles AS (
  SELECT snapshot_id, event_id, ts_us, actor_id AS name, actor_type AS type, 0 AS role,
    trim(exec || ' ' || action || CASE WHEN path <> '' THEN ' ' || path ELSE '' END) AS fallback FROM ev
  UNION ALL SELECT snapshot_id, event_id, ts_us, object_id, object_type, 1,
    trim(exec || ' ' || action || CASE WHEN path <> '' THEN ' ' || path ELSE '' END) FROM ev)"""

NODES = """node_props AS (
  SELECT DISTINCT r.snapshot_id, r.name, coalesce(b.props, r.fallback) AS prop
  FROM (SELECT DISTINCT snapshot_id, name, fallback FROM roles) r LEFT JOIN best_ent b ON r.name = b.name),
nodes AS (
  SELECT r.snapshot_id, r.name, r.frequency, r.last_ts, r.type, p.properties, p.prop,
    CASE WHEN l.label_id IS NULL THEN 0 ELSE 1 END AS label
  FROM (SELECT snapshot_id, name, count(*) AS frequency, max(ts_us) AS last_ts,
          arg_min(type, ts_us * 2 + role) AS type FROM roles GROUP BY snapshot_id, name) r
  JOIN (SELECT snapshot_id, name, string_agg(prop, '|' ORDER BY prop) AS properties, min(prop) AS prop
        FROM node_props GROUP BY snapshot_id, name) p ON r.snapshot_id = p.snapshot_id AND r.name = p.name
  LEFT JOIN lab l ON r.name = l.label_id)"""

EDGES = """edges AS (
  SELECT snapshot_id, actor_id AS src, object_id AS dst, string_agg(DISTINCT action, ',' ORDER BY action) AS actions_str,
    max(ts_us) AS last_ts FROM ev GROUP BY snapshot_id, actor_id, object_id)"""

GRAPH = ",\n".join([EV, ENT, LAB, ROLES, NODES, EDGES])


def with_ctes(*parts: str) -> str:
    """'WITH a, b, c' + final select; the last part is the select."""
    return "WITH " + ",\n".join(parts[:-1]) + "\n" + parts[-1]


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import node_table

    return node_table(hourly(spark, sf), entities(spark, sf), labelled_entities(spark, sf))


def edges(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import edge_table

    return edge_table(hourly(spark, sf))


def vectors(spark: SparkSession, sf: str, groups: int = 50) -> DataFrame:
    """``vec_id, snapshot_id, label, is_attack, vec``; label 9 counts as attack."""
    emb = table(spark, sf, "embeddings")
    return emb.select(
        "vec_id",
        (F.col("vec_id") % groups).alias("snapshot_id"),
        "label",
        (F.col("label") == 9).cast("int").alias("is_attack"),
        F.col("embedding").cast("array<double>").alias("vec"),
    )


DIM = 64

VEC = """vec AS (
  SELECT vec_id, vec_id % 50 AS snapshot_id, label, CASE WHEN label = 9 THEN 1 ELSE 0 END AS is_attack,
    unnest(range(64)) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings)"""


def case_sql(expr: str, mapping: dict, default: str = "NULL") -> str:
    arms = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items())
    return f"(CASE {expr} {arms} ELSE {default} END)"


DAY_US = 24 * HOUR_US
DAY_GRAPH = GRAPH.replace("3600000000", str(DAY_US))


def daily(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import tumbling

    return tumbling(audit_events(spark, sf), DAY_US)


def daily_nodes(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import node_table

    return node_table(daily(spark, sf), entities(spark, sf), labelled_entities(spark, sf))


def daily_edges(spark: SparkSession, sf: str) -> DataFrame:
    from auditloom.operators.snapshots import edge_table

    return edge_table(daily(spark, sf))
