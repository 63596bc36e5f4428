"""Sources and sinks: the given tables are written in each source format, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import events as ev_ops
from auditloom.plans import views as v
from auditloom.plans.registry import query
from auditloom.session import scratch_path
from auditloom.sources import cdm, dot, edges as edge_src, optc, sinks, techniques

NS18 = "com.bbn.tc.schema.avro.cdm18."
NS20 = "com.bbn.tc.schema.avro.cdm20."


def _text_file(df, spark, name, column="value"):
    path = scratch_path(spark, name)
    df.select(F.col(column).alias("value")).write.text(path)
    return path


def _tsv(spark, sf):
    cols = [F.col(c).cast("string") for c in ("actor_id", "actor_type", "object_id", "object_type", "action")]
    ns = F.when(F.col("event_id") % 50 == 0, "bad").otherwise((F.col("ts_us") * 1000).cast("string"))
    line = F.concat_ws("\t", *cols, ns)
    short = F.when(F.col("event_id") % 40 == 1, F.concat_ws("\t", *cols)).otherwise(line)
    return _text_file(v.audit_events(spark, sf).select(short.alias("value")), spark, "tsv")


TSV_SQL = """SELECT actor_id, object_id, action, count(*) AS n,
  sum(CASE WHEN event_id % 50 = 0 THEN 0 ELSE ts_us // 1000000 END)::BIGINT AS sum_s,
  count(CASE WHEN event_id % 50 = 0 THEN NULL ELSE 1 END) AS n_timed
FROM ev WHERE event_id % 40 <> 1 GROUP BY 1, 2, 3"""


def _edge_summary(df):
    seconds = F.expr("coalesce(ts_us div 1000000, 0)")
    return df.groupBy("actor_id", "object_id", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum(seconds).alias("sum_s"), F.count("ts_us").alias("n_timed")
    )


@query("src1_edge_tsv", v.with_ctes(v.EV, TSV_SQL))
def src1_edge_tsv(spark, sf):
    return _edge_summary(edge_src.read_edge_tsv(spark, _tsv(spark, sf)))


@query(
    "prj1_time_normalise",
    v.with_ctes(
        v.EV,
        """SELECT ts_us // 60000000 AS minute, count(*) AS n FROM ev
           WHERE event_id % 50 <> 0 AND event_id % 40 <> 1 GROUP BY 1""",
    ),
)
def prj1_time_normalise(spark, sf):
    timed = edge_src.read_edge_tsv(spark, _tsv(spark, sf)).filter(F.col("ts_us").isNotNull())
    return timed.groupBy(F.expr("ts_us div 60000000").alias("minute")).agg(F.count(F.lit(1)).alias("n"))


def _cdm_events(spark, sf, ns):
    """Event records: clicks carry a second object, every third has no path, some lines are broken."""
    e = v.audit_events(spark, sf)
    q = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    uuid = lambda c: F.concat(F.lit('{"' + ns + 'UUID":"'), c, F.lit('"}'))
    second = F.when(F.col("action") == "EVENT_READ", uuid(F.concat(F.col("object_id"), F.lit("b")))).otherwise("null")
    path = F.when(F.col("path") == "", "null").otherwise(F.concat(F.lit('{"string":"'), F.col("path"), F.lit('"}')))
    props = F.when(F.col("event_id") % 11 == 0, "null").otherwise(
        F.concat(F.lit('{"map":{"cmdLine":"'), F.col("exec"), F.lit('"}}'))
    )
    line = F.concat(
        F.lit('{"datum":{"' + ns + 'Event":{"type":'), q(F.col("action")), F.lit(',"subject":'), uuid(F.col("actor_id")),
        F.lit(',"predicateObject":'), uuid(F.col("object_id")), F.lit(',"predicateObject2":'), second,
        F.lit(',"timestampNanos":'), (F.col("ts_us") * 1000).cast("string"), F.lit(',"properties":'), props,
        F.lit(',"predicateObjectPath":'), path, F.lit(',"predicateObject2Path":{"string":"/second"}}}}'),
    )
    broken = F.when(F.col("event_id") % 97 == 5, F.substring(line, 1, 60)).otherwise(line)
    return _text_file(e.select(broken.alias("value")), spark, "cdm")


CDM_SQL = """raw AS (
  SELECT event_id, actor_id, object_id, action, ts_us, CASE WHEN event_id % 11 = 0 THEN '' ELSE exec END AS exec, path
  FROM ev WHERE event_id % 97 <> 5
  UNION ALL SELECT event_id, actor_id, object_id || 'b', action, ts_us,
    CASE WHEN event_id % 11 = 0 THEN '' ELSE exec END, '/second' FROM ev
  WHERE event_id % 97 <> 5 AND action = 'EVENT_READ')"""
RAW_SUMMARY = """SELECT actor_id, object_id, action, exec, path, count(*) AS n, min(ts_us) AS first_us FROM raw
  GROUP BY 1, 2, 3, 4, 5"""


def _raw_summary(df):
    return df.groupBy("actor_id", "object_id", "action", "exec", "path").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us")
    )


@query("src2_cdm18_events", v.with_ctes(v.EV, CDM_SQL, RAW_SUMMARY))
def src2_cdm18_events(spark, sf):
    return _raw_summary(cdm.read_events(spark, _cdm_events(spark, sf, NS18), 18))


@query("src2_cdm20_events", v.with_ctes(v.EV, CDM_SQL, RAW_SUMMARY))
def src2_cdm20_events(spark, sf):
    return _raw_summary(cdm.read_events(spark, _cdm_events(spark, sf, NS20), 20))


def _cdm_entities(spark, sf, version):
    ns = NS18 if version == 18 else NS20
    e = v.entities(spark, sf)
    p = F.split("props", ",")
    head = lambda name: F.concat(F.lit('{"datum":{"' + ns + name + '":{"uuid":"'), F.col("uuid"), F.lit('",'))
    if version == 18:
        flow = F.concat(
            head("NetFlowObject"), F.lit('"localAddress":"'), p[0], F.lit('","localPort":'), p[1],
            F.lit(',"remoteAddress":"'), p[2], F.lit('","remotePort":'), p[3], F.lit("}}}"),
        )
        process = F.concat(
            head("Subject"), F.lit('"cmdLine":{"string":"'), p[0], F.lit('"},"properties":{"map":{"tgid":"'), p[1],
            F.lit('"'), F.when(p[1].cast("int") % 5 == 0, "").otherwise(F.concat(F.lit(',"path":"'), p[2], F.lit('"'))),
            F.lit("}}}}}"),
        )
        file = F.concat(
            head("FileObject"), F.lit('"baseObject":{"properties":{"map":{"filename":"'), F.col("props"), F.lit('"}}}}}}')
        )
    else:
        local = F.when(p[1].cast("int") % 2 == 0, "null").otherwise(F.concat(F.lit('{"string":"'), p[0], F.lit('"}')))
        flow = F.concat(
            head("NetFlowObject"), F.lit('"localAddress":'), local, F.lit(',"localPort":{"int":'), p[1],
            F.lit('},"remoteAddress":{"string":"'), p[2], F.lit('"},"remotePort":{"int":'), p[3], F.lit("}}}}"),
        )
        cmd = F.when(p[1].cast("int") % 5 == 0, "null").otherwise(F.concat(F.lit('{"string":"'), p[0], F.lit('"}')))
        process = F.concat(
            head("Subject"), F.lit('"cmdLine":'), cmd, F.lit(',"properties":{"map":{"path":"'), p[2], F.lit('"}}}}}')
        )
        file = F.concat(
            head("FileObject"), F.lit('"baseObject":{"properties":{"map":{"filename":"'), F.col("props"), F.lit('"}}}}}}')
        )
    line = F.when(F.col("kind") == "net", flow).when(F.col("kind") == "subject", process).otherwise(file)
    return _text_file(e.select(line.alias("value")), spark, "entities")


@query(
    "src3_cdm18_entities",
    v.with_ctes(
        v.ENT,
        """SELECT uuid, kind, CASE WHEN kind = 'subject' AND split_part(props, ',', 2)::INT % 5 = 0
             THEN split_part(props, ',', 1) || ',' || split_part(props, ',', 2) || ',null' ELSE props END AS props
           FROM ent""",
    ),
)
def src3_cdm18_entities(spark, sf):
    return cdm.read_entities18(spark, _cdm_entities(spark, sf, 18)).select("uuid", "kind", "props")


@query(
    "src4_cdm20_entities",
    v.with_ctes(
        v.ENT,
        """SELECT uuid, kind, CASE kind
             WHEN 'net' THEN CASE WHEN split_part(props, ',', 2)::INT % 2 = 0 THEN 'null'
                 ELSE '{"string":"' || split_part(props, ',', 1) || '"}' END || ',{"int":' || split_part(props, ',', 2)
                 || '},' || split_part(props, ',', 3) || ',' || split_part(props, ',', 4)
             WHEN 'subject' THEN CASE WHEN split_part(props, ',', 2)::INT % 5 = 0 THEN ''
                 ELSE split_part(props, ',', 1) END || ',{"path":"' || split_part(props, ',', 3) || '"}'
             ELSE '{"filename":"' || props || '"}' END AS props FROM ent""",
    ),
)
def src4_cdm20_entities(spark, sf):
    return cdm.read_entities20(spark, _cdm_entities(spark, sf, 20)).select("uuid", "kind", "props")


@query(
    "src5_optc_edges",
    v.with_ctes(
        v.EV,
        """SELECT actor_id, object_type, action, count(*) AS n, sum(ts_us // 1000000)::BIGINT AS sum_s
           FROM ev GROUP BY 1, 2, 3""",
    ),
)
def src5_optc_edges(spark, sf):
    e = v.audit_events(spark, sf)
    iso = F.date_format(F.timestamp_micros("ts_us"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    line = F.concat_ws(" ", "object_id", "object_type", "actor_id", "actor_type", "action", iso)
    header = "Destination_ID Destination_Type Source_ID Source_Type Edge_Type Timestamp"
    lines = e.select(line.alias("value")).unionByName(spark.range(1).select(F.lit(header).alias("value")))
    rows = edge_src.read_optc_edges(spark, _text_file(lines, spark, "optc"))
    return rows.groupBy("actor_id", "object_type", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.expr("ts_us div 1000000")).alias("sum_s")
    )


def _optc_records(spark, sf):
    """One object per line, some lines an array, some two objects glued together."""
    ents = v.entities(spark, sf)
    p = F.split("props", ",")
    name = F.when(F.col("kind") == "file", "FILE").when(F.col("kind") == "net", "FLOW").otherwise("Process")
    props = F.struct(
        F.when(F.col("kind") == "subject", p[0]).alias("command_line"),
        F.when(F.col("kind") == "subject", p[2]).alias("image_path"),
        F.when(F.col("kind") == "file", F.col("props")).alias("file_path"),
        F.when(F.col("kind") == "net", p[0]).alias("src_ip"), F.when(F.col("kind") == "net", p[1]).alias("src_port"),
        F.when(F.col("kind") == "net", p[2]).alias("dest_ip"), F.when(F.col("kind") == "net", p[3]).alias("dest_port"),
    )
    rec = F.to_json(
        F.struct(
            F.lit("CREATE").alias("action"), F.concat(F.lit("a"), "uuid").alias("actorID"), F.col("uuid").alias("objectID"),
            name.alias("object"), F.lit("2024-01-01T00:00:00.5").alias("timestamp"),
            F.when(F.col("kind") == "subject", p[1]).alias("tgid"), props.alias("properties"),
        )
    )
    twin = F.replace(rec, F.lit('"CREATE"'), F.lit('"OPEN"'))
    shape = F.pmod(F.length("props"), F.lit(3))
    line = F.when(shape == 0, rec).when(shape == 1, F.concat(rec, F.lit(" "), twin)).otherwise(
        F.concat(F.lit("["), rec, F.lit(", "), twin, F.lit("]"))
    )
    return optc.read_records(spark, _text_file(ents.select(line.alias("value")), spark, "records"))


REC_SQL = """rec AS (
  SELECT uuid, kind, props, 'CREATE' AS action FROM ent
  UNION ALL SELECT uuid, kind, props, 'OPEN' FROM ent WHERE length(props) % 3 <> 0)"""


@query(
    "src6_optc_records",
    v.with_ctes(v.ENT, REC_SQL, "SELECT uuid AS object_id, action, kind, count(*) AS n FROM rec GROUP BY 1, 2, 3"),
)
def src6_optc_records(spark, sf):
    kind = F.when(F.col("object") == "FILE", "file").when(F.col("object") == "FLOW", "net").otherwise("subject")
    return _optc_records(spark, sf).groupBy(F.col("objectID").alias("object_id"), "action", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query("src7_optc_entities", v.with_ctes(v.ENT, "SELECT DISTINCT uuid, kind, props FROM ent"))
def src7_optc_entities(spark, sf):
    return optc.entities(_optc_records(spark, sf)).select("uuid", "kind", "props").distinct()


@query(
    "src8_optc_events",
    v.with_ctes(
        v.ENT,
        REC_SQL,
        """SELECT 'a' || uuid AS actor_id, uuid AS object_id, action, 1704067200500000 AS ts_us,
             CASE WHEN kind = 'subject' THEN split_part(props, ',', 1) ELSE '' END AS exec,
             CASE WHEN kind = 'subject' THEN split_part(props, ',', 3) ELSE '' END AS path FROM rec""",
    ),
)
def src8_optc_events(spark, sf):
    return optc.events(_optc_records(spark, sf)).select("actor_id", "object_id", "action", "ts_us", "exec", "path")


def _dot_file(spark, sf):
    e = v.audit_events(spark, sf)
    nodes = e.select(F.col("actor_id").alias("n"), F.lit("process").alias("t")).union(
        e.filter(F.col("object_type") != "SUBJECT_PROCESS").select(
            "object_id", F.when(F.col("object_type") == "NetFlowObject", "IP_Address").otherwise("file")
        )
    )
    statements = nodes.distinct().select(F.concat(F.lit('"'), "n", F.lit('" [type="'), "t", F.lit('"];')).alias("value"))
    links = e.select(
        F.concat(
            F.lit('"'), "actor_id", F.lit('" -> "'), F.concat(F.col("object_id"), F.when(F.col("event_id") % 9 == 0, "x").otherwise("")),
            F.lit('" [capacity=1, type="'), F.lower(F.substring("action", 7, 20)), F.lit('", timestamp='), F.expr("ts_us div 1000000"),
            F.lit("];"),
        ).alias("value")
    )
    return _text_file(statements.unionByName(links), spark, "dot")


DOT_NODES = """dn AS (
  SELECT DISTINCT actor_id AS name, 'process' AS node_type FROM ev
  UNION SELECT DISTINCT object_id, CASE WHEN object_type = 'NetFlowObject' THEN 'IP_Address' ELSE 'file' END FROM ev
  WHERE object_type <> 'SUBJECT_PROCESS')"""


@query(
    "src9_dot_nodes",
    v.with_ctes(
        v.EV,
        DOT_NODES,
        """SELECT name, node_type, CASE node_type WHEN 'process' THEN 'subject' WHEN 'file' THEN 'file' ELSE 'net' END AS kind
           FROM dn""",
    ),
)
def src9_dot_nodes(spark, sf):
    return dot.read_nodes(spark, _dot_file(spark, sf)).select("name", "node_type", "kind")


@query(
    "src10_dot_edges",
    v.with_ctes(
        v.EV,
        DOT_NODES,
        """dt AS (SELECT name, arg_min(CASE node_type WHEN 'IP_Address' THEN 'NETFLOW_OBJECT' WHEN 'process'
             THEN 'SUBJECT_PROCESS' ELSE 'FILE_OBJECT_BLOCK' END, CASE node_type WHEN 'IP_Address' THEN 1 WHEN 'process'
             THEN 5 ELSE 6 END) AS t FROM dn GROUP BY name)""",
        """SELECT e.actor_id, a.t AS actor_type, coalesce(o.t, 'PRINCIPAL_LOCAL') AS object_type, e.action, count(*) AS n,
             sum(e.ts)::BIGINT AS sum_ts
           FROM (SELECT actor_id, object_id || CASE WHEN event_id % 9 = 0 THEN 'x' ELSE '' END AS object_id,
                   lower(substring(action, 7, 20)) AS action, ts_us // 1000000 AS ts FROM ev) e
           LEFT JOIN dt a ON e.actor_id = a.name LEFT JOIN dt o ON e.object_id = o.name GROUP BY 1, 2, 3, 4""",
    ),
)
def src10_dot_edges(spark, sf):
    path = _dot_file(spark, sf)
    rows = dot.read_edges(spark, path, dot.read_nodes(spark, path))
    return rows.groupBy("actor_id", "actor_type", "object_type", "action").agg(
        F.count(F.lit(1)).alias("n"), F.sum("ts").alias("sum_ts")
    )


@query("src11_labels", "SELECT DISTINCT 'doc-' || doc_id AS label_id FROM labels WHERE toxic = 1")
def src11_labels(spark, sf):
    lab = v.table(spark, sf, "labels")
    text = F.when(F.col("toxic") == 1, F.concat(F.lit("  doc-"), "doc_id", F.lit(" "))).otherwise("   ")
    return edge_src.read_labels(spark, _text_file(lab.select(text.alias("value")), spark, "labels"))


@query(
    "src12_scenes",
    v.with_ctes(
        v.EV,
        """s AS (SELECT DISTINCT CASE WHEN object_type = 'NetFlowObject' THEN 'network' ELSE 'files' END AS scene,
             CASE WHEN actor_id IN ('u3', 'u7') THEN 'malicious' ELSE 'benign' END AS category FROM ev)""",
        """SELECT scene, category, 'log' AS role FROM s
           UNION ALL SELECT DISTINCT scene, 'malicious', 'labels' FROM s""",
    ),
)
def src12_scenes(spark, sf):
    """Scene folders written from the events: logs per scene and category, labels beside the malicious logs."""
    base = scratch_path(spark, "scenes")
    e = v.audit_events(spark, sf)
    for scene in ("files", "network"):
        rows = e.filter((F.col("object_type") == "NetFlowObject") == (scene == "network"))
        marked = F.col("actor_id").isin(*v.LABELLED)
        for category, part in (("benign", rows.filter(~marked)), ("malicious", rows.filter(marked))):
            part.select("event_id", "action").write.json(f"{base}/{scene}/{category}")
    for scene in ("files", "network"):
        v.labelled_entities(spark, sf).write.mode("append").text(f"{base}/{scene}/malicious")
    return edge_src.discover_scenes(spark, base).select("scene", "category", "role").distinct()


@query(
    "src13_scene_filter",
    v.with_ctes(v.EV, "SELECT action, count(*) AS n FROM ev WHERE object_type = 'NetFlowObject' GROUP BY 1"),
)
def src13_scene_filter(spark, sf):
    base = scratch_path(spark, "by-scene")
    scene = F.when(F.col("object_type") == "NetFlowObject", "net").otherwise("host")
    v.audit_events(spark, sf).withColumn("scene", scene).write.partitionBy("scene").parquet(base)
    kept = edge_src.only_scene(spark.read.parquet(base), "net")
    return kept.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src14_rows_per_file",
    v.with_ctes(
        v.EV,
        """SELECT event_id, source_file FROM (
             SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY ts_us, event_id) AS rn FROM (
               SELECT event_id, ts_us, object_type AS source_file FROM ev))
           WHERE rn <= 1500 OR source_file = 'SUBJECT_PROCESS'""",
    ),
)
def src14_rows_per_file(spark, sf):
    e = v.audit_events(spark, sf).select("event_id", "ts_us", F.col("object_type").alias("source_file"))
    benign = F.col("source_file") != "SUBJECT_PROCESS"
    capped = ev_ops.cap_per_file(e, 1500, [F.col("ts_us"), F.col("event_id")], benign)
    return capped.select("event_id", "source_file")


def _stix(spark, sf):
    """One bundle per hundred parts: an attack pattern per part, and sub-technique links to part numbers / 10."""
    part = v.table(spark, sf, "part")
    key = F.col("p_partkey")
    tech = F.concat(F.lit("T"), 1000 + key)
    obj = F.struct(
        F.lit("attack-pattern").alias("type"), F.concat(F.lit("ap--"), key).alias("id"), F.col("p_name").alias("name"),
        F.concat(F.lit("Use of "), "p_type", F.lit(" (Citation: X) <code>y</code> [z](http://a)")).alias("description"),
        (key % 7 == 3).alias("revoked"), F.when(key % 11 == 4, True).alias("x_mitre_deprecated"),
        (key % 10 != 0).alias("x_mitre_is_subtechnique"),
        F.array(
            F.struct(F.lit("other").alias("source_name"), F.lit("x").alias("external_id"), F.lit("").alias("url")),
            F.struct(
                F.when(key % 13 == 5, "nist").otherwise("mitre-attack").alias("source_name"), tech.alias("external_id"),
                F.concat(F.lit("https://t/"), tech).alias("url"),
            ),
        ).alias("external_references"),
        F.lit(None).cast("string").alias("relationship_type"), F.lit(None).cast("string").alias("source_ref"),
        F.lit(None).cast("string").alias("target_ref"),
    )
    rel = F.struct(
        F.lit("relationship"), F.concat(F.lit("rel--"), key), F.lit(None).cast("string"), F.lit(None).cast("string"),
        F.lit(None).cast("boolean"), F.lit(None).cast("boolean"), F.lit(None).cast("boolean"),
        F.lit(None).cast("array<struct<source_name:string,external_id:string,url:string>>"),
        F.lit("subtechnique-of"), F.concat(F.lit("ap--"), key), F.concat(F.lit("ap--"), F.expr("p_partkey div 10 * 10")),
    )
    element = techniques.STIX_SCHEMA[len("objects array<") : -1]
    obj, rel = obj.cast(element), rel.cast(element)
    rows = part.select(F.expr("p_partkey div 100").alias("bundle"), F.explode(F.when(key % 10 == 0, F.array(obj)).otherwise(F.array(obj, rel))).alias("o"))
    bundles = rows.groupBy("bundle").agg(F.to_json(F.struct(F.collect_list("o").alias("objects"))).alias("value"))
    path = scratch_path(spark, "stix")
    bundles.select("value").write.text(path)
    return techniques.read_stix_objects(spark, path, one_per_line=True)


STIX_ACTIVE = "p_partkey % 7 <> 3 AND p_partkey % 11 <> 4 AND p_partkey % 13 <> 5"


@query(
    "src15_stix_techniques",
    f"""SELECT 'T' || (1000 + p_partkey) AS tech_id, p_name AS name, 'https://t/T' || (1000 + p_partkey) AS url,
          CASE WHEN p_partkey % 10 <> 0 THEN 1 ELSE 0 END AS is_sub, 'Use of ' || p_type || '  y z' AS description
        FROM part WHERE {STIX_ACTIVE}""",
)
def src15_stix_techniques(spark, sf):
    from auditloom.functions.text import clean_description

    t = techniques.techniques(_stix(spark, sf))
    return t.select(
        "tech_id", "name", "url", F.col("is_sub").cast("int").alias("is_sub"),
        clean_description(F.col("description")).alias("description"),
    )


@query(
    "jn9_subtechnique_parents",
    f"""WITH a AS (SELECT p_partkey FROM part WHERE {STIX_ACTIVE})
        SELECT 'T' || (1000 + s.p_partkey) AS sub_id, 'T' || (1000 + p.p_partkey) AS parent_id
        FROM a s JOIN a p ON p.p_partkey = s.p_partkey // 10 * 10 WHERE s.p_partkey % 10 <> 0""",
)
def jn9_subtechnique_parents(spark, sf):
    objects = _stix(spark, sf)
    return techniques.parents(objects, techniques.techniques(objects))


@query(
    "src16_technique_documents",
    """SELECT 'T' || (1000 + doc_id) || CASE WHEN doc_id % 2 = 0 THEN '' ELSE '.001' END AS tech_id, length(text) AS n_chars,
         md5(text) AS digest FROM (SELECT doc_id, trim(text) AS text FROM documents) WHERE doc_id % 17 <> 3""",
)
def src16_technique_documents(spark, sf):
    docs = v.table(spark, sf, "documents")
    sub = F.when(F.col("doc_id") % 2 == 0, "").otherwise("/001")
    url = F.when(F.col("doc_id") % 17 == 3, "https://x/none").otherwise(
        F.concat(F.lit("https://x/techniques/T"), (1000 + F.col("doc_id")).cast("string"), sub)
    )
    path = scratch_path(spark, "docs")
    rows = docs.select(url.alias("filepath"), F.col("text").alias("Body"))
    rows.write.option("header", "true").option("escape", '"').option("quoteAll", "true").csv(path)
    out = techniques.read_documents(spark, path)
    return out.select("tech_id", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("digest"))


@query(
    "src17_sequences",
    """SELECT steps, count(*) AS n FROM (SELECT string_agg('T' || (1000 + l_partkey % 50) || '.00' || l_linenumber, ' '
         ORDER BY l_linenumber, l_partkey, l_suppkey) AS steps FROM lineitem GROUP BY l_orderkey) GROUP BY 1 HAVING count(*) >= 1""",
)
def src17_sequences(spark, sf):
    li = v.table(spark, sf, "lineitem")
    step = F.concat(F.lit("t"), 1000 + F.col("l_partkey") % 50, F.lit("/00"), "l_linenumber")
    order = F.struct("l_linenumber", "l_partkey", "l_suppkey", step.alias("s"))
    lines = li.groupBy("l_orderkey").agg(F.sort_array(F.collect_list(order)).alias("a"))
    sep = F.when(F.col("l_orderkey") % 2 == 0, ",").otherwise("\t ")
    text = F.concat_ws(" ", F.transform("a", lambda s: s["s"]))
    joined = F.concat(F.lit(" "), F.replace(text, F.lit(" "), sep))
    listed = lines.select(F.explode(F.array(joined, F.concat(F.lit("# "), joined), F.lit(""))).alias("value"))
    path = _text_file(listed, spark, "sequences")
    seqs = techniques.read_sequences(spark, path).select("steps")
    orders = lines.select(F.transform("a", lambda s: F.upper(F.replace(s["s"], F.lit("/"), F.lit(".")))).alias("steps"))
    counts = orders.groupBy("steps").agg(F.count(F.lit(1)).alias("n"))
    found = seqs.distinct().join(counts, "steps")
    return found.select(F.array_join("steps", " ").alias("steps"), "n")


@query(
    "snk1_snapshot_store",
    v.with_ctes(
        v.GRAPH,
        """SELECT CASE WHEN snapshot_id < 473808 THEN 'benign' ELSE 'evaluation' END AS split,
             count(DISTINCT snapshot_id) AS n_snapshots, count(*) AS n_nodes FROM nodes GROUP BY 1""",
    ),
)
def snk1_snapshot_store(spark, sf):
    path = scratch_path(spark, "snapshots")
    split = F.when(F.col("snapshot_id") < v.SPLIT_HOUR, "benign").otherwise("evaluation")
    build = lambda: v.nodes(spark, sf).withColumn("split", split)
    sinks.load_or_build(spark, path, build)
    again = sinks.load_or_build(spark, path, lambda: (_ for _ in ()).throw(RuntimeError("rebuilt")))
    return again.groupBy("split").agg(F.countDistinct("snapshot_id").alias("n_snapshots"), F.count(F.lit(1)).alias("n_nodes"))


@query(
    "snk2_snapshot_report",
    v.with_ctes(
        v.GRAPH,
        """SELECT snapshot_id, type, n_nodes, n_malicious, sum(n_nodes) OVER (PARTITION BY snapshot_id)::BIGINT AS n_total,
             round(n_nodes::DOUBLE / sum(n_nodes) OVER (PARTITION BY snapshot_id), 6) AS share
           FROM (SELECT snapshot_id, type, count(*) AS n_nodes, sum(label)::BIGINT AS n_malicious FROM nodes GROUP BY 1, 2)""",
    ),
)
def snk2_snapshot_report(spark, sf):
    path = scratch_path(spark, "report")
    sinks.write_report(v.nodes(spark, sf), path)
    schema = "snapshot_id bigint, type string, n_nodes bigint, n_malicious bigint, n_total bigint, share double"
    return spark.read.schema(schema).json(path)


PREDS = """preds AS (SELECT name, snapshot_id, label AS y_true, CASE WHEN frequency >= 3 THEN 1 ELSE 0 END AS y_pred,
  frequency / 10.0 AS score FROM nodes)"""


def node_preds(spark, sf):
    n = v.nodes(spark, sf)
    return n.select(
        "name", "snapshot_id", F.col("label").alias("y_true"), (F.col("frequency") >= 3).cast("int").alias("y_pred"),
        (F.col("frequency") / 10.0).alias("score"),
    )


ROLLUP_SQL = v.with_ctes(
    v.GRAPH,
    PREDS,
    """SELECT ('0x' || substring(md5(name), 1, 15))::BIGINT AS node_id, max(y_true) AS y_true, max(y_pred) AS pred,
         max(score)::DOUBLE AS score FROM preds GROUP BY 1""",
)


@query("snk3_node_label_export", ROLLUP_SQL)
def snk3_node_label_export(spark, sf):
    path = scratch_path(spark, "node-labels")
    sinks.export_node_labels(node_preds(spark, sf), path)
    schema = "node_id bigint, y_true int, pred int, score double"
    return spark.read.schema(schema).option("header", "true").csv(path)


@query("ag13_node_rollup", ROLLUP_SQL)
def ag13_node_rollup(spark, sf):
    from auditloom.operators.metrics import node_rollup

    return node_rollup(node_preds(spark, sf))
