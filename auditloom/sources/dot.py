"""Graph files in DOT form: node statements and edge statements separated by ';'."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.functions import fixed_values as V
from auditloom.functions.text import lookup

# --- fixed values: statement patterns ---
NODE_PATTERN = r'(?i)^\s*"?(.+?)"?\s*\[.*?type="?([^",\]]+)"?'
EDGE_PATTERN = (
    r'(?is)"?([^"]+)"?\s*->\s*"?(.*?)"?\s*\[.*?capacity=.*?type="?([^",\]]+)"?.*?timestamp=(\d+)'
)


def _statements(spark: SparkSession, path) -> DataFrame:
    lines = spark.read.option("lineSep", ";").text(path)
    return lines.select("value", F.col("_metadata.file_path").alias("source_file"))


def read_nodes(spark: SparkSession, path) -> DataFrame:
    """``name, node_type, kind`` of every node statement (the name is also the property text)."""
    rows = _statements(spark, path).filter(~F.col("value").contains("capacity="))
    rows = rows.select(
        "source_file",
        F.regexp_extract("value", NODE_PATTERN, 1).alias("name"),
        F.regexp_extract("value", NODE_PATTERN, 2).alias("node_type"),
    )
    kinds = {t: kind for t, (kind, _) in V.DOT_NODE_KINDS.items()}
    return rows.filter(F.col("name") != "").withColumn("kind", lookup(kinds, F.col("node_type")))


def entities(nodes: DataFrame) -> DataFrame:
    return nodes.filter(F.col("kind").isNotNull()).select(
        F.col("name").alias("uuid"), "kind", F.col("name").alias("props"), "source_file", F.lit("").alias("record_key")
    )


def read_edges(spark: SparkSession, path, nodes: DataFrame) -> DataFrame:
    """Edges with the type of both ends; a name of several types takes the first in precedence order."""
    raw = _statements(spark, path).filter(F.col("value").contains("capacity="))
    parts = [F.trim(F.regexp_replace(F.regexp_extract("value", EDGE_PATTERN, i), r"^\s+|\s+$", "")) for i in range(1, 5)]
    edges = raw.select(
        "source_file", parts[0].alias("actor_id"), parts[1].alias("object_id"), parts[2].alias("action"),
        parts[3].cast("bigint").alias("ts"),
    ).filter(F.col("ts").isNotNull())
    order = {t: i for i, t in enumerate(V.DOT_NODE_KINDS)}
    types = {t: name for t, (_, name) in V.DOT_NODE_KINDS.items()}
    known = nodes.filter(F.col("kind").isNotNull()).groupBy("name").agg(
        F.min_by(lookup(types, F.col("node_type")), lookup(order, F.col("node_type"))).alias("_type")
    )
    for end, out in (("actor_id", "actor_type"), ("object_id", "object_type")):
        side = known.select(F.col("name").alias(end), F.col("_type").alias(out))
        edges = edges.join(side, end, "left").withColumn(out, F.coalesce(out, F.lit(V.DOT_DEFAULT_TYPE)))
    return edges
