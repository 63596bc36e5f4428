"""Edge tables, label lists and scene folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators.events import iso_to_micros, nanos_to_micros

EDGE_COLUMNS = ["actor_id", "actor_type", "object_id", "object_type", "action", "timestamp"]
OPTC_HEADER = {
    "Source_ID": "actor_id",
    "Source_Type": "actor_type",
    "Destination_ID": "object_id",
    "Destination_Type": "object_type",
    "Edge_Type": "action",
    "Timestamp": "timestamp",
}


def read_edge_tsv(spark: SparkSession, path) -> DataFrame:
    """Tab-separated edges without header; lines that do not have all six fields are dropped."""
    parts = F.split("value", "\t")
    lines = spark.read.text(path).filter(F.size(parts) == len(EDGE_COLUMNS))
    cols = [parts[i].alias(c) for i, c in enumerate(EDGE_COLUMNS)]
    return lines.select(*cols).withColumn("ts_us", nanos_to_micros("timestamp"))


def read_optc_edges(spark: SparkSession, path) -> DataFrame:
    """Whitespace-separated edges with a header line; columns are found by their header names."""
    lines = spark.read.text(path)
    header = lines.filter(F.col("value").contains("Source_ID")).first()
    if header is None:
        raise ValueError(f"no header line in {path}")
    names = [n.strip() for n in header["value"].split()]
    parts = F.split("value", r"\t| {2,}|\s")
    rows = lines.filter((F.size(parts) == len(names)) & ~F.col("value").contains("Source_ID"))
    cols = [parts[names.index(raw)].alias(ours) for raw, ours in OPTC_HEADER.items()]
    return rows.select(*cols).withColumn("ts_us", iso_to_micros(F.col("timestamp")))


def read_labels(spark: SparkSession, path) -> DataFrame:
    """One trimmed id per non-empty line."""
    return spark.read.text(path).select(F.trim("value").alias("label_id")).filter(F.col("label_id") != "")


def discover_scenes(spark: SparkSession, base: str) -> DataFrame:
    """``scene, category, role, path`` of the log and label files below ``base``; only paths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base).select("path")
    pattern = r"/([^/]+)/(benign|malicious)/([^/]+)\.(json|txt)$"
    found = files.select(
        F.regexp_extract("path", pattern, 1).alias("scene"),
        F.regexp_extract("path", pattern, 2).alias("category"),
        F.regexp_extract("path", pattern, 3).alias("file"),
        F.regexp_extract("path", pattern, 4).alias("ext"),
        "path",
    )
    kept = found.filter((F.col("scene") != "") & ~F.col("file").startswith("._"))
    kept = kept.filter((F.col("ext") == "json") | (F.col("category") == "malicious"))
    return kept.withColumn("role", F.when(F.col("ext") == "json", "log").otherwise("labels")).drop("ext")


def only_scene(df: DataFrame, scene: str | None) -> DataFrame:
    """Keep one scene, or everything for ``None``; prunes partitions when stored by scene."""
    return df if scene is None else df.filter(F.col("scene") == scene)
