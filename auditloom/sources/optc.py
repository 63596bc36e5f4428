"""OpTC-style JSON records: entities and events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.events import iso_to_micros

_PROPERTIES = ["command_line", "image_path", "file_path", "src_ip", "src_port", "dest_ip", "dest_port"]
RECORD = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("action", "actorID", "objectID", "object", "timestamp", "tgid")]
    + [T.StructField("properties", T.StructType([T.StructField(p, T.StringType()) for p in _PROPERTIES]))]
)


def _nested(depth: int) -> str:
    """Pattern of a JSON object with objects inside up to ``depth`` deep; braces inside strings count as text."""
    inside = r'[^{}"]++|"(?:[^"\\]++|\\.)*+"'
    pattern = rf"\{{(?:{inside})*+\}}"
    for _ in range(depth):
        pattern = rf"\{{(?:{inside}|{pattern})*+\}}"
    return pattern


def read_records(spark: SparkSession, path, multi_line: bool = False) -> DataFrame:
    """Records from JSON lines, arrays on one line, or several objects glued on one line.

    A line that is one array is parsed as a whole; from other lines, also from arrays that are cut off, every object is taken
    that is complete, with braces inside strings left alone. ``multi_line`` reads pretty-printed array files, one file per
    task.
    """
    if multi_line:
        parsed = spark.read.schema(RECORD).option("multiLine", "true").json(path)
        return parsed.withColumn("source_file", F.col("_metadata.file_path"))
    lines = spark.read.text(path).select(F.trim("value").alias("value"), F.col("_metadata.file_path").alias("source_file"))
    array = F.when(F.col("value").startswith("["), F.from_json("value", T.ArrayType(RECORD)))
    lines = lines.filter(F.col("value") != "").withColumn("whole", array)
    objects = F.transform(F.regexp_extract_all("value", F.lit(_nested(6)), F.lit(0)), lambda x: F.from_json(x, RECORD))
    pieces = lines.select("source_file", F.explode(F.coalesce("whole", objects)).alias("r"))
    return pieces.filter(F.coalesce("r.objectID", "r.actorID", "r.action").isNotNull()).select("source_file", "r.*")


def _text(name: str):
    return F.coalesce(F.col(name), F.lit(""))


def entities(records: DataFrame) -> DataFrame:
    kind = F.upper(_text("object"))
    p = {c: _text(f"properties.{c}") for c in _PROPERTIES}
    process = F.concat_ws(",", p["command_line"], _text("tgid"), p["image_path"])
    flow = F.concat_ws(",", p["src_ip"], p["src_port"], p["dest_ip"], p["dest_port"])
    return records.select(
        _text("objectID").alias("uuid"),
        F.when(kind == "FILE", "file").when(kind == "PROCESS", "subject").when(kind.isin("FLOW", "NETFLOW"), "net").alias("kind"),
        F.when(kind == "FILE", p["file_path"]).when(kind == "PROCESS", process).otherwise(flow).alias("props"),
        "source_file",
        _text("timestamp").alias("record_key"),
    ).filter(F.col("kind").isNotNull())


def events(records: DataFrame) -> DataFrame:
    return records.select(
        "source_file",
        _text("actorID").alias("actor_id"),
        _text("objectID").alias("object_id"),
        _text("action").alias("action"),
        _text("timestamp").alias("timestamp"),
        _text("properties.command_line").alias("exec"),
        _text("properties.image_path").alias("path"),
    ).withColumn("ts_us", iso_to_micros(F.col("timestamp")))
