"""Common Data Model logs (versions 18 and 20): events and entity records as JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.operators.events import nanos_to_micros

NAMESPACE = "com.bbn.tc.schema.avro.cdm{version}."


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def _string_box() -> T.StructType:
    return _struct(string=T.StringType())


def _record_schema(version: int, name: str, body: T.StructType) -> T.StructType:
    inner = T.StructType([T.StructField(NAMESPACE.format(version=version) + name, body)])
    return T.StructType([T.StructField("datum", inner)])


def _parse(lines: DataFrame, version: int, name: str, body: T.StructType) -> DataFrame:
    full = NAMESPACE.format(version=version) + name
    parsed = F.from_json("value", _record_schema(version, name, body))
    return lines.withColumn("r", parsed.getField("datum").getField(full)).filter(F.col("r").isNotNull())


def _lines(spark: SparkSession, paths) -> DataFrame:
    return spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("source_file"))


def read_events(spark: SparkSession, paths, version: int = 18) -> DataFrame:
    """Raw events; an event with a second object gives two rows, each with its own path.

    The substring test runs before the JSON parse, so other records are never parsed.
    """
    uuid = NAMESPACE.format(version=version) + "UUID"
    box = T.StructType([T.StructField(uuid, T.StringType())])
    body = _struct(
        type=T.StringType(),
        subject=box,
        predicateObject=box,
        predicateObject2=box,
        timestampNanos=T.StringType(),
        properties=_struct(map=T.MapType(T.StringType(), T.StringType())),
        predicateObjectPath=_string_box(),
        predicateObject2Path=_string_box(),
    )
    records = _parse(_lines(spark, paths).filter(F.col("value").contains("EVENT")), version, "Event", body)
    r = F.col("r")

    def text(c: Column) -> Column:
        return F.coalesce(c, F.lit(""))

    first = F.struct(
        text(r["predicateObject"].getField(uuid)).alias("object_id"),
        text(r["predicateObjectPath"]["string"]).alias("path"),
        F.lit(False).alias("second"),
    )
    second = F.struct(
        text(r["predicateObject2"].getField(uuid)).alias("object_id"),
        text(r["predicateObject2Path"]["string"]).alias("path"),
        F.lit(True).alias("second"),
    )
    rows = records.select(
        "source_file",
        text(r["subject"].getField(uuid)).alias("actor_id"),
        text(r["type"]).alias("action"),
        text(r["timestampNanos"]).alias("timestamp"),
        text(F.try_element_at(r["properties"]["map"], F.lit("cmdLine"))).alias("exec"),
        F.inline(F.array(first, second)),
    )
    rows = rows.filter(~F.col("second") | (F.col("object_id") != "")).drop("second")
    return rows.withColumn("ts_us", nanos_to_micros("timestamp"))


def _entity(rows: DataFrame, kind: str, props: Column) -> DataFrame:
    return rows.select(
        F.col("r.uuid").alias("uuid"), F.lit(kind).alias("kind"), props.alias("props"), "source_file",
        F.lit("").alias("record_key"),
    ).filter(F.col("uuid").isNotNull() & F.col("props").isNotNull())


def read_entities18(spark: SparkSession, paths) -> DataFrame:
    """Network flows 'addr,port,addr,port', processes 'cmdLine,tgid,path', file names.

    Parts that must be present: all four flow fields, command line and thread group, the file name;
    a process without path gets the text null.
    """
    lines = _lines(spark, paths)

    def of(name: str) -> DataFrame:
        return lines.filter(F.col("value").startswith('{"datum":{"' + NAMESPACE.format(version=18) + name + '"'))

    text = T.StringType()
    flow = _struct(uuid=text, localAddress=text, localPort=text, remoteAddress=text, remotePort=text)
    flows = _parse(of("NetFlowObject"), 18, "NetFlowObject", flow)
    ends = [F.col(f"r.{c}") for c in ("localAddress", "localPort", "remoteAddress", "remotePort")]
    subject = _struct(uuid=text, cmdLine=_string_box(), properties=_struct(map=T.MapType(text, text)))
    subjects = _parse(of("Subject"), 18, "Subject", subject)
    tags = F.col("r.properties.map")
    path = F.coalesce(F.try_element_at(tags, F.lit("path")), F.lit("null"))
    process = F.concat(F.col("r.cmdLine.string"), F.lit(","), F.try_element_at(tags, F.lit("tgid")), F.lit(","), path)
    files = _parse(of("FileObject"), 18, "FileObject", _struct(uuid=text))
    filename = F.nullif(F.regexp_extract("value", '"filename":"(.*?)"', 1), F.lit(""))
    comma = F.lit(",")
    flow_text = F.concat(ends[0], comma, ends[1], comma, ends[2], comma, ends[3])
    return (
        _entity(flows, "net", flow_text)
        .unionByName(_entity(subjects, "subject", process))
        .unionByName(_entity(files, "file", filename))
    )


def read_entities20(spark: SparkSession, paths) -> DataFrame:
    """As version 18 with nullable parts: the local end stays in its JSON form or the text null,
    process and file properties are the JSON text of their map."""
    lines = _lines(spark, paths)

    def of(name: str) -> DataFrame:
        return lines.filter(F.col("value").startswith('{"datum":{"' + NAMESPACE.format(version=20) + name + '"'))

    text = T.StringType()
    flow = _struct(
        uuid=text, localAddress=text, localPort=text, remoteAddress=_string_box(), remotePort=_struct(int=text)
    )
    flows = _parse(of("NetFlowObject"), 20, "NetFlowObject", flow)
    comma = F.lit(",")
    none = F.lit("null")
    flow_text = F.concat(
        F.coalesce("r.localAddress", none), comma, F.coalesce("r.localPort", none), comma,
        F.col("r.remoteAddress.string"), comma, F.col("r.remotePort.int"),
    )
    subject = _struct(uuid=text, cmdLine=_string_box(), properties=_struct(map=text))
    subjects = _parse(of("Subject"), 20, "Subject", subject)
    command = F.coalesce(F.col("r.cmdLine.string"), F.lit(""))
    process = F.concat(command, comma, F.col("r.properties.map"))
    body = _struct(uuid=text, baseObject=_struct(properties=_struct(map=text)), properties=_struct(map=text))
    files = _parse(of("FileObject"), 20, "FileObject", body)
    file_text = F.coalesce("r.baseObject.properties.map", "r.properties.map")
    return (
        _entity(flows, "net", flow_text)
        .unionByName(_entity(subjects, "subject", process))
        .unionByName(_entity(files, "file", file_text))
    )
