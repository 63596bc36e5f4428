"""Technique libraries: STIX bundles, technique documents, triples, sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_REF = "struct<source_name:string,external_id:string,url:string>"
STIX_SCHEMA = (
    "objects array<struct<type:string,id:string,name:string,description:string,revoked:boolean,"
    "x_mitre_deprecated:boolean,x_mitre_is_subtechnique:boolean,"
    f"external_references:array<{_REF}>,relationship_type:string,source_ref:string,target_ref:string>>"
)


def read_stix_objects(spark: SparkSession, path, one_per_line: bool = False) -> DataFrame:
    """One row per object. A bundle is one JSON document: one per file, or one per line."""
    bundle = spark.read.schema(STIX_SCHEMA).option("multiLine", str(not one_per_line).lower()).json(path)
    return bundle.select(F.explode("objects").alias("o")).select("o.*")


def techniques(objects: DataFrame) -> DataFrame:
    """Active attack patterns with their technique id and page."""
    refs = F.filter("external_references", lambda r: r["source_name"] == "mitre-attack")
    ref = F.get(refs, F.lit(0))
    active = (F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False))
    active &= ~F.coalesce("x_mitre_deprecated", F.lit(False))
    return objects.filter(active).select(
        ref["external_id"].alias("tech_id"), "name", "description", ref["url"].alias("url"),
        F.coalesce("x_mitre_is_subtechnique", F.lit(False)).alias("is_sub"), F.col("id").alias("stix_id"),
    ).filter(F.coalesce("tech_id", F.lit("")) != "")


def parents(objects: DataFrame, techs: DataFrame) -> DataFrame:
    """``sub_id, parent_id`` from the subtechnique-of relationships."""
    links = objects.filter((F.col("type") == "relationship") & (F.col("relationship_type") == "subtechnique-of"))
    sub = techs.select(F.col("stix_id").alias("source_ref"), F.col("tech_id").alias("sub_id"))
    parent = techs.select(F.col("stix_id").alias("target_ref"), F.col("tech_id").alias("parent_id"))
    return links.select("source_ref", "target_ref").join(sub, "source_ref").join(parent, "target_ref").select("sub_id", "parent_id")


def read_documents(spark: SparkSession, path) -> DataFrame:
    """``tech_id, body`` from a CSV with the columns filepath and Body; empty bodies are skipped."""
    rows = spark.read.option("header", "true").option("multiLine", "true").option("escape", '"').csv(path)
    tech = F.replace(F.regexp_extract("filepath", r"(T\d+(?:/\d+)?)", 1), F.lit("/"), F.lit("."))
    out = rows.select(tech.alias("tech_id"), F.trim("Body").alias("body"))
    return out.filter((F.col("tech_id") != "") & (F.coalesce("body", F.lit("")) != ""))


def read_triples(spark: SparkSession, path, whole: bool = True) -> DataFrame:
    """``tech_id, triples`` from JSON objects of lists, one object per file or (``whole`` off) per line;
    techniques without triples are skipped."""
    triple = T.StructType([T.StructField(c, T.StringType()) for c in ("subject", "verb", "object")])
    text = spark.read.text(path, wholetext=whole)
    parsed = text.select(F.from_json("value", T.MapType(T.StringType(), T.ArrayType(triple))).alias("m"))
    rows = parsed.select(F.explode("m").alias("tech_id", "triples"))
    return rows.filter(F.size("triples") > 0)


def triples_text(triples: Column) -> Column:
    return F.array_join(
        F.transform(triples, lambda t: F.concat_ws(" ", t["subject"], t["verb"], t["object"])), ". "
    )


def read_sequences(spark: SparkSession, path) -> DataFrame:
    """``seq_id, steps``: one sequence per line, '#' lines skipped, ids written with '.' and in capitals.

    The id orders sequences by file, then by text.
    """
    line = F.trim(F.regexp_replace("value", r"[\t,]", " "))
    rows = spark.read.text(path).filter(~F.trim("value").startswith("#")).select(line.alias("text"))
    rows = rows.filter(F.col("text") != "").distinct()
    steps = F.transform(F.split("text", " +"), lambda s: F.upper(F.replace(s, F.lit("/"), F.lit("."))))
    return rows.select(F.md5("text").alias("seq_id"), steps.alias("steps"), "text")
