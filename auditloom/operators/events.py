"""Event-level operators: time normalisation, entity properties, labels, joins and set operations.

Event tables carry ``actor_id, actor_type, object_id, object_type, action`` and ``ts_us``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.session import stored

EVENT_KEY = ["actor_id", "object_id", "action", "ts_us"]
KIND_ORDER = {"net": 0, "file": 1, "subject": 2}


def nanos_to_micros(column: str) -> Column:
    """Nanosecond text column to microseconds; null for text that is not a number."""
    return F.expr(f"try_cast({column} AS BIGINT) div 1000")


def iso_to_micros(text: Column) -> Column:
    return F.unix_micros(F.try_to_timestamp(text))


def merge_entities(entities: DataFrame) -> DataFrame:
    """One property text per (uuid, kind): the first file wins, inside a file the last record wins.

    Needs ``uuid, kind, props, source_file, record_key``; the record key orders records in a file.
    """
    last_in_file = entities.groupBy("uuid", "kind", "source_file").agg(
        F.max_by("props", F.struct("record_key", "props")).alias("props")
    )
    return last_in_file.groupBy("uuid", "kind").agg(F.min_by("props", "source_file").alias("props"))


def preferred_entities(entities: DataFrame) -> DataFrame:
    """One property text per uuid: net before file before subject; an empty text counts as missing."""
    order = F.coalesce(*[F.when(F.col("kind") == k, F.lit(i)) for k, i in KIND_ORDER.items()], F.lit(9))
    return (
        entities.filter(F.coalesce(F.col("props"), F.lit("")) != "")
        .groupBy(F.col("uuid").alias("name"))
        .agg(F.min_by("props", F.struct(order, F.col("props"))).alias("props"))
    )


def fallback_property(exec_col: Column, action: Column, path: Column) -> Column:
    """'exec action path' for entities without a property record."""
    known_path = F.when(F.coalesce(path, F.lit("")) != "", path)
    return F.trim(F.concat_ws(" ", F.coalesce(exec_col, F.lit("")), action, known_path))


def resolve_properties(rows: DataFrame, entities: DataFrame, name: str = "name") -> DataFrame:
    """Add ``prop``: the entity's property text, else the row's ``fallback``."""
    best = preferred_entities(entities).withColumnRenamed("name", name)
    return rows.join(best, name, "left").withColumn("prop", F.coalesce("props", "fallback")).drop("props")


def label_exact(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``label`` = 1 when the node name is in the one-column label table."""
    marks = labels.select(F.col(labels.columns[0]).alias("name")).distinct().withColumn("_hit", F.lit(1))
    return nodes.join(marks, "name", "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


_GRAM_SIZES = (1, 2, 4, 8)


def contains_join(names: DataFrame, name: str, labels: DataFrame, label: str) -> DataFrame:
    """All (name, label) pairs where the label is a substring of the name, as an equi-join.

    A name offers its distinct substrings of 1, 2, 4 and 8 characters. A label is looked up by one of its
    own substrings of the largest size that fits, the one that occurs in the fewest names. Only pairs that
    share this key are tested, none is missed, and common beginnings such as directories do not collect pairs.
    Only substrings that a label asks for are kept. What is asked for is stored first, so that Spark knows its size; the
    substrings of the names are never broadcast, as Spark takes them for as small as the table of names.
    """
    keyed = labels.select(label).distinct().filter(F.length(label) > 0)
    parts = F.coalesce(*[F.when(F.length(label) >= s, _substrings(label, s)) for s in reversed(_GRAM_SIZES)])
    distinct_names = names.select(name).distinct().filter(F.length(name) > 0)
    grams = [_substrings(name, s) for s in _GRAM_SIZES]
    offered = distinct_names.withColumn("_gram", F.explode(F.array_distinct(F.concat(*grams))))
    asked = stored(keyed.withColumn("_gram", F.explode(F.array_distinct(parts))))
    seen = offered.select("_gram").join(asked.select("_gram"), "_gram", "left_semi").groupBy("_gram").agg(F.count(F.lit(1)).alias("_n"))
    wanted = asked.join(seen.hint("merge"), "_gram", "left")
    rarest = wanted.groupBy(label).agg(F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), F.col("_gram"))).alias("_gram"))
    rarest = stored(rarest)
    shared = offered.join(rarest.select("_gram"), "_gram", "left_semi")
    return shared.hint("merge").join(rarest, "_gram").filter(F.col(name).contains(F.col(label))).select(name, label)


def _substrings(name: str, size: int) -> Column:
    """All substrings of one size; empty for shorter texts."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(name) - (size - 1), F.lit(1)))
    cut_out = F.transform(starts, lambda i: F.col(name).substr(i, F.lit(size)))
    return F.when(F.length(name) >= size, cut_out).otherwise(F.array().cast("array<string>"))


def label_substring(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """``label`` = 1 when any label text occurs inside the node name."""
    text = labels.select(F.col(labels.columns[0]).alias("_label"))
    hits = contains_join(nodes, "name", text, "_label").select("name").distinct().withColumn("_hit", F.lit(1))
    return nodes.join(hits, "name", "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def drop_labelled_edges(events: DataFrame, labels: DataFrame) -> DataFrame:
    """Drop a row when any of its text columns equals a label."""
    marks = labels.select(F.col(labels.columns[0]).alias("_label")).distinct()
    for column in ("actor_id", "actor_type", "object_id", "object_type", "action"):
        events = events.join(marks, events[column] == marks["_label"], "left_anti")
    return events


def join_raw_events(edges: DataFrame, raw: DataFrame) -> DataFrame:
    """Inner join of the edge table with raw events on the four key columns, then distinct."""
    wanted = raw.select(*EVENT_KEY, "exec", "path").distinct()
    return edges.distinct().join(wanted, EVENT_KEY, "inner").distinct()


def keep_known_events(raw: DataFrame, edges: DataFrame) -> DataFrame:
    """Semi-join prefilter: only raw events whose key occurs in the edge table."""
    return raw.join(edges.select(*EVENT_KEY).distinct(), EVENT_KEY, "left_semi")


def concat_distinct(*frames: DataFrame) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out.distinct()


def cap_per_file(records: DataFrame, limit: int, order: list[Column], only: Column | None = None) -> DataFrame:
    """First ``limit`` rows per ``source_file`` in the given order; rows outside ``only`` are kept whole."""
    from auditloom.operators.ranking import ordered_positions

    chosen = records if only is None else records.filter(only)
    capped = ordered_positions(chosen, ["source_file"], order).filter(F.col("position") <= limit).drop("position")
    return capped if only is None else capped.unionByName(records.filter(~only))


def replicate(events: DataFrame, factor: int) -> DataFrame:
    """``factor`` copies of every row, numbered by ``copy``."""
    return events.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(factor - 1))))


def replication_factor(size_text: str, base_bytes: int) -> int:
    """Copies needed to reach a size such as '10GB' (units B, KB, MB, GB, TB), at least one."""
    units = {"TB": 1 << 40, "GB": 1 << 30, "MB": 1 << 20, "KB": 1 << 10, "B": 1}
    text = size_text.strip().upper()
    for unit, scale in units.items():
        if text.endswith(unit):
            wanted = float(text[: -len(unit)]) * scale
            break
    else:
        wanted = float(text)
    return max(1, -(-int(wanted) // max(1, base_bytes)))
