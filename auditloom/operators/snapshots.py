"""Windows over events and the node and edge tables of each snapshot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.operators.events import fallback_property, label_exact, preferred_entities
from auditloom.operators.ranking import ordered_positions

MINUTE_US = 60_000_000


def tumbling(events: DataFrame, length_us: int = MINUTE_US) -> DataFrame:
    """Epoch-aligned windows; ``snapshot_id`` is the window number. Rows without a time are dropped."""
    return events.filter(F.col("ts_us").isNotNull()).withColumn("snapshot_id", F.expr(f"ts_us div {length_us}"))


def tumbling_from_first(events: DataFrame, length_us: int = 5 * MINUTE_US, by: list[str] | None = None) -> DataFrame:
    """Windows anchored at the earliest event, of the whole table or of each ``by`` group."""
    timed = events.filter(F.col("ts_us").isNotNull())
    if by:
        first = timed.groupBy(*by).agg(F.min("ts_us").alias("_first"))
        timed = timed.join(first, by)
    else:
        timed = timed.withColumn("_first", timed.agg(F.min("ts_us")).scalar())
    return timed.withColumn("snapshot_id", F.expr(f"(ts_us - _first) div {length_us}")).drop("_first")


def count_chunks(events: DataFrame, size: int = 100, by: list[str] | None = None, order: list[Column] | None = None):
    """Every ``size`` events in time order form a chunk, over the whole stream or per ``by`` group."""
    keys = by or []
    placed = ordered_positions(events, keys, order or [F.col("ts_us"), F.col("event_id")])
    return placed.withColumn("snapshot_id", F.expr(f"(position - 1) div {size}")).drop("position")


def around(events: DataFrame, marks: DataFrame, before_us: int, after_us: int) -> DataFrame:
    """Events near a marked time on the same day-long grid cell, by a bucketed range join.

    ``marks(mark_id, mark_us)``; each mark is repeated for the buckets its range touches, so the join
    is an equi-join on the bucket followed by the exact range test.
    """
    width = max(1, before_us + after_us)
    span = F.sequence(F.expr(f"(mark_us - {before_us}) div {width}"), F.expr(f"(mark_us + {after_us}) div {width}"))
    ranged = marks.withColumn("_bucket", F.explode(span))
    placed = events.withColumn("_bucket", F.expr(f"ts_us div {width}"))
    near = F.col("ts_us").between(F.col("mark_us") - before_us, F.col("mark_us") + after_us)
    return placed.join(ranged, "_bucket").filter(near).drop("_bucket")


def roles(events: DataFrame) -> DataFrame:
    """One row per event end (actor 0, object 1), from a single scan."""
    text = fallback_property(F.col("exec"), F.col("action"), F.col("path"))
    ends = F.array(
        F.struct(F.col("actor_id").alias("name"), F.col("actor_type").alias("type"), F.lit(0).alias("role")),
        F.struct(F.col("object_id").alias("name"), F.col("object_type").alias("type"), F.lit(1).alias("role")),
    )
    return events.select("snapshot_id", "ts_us", text.alias("fallback"), F.inline(ends))


def node_properties(events: DataFrame, entities: DataFrame) -> DataFrame:
    """Distinct ``(snapshot_id, name, prop)``; the long form, safe for entities with many properties."""
    distinct = roles(events).select("snapshot_id", "name", "fallback").distinct()
    best = preferred_entities(entities)
    joined = distinct.join(best, "name", "left")
    return joined.select("snapshot_id", "name", F.coalesce("props", "fallback").alias("prop")).distinct()


def node_table(events: DataFrame, entities: DataFrame, labels: DataFrame) -> DataFrame:
    """Nodes per snapshot: appearances, last time, first type, sorted properties, label.

    Counts are combined map-side, so a hub entity costs one row per task; properties are joined after
    the aggregation.
    """
    ends = roles(events)
    counted = ends.groupBy("snapshot_id", "name").agg(
        F.count(F.lit(1)).alias("frequency"),
        F.max("ts_us").alias("last_ts"),
        F.min_by("type", F.struct("ts_us", "role", "type")).alias("type"),
    )
    sets = node_properties(events, entities).groupBy("snapshot_id", "name").agg(
        F.array_sort(F.collect_set("prop")).alias("properties")
    )
    nodes = counted.join(sets, ["snapshot_id", "name"])
    return label_exact(nodes, labels).withColumn("prop", F.col("properties")[0])


def edge_table(events: DataFrame) -> DataFrame:
    """Edges per snapshot: sorted distinct actions and last time per (src, dst)."""
    grouped = events.groupBy("snapshot_id", F.col("actor_id").alias("src"), F.col("object_id").alias("dst")).agg(
        F.array_sort(F.collect_set("action")).alias("actions"), F.max("ts_us").alias("last_ts")
    )
    return grouped.withColumn("actions_str", F.array_join("actions", ","))


def multigraph_nodes(events: DataFrame) -> DataFrame:
    """Chunk-wise nodes when every event stays an edge: frequency and first type."""
    return roles(events).groupBy("snapshot_id", "name").agg(
        F.count(F.lit(1)).alias("frequency"), F.min_by("type", F.struct("ts_us", "role", "type")).alias("type")
    )


def new_edges(events: DataFrame) -> DataFrame:
    """One row per distinct (snapshot, src, dst, action)."""
    return events.select(
        "snapshot_id", F.col("actor_id").alias("src"), F.col("object_id").alias("dst"), "action"
    ).distinct()


def first_actions(events: DataFrame) -> DataFrame:
    """Only the first action of each (snapshot, src, dst)."""
    return events.groupBy("snapshot_id", F.col("actor_id").alias("src"), F.col("object_id").alias("dst")).agg(
        F.min_by("action", F.struct("ts_us", "action")).alias("action"), F.min("ts_us").alias("first_ts")
    )


def snapshot_labels(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("snapshot_id").agg(F.max("label").alias("label"))


def type_distribution(nodes: DataFrame) -> DataFrame:
    return nodes.groupBy("snapshot_id", "type").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("label").alias("n_malicious")
    )


def throughput(events: DataFrame, window_seconds: float = 60.0) -> DataFrame:
    return events.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_edges"), (F.count(F.lit(1)) / F.lit(window_seconds)).alias("edges_per_second")
    )


def select_training(snapshots: DataFrame, chosen=None, column: str = "snapshot_id") -> DataFrame:
    """All snapshots, one index, an inclusive (low, high) pair, or a list; an empty result is an error."""
    if chosen is None:
        return snapshots
    if isinstance(chosen, int):
        picked = snapshots.filter(F.col(column) == chosen)
    elif isinstance(chosen, tuple):
        picked = snapshots.filter(F.col(column).between(*chosen))
    else:
        picked = snapshots.filter(F.col(column).isin(*[int(c) for c in chosen]))
    if picked.isEmpty():
        raise ValueError("no training snapshot left after the selection")
    return picked
