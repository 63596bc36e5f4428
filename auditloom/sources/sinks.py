"""Writers: snapshot tables, reports, node labels, cases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SNAPSHOTS_PER_FOLDER = 1000


def write_snapshots(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet by split and snapshot range. A folder per snapshot would not hold for millions of them;
    inside a folder rows are sorted by snapshot so that row-group statistics still prune."""
    placed = df.withColumn("snapshot_range", F.expr(f"snapshot_id div {SNAPSHOTS_PER_FOLDER}"))
    spread = F.pmod(F.xxhash64(*df.columns), F.lit(16))
    placed = placed.repartition("split", "snapshot_range", spread)
    placed.sortWithinPartitions("split", "snapshot_range", "snapshot_id").write.mode(mode).partitionBy(
        "split", "snapshot_range"
    ).parquet(path)


def read_snapshots(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)


def load_or_build(spark: SparkSession, path: str, build: Callable[[], DataFrame]) -> DataFrame:
    """Read the stored snapshots, or build and store them first when there are none."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(target):
        write_snapshots(build(), path)
    return read_snapshots(spark, path)


def snapshot_report(nodes: DataFrame) -> DataFrame:
    """Per snapshot and type: node count, malicious count, share of the snapshot."""
    per_type = nodes.groupBy("snapshot_id", "type").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.sum("label").alias("n_malicious")
    )
    totals = per_type.groupBy("snapshot_id").agg(F.sum("n_nodes").alias("n_total"))
    joined = per_type.join(totals, "snapshot_id")
    return joined.withColumn("share", F.round(F.col("n_nodes") / F.col("n_total"), 6))


def write_report(nodes: DataFrame, path: str) -> None:
    snapshot_report(nodes).write.mode("overwrite").json(path)


def export_node_labels(preds: DataFrame, path: str) -> None:
    """CSV of the node roll-up in id order: range-sorted part files instead of one file from one task."""
    from auditloom.operators.metrics import node_rollup

    ordered = node_rollup(preds).select("node_id", "y_true", "pred", "score").orderBy("node_id")
    ordered.write.mode("overwrite").option("header", "true").csv(path)


def case_rows(cases: DataFrame, ego_nodes: DataFrame, ego_edges: DataFrame) -> DataFrame:
    """One row per case with its (size-limited) ego nodes and edges nested."""
    key = ["snapshot_id", "center"]
    nodes = ego_nodes.groupBy(*key).agg(
        F.sort_array(F.collect_list(F.struct("hop", "node", "type", "prop"))).alias("nodes")
    )
    edges = ego_edges.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("src", "dst", "actions_str"))).alias("edges"))
    return cases.join(nodes, key, "left").join(edges, key, "left")


def write_cases(cases: DataFrame, path: str) -> None:
    cases.write.mode("overwrite").json(path)
