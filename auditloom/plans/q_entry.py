"""Flagship query: events -> hourly snapshots -> deviation -> top-k labels -> confusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.operators import detect, metrics, snapshots
from auditloom.plans import views as v
from auditloom.plans.registry import query

FEATURES = """feat AS (
  SELECT n.snapshot_id, n.label, n.n_nodes::DOUBLE AS f1, n.freq::DOUBLE AS f2, e.n_edges::DOUBLE AS f3,
    e.n_actions::DOUBLE AS f4
  FROM (SELECT snapshot_id, max(label) AS label, count(*) AS n_nodes, max(frequency) AS freq FROM nodes GROUP BY 1) n
  JOIN (SELECT snapshot_id, count(*) AS n_edges, sum(len(actions_str)) AS n_actions FROM edges GROUP BY 1) e
    ON n.snapshot_id = e.snapshot_id),
cen AS (SELECT avg(f1) AS c1, avg(f2) AS c2, avg(f3) AS c3, avg(f4) AS c4 FROM feat
  WHERE snapshot_id < 473808 AND label = 0),
dev AS (SELECT snapshot_id, label, sqrt((f1-c1)*(f1-c1) + (f2-c2)*(f2-c2) + (f3-c3)*(f3-c3) + (f4-c4)*(f4-c4)) AS dev
  FROM feat, cen WHERE snapshot_id >= 473808),
ranked AS (SELECT *, row_number() OVER (ORDER BY round(dev, 9) DESC, snapshot_id) AS rk FROM dev),
labelled AS (SELECT snapshot_id, dev, label AS y_true, CASE WHEN rk <= 40 THEN 1 ELSE 0 END AS y_pred FROM ranked)"""


def labelled_snapshots(spark, sf):
    nodes, edges = v.nodes(spark, sf), v.edges(spark, sf)
    per_node = nodes.groupBy("snapshot_id").agg(
        F.max("label").alias("label"), F.count(F.lit(1)).alias("n_nodes"), F.max("frequency").alias("freq")
    )
    per_edge = edges.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.sum(F.length("actions_str")).alias("n_actions")
    )
    parts = [F.col(c).cast("double") for c in ("n_nodes", "freq", "n_edges", "n_actions")]
    feats = per_node.join(per_edge, "snapshot_id").select("snapshot_id", "label", F.array(*parts).alias("vec"))
    benign = (F.col("snapshot_id") < v.SPLIT_HOUR) & (F.col("label") == 0)
    scored = detect.deviation(feats, "vec", 4, benign, "l2").withColumn("score", F.round("dev", 9))
    test = scored.filter(F.col("snapshot_id") >= v.SPLIT_HOUR)
    out = detect.top_k_labels(test, "snapshot_id", 40, "score")
    return out.select("snapshot_id", F.round("dev", 6).alias("dev"), F.col("label").alias("y_true"), F.col("pred").alias("y_pred"))


@query(
    "entry_snapshot_detection",
    v.with_ctes(v.GRAPH, FEATURES, "SELECT snapshot_id, round(dev, 6) AS dev, y_true, y_pred FROM labelled"),
)
def entry_snapshot_detection(spark, sf):
    return labelled_snapshots(spark, sf)


METRICS_SQL = """SELECT tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tp = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(CASE WHEN fp + tn = 0 THEN 0 ELSE fp::DOUBLE / (fp + tn) END, 6) AS fpr"""
COUNTS_SQL = """count(*) FILTER (WHERE y_true = 1 AND y_pred = 1) AS tp,
  count(*) FILTER (WHERE y_true <> 1 AND y_pred = 1) AS fp, count(*) FILTER (WHERE y_true <> 1 AND y_pred <> 1) AS tn,
  count(*) FILTER (WHERE y_true = 1 AND y_pred <> 1) AS fn"""


@query(
    "ag15_confusion_metrics",
    v.with_ctes(v.GRAPH, FEATURES, f"{METRICS_SQL} FROM (SELECT {COUNTS_SQL} FROM labelled)"),
)
def ag15_confusion_metrics(spark, sf):
    return metrics.evaluate(labelled_snapshots(spark, sf), [])


@query("ag6_snapshot_label", v.with_ctes(v.GRAPH, "SELECT snapshot_id, max(label) AS label FROM nodes GROUP BY 1"))
def ag6_snapshot_label(spark, sf):
    return snapshots.snapshot_labels(v.nodes(spark, sf))
