"""Evaluation roll-ups: confusion counts, ratios, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFUSION = ("tp", "fp", "tn", "fn")


def guarded(numerator: Column, denominator: Column) -> Column:
    """Ratio with zero denominator -> 0."""
    return F.when(denominator == 0, F.lit(0.0)).otherwise(numerator / denominator)


def confusion(preds: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return preds.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"),
        F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"),
    )


def ratios(counts: DataFrame, places: int = 6) -> DataFrame:
    tp, fp, tn, fn = (F.col(c) for c in CONFUSION)
    precision, recall = guarded(tp, tp + fp), guarded(tp, tp + fn)
    values = {
        "accuracy": guarded(tp + tn, tp + fp + tn + fn),
        "precision": precision,
        "recall": recall,
        "f1": guarded(2 * precision * recall, precision + recall),
        "fpr": guarded(fp, fp + tn),
    }
    return counts.withColumns({k: F.round(v, places) for k, v in values.items()})


def evaluate(preds: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    return ratios(confusion(preds, by, truth, pred))


def micro_average(counts: DataFrame, by: list[str]) -> DataFrame:
    """Sum confusion counts over data sets, then the ratios."""
    return ratios(counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in CONFUSION]))


def any_positive(preds: DataFrame, by: list[str], truth: str = "y_true", pred: str = "y_pred") -> DataFrame:
    """A group is positive when any member is."""
    return preds.groupBy(*by).agg(F.max(truth).alias(truth), F.max(pred).alias(pred))


def node_rollup(preds: DataFrame, name: str = "name") -> DataFrame:
    """Per entity over all snapshots: highest label, prediction and score."""
    from auditloom.functions.hashing import stable_id

    return preds.groupBy(stable_id(F.col(name)).alias("node_id")).agg(
        F.max("y_true").alias("y_true"), F.max("y_pred").alias("pred"), F.max("score").alias("score")
    )


def status_shares(details: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    """Counts and percent of correct, incorrect and unmapped, per group and over all groups (rollup)."""
    names = ("correct", "incorrect", "unmapped")
    agg = [F.count_if(F.col(status) == n).alias(n) for n in names] + [F.count(F.lit(1)).alias("total")]
    out = details.rollup(*by).agg(*agg)
    return out.withColumns({f"{n}_pct": F.round(100.0 * F.col(n) / F.col("total"), 1) for n in names})


def metric_change(base: DataFrame, other: DataFrame, by: list[str], metric: str = "recall") -> DataFrame:
    """Metric of two test sets side by side and the drop from the first to the second."""
    a = evaluate(base, by).select(*by, F.col(metric).alias(f"{metric}_base"))
    b = evaluate(other, by).select(*by, F.col(metric).alias(f"{metric}_other"))
    drop = F.round(F.col(f"{metric}_base") - F.col(f"{metric}_other"), 6)
    return a.join(b, by).withColumn(f"{metric}_drop", drop)


def outcome(truth: str = "y_true", pred: str = "y_pred") -> Column:
    t, p = F.col(truth) == 1, F.col(pred) == 1
    return F.when(t & p, "TP").when(~t & p, "FP").when(t & ~p, "FN").otherwise("TN")


def method_differences(details: DataFrame, a: str, b: str, key: str = "entity") -> DataFrame:
    """Cases right in one of two methods only: ``gain`` (b right, a wrong) and ``loss``."""
    right = F.col("status") == "correct"
    side = details.filter(F.col("method").isin(a, b)).groupBy(key).agg(
        F.max(F.when((F.col("method") == a) & right, 1).otherwise(0)).alias("_a"),
        F.max(F.when((F.col("method") == b) & right, 1).otherwise(0)).alias("_b"),
    )
    change = F.when((F.col("_a") == 0) & (F.col("_b") == 1), "gain").when(
        (F.col("_a") == 1) & (F.col("_b") == 0), "loss"
    )
    return side.withColumn("change", change).filter(F.col("change").isNotNull()).select(key, "change")


def only_right(details: DataFrame, method: str, key: str = "entity") -> DataFrame:
    """Cases where this method alone is right."""
    right = F.col("status") == "correct"
    return (
        details.groupBy(key)
        .agg(
            F.max(F.when((F.col("method") == method) & right, 1).otherwise(0)).alias("_this"),
            F.max(F.when((F.col("method") != method) & right, 1).otherwise(0)).alias("_other"),
        )
        .filter((F.col("_this") == 1) & (F.col("_other") == 0))
        .select(key)
    )


def usage_rollup(calls: DataFrame, by: list[str], unit: str = "snapshot_id") -> DataFrame:
    """Calls, tokens and latency, in total and per snapshot."""
    units = F.countDistinct(unit)
    return calls.groupBy(*by).agg(
        F.count(F.lit(1)).alias("calls"),
        units.alias("n_snapshots"),
        F.sum("tokens").alias("total_tokens"),
        F.sum("latency").alias("total_latency"),
        (F.sum("tokens") / units).alias("tokens_per_snapshot"),
        (F.sum("latency") / units).alias("latency_per_snapshot"),
    )
