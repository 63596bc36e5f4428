"""Reproducible splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.hashing import hash60
from auditloom.operators.ranking import ordered_positions


def stratified_split(df: DataFrame, label: str, key: list[str], share: float, seed: int) -> DataFrame:
    """``part``: floor(share * n) rows of every class are train, in hash order, the rest test."""
    cols = [F.col(k) for k in key]
    placed = ordered_positions(df, [label], [hash60(*cols, seed), *cols], "_pos")
    sizes = df.groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    part = F.when(F.col("_pos") <= F.floor(F.lit(share) * F.col("_n")), "train").otherwise("test")
    return placed.join(sizes, label).withColumn("part", part).drop("_pos", "_n")


def ordered_split(df: DataFrame, order: list[Column], shares: dict[str, float]) -> DataFrame:
    """``part`` by position in the order; shares are given in that order and sum to one."""
    placed = ordered_positions(df, [], order, "_pos").withColumn("_n", df.agg(F.count(F.lit(1))).scalar())
    names, bound, arms = list(shares), 0.0, []
    for name in names[:-1]:
        bound += shares[name]
        arms.append(F.when(F.col("_pos") <= F.floor(F.lit(round(bound, 9)) * F.col("_n")), name))
    return placed.withColumn("part", F.coalesce(*arms, F.lit(names[-1]))).drop("_pos", "_n")
