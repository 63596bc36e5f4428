"""Overlap of node sets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


FEW = 64  # groups of which all pairs are counted


def _all_pairs(sets: DataFrame, group: str, item: str) -> DataFrame:
    """``a, b, shared`` of all pairs, b before a: items with the same groups are counted together, and no pair of rows moves."""
    held = sets.groupBy(item).agg(F.sort_array(F.collect_list(group)).alias("_g")).groupBy("_g").agg(F.count(F.lit(1)).alias("_c"))
    pairs = held.select("_g", "_c", F.posexplode("_g").alias("_i", "a")).select("a", "_c", F.explode(F.expr("slice(_g, 1, _i)")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.sum("_c").alias("shared"))


def overlapping(members: DataFrame, group: str, item: str, share: float) -> DataFrame:
    """Pairs (a, b), b before a, where b holds more than ``share`` of the items of a.

    Only the rarest items of a group are looked up: when more than a share s of the n items of ``a`` is
    shared, at least one of its n - floor(s * n) rarest items is. Candidates are then counted in full. Of up to FEW groups
    nearly all pairs are candidates, so these are counted from the groups of each item.
    """
    from auditloom.operators.ranking import ordered_positions

    sets = members.select(group, item).distinct()
    if members.select(group).distinct().limit(FEW + 1).count() <= FEW:
        counted = _all_pairs(sets.filter(F.col(group).isNotNull() & F.col(item).isNotNull()), group, item)
        return _over(counted, sets, group, share)
    frequency = sets.groupBy(item).agg(F.count(F.lit(1)).alias("_df"))
    sizes = sets.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    ranked = sets.join(frequency, item).join(sizes, group)
    placed = ordered_positions(ranked, [group], [F.col("_df"), F.col(item)], "_r")
    rare = placed.filter(F.col("_r") <= F.col("_n") - F.floor(F.col("_n") * share))
    a = rare.select(F.col(group).alias("a"), item)
    b = sets.select(F.col(group).alias("b"), item)
    candidates = a.join(b, item).filter(F.col("b") < F.col("a")).select("a", "b").distinct()
    full = candidates.join(sets.withColumnRenamed(group, "a"), "a").join(
        sets.select(F.col(group).alias("b"), item), ["b", item]
    )
    return _over(full.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared")), sets, group, share)


def _over(counted: DataFrame, sets: DataFrame, group: str, share: float) -> DataFrame:
    sizes = sets.groupBy(F.col(group).alias("a")).agg(F.count(F.lit(1)).alias("_n"))
    return counted.join(sizes, "a").filter(F.col("shared") > F.col("_n") * share).select("a", "b", "shared")
