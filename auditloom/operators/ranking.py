"""Exact positions inside ordered groups of any size, and joins that survive hot keys.

A plain ``row_number`` window sorts every group in one task. ``ordered_positions`` range-partitions
the rows by (group, order) instead, so one huge group is spread over many tasks, and adds the sizes of
the preceding partitions to a local running count.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from auditloom.session import cut


def top_per_group(df: DataFrame, group: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First ``k`` rows per group. Spark limits each group map-side, so only k rows per task move."""
    window = W.partitionBy(*group).orderBy(*order) if group else W.orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= k)


def ordered_positions(
    df: DataFrame,
    group: list[str],
    order: list[Column],
    position: str = "position",
    weight: str | None = None,
    before: str | None = None,
    partitions: int | None = None,
) -> DataFrame:
    """Add the 1-based ``position`` of each row in its group (``order`` must be unique in the group).

    With ``weight`` and ``before`` the exclusive running sum of the weight column is added too.
    """
    keys = [F.col(g) for g in group]
    # without a fixed number adaptive execution merges neighbouring ranges of small tables
    ranged = df.repartitionByRange(partitions, *keys, *order) if partitions else df.repartitionByRange(*keys, *order)
    placed = cut(ranged.withColumn("_part", F.spark_partition_id()))
    local = W.partitionBy("_part", *group).orderBy(*order)
    out = placed.withColumn("_local", F.row_number().over(local))
    sizes = [F.count(F.lit(1)).alias("_n")]
    if weight:
        running = local.rowsBetween(W.unboundedPreceding, -1)
        out = out.withColumn("_wlocal", F.coalesce(F.sum(weight).over(running), F.lit(0)))
        sizes.append(F.sum(weight).alias("_w"))
    totals = placed.groupBy("_part", *group).agg(*sizes)
    preceding = W.partitionBy(*group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.withColumn("_offset", F.coalesce(F.sum("_n").over(preceding), F.lit(0)))
    if weight:
        offsets = offsets.withColumn("_woffset", F.coalesce(F.sum("_w").over(preceding), F.lit(0)))
        offsets = offsets.drop("_w")
    renamed = reduce(lambda d, g: d.withColumnRenamed(g, f"_g_{g}"), group, offsets.drop("_n"))
    renamed = renamed.withColumnRenamed("_part", "_g__part")
    match = [F.col("_part") == F.col("_g__part")] + [F.col(g).eqNullSafe(F.col(f"_g_{g}")) for g in group]
    out = out.join(renamed, reduce(lambda a, b: a & b, match))
    out = out.withColumn(position, F.col("_local") + F.col("_offset"))
    drop = ["_part", "_local", "_offset", "_g__part", *[f"_g_{g}" for g in group]]
    if weight:
        out = out.withColumn(before, F.col("_wlocal") + F.col("_woffset"))
        drop += ["_wlocal", "_woffset"]
    return out.drop(*drop)


def exact_percentiles(df: DataFrame, group: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Linear-interpolation percentiles per group; equal values are counted once before ordering."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("_c"))
    placed = ordered_positions(counted, group, [F.col(value)], weight="_c", before="_before")
    totals = counted.groupBy(*group).agg(F.sum("_c").alias("_total"))
    if group:
        joined = placed.join(totals, group)
    else:
        joined = placed.withColumn("_total", counted.agg(F.sum("_c")).scalar())
    picks = []
    for name, share in shares.items():
        at = F.lit(share) * (F.col("_total") - 1)
        for side, index in (("lo", F.floor(at)), ("hi", F.ceil(at))):
            hit = (F.col("_before") <= index) & (index < F.col("_before") + F.col("_c"))
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"_{name}_{side}"))
        picks.append(F.max(at - F.floor(at)).alias(f"_{name}_frac"))
    grouped = joined.groupBy(*group).agg(*picks)
    cols = [
        (F.col(f"_{n}_lo") + (F.col(f"_{n}_hi") - F.col(f"_{n}_lo")) * F.col(f"_{n}_frac")).alias(n) for n in shares
    ]
    return grouped.select(*group, *cols)


def hot_keys(df: DataFrame, on: list[str], share: float = 1e-3, at_least: int = 100_000) -> list[tuple]:
    """Keys that hold more than ``share`` of the rows: at most 1/share of them, whatever the data size."""
    counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_n"))
    big = counts.filter(F.col("_n") >= at_least)
    total = df.count()
    found = big.filter(F.col("_n") > F.lit(share * total)).limit(int(1 / share) + 1).collect()
    return [tuple(r[c] for c in on) for r in found]


def salted_join(
    big: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "inner",
    salts: int = 64,
    at_least: int = 100_000,
    hot: list[tuple] | None = None,
) -> DataFrame:
    """Join a table with possible hot keys to a lookup table, spreading only the hot keys.

    Rows of a hot key are split over ``salts`` buckets and the matching lookup rows are repeated that
    many times; all other rows keep bucket 0, so nothing is repeated for them. ``hot`` may be given by
    callers that join the same keys again and again.
    """
    hot = hot_keys(big, on, at_least=at_least) if hot is None else hot
    if not hot:
        return big.join(lookup, on, how)
    spark = big.sparkSession
    schema = big.select(*on).schema
    flags = F.broadcast(spark.createDataFrame(hot, schema).withColumn("_hot", F.lit(True)))
    spread = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    left = big.join(flags, on, "left")
    left = left.withColumn("_salt", F.when(F.col("_hot"), spread).otherwise(F.lit(0))).drop("_hot")
    right = lookup.join(flags, on, "left")
    repeat = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    right = right.withColumn("_salt", F.explode(repeat)).drop("_hot")
    return left.join(right, [*on, "_salt"], how).drop("_salt")
