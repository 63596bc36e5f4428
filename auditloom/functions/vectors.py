"""Array arithmetic and position-wise aggregates over ``array<double>`` columns.

Group sums use one aggregate per position, so partial sums are combined map-side and no row is
exploded into its components.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-12


def dim_of(df: DataFrame, vec: str = "vec") -> int:
    """Length of the vectors, read from one row."""
    row = df.filter(F.col(vec).isNotNull()).select(F.size(vec).alias("n")).first()
    return int(row["n"]) if row else 0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a, b) -> Column:
    return total(F.zip_with(_c(a), _c(b), lambda x, y: x * y))


def norm(a) -> Column:
    return F.sqrt(total(F.transform(_c(a), lambda x: x * x)))


def subtract(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x - y)


def add(a, b) -> Column:
    return F.zip_with(_c(a), _c(b), lambda x, y: x + y)


def scale(a, factor: Column) -> Column:
    return F.transform(_c(a), lambda x: x * factor)


def l2(a, b) -> Column:
    return F.sqrt(total(F.zip_with(_c(a), _c(b), lambda x, y: (x - y) * (x - y))))


def cosine(a, b) -> Column:
    return dot(a, b) / ((norm(a) + EPS) * (norm(b) + EPS))


def hamming(a, b) -> Column:
    """Share of positions that differ."""
    differ = F.zip_with(_c(a), _c(b), lambda x, y: F.when(x == y, 0.0).otherwise(1.0))
    return total(differ) / F.size(_c(a))


def unit(a) -> Column:
    """L2-normalised vector; a zero vector stays zero."""
    length = F.array(norm(a) + EPS)  # evaluated once per row
    return F.get(F.transform(length, lambda n: F.transform(_c(a), lambda x: x / n)), F.lit(0))


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def _at(vec: str, i: int) -> Column:
    return F.get(F.col(vec), F.lit(i))


def sum_vector(df: DataFrame, group: list[str], vec: str, dim: int, out: str, weight: str | None = None) -> DataFrame:
    """Weighted position-wise sum per group, with the weight total as ``<out>_weight``."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    sums = [F.sum(_at(vec, i) * w).alias(f"_s{i}") for i in range(dim)]
    grouped = df.groupBy(*group).agg(F.sum(w).alias(f"{out}_weight"), *sums)
    return grouped.select(*group, F.array(*[F.col(f"_s{i}") for i in range(dim)]).alias(out), f"{out}_weight")


def mean_vector(df: DataFrame, group: list[str], vec: str, dim: int, out: str, weight: str | None = None) -> DataFrame:
    summed = sum_vector(df, group, vec, dim, out, weight)
    return summed.withColumn(out, F.transform(out, lambda x: x / F.col(f"{out}_weight"))).drop(f"{out}_weight")


def global_mean(df: DataFrame, vec: str, dim: int) -> Column:
    """Mean vector of the whole table as a scalar subquery (one row)."""
    return mean_vector(df, [], vec, dim, "center").scalar()


def position_stats(df: DataFrame, vec: str, dim: int) -> DataFrame:
    """One row: position-wise mean and population standard deviation."""
    means = [F.avg(_at(vec, i)) for i in range(dim)]
    stds = [F.stddev_pop(_at(vec, i)) for i in range(dim)]
    return df.agg(F.array(*means).alias("mean"), F.array(*stds).alias("std"))


def z_scores(df: DataFrame, vec: str, dim: int, out: str, reference: DataFrame | None = None) -> DataFrame:
    """Position-wise z-score against the reference rows (the table itself by default)."""
    stats = position_stats(reference if reference is not None else df, vec, dim)
    placed = df.withColumns({"_mean": stats.select("mean").scalar(), "_std": stats.select("std").scalar()})
    centred = F.zip_with(F.col(vec), F.col("_mean"), lambda x, m: x - m)
    scaled = F.zip_with(centred, F.col("_std"), lambda x, s: F.when(s > 0, x / s).otherwise(F.lit(0.0)))
    return placed.withColumn(out, scaled).drop("_mean", "_std")


def as_rows(df: DataFrame, keys: list[str], vec: str, value: str = "x", places: int = 6) -> DataFrame:
    """Long form ``keys, i, value`` of a vector column, rounded."""
    return df.select(*keys, F.posexplode(vec).alias("i", value)).withColumn(value, F.round(value, places))
