"""Decayed histograms, sketches and carried vectors as batch jobs."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.functions.hashing import hash60, unit_draw
from auditloom.operators.ranking import ordered_positions, top_per_group

_FLOOR = 1e-12


def decayed_histogram(bins: DataFrame, rate_per_second: float, window_us: int, max_bins: int = 20_000) -> DataFrame:
    """``snapshot_id, label, weight, last_us``: sum of exp(-rate * age) at the end of each window.

    ``bins(snapshot_id, label, ts_us)`` with window numbers of ``window_us`` length. Events of earlier
    windows count too: each window's partial sum is sent, decayed, to the later windows it still matters for
    (weight at least 1e-12), among the windows that have events. The newest ``max_bins`` labels are kept.
    """
    age = (F.lit(1.0) * (F.col("snapshot_id") + 1) * window_us - F.col("ts_us")) / 1e6
    partial = bins.groupBy("snapshot_id", "label").agg(
        F.sum(F.exp(-rate_per_second * age)).alias("_w"), F.max("ts_us").alias("last_us")
    )
    step = window_us / 1e6
    reach = int(math.ceil(-math.log(_FLOOR) / (rate_per_second * step)))
    sent = partial.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(reach))))
    sent = sent.withColumn("_w", F.col("_w") * F.exp(-rate_per_second * step * F.col("_k")))
    sent = sent.withColumn("snapshot_id", F.col("snapshot_id") + F.col("_k"))
    sums = sent.groupBy("snapshot_id", "label").agg(F.sum("_w").alias("weight"), F.max("last_us").alias("last_us"))
    present = bins.select("snapshot_id").distinct()
    kept = sums.filter(F.col("weight") >= _FLOOR).join(present, "snapshot_id", "left_semi")
    return top_per_group(kept, ["snapshot_id"], [F.desc("last_us"), F.col("label")], max_bins, "_r").drop("_r")


def histogram_sketch(hist: DataFrame, by: list[str], slots: int, seed: int = 0) -> DataFrame:
    """Consistent weighted sampling: per slot the label with the smallest key, as a 60-bit code.

    ``hist(by, label, weight)``; two histograms agree in a slot with a chance equal to their weighted
    overlap. Slots are found with a map-side minimum.
    """
    rows = hist.filter(F.col("weight") > 0).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    u = [F.greatest(unit_draw(F.col("label"), F.col("slot"), seed, j), F.lit(1e-18)) for j in range(5)]
    rows = rows.withColumns({"_r": -F.log(u[0]) - F.log(u[1]), "_c": -F.log(u[2]) - F.log(u[3]), "_b": u[4]})
    t = F.floor(F.log("weight") / F.col("_r") + F.col("_b"))
    y = F.exp(F.col("_r") * (t - F.col("_b")))
    score = F.col("_c") / (y * F.exp("_r"))
    best = rows.groupBy(*by, "slot").agg(F.min_by("label", F.struct(score, F.col("label"))).alias("label"))
    return best.select(*by, "slot", hash60(F.col("label")).alias("code"))


def carried_vectors(rows: DataFrame, key: str, order: str, vec: str, alpha: float) -> DataFrame:
    """h_t = alpha * z_t + (1 - alpha) * h_{t-1} per key, from zero: ``key, order, vec``.

    Rows are cut into chunks of one reach, the number of steps after which a vector's share falls below
    1e-12. A chunk needs only itself and the chunk before, so groups stay small however long a key is.
    """
    reach = max(1, int(math.ceil(math.log(_FLOOR) / math.log(1 - alpha))))
    placed = ordered_positions(rows.select(key, order, vec), [key], [F.col(order)], "_i")
    chunk = F.expr(f"(_i - 1) div {reach}")
    sent = placed.withColumn("_own", chunk).withColumn("_chunk", F.explode(F.array(F.expr("_own"), F.expr("_own + 1"))))
    packed = sent.groupBy(key, "_chunk").agg(
        F.sort_array(F.collect_list(F.struct("_i", "_own", order, F.col(vec).alias("v")))).alias("_s")
    )
    kind = packed.schema["_s"].dataType.elementType["v"].dataType.simpleString()
    start = F.struct(
        F.expr("array()").cast(f"array<struct<o:{rows.schema[order].dataType.simpleString()},c:bigint,h:{kind}>>").alias("out"),
        F.lit(None).cast(kind).alias("h"),
    )

    def advance(acc, s):
        fresh = F.when(acc["h"].isNull(), F.transform(s["v"], lambda z: alpha * z)).otherwise(
            F.zip_with(s["v"], acc["h"], lambda z, h: alpha * z + (1 - alpha) * h)
        )
        entry = F.struct(s[order].alias("o"), s["_own"].alias("c"), fresh.alias("h"))
        return F.struct(F.concat(acc["out"], F.array(entry)).alias("out"), fresh.alias("h"))

    done = packed.withColumn("_r", F.aggregate("_s", start, advance)).select(key, "_chunk", F.explode("_r.out").alias("_e"))
    own = done.filter(F.col("_e.c") == F.col("_chunk"))
    return own.select(key, F.col("_e.o").alias(order), F.col("_e.h").alias(vec))
