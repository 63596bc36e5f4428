"""Deviation, thresholds, ranks, classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions import vectors as V
from auditloom.operators.ranking import exact_percentiles, ordered_positions


def distance(vec, center, metric: str = "cosine") -> Column:
    return V.l2(vec, center) if metric == "l2" else 1.0 - V.cosine(vec, center)


def deviation(df: DataFrame, vec: str, dim: int, reference: Column | None = None, metric: str = "cosine") -> DataFrame:
    """``dev`` of every row from the mean of the reference rows (all rows by default)."""
    base = df if reference is None else df.filter(reference)
    placed = df.withColumn("_center", V.global_mean(base, vec, dim))
    return placed.withColumn("dev", distance(vec, "_center", metric)).drop("_center")


def top_k_labels(df: DataFrame, key: str, k: int, score: str = "dev") -> DataFrame:
    """``pred`` = 1 for the k rows with the highest score (ties by key), k clipped at 0."""
    top = df.orderBy(F.desc(score), F.col(key)).limit(max(0, k)).select(key).withColumn("_top", F.lit(1))
    return df.join(top, key, "left").withColumn("pred", F.coalesce("_top", F.lit(0))).drop("_top")


def top_k_deviation(df: DataFrame, key: str, vec: str, dim: int, k: int, standardise: bool = False) -> DataFrame:
    """Distance from the batch mean, the k farthest rows are positive."""
    if standardise:
        df = V.z_scores(df, vec, dim, "_z")
        vec = "_z"
    out = top_k_labels(deviation(df, vec, dim, metric="l2"), key, k)
    return out.drop("_z") if standardise else out


def with_index(df: DataFrame, group: list[str], order: list[Column], name: str = "idx") -> DataFrame:
    """Dense 1-based index in time order; neighbours are then found by joins on the index."""
    return ordered_positions(df, group, order, position=name)


def previous(df: DataFrame, group: list[str], columns: dict[str, str], idx: str = "idx") -> DataFrame:
    """Columns of the preceding row (by dense index), null for the first."""
    before = df.select(*group, (F.col(idx) + 1).alias(idx), *[F.col(c).alias(n) for c, n in columns.items()])
    return df.join(before, [*group, idx], "left")


def step_deviation(df: DataFrame, group: list[str], vec: str, metric: str = "cosine") -> DataFrame:
    """Distance to the preceding row, 0 for the first; needs a dense ``idx``."""
    linked = previous(df, group, {vec: "_before"})
    dev = F.when(F.col("_before").isNull(), F.lit(0.0)).otherwise(distance(vec, "_before", metric))
    return linked.withColumn("step_dev", dev).drop("_before")


def moving_average(df: DataFrame, group: list[str], value: str, width: int, out: str = "smooth") -> DataFrame:
    """Centred moving average with zero padding; the width must be odd.

    Each row adds its value to the ``width`` windows it belongs to, so the work is a plain aggregate
    and no group is sorted in one task.
    """
    if width % 2 == 0:
        raise ValueError("the window width must be odd")
    half = width // 2
    shares = df.select(*group, F.explode(F.sequence(F.col("idx") - half, F.col("idx") + half)).alias("idx"), value)
    sums = shares.groupBy(*group, "idx").agg((F.sum(value) / F.lit(float(width))).alias(out))
    return df.join(sums, [*group, "idx"])


def sigma_flags(df: DataFrame, value: str, reference: Column) -> DataFrame:
    """0, 1 or 2: how many of mean+sd and mean+2sd of the reference segment are exceeded."""
    base = df.filter(reference)
    mean = base.agg(F.avg(value)).scalar()
    std = base.agg(F.stddev_pop(value)).scalar()
    df = df.withColumns({"_mean": mean, "_std": std})
    above = (F.col(value) > F.col("_mean") + F.col("_std")).cast("int")
    far = (F.col(value) > F.col("_mean") + 2 * F.col("_std")).cast("int")
    return df.withColumn("level", above + far).drop("_mean", "_std")


def sequences(df: DataFrame, group: list[str], vec: str, length: int, dim: int) -> DataFrame:
    """Sliding sequences of ``length`` vectors ending at ``idx``; a short group is zero-padded once.

    Every vector is sent to the at most ``length`` sequences it belongs to.
    """
    n = df.groupBy(*group).agg(F.max("idx").alias("_n"))
    sent = df.select(*group, "idx", vec).withColumn(
        "_end", F.explode(F.sequence(F.col("idx"), F.col("idx") + (length - 1)))
    )
    sent = sent.join(n, group) if group else sent.withColumn("_n", df.agg(F.max("idx")).scalar())
    short = F.col("_n") < length
    sent = sent.filter((F.col("_end") >= length) & ((F.col("_end") <= F.col("_n")) | (short & (F.col("_end") == length))))
    packed = sent.groupBy(*group, "_end").agg(
        F.sort_array(F.collect_list(F.struct("idx", F.col(vec).alias("v")))).alias("_s"), F.max("_n").alias("_n")
    )
    body = F.transform("_s", lambda s: s["v"])
    padding = F.array_repeat(V.zeros(dim), F.lit(length) - F.size(body))
    end = F.least(F.col("_end"), F.col("_n")).alias("idx")
    return packed.select(*group, end, F.concat(body, padding).alias("sequence"), F.element_at(body, -1).alias("target"))


def history(df: DataFrame, group: list[str], vec: str, length: int, dim: int) -> DataFrame:
    """The ``length`` vectors before each row, zero-padded in front; the first row repeats itself."""
    sent = df.select(*group, F.col("idx").alias("_from"), F.col(vec).alias("_v")).withColumn(
        "idx", F.explode(F.sequence(F.col("_from") + 1, F.col("_from") + length))
    )
    packed = sent.groupBy(*group, "idx").agg(F.sort_array(F.collect_list(F.struct("_from", "_v"))).alias("_s"))
    joined = df.join(packed, [*group, "idx"], "left")
    past = F.transform("_s", lambda s: s["_v"])
    padded = F.concat(F.array_repeat(V.zeros(dim), F.lit(length) - F.size(past)), past)
    first = F.array_repeat(F.col(vec), length)
    return joined.withColumn("history", F.when(F.col("_s").isNull(), first).otherwise(padded)).drop("_s")


def prediction_error(df: DataFrame, group: list[str], vec: str, length: int, dim: int, threshold: float) -> DataFrame:
    """Mean squared error of predicting each vector by the mean of its history; above the threshold is 1."""
    past = history(df, group, vec, length, dim)
    summed = F.aggregate("history", V.zeros(dim), lambda acc, v: F.zip_with(acc, v, lambda a, b: a + b))
    guess = F.transform(summed, lambda x: x / F.lit(float(length)))
    diff = F.zip_with(guess, F.col(vec), lambda a, b: (a - b) * (a - b))
    out = past.withColumn("error", V.total(diff) / F.lit(float(dim))).drop("history")
    return out.withColumn("pred", (F.col("error") > threshold).cast("int"))


# ---- ranks --------------------------------------------------------------------------------------
def deviation_ranks(nodes: DataFrame, group: str, name: str, dev: str = "dev") -> DataFrame:
    """Rank (1 = farthest) and rank percent of every node in its snapshot."""
    ranked = ordered_positions(nodes, [group], [F.desc(dev), F.col(name)], position="rank")
    size = nodes.groupBy(group).agg(F.count(F.lit(1)).alias("n_nodes"))
    return ranked.join(size, group).withColumn("rank_pct", F.col("rank") / F.col("n_nodes") * 100.0)


def rank_summary(ranked: DataFrame, group: str, name: str, label: str = "label", dev: str = "dev") -> DataFrame:
    """Per snapshot with malicious nodes: their mean rank percent, mean deviation, extreme nodes."""
    bad = F.col(label) == 1
    return (
        ranked.groupBy(group)
        .agg(
            F.count_if(bad).alias("n_malicious"),
            F.count(F.lit(1)).alias("n_nodes"),
            F.avg(F.when(bad, F.col("rank_pct"))).alias("mean_rank_pct"),
            F.avg(dev).alias("mean_dev"),
            F.min_by(name, F.struct(-F.col(dev), F.col(name))).alias("max_node"),
            F.min_by(name, F.struct(F.col(dev), F.col(name))).alias("min_node"),
        )
        .filter(F.col("n_malicious") > 0)
    )


def auc(scored: DataFrame, group: list[str], score: str, label: str) -> DataFrame:
    """Area under the ROC curve by average ranks; groups with a single class are skipped.

    Equal scores are counted first, so the running count works on distinct scores only.
    """
    counted = scored.groupBy(*group, score).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(F.col(label).cast("long")).alias("_pos")
    )
    placed = ordered_positions(counted, group, [F.col(score)], weight="_n", before="_before")
    rank_sum = F.sum((F.col("_before") + (F.col("_n") + 1) / 2.0) * F.col("_pos"))
    out = placed.groupBy(*group).agg(rank_sum.alias("_r"), F.sum("_pos").alias("n_pos"), F.sum("_n").alias("_n"))
    out = out.withColumn("n_neg", F.col("_n") - F.col("n_pos")).filter((F.col("n_pos") > 0) & (F.col("n_neg") > 0))
    pairs = F.col("n_pos") * F.col("n_neg")
    value = (F.col("_r") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / pairs
    return out.withColumn("auc", value).drop("_r", "_n")


def median_rank_share(ranked: DataFrame, group: str, label: str = "label") -> DataFrame:
    """Median 0-based rank of the labelled nodes as a percent of the group size."""
    hits = ranked.filter(F.col(label) == 1).withColumn("_r", (F.col("rank") - 1).cast("double"))
    medians = exact_percentiles(hits, [group], "_r", {"_median": 0.5})
    sizes = ranked.groupBy(group).agg(F.count(F.lit(1)).alias("n_nodes"))
    share = F.col("_median") / F.col("n_nodes") * 100.0
    return medians.join(sizes, group).select(group, share.alias("median_rank_pct"))


def above_percentile(df: DataFrame, value: str, reference: Column, share: float = 0.99) -> DataFrame:
    """``above`` = 1 when the value exceeds the percentile of the reference rows."""
    limit = exact_percentiles(df.filter(reference), [], value, {"limit": share}).scalar()
    return df.withColumn("limit", limit).withColumn("above", (F.col(value) > F.col("limit")).cast("int"))


def attack_distance_summary(nodes: DataFrame, group: str, value: str, reference: Column, label: str = "label"):
    """Per snapshot with attack nodes: mean and max distance of both classes, attack nodes above benign p99."""
    flagged = above_percentile(nodes, value, reference)
    bad = F.col(label) == 1
    return (
        flagged.groupBy(group)
        .agg(
            F.count_if(bad).alias("n_attack"),
            F.avg(F.when(bad, F.col(value))).alias("attack_mean"),
            F.max(F.when(bad, F.col(value))).alias("attack_max"),
            F.avg(F.when(~bad, F.col(value))).alias("benign_mean"),
            F.max(F.when(~bad, F.col(value))).alias("benign_max"),
            F.count_if(bad & (F.col("above") == 1)).alias("attack_above_p99"),
        )
        .filter(F.col("n_attack") > 0)
    )


def push_from_center(df: DataFrame, vec: str, dim: int, target: Column, alpha: float, renormalise: bool = True):
    """Move the target vectors away from the centre by ``alpha`` and report the deviation before and after."""
    df = df.withColumn("_center", V.global_mean(df, vec, dim))
    away = V.unit(V.subtract(vec, "_center"))
    moved = V.add(vec, V.scale(away, F.lit(alpha)))
    pushed = V.unit(moved) if renormalise else moved
    out = df.withColumn("_pushed", F.when(target, pushed).otherwise(F.col(vec)))
    return (
        out.withColumn("before_dev", distance(vec, "_center"))
        .withColumn("after_dev", distance("_pushed", "_center"))
        .withColumn(vec, F.col("_pushed"))
        .drop("_center", "_pushed")
    )


# ---- medoid clusters ----------------------------------------------------------------------------
def medoid_clusters(df: DataFrame, key: str, vec: str, k: int, rounds: int = 5, candidates: int = 32) -> DataFrame:
    """k medoids under Hamming distance: assign, then replace each medoid by the best of its candidates.

    A candidate is one of the ``candidates`` members closest to the cluster's position-wise most common
    value; all distances needed are rows x (k * candidates), never rows x rows.
    """
    from auditloom.operators.ranking import top_per_group
    from auditloom.session import cut

    base = df.select(F.col(key).alias("_id"), F.col(vec).alias("_v"))
    seeds = base.orderBy(F.md5(F.col("_id").cast("string")), "_id").limit(k).collect()
    spark = df.sparkSession
    schema = "cluster int, medoid_id bigint, medoid " + base.schema["_v"].dataType.simpleString()
    medoids = [(i, int(r["_id"]), list(r["_v"])) for i, r in enumerate(seeds)]
    assigned = None
    for _ in range(rounds):
        centre = F.broadcast(spark.createDataFrame(medoids, schema))
        assigned = assign_medoids(base, "_id", "_v", centre)
        mode = (
            assigned.select("cluster", F.posexplode("_v").alias("i", "x"))
            .groupBy("cluster", "i", "x").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("cluster", "i").agg(F.max_by("x", F.struct("n", "x")).alias("x"))
            .groupBy("cluster").agg(F.sort_array(F.collect_list(F.struct("i", "x"))).alias("m"))
            .select("cluster", F.transform("m", lambda s: s["x"]).alias("mode"))
        )
        near = assigned.join(F.broadcast(mode), "cluster").withColumn("_dm", V.hamming("_v", "mode"))
        picks = top_per_group(near, ["cluster"], [F.col("_dm"), F.col("_id")], candidates)
        picks = cut(picks.select("cluster", F.col("_id").alias("cand_id"), F.col("_v").alias("cand")))
        cost = assigned.join(F.broadcast(picks), "cluster").groupBy("cluster", "cand_id").agg(
            F.sum(V.hamming("_v", "cand")).alias("cost")
        )
        best = cost.groupBy("cluster").agg(F.min_by("cand_id", F.struct("cost", "cand_id")).alias("cand_id"))
        rows = best.join(picks, ["cluster", "cand_id"]).orderBy("cluster").collect()
        fresh = [(int(r["cluster"]), int(r["cand_id"]), list(r["cand"])) for r in rows]
        if [m[1] for m in fresh] == [m[1] for m in medoids]:
            break
        medoids = fresh
    assigned = assign_medoids(base, "_id", "_v", F.broadcast(spark.createDataFrame(medoids, schema)))
    stats = assigned.groupBy("cluster").agg(
        F.avg("dist").alias("mean"), F.max("dist").alias("max"), F.stddev_pop("dist").alias("std"),
        F.count(F.lit(1)).alias("size"),
    )
    return spark.createDataFrame(medoids, schema).join(stats, "cluster")


def assign_medoids(df: DataFrame, key: str, vec: str, medoids: DataFrame) -> DataFrame:
    """Closest of the k medoids per row (k rows, broadcast)."""
    packed = medoids.agg(F.sort_array(F.collect_list(F.struct("cluster", "medoid"))).alias("m")).scalar()
    scored = F.transform(F.col("_m"), lambda s: F.struct(V.hamming(F.col(vec), s["medoid"]).alias("dist"), s["cluster"]))
    best = df.withColumn("_m", packed).withColumn("_best", F.array_min(scored))
    return best.withColumns({"dist": F.col("_best.dist"), "cluster": F.col("_best.cluster")}).drop("_m", "_best")


def medoid_test(df: DataFrame, key: str, vec: str, clusters: DataFrame, stds: float = 1.0, limit: float = 0.9):
    """Normal when any cluster is near enough; abnormal anyway when the mean distance exceeds ``limit``."""
    entry = F.struct("cluster", "medoid", "mean", "max", F.coalesce("std", F.lit(0.0)).alias("std"))
    packed = clusters.agg(F.sort_array(F.collect_list(entry)).alias("m")).scalar()
    dists = F.transform(
        F.col("_m"),
        lambda s: F.struct(
            V.hamming(F.col(vec), s["medoid"]).alias("d"),
            (s["mean"] + stds * s["std"]).alias("a"),
            (s["max"] + stds * s["std"]).alias("b"),
        ),
    )
    out = df.withColumn("_m", packed).withColumn("_d", dists)
    near = F.exists("_d", lambda s: (s["d"] <= s["a"]) & (s["d"] <= s["b"]))
    score = V.total(F.transform("_d", lambda s: s["d"])) / F.size("_d")
    out = out.withColumn("score", score).withColumn("pred", (~near | (F.col("score") > limit)).cast("int"))
    return out.drop("_m", "_d")


def train_classifier(df: DataFrame, vec: str, label: str, dim: int, hidden: int = 128, iterations: int = 50, seed: int = 7):
    """Two-layer perceptron on explicit labels (balance the classes first, see ``augment.balanced``)."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    data = df.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    trainer = MultilayerPerceptronClassifier(layers=[dim, hidden, 2], maxIter=iterations, seed=seed, blockSize=128)
    return trainer.fit(data)


def classify(model, df: DataFrame, vec: str) -> DataFrame:
    """``pred`` and the probability of class 1 as ``score``."""
    from pyspark.ml.functions import array_to_vector, vector_to_array

    scored = model.transform(df.withColumn("features", array_to_vector(vec)))
    scored = scored.withColumn("score", vector_to_array("probability")[1]).withColumn("pred", F.col("prediction").cast("int"))
    return scored.drop("features", "rawPrediction", "probability", "prediction")
