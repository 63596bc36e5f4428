"""Vector statistics, deviation, ranks, windows, top-k and detection over the embeddings table."""

from __future__ import annotations

from pyspark.sql import functions as F

from auditloom.functions import vectors as X
from auditloom.functions.hashing import hash60, unit_draw
from auditloom.operators import augment, detect, features, metrics, ranking, snapshots
from auditloom.plans import views as v
from auditloom.plans.registry import query

DIM = v.DIM


@query(
    "ag21_group_mean",
    v.with_ctes(v.VEC, "SELECT label, i, round(avg(x), 6) AS x FROM vec GROUP BY 1, 2"),
)
def ag21_group_mean(spark, sf):
    means = X.mean_vector(v.vectors(spark, sf), ["label"], "vec", DIM, "center")
    return X.as_rows(means, ["label"], "center")


@query(
    "ag22_z_scores",
    v.with_ctes(
        v.VEC,
        """SELECT vec_id, i, round((x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i), 6) AS x FROM vec""",
    ),
)
def ag22_z_scores(spark, sf):
    z = X.z_scores(v.vectors(spark, sf), "vec", DIM, "z")
    return X.as_rows(z, ["vec_id"], "z")


DEV = """cen AS (SELECT i, avg(x) AS c FROM vec WHERE is_attack = 0 GROUP BY 1),
devs AS (SELECT vec_id, snapshot_id, label, is_attack, sqrt(sum((x - c) * (x - c))) AS dev,
  1 - sum(x * c) / ((sqrt(sum(x * x)) + 1e-12) * (sqrt(sum(c * c)) + 1e-12)) AS cosdev
  FROM vec JOIN cen USING (i) GROUP BY 1, 2, 3, 4)"""


def deviations(spark, sf, metric="l2"):
    """Distance of every vector from the mean of the benign ones."""
    return detect.deviation(v.vectors(spark, sf), "vec", DIM, F.col("is_attack") == 0, metric)


@query(
    "ag23_percentiles",
    v.with_ctes(
        v.VEC,
        DEV,
        """SELECT round(quantile_cont(dev, 0.95), 6) AS p95, round(quantile_cont(dev, 0.99), 6) AS p99 FROM devs WHERE is_attack = 0""",
    ),
)
def ag23_percentiles(spark, sf):
    d = deviations(spark, sf).filter("is_attack = 0")
    out = ranking.exact_percentiles(d, [], "dev", {"p95": 0.95, "p99": 0.99})
    return out.select(F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"))


@query(
    "ag23_percentiles_by_snapshot",
    v.with_ctes(
        v.VEC, DEV, "SELECT snapshot_id, round(quantile_cont(dev, 0.95), 6) AS p95, round(quantile_cont(dev, 0.5), 6) AS p50 FROM devs GROUP BY 1"
    ),
)
def ag23_percentiles_by_snapshot(spark, sf):
    out = ranking.exact_percentiles(deviations(spark, sf), ["snapshot_id"], "dev", {"p95": 0.95, "p50": 0.5})
    return out.select("snapshot_id", F.round("p95", 6).alias("p95"), F.round("p50", 6).alias("p50"))


@query(
    "ag24_ensemble_mean",
    v.with_ctes(v.VEC, "SELECT snapshot_id, i, round(avg(x), 6) AS x FROM vec GROUP BY 1, 2"),
)
def ag24_ensemble_mean(spark, sf):
    """Vectors of one snapshot stand for the embeddings of several seeds."""
    means = X.mean_vector(v.vectors(spark, sf), ["snapshot_id"], "vec", DIM, "center")
    return X.as_rows(means, ["snapshot_id"], "center")


@query(
    "dt1_center_deviation",
    v.with_ctes(v.VEC, DEV, "SELECT vec_id, round(cosdev, 6) AS cosine_dev, round(dev, 6) AS l2_dev FROM devs"),
)
def dt1_center_deviation(spark, sf):
    a = deviations(spark, sf, "cosine").select("vec_id", F.round("dev", 6).alias("cosine_dev"))
    return a.join(deviations(spark, sf).select("vec_id", F.round("dev", 6).alias("l2_dev")), "vec_id")


ZDEV = """z AS (SELECT vec_id, i, (x - avg(x) OVER (PARTITION BY i)) / stddev_pop(x) OVER (PARTITION BY i) AS x FROM vec),
zdev AS (SELECT vec_id, sqrt(sum(x * x)) AS dev FROM z GROUP BY 1)"""


@query(
    "dt2_topk_deviation",
    v.with_ctes(
        v.VEC,
        ZDEV,
        """SELECT vec_id, round(dev, 6) AS dev, CASE WHEN row_number() OVER (ORDER BY round(dev, 9) DESC, vec_id) <= 25 THEN 1 ELSE 0 END
             AS pred FROM zdev""",
    ),
)
def dt2_topk_deviation(spark, sf):
    z = X.z_scores(v.vectors(spark, sf), "vec", DIM, "z").select("vec_id", "z")
    scored = detect.deviation(z, "z", DIM, metric="l2").withColumn("score", F.round("dev", 9))
    out = detect.top_k_labels(scored, "vec_id", 25, "score")
    return out.select("vec_id", F.round("dev", 6).alias("dev"), "pred")


@query(
    "tk1_topk_labels",
    v.with_ctes(v.VEC, DEV, "SELECT vec_id, CASE WHEN row_number() OVER (ORDER BY round(dev, 9) DESC, vec_id) <= 30 THEN 1 ELSE 0 END AS pred FROM devs"),
)
def tk1_topk_labels(spark, sf):
    scored = deviations(spark, sf).withColumn("score", F.round("dev", 9))
    return detect.top_k_labels(scored, "vec_id", 30, "score").select("vec_id", "pred")


@query(
    "tk2_topk_per_group",
    v.with_ctes(
        v.VEC,
        DEV,
        """SELECT is_attack, vec_id, rank FROM (SELECT is_attack, vec_id, row_number() OVER (PARTITION BY is_attack ORDER BY round(dev, 9) DESC,
             vec_id)::INT AS rank FROM devs) WHERE rank <= 10""",
    ),
)
def tk2_topk_per_group(spark, sf):
    scored = deviations(spark, sf).withColumn("score", F.round("dev", 9))
    top = ranking.top_per_group(scored, ["is_attack"], [F.desc("score"), F.col("vec_id")], 10)
    return top.select("is_attack", "vec_id", "rank")


# ---- series -------------------------------------------------------------------------------------
SERIES = """sm AS (SELECT snapshot_id, i, avg(x) AS x FROM vec GROUP BY 1, 2),
idx AS (SELECT snapshot_id, row_number() OVER (ORDER BY snapshot_id) AS idx FROM (SELECT DISTINCT snapshot_id FROM sm)),
step AS (SELECT b.snapshot_id, p.idx, CASE WHEN a.snapshot_id IS NULL THEN 0 ELSE
    1 - sum(a.x * b.x) / (sqrt(sum(a.x * a.x)) * sqrt(sum(b.x * b.x))) END AS dev
  FROM sm b JOIN idx p ON b.snapshot_id = p.snapshot_id LEFT JOIN idx q ON q.idx = p.idx - 1
  LEFT JOIN sm a ON a.snapshot_id = q.snapshot_id AND a.i = b.i GROUP BY b.snapshot_id, p.idx, a.snapshot_id)"""


def series(spark, sf):
    """One mean vector per snapshot with its dense index."""
    means = X.mean_vector(v.vectors(spark, sf), ["snapshot_id"], "vec", DIM, "vec")
    return detect.with_index(means.withColumn("split", F.lit("all")), ["split"], [F.col("snapshot_id")])


def step_series(spark, sf):
    return detect.step_deviation(series(spark, sf), ["split"], "vec")


@query("wf2_step_deviation", v.with_ctes(v.VEC, SERIES, "SELECT snapshot_id, idx, round(dev, 6) AS step_dev FROM step"))
def wf2_step_deviation(spark, sf):
    return step_series(spark, sf).select("snapshot_id", "idx", F.round("step_dev", 6).alias("step_dev"))


@query(
    "wf3_moving_average",
    v.with_ctes(
        v.VEC,
        SERIES,
        """SELECT snapshot_id, round(sum(dev) OVER (ORDER BY idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5, 6) AS smooth FROM step""",
    ),
)
def wf3_moving_average(spark, sf):
    s = step_series(spark, sf).select("split", "idx", "snapshot_id", "step_dev")
    return detect.moving_average(s, ["split"], "step_dev", 5).select("snapshot_id", F.round("smooth", 6).alias("smooth"))


@query(
    "wf4_sigma_flags",
    v.with_ctes(
        v.VEC,
        SERIES,
        """SELECT snapshot_id, CASE WHEN dev > (SELECT avg(dev) + 2 * stddev_pop(dev) FROM step WHERE idx <= 25) THEN 2
             WHEN dev > (SELECT avg(dev) + stddev_pop(dev) FROM step WHERE idx <= 25) THEN 1 ELSE 0 END AS level FROM step""",
    ),
)
def wf4_sigma_flags(spark, sf):
    s = step_series(spark, sf).select("split", "idx", "snapshot_id", "step_dev")
    return detect.sigma_flags(s, "step_dev", F.col("idx") <= 25).select("snapshot_id", "level")


@query(
    "wf5_sequences",
    v.with_ctes(
        v.VEC,
        SERIES,
        """SELECT e.idx, p.idx - e.idx + 4 AS slot, s.i, round(s.x, 6) AS x FROM idx e JOIN idx p ON p.idx BETWEEN e.idx - 4 AND e.idx
           JOIN sm s ON s.snapshot_id = p.snapshot_id WHERE e.idx >= 5""",
    ),
)
def wf5_sequences(spark, sf):
    seqs = detect.sequences(series(spark, sf), ["split"], "vec", 5, DIM)
    slots = seqs.select("idx", F.posexplode("sequence").alias("slot", "v")).withColumn("slot", F.col("slot").cast("bigint"))
    return X.as_rows(slots, ["idx", "slot"], "v")


@query(
    "wf6_history",
    v.with_ctes(
        v.VEC,
        SERIES,
        """SELECT e.idx, s.i, round(sum(s.x) / 5, 6) AS x FROM idx e JOIN idx p ON (p.idx BETWEEN e.idx - 5 AND e.idx - 1)
           JOIN sm s ON s.snapshot_id = p.snapshot_id GROUP BY 1, 2
           UNION ALL SELECT 1, i, round(x, 6) FROM sm JOIN idx ON sm.snapshot_id = idx.snapshot_id WHERE idx.idx = 1""",
    ),
)
def wf6_history(spark, sf):
    past = detect.history(series(spark, sf), ["split"], "vec", 5, DIM)
    mean = F.aggregate("history", X.zeros(DIM), lambda acc, h: F.zip_with(acc, h, lambda a, b: a + b / 5))
    return X.as_rows(past.select("idx", mean.alias("m")), ["idx"], "m")


@query(
    "dt5_prediction_error",
    v.with_ctes(
        v.VEC,
        SERIES,
        """h AS (SELECT e.idx, s.i, sum(s.x) / 5 AS g FROM idx e JOIN idx p ON p.idx BETWEEN e.idx - 5 AND e.idx - 1
             JOIN sm s ON s.snapshot_id = p.snapshot_id GROUP BY 1, 2),
           er AS (SELECT e.idx, avg((s.x - coalesce(h.g, s.x)) * (s.x - coalesce(h.g, s.x))) AS error FROM idx e
             JOIN sm s ON s.snapshot_id = e.snapshot_id LEFT JOIN h ON h.idx = e.idx AND h.i = s.i GROUP BY 1)""",
        "SELECT idx, round(error, 6) AS error, CASE WHEN error > 0.0022 THEN 1 ELSE 0 END AS pred FROM er",
    ),
)
def dt5_prediction_error(spark, sf):
    out = detect.prediction_error(series(spark, sf), ["split"], "vec", 5, DIM, 0.0022)
    return out.select("idx", F.round("error", 6).alias("error"), "pred")


# ---- ranks --------------------------------------------------------------------------------------
RANKS = """rk AS (SELECT *, row_number() OVER (PARTITION BY snapshot_id ORDER BY round(dev, 9) DESC, vec_id) AS rank,
  count(*) OVER (PARTITION BY snapshot_id) AS n_nodes FROM devs)"""


def ranked(spark, sf):
    d = deviations(spark, sf).withColumn("dev", F.round("dev", 9)).select("snapshot_id", "vec_id", "dev", F.col("is_attack").alias("label"))
    return detect.deviation_ranks(d, "snapshot_id", "vec_id")


@query(
    "wf1_deviation_rank",
    v.with_ctes(v.VEC, DEV, RANKS, "SELECT snapshot_id, vec_id, rank, round(100.0 * rank / n_nodes, 6)::DOUBLE AS rank_pct FROM rk"),
)
def wf1_deviation_rank(spark, sf):
    return ranked(spark, sf).select("snapshot_id", "vec_id", "rank", F.round("rank_pct", 6).alias("rank_pct"))


@query(
    "wf1_rank_summary",
    v.with_ctes(
        v.VEC,
        DEV,
        RANKS,
        """SELECT snapshot_id, sum(is_attack)::BIGINT AS n_malicious, count(*) AS n_nodes,
             round(avg(CASE WHEN is_attack = 1 THEN 100.0 * rank / n_nodes END), 6)::DOUBLE AS mean_rank_pct,
             round(avg(round(dev, 9)), 6) AS mean_dev, arg_min(vec_id, rank) AS max_node, arg_max(vec_id, rank) AS min_node
           FROM rk GROUP BY 1 HAVING sum(is_attack) > 0""",
    ),
)
def wf1_rank_summary(spark, sf):
    out = detect.rank_summary(ranked(spark, sf), "snapshot_id", "vec_id")
    return out.withColumns({c: F.round(c, 6) for c in ("mean_rank_pct", "mean_dev")})


@query(
    "wf9_auc",
    v.with_ctes(
        v.VEC,
        DEV,
        """SELECT a.snapshot_id, count(DISTINCT a.vec_id) AS n_pos, count(DISTINCT b.vec_id) AS n_neg,
             round(avg(CASE WHEN round(a.dev, 9) > round(b.dev, 9) THEN 1.0 WHEN round(a.dev, 9) = round(b.dev, 9) THEN 0.5 ELSE 0 END), 6)::DOUBLE
               AS auc
           FROM devs a JOIN devs b ON a.snapshot_id = b.snapshot_id AND a.is_attack = 1 AND b.is_attack = 0 GROUP BY 1""",
    ),
)
def wf9_auc(spark, sf):
    d = deviations(spark, sf).withColumn("dev", F.round("dev", 9))
    out = detect.auc(d, ["snapshot_id"], "dev", "is_attack")
    return out.select("snapshot_id", "n_pos", "n_neg", F.round("auc", 6).alias("auc"))


@query(
    "wf10_median_rank",
    v.with_ctes(
        v.VEC,
        DEV,
        RANKS,
        """SELECT snapshot_id, round(quantile_cont(rank - 1, 0.5) / max(n_nodes) * 100, 6) AS median_rank_pct FROM rk
           WHERE is_attack = 1 GROUP BY 1""",
    ),
)
def wf10_median_rank(spark, sf):
    out = detect.median_rank_share(ranked(spark, sf), "snapshot_id")
    return out.select("snapshot_id", F.round("median_rank_pct", 6).alias("median_rank_pct"))


# ---- thresholds -----------------------------------------------------------------------------------
SNAPDEV = """sm AS (SELECT snapshot_id, i, avg(x) AS x, max(is_attack) AS is_attack FROM vec GROUP BY 1, 2),
sc AS (SELECT i, avg(x) AS c FROM sm WHERE snapshot_id < 30 GROUP BY 1),
sd AS (SELECT snapshot_id, max(is_attack) AS is_attack, sqrt(sum((x - c) * (x - c))) AS dev FROM sm JOIN sc USING (i) GROUP BY 1)"""


@query(
    "dt8_p99_exceedance",
    v.with_ctes(
        v.VEC,
        SNAPDEV,
        """SELECT snapshot_id, round(dev, 6) AS dev, CASE WHEN dev > (SELECT quantile_cont(dev, 0.99) FROM sd WHERE snapshot_id < 30)
             THEN 1 ELSE 0 END AS above FROM sd""",
    ),
)
def dt8_p99_exceedance(spark, sf):
    means = X.mean_vector(v.vectors(spark, sf), ["snapshot_id"], "vec", DIM, "vec")
    d = detect.deviation(means, "vec", DIM, F.col("snapshot_id") < 30, "l2")
    out = detect.above_percentile(d, "dev", F.col("snapshot_id") < 30)
    return out.select("snapshot_id", F.round("dev", 6).alias("dev"), "above")


@query(
    "dt10_attack_distances",
    v.with_ctes(
        v.VEC,
        DEV,
        """SELECT snapshot_id, sum(is_attack)::BIGINT AS n_attack, round(avg(CASE WHEN is_attack = 1 THEN dev END), 6) AS attack_mean,
             round(max(CASE WHEN is_attack = 1 THEN dev END), 6) AS attack_max, round(avg(CASE WHEN is_attack = 0 THEN dev END), 6) AS benign_mean,
             round(max(CASE WHEN is_attack = 0 THEN dev END), 6) AS benign_max,
             count(*) FILTER (WHERE is_attack = 1 AND dev > (SELECT quantile_cont(dev, 0.99) FROM devs WHERE is_attack = 0)) AS attack_above_p99
           FROM devs GROUP BY 1 HAVING sum(is_attack) > 0""",
    ),
)
def dt10_attack_distances(spark, sf):
    out = detect.attack_distance_summary(deviations(spark, sf), "snapshot_id", "dev", F.col("is_attack") == 0, "is_attack")
    return out.withColumns({c: F.round(c, 6) for c in ("attack_mean", "attack_max", "benign_mean", "benign_max")})


@query(
    "dt7_deviation_injection",
    v.with_ctes(
        v.VEC,
        """c AS (SELECT i, avg(x) AS c FROM vec GROUP BY 1),
           d AS (SELECT vec_id, label, i, x, c, x - c AS u, sqrt(sum((x - c) * (x - c)) OVER (PARTITION BY vec_id)) AS n FROM vec JOIN c USING (i)),
           p AS (SELECT vec_id, label, i, x, c, CASE WHEN label = 9 THEN x + 3.0 * u / n ELSE x END AS y FROM d)""",
        """SELECT vec_id, round(1 - sum(x * c) / (sqrt(sum(x * x)) * sqrt(sum(c * c))), 6) AS before_dev,
             round(1 - sum(y * c) / (sqrt(sum(y * y)) * sqrt(sum(c * c))), 6) AS after_dev FROM p GROUP BY 1""",
    ),
)
def dt7_deviation_injection(spark, sf):
    out = detect.push_from_center(v.vectors(spark, sf), "vec", DIM, F.col("label") == 9, 3.0)
    return out.select("vec_id", F.round("before_dev", 6).alias("before_dev"), F.round("after_dev", 6).alias("after_dev"))


# ---- medoids --------------------------------------------------------------------------------------
def slots(spark, sf):
    """Integer slots from the vectors: the rounded components."""
    e = v.vectors(spark, sf)
    return e.select("vec_id", "label", F.transform("vec", lambda x: F.floor(x * 4).cast("bigint")).alias("slots"))


@query("dt3_medoid_clusters")
def dt3_medoid_clusters(spark, sf):
    out = detect.medoid_clusters(slots(spark, sf).filter("label <> 9"), "vec_id", "slots", 4)
    return out.select("cluster", "medoid_id", "size", F.round("mean", 6).alias("mean"), F.round("max", 6).alias("max"))


SLOTS = """sl AS (SELECT vec_id, label, i, floor(x * 4)::BIGINT AS s FROM vec),
med AS (SELECT label AS cluster, min(vec_id) AS medoid_id FROM sl WHERE label < 4 GROUP BY 1),
ds AS (SELECT a.vec_id, a.label, m.cluster, avg(CASE WHEN a.s = b.s THEN 0.0 ELSE 1.0 END)::DOUBLE AS d
  FROM sl a, med m JOIN sl b ON b.vec_id = m.medoid_id WHERE a.i = b.i GROUP BY 1, 2, 3),
st AS (SELECT cluster, avg(d) AS mean, max(d) AS mx, stddev_pop(d) AS sd FROM ds WHERE label = cluster GROUP BY 1)"""


@query(
    "dt4_medoid_test",
    v.with_ctes(
        v.VEC,
        SLOTS,
        """SELECT vec_id, round(avg(d), 6) AS score, CASE WHEN max(CASE WHEN d <= mean + sd AND d <= mx + sd THEN 1 ELSE 0 END) = 0
             OR avg(d) > 0.9 THEN 1 ELSE 0 END AS pred FROM ds JOIN st USING (cluster) GROUP BY 1""",
    ),
)
def dt4_medoid_test(spark, sf):
    """Clusters given by the labels 0..3 with the first member as medoid."""
    s = slots(spark, sf)
    members = s.filter("label < 4")
    medoids = members.groupBy(F.col("label").alias("cluster")).agg(
        F.min("vec_id").alias("medoid_id"), F.min_by("slots", "vec_id").alias("medoid")
    )
    stats = members.join(medoids, members["label"] == medoids["cluster"]).withColumn("d", X.hamming("slots", "medoid"))
    stats = stats.groupBy("cluster").agg(F.avg("d").alias("mean"), F.max("d").alias("max"), F.stddev_pop("d").alias("std"))
    out = detect.medoid_test(s, "vec_id", "slots", medoids.join(stats, "cluster"))
    return out.select("vec_id", F.round("score", 6).alias("score"), "pred")


@query("dt6_supervised_classifier")
def dt6_supervised_classifier(spark, sf):
    e = v.vectors(spark, sf).select("vec_id", "vec", "is_attack")
    train = augment.balanced(e.filter("vec_id % 10 < 8"), "is_attack", ["vec_id"], 3)
    model = detect.train_classifier(train, "vec", "is_attack", DIM, hidden=32, iterations=20)
    out = detect.classify(model, e, "vec").select(F.col("is_attack").alias("y_true"), F.col("pred").alias("y_pred"))
    return metrics.evaluate(out, [])


@query(
    "dt9_outcome_listing",
    v.with_ctes(
        v.VEC,
        SNAPDEV,
        """pr AS (SELECT snapshot_id, is_attack, CASE WHEN row_number() OVER (ORDER BY round(dev, 9) DESC, snapshot_id) <= 20 THEN 1 ELSE 0 END
             AS pred FROM sd)""",
        """SELECT p.snapshot_id, CASE WHEN p.is_attack = 1 AND pred = 1 THEN 'TP' WHEN p.is_attack = 1 THEN 'FN' WHEN pred = 1 THEN 'FP'
             ELSE 'TN' END AS outcome, count(*) AS n_nodes, count(*) FILTER (WHERE x.is_attack = 1) AS n_malicious
           FROM pr p JOIN (SELECT DISTINCT vec_id, snapshot_id, is_attack FROM vec) x ON x.snapshot_id = p.snapshot_id GROUP BY 1, 2""",
    ),
)
def dt9_outcome_listing(spark, sf):
    nodes = v.vectors(spark, sf)
    means = X.mean_vector(nodes, ["snapshot_id"], "vec", DIM, "vec")
    truth = nodes.groupBy("snapshot_id").agg(F.max("is_attack").alias("y_true"))
    d = detect.deviation(means, "vec", DIM, F.col("snapshot_id") < 30, "l2").withColumn("score", F.round("dev", 9))
    pred = detect.top_k_labels(d, "snapshot_id", 20, "score").select("snapshot_id", F.col("pred").alias("y_pred"))
    listed = nodes.join(pred.join(truth, "snapshot_id"), "snapshot_id").withColumn("outcome", metrics.outcome())
    return listed.groupBy("snapshot_id", "outcome").agg(
        F.count(F.lit(1)).alias("n_nodes"), F.count_if(F.col("is_attack") == 1).alias("n_malicious")
    )


# ---- samples and splits ---------------------------------------------------------------------------
def H(*parts: str) -> str:
    """SQL of the 60-bit hash of the parts."""
    return f"('0x' || substring(md5({' || chr(124) || '.join(parts)}), 1, 15))::BIGINT"


@query(
    "tk3_frequent_nodes",
    v.with_ctes(
        v.GRAPH,
        """SELECT snapshot_id, name, rank FROM (SELECT snapshot_id, name, row_number() OVER (PARTITION BY snapshot_id
             ORDER BY frequency DESC, name)::INT AS rank FROM nodes) WHERE rank <= 5""",
    ),
)
def tk3_frequent_nodes(spark, sf):
    top = ranking.top_per_group(v.nodes(spark, sf), ["snapshot_id"], [F.desc("frequency"), F.col("name")], 5)
    return top.select("snapshot_id", "name", "rank")


@query(
    "tk4_class_balance",
    f"""WITH b AS (SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {H('doc_id', '5')}, doc_id) AS pos FROM labels),
        c AS (SELECT sum(toxic)::BIGINT AS a, sum(1 - toxic)::BIGINT AS n FROM labels),
        t AS (SELECT a, least(n, greatest(a * 2, 50)) AS target FROM c)
        SELECT doc_id, toxic, CASE WHEN toxic = 0 THEN 1 ELSE (target - pos) // a + 1 END AS copies FROM b, t WHERE pos <= target""",
)
def tk4_class_balance(spark, sf):
    lab = v.table(spark, sf, "labels").select("doc_id", "toxic")
    out = augment.balanced(lab, "toxic", ["doc_id"], 5, ratio=2, least=50)
    return out.groupBy("doc_id", "toxic").agg(F.count(F.lit(1)).alias("copies"))


@query(
    "tk5_benign_sample",
    v.with_ctes(
        v.GRAPH,
        f"""SELECT snapshot_id, name, label FROM (SELECT snapshot_id, name, label, row_number() OVER (PARTITION BY snapshot_id, label
             ORDER BY {H('snapshot_id', 'name', '9')}, name) AS r FROM nodes) WHERE label = 1 OR r <= 8""",
    ),
)
def tk5_benign_sample(spark, sf):
    n = v.nodes(spark, sf).select("snapshot_id", "name", "label")
    order = [hash60(F.col("snapshot_id"), F.col("name"), 9), F.col("name")]
    benign = ranking.top_per_group(n.filter("label = 0"), ["snapshot_id"], order, 8).drop("rank")
    return benign.unionByName(n.filter("label = 1"))


@query(
    "tk6_weighted_centers",
    v.with_ctes(
        v.GRAPH,
        f"""SELECT snapshot_id, name FROM (SELECT snapshot_id, name, row_number() OVER (PARTITION BY snapshot_id
             ORDER BY round(-ln(greatest({H('snapshot_id', 'name', '4')} / 1152921504606846976.0, 1e-18)) / (frequency + 1e-6), 9), name) AS r
             FROM nodes) WHERE r <= 6""",
    ),
)
def tk6_weighted_centers(spark, sf):
    n = v.nodes(spark, sf)
    draw = unit_draw(F.col("snapshot_id"), F.col("name"), 4)
    key = F.round(-F.log(F.greatest(draw, F.lit(1e-18))) / (F.col("frequency") + 1e-6), 9)
    return ranking.top_per_group(n, ["snapshot_id"], [key, F.col("name")], 6).select("snapshot_id", "name")


@query(
    "tk7_node_sample",
    v.with_ctes(
        v.GRAPH,
        f"""SELECT snapshot_id, name FROM (SELECT snapshot_id, name, row_number() OVER (PARTITION BY snapshot_id
             ORDER BY {H('name', '0')}, name) AS r FROM nodes) WHERE r <= 10""",
    ),
)
def tk7_node_sample(spark, sf):
    from auditloom.operators.wl import sample_nodes

    return sample_nodes(v.nodes(spark, sf), ["snapshot_id"], 10).select("snapshot_id", "name")


@query(
    "tk8_stratified_split",
    f"""SELECT doc_id, toxic, CASE WHEN pos <= floor(0.3 * n) THEN 'train' ELSE 'test' END AS part FROM (
          SELECT doc_id, toxic, row_number() OVER (PARTITION BY toxic ORDER BY {H('doc_id', '2')}, doc_id) AS pos,
            count(*) OVER (PARTITION BY toxic) AS n FROM labels)""",
)
def tk8_stratified_split(spark, sf):
    from auditloom.operators.sampling import stratified_split

    out = stratified_split(v.table(spark, sf, "labels"), "toxic", ["doc_id"], 0.3, 2)
    return out.select("doc_id", "toxic", "part")


@query(
    "tk9_count_chunks",
    v.with_ctes(
        v.EV,
        """SELECT event_id, object_type, (row_number() OVER (PARTITION BY object_type ORDER BY ts_us, event_id) - 1) // 100 AS chunk FROM ev""",
    ),
)
def tk9_count_chunks(spark, sf):
    out = snapshots.count_chunks(v.audit_events(spark, sf), 100, ["object_type"])
    return out.select("event_id", "object_type", F.col("snapshot_id").alias("chunk"))


@query(
    "sw3_count_window",
    v.with_ctes(
        v.EV,
        """c AS (SELECT ts_us, (row_number() OVER (ORDER BY ts_us, event_id) - 1) // 100 AS snapshot_id FROM ev)""",
        "SELECT snapshot_id, count(*) AS n_edges, min(ts_us) AS first_us, max(ts_us) AS last_us FROM c GROUP BY 1",
    ),
)
def sw3_count_window(spark, sf):
    """One stream chunked as a whole: range-partitioned, counted per partition, offsets added."""
    out = snapshots.count_chunks(v.audit_events(spark, sf), 100)
    return out.groupBy("snapshot_id").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


@query(
    "tk10_ordered_split",
    v.with_ctes(
        v.EV,
        """SELECT part, count(*) AS n, min(ts_us) AS first_us, max(ts_us) AS last_us FROM (
             SELECT ts_us, CASE WHEN pos <= floor(0.8 * n) THEN 'train' WHEN pos <= floor(0.9 * n) THEN 'validation' ELSE 'test' END AS part
             FROM (SELECT ts_us, row_number() OVER (ORDER BY ts_us, event_id) AS pos, count(*) OVER () AS n FROM ev)) GROUP BY 1""",
    ),
)
def tk10_ordered_split(spark, sf):
    from auditloom.operators.sampling import ordered_split

    out = ordered_split(v.audit_events(spark, sf), [F.col("ts_us"), F.col("event_id")], {"train": 0.8, "validation": 0.1, "test": 0.1})
    return out.groupBy("part").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us")
    )


@query(
    "tk11_most_malicious",
    v.with_ctes(
        v.GRAPH,
        """SELECT snapshot_id, n FROM (SELECT snapshot_id, sum(label)::BIGINT AS n FROM nodes GROUP BY 1) ORDER BY n DESC, snapshot_id LIMIT 1""",
    ),
)
def tk11_most_malicious(spark, sf):
    counts = v.nodes(spark, sf).groupBy("snapshot_id").agg(F.sum("label").alias("n"))
    return counts.agg(F.max_by(F.struct("snapshot_id", "n"), F.struct("n", -F.col("snapshot_id"))).alias("m")).select("m.*")


@query(
    "tk12_training_selection",
    v.with_ctes(v.EV, "SELECT snapshot_id, count(*) AS n FROM ev WHERE snapshot_id BETWEEN 473400 AND 473700 GROUP BY 1"),
)
def tk12_training_selection(spark, sf):
    picked = snapshots.select_training(v.hourly(spark, sf), (473400, 473700))
    return picked.groupBy("snapshot_id").agg(F.count(F.lit(1)).alias("n"))


@query(
    "fe10_sample_weight",
    v.with_ctes(v.GRAPH, "SELECT snapshot_id, name, round(1 + 0.3 * frequency, 6)::DOUBLE AS weight FROM nodes"),
)
def fe10_sample_weight(spark, sf):
    n = v.nodes(spark, sf)
    return n.select("snapshot_id", "name", F.round(features.sample_weight(F.col("frequency"), 0.3), 6).alias("weight"))


@query(
    "fe12_class_separation",
    v.with_ctes(
        v.VEC,
        """c AS (SELECT is_attack, i, avg(x) AS c FROM vec GROUP BY 1, 2),
           w AS (SELECT is_attack, sum((x - c) * (x - c)) / count(DISTINCT vec_id) AS s FROM vec JOIN c USING (is_attack, i) GROUP BY 1),
           d AS (SELECT sqrt(sum((a.c - b.c) * (a.c - b.c))) AS d FROM c a JOIN c b ON a.i = b.i AND a.is_attack = 0 AND b.is_attack = 1)""",
        """SELECT round((SELECT sum(s) FROM w), 6) AS within, round(greatest(0, 1 - d), 6) AS between,
             round((SELECT sum(s) FROM w) + greatest(0, 1 - d), 6) AS loss FROM d""",
    ),
)
def fe12_class_separation(spark, sf):
    out = features.separation(v.vectors(spark, sf), "vec", "is_attack", DIM)
    return out.select(*[F.round(c, 6).alias(c) for c in ("within", "between", "loss")])


@query(
    "fe13_attack_shift",
    v.with_ctes(
        v.VEC,
        """a AS (SELECT snapshot_id, i, avg(x) AS x FROM vec GROUP BY 1, 2),
           b AS (SELECT snapshot_id, i, avg(x) AS x FROM vec WHERE is_attack = 0 GROUP BY 1, 2)""",
        """SELECT snapshot_id, round(sqrt(sum((a.x - b.x) * (a.x - b.x))), 6) AS shift,
             round(sqrt(sum((a.x - b.x) * (a.x - b.x))) / sqrt(sum(b.x * b.x)) * 100, 6) AS shift_pct FROM a JOIN b USING (snapshot_id, i) GROUP BY 1""",
    ),
)
def fe13_attack_shift(spark, sf):
    out = features.attack_shift(v.vectors(spark, sf), "vec", "is_attack", DIM)
    return out.select("snapshot_id", F.round("shift", 6).alias("shift"), F.round("shift_pct", 6).alias("shift_pct"))


