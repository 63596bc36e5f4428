import math

from pyspark.sql import functions as F

from auditloom.operators import decay
from auditloom.streaming import windows

EVENT = "event_id long, actor_id string, actor_type string, object_id string, object_type string, action string, ts_us long"


def events(spark, rows):
    full = [(i, a, "SUBJECT_PROCESS", o, "FILE_OBJECT_BLOCK", "EVENT_READ", t) for i, (a, o, t) in enumerate(rows)]
    return spark.createDataFrame(full, EVENT)


def test_late_rows_are_dropped(spark, tmp_path):
    """A batch is held against the watermark of the batch before the last one."""
    minute = 60_000_000
    base = 1_704_067_200_000_000
    batches = [[("a", "b", base)], [("a", "b", base + 60 * minute)], [("a", "b", base + 60 * minute + 1)], [("late", "x", base + minute), ("a", "b", base + 61 * minute)]]
    path = str(tmp_path / "in")
    for rows in batches:
        events(spark, rows).coalesce(1).write.mode("append").parquet(path)
    stream = windows.stream_table(spark, path, events(spark, batches[0]).schema, files_per_batch=1)
    out = windows.latest(windows.run_available(windows.stream_counts(stream), "late"), ["w"])
    got = {r.m: r.n_edges for r in out.select(((F.unix_micros("w.start") - base) / minute).cast("int").alias("m"), "n_edges").collect()}
    assert got == {0: 1, 60: 2, 61: 1}


def test_decayed_histogram_equals_sum(spark):
    hour = 3_600_000_000
    rows = [(t // hour, "x", t) for t in (0, hour // 2, 3 * hour, 3 * hour + 7)] + [(1, "y", hour)]
    df = spark.createDataFrame(rows, "snapshot_id long, label string, ts_us long")
    got = {(r.snapshot_id, r.label): r.weight for r in decay.decayed_histogram(df, 0.0005, hour).collect()}
    for snap in (0, 1, 3):
        want = sum(math.exp(-0.0005 * ((snap + 1) * hour - t) / 1e6) for _, lab, t in rows if lab == "x" and t < (snap + 1) * hour)
        assert abs(got[(snap, "x")] - want) < 1e-9


def test_sketch_agreement_grows_with_overlap(spark):
    hist = [(g, f"l{i}", w) for g, shift in ((1, 0), (2, 2), (3, 30)) for i, w in ((j + shift, 1.0) for j in range(20))]
    df = spark.createDataFrame(hist, "g int, label string, weight double")
    codes = {}
    for r in decay.histogram_sketch(df, ["g"], 64).collect():
        codes.setdefault(r.g, {})[r.slot] = r.code
    same = lambda a, b: sum(codes[a][s] == codes[b][s] for s in range(64)) / 64
    assert same(1, 2) > 0.55 and same(1, 3) < 0.1


def test_carried_vectors_cross_chunks(spark):
    n = 130
    df = spark.createDataFrame([("a", i, [float(i % 5), 1.0]) for i in range(n)], "name string, t long, vec array<double>")
    got = {r.t: r.vec for r in decay.carried_vectors(df, "name", "t", "vec", 0.5).collect()}
    h = [0.0, 0.0]
    for i in range(n):
        h = [0.5 * z + 0.5 * x for z, x in zip([float(i % 5), 1.0], h)]
        assert all(abs(a - b) < 1e-9 for a, b in zip(got[i], h))
