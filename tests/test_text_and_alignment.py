import itertools
import random
import re
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from auditloom.functions import text as T
from auditloom.operators import events as ev
from auditloom.operators import interpret, metrics


def one(spark, expr, *values):
    row = spark.range(1).select(*[F.lit(x).alias(f"c{i}") for i, x in enumerate(values)])
    return row.select(expr(*[F.col(f"c{i}") for i in range(len(values))]).alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("path", "kind"),
    [("/tmp/a.so", "shared library"), ("/etc/shadow", "credential file"), ("/etc/cron.d/x", "configuration file"),
     ("/root/.ssh/authorized_keys", "authentication key file"), ("/proc/1/maps", "process"), ("/opt/x", ""), ("", "")],
)
def test_file_kind(spark, path, kind):
    assert one(spark, T.file_kind, path) == kind


@pytest.mark.parametrize(
    ("event", "phrase"),
    [("EVENT_WRITE /tmp/memhelp.so", "writes /tmp/memhelp.so shared library"), ("EVENT_SENDTO 1.2.3.4", "sends network connection"),
     ("EVENT_READ", "reads"), ("EVENT_READ /opt/x", "reads /opt/x"), ("nonsense /x", ""), ("", "")],
)
def test_event_phrase(spark, event, phrase):
    assert one(spark, T.event_phrase, event) == phrase


@pytest.mark.parametrize(
    ("ip", "inside"),
    [("172.2.0.1", False), ("172.16.0.1", True), ("172.31.255.1", True), ("172.200.1.1", False), ("10.1.2.3", True),
     ("192.168.0.1", True), ("127.0.0.1", True), ("localhost", True), ("", False)],
)
def test_private_ip(spark, ip, inside):
    assert one(spark, T.is_private_ip, ip) is inside


def test_intent_maps(spark):
    assert one(spark, T.intent_operations, "injecting") == ["writes", "writes", "reads"]
    assert one(spark, T.intent_operations, "juggle") is None
    assert one(spark, T.intent_object, "stolen session tokens") == "authentication token"
    assert one(spark, T.intent_object, "weather") == "weather"
    assert one(spark, T.intent_subject, "Legitimate User") == "user"


def test_tokens_and_names(spark):
    assert one(spark, T.property_tokens, "run /a/b.so,(x y)") == ["run", "/a/b.so", "x", "y"]
    assert one(spark, lambda c: T.with_bigrams(T.word_tokens(c)), "A b-C") == ["a", "b", "c", "a_b", "b_c"]
    assert one(spark, T.process_name, "bash -c,12,/bin/bash") == "bash"
    assert one(spark, T.process_name, "/usr/bin/vim") == "vim"
    assert one(spark, T.process_role, "/bin/BASH") == "command shell"
    assert one(spark, T.redact_events, "x EVENT_READ myEVENT_X") == "x REDACTED myEVENT_X"


def test_contains_join_equals_brute_force(spark):
    rng = random.Random(2)
    names = {"".join(rng.choice("ab/") for _ in range(rng.randrange(1, 14))) for _ in range(60)}
    labels = {"".join(rng.choice("ab/") for _ in range(rng.randrange(1, 11))) for _ in range(40)}
    n = spark.createDataFrame([(x,) for x in names], "name string")
    k = spark.createDataFrame([(x,) for x in labels], "lab string")
    got = {(r.name, r.lab) for r in ev.contains_join(n, "name", k, "lab").collect()}
    assert got == {(x, y) for x in names for y in labels if y in x}


def lcs_length(a, b):
    @lru_cache(None)
    def go(i, j):
        if i == len(a) or j == len(b):
            return 0
        return 1 + go(i + 1, j + 1) if a[i] == b[j] else max(go(i + 1, j), go(i, j + 1))

    return go(0, 0)


def test_lcs_against_brute_force():
    rng = random.Random(4)
    for _ in range(200):
        a = [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]
        b = [rng.choice("abcd") for _ in range(rng.randrange(0, 9))]
        length, mask = interpret._lcs(a, b)
        places = {}
        for i, x in enumerate(b):
            places[x] = places.get(x, 0) | (1 << i)
        assert length == lcs_length(tuple(a), tuple(b)) == sum(mask) == interpret._lcs_length(a, places, len(b))
        kept, rest = [x for x, m in zip(a, mask) if m], iter(b)
        assert all(x in rest for x in kept)
    # of two equally long choices the later position is kept
    assert interpret._lcs(["x", "y", "x"], ["x"])[1] == [False, False, True]


def test_alignment_filter(spark):
    seqs = spark.createDataFrame(
        [("h1", ["t1", "T9", "T2"], [10, 11, 12]), ("h2", ["T7"], [20]), ("h3", ["T5", "T6"], [30, 31])],
        "host string, steps array<string>, snapshots array<int>",
    )
    library = spark.createDataFrame([("a", ["T1", "T2", "T3"]), ("b", ["T5", "T4", "T4", "T4"])], "seq_id string, steps array<string>")
    kept = interpret.filter_by_alignment(seqs, library, ["host"], 0.6).collect()
    assert {(r.host, r.snapshot_id) for r in kept} == {("h1", 10), ("h1", 12)}


def test_confusion_edge_cases(spark):
    df = spark.createDataFrame([(1, 0, 0), (1, 0, 0)], "g int, y_true int, y_pred int")
    row = metrics.evaluate(df, ["g"]).first()
    assert (row.tp + row.fp + row.tn + row.fn, row.precision, row.recall, row.f1, row.accuracy) == (2, 0.0, 0.0, 0.0, 1.0)


def test_contains_join_broadcasts_no_substrings_of_names(spark):
    n = spark.range(50_000).selectExpr("concat('/usr/share/long/directory/of/files/', id) as name")
    k = spark.createDataFrame([("s/77",), ("/49999",)], "lab string")
    out = ev.contains_join(n, "name", k, "lab")
    found = {(r.name, r.lab) for r in out.collect()}
    assert len(found) == 1 + sum(str(i).startswith("77") for i in range(50_000))
    lines = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    depth = [re.search(r"[A-Za-z(*]", x).start() if re.search(r"[A-Za-z(*]", x) else 0 for x in lines]
    for at, line in enumerate(lines):
        if "BroadcastExchange" in line:
            below = itertools.takewhile(lambda i: depth[i] > depth[at], range(at + 1, len(lines)))
            assert not any("Generate" in lines[i] for i in below)


def test_event_sides_read_the_events_once(spark):
    rows = [(i, "u1", "SUBJECT_PROCESS", f"k{i % 2}", "FILE_OBJECT_BLOCK", "EVENT_READ", i) for i in range(6)]
    events = spark.createDataFrame(rows, "event_id long, actor_id string, actor_type string, object_id string, object_type string, action string, ts_us long")
    read = spark.sparkContext.accumulator(0)

    def seen(x):
        read.add(1)
        return x

    events = events.withColumn("actor_id", F.udf(seen)("actor_id"))
    entities = spark.createDataFrame([("u1", "/usr/bin/bash -n 3,7,/usr/bin/bash"), ("k0", "/tmp/a.so")], "name string, props string")
    wanted = spark.createDataFrame([("u1",)], "entity string")
    sides = interpret.event_sides(events, entities, wanted)
    found = {(r["object_id"], r["actor_prop"][:13], r["object_prop"]) for r in sides.collect()}
    assert found == {("k0", "/usr/bin/bash", "/tmp/a.so"), ("k1", "/usr/bin/bash", "")}
    assert read.value == len(rows)
