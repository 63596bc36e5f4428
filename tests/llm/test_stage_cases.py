"""Stages on repeated doc_ids with different texts, clashing column names, conflicting labels; keys without padding."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import decontam, passages, quality, simhash, toxicity
from auditloom.llm.common import fresh, one_text
from auditloom.session import ship_package

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, _id long, _gone int, _bad int, _cuts int, _digest string, digest string, cuts int, node long, key int"


def prose(seed, n):
    rnd = random.Random(seed)
    vocabulary = ["the", "of", "and", "to", "in"] * 6 + ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 8))) for _ in range(400)]
    return " ".join(rnd.choice(vocabulary) for _ in range(n))


OTHER = prose(8, 20)


@pytest.fixture(scope="module")
def rows():
    passage = prose(2, 60)
    a, b = prose(5, 70) + " " + passage + " " + prose(6, 70), prose(7, 30) + " " + passage + " " + prose(9, 40)
    return [(1, a), (2, b), (2, OTHER), (2, OTHER), (3, prose(3, 150)), (4, prose(3, 150)), (4, prose(11, 90)), (5, None), (None, a), (6, "")]


@pytest.fixture(scope="module")
def docs(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "en", "s", len(t or ""), 1, 2, 3, 4, "d", "e", 5, 6, 7) for i, t in rows], COLUMNS).repartition(3)


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_one_text(spark, rows, docs):
    import hashlib

    md5 = lambda t: hashlib.md5(t.encode()).hexdigest()
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    best = {}
    for i, t in rows:
        if i is not None:
            best[i] = min(best.get(i, t or ""), t or "", key=md5)
    assert kept(one_text(plain)) == sorted([(i, t or "") for i, t in rows if i is not None and (t or "") == best[i]], key=str)
    assert fresh(docs, "_bad") == "_bad_" and fresh(docs, "_BAD") == "_BAD_" and fresh(docs, "_new") == "_new"


def test_passages_of_repeated_ids(rows, docs):
    out = passages.keep_first(docs)
    assert out.columns == docs.columns
    import hashlib

    got, passage = kept(out), prose(2, 60)
    searched = min((t for i, t in rows if i == 2), key=lambda t: hashlib.md5(t.encode()).hexdigest())
    assert sum(passage in (t or "") for i, t in got if i is not None) == (1 if passage in searched else 2)
    assert {t for i, t in got if i == 2} >= {t for i, t in rows if i == 2 and t != searched}
    assert (3, prose(3, 150)) in got and (None, rows[0][1]) in got


def test_near_duplicates_of_repeated_ids(docs):
    first = kept(simhash.keep_one(docs))
    assert first == kept(simhash.keep_one(docs.repartition(1))) and simhash.keep_one(docs).columns == docs.columns
    assert {i for i, _ in first} >= {1, 2, 3, None}


def test_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, " ".join(prose(2, 60).split()[:20]))], "item_id long, text string")
    left = decontam.clean(docs, items)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.select("doc_id").collect()} == {3, 4, 5, 6}
    assert quality.keep_good(docs).columns == docs.columns
    quality.keep_good(docs).collect()


def test_largest_of_conflicting_labels(spark):
    texts = [(i, f"{'vile awful' if i % 2 else 'kind calm'} word{i} other{i % 7}") for i in range(60)]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    labels = [(i, 1, i % 2) for i, _ in texts]
    clear = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mixed = spark.createDataFrame(labels + [(i, 1, 0) for i, _ in texts if i % 2], "doc_id long, quality int, toxic int").repartition(5)
    a, b = (sorted(map(tuple, toxicity.grade(table, toxicity.fit(table, x)).collect())) for x in (clear, mixed))
    assert a == b


def test_keys_hold_words():
    """Windows without a common word share no key; near ones meet in some table with the recall asked for."""
    rnd = random.Random(3)
    tables = decontam.tables_for(0.99)
    walks = [decontam.Walk(i) for i in range(decontam.WALKS)]
    keys = lambda w: {k for x in walks for k in x.keys(w, tables)}
    for size in (10, 20, 40):
        met = 0
        for _ in range(100):
            a = [f"w{rnd.randrange(10**6)}" for _ in range(size)]
            b = list(a)
            for i in rnd.sample(range(size), size // 5):
                b[i] = f"x{rnd.randrange(10**6)}"
            far = [f"y{rnd.randrange(10**6)}" for _ in range(size)]
            assert not keys(a) & keys(far)
            met += bool(keys(a) & keys(b))
        assert met >= 97


def test_many_different_words_do_not_overflow():
    codes = np.array([3_000_000, 2_999_999, 3_000_001, 5], np.uint64)
    assert len(decontam.grams(codes)) == 2
