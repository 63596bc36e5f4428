"""Stored tables leave no shuffle files behind and no setting changed."""

import time

from auditloom.session import SHUFFLES_GO, stored


def shuffle_files(spark):
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("|").split("|")
    return {x for x in files if "/shuffle_" in x and x.endswith(".data")}


def test_stored_leaves_no_shuffle_files(spark):
    before, setting = shuffle_files(spark), spark.conf.get(SHUFFLES_GO, None)
    df = spark.range(1000).groupBy("id").count().repartition(3)
    table = stored(df, "counts")
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before
    assert spark.conf.get(SHUFFLES_GO, None) == setting
    assert table.count() == 1000 == stored(df, "again").count()
