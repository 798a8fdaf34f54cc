import os

from pyspark.sql import functions as F

import __spark_entry__ as entry
from gridspark import fixtures
from gridspark.session import TASK_MB, bound_tasks, free_tasks

KEYS = ("spark.sql.adaptive.advisoryPartitionSizeInBytes", "spark.sql.adaptive.coalescePartitions.initialPartitionNum",
        "spark.sql.files.maxPartitionBytes")


def settings(spark):
    return [spark.conf.get(k, None) for k in KEYS]


def test_tasks_on_pixel_rows_stay_small_with_few_partitions(spark, sf):
    found = settings(spark)
    entry.queries()["d11_error_by_horizon"](spark, sf)
    try:
        # 307 MB of hexadecimal digits, about half of that when compressed; the session's four partitions would hold 77 MB each.
        rows = spark.range(600_000).select((F.col("id") * 7).alias("id"), *[F.sha2(F.concat("id", F.lit(str(i))), 512).alias(f"h{i}") for i in range(4)])
        each = rows.groupBy("id").agg(*[F.max(f"h{i}").alias(f"h{i}") for i in range(4)])
        sizes = each.groupBy(F.spark_partition_id()).agg(F.sum(F.expr("length(h0 || h1 || h2 || h3)")).alias("b")).collect()
        assert max(r["b"] for r in sizes) < 3 * TASK_MB << 20
    finally:
        free_tasks(spark)
    assert settings(spark) == found


def test_text_operators_run_with_the_settings_of_the_session(spark, sf):
    found = settings(spark)
    bound_tasks(spark)
    bound_tasks(spark)
    assert settings(spark) != found
    entry.queries()["op8_mixing"](spark, sf)
    assert settings(spark) == found


def test_smaller_tasks_of_the_session_stay(spark):
    try:
        spark.conf.set(KEYS[0], "8m")
        bound_tasks(spark)
        assert int(spark.conf.get(KEYS[0])) == 8 << 20
        free_tasks(spark)
        assert spark.conf.get(KEYS[0]) == "8m"
    finally:
        free_tasks(spark)
        spark.conf.unset(KEYS[0])


def test_partitions_grow_with_the_tables(spark, sf, monkeypatch):
    found = settings(spark)
    assert fixtures.input_bytes(spark, sf) == sum(os.path.getsize(f"{sf}/{name}.parquet") for name in fixtures.TABLES)
    assert fixtures.input_bytes(spark, f"{sf}/none") == 0
    try:
        counts = []
        for size in (0, 600 << 20, 4 << 30, 40 << 30):
            monkeypatch.setattr(entry, "input_bytes", lambda spark, sf_dir: size)
            entry.queries()["d11_error_by_horizon"](spark, sf)
            counts.append(int(spark.conf.get(KEYS[1])))
        # 200 partitions of 16 MB hold what some 800 MB of files become; beyond that partitions are more, not larger.
        assert counts == [200, 200, 1024, 10240]
    finally:
        free_tasks(spark)
    assert settings(spark) == found
