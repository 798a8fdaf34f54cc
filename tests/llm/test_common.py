import time

import pytest
from pyspark.sql import functions as F

from gridspark.llm.common import _FREE_SHUFFLES, written


def shuffle_files(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    names = (files.apply(i).getName() for i in range(files.size()))
    return {n for n in names if n.startswith("shuffle_")}


def test_written_tables_leave_no_shuffle_files(spark):
    before, found = shuffle_files(spark), spark.conf.get(_FREE_SHUFFLES, None)
    rows = spark.range(20_000).select((F.col("id") % 997).alias("k"), "id")
    sums = rows.groupBy("k").agg(F.sum("id").alias("s"))
    out = written(rows.join(sums, "k").dropDuplicates(["s"]), "sums")
    until = time.time() + 5
    while shuffle_files(spark) - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffle_files(spark) - before
    assert out.count() == 997 and sums.count() == 997
    assert spark.conf.get(_FREE_SHUFFLES, None) == found


def test_setting_of_the_session_stays_when_a_write_fails(spark):
    spark.conf.set(_FREE_SHUFFLES, "false")
    try:
        with pytest.raises(Exception, match="DIVIDE_BY_ZERO"):
            written(spark.range(1).select((F.lit(1) / F.col("id")).alias("x")), "none")
        assert spark.conf.get(_FREE_SHUFFLES) == "false"
    finally:
        spark.conf.unset(_FREE_SHUFFLES)
