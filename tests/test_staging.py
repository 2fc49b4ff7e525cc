import os
import time

from pyspark.sql import functions as F

from voucherlens import staging


def shuffle_files(spark):
    env = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    dirs = [f.getPath() for f in env.blockManager().diskBlockManager().localDirs()]
    return {f for d in dirs for _, _, names in os.walk(d) for f in names if f.startswith("shuffle_")}


def test_a_staged_table_leaves_no_shuffle_files(spark, stage):
    """They would add up from table to table, until the driver happens to collect its garbage."""
    setting, before = spark.conf.get(staging._CLEANUP), shuffle_files(spark)
    rows = spark.range(10_000).groupBy((F.col("id") % 100).alias("k")).count().repartition(5, "count")
    staged = stage(rows.join(rows.select("k").hint("merge"), "k"), "joined")
    for _ in range(50):  # they go in the background
        if not (left := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    assert not left
    assert staged.count() == 100 and staged.count() == 100  # which needs none of them
    assert spark.conf.get(staging._CLEANUP) == setting
