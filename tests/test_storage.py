"""Nothing that is shuffled for a written table outlives it."""

import glob
import time

from pyspark.sql import functions as F

from hearthline import storage


def test_shuffled_files_go_when_a_table_is_written(spark):
    dirs = [d.toString() for d in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*", recursive=True)}
    before, until = files(), time.time() + 10
    out = storage.written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counted")
    while files() - before and time.time() < until:
        time.sleep(0.1)
    assert not files() - before
    assert out.count() == 7
