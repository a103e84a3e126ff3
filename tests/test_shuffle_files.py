"""Shuffle files of plans that are written as tables."""

import glob
import time

from pyspark.sql import functions as F

from weftgraph.plans import work


def test_tables_leave_no_shuffle_files(spark, monkeypatch):
    monkeypatch.setattr(work, "_freed", [time.monotonic() + 3600])  # no garbage is collected for it
    dirs = [d.getPath() for d in spark._jsc.sc().env().blockManager().diskBlockManager().localDirs()]
    files = lambda: {f for d in dirs for f in glob.glob(f"{d}/**/shuffle_*.data", recursive=True)}
    own = spark.conf.get(work.CLEAN, None)
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    try:
        before = files()
        rows = spark.range(0, 20_000, 1, 4).repartition(3, "id").groupBy((F.col("id") % 7).alias("k")).agg(F.sum("id").alias("s"))
        t = work.table(rows, "sums")
        until = time.monotonic() + 5  # executors delete in the background
        while (left := files() - before) and time.monotonic() < until:
            time.sleep(0.1)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
    assert not left
    assert t.agg(F.sum("s")).first()[0] == 20_000 * 19_999 // 2
    assert spark.conf.get(work.CLEAN, None) == own
