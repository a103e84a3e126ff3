"""Shared work space and bounded broadcasts."""

from __future__ import annotations

import atexit
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_freed = [time.monotonic()]
#: Spark's setting that lets the shuffle files of a plan go when its execution ends.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def work_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``; a local one only where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = "file://" + tempfile.mkdtemp(prefix="weft-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session ended first: its cleaner owns the folder
        pass


_listeners: list[Callable[[str], None]] = []


@contextmanager
def telling(say: Callable[[str], None]) -> Iterator[None]:
    """``say`` hears of rounds and tables as they are done."""
    _listeners.append(say)
    try:
        yield
    finally:
        _listeners.remove(say)


def tell(text: str) -> None:
    for say in _listeners:
        say(text)


def observed(df: DataFrame, name: str, **metrics: Column) -> tuple[DataFrame, dict[str, int]]:
    """``table`` with aggregates of its rows, seen while they are written: no second scan."""
    seen = Observation()
    t = table(df.observe(seen, *[m.alias(k) for k, m in metrics.items()]), name)
    got = {k: seen.get[k] or 0 for k in metrics}
    tell(f"{name}: " + ", ".join(f"{v} {k.replace('_', ' ')}" for k, v in got.items()))
    return t, got


def table(df: DataFrame, name: str = "t") -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends here and lost executors can reread it."""
    spark = df.sparkSession
    path = scratch(spark, name)
    schema = df.schema
    with cleaned(spark):
        df.write.parquet(path)
    _tidy(spark)
    out = spark.read.schema(schema).parquet(path)
    out._weft_path = path
    return out


@contextmanager
def cleaned(spark: SparkSession) -> Iterator[None]:
    """Plans that are written inside (adaptive ones) leave no shuffle files, whenever the driver collects its garbage; what is executed later keeps the session's own setting."""
    own = spark.conf.get(CLEAN, None)
    spark.conf.set(CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEAN) if own is None else spark.conf.set(CLEAN, own)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there goes when the driver ends."""
    path = f"{work_dir(spark)}/weft-{name}-{uuid.uuid4().hex}"
    atexit.register(partial(_delete, spark, path))
    return path


def drop(*tables: DataFrame) -> None:
    """Delete written tables that no later plan reads: call it only once their successors are written."""
    for t in tables:
        if path := getattr(t, "_weft_path", None):
            _delete(t.sparkSession, path)


def _tidy(spark: SparkSession) -> None:
    # plans that only fed this table are garbage now: let the driver's cleaner drop their shuffle files
    if time.monotonic() - _freed[0] > 5:
        settle(spark)


def settle(spark: SparkSession) -> None:
    """Lets the driver's cleaner drop the shuffle files of plans that are done, before a stage that shuffles much."""
    gc.collect()
    spark._jvm.System.gc()
    _freed[0] = time.monotonic()


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast ``df`` if it proves to have at most ``rows`` rows, else leave the join to the planner (shuffle, AQE skew split)."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def split_join(rows: DataFrame, lookup: DataFrame, on: list[str], count: str = "c", parts: int = 10_000, total: int | None = None) -> DataFrame:
    """``rows`` inner-joined to ``lookup`` without a hot task; both are written tables (or cheap reads of one, with their ``total``).

    ``lookup`` has one row per key ``on`` and a column ``count``: how many of ``rows`` (or a
    superset as large as the read table) have the key.  Keys above 1 / ``parts`` of all rows
    are at most ``parts``, whatever the size: they are broadcast and their rows stay where
    they are.  All other keys meet by shuffle.  Null keys never match.
    """
    most = (rows.count() if total is None else total) // parts
    hot = F.broadcast(lookup.where(F.col(count) > most).drop(count))
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti")
    return rows.join(hot, on).unionByName(cold.join(lookup.where(F.col(count) <= most).drop(count), on))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
