"""Dense numbering and running sums over data of any size, without one-task windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.plans.work import bounded, table

_LOW = (1 << 33) - 1
#: Most rows of a window in one task, and the bits of a block number that a level of ``carried`` takes off.
ROWS, SHIFT = 1 << 18, 12


def numbered(df: DataFrame, *order: Column | str, name: str = "rank", start: int = 0) -> DataFrame:
    """``df`` with its place in the order: a range sort, row numbers inside partitions, and an offset per partition.

    Rows equal in the order columns get different numbers, fixed by the written sort.
    """
    t = table(df.orderBy(*order).withColumn("_m", F.monotonically_increasing_id()), "sorted")
    t = t.withColumn("_p", F.shiftright("_m", 33)).withColumn("_r", F.col("_m").bitwiseAND(F.lit(_LOW)))
    w = W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)  # one row per partition of the sort
    offsets = t.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_o"))
    return t.join(bounded(offsets, 1_000_000), "_p").withColumn(name, F.col("_o") + F.col("_r") + start).drop("_m", "_p", "_r", "_o")


def carried(blocks: DataFrame, sums: tuple[str, ...] = (), lasts: tuple[str, ...] = (), firsts: tuple[str, ...] = (), rows: int = ROWS, shift: int = SHIFT) -> DataFrame:
    """What earlier (and later) blocks hand on to each: an exclusive scan by the long ``_b``, one row per block.

    Columns: the sum of ``sums`` and the last non-null of ``lasts`` over smaller blocks, the first non-null of ``firsts`` over
    larger ones, under their own names.  Up to ``rows`` blocks, proved by a count, are one window.  More are
    scanned inside groups of 2**shift block numbers; the groups' totals are blocks of a level above and scanned the same way, so no
    task ever holds more than ``rows`` rows or one group, whatever the size.
    """
    t = table(blocks.select("_b", *sums, *lasts, *firsts), "carry")
    before = (W.unboundedPreceding, -1)

    def scan(group: list[str]) -> list[Column]:
        up, down = (W.partitionBy(*group).orderBy(o).rowsBetween(*before) for o in (F.asc("_b"), F.desc("_b")))
        return [*[F.coalesce(F.sum(c).over(up), F.lit(0)).alias(c) for c in sums], *[F.last(c, True).over(w).alias(c) for w, names in ((up, lasts), (down, firsts)) for c in names]]

    if t.count() <= rows:
        return t.select("_b", *scan([]))
    t = t.withColumn("_g", F.shiftright("_b", shift))
    some = lambda c: F.when(F.col(c).isNotNull(), F.struct("_b", F.col(c).alias("_x")))
    ends = [*[F.max(some(c))["_x"].alias(c) for c in lasts], *[F.min(some(c))["_x"].alias(c) for c in firsts]]
    above = carried(t.groupBy("_g").agg(*[F.sum(c).alias(c) for c in sums], *ends).withColumnRenamed("_g", "_b"), sums, lasts, firsts, rows, shift)
    above = above.select(F.col("_b").alias("_g"), *[F.col(c).alias(f"_up_{c}") for c in (*sums, *lasts, *firsts)])
    inside = t.select("_g", "_b", *scan(["_g"])).join(above, "_g")
    return inside.select("_b", *[(F.col(c) + F.col(f"_up_{c}")).alias(c) for c in sums], *[F.coalesce(c, f"_up_{c}").alias(c) for c in (*lasts, *firsts)])


def running_sum(df: DataFrame, at: str, value: str, name: str, block: int = 1 << 16, **levels: int) -> DataFrame:
    """Inclusive running sum of ``value`` by the long ``at``: inside blocks of positions, plus the sums of earlier blocks."""
    d = df.withColumn("_b", F.floor(F.col(at) / block))
    before = carried(d.groupBy("_b").agg(F.sum(value).alias("_o")), sums=("_o",), **levels)
    inside = W.partitionBy("_b").orderBy(at)
    return d.withColumn("_i", F.sum(value).over(inside)).join(before, "_b").withColumn(name, F.col("_o") + F.col("_i")).drop("_b", "_i", "_o")


def running_last(df: DataFrame, at: str, value: str, name: str, block: int = 1 << 16, **levels: int) -> DataFrame:
    """The last non-null ``value`` at or before each row by the long ``at`` (null before the first)."""
    d = df.withColumn("_b", F.floor(F.col(at) / block))
    ends = d.groupBy("_b").agg(F.max(F.when(F.col(value).isNotNull(), F.struct(at, F.col(value).alias("_x"))))["_x"].alias("_o"))
    inside = W.partitionBy("_b").orderBy(at)
    d = d.withColumn("_i", F.last(value, True).over(inside)).join(carried(ends, lasts=("_o",), **levels), "_b")
    return d.withColumn(name, F.coalesce("_i", "_o")).drop("_b", "_i", "_o")


def neighbours(df: DataFrame, at: str, *cols: str, block: int = 1 << 14, **levels: int) -> DataFrame:
    """``df`` with ``_prev`` and ``_next``: structs of ``at`` and ``cols`` of the rows before and after it by the long ``at`` (null at the ends).

    Windows run inside blocks of positions; between blocks the last and first rows of
    each meet, one row a block, so a sequence of any length is spread over all tasks.
    """
    d = df.withColumn("_b", F.floor(F.col(at) / block)).withColumn("_own", F.struct(at, *cols))
    ends = d.groupBy("_b").agg(F.min("_own").alias("_after"), F.max("_own").alias("_before"))
    ends = carried(ends, lasts=("_before",), firsts=("_after",), **levels)
    inside = W.partitionBy("_b").orderBy(at)
    d = d.withColumn("_prev", F.lag("_own").over(inside)).withColumn("_next", F.lead("_own").over(inside)).join(ends, "_b")
    return d.withColumn("_prev", F.coalesce("_prev", "_before")).withColumn("_next", F.coalesce("_next", "_after")).drop("_b", "_own", "_before", "_after")
