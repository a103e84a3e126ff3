"""Interval joins on nested bins against plain loops: nested, long, skewed and empty ranges."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import intervals


def ranges(spark, rows, side):
    return spark.createDataFrame(rows, f"{side}_id long, {side}_start long, {side}_end long")


def some(r, n, low):
    out = []
    for k in range(n):
        size = r.choice([0, 1, 3, 64, 65, 1000, 70_000, 10**9, 2**45])
        at = r.choice([r.randint(-50, 50), r.randint(0, 100_000), r.randint(0, 10**9)])
        out.append((low + k, at, at + size))
    return out


@pytest.mark.parametrize("crowd,width", [(None, 64), (3, 8), (20, 1 << 14)])
def test_overlaps(spark, crowd, width):
    r = random.Random(width)
    a, b = some(r, 60, 0), some(r, 70, 1000)
    a += [(500 + k, 10, 12) for k in range(40)]  # a crowd in one bin
    got = intervals.overlap_join(ranges(spark, a, "l"), ranges(spark, b, "r"), width, crowd)
    assert got.columns == ["l_id", "l_start", "l_end", "r_id", "r_start", "r_end"]
    pairs = sorted((x.l_id, x.r_id) for x in got.collect())
    assert pairs == sorted((i, j) for i, s, e in a for j, t, f in b if s < e and t < f and s < f and t < e)


@pytest.mark.parametrize("crowd", [None, 5])
def test_points(spark, crowd):
    r = random.Random(2)
    b = some(r, 60, 0)
    p = [r.choice([r.randint(-60, 200), r.randint(0, 10**9), 2**44]) for _ in range(150)]
    got = intervals.point_join(spark.createDataFrame([(x,) for x in p], "p long"), ranges(spark, b, "r"), 16, crowd)
    assert sorted((x.p, x.r_id) for x in got.collect()) == sorted((x, i) for x in p for i, s, e in b if s <= x < e)


def test_nothing(spark):
    a, none = ranges(spark, [(1, 0, 10)], "l"), ranges(spark, [], "r")
    assert intervals.overlap_join(a, none).count() == 0
    assert intervals.point_join(spark.range(3).select(F.col("id").alias("p")), none).count() == 0


def test_rows_of_a_range_are_bounded(spark):
    """A range of any length lives in two bins and visits two on each level."""
    for size in (1, 5, 10**3, 10**9, 2**60):
        a = ranges(spark, [(1, 123_456, 123_456 + size)], "l")
        k = a.select(intervals._level("l_start", "l_end", 6)).first()[0]
        assert 0 <= k < intervals.LEVELS and size <= 64 << (2 * k) and (not k or size > 16 << (2 * k))
        live = intervals._binned(a.withColumn("_k", intervals._level("l_start", "l_end", 6)), "l_start", "l_end", 6)
        assert live.count() <= 2
        assert intervals._visiting(a, "l_start", "l_end", 6, list(range(28)), False).count() <= 2 * 28
