"""Scans over blocks on several levels, against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from weftgraph.operators import closure, intervals, rank

TINY = {"rows": 3, "shift": 1}


@pytest.fixture(scope="module")
def places(spark):
    r = random.Random(8)
    at = sorted(r.sample(range(-50, 4000), 260) + [2**40, 2**40 + 1])
    rows = [(p, r.randint(-3, 9), r.choice([None, None, p * 7])) for p in at]
    return rows, spark.createDataFrame(r.sample(rows, len(rows)), "at long, v long, x long").cache()


def test_running_sum_and_last_on_many_levels(places):
    rows, df = places
    total, last, sums, lasts = 0, None, [], []
    for p, v, x in rows:
        total, last = total + v, x if x is not None else last
        sums.append((p, total))
        lasts.append((p, last))
    assert sorted(map(tuple, rank.running_sum(df, "at", "v", "s", block=16, **TINY).select("at", "s").collect())) == sums
    assert sorted(map(tuple, rank.running_last(df, "at", "x", "s", block=16, **TINY).select("at", "s").collect())) == lasts


def test_neighbours_on_many_levels(places):
    rows, df = places
    got = sorted(rank.neighbours(df, "at", "v", block=16, **TINY).collect())
    for k, g in enumerate(got):
        assert g._prev == (None if not k else (rows[k - 1][0], rows[k - 1][1]))
        assert g._next == (None if k + 1 == len(rows) else (rows[k + 1][0], rows[k + 1][1]))


def test_asof_on_many_levels(spark):
    r = random.Random(3)
    starts = sorted(r.sample(range(100, 3000), 40))
    points = [r.randint(0, 3500) for _ in range(300)]
    s = spark.createDataFrame([(x, x * 3) for x in starts], "start long, tag long")
    p = spark.createDataFrame([(x,) for x in points], "p long")
    got = sorted(map(tuple, intervals.asof_join(p, s, block=8, **TINY).collect()), key=str)
    best = [max((x for x in starts if x <= v), default=None) for v in points]
    assert got == sorted(((v, b, None if b is None else b * 3) for v, b in zip(points, best, strict=True)), key=str)


def test_a_window_without_groups_sees_few_rows(spark, monkeypatch):
    """Every window over one partition is over a table proved to have at most ``rows`` rows, however many levels it takes."""
    seen = []
    table = rank.table
    monkeypatch.setattr(rank, "table", lambda df, name="t": seen.append(table(df, name)) or seen[-1])
    df = spark.range(4096).select(F.col("id").alias("at"), F.lit(1).alias("v"))
    assert rank.running_sum(df, "at", "v", "s", block=2, rows=40, shift=2).where("s != at + 1").count() == 0
    assert [t.count() for t in seen] == [2048, 512, 128, 32]


def test_repeat_groups_of_a_hot_component(spark):
    """One component in one sequence with most of the bases: same numbers, and no window is partitioned by it."""
    r = random.Random(5)
    rows = [(q, 1 if q < 700 else r.randint(1, 3), 0 if q < 600 else r.choice([0, 600, 601])) for q in sorted(r.sample(range(1500), 900))]
    df = spark.createDataFrame(rows, "q long, seq_id long, c long")
    for top, far in ((1, 0), (0, 3), (4, 2)):
        want, n, last = [], {}, {}
        for q, s, c in rows:
            k = n[s, c] = n.get((s, c), 0) + 1
            split = (far and (s, c) in last and q - last[s, c] < far) or (top and k > top)
            last[s, c] = q
            want.append((q, k if split else 0))
        got = closure.repeat_groups(df, top, far, block=32, **TINY)
        assert sorted(map(tuple, got.select("q", "g").collect())) == want
        assert got.columns == [*df.columns, "g"]
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "hashpartitioning(c#" not in plan and "hashpartitioning(seq_id#" not in plan
