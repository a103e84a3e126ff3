"""Interval joins: overlap, point in interval and as-of, as equi-joins on nested bins.

A range lives in bins of the least width, four times the one below from level to level, that is no
less than its length: one or two bins, however long it is.  Two ranges meet on
the level of the longer one: each range also visits its bins on the levels above that the other side lives on,
of which there are ``LEVELS`` at most.  Wide bins hold long ranges only, so what meets there mostly overlaps.
Bins that very many visit are dealt out: their visitors get one of several numbers, their few dwellers all of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.operators.rank import carried

LEVELS = 32
#: Visitors of one bin beyond which it is dealt out, in rows and as a part of all.
CROWD, SHARE = 100_000, 10_000


def _level(start: str, end: str, bits: int) -> Column:
    """The level whose bins are as wide as the range is long, or up to four times as wide."""
    length = F.length(F.bin(F.col(end) - F.col(start) - 1))
    return F.greatest(F.ceil((length - bits) / 2), F.lit(0)).cast("int")


def _binned(df: DataFrame, start: str, end: str, bits: int) -> DataFrame:
    """A row for each bin of the level ``_k`` that the range touches: one or two if it lives there."""
    first, last = (F.expr(f"shiftright({x}, {bits} + 2 * _k)") for x in (f"`{start}`", f"`{end}` - 1"))
    return df.withColumn("_bin", F.explode(F.sequence(first, last)))


def _visiting(df: DataFrame, start: str, end: str, bits: int, levels: list[int], above: bool) -> DataFrame:
    """``df`` on each of ``levels`` that is its own or higher (``above``: higher only)."""
    own = _level(start, end, bits)
    up = F.filter(F.array(*[F.lit(k) for k in levels]), lambda k: k > own if above else k >= own)
    return _binned(df.withColumn("_k", F.explode(up)), start, end, bits)


def _met(dwellers: DataFrame, visitors: DataFrame, crowd: int) -> DataFrame:
    """Both sides by level and bin; bins of over ``crowd`` visitors over several tasks."""
    keys = ["_k", "_bin"]
    hot = visitors.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd)
    hot = F.broadcast(hot.select(*keys, F.ceil(F.col("_n") / crowd).cast("int").alias("_n")))  # at most all visitors / crowd rows
    n = F.coalesce("_n", F.lit(1))
    left = visitors.join(hot, keys, "left").withColumn("_salt", F.pmod(F.xxhash64(*[f"`{c}`" for c in visitors.columns]), n).cast("int")).drop("_n")
    right = dwellers.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_n")
    return left.join(right, [*keys, "_salt"]).drop("_salt")


def _crowd(df: DataFrame) -> int:
    return max(CROWD, df.count() // SHARE)


def _levels(df: DataFrame, start: str, end: str, bits: int) -> list[int]:
    return sorted(r[0] for r in df.select(_level(start, end, bits)).distinct().collect())  # LEVELS rows at most


def overlap_join(left: DataFrame, right: DataFrame, bin_width: int = 1 << 6, crowd: int | None = None) -> DataFrame:
    """Pairs of half-open ranges ``[l_start, l_end)`` and ``[r_start, r_end)`` that share a place, once each.

    A pair is kept in the bin of its first shared place, so no distinct is needed.  Empty ranges match nothing.
    ``bin_width``, a power of two, is that of the lowest level.
    """
    bits = bin_width.bit_length() - 1
    a, b = left.where("l_start < l_end"), right.where("r_start < r_end")
    l_levels, r_levels = _levels(a, "l_start", "l_end", bits), _levels(b, "r_start", "r_end", bits)
    live = lambda x, s, e: _binned(x.withColumn("_k", _level(s, e, bits)), s, e, bits)
    up = _met(live(b, "r_start", "r_end"), _visiting(a, "l_start", "l_end", bits, r_levels, False), crowd or _crowd(a))
    down = _met(live(a, "l_start", "l_end"), _visiting(b, "r_start", "r_end", bits, l_levels, True), crowd or _crowd(b))
    both = up.unionByName(down).where((F.col("l_start") < F.col("r_end")) & (F.col("r_start") < F.col("l_end")))
    both = both.where(F.expr(f"shiftright(greatest(l_start, r_start), {bits} + 2 * _k) = _bin"))
    return both.select(*[F.col(f"`{c}`") for c in (*left.columns, *right.columns)])


def trimmed(pairs: DataFrame) -> DataFrame:
    """Overlap rows with the right range clipped to the left one and its anchor (``pos``, ``is_rev``) moved along."""
    lead = F.greatest(F.col("l_start") - F.col("r_start"), F.lit(0))
    s, e = F.greatest("l_start", "r_start"), F.least("l_end", "r_end")
    moved = F.when(F.col("is_rev"), F.col("pos") - lead).otherwise(F.col("pos") + lead)
    return pairs.withColumn("start", s).withColumn("end", e).withColumn("pos", moved)


def point_join(points: DataFrame, ranges: DataFrame, bin_width: int = 1 << 6, crowd: int | None = None) -> DataFrame:
    """Points (column ``p``) with the ranges ``[r_start, r_end)`` that hold them: a point visits one bin of each level that a range lives on."""
    bits = bin_width.bit_length() - 1
    b = ranges.where("r_start < r_end")
    levels = F.array(*[F.lit(k) for k in _levels(b, "r_start", "r_end", bits)]).cast("array<int>")
    a = points.withColumn("_k", F.explode(levels)).withColumn("_bin", F.expr(f"shiftright(p, {bits} + 2 * _k)"))
    b = _binned(b.withColumn("_k", _level("r_start", "r_end", bits)), "r_start", "r_end", bits)
    both = _met(b, a, crowd or _crowd(points)).where("r_start <= p AND p < r_end")
    return both.select(*[F.col(f"`{c}`") for c in (*points.columns, *ranges.columns)])


def asof_join(points: DataFrame, starts: DataFrame, block: int = 1 << 16, **levels: int) -> DataFrame:
    """Each point (``p``) with the row of ``starts`` (``start`` and others) of the largest start <= p.

    Inside a block of positions the last start is a window over both; a block that begins
    inside a range takes the last start of earlier blocks, of which there is one row each (``rank.carried``).
    """
    extra = [c for c in starts.columns if c != "start"]
    s = starts.select(F.struct("start", *extra).alias("_s"), F.col("start").alias("_at"), F.lit(0).alias("_k"))
    p = points.select(F.struct(*points.columns).alias("_p"), F.col("p").alias("_at"), F.lit(1).alias("_k"))
    both = s.unionByName(p, allowMissingColumns=True).withColumn("_b", F.floor(F.col("_at") / block))
    own = both.withColumn("_f", F.last("_s", ignorenulls=True).over(W.partitionBy("_b").orderBy("_at", "_k").rowsBetween(W.unboundedPreceding, 0)))
    ends = both.groupBy("_b").agg(F.max("_s").alias("_c"))
    before = carried(ends, lasts=("_c",), **levels)
    out = own.where("_p IS NOT NULL").join(before, "_b").select("_p.*", F.coalesce("_f", "_c").alias("_s"))
    return out.select(*points.columns, F.col("_s.start").alias("start"), *[F.col(f"_s.{c}").alias(c) for c in extra])
