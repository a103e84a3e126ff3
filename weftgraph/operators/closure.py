"""Transitive closure of matched bases: components, graph positions, intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.rank import neighbours, numbered, running_last
from weftgraph.operators.segments import close_runs, expanded, segments
from weftgraph.plans.work import table


def base_components(bases: DataFrame, runs: DataFrame) -> DataFrame:
    """(q, seq_id, base, c, c_base): c is the smallest base of q's component."""
    comp = expanded(close_runs(runs), "u", "v").select(F.col("u").alias("q"), F.col("v").alias("c0"))
    b = bases.join(comp, "q", "left").select("q", "seq_id", "base", F.coalesce("c0", "q").alias("c"))
    heads = bases.select(F.col("q").alias("c"), F.col("base").alias("c_base"))
    return b.join(heads, "c").select("q", "seq_id", "base", "c", "c_base")


def repeat_groups(members: DataFrame, repeat_max: int = 0, min_repeat_dist: int = 0, **levels: int) -> DataFrame:
    """Adds ``g``: 0, or the running number of a base within its component and sequence if it is split off.

    A base is split if it is closer than ``min_repeat_dist`` to the one before it, or
    if more than ``repeat_max`` members have come; split bases of one number share a
    graph base across sequences.
    """
    if not repeat_max and not min_repeat_dist:
        return members.withColumn("g", F.lit(0).cast("long"))
    # places in one order of all, and in each row that of its group's first: no group is a window's partition
    m = table(numbered(members, "c", "seq_id", "q", name="_n"), "ordered")
    m = neighbours(m, "_n", "c", "seq_id", "q", **levels)
    same = F.coalesce((F.col("_prev.c") == F.col("c")) & (F.col("_prev.seq_id") == F.col("seq_id")), F.lit(False))
    m = m.withColumn("_first", F.when(~same, F.col("_n"))).withColumn("_gap", F.when(same, F.col("q") - F.col("_prev.q"))).drop("_prev", "_next")
    m = running_last(m, "_n", "_first", "_from", **levels)
    n = (F.col("_n") - F.col("_from") + 1).cast("long")
    split = F.lit(False)
    if min_repeat_dist:
        split = split | F.coalesce(F.col("_gap") < min_repeat_dist, F.lit(False))
    if repeat_max:
        split = split | (n > repeat_max)
    return m.select(*members.columns, F.when(split, n).otherwise(F.lit(0).cast("long")).alias("g"))


def base_map(members: DataFrame, repeat_max: int = 0, min_repeat_dist: int = 0) -> DataFrame:
    """(q, seq_id, base, s, s_base, is_rev): the graph position of every base."""
    m = table(repeat_groups(members, repeat_max, min_repeat_dist), "groups")
    place = numbered(m.select("c", "g").distinct(), "c", "g", name="s")
    out = m.join(place, ["c", "g"])
    return out.select("q", "seq_id", "base", F.col("s").cast("long").alias("s"), F.col("c_base").alias("s_base"), (F.col("base") != F.col("c_base")).alias("is_rev"))


def map_by_segments(bases: DataFrame, index: DataFrame, runs: DataFrame) -> DataFrame:
    """``base_map`` without repeat groups: components, numbers and places are worked out on segments, and bases made of them last."""
    s = table(segments(close_runs(runs), index), "segments")
    at = expanded(s.select("q", "c", "s", "len", "d"), "q", "c", "s")
    heads = bases.select(F.col("q").alias("c"), F.col("base").alias("s_base"))
    return bases.join(at, "q").join(heads, "c").select("q", "seq_id", "base", "s", "s_base", (F.col("base") != F.col("s_base")).alias("is_rev"))


def graph_bases(mapped: DataFrame) -> DataFrame:
    """(s, base): the graph sequence."""
    return mapped.groupBy("s").agg(F.min("s_base").alias("base"))


def chained(mapped: DataFrame) -> DataFrame:
    """Adds ``first`` and ``last``: whether a base begins or ends an interval.

    A base continues its predecessor's interval if both have one strand and their
    graph positions are neighbours in its direction.
    """
    n = neighbours(mapped, "q", "seq_id", "s", "is_rev")
    step = F.when(F.col("is_rev"), -1).otherwise(1)

    def joined(other: str, sign: int) -> Column:
        o = F.col(other)
        same = (o["q"] == F.col("q") + sign) & (o["seq_id"] == F.col("seq_id")) & (o["is_rev"] == F.col("is_rev"))
        return F.coalesce(same & (o["s"] - F.col("s") == sign * step), F.lit(False))

    return n.withColumn("first", ~joined("_prev", -1)).withColumn("last", ~joined("_next", 1)).drop("_prev", "_next")


def path_intervals(chain: DataFrame) -> DataFrame:
    """(seq_id, q_start, q_end, s_start, s_end, is_rev): an interval's first base meets its last among the ends of all."""
    ends = neighbours(chain.where("first OR last"), "q", "s").where("first")
    q, s = (F.when(F.col("last"), F.col(c)).otherwise(F.col(f"_next.{c}")) for c in ("q", "s"))
    x = ends.select("*", q.alias("_q"), s.alias("_s"))
    return x.select("seq_id", F.col("q").alias("q_start"), (F.col("_q") + 1).alias("q_end"), F.least("s", "_s").alias("s_start"), (F.greatest("s", "_s") + 1).alias("s_end"), "is_rev")
