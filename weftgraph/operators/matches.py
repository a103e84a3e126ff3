"""Alignments to exact-match intervals.

CIGAR entries are rows with running offsets; an entry is cut where its query or
its target crosses a block of the concatenation (``operators.sequences``), each piece meets its
two blocks by equi-joins and keeps only its own slice of them.  The slices are compared an Arrow batch at a time, so
no row per base is made, and no row holds a sequence.  Runs never cross entries: ``M``, ``=`` and ``X`` are all
compared again, ``I`` and ``D`` move one cursor, others move none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.functions.cigar import consumed
from weftgraph.functions.dna import equal_runs, reverse_complement
from weftgraph.functions.hashing import keep_sparse
from weftgraph.functions.positions import make_pos
from weftgraph.operators.rank import numbered
from weftgraph.operators.sequences import BLOCK
from weftgraph.plans.work import table


class UnknownSequence(ValueError):
    """An alignment names a sequence that is not there."""


def valid_row() -> Column:
    """Non-zero lengths and ranges inside the declared lengths."""
    ok = F.lit(True)
    for x in ("query", "target"):
        s, e, n = (F.col(f"{x}_{y}") for y in ("start", "end", "len"))
        ok = ok & (n > 0) & (s >= 0) & (s < n) & (s < e) & (e <= n)
    return F.coalesce(ok, F.lit(False))


def locate(paf: DataFrame, sequences: DataFrame) -> DataFrame:
    """Alignments with numbers (``aln``) and the places of the sequences they name, written; an unknown name raises."""
    ids = sequences.select("name", "seq_id", "seq_offset", "seq_len")
    out = paf
    for x in ("query", "target"):
        out = out.join(ids.select(F.col("name").alias(f"{x}_name"), *[F.col(c).alias(f"{x[0]}_{c}") for c in ("seq_offset", "seq_len")]), f"{x}_name", "left")
    out = table(out.withColumn("aln", F.monotonically_increasing_id()), "located")
    lost = out.where("q_seq_len IS NULL OR t_seq_len IS NULL").select(F.when(F.col("q_seq_len").isNull(), F.col("query_name")).otherwise(F.col("target_name")).alias("name")).limit(5).collect()
    if lost:
        raise UnknownSequence(f"alignments name unknown sequences, such as {', '.join(sorted({str(r.name) for r in lost}))}")
    return out


def cigar_steps(located: DataFrame) -> DataFrame:
    """One row per CIGAR entry with the bases both sides consumed before it (``a``, ``b``)."""
    steps = located.select("*", F.posexplode("cigar").alias("op_no", "_c")).drop("cigar").withColumn("len", F.col("_c.len")).withColumn("op", F.col("_c.op")).drop("_c")
    before = W.partitionBy("aln").orderBy("op_no").rowsBetween(W.unboundedPreceding, -1)
    for name, by in (("a", "q"), ("b", "t")):
        steps = steps.withColumn(name, F.coalesce(F.sum(consumed(F.col("op"), F.col("len"), by)).over(before), F.lit(0)).cast("long"))
    return steps


def match_runs(located: DataFrame, block_table: DataFrame, width: int = BLOCK) -> DataFrame:
    """(aln, min_match_len, is_rev, q, t, len): maximal exact runs; q is the first compared base of the query.

    A base pair matches if it is equal, is not N and is not one and the same place.
    """
    slim = ["aln", "min_match_len", "strand", "query_name", "target_name", "query_start", "query_end", "target_start", "q_seq_offset", "q_seq_len", "t_seq_offset", "t_seq_len", "cigar"]
    s = cigar_steps(located.select(*slim)).where(F.col("op").isin("M", "=", "X") & (F.col("len") > 0))
    rev = F.col("strand") != "+"
    ql = F.when(rev, F.col("query_end") - 1 - F.col("a")).otherwise(F.col("query_start") + F.col("a"))
    s = s.withColumn("is_rev", rev).withColumn("ql", ql).withColumn("tl", F.col("target_start") + F.col("b"))
    low = F.when(rev, F.col("ql") - F.col("len") + 1).otherwise(F.col("ql"))
    bad = (low < 0) | (low + F.col("len") > F.col("q_seq_len")) | (F.col("tl") + F.col("len") > F.col("t_seq_len"))
    fault = F.raise_error(F.concat(F.lit("alignment leaves its sequence: "), F.col("query_name"), F.lit(" "), F.col("target_name"))).cast("long")
    s = s.select("aln", "op_no", "min_match_len", "is_rev", "len", F.when(bad, fault).otherwise(F.col("q_seq_offset") + F.col("ql")).alias("q0"), (F.col("t_seq_offset") + F.col("tl")).alias("t0"))
    # where the query or the target enters another block
    q_cut = F.when(F.col("is_rev"), F.col("q0") % width + 1).otherwise(width - F.col("q0") % width)
    t_cut = width - F.col("t0") % width
    every = lambda c: F.when(c < F.col("len"), F.sequence(c, F.col("len") - 1, F.lit(width).cast("long"))).otherwise(F.array().cast("array<bigint>"))
    s = s.withColumn("_cuts", F.array_sort(F.concat(F.array(F.lit(0).cast("long")), F.array_union(every(q_cut), every(t_cut)))))
    s = s.select("*", F.posexplode("_cuts").alias("_j", "at")).withColumn("n", F.coalesce(F.get("_cuts", F.col("_j") + 1), F.col("len")) - F.col("at")).drop("_cuts", "_j")
    step = F.when(F.col("is_rev"), -1).otherwise(1)
    first = F.when(F.col("is_rev"), F.col("q0") - F.col("at") - F.col("n") + 1).otherwise(F.col("q0") + F.col("at"))
    for name, place in (("_qs", first), ("_ts", F.col("t0") + F.col("at"))):
        s = s.withColumn("_p", place).withColumn("block", F.floor(F.col("_p") / width))
        slice_ = F.substring(F.col("text"), (F.col("_p") % width + 1).cast("int"), F.col("n").cast("int"))
        s = s.join(block_table, "block").withColumn(name, slice_).drop("text", "_p", "block")
    query = F.when(F.col("is_rev"), reverse_complement(F.col("_qs"))).otherwise(F.col("_qs"))
    # a base is no match of itself: a forward piece lies on itself wholly or not at all, a reverse one at one base
    apart = (F.col("q0") + step * F.col("at")) - (F.col("t0") + F.col("at"))
    own = F.when(F.col("is_rev") & (apart % 2 == 0) & (apart >= 0) & (apart < 2 * F.col("n")), F.floor(apart / 2))
    got = equal_runs(query, F.col("_ts"), own)
    s = s.where(F.col("is_rev") | (F.col("q0") != F.col("t0")))
    s = s.select("aln", "op_no", "min_match_len", "is_rev", "q0", "t0", "at", "n", F.col("len").alias("_all"), F.explode(got).alias("_r"))
    cut = (F.col("_r.s") == 0) & (F.col("at") > 0) | (F.col("_r.e") == F.col("n")) & (F.col("at") + F.col("n") < F.col("_all"))
    s = s.select("aln", "op_no", "min_match_len", "is_rev", "q0", "t0", (F.col("at") + F.col("_r.s")).alias("i"), (F.col("_r.e") - F.col("_r.s")).alias("len"), cut.alias("_cut"))
    # runs that a border may have cut grow together again
    key = ["aln", "op_no", "min_match_len", "is_rev", "q0", "t0"]
    w = W.partitionBy("aln", "op_no").orderBy("i")
    ends = s.where("_cut").withColumn("_new", F.when(F.col("i") == F.lag(F.col("i") + F.col("len")).over(w), 0).otherwise(1))
    ends = ends.withColumn("_g", F.sum("_new").over(w)).groupBy(*key, "_g").agg(F.min("i").alias("i"), F.sum("len").alias("len")).select(*key, "i", "len")
    s = s.where("NOT _cut").select(*key, "i", "len").unionByName(ends)
    return s.select("aln", "min_match_len", "is_rev", (F.col("q0") + step * F.col("i")).alias("q"), (F.col("t0") + F.col("i")).alias("t"), "len")


def kept_runs(runs: DataFrame, min_match_len: int = 0, sparse_factor: float = 0.0) -> DataFrame:
    """Runs of the file's shortest length (or else the common one), thinned by hash if a factor is given."""
    least = F.coalesce(F.nullif(F.col("min_match_len"), F.lit(0)), F.lit(min_match_len))
    out = runs.where(F.col("len") >= least)
    if sparse_factor:
        out = out.where(keep_sparse(make_pos(F.col("q"), F.col("is_rev")), make_pos(F.col("t"), F.lit(False)), F.col("len"), sparse_factor))
    return out


def both_directions(runs: DataFrame) -> DataFrame:
    """(start, end, pos, is_rev): each run as an interval on the query with its place on the target, and the other way round."""
    n = F.col("len")
    fwd = F.when(F.col("is_rev"), F.col("q") - n + 1).otherwise(F.col("q"))
    one = runs.select(fwd.alias("start"), (fwd + n).alias("end"), F.when(F.col("is_rev"), F.col("t") + n - 1).otherwise(F.col("t")).alias("pos"), "is_rev")
    two = runs.select(F.col("t").alias("start"), (F.col("t") + n).alias("end"), F.col("q").alias("pos"), "is_rev")
    return one.unionAll(two)


def match_index(runs: DataFrame) -> DataFrame:
    """``both_directions`` with the number ``n`` of each match in the order of its fields, so that the nth one is a filter."""
    return numbered(both_directions(runs), "start", "end", "pos", "is_rev", name="n")


def unpack(paf: DataFrame, index: DataFrame, block_table: DataFrame, min_match_len: int = 0, sparse_factor: float = 0.0) -> DataFrame:
    return kept_runs(match_runs(locate(paf, index), block_table), min_match_len, sparse_factor)


def base_edges(runs: DataFrame) -> DataFrame:
    """(u, v): one row per pair of matched bases; runs that say the same are taken once."""
    step = F.when(F.col("is_rev"), -1).otherwise(1)
    r = runs.select("is_rev", "q", "t", "len").distinct()
    return r.select("q", "t", step.alias("d"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("y")).select((F.col("q") + F.col("d") * F.col("y")).alias("u"), (F.col("t") + F.col("y")).alias("v"))
