"""Nodes, path steps, links, GFA records and checks of a closed graph."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.functions.dna import complement
from weftgraph.functions.positions import strand
from weftgraph.operators.rank import carried, neighbours
from weftgraph.operators.segments import groups, strings
from weftgraph.operators.sequences import BLOCK
from weftgraph.plans.work import table

_NEVER = np.iinfo(np.int64).max


class BrokenGraph(RuntimeError):
    """The graph does not spell its input."""


def node_cuts(chain: DataFrame) -> DataFrame:
    """(s): graph positions where a node begins or the graph ends, as often as intervals do: both ends of every interval."""
    low = F.when((F.col("first") & ~F.col("is_rev")) | (F.col("last") & F.col("is_rev")), F.col("s"))
    high = F.when((F.col("last") & ~F.col("is_rev")) | (F.col("first") & F.col("is_rev")), F.col("s") + 1)
    return chain.select(F.explode(F.array_compact(F.array(low, high))).alias("s"))


def nodes(chain: DataFrame, graph: DataFrame, width: int = BLOCK) -> DataFrame:
    """(node_id from 1, s_start, s_end, seq).

    The cuts and bases of a block of graph positions are arrays of ``width`` at most; a block's numbers and the end of its last node
    come from a scan of one row a block, and only nodes that cross a border are put together from parts.
    """
    none = F.lit(-1).cast("int")
    rows = node_cuts(chain).select("s", none.alias("code")).unionByName(graph.select("s", F.ascii("base").alias("code")))
    rows = rows.withColumn("block", F.floor(F.col("s") / width)).repartition("block").sortWithinPartitions("block")

    def gather(batches):
        own, cut, codes = None, None, None

        def out():
            at = np.flatnonzero(cut)
            lists = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x)) for x in (at + own * width, codes[codes >= 0])]
            row = [pa.array([own]), pa.array([len(at)]), pa.array([int(at[0]) + own * width if len(at) else None], pa.int64()), *lists]
            return pa.RecordBatch.from_arrays(row, names=["block", "n", "low", "cuts", "codes"])

        for b in batches:
            s, code, block = (b.column(c).to_numpy() for c in ("s", "code", "block"))
            for lo, hi in groups(block) if len(block) else ():
                if own != int(block[lo]):
                    if own is not None:
                        yield out()
                    own, cut, codes = int(block[lo]), np.zeros(width, bool), np.full(width, -1, np.int32)
                at, x = s[lo:hi] - own * width, code[lo:hi]
                cut[at[x < 0]] = True
                codes[at[x >= 0]] = x[x >= 0]
        if own is not None:
            yield out()

    blocks = table(rows.mapInArrow(gather, "block bigint, n bigint, low bigint, cuts array<bigint>, codes array<int>"), "cuts")
    around = carried(blocks.select(F.col("block").alias("_b"), F.col("n").alias("_n"), F.col("low").alias("_low")), sums=("_n",), firsts=("_low",))
    around = around.select(F.col("_b").alias("block"), F.col("_n").cast("long").alias("before"), F.col("_low").alias("after"))

    def cut_out(batches):
        for b in batches:
            for k in range(b.num_rows):
                at, before, after = (b.column(c)[k].as_py() for c in ("block", "before", "after"))
                cuts, codes = (b.column(c)[k].values.to_numpy() for c in ("cuts", "codes"))
                # what comes before the first cut goes on with an earlier node
                start = np.append(at * width, cuts)
                end = np.append(cuts, _NEVER if after is None else after)
                head = np.minimum(start - at * width, len(codes)).astype(np.int32)
                text = strings(codes, np.append(head, len(codes)).astype(np.int32))
                node = before + np.arange(len(start))
                whole = np.append(False, end[1:] <= (at + 1) * width)
                keep = (node > 0) & (end > start) & (np.append(head[1:], len(codes)) > head)
                keep &= ~((end == _NEVER) & (np.arange(len(start)) > 0)) & (after is not None or len(cuts) > 0)
                cols = [pa.array(node), pa.array(start), pa.array(end), text, pa.array(whole)]
                yield pa.RecordBatch.from_arrays(cols, names=["node_id", "s_start", "s_end", "seq", "whole"]).filter(pa.array(keep))

    parts = table(blocks.join(around, "block").mapInArrow(cut_out, "node_id bigint, s_start bigint, s_end bigint, seq string, whole boolean"), "parts")
    # an earlier node's part begins at a border; all parts of a node end at the same place
    one = F.transform(F.array_sort(F.collect_list(F.struct("s_start", "seq"))), lambda x: x["seq"])
    joined = parts.where("NOT whole").groupBy("node_id").agg(F.min("s_start").alias("s_start"), F.max("s_end").alias("s_end"), F.array_join(one, "").alias("seq"))
    return parts.where("whole").drop("whole").unionByName(joined)


def steps(mapped: DataFrame, node_table: DataFrame) -> DataFrame:
    """(seq_id, q, node_id, is_rev): a step where a path is at the first graph position of a node."""
    heads = node_table.select(F.col("s_start").alias("s"), "node_id")
    return mapped.join(heads, "s").select("seq_id", "q", "node_id", "is_rev")


def step_pairs(step_table: DataFrame) -> DataFrame:
    """(from_id, from_rev, to_id, to_rev) of each two steps in a row."""
    s = neighbours(step_table, "q", "seq_id", "node_id", "is_rev").where(F.col("_next.seq_id") == F.col("seq_id"))
    return s.select(F.col("node_id").alias("from_id"), F.col("is_rev").alias("from_rev"), F.col("_next.node_id").alias("to_id"), F.col("_next.is_rev").alias("to_rev"))


def links(step_table: DataFrame) -> DataFrame:
    """Distinct links with ``n``, how often paths take them."""
    return step_pairs(step_table).groupBy("from_id", "from_rev", "to_id", "to_rev").agg(F.count("*").alias("n"))


def paths(step_table: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, name, steps): the path text of each sequence."""
    one = F.struct("q", F.concat(F.col("node_id").cast("string"), strand(F.col("is_rev"))).alias("x"))
    text = step_table.groupBy("seq_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(one)), lambda x: x["x"]), ",").alias("steps"))
    return sequences.select("seq_id", "name").join(text, "seq_id")


def gfa_records(node_table: DataFrame, link_table: DataFrame, path_table: DataFrame) -> DataFrame:
    """(kind, k1, k2, k3, k4, line): GFA 1 lines with their sort keys (H, S by id, L by ends, P by sequence)."""
    zero = F.lit(0).cast("long")
    spark = node_table.sparkSession
    head = spark.range(1).select(F.lit(0).alias("kind"), *[zero.alias(f"k{i}") for i in (1, 2, 3, 4)], F.lit("H\tVN:Z:1.0").alias("line"))
    s = node_table.select(F.lit(1), "node_id", zero, zero, zero, F.concat_ws("\t", F.lit("S"), F.col("node_id").cast("string"), "seq"))
    ends = ["from_id", F.col("from_rev").cast("long"), "to_id", F.col("to_rev").cast("long")]
    line = F.concat_ws("\t", F.lit("L"), F.col("from_id").cast("string"), strand(F.col("from_rev")), F.col("to_id").cast("string"), strand(F.col("to_rev")), F.lit("0M"))
    k = link_table.select(F.lit(2), *ends, line)
    p = path_table.select(F.lit(3), "seq_id", zero, zero, zero, F.concat_ws("\t", F.lit("P"), "name", "steps", F.lit("*")))
    return head.union(s).union(k).union(p)


def spelling_faults(mapped: DataFrame) -> DataFrame:
    """Bases whose graph base, complemented on the reverse strand, is not their own."""
    spelled = F.when(F.col("is_rev"), complement(F.col("s_base"))).otherwise(F.col("s_base"))
    return mapped.where(spelled != F.col("base"))


def map_faults(mapped: DataFrame) -> DataFrame:
    """(q, n): bases that have not exactly one graph position."""
    return mapped.groupBy("q").agg(F.count("*").alias("n")).where("n != 1")


def check(mapped: DataFrame, intervals: DataFrame, sequences: DataFrame) -> None:
    """Raises if a base is mapped never or twice, a path spells another text or has another length."""
    if bad := spelling_faults(mapped).limit(1).collect():
        raise BrokenGraph(f"base {bad[0].q} of sequence {bad[0].seq_id} is not what its graph position says")
    if bad := map_faults(mapped).limit(1).collect():
        raise BrokenGraph(f"base {bad[0].q} has {bad[0].n} graph positions")
    lengths = intervals.groupBy("seq_id").agg(F.sum(F.col("q_end") - F.col("q_start")).alias("n"))
    if bad := sequences.join(lengths, "seq_id", "left").where("n IS NULL OR n != seq_len").limit(1).collect():
        raise BrokenGraph(f"the path of {bad[0]['name']} has {bad[0].n} bases, not {bad[0].seq_len}")
