"""GFA 1 and scaffold-style sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_gfa(records: DataFrame, path: str) -> None:
    """Lines in order, as range-sorted part files of one folder."""
    records.orderBy("kind", "k1", "k2", "k3", "k4").select("line").write.text(path)


def node_lines(nodes: DataFrame) -> DataFrame:
    """(node_id, line): S, length and text."""
    return nodes.select("node_id", F.concat_ws("\t", F.lit("S"), F.length("seq").cast("string"), "seq").alias("line"))


def join_lines(links: DataFrame) -> DataFrame:
    """(from_id, to_id, line): J with the end of each node that the link touches."""
    start = F.when(F.col("from_rev"), "s").otherwise("e")
    end = F.when(F.col("to_rev"), "e").otherwise("s")
    return links.select("from_id", "to_id", F.concat_ws("\t", F.lit("J"), F.col("from_id").cast("string"), F.col("to_id").cast("string"), start, end).alias("line"))


def step_alignment_lines(steps: DataFrame, nodes: DataFrame, sequences: DataFrame) -> DataFrame:
    """(seq_id, q, line): A and I lines of every step: the node against its place in the sequence.

    A forward step begins where the path enters the node, a reverse step ends there.
    """
    n = steps.join(nodes.select("node_id", (F.col("s_end") - F.col("s_start")).alias("n")), "node_id").join(sequences.select("seq_id", "name", "seq_offset"), "seq_id")
    a = F.col("q") - F.col("seq_offset") - F.when(F.col("is_rev"), F.col("n") - 1).otherwise(0)
    b = a + F.col("n")
    s, e = F.when(F.col("is_rev"), b).otherwise(a), F.when(F.col("is_rev"), a).otherwise(b)
    line = F.concat_ws("\n", F.concat_ws("\t", F.lit("A"), F.col("node_id").cast("string"), "name"), F.concat_ws("\t", F.lit("I"), F.lit("0"), F.col("n").cast("string"), s.cast("string"), e.cast("string")))
    return n.select("seq_id", "q", line.alias("line"))


def write_scaffolds(nodes: DataFrame, links: DataFrame, steps: DataFrame, sequences: DataFrame, path: str) -> None:
    """Three folders: ``seq`` (nodes by id), ``scf`` (joins by ends) and ``sxs`` (steps by sequence and place)."""
    node_lines(nodes).orderBy("node_id").select("line").write.text(f"{path}/seq")
    join_lines(links).orderBy("from_id", "to_id", "line").select("line").write.text(f"{path}/scf")
    step_alignment_lines(steps, nodes, sequences).orderBy("q").select("line").write.text(f"{path}/sxs")
