"""The whole plan: sequences and alignments to a graph, every table a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators import closure, graph
from weftgraph.operators.matches import both_directions, unpack
from weftgraph.operators.segments import close_runs, placed
from weftgraph.operators.sequences import bases, blocks
from weftgraph.plans.work import observed, table
from weftgraph.sources.alignments import read_paf_list
from weftgraph.sources.graphs import write_gfa
from weftgraph.sources.sequences import read_blocks


@dataclass
class Graph:
    """Tables of an induced graph."""

    sequences: DataFrame
    runs: DataFrame
    base_map: DataFrame
    chain: DataFrame
    nodes: DataFrame
    steps: DataFrame
    #: Counts that the tables' writes have seen.
    seen: dict[str, int] = field(default_factory=dict)

    @property
    def matches(self) -> DataFrame:
        return both_directions(self.runs)

    @property
    def graph_bases(self) -> DataFrame:
        return closure.graph_bases(self.base_map)

    @property
    def intervals(self) -> DataFrame:
        return closure.path_intervals(self.chain)

    @property
    def links(self) -> DataFrame:
        return graph.links(self.steps)

    @property
    def paths(self) -> DataFrame:
        return graph.paths(self.steps, self.sequences)

    @property
    def gfa(self) -> DataFrame:
        return graph.gfa_records(self.nodes, self.links, self.paths)

    def check(self) -> None:
        graph.check(self.base_map, self.intervals, self.sequences)

    def write_gfa(self, path: str) -> None:
        write_gfa(self.gfa, path)


def induce(
    sequences: DataFrame,
    alignments: DataFrame,
    block_table: DataFrame | None = None,
    min_match_len: int = 0,
    sparse_factor: float = 0.0,
    repeat_max: int = 0,
    min_repeat_dist: int = 0,
    check: bool = True,
) -> Graph:
    """Graph of a sequence table (``build_sequences``; or without ``seq``, but with ``block_table``) and PAF rows (``read_paf``).

    The size of closure batches of other tools has no counterpart: components of
    all bases are found at once and positions are ranks, so no batch changes them.
    """
    seqs = table(sequences.drop("seq"), "sequences")
    held = table(blocks(sequences), "blocks") if block_table is None else block_table
    runs, seen = observed(unpack(alignments, seqs, held, min_match_len, sparse_factor), "matches", runs=F.count(F.lit(1)), bases_matched=F.sum("len"))
    sizes = {"bases_seen": F.count(F.lit(1)), "graph_bases": F.max("s") + 1}
    if repeat_max or min_repeat_dist:
        members = closure.base_components(bases(seqs, held), runs)
        mapped, more = observed(closure.base_map(members, repeat_max, min_repeat_dist), "graph", **sizes)
        chain, text = table(closure.chained(mapped), "chain"), closure.graph_bases(mapped)
    else:  # nothing is split off: positions, ends of intervals and graph bases in one go
        full, more = observed(placed(close_runs(runs), seqs, held), "graph", **sizes)
        mapped, chain, text = full.drop("head", "first", "last"), full.drop("head"), full.where("head").select("s", F.col("s_base").alias("base"))
    seen |= more
    node_table, more = observed(graph.nodes(chain, text), "nodes", nodes=F.count(F.lit(1)))
    step_table, last = observed(graph.steps(mapped, node_table), "paths", steps=F.count(F.lit(1)))
    g = Graph(seqs, runs, mapped, chain, node_table, step_table, seen | more | last)
    if check:
        g.check()
    return g


def induce_files(spark: SparkSession, sequences: str, alignments: str | list[tuple[str, int]], on_bad_row: str = "stop", **options) -> Graph:
    """``induce`` on FASTA or FASTQ and PAF files."""
    index, held = read_blocks(spark, sequences)
    return induce(index, read_paf_list(spark, alignments, on_bad_row), table(held, "blocks"), **options)
