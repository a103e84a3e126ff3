"""One query per operator, on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions import cigar, dna, positions
from weftgraph.functions.hashing import keep_sparse, match_hash
from weftgraph.functions.text import handy_number_column, tokens
from weftgraph.operators import closure, graph, intervals
from weftgraph.operators.components import connected_components
from weftgraph.operators.matches import base_edges, both_directions, kept_runs, locate, match_index, match_runs, valid_row
from weftgraph.operators.sequences import bases
from weftgraph.plans import files
from weftgraph.plans.events import event_alignments, event_graph, event_sequences, event_tables
from weftgraph.plans.work import table
from weftgraph.sources.alignments import paf_lines, parse_paf, sxs_lines
from weftgraph.sources.graphs import join_lines, node_lines, step_alignment_lines
from weftgraph.sources.sequences import fasta_lines

Query = Callable[[SparkSession, str], DataFrame]
L = lambda c: F.col(c).cast("long").alias(c)


def sequence_index(spark: SparkSession, d: str) -> DataFrame:
    return event_tables(spark, d)[0]


def base_table(spark: SparkSession, d: str) -> DataFrame:
    return bases(*event_tables(spark, d))


def complement(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    return p.select("p_partkey", dna.complement(F.upper("p_name")).alias("complement"))


def revcomp(spark: SparkSession, d: str) -> DataFrame:
    return event_sequences(spark, d).select("seq_id", dna.reverse_complement(F.col("seq")).alias("revcomp"))


def pos_pack_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_custkey") % 2 == 1).alias("rev"))
    p = o.withColumn("pos", positions.make_pos(F.col("o_orderkey"), F.col("rev")))
    return p.select("o_orderkey", "pos", positions.pos_offset(F.col("pos")).alias("off"), positions.pos_is_rev(F.col("pos")).alias("is_rev"), positions.pos_text(F.col("pos")).alias("txt"))


def pos_step(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    pos = positions.make_pos(F.col("o_orderkey") + 10, F.col("o_custkey") % 2 == 1)
    return o.select("o_orderkey", positions.incr_pos(pos).alias("up"), positions.decr_pos(pos, 3).alias("down"), positions.flip_pos(pos).alias("flip"))


def pos_in_sequences(spark: SparkSession, d: str) -> DataFrame:
    s = event_sequences(spark, d)
    at = lambda rev: positions.pos_in_all(F.col("seq_offset"), F.col("seq_len"), F.lit(0).cast("long"), F.lit(rev))
    return s.select("seq_id", at(False).alias("fwd"), at(True).alias("rev"), dna.subseq(F.col("seq"), F.lit(1), F.lit(3)).alias("sub"), dna.base_at(F.col("seq"), F.lit(0), F.lit(True)).alias("base"))


def _cigars(spark: SparkSession, d: str) -> DataFrame:
    q = F.col("l_quantity").cast("long").cast("string")
    text = F.concat(q, F.lit("M"), F.col("l_linenumber").cast("string"), F.lit("I"), F.col("l_suppkey").cast("string"), F.lit("="))
    return spark.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", text.alias("text"))


def cigar_parse(spark: SparkSession, d: str) -> DataFrame:
    c = _cigars(spark, d).select("l_orderkey", "l_linenumber", F.posexplode(cigar.parse_cigar(F.col("text"))).alias("op_no", "x"))
    return c.select("l_orderkey", "l_linenumber", L("op_no"), F.col("x.len").alias("len"), F.col("x.op").alias("op"))


def cigar_format(spark: SparkSession, d: str) -> DataFrame:
    return _cigars(spark, d).select("l_orderkey", "l_linenumber", cigar.format_cigar(cigar.parse_cigar(F.col("text"))).alias("text"))


def handy_numbers(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet")
    value = F.concat(F.col("p_size").cast("string"), F.element_at(F.array(*[F.lit(x) for x in ("k", "M", "g", "", "x")]), (F.col("p_partkey") % 5 + 1).cast("int")))
    return p.select("p_partkey", value.alias("txt"), handy_number_column(value, -1.0).alias("value"))


def tokenize(spark: SparkSession, d: str) -> DataFrame:
    p = spark.read.parquet(f"{d}/part.parquet").select("p_partkey", F.posexplode(tokens(F.col("p_type"), " \t")).alias("i", "token"))
    return p.select("p_partkey", L("i"), "token")


def paf_valid_filter(spark: SparkSession, d: str) -> DataFrame:
    """Rows of lineitem as alignments, some of them out of their declared lengths."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    q, n = F.col("l_quantity").cast("long"), F.col("l_linenumber").cast("long")
    p = li.select("l_orderkey", n.alias("l_linenumber"), F.lit(40).cast("long").alias("query_len"), (n - 1).alias("query_start"), q.alias("query_end"), F.lit(30).cast("long").alias("target_len"), (n * 2 - 2).alias("target_start"), (q - 5).alias("target_end"))
    return p.where(valid_row()).select("l_orderkey", "l_linenumber", "query_start", "query_end", "target_start", "target_end")


def paf_round_trip(spark: SparkSession, d: str) -> DataFrame:
    a = event_alignments(event_tables(spark, d)[0])
    p = parse_paf(paf_lines(a).withColumnRenamed("line", "value"))
    return p.select("query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len", "target_start", "target_end", cigar.format_cigar(F.col("cigar")).alias("cigar"))


def sxs_records(spark: SparkSession, d: str) -> DataFrame:
    a = event_alignments(event_tables(spark, d)[0])
    return sxs_lines(a.withColumn("rec", F.concat_ws(">", "query_name", "target_name"))).select("rec", "line")


def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    return fasta_lines(event_sequences(spark, d))


def pair_enumeration(spark: SparkSession, d: str) -> DataFrame:
    """Unordered pairs of nations of a region, each once."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey", F.col("n_nationkey").alias("a"))
    m = n.select("n_regionkey", F.col("a").alias("b"))
    return n.join(m, "n_regionkey").where("a < b").select("n_regionkey", "a", "b")


def _aligned(index: DataFrame, held: DataFrame, **options) -> DataFrame:
    return kept_runs(match_runs(locate(event_alignments(index), index), held), **options)


def _runs(spark: SparkSession, d: str, **options) -> DataFrame:
    return _aligned(*event_tables(spark, d), **options)


def match_runs_all(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d).select("is_rev", "q", "t", "len")


def match_runs_min_len(spark: SparkSession, d: str) -> DataFrame:
    return _runs(spark, d, min_match_len=2).select("is_rev", "q", "t", "len")


def match_both_directions(spark: SparkSession, d: str) -> DataFrame:
    return both_directions(_runs(spark, d)).select("start", L("end"), "pos", "is_rev")


def nth_match(spark: SparkSession, d: str) -> DataFrame:
    """Every match under its number."""
    return match_index(_runs(spark, d)).select(L("n"), "start", L("end"), "pos", "is_rev")


def _packed(r: DataFrame) -> DataFrame:
    return r.select(positions.make_pos(F.col("q"), F.col("is_rev")).alias("qp"), positions.make_pos(F.col("t"), F.lit(False)).alias("tp"), "len")


def match_hashes(spark: SparkSession, d: str) -> DataFrame:
    return _packed(_runs(spark, d)).select("qp", "tp", "len", match_hash(F.col("qp"), F.col("tp"), F.col("len")).alias("hash"))


def match_sparse(spark: SparkSession, d: str) -> DataFrame:
    return _packed(_runs(spark, d)).where(keep_sparse(F.col("qp"), F.col("tp"), F.col("len"), 0.5))


def seq_asof_lookup(spark: SparkSession, d: str) -> DataFrame:
    s = event_tables(spark, d)[0].select(F.col("seq_offset").alias("start"), "seq_id")
    p = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("p"))
    return intervals.asof_join(p, s).select("p", "start", "seq_id")


def _order_ranges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    o = spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", (F.col("o_orderkey") * 3).alias("s"), (F.col("o_custkey") % 9 + 1).alias("n"))
    left = o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").alias("l_id"), F.col("s").alias("l_start"), (F.col("s") + F.col("n")).alias("l_end"))
    right = o.where("o_orderkey % 2 = 1").select(F.col("o_orderkey").alias("r_id"), F.col("s").alias("r_start"), (F.col("s") + F.col("n")).alias("r_end"), (F.col("s") * 2 + 50).alias("pos"), (F.col("o_orderkey") % 3 == 0).alias("is_rev"))
    return left, right


def interval_overlap_join(spark: SparkSession, d: str) -> DataFrame:
    return intervals.trimmed(intervals.overlap_join(*_order_ranges(spark, d), bin_width=64)).select("l_id", "r_id", "start", "end", "pos", "is_rev")


def point_in_interval(spark: SparkSession, d: str) -> DataFrame:
    left, right = _order_ranges(spark, d)
    return intervals.point_join(left.select("l_id", F.col("l_start").alias("p")), right, bin_width=64).select("l_id", "p", "r_id")


def components(spark: SparkSession, d: str) -> DataFrame:
    return connected_components(base_edges(_runs(spark, d))).select(F.col("node").alias("q"), F.col("component").alias("c"))


def component_sizes(spark: SparkSession, d: str) -> DataFrame:
    return components(spark, d).groupBy("c").agg(F.count("*").alias("n"), F.min("q").alias("low"), F.max("q").alias("high"))


def _members(spark: SparkSession, d: str) -> DataFrame:
    index, held = event_tables(spark, d)
    return table(closure.base_components(bases(index, held), _aligned(index, held)), "members")


def repeat_groups_r1(spark: SparkSession, d: str) -> DataFrame:
    return closure.repeat_groups(_members(spark, d), repeat_max=1).select("q", "c", "g")


def repeat_groups_l(spark: SparkSession, d: str) -> DataFrame:
    return closure.repeat_groups(_members(spark, d), min_repeat_dist=4).select("q", "c", "g")


def base_map(spark: SparkSession, d: str) -> DataFrame:
    return closure.base_map(_members(spark, d)).select("q", "seq_id", "s", "is_rev")


def closure_segments(spark: SparkSession, d: str) -> DataFrame:
    """Every base of the segments that the runs close to."""
    index, held = event_tables(spark, d)
    return closure.map_by_segments(bases(index, held), index, _aligned(index, held)).select("q", "seq_id", "s", "is_rev")


def base_map_r2(spark: SparkSession, d: str) -> DataFrame:
    return closure.base_map(_members(spark, d), repeat_max=2).select("q", "seq_id", "s", "is_rev")


def graph_bases(spark: SparkSession, d: str) -> DataFrame:
    return closure.graph_bases(closure.base_map(_members(spark, d)))


def path_intervals(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).intervals


def node_table(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).nodes.select("node_id", "s_start", "s_end", "seq")


def path_steps(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).steps.select("seq_id", "q", "node_id", "is_rev")


def links(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).links.drop("n")


def link_frequency(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).links


def gfa_lines(spark: SparkSession, d: str) -> DataFrame:
    return event_graph(spark, d).gfa.select("line")


def scaffold_lines(spark: SparkSession, d: str) -> DataFrame:
    """S, J and A/I lines of the graph."""
    g = event_graph(spark, d)
    return node_lines(g.nodes).select("line").union(join_lines(g.links).select("line")).union(step_alignment_lines(g.steps, g.nodes, g.sequences).select("line"))


def validate_paths(spark: SparkSession, d: str) -> DataFrame:
    g = event_graph(spark, d)
    n = g.intervals.groupBy("seq_id").agg(F.sum(F.col("q_end") - F.col("q_start")).alias("spelled"))
    bad = graph.spelling_faults(g.base_map).groupBy("seq_id").agg(F.count("*").alias("faults"))
    return g.sequences.join(n, "seq_id", "left").join(bad, "seq_id", "left").select("seq_id", "seq_len", "spelled", F.coalesce("faults", F.lit(0)).cast("long").alias("faults"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        sequence_index, base_table, complement, revcomp, pos_pack_roundtrip, pos_step, pos_in_sequences, cigar_parse, cigar_format, handy_numbers, tokenize,
        paf_valid_filter, paf_round_trip, sxs_records, fasta_records, pair_enumeration, match_runs_min_len, match_both_directions, nth_match, match_sparse,
        seq_asof_lookup, interval_overlap_join, point_in_interval, component_sizes, repeat_groups_r1, repeat_groups_l, base_map, closure_segments, base_map_r2, graph_bases,
        path_intervals, node_table, path_steps, links, link_frequency, gfa_lines, scaffold_lines, validate_paths,
    )
} | {"match_runs": match_runs_all, "match_hash": match_hashes, "connected_components": components} | files.QUERIES
