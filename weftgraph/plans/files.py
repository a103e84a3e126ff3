"""Queries that write files made of the driver's tables and read them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.hashing import integer_hash
from weftgraph.operators.graph import map_faults
from weftgraph.operators.rank import numbered
from weftgraph.operators.sequences import build_sequences, repeated_names
from weftgraph.plans.events import event_alignments, event_graph, event_sequences, event_tables
from weftgraph.plans.work import scratch
from weftgraph.sources.alignments import paf_line, read_paf, read_paf_list, read_sxs, sxs_lines
from weftgraph.sources.graphs import write_gfa, write_scaffolds
from weftgraph.sources.lines import read_lines
from weftgraph.sources.sequences import fasta_lines, fastq_lines, header_name, load_index, read_sequences, save_index, sniff

#: Alignment lines before a blank one in ``paf_stop``.
STOP = 100


def _path(spark: SparkSession) -> str:
    return scratch(spark, "files")


def _odd_names(sequences: DataFrame) -> DataFrame:
    """Names of which every third begins with '>', and a note behind them."""
    return sequences.withColumn("name", F.concat(F.when(F.col("seq_id") % 3 == 0, ">").otherwise(""), "name", F.lit(" of "), F.col("seq_len").cast("string"), F.lit(" bases")))


def fasta_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    fasta_lines(_odd_names(event_sequences(spark, d)), 50).orderBy("seq_id").select("line").write.text(path)
    return read_sequences(spark, path)


def fastq_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    fastq_lines(_odd_names(event_sequences(spark, d))).orderBy("seq_id").select("line").write.text(path)
    return read_sequences(spark, path)


def gzip_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    fasta_lines(event_sequences(spark, d)).orderBy("seq_id").select("line").write.option("compression", "gzip").text(path)
    return read_sequences(spark, path)


def format_sniff(spark: SparkSession, d: str) -> DataFrame:
    """What the first letter of a file of either format says."""
    s = event_sequences(spark, d)
    out = []
    for lines in (fasta_lines(s), fastq_lines(s)):
        path = _path(spark)
        lines.orderBy("seq_id").select("line").write.text(path)
        out.append((len(out), sniff(spark, path)))
    return spark.createDataFrame(out, "n int, kind string")


def _alignments(spark: SparkSession, d: str) -> DataFrame:
    """PAF lines in order: by query number, the alignment with the next sequence first."""
    index, _ = event_tables(spark, d)
    a = event_alignments(index).join(index.select(F.col("name").alias("query_name"), "seq_id"), "query_name")
    order = F.col("seq_id") * 2 + F.when(F.col("query_name") == F.col("target_name"), 1).otherwise(0)
    return a.select(order.alias("n"), (F.col("query_name") == F.col("target_name")).alias("own"), paf_line().alias("line"))


_PAF = ("query_name", "query_len", "query_start", "query_end", "strand", "target_name", "target_len", "target_start", "target_end")


def paf_list_scan(spark: SparkSession, d: str) -> DataFrame:
    """Two files, one with a shortest match of its own."""
    lines, spec = _alignments(spark, d), []
    for own, least in ((False, 3), (True, 0)):
        path = _path(spark)
        lines.where(F.col("own") == own).orderBy("n").select("line").write.text(path)
        spec.append((path, least))
    return read_paf_list(spark, spec).select(*_PAF, "min_match_len")


def _broken(spark: SparkSession, d: str) -> str:
    """A file with a blank line after ``STOP`` alignments."""
    lines = numbered(_alignments(spark, d), "n", name="k")
    blank = spark.range(1).select(F.lit(STOP - 0.5).alias("k"), F.lit("").alias("line"))
    path = _path(spark)
    lines.select(F.col("k").cast("double").alias("k"), "line").unionByName(blank).orderBy("k").select("line").write.text(path)
    return path


def paf_stop(spark: SparkSession, d: str) -> DataFrame:
    return read_paf(spark, _broken(spark, d)).select(*_PAF)


def paf_skip(spark: SparkSession, d: str) -> DataFrame:
    return read_paf(spark, _broken(spark, d), on_bad_row="skip").select(*_PAF)


def sxs_scan(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    a = event_alignments(event_tables(spark, d)[0])
    sxs_lines(a.withColumn("rec", F.concat_ws(">", "query_name", "target_name"))).orderBy("rec").select("line").write.text(path)
    r = read_sxs(spark, path)
    return r.select("query_name", "target_name", "query_start", "query_end", "target_start", "target_end", "num_matches", F.col("cigar")[0]["len"].alias("len"), F.col("cigar")[0]["op"].alias("op"), "mapq")


def gfa_file(spark: SparkSession, d: str) -> DataFrame:
    """(n, line): the written graph, line by line in the order of its files."""
    path = _path(spark)
    write_gfa(event_graph(spark, d).gfa, path)
    return numbered(read_lines(spark, path), "file", "block", "place", name="n").select("n", F.col("value").alias("line"))


def scaffold_files(spark: SparkSession, d: str) -> DataFrame:
    """(kind, n, line) of the three written folders."""
    path = _path(spark)
    g = event_graph(spark, d)
    write_scaffolds(g.nodes, g.links, g.steps, g.sequences, path)
    out = None
    for kind in ("seq", "scf", "sxs"):
        one = numbered(read_lines(spark, f"{path}/{kind}"), "file", "block", "place", name="n").select(F.lit(kind).alias("kind"), "n", F.col("value").alias("line"))
        out = one if out is None else out.unionByName(one)
    return out


def index_round_trip(spark: SparkSession, d: str) -> DataFrame:
    path = _path(spark)
    save_index(event_tables(spark, d)[0], path)
    return load_index(spark, path)


def duplicate_names(spark: SparkSession, d: str) -> DataFrame:
    """Customers' nations as names."""
    c = spark.read.parquet(f"{d}/customer.parquet")
    return repeated_names(c.select(F.col("c_custkey").alias("rec_no"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("name")))


def part_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Part names as sequences in mixed case; every seventh is empty and left out."""
    p = spark.read.parquet(f"{d}/part.parquet")
    seq = F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.lower(F.translate("p_name", " ", "")))
    return build_sequences(p.select(F.col("p_partkey").cast("long").alias("rec_no"), F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("name"), seq.alias("seq")))


def header_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/part.parquet").select("p_partkey", header_name(F.col("p_name")).alias("name"))


def integer_hashes(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/orders.parquet").select("o_orderkey", integer_hash(F.col("o_orderkey") * 1_000_003).alias("hash"))


def map_fault_counts(spark: SparkSession, d: str) -> DataFrame:
    """Every tenth base mapped twice."""
    m = event_graph(spark, d).base_map
    return map_faults(m.unionAll(m.where("q % 10 = 0")))


def pair_one_vs_rest(spark: SparkSession, d: str) -> DataFrame:
    """Each nation with all other nations of its region."""
    n = spark.read.parquet(f"{d}/nation.parquet").select("n_regionkey", F.col("n_nationkey").alias("a"))
    return n.join(n.withColumnRenamed("a", "b"), "n_regionkey").where("a != b")


QUERIES = {
    f.__name__: f
    for f in (
        fasta_scan, fastq_scan, gzip_scan, format_sniff, paf_list_scan, paf_stop, paf_skip, sxs_scan, gfa_file, scaffold_files, index_round_trip, duplicate_names,
        part_sequences, header_names, integer_hashes, map_fault_counts, pair_one_vs_rest,
    )
}
