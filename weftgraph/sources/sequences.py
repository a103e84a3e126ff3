"""FASTA and FASTQ scans, FASTA writer, and saved sequence tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.operators.rank import numbered, running_last, running_sum
from weftgraph.operators.sequences import blocks, build_index
from weftgraph.plans.work import split_join, table
from weftgraph.sources.lines import first_bytes, read_lines


class UnknownFormat(ValueError):
    """A sequence file begins with neither '>' nor '@'."""


def header_name(header: Column) -> Column:
    """The name ends at the first space."""
    return F.substring_index(header, " ", 1)


def sniff(spark: SparkSession, path: str) -> str:
    """``fasta`` or ``fastq``, by the first byte."""
    kind = {b">": "fasta", b"@": "fastq"}.get(first_bytes(spark, path)[:1])
    if not kind:
        raise UnknownFormat(f"{path} begins with neither '>' nor '@'")
    return kind


def record_lines(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, at, text, name): a file's sequence lines with their places in the record; a header is an empty text with a name.

    The lines of plain files come from all splits, so a record is spread over as many tasks as it has splits and is
    no row of its own.  Records and places are running sums over (line number, length) only.
    """
    fastq = sniff(spark, path) == "fastq"
    lines = table(numbered(read_lines(spark, path), "file", "block", "place", name="n"), "lines")
    value = F.regexp_replace("value", "\r", "")
    head = F.col("n") % 4 == 0 if fastq else F.col("value").startswith(">")
    if fastq:  # strict records of four lines: delimiter and quality are dropped
        lines = lines.where("n % 4 < 2")
    lines = lines.select("n", head.alias("_head"), F.when(head, F.substring(value, F.lit(2), F.length("value"))).otherwise(value).alias("text"))
    if fastq:
        placed = lines.select("n", "_head", "text", F.floor(F.col("n") / 4).alias("rec_no"), F.lit(0).cast("long").alias("at"))
    else:
        own = F.when(F.col("_head"), 0).otherwise(F.length("text")).cast("long")
        slim = running_sum(lines.select("n", "_head", F.col("_head").cast("long").alias("_new"), own.alias("_len")), "n", "_new", "_rec")
        slim = table(running_sum(slim, "n", "_len", "_to"), "places")
        slim = running_last(slim.withColumn("_start", F.when(F.col("_head"), F.col("_to"))), "n", "_start", "_from").where("_rec > 0")
        slim = slim.select("n", (F.col("_rec") - 1).alias("rec_no"), (F.col("_to") - F.col("_len") - F.col("_from")).alias("at"))
        placed = lines.join(slim, "n")
    name = F.when(F.col("_head"), header_name(F.col("text"))).alias("name")
    return placed.select("rec_no", "at", F.when(F.col("_head"), F.lit("")).otherwise(F.col("text")).alias("text"), name)


def read_sequences(spark: SparkSession, path: str) -> DataFrame:
    """(rec_no, name, seq): one row a record, for what needs it so; large records are better read by ``read_blocks``."""
    one = F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("at", "text"))))
    text = F.array_join(F.transform(one, lambda x: x["text"]), "")
    return record_lines(spark, path).groupBy("rec_no").agg(F.max("name").alias("name"), text.alias("seq"))


def read_blocks(spark: SparkSession, path: str, check_names: bool = True) -> tuple[DataFrame, DataFrame]:
    """(index, blocks) as ``build_sequences`` and ``blocks`` give them, without a row that holds a record."""
    lines = table(record_lines(spark, path), "record_lines")
    records = lines.groupBy("rec_no").agg(F.max("name").alias("name"), F.sum(F.length("text")).cast("long").alias("seq_len"), F.count("*").alias("c")).where("seq_len > 0")
    index = table(build_index(records, check_names), "index")
    # a chromosome has a good part of all lines: its row goes to them, not they to its task
    placed = split_join(lines.where("text != ''").select("rec_no", "at", "text"), table(index.select("rec_no", "seq_offset", "c"), "offsets"), ["rec_no"], total=lines.count())
    held = placed.select((F.col("seq_offset") + F.col("at")).alias("seq_offset"), F.length("text").cast("long").alias("seq_len"), F.upper("text").alias("seq"))
    return index.select("seq_id", "name", "seq_offset", "seq_len"), blocks(held)


def fasta_lines(sequences: DataFrame, width: int = 60) -> DataFrame:
    """(seq_id, line): a record per row, wrapped at ``width``."""
    wrapped = F.regexp_replace(F.regexp_replace("seq", f"(.{{{width}}})", "$1\n"), "\n$", "")
    return sequences.select("seq_id", F.concat(F.lit(">"), "name", F.lit("\n"), wrapped).alias("line"))


def fastq_lines(sequences: DataFrame) -> DataFrame:
    """(seq_id, line): a record of four lines per row, all of one quality."""
    return sequences.select("seq_id", F.concat(F.lit("@"), "name", F.lit("\n"), "seq", F.lit("\n+\n"), F.repeat(F.lit("I"), F.length("seq"))).alias("line"))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    fasta_lines(sequences, width).orderBy("seq_id").select("line").write.text(path)


def save_index(sequences: DataFrame, path: str) -> None:
    sequences.write.mode("overwrite").parquet(path)


def load_index(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)
