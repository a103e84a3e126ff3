"""Sequences and alignments made of the ``events`` table, so that every operator runs on tables.

An event type is a base; the events of a user in time order are a sequence; each user
is aligned with the next one (reverse if the user number divides by 3) and with itself
shifted by two.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.cigar import CIGAR_TYPE
from weftgraph.operators.rank import numbered
from weftgraph.operators.sequences import blocks_of_bases, with_text
from weftgraph.plans.induce import Graph, induce
from weftgraph.plans.work import table

#: Event type -> base; any other type is N.
EVENT_BASES = {"click": "A", "purchase": "C", "signup": "G", "view": "T"}


def event_bases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, ts, event_id, base, q): events with their place in the concatenation, by a range sort."""
    base = F.lit("N")
    for kind, b in EVENT_BASES.items():
        base = F.when(F.col("event_type") == kind, b).otherwise(base)
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_id", base.alias("base"))
    return numbered(e, "user_id", "ts", "event_id", name="q")


def event_index(placed: DataFrame) -> DataFrame:
    """(seq_id, name, seq_offset, seq_len): no user's events are gathered."""
    own = placed.groupBy("user_id").agg(F.min("q").alias("seq_offset"), F.count("*").alias("seq_len"))
    own = numbered(own, "seq_offset", name="seq_id", start=1)
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    return table(own.select(F.col("seq_id").cast("long").alias("seq_id"), name.alias("name"), F.col("seq_offset").cast("long").alias("seq_offset"), "seq_len"), "event_index")


def event_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(index, blocks) of the events' sequences."""
    placed = event_bases(spark, sf_dir)
    return event_index(placed), table(blocks_of_bases(placed), "event_blocks")


def event_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index with whole texts in ``seq``, for what writes or shows them."""
    return with_text(*event_tables(spark, sf_dir))


def event_alignments(sequences: DataFrame) -> DataFrame:
    """PAF rows of both kinds."""
    s = sequences.select("seq_id", "name", "seq_len", F.substring("name", 2, 20).cast("long").alias("user_id"))
    t = s.select((F.col("seq_id") - 1).alias("seq_id"), F.col("name").alias("target_name"), F.col("seq_len").alias("target_len"))
    zero = F.lit(0).cast("long")
    n = F.least("seq_len", "target_len")
    one = s.join(t, "seq_id").select(F.col("name").alias("query_name"), F.col("seq_len").alias("query_len"), zero.alias("query_start"), n.alias("query_end"), F.when(F.col("user_id") % 3 == 0, "-").otherwise("+").alias("strand"), "target_name", "target_len", zero.alias("target_start"), n.alias("target_end"))
    two = s.where("seq_len > 2").select(F.col("name"), "seq_len", zero, F.col("seq_len") - 2, F.lit("+"), "name", "seq_len", F.lit(2).cast("long"), "seq_len")
    a = one.union(two)
    n = F.col("query_end") - F.col("query_start")
    cigar = F.array(F.struct(n.alias("len"), F.lit("M").alias("op"))).cast(CIGAR_TYPE)
    return a.select("*", n.alias("num_matches"), n.alias("block_len"), F.lit(60).alias("mapq"), cigar.alias("cigar"), zero.alias("min_match_len"))


def event_graph(spark: SparkSession, sf_dir: str, **options) -> Graph:
    index, held = event_tables(spark, sf_dir)
    return induce(index, event_alignments(index), held, check=False, **options)
