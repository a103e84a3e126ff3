"""The sequence table: numbers, offsets in the concatenation, and single bases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.rank import numbered, running_sum
from weftgraph.plans.work import table


class DuplicateNames(ValueError):
    """Two sequences have one name."""


def repeated_names(records: DataFrame) -> DataFrame:
    """(name, n): names that more than one record has."""
    return records.groupBy("name").agg(F.count("*").alias("n")).where("n > 1")


def build_index(records: DataFrame, check_names: bool = True) -> DataFrame:
    """``records`` (rec_no, name, seq_len, any others; all lengths over 0) with seq_id from 1 and seq_offset; a repeated name raises."""
    r = table(records, "lengths")
    if check_names:
        twice = [x.name for x in repeated_names(r).limit(5).collect()]
        if twice:
            raise DuplicateNames(f"repeated sequence names, such as {', '.join(map(str, twice))}")
    slim = numbered(r, "rec_no", name="seq_id", start=1)
    slim = running_sum(slim, "seq_id", "seq_len", "_to").withColumn("seq_offset", (F.col("_to") - F.col("seq_len")).cast("long"))
    return slim.withColumn("seq_id", F.col("seq_id").cast("long")).drop("_to")


def build_sequences(records: DataFrame, check_names: bool = True) -> DataFrame:
    """(seq_id from 1, name, seq_offset, seq_len, seq) of records (rec_no, name, seq).

    Text is upper-cased; empty sequences are left out; a repeated name raises.
    Numbers and offsets are computed on (rec_no, length) rows, the text meets
    them afterwards.
    """
    r = table(records.select("rec_no", "name", F.upper("seq").alias("seq")).where(F.length("seq") > 0), "records")
    slim = build_index(r.select("rec_no", "name", F.length("seq").cast("long").alias("seq_len")), check_names).drop("name")
    return r.join(slim, "rec_no").select(F.col("seq_id").cast("long").alias("seq_id"), "name", F.col("seq_offset").cast("long").alias("seq_offset"), "seq_len", "seq")


#: Bases a block of the concatenation holds: small, so that a slice never scans far and a row stays small.
BLOCK = 1 << 13


def blocks(sequences: DataFrame, width: int = BLOCK) -> DataFrame:
    """(block, text): the concatenation in blocks of ``width`` bases, from sequences with ``seq``; the one place that reads whole texts."""
    head = width - F.col("seq_offset") % width
    cut = F.regexp_extract_all(F.substring(F.col("seq"), head + 1, F.col("seq_len")), F.lit(f"(?s).{{1,{width}}}"), F.lit(0))
    parts = sequences.select("seq_offset", head.alias("_h"), F.posexplode(F.concat(F.array(F.substring(F.col("seq"), F.lit(1), head)), cut)).alias("_i", "text"))
    at = F.col("seq_offset") + F.when(F.col("_i") > 0, F.col("_h") + (F.col("_i") - 1) * width).otherwise(F.lit(0).cast("long"))
    return _joined(parts.select(at.alias("q"), "text"), width)


def _joined(parts: DataFrame, width: int) -> DataFrame:
    """Blocks of texts that begin at ``q`` and cross no border; a block has ``width`` of them at most."""
    one = F.array_sort(F.collect_list(F.struct("q", "text")))
    return parts.groupBy(F.floor(F.col("q") / width).alias("block")).agg(F.array_join(F.transform(one, lambda x: x["text"]), "").alias("text"))


def blocks_of_bases(numbered_bases: DataFrame, width: int = BLOCK) -> DataFrame:
    """(block, text) of single bases (q, base)."""
    return _joined(numbered_bases.select("q", F.col("base").alias("text")), width)


def pieces(index: DataFrame, block_table: DataFrame, width: int = BLOCK) -> DataFrame:
    """(seq_id, q, text): the parts of every sequence, none across a border."""
    ends = F.sequence(F.floor(F.col("seq_offset") / width), F.floor((F.col("seq_offset") + F.col("seq_len") - 1) / width))
    own = index.where("seq_len > 0").select("seq_id", "seq_offset", (F.col("seq_offset") + F.col("seq_len")).alias("_end"), F.explode(ends).alias("block"))
    low, high = F.greatest(F.col("seq_offset"), F.col("block") * width), F.least(F.col("_end"), (F.col("block") + 1) * width)
    text = F.substring(F.col("text"), (low % width + 1).cast("int"), (high - low).cast("int"))
    return own.join(block_table, "block").select("seq_id", low.alias("q"), text.alias("text"))


def with_text(index: DataFrame, block_table: DataFrame, width: int = BLOCK) -> DataFrame:
    """``index`` with each sequence's whole text in ``seq``, for writers that need it in one row."""
    one = F.array_sort(F.collect_list(F.struct("q", "text")))
    text = pieces(index, block_table, width).groupBy("seq_id").agg(F.array_join(F.transform(one, lambda x: x["text"]), "").alias("seq"))
    return index.join(text, "seq_id")


def bases(index: DataFrame, block_table: DataFrame, width: int = BLOCK) -> DataFrame:
    """(q, seq_id, base): one row per base; q is the place in the concatenation."""
    chars = pieces(index, block_table, width).select("seq_id", "q", F.posexplode(F.split("text", "")).alias("i", "base"))
    return chars.where("base != ''").select((F.col("q") + F.col("i")).alias("q"), "seq_id", "base")
