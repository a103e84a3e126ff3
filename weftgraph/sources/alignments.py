"""PAF and SxS scans and writers."""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.functions.cigar import format_cigar, parse_cigar
from weftgraph.functions.text import alignment_list, tokens
from weftgraph.operators.matches import valid_row
from weftgraph.operators.rank import numbered, running_sum
from weftgraph.sources.lines import first_bytes, read_lines

#: The twelve columns of PAF and their types.
PAF_FIELDS = (
    ("query_name", "string"), ("query_len", "long"), ("query_start", "long"), ("query_end", "long"), ("strand", "string"), ("target_name", "string"),
    ("target_len", "long"), ("target_start", "long"), ("target_end", "long"), ("num_matches", "long"), ("block_len", "long"), ("mapq", "int"),
)


class BadAlignment(ValueError):
    """A PAF row is blank or invalid."""


def parse_paf(lines: DataFrame) -> DataFrame:
    """PAF columns from ``value``; other columns stay.  The first ``cg:Z:`` tag is the CIGAR (none: empty)."""
    f = tokens(F.col("value"))
    cols = [(F.when(F.get(f, F.lit(i)) == "+", "+").otherwise("-") if name == "strand" else F.get(f, F.lit(i)) if kind == "string" else F.get(f, F.lit(i)).try_cast(kind)).alias(name) for i, (name, kind) in enumerate(PAF_FIELDS)]
    tag = F.get(F.filter(F.slice(f, 13, F.greatest(F.size(f), F.lit(1))), lambda x: x.startswith("cg:Z:")), F.lit(0))
    cigar = parse_cigar(F.coalesce(F.substring(tag, F.lit(6), F.length(tag)), F.lit("")))
    return lines.select(*cols, cigar.alias("cigar"), *[c for c in lines.columns if c != "value"])


def read_paf(spark: SparkSession, path: str, min_match_len: int = 0, on_bad_row: str = "stop") -> DataFrame:
    """Valid rows of one file.  At a blank or invalid row: ``stop`` ends the file there, ``skip`` goes on, ``raise`` raises."""
    rows = read_lines(spark, path)
    # the first line that isn't empty, as far as the first bytes hold it
    first = next((x for x in first_bytes(spark, path, 1 << 20).splitlines() if x), b"")
    if first and b"cg:Z:" not in first:
        warnings.warn(f"{path} has no cg:Z: tag: without base-level alignments no matches are made", stacklevel=2)
    parsed = parse_paf(rows).withColumn("min_match_len", F.lit(min_match_len).cast("long"))
    if on_bad_row != "skip":
        end = parsed.where(~valid_row()).agg(F.min(F.struct("file", "block", "place")).alias("x")).first().x
        if end is not None:
            if on_bad_row == "raise":
                raise BadAlignment(f"{path} has a blank or invalid row")
            parsed = parsed.where(F.struct("file", "block", "place") < F.struct(F.lit(end.file).alias("file"), F.lit(end.block).cast("long").alias("block"), F.lit(end.place).cast("long").alias("place")))
    return parsed.where(valid_row()).drop("file", "block", "place")


def read_paf_list(spark: SparkSession, spec: str | list[tuple[str, int]], on_bad_row: str = "stop") -> DataFrame:
    """All files of 'file[:shortest],...'."""
    entries = alignment_list(spec) if isinstance(spec, str) else spec
    if not entries:
        raise FileNotFoundError("no alignment files")
    out = None
    for path, k in entries:
        one = read_paf(spark, path, k, on_bad_row)
        out = one if out is None else out.unionByName(one)
    return out


def paf_line() -> Column:
    cols = [F.col(n).cast("string") for n, _ in PAF_FIELDS]
    return F.concat_ws("\t", *cols, F.concat(F.lit("cg:Z:"), format_cigar(F.col("cigar"))))


def paf_lines(paf: DataFrame) -> DataFrame:
    return paf.select(paf_line().alias("line"))


def read_sxs(spark: SparkSession, path: str) -> DataFrame:
    """One row per record; a record starts at a line tagged A.  Lines before the first one are ignored."""
    lines = numbered(read_lines(spark, path), "file", "block", "place", name="at").select("value", "at")
    lines = running_sum(lines.withColumn("new", F.when(F.col("value").startswith("A"), 1).otherwise(0)), "at", "new", "rec").where("rec > 0")
    f = tokens(F.col("value"))
    tagged = lines.select("rec", F.substring("value", 1, 1).alias("tag"), f.alias("f"))
    field = lambda tag, i, kind: F.max(F.when(F.col("tag") == tag, F.get("f", F.lit(i)))).try_cast(kind)
    out = tagged.groupBy("rec").agg(
        field("A", 1, "string").alias("target_name"), field("A", 2, "string").alias("query_name"), field("I", 1, "long").alias("target_start"), field("I", 2, "long").alias("target_end"),
        field("I", 3, "long").alias("query_start"), field("I", 4, "long").alias("query_end"), field("M", 1, "long").alias("num_matches"), field("C", 1, "string").alias("_c"), field("Q", 1, "int").alias("mapq"),
    )
    return out.withColumn("cigar", parse_cigar(F.coalesce("_c", F.lit("")))).drop("_c")


def sxs_lines(records: DataFrame) -> DataFrame:
    """(rec, line): a record's lines in one row."""
    t = lambda *xs: F.concat_ws("\t", *[F.lit(x) if isinstance(x, str) and len(x) == 1 else F.col(x).cast("string") for x in xs])
    text = F.concat_ws("\n", t("A", "target_name", "query_name"), t("I", "target_start", "target_end", "query_start", "query_end"), t("M", "num_matches"), F.concat(F.lit("C\t"), format_cigar(F.col("cigar"))), t("Q", "mapq"))
    return records.select("rec", text.alias("line"))


