"""CIGAR text to array<struct<len:bigint,op:string>> and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CIGAR_TYPE = "array<struct<len:bigint,op:string>>"


def parse_cigar(text: Column) -> Column:
    """A number and the last of the operators behind it form an entry; trailing digits are dropped."""
    pairs = F.regexp_extract_all(text, F.lit("([0-9]+[^0-9]+)"), F.lit(1))
    return F.transform(
        pairs,
        lambda x: F.struct(F.regexp_extract(x, "^([0-9]+)", 1).cast("long").alias("len"), F.substring(x, F.length(x), F.lit(1)).alias("op")),
    )


def format_cigar(cigar: Column) -> Column:
    return F.array_join(F.transform(cigar, lambda x: F.concat(x["len"].cast("string"), x["op"])), "")


def consumed(op: Column, length: Column, by: str) -> Column:
    """Bases of the query ('q') or target ('t') that an entry goes over."""
    ops = ("M", "=", "X", "I" if by == "q" else "D")
    return F.when(op.isin(*ops), length).otherwise(F.lit(0).cast("long"))
