"""Shared work space and bounded broadcasts, as the llm operators use them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.rank import numbered
from weftgraph.plans.work import bounded, documents, drop, settle, split_join, table, work_dir

__all__ = ["bounded", "documents", "drop", "numbered", "packed", "settle", "split_join", "table", "work_dir"]


def packed(docs: DataFrame, **keys: Column) -> DataFrame:
    """``docs`` as one struct ``_row`` (its columns may have any names) with the given key columns; ``select("_row.*")`` unpacks."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    return docs.select(row).select("_row", *[k.alias(name) for name, k in keys.items()])
