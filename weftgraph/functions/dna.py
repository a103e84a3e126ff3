"""Complement and reverse complement of upper-cased sequence text."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters with a complement of their own, and these complements; any other letter becomes N.
BASES = "ABCDGHKMQRSTUVWY"
COMPLEMENTS = "TVGHCDMKQYWAABSR"
_OTHER = f"[^{BASES}#$\\-]"


def complement(seq: Column) -> Column:
    known = F.regexp_replace(seq, _OTHER, "N")
    return F.translate(known, BASES + "#$", COMPLEMENTS + "$#")


def reverse_complement(seq: Column) -> Column:
    return F.reverse(complement(seq))


def base_at(seq: Column, pos: Column, is_rev: Column) -> Column:
    """The base at a 0-based place, complemented if the strand is reverse."""
    base = F.substring(seq, pos + 1, F.lit(1))
    return F.when(is_rev, complement(base)).otherwise(base)


def subseq(seq: Column, pos: Column, n: Column) -> Column:
    return F.substring(seq, pos + 1, n)


def _letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All letters of a column of texts as numbers, and where each text begins and the last ends."""
    texts = column.to_pylist()
    ends = np.cumsum([0, *map(len, texts)])
    whole = "".join(texts)
    return np.frombuffer(whole.encode("latin-1"), np.uint8) if whole.isascii() else np.frombuffer(whole.encode("utf-32-le"), np.uint32), ends


def equal_runs(query: Column, target: Column, own: Column) -> Column:
    """Array of half-open ranges (s, e) where two texts of one length are equal and not N, without the place ``own`` (null: none)."""

    @F.arrow_udf("array<struct<s:bigint,e:bigint>>")
    def run(q: pa.Array, t: pa.Array, o: pa.Array) -> pa.Array:
        (x, at), (y, _) = _letters(q), _letters(t)
        same = np.zeros(len(x) + len(at), bool)  # one place more behind each text keeps runs apart
        row = np.repeat(np.arange(len(at) - 1), np.diff(at))
        same[np.arange(len(x)) + row] = (x == y) & (x != ord("N"))
        own = o.to_numpy(zero_copy_only=False).astype(float)
        some = np.flatnonzero(~np.isnan(own))
        same[at[some] + some + own[some].astype(np.int64)] = False
        d = np.diff(np.concatenate(([0], same.astype(np.int8))))
        s, e = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        of = np.searchsorted(at + np.arange(len(at)), s, side="right") - 1
        base = at[of] + of
        ranges = pa.StructArray.from_arrays([pa.array(s - base), pa.array(e - base)], names=["s", "e"])
        counts = np.concatenate(([0], np.cumsum(np.bincount(of, minlength=len(at) - 1))))
        return pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), ranges)

    return run(query, target, own)
