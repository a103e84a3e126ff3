"""Oriented positions: offset and strand in one long, the strand in the lowest bit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def make_pos(offset: Column, is_rev: Column) -> Column:
    return F.shiftleft(offset.cast("long"), 1).bitwiseOR(is_rev.cast("long"))


def pos_offset(pos: Column) -> Column:
    return F.shiftrightunsigned(pos, 1)


def pos_is_rev(pos: Column) -> Column:
    return pos.bitwiseAND(F.lit(1).cast("long")) == 1


def _step(pos: Column, n: Column | int, sign: int) -> Column:
    n = (F.lit(n) if isinstance(n, int) else n).cast("long") * 2 * sign
    return pos + F.when(pos_is_rev(pos), -n).otherwise(n)


def incr_pos(pos: Column, n: Column | int = 1) -> Column:
    """n bases on in the position's own direction: up if forward, down if reverse."""
    return _step(pos, n, 1)


def decr_pos(pos: Column, n: Column | int = 1) -> Column:
    return _step(pos, n, -1)


def flip_pos(pos: Column) -> Column:
    """Same offset, other strand."""
    return pos.bitwiseXOR(F.lit(1).cast("long"))


def strand(is_rev: Column) -> Column:
    return F.when(is_rev, "-").otherwise("+")


def pos_text(pos: Column) -> Column:
    return F.concat(pos_offset(pos).cast("string"), strand(pos_is_rev(pos)))


def pos_in_all(seq_offset: Column, seq_len: Column, pos: Column, is_rev: Column) -> Column:
    """Place in the concatenation of a place in one sequence, counted from its end if reverse."""
    return seq_offset + F.when(is_rev, seq_len - 1 - pos).otherwise(pos)
