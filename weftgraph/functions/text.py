"""Small text helpers: numbers with magnitudes, splitting, alignment lists."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = re.compile(r"[0-9]+(\.[0-9]*)?|\.[0-9]+")
_MAGNITUDE = {"k": 3, "m": 6, "g": 9}


def handy_number(value: str, default: float) -> float:
    """'10k', '1M' or '2.5g' as a number; the default if it is none."""
    power = _MAGNITUDE.get(value[-1:].lower(), 0)
    digits = value[:-1] if power else value
    return float(digits) * 10**power if _NUMBER.fullmatch(digits) else default


def handy_number_column(value: Column, default: float) -> Column:
    power = F.when(F.lower(F.right(value, F.lit(1))) == "k", 1e3).when(F.lower(F.right(value, F.lit(1))) == "m", 1e6).when(F.lower(F.right(value, F.lit(1))) == "g", 1e9)
    digits = F.when(power.isNull(), value).otherwise(F.substring(value, F.lit(1), F.length(value) - 1))
    ok = digits.rlike(r"^([0-9]+(\.[0-9]*)?|\.[0-9]+)$")
    return F.when(ok, F.expr("try_cast(0 as double)") + digits.try_cast("double") * F.coalesce(power, F.lit(1.0))).otherwise(F.lit(default))


def tokens(value: Column, delimiters: str = " \t", trim_empty: bool = False) -> Column:
    """Split at any of the delimiters; empty fields stay unless trimmed."""
    out = F.split(value, "[" + re.escape(delimiters) + "]")
    return F.filter(out, lambda x: x != "") if trim_empty else out


def alignment_list(spec: str) -> list[tuple[str, int]]:
    """'file[:shortest],...' as (file, shortest match or 0); entries with more colons are left out."""
    out = []
    for entry in spec.split(","):
        fields = entry.split(":")
        if len(fields) <= 2:
            out.append((fields[0], int(fields[1]) if len(fields) == 2 else 0))
    return out
