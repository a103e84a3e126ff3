"""64-bit hashes with unsigned wrap-around, as Arrow UDFs over numpy (SQL longs would overflow)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values of the match hash: the additive constant and the shifts of its three rounds.
MATCH_ADD = 0x9E3779B97F4A7C15
MATCH_SHIFTS = ((17, 9), (7, 23), (9, 2))


def match_hash_values(query: np.ndarray, target: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hash of packed query and target positions and a length, as unsigned numbers."""
    seed = query | target | length
    for part, (up, down) in zip((query, target, length), MATCH_SHIFTS, strict=True):
        spread = (seed << np.uint64(up)) + (seed >> np.uint64(down))
        seed = seed ^ (part + np.uint64(MATCH_ADD) + spread)
    return seed


def _unsigned(x: pa.Array) -> np.ndarray:
    return x.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)


def match_hash(query: Column, target: Column, length: Column) -> Column:
    """The hash as a signed long with the same bits."""

    @F.arrow_udf("bigint")
    def run(q: pa.Array, t: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(match_hash_values(_unsigned(q), _unsigned(t), _unsigned(n)).view(np.int64))

    return run(query.cast("long"), target.cast("long"), length.cast("long"))


def keep_sparse(query: Column, target: Column, length: Column, factor: float) -> Column:
    """Whether the hash is under ``factor`` of its range, compared in single precision."""
    limit = np.float32(2.0**64) * np.float32(factor)

    @F.arrow_udf("boolean")
    def keep(q: pa.Array, t: pa.Array, n: pa.Array) -> pa.Array:
        return pa.array(match_hash_values(_unsigned(q), _unsigned(t), _unsigned(n)).astype(np.float32) < limit)

    return keep(query.cast("long"), target.cast("long"), length.cast("long"))


def integer_hash(key: Column) -> Column:
    """Wang's 64-bit integer mix, as a signed long with the same bits."""

    @F.arrow_udf("bigint")
    def run(k: pa.Array) -> pa.Array:
        x = _unsigned(k)
        by = np.uint64
        x = ~x + (x << by(21))
        x ^= x >> by(24)
        x = x * by(265)
        x ^= x >> by(14)
        x = x * by(21)
        x ^= x >> by(28)
        return pa.array((x + (x << by(31))).view(np.int64))

    return run(key.cast("long"))
