"""Operator 2: substring dedup by seed and extend.

Every word covered by a window of ``WINDOW`` words whose words also start
anywhere else goes.  Seeds are winnowed anchors (``_repeats``); the distinct
surroundings of a seed are extended word by word to the right and to the left,
and two of them stay in one class as long as their words agree.  A window that
reaches o words left of the seed repeats where the pair (left class after o
words, right class after the rest) occurs twice; all such windows together are
the maximal repeats of at least ``WINDOW`` words.

Nulls and empty texts: no words, kept text empty.  Repeated rows remove each
other's words if long enough.  Texts of any length are handled whole.  Order and
ties play no part; other columns are not used, whatever their names.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm import _text as tx
from weftgraph.llm._repeats import cover, repeated_windows, with_ranges
from weftgraph.llm._work import documents

WINDOW = 35
SEED = 8


def extend(group: np.ndarray, off: np.ndarray, n: np.ndarray, x: list[bytes], L: int) -> list[np.ndarray]:
    """For each superwindow, which of its windows another one of its group has too."""
    ids: dict[bytes, int] = {}
    rows = [[ids.setdefault(w, len(ids)) for w in t.split(b" ")] for t in x]
    m, length = len(rows), n + L - 1
    flat = np.concatenate([np.array(r, np.int64) for r in rows])
    head = np.cumsum(length) - length + off  # place of the seed
    words = len(ids) + 1

    def classes(step: int, upto: np.ndarray, most: int) -> list[np.ndarray]:
        """Class of each row after 0..most words in one direction; -1 where it ends before."""
        out = [group.astype(np.int64)]
        for k in range(1, most + 1):
            ok = np.flatnonzero((upto >= k) & (out[-1] >= 0))
            c = np.full(m, -1, np.int64)
            if len(ok):
                sym = flat[head[ok] + (k - 1 if step > 0 else -k)]
                c[ok] = np.unique(out[-1][ok] * words + sym, return_inverse=True)[1]
            out.append(c)
        return out

    right = classes(1, length - off, L)
    left = classes(-1, off, int(off.max(initial=0)))
    bits = [np.zeros(k, bool) for k in n]
    for o in range(len(left)):
        has = np.flatnonzero((off >= o) & (off - o < n) & (right[L - o] >= 0) & (left[o] >= 0)) if L - o >= 0 else []
        if len(has):
            pair = left[o][has] * (int(right[L - o].max()) + 1) + right[L - o][has]
            for i in has[tx.duplicated(pair)]:
                bits[i][off[i] - o] = True
    return bits


def removed_words(docs: DataFrame, window: int = WINDOW, seed: int = SEED, **options) -> DataFrame:
    """(id, text, r) with the starts of repeated windows as ranges of word numbers."""
    return with_ranges(*repeated_windows(docs, "word", window, seed, extend, **options))


def digest(docs: DataFrame, window: int = WINDOW, seed: int = SEED, **options) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [[], [], []]
            for text, r in zip(b.column(1), b.column(2), strict=True):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                gone = cover(r.as_py(), window, len(words)) if r.is_valid else None
                kept = words if gone is None else [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                for o, v in zip(out, (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256"])

    return removed_words(docs, window, seed, **options).mapInArrow(run, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir).select("doc_id", "text"))
