"""Operator 9: byte-level dedup by column-wise Burrows-Wheeler construction.

Every byte covered by a string of ``LENGTH`` bytes that also starts anywhere
else goes.  The documents of a construction are the superwindows around one
anchor (``_repeats``), aligned at it; a whole corpus would need as many rounds as
its longest document has bytes.  ``columns`` goes through them from the right,
one column a round: it inserts the round's symbol of every active document, sorts
the suffixes that begin there (a stable sort of the last round's order by the
new symbol: the column's part of the collection's transform) and updates the
common prefix of neighbours: one more than the smallest between them in the last
round if their symbols agree, else 0.  A window repeats where a neighbour's common
prefix covers it.  Order, prefixes and symbols of a round are sequential arrays;
groups stream through a task from sorted shuffle files.

Nulls and empty texts: no bytes, nothing removed.  Repeated rows remove each
other's bytes if long enough.  Equal suffixes keep the order they came in, which
changes no common prefix, so ties play no part.  Texts of any length are handled whole.  Empty table: no rows.  Other
columns are not used, whatever their names.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from weftgraph.llm._repeats import cover, repeated_windows, with_ranges
from weftgraph.llm._work import documents

LENGTH = 200
ANCHOR = 40


def columns(group: np.ndarray, off: np.ndarray, n: np.ndarray, x: list[bytes], L: int) -> list[np.ndarray]:
    """For each superwindow, which of its windows another one of its group has too."""
    length = n + L - 1
    data = np.frombuffer(b"".join(x), np.uint8)
    head = np.cumsum(length) - length + off  # place of column 0
    right, left = length - off, -off  # columns left..right-1
    out = np.zeros(int(n.sum()), bool)
    base = np.cumsum(n) - n + off
    enter = np.argsort(-right, kind="stable")
    entered = np.searchsorted(-right[enter], -np.arange(int(right.max()), int(left.min()) - 1, -1), side="right")
    order = np.zeros(0, np.int64)
    lcp = np.zeros(0, np.int32)
    came = 0
    for c in range(int(right.max()) - 1, int(left.min()) - 1, -1):
        upto = entered[int(right.max()) - 1 - c]
        if upto > came:  # new documents: empty suffixes, first in their group
            order = np.concatenate((enter[came:upto], order))
            lcp = np.concatenate((np.zeros(upto - came, np.int32), lcp))
            s = np.argsort(group[order], kind="stable")
            order, lcp = order[s], lcp[s]
            came = upto
        keep = np.flatnonzero(left[order] <= c)
        if len(keep) < len(order):  # documents that began at c + 1 leave; gaps take the smaller prefix
            if not len(keep):
                order, lcp = order[:0], lcp[:0]
                continue
            lcp = np.minimum.reduceat(lcp[: keep[-1] + 1], np.concatenate(([0], keep[:-1] + 1)))
            order = order[keep]
        if not len(order):
            continue
        key = group[order] * 256 + data[head[order] + c]
        s = np.argsort(key, kind="stable")
        key = key[s]
        new = np.zeros(len(s), np.int32)
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        near = s[same] == s[same - 1] + 1
        new[same[near]] = lcp[s[same[near]]] + 1
        far = same[~near]
        if len(far):
            between = np.stack((s[far - 1] + 1, s[far] + 1), axis=1).ravel()
            new[far] = np.minimum.reduceat(np.append(lcp, 0), between)[::2] + 1
        order, lcp = order[s], new
        long = np.flatnonzero(lcp >= L)
        if len(long):
            for i in (order[long], order[long - 1]):
                i = i[c - left[i] < n[i]]
                out[base[i] + c] = True
    return np.split(out, np.cumsum(n)[:-1])


def digest(docs: DataFrame, length: int = LENGTH, anchor: int = ANCHOR, **options) -> DataFrame:
    def run(batches):
        for b in batches:
            out = [[], [], [], []]
            for text, r in zip(b.column(1), b.column(2), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                removed = spans = 0
                kept = raw
                if r.is_valid:
                    gone = cover(r.as_py(), length, len(raw))
                    removed = int(gone.sum())
                    spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                for o, v in zip(out, (len(raw), removed, spans, hashlib.sha256(kept).hexdigest()), strict=True):
                    o.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(o, pa.int64()) for o in out[:3]], pa.array(out[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    keyed, ranges = repeated_windows(docs, "byte", length, anchor, columns, **options)
    return with_ranges(keyed, ranges).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(documents(spark, sf_dir).select("doc_id", "text"))
