"""Operator 12: packing token ids into sequences by an order-preserving dynamic program.

Documents are put end to end in ascending id order (null first; ties by a hash of the text), each with its end id.
Windows of at most ``WIDTH`` ids are cut from that stream; order is kept, so each
is a sequence as it stands.  Cuts may fall at document ends (free), after
sentences (``SENTENCE``) and, where none of these is near, at every ``STEP``-th id
(``INSIDE``).  The program minimises these penalties, the padding of all sequences
(a length of a power of two needs none; others are padded to ``WIDTH``) and
``SEQUENCE`` for each sequence, so that none is split for nothing.

With x the place of a cut and D its least cost, D(j) is the penalty of j plus
the least D(i) + x(i) of the cuts i in reach, plus WIDTH - x(j): a minimum over a
sliding window, which a monotone queue gives in constant time a cut.  The few
pairs of cuts a power of two apart are looked up besides.

Plan: one range partition and sort of the texts.  Each partition is a
stream: the program runs over ``CHUNK`` ids at a time, and the last, unfinished
window of a chunk opens the next, so a partition of any size takes the memory of
a chunk and pads one sequence at its end.  A sequence's number is its
partition's and its place there: by (sequence_id, offset) and by (doc_id, start)
pieces come in one order.

Nulls: a null text is empty (one piece, the end id); a null id is kept.  Empty
texts likewise.  A text of any length is encoded whole and becomes as many
pieces as it needs.  Repeated rows are packed each.  Empty table: no rows.
Other columns are not used, whatever their names.
"""

from __future__ import annotations

import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._work import documents
from weftgraph.llm.tokens import CACHE_PIECES, END_ID, Encoder, encoder, public_tokenizer

WIDTH, CHUNK = 1024, 1 << 19
#: Costs, in ids of padding.
SENTENCE, INSIDE, SEQUENCE = 2, 16, 8
#: Ids without a cut beyond which cuts inside sentences are allowed, and their distance.
REACH, STEP = 64, 16
#: Sequences of these lengths need no padding.
POWERS = (64, 128, 256, 512)
TYPE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


class Sentences:
    """Which ids end a sentence: a line end in it, or a full stop before an id that begins with white space."""

    def __init__(self, enc: Encoder) -> None:
        self.line, self.stop, self.space = (np.zeros(len(enc.starts), bool) for _ in range(3))
        for piece, i in enc.tok.get_vocab(with_added_tokens=True).items():
            self.line[i] = "Ċ" in piece or "\n" in piece
            self.stop[i] = piece.rstrip("\"')]")[-1:] in {".", "!", "?"}
            self.space[i] = piece[:1] in {"Ġ", "Ċ", "▁", " ", "\n"}

    def ends(self, ids: np.ndarray) -> np.ndarray:
        """Places behind the ids that end a sentence."""
        out = self.line[ids]
        out[:-1] |= self.stop[ids[:-1]] & self.space[ids[1:]]
        return np.flatnonzero(out) + 1


@lru_cache(maxsize=2)
def sentence_rule(path: str, cache: int) -> Sentences:
    """One for each Python worker, as its encoder."""
    return Sentences(encoder(path, cache))


def candidates(doc_ends: np.ndarray, sentence_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places where a window may end, with their penalties; the first is 0, the last the end of all."""
    total = int(doc_ends[-1])
    cost = np.full(total + 1, -1, np.int64)
    cost[sentence_ends] = SENTENCE
    cost[doc_ends] = 0
    cost[0] = 0
    at = np.flatnonzero(cost >= 0)
    for k in np.flatnonzero(np.diff(at) > REACH).tolist():
        cost[at[k] + STEP : at[k + 1] - STEP + 1 : STEP] = INSIDE
    at = np.flatnonzero(cost >= 0)
    return at, cost[at]


def best_cuts(at: np.ndarray, cost: np.ndarray, width: int = WIDTH, powers: tuple[int, ...] = POWERS) -> np.ndarray:
    """The places of the cheapest cuts, from the first to the last of ``at`` (no two neighbours over ``width`` apart)."""
    m = len(at)
    index = np.full(int(at[-1]) + 1, -1, np.int64)
    index[at] = np.arange(m)
    far, near = [], []
    for p in powers:
        j = np.flatnonzero(at >= p)
        i = index[at[j] - p]
        far.append(j[i >= 0])
        near.append(i[i >= 0])
    j, i = np.concatenate(far), np.concatenate(near)
    o = np.argsort(j, kind="stable")
    exact_j, exact_i = [*j[o].tolist(), m], i[o].tolist()
    x, pen = at.tolist(), cost.tolist()
    least, shifted, back = [0] * m, [0] * m, [0] * m
    queue, head, tail, t = [0] * m, 0, 1, 0
    for j in range(1, m):
        here = x[j]
        while x[queue[head]] < here - width:
            head += 1
        i = queue[head]
        d = shifted[i] + width - here
        while exact_j[t] == j:
            k = exact_i[t]
            if least[k] < d:
                d, i = least[k], k
            t += 1
        d += pen[j] + SEQUENCE
        least[j], back[j] = d, i
        d += here
        shifted[j] = d
        while tail > head and shifted[queue[tail - 1]] >= d:
            tail -= 1
        queue[tail] = j
        tail += 1
    out = [m - 1]
    while out[-1]:
        out.append(back[out[-1]])
    return at[np.array(out[::-1])]


def pack(docs: DataFrame, tokenizer: str | None = None, end_id: int = END_ID, width: int = WIDTH, chunk: int = CHUNK, cache: int = CACHE_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece of a document (doc_id, text); ``with_ids`` adds the ids as little-endian unsigned 32-bit numbers."""
    path = tokenizer or public_tokenizer()

    def run(batches):
        from pyspark import TaskContext

        enc = encoder(path, cache)
        sentences = sentence_rule(path, cache)
        end = np.array([end_id], enc.kind).tobytes()
        open_: list[tuple] = []  # (doc_id, its tokens, tokens before these, ids)
        size, number = 0, TaskContext.get().partitionId() << 33

        def close(final: bool) -> pa.RecordBatch:
            nonlocal open_, size, number
            names, totals, before, blobs = zip(*open_, strict=True)
            ids = np.frombuffer(b"".join(blobs), enc.kind)
            ends = np.cumsum([len(b) // enc.width for b in blobs])
            starts = np.append(0, ends[:-1])
            cuts = best_cuts(*candidates(ends, sentences.ends(ids)), width, tuple(p for p in POWERS if p < width))
            if not final and len(cuts) > 2:
                cuts = cuts[:-1]
            done = int(cuts[-1])
            lo = np.union1d(starts, cuts[:-1])
            lo = lo[lo < done]
            hi = np.append(lo[1:], done)
            doc = np.searchsorted(starts, lo, side="right") - 1
            window = np.searchsorted(cuts, lo, side="right") - 1
            wide = ids.astype("<u4")
            spans = list(zip(lo.tolist(), hi.tolist(), strict=True))
            own = doc.tolist()
            cols = [
                pa.array([names[d] for d in own], pa.int64()),
                pa.array(lo - starts[doc] + np.array(before, np.int64)[doc]),
                pa.array(hi - lo),
                pa.array([zlib.crc32(wide[a:b]) for a, b in spans], pa.int64()),
                pa.array(np.array(totals, np.int64)[doc]),
                pa.array(number + window),
                pa.array(lo - cuts[window]),
            ]
            if with_ids:
                cols.append(pa.array([wide[a:b].tobytes() for a, b in spans], pa.binary()))
            number += len(cuts) - 1
            rest = []
            for d in range(int(np.searchsorted(ends, done, side="right")), len(blobs)):
                gone = max(0, done - int(starts[d]))
                rest.append((names[d], totals[d], before[d] + gone, blobs[d][gone * enc.width :]))
            open_, size = rest, len(ids) - done
            return pa.RecordBatch.from_arrays(cols, names=[*(c.split()[0] for c in TYPE.split(", ")), *(["ids"] if with_ids else [])])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blob = enc.encode(text.as_py() or "") + end
                n = len(blob) // enc.width
                open_.append((doc, n, 0, blob))
                size += n
                if size >= chunk:
                    yield close(False)
        if open_:
            yield close(True)

    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(*order).sortWithinPartitions(*order)
    return rows.mapInArrow(run, TYPE + (", ids binary" if with_ids else ""))


def sequences(pieces: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pieces with ids; no group is larger than a sequence."""
    one = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.reduce(one, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("length"), joined.alias("ids"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir).select("doc_id", "text"))
