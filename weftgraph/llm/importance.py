"""Operator 11: importance resampling towards a target distribution, by hashed n-grams.

Features are all runs of 1 to 3 consecutive words of a text, lower-cased (A-Z),
each in the bucket of its CRC.  A bucket's gain is the logarithm of how much
more often the target has it than the corpus; a document's weight is the sum
of its features' gains; Gumbel noise from its id turns the highest weights into
a sample without replacement (``share`` of the documents with enough words).

CRCs are linear over GF(2): ``crc(A + B)`` is ``crc(A)`` shifted by the length of
B, a 32 x 32 bit matrix applied to it, xor ``crc(B)``.  So each distinct word of
a batch is put through the CRC once, and those of the runs are composed from
them: the shift matrices of short lengths are kept as four tables of 256
entries, those of long ones are products of matrices for powers of two.  No
run's text is ever made.

Plan: the corpus is read twice.  The first pass sums each task's features into
one count per bucket, of which ``buckets`` rows at most reach the driver; the
second makes a few numbers per document, and only those are sorted.

Nulls: a null text has no words (no features, weight 0, never drawn); a null id
takes part as ``null`` and comes after others in a tie.  Empty texts likewise.
Texts of any length are taken whole, a stretch of words at a time.  Ties in
score go to the smaller id; repeated rows are ranked each, in an order fixed by
their other numbers.  Empty corpus: no rows; empty target: its counts are 0.
Extra columns, whatever their names: unused by ``scored``, kept by ``resample``.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import documents, drop, numbered, packed, table

BUCKETS, ORDER, SHARE, MIN_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Words of one text that are worked on at a time.
STRETCH = 1 << 17
#: The polynomial of CRC-32, reflected (fixed value).
POLYNOMIAL = 0xEDB88320
SHORT = 48
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BYTES = np.arange(256)
_GAP = ~((_BYTES >= 48) & (_BYTES <= 57) | (_BYTES >= 97) & (_BYTES <= 122) | (_BYTES >= 128))
_ONE = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _ONE = np.where(_ONE & 1, _ONE >> np.uint32(1) ^ np.uint32(POLYNOMIAL), _ONE >> np.uint32(1))


def _times(matrix: np.ndarray, v: np.ndarray) -> np.ndarray:
    """A shift matrix, as tables by byte of the vector (4, 256), applied to 32-bit vectors."""
    return matrix[0][v & 255] ^ matrix[1][v >> 8 & 255] ^ matrix[2][v >> 16 & 255] ^ matrix[3][v >> 24]


def _short() -> np.ndarray:
    """The matrices that shift by 0 .. SHORT - 1 bytes."""
    out = [np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])]
    while len(out) < SHORT:
        out.append(out[-1] >> np.uint32(8) ^ _ONE[out[-1] & 255])
    return np.stack(out)


_SHORT = _short()
_FLAT = _SHORT.reshape(-1)


def crc_shift(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs moved left by ``length`` zero bytes."""
    base = np.minimum(length, SHORT - 1).astype(np.int64) * 1024
    out = _FLAT[base + (crc & 255)] ^ _FLAT[base + 256 + (crc >> 8 & 255)] ^ _FLAT[base + 512 + (crc >> 16 & 255)] ^ _FLAT[base + 768 + (crc >> 24)]
    far = np.flatnonzero(length >= SHORT)
    if len(far):
        matrix, v, left = _SHORT[1], crc[far], length[far].astype(np.int64)
        while left.any():  # one matrix for each bit of the length, squared from the one before
            on = np.flatnonzero(left & 1)
            v[on] = _times(matrix, v[on])
            matrix, left = _times(matrix, matrix), left >> 1
        out[far] = v
    return out


def crc_join(a: np.ndarray, b: np.ndarray, b_length: np.ndarray) -> np.ndarray:
    """CRC of each A + B from those of A and of B."""
    return crc_shift(a, b_length) ^ b


def _word_crcs(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """CRC of every word: each distinct one is computed once."""
    number, distinct = tx.numbers(buf, s, e)
    of = np.zeros(len(distinct), np.uint32)
    used = np.unique(number)
    of[used] = [zlib.crc32(x) for x in distinct.take(pa.array(used)).to_pylist()]
    return of[number]


def features(buf: np.ndarray, offs: np.ndarray):
    """(words of each row, iterator of (row, crc) arrays of all runs of 1 to ORDER words) of lower-cased texts."""
    buf = _LOWER[buf]
    s, e, row = tx.words(buf, offs, _GAP)

    def runs():
        for lo in range(0, len(s), STRETCH):
            hi = min(lo + STRETCH + ORDER - 1, len(s))  # the last words come again: runs that begin before them reach there
            own = min(lo + STRETCH, len(s)) - lo
            first = int(s[lo])
            r, length = row[lo:hi], (e[lo:hi] - s[lo:hi]) + 1
            word = _word_crcs(buf[first : int(e[hi - 1])], s[lo:hi] - first, e[lo:hi] - first)
            space = np.full(len(word), zlib.crc32(b" "), np.uint32)
            led = crc_join(space, word, length - 1)  # a space and the word
            run = word
            yield r[:own], run[:own]
            for k in range(1, ORDER):
                if len(run) < 2:
                    break
                run = crc_join(run[:-1], led[k:], length[k:])  # one more word, for all runs at once
                whole = np.flatnonzero(r[: len(run)] == r[k:])
                whole = whole[whole < own]
                yield r[whole], run[whole]

    return np.bincount(row, minlength=len(offs) - 1), runs()


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): features of all texts; every task hands on one row per bucket at most."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for _, _, buf, offs in tx.parts(b.column(0)):
                for _, crc in features(buf, offs)[1]:
                    total += np.bincount(crc % np.uint32(buckets), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    return docs.select("text").mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Thousandths of the log ratio of target to corpus, by bucket, each count with one added."""
    counts = []
    for t in (target, docs):
        c = np.zeros(buckets, np.int64)
        for r in bucket_counts(t, buckets).collect():  # ``buckets`` rows at most
            c[r.bucket] = r.n
        counts.append(c.tolist())
    t_all, s_all = (sum(c) + buckets for c in counts)
    return np.array([math.floor(1000 * math.log((t + 1) * s_all / ((s + 1) * t_all))) for t, s in zip(*counts, strict=True)], np.int64)


def weights(text: Column, gain: np.ndarray) -> Column:
    """Struct (n_words, n_features, weight) of whole texts (Arrow UDF, numpy inside)."""
    buckets = len(gain)

    def some(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
        words, runs = features(buf, offs)
        out = np.zeros((3, len(words)), np.int64)
        out[0] = words
        for row, crc in runs:
            if len(row):  # rows ascend: one sum for each stretch of equal ones
                at = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
                out[1, row[at]] += np.diff(np.append(at, len(row)))
                out[2, row[at]] += np.add.reduceat(gain[crc % np.uint32(buckets)], at)
        return out

    @F.arrow_udf("struct<n_words:bigint,n_features:bigint,weight:bigint>")
    def run(column: pa.Array) -> pa.Array:
        got = [some(buf, offs) for _, _, buf, offs in tx.parts(column)]
        cols = np.concatenate(got, axis=1) if got else np.zeros((3, 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=["n_words", "n_features", "weight"])

    return run(text)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Thousandths of a Gumbel variable that is fixed by the id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000.0 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def _order() -> list[Column]:
    return [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("n_features"), F.asc("weight"), F.asc("n_words")]


def scored(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_features, weight, score, rank): ``share`` percent of the documents of ``min_words`` words are ranked."""
    gain = gains(docs, target, buckets)
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), weights(F.col("text"), gain).alias("_w"))
    d = table(d.select("doc_id", "_w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.col("n_words") >= min_words
    draws = d.where(able).count() * share // 100
    ranked = numbered(d.where(able), *_order(), name="rank", start=1)
    rank = F.when(F.col("rank") <= draws, F.col("rank")).cast("long").alias("rank")
    return ranked.select(*d.columns, rank).unionByName(d.where(~able).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, share: int = SHARE, min_words: int = MIN_WORDS, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """The drawn rows of ``docs`` with all their columns; rows equal to the last one drawn in all its numbers come with it."""
    gain = gains(docs, target, buckets)
    keys = ["score", "doc_id", "n_features", "weight", "n_words"]
    d = packed(docs, doc_id=F.col("_row.doc_id").cast("long"), _w=weights(F.col("_row.text"), gain))
    d = d.select("_row", "doc_id", "_w.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)).where(F.col("n_words") >= min_words)
    slim = table(d.select(*keys), "weights")
    draws = slim.count() * share // 100
    last = numbered(slim, *_order(), name="rank", start=1).where(F.col("rank") == draws).select(*keys).first()
    drop(slim)
    if last is None:
        return docs.limit(0)
    # (score down, others up) up to the last row drawn, as one comparison of structs
    far = (1 << 63) - 1
    flat = [-F.col("score"), F.coalesce("doc_id", F.lit(far)), *[F.col(k) for k in keys[2:]]]
    end = [F.lit(x).cast("long") for x in (-last.score, far if last.doc_id is None else last.doc_id, *[last[k] for k in keys[2:]])]
    flat, end = (F.struct(*[c.alias(k) for c, k in zip(x, keys, strict=True)]) for x in (flat, end))
    return d.where(flat <= end).select("_row.*")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return scored(documents(spark, sf_dir), benchmark).select("doc_id", "n_features", "weight", "score", "rank")
