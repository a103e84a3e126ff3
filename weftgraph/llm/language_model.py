"""Operator 4: language-model scoring by deleted interpolation.

Documents whose crc32 of the id (as text) leaves 2 modulo 7 are held out; the
others train (a null id trains).  Tokens: words lower-cased A-Z, then one end.

Base score: add-one unigrams.  Model: a bigram over all training words and the end,
and one class for words that no training document has:

    P(w | v) = l2[b] c(v, w) / c(v) + l1[b] c(w) / N + l0[b] / classes

with weights by bucket b (the power of two) of the context's count c(v); a context
never seen gives its l2 to l1.  The weights are learned
by expectation-maximisation on deleted counts: the training documents that leave 3
modulo 7 are scored by the counts of the other ones, bucket by bucket, over a
histogram of (bucket, ratio, ratio) whose size is bounded by its grid.

Scale: a chunk of texts turns into sorted count blobs, one for each hash part of its
distinct word pairs, with the documents each occurs in; one shuffle by part brings
all counts of a pair together, and the task that knows its count adds its
log-probability to the documents of every chunk.  A pair in a third of all
documents costs two bytes a document.  A part holds ``PART_TOKENS`` / 2 tokens, so parts grow in number with the
corpus, but neither tasks nor small blobs do: a chunk writes at most ``FAN`` parts of each kind.  Beyond
that these are ranges of parts, and a second shuffle gathers the blobs of many chunks (``GATHER`` bytes at a time),
merges equal pairs and writes them by part.  ``TASKS`` bounds the reduce tasks; each goes
through its parts in Spark's sorted, spilling order.  The sums that parts send back go by groups of documents.  The ``HEAD`` most frequent words at most (all
words down to one count) are a broadcast table that spares space and changes no score:
their pairs carry short numbers.  Every other word goes by its 64-bit hash: a pair
with one such word meets the word's counts in its part, a pair of two is joined with
the table of words.  Such a word has at most 1 / ``HEAD`` of all tokens.
Only the head, the counts of counts and the histogram reach the driver.

The texts are read three times (words, counts for the weights, scores) instead of keeping the
blobs; so ``docs`` must give the same rows in the same order each time, as a scan of files does.
``stable=False`` writes them first.  The second and third reading each send a digest of every chunk to its documents'
group, and a difference raises an error.  Nothing is cached: a lost executor's share is read again.

Nulls and empty texts: one token, the end.  Empty table: no rows.  Repeated rows
count and are scored each.  Ties: equal counts share a bucket, sums are taken in a fixed order.  Texts of any
length are scored whole.  Other columns pass by, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import documents, drop, table

HEAD = 1 << 18
PART_TOKENS = 1 << 20
FAN = 4096
GATHER = 4 << 20  # packed bytes, some four times as many unpacked
TASKS = 8192
BLOCK = 12  # documents of a partition share a group by blocks of 4,096 rows
GROUP_DOCS = 17  # about 131,072 documents a group
FOLDS, HELD, DELETED = 7, 2, 3
CHUNK = 4 << 20
STEP = 4.0  # histogram cells per factor of two
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def folds(docs: DataFrame) -> DataFrame:
    """id, fold, text."""
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(0)) % FOLDS
    return docs.select(F.col("doc_id").cast("long").alias("id"), fold.cast("int").alias("fold"), F.col("text"))


def _hashes(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    s, e, row = tx.words(buf, offs)
    return tx.span_hash(_LOWER[buf], s, e), row


def _unigrams(batches):
    for b in batches:
        fold = b.column(1).to_numpy(zero_copy_only=False)
        for lo, _, buf, offs in tx.parts(b.column(2), CHUNK):
            h, row = _hashes(buf, offs)
            f = fold[lo + row] if len(row) else np.zeros(0, np.int32)
            h, f = h[f != HELD], f[f != HELD]
            w, at = np.unique(h, return_inverse=True)
            c = np.bincount(at, minlength=len(w))
            d = np.bincount(at, weights=f == DELETED, minlength=len(w)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(c), pa.array(d)], names=["w", "c", "d"])


class Head:
    """The head words with their counts, and the totals; ``rest`` stands for every other word, ``classes`` counts all words."""

    def __init__(self, w: np.ndarray, c: np.ndarray, d: np.ndarray, total: int, deleted: int, distinct: int, docs: int, docs_deleted: int) -> None:
        o = np.argsort(w)
        self.w, n = w[o], len(w)
        self.rest, self.end, self.slots = n, n + 1, n + 2
        self.total, self.deleted, self.distinct = total, deleted, distinct
        self.classes = distinct - (docs > 0) + 2
        self.c = np.concatenate((c[o], [0, docs])).astype(np.int64)
        self.d = np.concatenate((d[o], [0, docs_deleted])).astype(np.int64)

    def ids(self, h: np.ndarray) -> np.ndarray:
        if not len(self.w):
            return np.full(len(h), self.rest, np.int64)
        i = np.minimum(np.searchsorted(self.w, h), len(self.w) - 1)
        return np.where(self.w[i] == h, i, self.rest)


def learn_head(keyed: DataFrame, limit: int = HEAD) -> tuple[Head, DataFrame]:
    """The head, and the other training words (w, c, d)."""
    words = table(keyed.where(F.col("fold") != HELD).mapInArrow(_unigrams, "w bigint, c bigint, d bigint").groupBy("w").agg(F.sum("c").alias("c"), F.sum("d").alias("d")), "words")
    n_docs = keyed.where(F.col("fold") != HELD).agg(F.count("*"), F.count(F.when(F.col("fold") == DELETED, 1))).first()
    of = words.groupBy("c").agg(F.count("*").alias("n"), F.sum("d").alias("d")).orderBy(F.desc("c")).collect()  # at most sqrt(2 N) rows
    least, have = 1 << 62, 0
    for r in of:
        if have + r.n > limit:
            break
        least, have = r.c, have + r.n
    head = words.where(F.col("c") >= least).toArrow()
    cols = [head.column(x).to_numpy() for x in ("w", "c", "d")]
    total, deleted, distinct = sum(r.c * r.n for r in of) + n_docs[0], sum(r.d for r in of) + n_docs[1], sum(r.n for r in of) + (n_docs[0] > 0)
    return Head(cols[0].view(np.uint64), cols[1], cols[2], total, deleted, distinct, n_docs[0], n_docs[1]), words.where(F.col("c") < least)


# --- blobs -------------------------------------------------------------------------


def _planes(a: np.ndarray) -> bytes:
    """Unsigned numbers as byte planes, low bytes first, behind their width."""
    width = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    return struct.pack("<BI", width, len(a)) + a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def _unplanes(data: bytes, at: int) -> tuple[np.ndarray, int]:
    width, n = struct.unpack_from("<BI", data, at)
    at += 5
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, width * n, at).reshape(width, n).T
    return out.view("<u8").ravel(), at + width * n


def _pack(*arrays: np.ndarray) -> bytes:
    return zlib.compress(b"".join(map(_planes, arrays)), 1)


def _unpack(data: bytes) -> list[np.ndarray]:
    raw, out, at = zlib.decompress(data), [], 0
    while at < len(raw):
        a, at = _unplanes(raw, at)
        out.append(a)
    return out


def _grouped(key: np.ndarray, doc: np.ndarray, fold: np.ndarray):
    """Sorted distinct keys with training and deleted counts, and (documents, counts) of each."""
    o = np.argsort(key, kind="stable")
    k, d = key[o], doc[o]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    cnt = np.diff(np.append(at, len(k)))
    k, d = k[at], d[at]
    head = np.ones(len(k), bool)
    head[1:] = k[1:] != k[:-1]
    first = np.flatnonzero(head)
    f = fold[d]
    if not len(first):
        z = np.zeros(0, np.int64)
        return k, z, z, z, d, cnt
    train = np.add.reduceat(np.where(f != HELD, cnt, 0), first)
    deleted = np.add.reduceat(np.where(f == DELETED, cnt, 0), first)
    return k[first], train, deleted, np.diff(np.append(first, len(k))), d, cnt


def _split(part: np.ndarray, key, train, deleted, docs, doc, cnt):
    """The arrays of ``_grouped`` for each part that has keys."""
    which = np.repeat(part, docs)
    o, q = np.argsort(part, kind="stable"), np.argsort(which, kind="stable")
    key, train, deleted, docs, doc, cnt = key[o], train[o], deleted[o], docs[o], doc[q], cnt[q]
    names, first = np.unique(part[o], return_index=True)
    ends = np.append(first, len(part))
    marks = np.append(np.searchsorted(which[q], names), len(which))
    for i, p in enumerate(names.tolist()):
        x, y = slice(ends[i], ends[i + 1]), slice(marks[i], marks[i + 1])
        yield p, key[x], train[x], deleted[x], docs[x], doc[y], cnt[y]


#: Kinds of blobs: pairs of head words, words outside the head, documents, pairs with such a word second, first and twice, counts for the last, digests of chunks.
PAIR, WORD, DOC, SECOND, FIRST, BOTH, COUNTS, DIGEST = range(8)


def _store(kind: int, names: list, train, deleted, docs, doc, cnt, base: int) -> bytes:
    """A blob: one word or two of each key, its counts, and how often it is in which documents (numbers from ``base`` on)."""
    v, *rest = names
    return _pack(np.diff(v, prepend=0) if kind == PAIR else v, *rest, train, deleted, docs if len(doc) else doc, doc - base, cnt)


def _open(kind: int, data: bytes, base: int) -> tuple:
    """What ``_store`` was given."""
    a = _unpack(data)
    if kind == PAIR:
        a[0] = np.cumsum(a[0])
    n = 1 if kind == WORD else 2
    train, deleted, docs, doc, cnt = (x.astype(np.int64) for x in a[n:])
    return a[:n], train, deleted, docs if len(docs) else np.zeros(len(train), np.int64), doc + base, cnt


def _opened(blobs: list, kind: int) -> tuple | None:
    """All blobs of a kind behind each other."""
    got = [_open(kind, x[3], x[2]) for x in blobs if x[1] == kind]
    if not got:
        return None
    names, *rest = zip(*got, strict=True)
    return [np.concatenate(x) for x in zip(*names, strict=True)], *[np.concatenate(x) for x in rest]


def _part_of(kind: int, names: list, slots: int, parts: int) -> np.ndarray:
    """The part of each key: by its hashed word, the first of two, or by the pair of numbers."""
    x = names[0].astype(np.uint64) * np.uint64(slots) + names[1].astype(np.uint64) if kind == PAIR else names[1 if kind == SECOND else 0]
    return (tx.mix(x.astype(np.uint64)) % np.uint64(parts)).astype(np.int64)


def _group_of(doc: np.ndarray, groups: int) -> np.ndarray:
    return (tx.mix((doc >> BLOCK).astype(np.uint64)) % np.uint64(groups)).astype(np.int64)


def _rows(out: list) -> pa.RecordBatch:
    part, kind, chunk, data = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(kind, pa.int32()), pa.array(chunk, pa.int64()), pa.array(data, pa.binary())], names=["part", "kind", "chunk", "data"])


def _gathered(rows: list, kind: int, slots: int, parts: int):
    """The blobs of many chunks as one blob a part, equal keys merged."""
    names, train, deleted, docs, doc, cnt = _opened(rows, kind)
    fine = _part_of(kind, names, slots, parts)
    o = np.lexsort((*names[::-1], fine))
    rank = np.empty(len(o), np.int64)
    rank[o] = np.arange(len(o))
    q = np.argsort(rank[np.repeat(np.arange(len(o)), docs)], kind="stable")
    doc, cnt, fine, names = doc[q], cnt[q], fine[o], [x[o] for x in names]
    new = np.ones(len(o), bool)
    new[1:] = np.any([x[1:] != x[:-1] for x in names], axis=0)
    first = np.flatnonzero(new)
    train, deleted, docs = (np.add.reduceat(x[o], first) for x in (train, deleted, docs))
    for p, at, *counts, d, n in _split(fine[first], first, train, deleted, docs, doc, cnt):
        base = int(d.min(initial=1 << 62)) if len(d) else 0
        yield p, kind, base, _store(kind, [x[at] for x in names], *counts, d, n, base)


def _gather(head, parts: int):
    """Blobs by ranges of parts, sorted, become blobs by part; a bounded number of bytes is held."""

    def flush(held: list, slots: int):
        out = [x for x in held if x[1] in (DOC, DIGEST)]
        for kind in sorted({x[1] for x in held} - {DOC, DIGEST}):
            out += _gathered(held, kind, slots, parts)
        return _rows(out)

    def run(batches):
        slots, held, size = head.value.slots, [], 0
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and (held[0][0] != row[0] or size >= GATHER):
                    yield flush(held, slots)
                    held, size = [], 0
                held.append(row)
                size += len(row[3])
        if held:
            yield flush(held, slots)
        tx.release()

    return run


def _blobs(head, parts: int, learn: bool, width: int = 1):
    """Rows (part, kind, chunk, data): pairs and words outside the head by range of ``width`` parts, the documents, and digests of what was read.
    ``chunk`` is the number of the first document.

    To ``learn`` only counts in training documents go out, but for pairs of two words outside
    the head, which carry all; to score all other kinds carry all.
    """

    def of(x: np.ndarray) -> np.ndarray:
        return (tx.mix(x) % np.uint64(parts)).astype(np.int64) // width

    def thin(kind: int, arrays: list) -> list:
        """Without documents, and without pairs and words that don't train."""
        if not learn or kind == BOTH:
            return arrays
        *names, train, deleted, _, _, _ = arrays
        use = train > 0
        z = np.zeros(0, np.int64)
        return [*[x[use] for x in (*names, train, deleted)], z, z, z]

    def run(batches):
        from pyspark import TaskContext

        at_doc = TaskContext.get().partitionId() << 40
        m = head.value
        log_c = np.log10(m.c + 1.0)
        for b in batches:
            ids, fold = b.column(0), b.column(1).to_numpy(zero_copy_only=False)
            for lo, hi, buf, offs in tx.parts(b.column(2), CHUNK):
                rows = hi - lo
                h, row = _hashes(buf, offs)
                words = np.bincount(row, minlength=rows)
                u, local = np.unique(h, return_inverse=True)
                short, u = np.append(m.ids(u), m.end), np.append(u, np.uint64(0))
                end, size = len(u) - 1, len(u)
                tail = short == m.rest
                token = np.full(len(h) + rows, end, np.int64)
                doc = np.repeat(np.arange(rows), words + 1)
                at = np.arange(len(h)) + row
                token[at] = local
                prev = np.concatenate(([end], token[:-1]))
                f = fold[lo:hi]
                out = []
                got = _grouped(prev * size + token, doc, f)
                v, w = got[0] // size, got[0] % size
                kind = np.where(tail[v], np.where(tail[w], BOTH, FIRST), np.where(tail[w], SECOND, PAIR))
                part = np.where(tail[v], of(u[v]), np.where(tail[w], of(u[w]), of((short[v] * m.slots + short[w]).astype(np.uint64))))
                for p, key, *rest in _split(kind * parts + part, *got):
                    k, p = divmod(p, parts)
                    if k == BOTH and not learn:
                        continue
                    v, w = key // size, key % size
                    v, w = u[v] if k in (FIRST, BOTH) else short[v], u[w] if k in (SECOND, BOTH) else short[w]
                    v, w, *rest = thin(k, [v, w, *rest])
                    if len(v):
                        out.append((p, k, at_doc, _store(k, [v, w], *rest, 0)))
                out_words = tail[local]
                got = _grouped(h[out_words], row[out_words], f)
                for p, key, *rest in _split(of(got[0]), *got):
                    key, *rest = thin(WORD, [key, *rest])
                    if len(key):
                        out.append((p, WORD, at_doc, _store(WORD, [key], *rest, 0)))
                names = ids.slice(lo, rows)
                null = np.asarray(names.is_null().to_numpy(zero_copy_only=False), np.float64)
                name = names.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
                seen = hashlib.blake2b(struct.pack("<q", at_doc), digest_size=16)
                for x in (name, null, offs, buf):
                    seen.update(np.ascontiguousarray(x))
                out.append((at_doc % parts // width, DIGEST, at_doc, seen.digest()))
                if not learn:
                    known = m.c[short[token]] > 0
                    base = np.where(tail[token], 0.0, log_c[short[token]]) - np.log10(m.total + m.distinct + 1.0)
                    info = np.stack((words + 1.0, np.bincount(doc, weights=known, minlength=rows), np.bincount(doc, weights=base, minlength=rows)))
                    info = np.concatenate((info, [null, f.astype(np.float64)]))
                    number = np.arange(at_doc, at_doc + rows)
                    for i in range(at_doc >> BLOCK, (at_doc + rows - 1 >> BLOCK) + 1):
                        x, y = np.searchsorted(number, (i << BLOCK, i + 1 << BLOCK))
                        data = number[x:y].astype("<i8").tobytes() + name[x:y].tobytes() + info[:, x:y].astype("<f8").tobytes()
                        out.append((int(number[x]) % parts // width, DOC, int(number[x]), data))
                tx.release()
                yield _rows(out)
                at_doc += rows

    return run


def _by(batches, key: int):
    """Runs of rows equal in column ``key`` of sorted batches, as lists of tuples."""
    held: list = []
    for b in batches:
        for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
            if held and held[0][key] != row[key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _merged(blobs: list, kind: int, slots: int):
    """(places of keys, documents, counts), and all keys (first word, second word, training and deleted counts)."""
    got = _opened(blobs, kind)
    if got is None:
        z, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        return (z, z, z), h, h, z, z
    names, train, deleted, docs, doc, cnt = got
    key, bound = names[0], np.uint64(slots)
    if kind == PAIR:
        key = key * bound + names[1]
    elif kind != WORD:  # two words of which one or both are hashes: number them first
        of_v, v = np.unique(key, return_inverse=True)
        of_w, w = np.unique(names[1], return_inverse=True)
        key, bound = v.astype(np.uint64) * np.uint64(len(of_w)) + w.astype(np.uint64), np.uint64(len(of_w))
    u, at = np.unique(key, return_inverse=True)
    c = np.bincount(at, weights=train, minlength=len(u)).astype(np.int64)
    d = np.bincount(at, weights=deleted, minlength=len(u)).astype(np.int64)
    where = np.repeat(at, docs), doc, cnt
    if kind == WORD:
        return where, u, u, c, d
    v, w = u // bound, u % bound
    return (where, v, w, c, d) if kind == PAIR else (where, of_v[v.astype(np.int64)], of_w[w.astype(np.int64)], c, d)


def _counts(words: np.ndarray, c: np.ndarray, d: np.ndarray):
    """Training and deleted counts of words by a sorted table; 0 for others."""

    def of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(words):
            return np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        i = np.minimum(np.searchsorted(words, x), len(words) - 1)
        return np.where(words[i] == x, c[i], 0), np.where(words[i] == x, d[i], 0)

    return of


def _pairs(blobs: list, m: Head):
    """Of each kind of pairs: where they are, pair counts, counts of the first and of the second word (training and deleted)."""

    def short(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return m.c[x.astype(np.int64)], m.d[x.astype(np.int64)]

    kinds = {b[1] for b in blobs}
    hashed = None
    if kinds & {FIRST, SECOND}:
        _, words, _, c, d = _merged(blobs, WORD, m.slots)
        hashed = _counts(words, c, d)
    elif BOTH in kinds:
        got = [_unpack(b[3]) for b in blobs if b[1] == COUNTS]
        words, c, d = (np.concatenate([g[i] for g in got] or [np.zeros(0, np.uint64)]) for i in range(3))
        o = np.argsort(words)
        hashed = _counts(words[o], c[o].astype(np.int64), d[o].astype(np.int64))
    for kind, first, second in ((PAIR, short, short), (SECOND, short, hashed), (FIRST, hashed, short), (BOTH, hashed, hashed)):
        if kind in kinds:
            where, v, w, c, d = _merged(blobs, kind, m.slots)
            yield where, (c, d), first(v), second(w)


def _words_of(batches):
    """Rows (part, w): the words of pairs of two words outside the head."""
    for b in batches:
        for part, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            w = np.unique(np.concatenate(_unpack(data)[:2])).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(w), pa.int32()), pa.array(w)], names=["part", "w"])


def _count_blobs(batches):
    for b in batches:
        part, w, c, d = (x.to_numpy(zero_copy_only=False) for x in b.columns)
        names = np.unique(part)
        data = [_pack(w[part == p].view(np.uint64), c[part == p], d[part == p]) for p in names]
        n = len(names)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array([COUNTS] * n, pa.int32()), pa.array([0] * n, pa.int64()), pa.array(data, pa.binary())], names=["part", "kind", "chunk", "data"])


def _ratio(a: np.ndarray, b: np.ndarray | float) -> np.ndarray:
    return np.where(np.asarray(b) > 0, a / np.maximum(b, 1), 0.0)


def bucket(count: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(count + 1.0)).astype(np.int64)


def _histogram(head, pairs_of_both: bool):
    """Deleted tokens by context bucket and the two maximum-likelihood ratios of the other counts.

    Pairs of two words outside the head and digests are passed on, or (``pairs_of_both``) are all there is, with their counts.
    """

    def run(batches):
        m = head.value
        total = m.total - m.deleted
        nothing = [pa.nulls(0, k) for k in (pa.int64(), pa.int64(), pa.int64(), pa.float64())]
        for blobs in _by(batches, 0):
            if not pairs_of_both:
                both = [x for x in blobs if x[1] in (BOTH, DIGEST)]
                blobs = [x for x in blobs if x[1] not in (BOTH, DIGEST)]
                if both:
                    kinds = (pa.int32(), pa.int32(), pa.int64(), pa.binary())
                    rows = [pa.array([x[i] for x in both], k) for i, k in enumerate(kinds)]
                    yield pa.RecordBatch.from_arrays([*[pa.nulls(len(both), x.type) for x in nothing], *rows], names=_LEARN_NAMES)
            for _, (c, d), (cv, dv), (cw, dw) in _pairs(blobs, m):
                use = d > 0
                if not use.any():
                    continue
                ctx = (cv - dv)[use]
                cells = []
                for p in (_ratio((c - d)[use], ctx), _ratio((cw - dw)[use], float(total))):
                    cells.append(np.where(p > 0, np.round(-np.log2(np.maximum(p, 1e-300)) * STEP), -1).astype(np.int64))
                cell, at = np.unique(np.stack((bucket(ctx), *cells)), axis=1, return_inverse=True)
                n = np.bincount(at.ravel(), weights=d[use], minlength=cell.shape[1])
                rest = [pa.nulls(len(n), k) for k in (pa.int32(), pa.int32(), pa.int64(), pa.binary())]
                yield pa.RecordBatch.from_arrays([*[pa.array(x) for x in cell], pa.array(n), *rest], names=_LEARN_NAMES)
        tx.release()

    return run


def expectation_maximisation(cells: np.ndarray, classes: int, rounds: int = 40) -> np.ndarray:
    """Weights (bucket, [uniform, unigram, bigram]) from rows (bucket, q2, q1, tokens)."""
    out = np.full((64, 3), 1 / 3)

    def fit(rows: np.ndarray) -> np.ndarray:
        p = np.stack((np.full(len(rows), 1 / classes), *[np.where(rows[:, i] >= 0, 2.0 ** (-rows[:, i] / STEP), 0.0) for i in (2, 1)]), axis=1)
        l = np.full(3, 1 / 3)  # noqa: E741
        for _ in range(rounds):
            post = p * l
            post *= (rows[:, 3] / post.sum(axis=1))[:, None]
            l = (post.sum(axis=0) + 1e-6) / (post.sum() + 3e-6)  # noqa: E741
        return l

    if len(cells):
        out[:] = fit(cells)
        for b in np.unique(cells[:, 0]).astype(int):
            out[b] = fit(cells[cells[:, 0] == b])
    return out


def _partial_scores(head, weights: np.ndarray, groups: int, kind: int):
    """Rows (grp, part, kind, data): what the pairs and words of one part add to a group's documents; documents and digests pass."""

    def run(batches):
        m = head.value
        total = float(m.total)
        unseen = weights[0] + np.array([0, weights[0, 2], 0])  # a context never seen: its bigram weight goes to the unigrams
        for blobs in _by(batches, 0):
            part = blobs[0][0]
            passing = [x for x in blobs if x[1] in (DOC, DIGEST)]
            out = list(zip(_group_of(np.array([x[2] for x in passing], np.int64), groups).tolist(), [x[1] for x in passing], [x[3] for x in passing], strict=True))
            adds = []
            for (at, doc, cnt), (c, _), (cv, _), (cw, _) in _pairs(blobs, m):
                l = np.where(cv[:, None] > 0, weights[bucket(cv)], unseen)  # noqa: E741
                log_p = np.log10(l[:, 2] * _ratio(c, cv) + l[:, 1] * _ratio(cw, total) + l[:, 0] / m.classes)
                adds.append((0, doc, cnt * log_p[at]))
            (at, doc, cnt), _, _, c, _ = _merged(blobs, WORD, m.slots)
            adds += [(1, doc, cnt * (c[at] > 0)), (2, doc, cnt * np.log10(c + 1.0)[at])]
            number = np.unique(np.concatenate([x[1] for x in adds]))
            sums = np.zeros((3, len(number)))
            for row, doc, x in adds:
                sums[row] += np.bincount(np.searchsorted(number, doc), weights=x, minlength=len(number))
            group = _group_of(number, groups)
            o = np.argsort(group, kind="stable")
            names, first = np.unique(group[o], return_index=True)
            for g, x in zip(names.tolist(), np.split(o, first[1:]), strict=False):  # a part of nothing still splits into one
                out.append((g, kind, zlib.compress(number[x].astype("<i8").tobytes() + sums[:, x].tobytes(), 1)))
            if out:
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([part] * n, pa.int32()), pa.array([x[1] for x in out], pa.int32()), pa.array([x[2] for x in out], pa.binary())], names=["grp", "part", "kind", "data"])
        tx.release()

    return run


def _totals(head):
    """Documents with their sums, of rows (grp, part, kind, data) sorted by the first three."""
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]

    def run(batches):
        m = head.value
        for rows in _by(batches, 0):
            seen = Counter(x[3] for x in rows if x[2] == DIGEST)
            if any(n != 2 for n in seen.values()):
                raise RuntimeError("the texts came in another order when they were read again: score them with stable=False")
            infos = [(x[3], len(x[3]) // 56) for x in rows if x[2] == DOC]
            number, doc = (np.concatenate([np.frombuffer(x, "<i8", n, i * 8 * n) for x, n in infos] or [np.zeros(0, np.int64)]) for i in range(2))
            tokens, known, base, null, fold = np.concatenate([np.frombuffer(x, "<f8", 5 * n, 16 * n).reshape(5, n) for x, n in infos] or [np.zeros((5, 0))], axis=1)
            order = np.argsort(number)
            sums = np.zeros((3, len(number)))
            for _, _, kind, data in rows:
                if kind not in (DOC, DIGEST):
                    raw = zlib.decompress(data)
                    k = len(raw) // 32
                    sums[:, order[np.searchsorted(number, np.frombuffer(raw, "<i8", k), sorter=order)]] += np.frombuffer(raw, "<f8", 3 * k, 8 * k).reshape(3, k)
            cols = [pa.array(doc, mask=null > 0), pa.array(fold == HELD), pa.array(tokens.astype(np.int64)), pa.array((known + sums[1]).astype(np.int64)), pa.array(np.full(len(doc), m.total, np.int64)), pa.array(base + sums[2]), pa.array(sums[0])]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return run


_BLOB = "part int, kind int, chunk bigint, data binary"
_LEARN = f"b bigint, q2 bigint, q1 bigint, n double, {_BLOB}"
_LEARN_NAMES = ["b", "q2", "q1", "n", "part", "kind", "chunk", "data"]
_PARTIAL = "grp bigint, part int, kind int, data binary"
_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score(docs: DataFrame, head_words: int = HEAD, stable: bool = True, part_tokens: int = PART_TOKENS, fan: int = FAN) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document."""
    spark = docs.sparkSession
    if not stable:
        docs = table(docs.select("doc_id", "text"), "texts")
    keyed = folds(docs)
    model, others = learn_head(keyed, head_words)
    head = spark.sparkContext.broadcast(model)
    shuffle = int(spark.conf.get("spark.sql.shuffle.partitions"))
    n = max(shuffle, -(-model.total // part_tokens))
    parts, tasks, groups = 2 * n, min(n, TASKS), max(shuffle, int(model.c[model.end]) >> GROUP_DOCS)
    width = -(-parts // fan)

    def by_part(df: DataFrame) -> DataFrame:
        return df.repartition(tasks, "part").sortWithinPartitions("part", "chunk", "kind")

    def blobs(learn: bool) -> DataFrame:
        out = keyed.mapInArrow(_blobs(head, parts, learn, width), _BLOB)
        if width > 1:
            slices = -(-tasks // fan)  # a range of parts may go to several tasks
            out = out.repartition(tasks, "part", F.pmod(F.xxhash64("chunk"), F.lit(slices))).sortWithinPartitions("part", "chunk", "kind").mapInArrow(_gather(head, parts), _BLOB)
        return by_part(out)

    counts = blobs(True)
    learned = table(counts.mapInArrow(_histogram(head, False), _LEARN), "learned")
    both = learned.where("data IS NOT NULL").select("part", "kind", "chunk", "data")
    need = both.where(F.col("kind") == BOTH).select("part", "data").mapInArrow(_words_of, "part int, w bigint").distinct()
    both = table(both.unionByName(need.join(others, "w").select("part", "w", "c", "d").mapInArrow(_count_blobs, _BLOB)), "rare_pairs")
    cells = learned.where("data IS NULL").unionByName(by_part(both).mapInArrow(_histogram(head, True), _LEARN))
    cells = cells.groupBy("b", "q2", "q1").agg(F.sum("n").alias("n")).orderBy("b", "q2", "q1").toArrow()
    rows = np.stack([cells.column(x).to_numpy().astype(np.float64) for x in ("b", "q2", "q1", "n")], axis=1) if cells.num_rows else np.zeros((0, 4))
    drop(learned)
    weights = expectation_maximisation(rows, model.classes)
    every = blobs(False).mapInArrow(_partial_scores(head, weights, groups, PAIR), _PARTIAL)
    every = every.unionByName(by_part(both).mapInArrow(_partial_scores(head, weights, groups, BOTH), _PARTIAL))
    return table(every.repartition(min(groups, TASKS), "grp").sortWithinPartitions("grp", "part", "kind").mapInArrow(_totals(head), _SCORES), "scores")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(documents(spark, sf_dir).select("doc_id", "text"))
