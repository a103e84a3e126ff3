"""Every window of L units that occurs at least twice in a collection, without pairs.

Shared by the substring operators (units: words or bytes).  The anchor of a
window is its leftmost smallest K-unit hash, so equal windows have equal anchors
at equal offsets.  Neighbouring windows with one anchor form a *superwindow*; each
window belongs to exactly one.

1. One pass writes a row per superwindow: anchor hash ``a``, digest ``s`` of its
   symbols (64 bits of blake2b, so superwindows are told apart within an anchor),
   place.  Rows of anchors that occur once are done: no window repeats.
2. Equal superwindows are counted and one of each brings its text, with a mark
   whether it occurs more than once; the texts of an anchor are compared symbol by
   symbol by the caller's ``resolve``, which takes a marked one as two.
3. Anchors with more than ``hot`` distinct superwindows are refined by more of what
   surrounds them: their superwindows are cut into pieces by the windows' offsets,
   and the symbols that all windows of a piece share are the anchor of the piece.
   Pieces go through 2 again, with finer cuts as long as a group is hot; a piece of
   one window is its own anchor, so this ends.
4. The repeated windows go back to their documents as ranges.

Documents are keyed by id and a text hash; rows equal in both count as separate
occurrences and get equal results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import bounded, drop, split_join, table

BLOCK = 1 << 20
HOT = 2_000
FINER = 4
RANGES = "array<struct<at:int,n:int>>"
_TEXTS = "a bigint, s bigint, off int, n int, twice boolean, x binary"


def anchors_of(sym_hash, n_units: int, ends, L: int, K: int):
    """(first window, windows, anchor offset, anchor hash) arrays, block by block.

    ``ends(b, e)``: end (in units) of the row that each of the units b..e-1 belongs
    to; ``sym_hash(b, e)``: K-unit hashes of starts b..e-1.
    """
    w = L - K + 1
    for b in range(0, max(0, n_units - L + 1), BLOCK):
        e = min(b + BLOCK, n_units - L + 1)
        valid = ends(b, e) - np.arange(b, e) >= L
        if not valid.any():
            continue
        h = sym_hash(b, e + w - 1)
        p = tx.minima(h, w) + b
        i = np.flatnonzero(valid)
        at = p[i]
        new = np.ones(len(i), bool)
        new[1:] = (at[1:] != at[:-1]) | (i[1:] != i[:-1] + 1)
        first = np.flatnonzero(new)
        n = np.diff(np.append(first, len(i)))
        lo = i[first] + b
        yield lo, n, at[first] - lo, h[at[first] - b]


_ANCHOR_TYPE = "id bigint, h bigint, lo int, n int, off int, a bigint, s bigint"


def _symbols(piece: bytes, off: int, n: int) -> int:
    return tx.digest64(b"%d,%d," % (off, n) + piece)


def _byte_anchors(buf: np.ndarray, offs: np.ndarray, L: int, K: int):
    row_end = offs[1:]

    def ends(b: int, e: int) -> np.ndarray:
        return row_end[np.searchsorted(offs, np.arange(b, e), side="right") - 1]

    for lo, n, off, a in anchors_of(lambda b, e: tx.rolling(buf[b : e + K - 1], K), len(buf), ends, L, K):
        base = int(lo[0])
        raw = buf[base : int((lo + n).max()) + L - 1].tobytes()
        s = [_symbols(raw[i : i + k + L - 1], o, k) for i, k, o in zip((lo - base).tolist(), n.tolist(), off.tolist(), strict=True)]
        row = np.searchsorted(offs, lo, side="right") - 1
        yield row, lo - offs[row], n, off, a, np.array(s, np.uint64)


def _word_anchors(buf: np.ndarray, offs: np.ndarray, L: int, K: int):
    s, e, row = tx.words(buf, offs)
    if len(s) < L:
        return
    h = tx.span_hash(buf, s, e)
    first = np.searchsorted(row, np.arange(len(offs) - 1))
    row_end = np.append(first[1:], len(s))
    wide = np.zeros(len(s) + 1, np.int32)  # places before word i where more or other than one space parts words
    wide[2:] = np.cumsum((s[1:] - e[:-1] != 1) | (buf[np.minimum(e[:-1], len(buf) - 1)] != 32))
    for lo, n, off, a in anchors_of(lambda b, z: tx.gram_hash(h[b : z + K - 1], K), len(s), lambda b, z: row_end[row[b:z]], L, K):
        last = lo + n + L - 2
        begin, stop = s[lo], e[last]
        base = int(begin[0])
        raw = buf[base : int(stop.max())].tobytes()
        plain = wide[last + 1] == wide[lo + 1]
        got = []
        for i, j, k, o, ok in zip((begin - base).tolist(), (stop - base).tolist(), n.tolist(), off.tolist(), plain.tolist(), strict=True):
            got.append(_symbols(raw[i:j] if ok else b" ".join(raw[i:j].split()), o, k))
        r = row[lo]
        yield r, lo - first[r], n, off, a, np.array(got, np.uint64)


def _superwindows(units: str, L: int, K: int):
    make = _byte_anchors if units == "byte" else _word_anchors

    def run(batches):
        for batch in batches:
            ids, hs = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False)
            for base, _, buf, offs in tx.parts(batch.column(2), BLOCK):
                for row, lo, n, off, a, s in make(buf, offs, L, K):
                    r = row + base
                    cols = [ids.take(pa.array(r)), pa.array(hs[r]), *[pa.array(x.astype(np.int32)) for x in (lo, n, off)], pa.array(a.view(np.int64)), pa.array(s.view(np.int64))]
                    yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "lo", "n", "off", "a", "s"])

    return run


def _cut(units: str, L: int):
    """Texts of the wanted superwindows of each document."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(6)]
            for text, want in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode("utf-8", "surrogatepass")
                seq = raw if units == "byte" else raw.split()
                for x in want.as_py():
                    piece = seq[x["lo"] : x["lo"] + x["n"] + L - 1]
                    for o, v in zip(out, (x["a"], x["s"], x["off"], x["n"], x["c"] > 1, piece if units == "byte" else b" ".join(piece)), strict=True):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["a", "s", "off", "n", "twice", "x"])

    return run


def _resolver(resolve, L: int, batch_rows: int):
    """Streams whole anchor groups (input sorted by ``a``) through ``resolve``."""

    def emit(a: np.ndarray, s: np.ndarray, off, n, twice, x):
        m = len(a)
        two = np.flatnonzero(twice)
        every = np.concatenate((np.arange(m), two))  # one that occurs more than once stands for two
        group = np.unique(a, return_inverse=True)[1]
        bits = resolve(group[every], off[every], n[every], [*x, *[x[i] for i in two.tolist()]], L)[:m]
        got = [i for i, b in enumerate(bits) if b.any()]
        ranges = [_ranges(bits[i]) for i in got]
        return pa.RecordBatch.from_arrays([pa.array(a[got]), pa.array(s[got]), pa.array(ranges, pa.list_(pa.struct([("at", pa.int32()), ("n", pa.int32())])))], names=["a", "s", "r"])

    def run(batches):
        held: list = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            rows += batch.num_rows
            if rows < batch_rows:
                continue
            t = pa.Table.from_batches(held)
            a = t.column("a").to_numpy()
            cut = int(np.flatnonzero(a != a[-1])[-1]) + 1 if a[0] != a[-1] else 0
            if cut:
                yield emit(*_columns(t.slice(0, cut)))
            held, rows = t.slice(cut).combine_chunks().to_batches(), t.num_rows - cut
        if held:
            yield emit(*_columns(pa.Table.from_batches(held)))
        tx.release()

    return run


def _columns(t: pa.Table):
    return (*[t.column(c).to_numpy() for c in ("a", "s", "off", "n", "twice")], t.column("x").to_pylist())


def _ranges(bits: np.ndarray) -> list[dict]:
    d = np.diff(np.concatenate(([0], bits.astype(np.int8), [0])))
    return [{"at": int(s), "n": int(e - s)} for s, e in zip(np.flatnonzero(d == 1), np.flatnonzero(d == -1), strict=True)]


def _pieces(units: str, L: int, step: int):
    """Superwindows cut by window offset into pieces of at most ``step`` windows, under what all windows of a piece share."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in range(9)]
            for a, s, off, n, twice, x in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                seq = x if units == "byte" else x.split(b" ")
                for b in range((off - n + 1) // step, off // step + 1):  # windows with b * step <= offset < (b + 1) * step
                    lo, hi = max(0, off - (b + 1) * step + 1), min(n - 1, off - b * step)
                    core, piece = seq[off - b * step : off + L - (b + 1) * step + 1], seq[lo : hi + L]
                    if units != "byte":
                        core, piece = b" ".join(core), b" ".join(piece)
                    key = [tx.digest64(v) for v in (b"%d,%d,%d," % (a, b, step) + core, b"%d,%d," % (off - lo, hi - lo + 1) + piece)]
                    for o, v in zip(out, (*[k - (1 << 64) if k >> 63 else k for k in key], off - lo, hi - lo + 1, twice, piece, a, s, lo), strict=True):
                        o.append(v)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["a", "s", "off", "n", "twice", "x", "pa", "ps", "lo"])

    return run


def _solved(texts: DataFrame, units: str, L: int, resolver, hot: int, step: int) -> DataFrame:
    """(a, s, r) of the distinct superwindows ``texts``, a written table that is dropped here; hot anchors by pieces."""
    sizes = table(texts.groupBy("a").agg(F.count("*").alias("g")).where(F.col("g") > hot).select("a"), "hot")
    if not sizes.limit(1).count():
        out = table(_verdicts(texts, resolver), "verdicts")
        drop(texts, sizes)
        return out
    big = bounded(sizes, 200_000)
    easy = table(_verdicts(texts.join(big, "a", "left_anti"), resolver), "verdicts")
    cut = texts.join(big, "a", "left_semi").select("a", "s", "off", "n", "twice", "x")
    pieces = table(cut.mapInArrow(_pieces(units, L, step), f"{_TEXTS}, pa bigint, ps bigint, lo int"), "pieces")
    drop(texts, sizes)
    one = [F.first(c).alias(c) for c in ("off", "n", "x")]
    of = pieces.groupBy("a", "s").agg(F.count("*").alias("c"), (F.max("twice") | (F.count("*") > 1)).alias("twice"), *one)
    of = table(of, "distinct_pieces")
    # a piece whose anchor has no other and that occurs once repeats nowhere
    many = table(of.groupBy("a").agg(F.count("*").alias("c"), F.max("twice").alias("t")).where("c > 1 OR t").select("a", "c"), "many")
    again = table(split_join(of.select("a", "s", "off", "n", "twice", "x"), many, ["a"]).select("a", "s", "off", "n", "twice", "x"), "texts")
    told = _solved(again, units, L, resolver, hot, max(1, step // FINER))
    back = split_join(pieces.select("a", "s", "pa", "ps", "lo"), table(told.join(of.select("a", "s", "c"), ["a", "s"]), "told"), ["a", "s"])
    back = back.select(F.col("pa").alias("a"), F.col("ps").alias("s"), _moved("lo").alias("r"))
    out = table(easy.unionByName(back.groupBy("a", "s").agg(F.flatten(F.collect_list("r")).alias("r")).select("a", "s", F.col("r").cast(RANGES).alias("r"))), "verdicts")
    drop(easy, pieces, of, many, told)
    return out


def _moved(lo: str):
    return F.transform("r", lambda x: F.struct((F.col(lo) + x["at"]).alias("at"), x["n"].alias("n")))


def repeated_windows(docs: DataFrame, units: str, L: int, K: int, resolve, hot: int = HOT, batch_rows: int = 40_000) -> tuple[DataFrame, DataFrame]:
    """(documents as id, h, text; repeated windows as id, h, ``r``: ranges of window starts).

    ``docs`` has doc_id and text.  Documents without a repeated window have no row
    in the second table.
    """
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text"))
    rows = table(keyed.mapInArrow(_superwindows(units, L, K), _ANCHOR_TYPE), "anchors")
    many = table(rows.groupBy("a").agg(F.count("*").alias("c")).where("c > 1"), "many")
    cand = table(split_join(rows, many, ["a"]), "candidates")
    drop(rows, many)
    first = [F.first(c).alias(c) for c in ("id", "h", "lo", "off", "n")]
    reps = table(cand.groupBy("a", "s").agg(F.count("*").alias("c"), *first), "distinct")
    # an anchor whose superwindows are all different is compared, one superwindow more than once is marked
    want = reps.groupBy("id", "h").agg(F.collect_list(F.struct("a", "s", "lo", "off", "n", "c")).alias("w"))
    joined = keyed.alias("d").join(want.hint("shuffle_hash").alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h")))
    texts = joined.select("text", "w").mapInArrow(_cut(units, L), _TEXTS)
    # rows equal in id and text bring their superwindows twice
    texts = table(texts.groupBy("a", "s").agg(*[F.first(c).alias(c) for c in ("off", "n", "twice", "x")]), "texts")
    told = _solved(texts, units, L, _resolver(resolve, L, batch_rows), hot, max(1, (L - K + 1) // FINER))
    told = table(told.join(reps.select("a", "s", "c"), ["a", "s"]), "told")
    found = split_join(cand.select("id", "h", "lo", "a", "s"), told, ["a", "s"]).select("id", "h", _moved("lo").alias("r"))
    spans = table(found.groupBy("id", "h").agg(F.flatten(F.collect_list("r")).alias("r")), "spans")
    drop(cand, reps, told)
    return keyed, spans


def _verdicts(texts: DataFrame, resolver) -> DataFrame:
    return texts.select("a", "s", "off", "n", "twice", "x").repartition("a").sortWithinPartitions("a").mapInArrow(resolver, f"a bigint, s bigint, r {RANGES}")


def with_ranges(keyed: DataFrame, ranges: DataFrame) -> DataFrame:
    """id, text, r (null: nothing repeats): the texts meet their ranges."""
    on = F.col("d.id").eqNullSafe(F.col("r.id")) & (F.col("d.h") == F.col("r.h"))
    return keyed.alias("d").join(ranges.hint("shuffle_hash").alias("r"), on, "left").select(F.col("d.id").alias("id"), F.col("d.text").alias("text"), F.col("r.r").alias("r"))


def cover(ranges: list | None, L: int, n: int) -> np.ndarray:
    """Which of n units lie in a window of L that starts in one of the ranges."""
    d = np.zeros(n + 1, np.int32)
    if ranges is not None and len(ranges):
        at = np.array([x["at"] for x in ranges])
        k = np.array([x["n"] for x in ranges])
        np.add.at(d, at, 1)
        np.add.at(d, at + k - 1 + L, -1)
    return np.cumsum(d[:n]) > 0
