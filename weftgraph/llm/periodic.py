"""Operator 13: periodic runs of words, by a harmonic grid of longest common extensions.

A run is a stretch of words with smallest period p, at least ``COPIES`` periods
and ``SHORTEST`` words long, that no neighbouring word extends with the same
period.  For every period p of a text, each two neighbours jp and (j + 1)p of
the grid are extended forward and backward: a run with period p covers several
such pairs and is what their extensions span.  Extensions are range minima over
the common prefixes of neighbours in the suffix array (forward) and in that of
the reversed words (backward).  Pairs of different words extend by nothing and
need no query, and a run of four periods holds three equal pairs in a row, so
only those are asked; texts without any get no suffix array.  A stretch whose
period is a multiple of its smallest one is found under both and kept under the
smaller.

``collapsed`` keeps the first period of every run and drops the rest of it.

A batch's texts share one suffix array, whose first symbol holds the text's
number, so common prefixes end with the text: prefixes are doubled, only groups
that are not yet single are sorted again, and the common prefix at a new border
is the doubled length plus a range minimum over the borders before
(Manber and Myers).  Words are numbered by Arrow's dictionary: no hash decides.

Plan: one pass over the table, no shuffle.  Rows are independent; each task
holds a batch of texts, of which about half a megabyte is worked on at a time.

Nulls: a null text has no words and no runs, its collapsed text is empty; a null
id is kept (and plants nothing).  Empty texts likewise.  A text of any length is taken
whole, in about 150 bytes a word, its pairs a million at a time.  Ties for the
greatest exponent: smallest start, then period.  Repeated rows: equal results
each.  Empty table: no rows.  Other columns are not used, whatever their names.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import documents

COPIES, SHORTEST = 4, 6
#: Grid pairs and extensions that are worked on at a time.
PAIRS = 1 << 20
TYPE = "doc_id bigint, n_words bigint, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string"
_FAR = np.iinfo(np.int32).max
_SPAN = 16


class RangeMin:
    """Minima over ranges: running minima from both ends of blocks, and a sparse table over whole blocks."""

    def __init__(self, v: np.ndarray) -> None:
        wide = np.full(-(-len(v) // _SPAN) * _SPAN, _FAR, np.int32)
        wide[: len(v)] = v
        b = wide.reshape(-1, _SPAN)
        self.v, self.pre = wide, np.minimum.accumulate(b, axis=1).ravel()
        self.suf = np.minimum.accumulate(b[:, ::-1], axis=1)[:, ::-1].ravel()
        self.levels = [b.min(axis=1)]
        while (k := 1 << (len(self.levels) - 1)) * 2 <= len(b):
            low = self.levels[-1]
            self.levels.append(np.minimum(low[:-k], low[k:]))

    def query(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least value at lo .. hi, both included, for each range."""
        a, z = lo // _SPAN, hi // _SPAN
        out = np.minimum(self.suf[lo], self.pre[hi])
        gap = z - a - 1
        far = np.flatnonzero(gap > 0)
        level = np.frexp(gap[far].astype(np.float64))[1] - 1  # exact: floor of the logarithm
        for k in np.unique(level).tolist():
            at = far[level == k]
            low = self.levels[k]
            out[at] = np.minimum(out[at], np.minimum(low[a[at] + 1], low[z[at] - (1 << k)]))
        near = np.flatnonzero(gap < 0)
        left, right = lo[near], hi[near]
        got = self.v[left]
        for step in range(1, int((right - left).max(initial=0)) + 1):
            got = np.minimum(got, self.v[np.minimum(left + step, right)])
        out[near] = got
        return out


class Extensions:
    """Longest common extensions to the right between places of texts that are laid end to end."""

    def __init__(self, symbols: np.ndarray, starts: np.ndarray) -> None:
        """``symbols``: small numbers; ``starts``: first place of each text, and the end."""
        n = len(symbols)
        length = np.diff(starts)
        end = np.repeat(starts[1:], length)
        key = np.repeat(np.arange(len(length)), length) * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        first = key[order]
        new = np.append(True, first[1:] != first[:-1])
        lcp = np.where(new, 0, _FAR).astype(np.int32)  # with the suffix before
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0))
        h = 1
        while len(act := np.flatnonzero(~new | np.append(~new[1:], False))):
            suffix = order[act]
            group = rank[suffix]
            after = suffix + h
            second = np.where(after < end[suffix], rank[np.minimum(after, n - 1)], -1)
            o = np.argsort(group * (n + 1) + second, kind="stable")
            suffix, second = suffix[o], second[o]
            order[act] = suffix
            at = np.flatnonzero((group[1:] == group[:-1]) & (second[1:] != second[:-1])) + 1
            below, above = second[at - 1], second[at]
            value = np.full(len(at), h, np.int32)
            some = np.flatnonzero(below >= 0)
            if len(some):
                value[some] += RangeMin(lcp).query(below[some] + 1, above[some])
            lcp[act[at]], new[act[at]] = value, True
            rank[suffix] = np.maximum.accumulate(np.where(new[act], act, 0))
            h *= 2
        self.rank, self.low = rank, RangeMin(lcp)

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols agree from a and from b on (a and b differ and lie in one text)."""
        x, y = self.rank[a], self.rank[b]
        return self.low.query(np.minimum(x, y) + 1, np.maximum(x, y)).astype(np.int64)


def _grid(symbols: np.ndarray, starts: np.ndarray):
    """(text, period, place) of grid pairs of equal words that two further equal pairs follow."""
    n = np.diff(starts)
    periods = np.where(n >= SHORTEST, n // COPIES, 0)
    text = np.repeat(np.arange(len(n)), periods)
    period = np.arange(len(text)) - np.repeat(np.cumsum(periods) - periods, periods) + 1
    pairs = (n[text] - 1) // period
    ends = np.cumsum(pairs)
    lo = 0
    while lo < len(text):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + PAIRS, side="right")))
        count = pairs[lo:hi]
        item = np.repeat(np.arange(lo, hi), count)
        j = np.arange(len(item)) - np.repeat(np.cumsum(count) - count, count)
        at = starts[text[item]] + j * period[item]
        same = np.flatnonzero(symbols[at] == symbols[at + period[item]])
        if len(same) > 2:
            k = np.flatnonzero((same[2:] == same[:-2] + 2) & (item[same[2:]] == item[same[:-2]]))
            hit = same[k]
            if len(hit):
                yield text[item[hit]], period[item[hit]], at[hit]
        lo = hi


def find_runs(symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rows (text, start in the text, length, period) of all runs, by text, start and period; ``symbols`` are word numbers of texts laid end to end."""
    got = [np.concatenate(x) for x in zip(*_grid(symbols, starts), strict=True)]
    if not got:
        return np.zeros((0, 4), np.int64)
    text, period, at = got
    # suffix arrays over the texts that have candidates only
    used, own = np.unique(text, return_inverse=True)
    length = (starts[used + 1] - starts[used]).astype(np.int64)
    base = np.append(0, np.cumsum(length))
    place = np.repeat(starts[used] - base[:-1], length) + np.arange(base[-1])
    dense = np.unique(symbols[place], return_inverse=True)[1]
    a = at - starts[text] + base[own]
    forth, back = np.zeros(len(a), np.int64), np.zeros(len(a), np.int64)
    total = int(base[-1])
    for ahead in (True, False):
        e = Extensions(dense, base) if ahead else Extensions(dense[::-1], total - base[::-1])
        for i in range(0, len(a), PAIRS):
            x, p = a[i : i + PAIRS], period[i : i + PAIRS]
            if ahead:
                forth[i : i + PAIRS] = e.between(x, x + p)
            else:  # the words before both places, read backwards
                some = np.flatnonzero(x > base[own[i : i + PAIRS]])
                back[i + some] = e.between(total - x[some], total - x[some] - p[some])
        del e
    start, size = a - back - base[own], back + period + forth
    ok = size >= np.maximum(SHORTEST, COPIES * period)
    rows = np.stack((text, start, size, period), axis=1)[ok]
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1], rows[:, 0]))]
    new = np.append(True, (rows[1:, :3] != rows[:-1, :3]).any(axis=1)) if len(rows) else np.zeros(0, bool)
    rows = rows[new]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def planted(doc_id: int | None, n: int) -> np.ndarray | None:
    """The numbers of the words that stand at 0 .. n - 1 once a period is planted by the id; None where none is."""
    if doc_id is None or not n:
        return None
    g, rest = divmod(zlib.crc32(str(doc_id).encode()), 10)
    if rest:
        return None
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % p)


def periodic_runs(docs: DataFrame, plant: bool = False) -> DataFrame:
    """(doc_id, n_words, runs, collapsed) of ``docs`` (doc_id, text); ``plant`` makes one text in ten periodic first."""

    def some(ids: list[int | None], buf: np.ndarray, offs: np.ndarray) -> list[pa.Array]:
        s, e, row = tx.words(buf, offs)
        symbols = tx.numbers(buf, s, e)[0].astype(np.int64)
        n = np.bincount(row, minlength=len(ids))
        starts = np.append(0, np.cumsum(n))
        moved = {}
        if plant:
            for k, (i, m) in enumerate(zip(ids, n.tolist(), strict=True)):
                if (to := planted(i, m)) is not None:
                    moved[k] = to
                    symbols[starts[k] : starts[k + 1]] = symbols[starts[k] + to]
        runs = find_runs(symbols, starts)
        cut = np.searchsorted(runs[:, 0], np.arange(len(ids) + 1))
        raw, texts = buf.tobytes(), []
        for k in range(len(ids)):
            words = raw[offs[k] : offs[k + 1]].split()
            own = runs[cut[k] : cut[k + 1]]
            if len(own) or k in moved:
                delta = np.zeros(len(words) + 1, np.int64)
                np.add.at(delta, own[:, 1] + own[:, 3], 1)
                np.add.at(delta, own[:, 1] + own[:, 2], -1)
                keep = np.flatnonzero(np.cumsum(delta[:-1]) == 0)
                words = [words[i] for i in (moved[k][keep] if k in moved else keep).tolist()]
            texts.append(b" ".join(words))
        fields = [pa.array(runs[:, c]) for c in (1, 2, 3)]
        held = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.StructArray.from_arrays(fields, names=["start", "length", "period"]))
        return [pa.array(ids, pa.int64()), pa.array(n), held, pa.array(texts, pa.binary()).cast(pa.string())]

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            for lo, hi, buf, offs in tx.parts(b.column(1)):
                yield pa.RecordBatch.from_arrays(some(ids[lo:hi], buf, offs), names=["doc_id", "n_words", "runs", "collapsed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, TYPE)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = periodic_runs(documents(spark, sf_dir), plant=True)
    # runs come by start and period: of equal exponents the first one stays
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda x, y: F.when(y["length"] * x["period"] > x["length"] * y["period"], y).otherwise(x))
    line = F.transform("runs", lambda x: F.concat_ws(",", x["start"].cast("string"), x["length"].cast("string"), x["period"].cast("string")))
    listed = F.concat(F.array_join(line, "\n"), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    r = r.withColumn("_b", best)
    return r.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_b.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("_b.length * 1000 DIV _b.period").alias("exponent_milli"), F.sha2(listed, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
