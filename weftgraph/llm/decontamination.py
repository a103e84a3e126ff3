"""Operator 3: benchmark decontamination by template canonicalisation.

Words are stripped of outer punctuation and lower-cased (A-Z); then numbers, units
after a number and capitalised words become typed placeholders, so a question keeps
its template when its figures and names are changed.  A capitalised word that opens
a row, a sentence or a line may be a name or not: windows are hashed in both
readings, one of which doesn't depend on layout.  Windows of ``WINDOW`` template
words are hashed and hash-joined with the benchmark's; a reading of fewer than
``MIN_LITERALS`` words that are no placeholders is replaced by the exact words.

Matches of a document and an item at one distance (place in the document minus
place in the item) form a diagonal; its slots must be consistent: each benchmark
value stands for one document value, and each document name for one benchmark name
(share of values that do: ``CONSISTENT``; two numbers may become one).
A diagonal counts with both readings, or else with the second alone.
A document is contaminated by an item if windows on consistent diagonals cover
``COVERAGE`` of the item's windows, or of those with ``MIN_LITERALS`` such words.  An item of fewer than ``WINDOW`` words is one
window of its own length; items under ``MIN_WORDS`` words match nothing.

The benchmark side is a fixed-size list: up to ``FILTER`` windows its hashes go
to the tasks and other windows stay there; a larger one is joined by shuffle.  In a periodic
stretch of a document (period up to a window's length) only the first period's windows
are kept: they meet the same places of an item, so matches never grow with place times place.

Nulls: null texts are empty and match nothing; a null id is kept as null.  Items
with a null id match under null.  Documents equal in id and text give one row per
item.  Ties: items with equal text match each; of several diagonals the one with the fewest changed
values is reported.  Empty tables: no rows, and all documents are kept.
Texts of any length are handled whole; other columns pass by, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import bounded, documents, packed, table

WINDOW = 8
MIN_WORDS = 5
MIN_LITERALS = 3
COVERAGE = 0.5
CONSISTENT = 0.8
FILTER = 2_000_000
#: Units that stand after a number.
UNITS = (
    "mm cm m km in inch inches ft feet foot yd yards mile miles mg g kg lb lbs pound pounds oz ton tons ml l liter liters litre litres gallon gallons "
    "s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years "
    "dollar dollars cent cents euro euros usd eur percent degrees kb mb gb tb hz khz mhz ghz w kw v mph kmh"
).split()
_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?:;"]] = True
NUMBER, NAME, UNIT = (np.uint64(x) for x in (0x1111111111111111, 0x2222222222222222, 0x3333333333333333))
#: Kinds of slots, in the lowest two bits of a slot's value hash.
IS_NUMBER, IS_NAME, IS_UNIT = 1, 2, 3


def _hash_words(words: list[str]) -> np.ndarray:
    data = " ".join(words).encode()
    buf = np.frombuffer(data, np.uint8)
    s, e, _ = tx.words(buf, np.array([0, len(buf)]))
    return np.sort(tx.span_hash(buf, s, e))


_UNIT_HASHES = _hash_words(list(UNITS))


def _member(x: np.ndarray, table_: np.ndarray) -> np.ndarray:
    if not len(table_):
        return np.zeros(len(x), bool)
    i = np.searchsorted(table_, x)
    return table_[np.minimum(i, len(table_) - 1)] == x


def canonical(buf: np.ndarray, offs: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray, np.ndarray]:
    """((template hash, kind of slot or 0) by reading: words that open a sentence or line are names, are none), value hash and row of every word."""
    s, e, row = tx.words(buf, offs)
    if not len(s):
        return [(np.zeros(0, np.uint64), np.zeros(0, np.uint8))] * 2, np.zeros(0, np.uint64), row
    low = _LOWER[buf]
    place = np.flatnonzero(_ALNUM[buf])
    a = np.searchsorted(place, s)
    z = np.searchsorted(place, e)
    some = z > a
    place = np.append(place, 0)
    cs, ce = np.where(some, place[np.minimum(a, len(place) - 1)], s), np.where(some, place[z - 1] + 1, e)
    h = tx.span_hash(low, cs, ce)
    first = buf[cs]
    number = (first >= 48) & (first <= 57)
    second = buf[np.minimum(cs + 1, len(buf) - 1)]
    upper = (first >= 65) & (first <= 90) | (first == 0xC3) & (second >= 0x80) & (second <= 0x9E)
    after = buf[np.minimum(cs + 1 + (first == 0xC3), len(buf) - 1)]
    upper &= (ce - cs > 1) & ~((after >= 65) & (after <= 90))
    inside = np.zeros(len(s), bool)
    lines = np.concatenate(([0], np.cumsum(buf == 10)))
    inside[1:] = (row[1:] == row[:-1]) & ~_STOP[buf[e[:-1] - 1]] & (lines[s[1:]] == lines[e[:-1]])
    unit = np.zeros(len(s), bool)
    unit[1:] = number[:-1] & (row[1:] == row[:-1]) & ~number[1:] & _member(h[1:], _UNIT_HASHES)
    out = []
    for name in (upper & ~number & ~unit, upper & inside & ~number & ~unit):
        t = h.copy()
        t[number], t[name], t[unit] = NUMBER, NAME, UNIT
        out.append((t, (number * IS_NUMBER + name * IS_NAME + unit * IS_UNIT).astype(np.uint8)))
    return out, h, row


EXACT = np.uint64(0x4444444444444444)
_TYPE = "id bigint, h bigint, pos int, total int, rich int, is_rich boolean, wide boolean, w bigint, slots array<bigint>"


def _windows(lengths: dict[int, np.ndarray | None], whole: bool):
    """Windows of each length; with a hash table only those in it.  ``whole``: benchmark side, each item at its own length."""

    def run(batches):
        for b in batches:
            ids, hs = b.column(0), b.column(1)
            for lo, _, buf, offs in tx.parts(b.column(2)):
                (wide, narrow), v, row = canonical(buf, offs)
                count = np.bincount(row, minlength=len(offs) - 1)
                first = np.cumsum(count) - count
                literal = [np.concatenate(([0], np.cumsum(slot == 0))) for _, slot in (wide, narrow)]
                for n, wanted in lengths.items():
                    if len(v) < n:
                        continue
                    m = len(v) - n + 1
                    ok = row[:m] == row[n - 1 :]
                    if whole:
                        ok &= (count[row[:m]] == n) if n < WINDOW else (count[row[:m]] >= n)
                    much = [x[n:] - x[:-n] >= MIN_LITERALS for x in literal]
                    rich = np.bincount(row[:m], weights=ok & much[1], minlength=len(count)).astype(np.int32)
                    by = [tx.gram_hash(t, n) + np.uint64(n) for t, _ in (wide, narrow)]
                    exact = tx.mix(tx.gram_hash(v, n) + np.uint64(n) ^ EXACT)
                    # narrow reading, wide reading where it differs, exact words where the wide one has few literals
                    if not whole:
                        again = np.zeros(m, bool)
                        for k in range(1, min(n, m - 1) + 1):
                            again[k:] |= (exact[k:] == exact[:-k]) & (by[1][k:] == by[1][:-k]) & (row[k:m] == row[: m - k])
                        ok &= ~again
                    kinds = [(by[1], much[1], narrow[1], False), (by[0], much[0] & (by[0] != by[1]), wide[1], True), (exact, ~much[0], wide[1], True)]
                    for w, use, slot, is_wide in kinds:
                        use = ok & use
                        if wanted is not None:
                            use &= _member(w, wanted)
                        i = np.flatnonzero(use)
                        if not len(i):
                            continue
                        r = row[i]
                        slots = [(v[x : x + n] & ~np.uint64(3) | slot[x : x + n])[slot[x : x + n] > 0].view(np.int64) for x in i.tolist()]
                        cols = [ids.take(pa.array(r + lo)), hs.take(pa.array(r + lo)), pa.array((i - first[r]).astype(np.int32)), pa.array((count[r] - n + 1).astype(np.int32)), pa.array(rich[r])]
                        cols += [pa.array(much[1][i]), pa.array(np.full(len(i), is_wide)), pa.array(w[i].view(np.int64)), pa.array(slots, pa.list_(pa.int64()))]
                        yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "pos", "total", "rich", "is_rich", "wide", "w", "slots"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, filter_rows: int = FILTER) -> DataFrame:
    """Rows (id, h, item, matched, share, changed): documents (id and text hash) with an item of the benchmark."""
    items = benchmark.select(F.col("item_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text")).dropDuplicates(["id", "h"])
    lengths = dict.fromkeys(range(MIN_WORDS, WINDOW + 1))
    bench = table(items.mapInArrow(_windows(lengths, True), _TYPE), "bench")
    small = bench.limit(filter_rows + 1).count() <= filter_rows
    if small:
        got = bench.select("w").toArrow()
        w = np.unique(got["w"].to_numpy().view(np.uint64))
        # one table serves all lengths (the length is part of the hash); lengths that no item has are left out
        have = {r[0] for r in items.select(F.least(F.size(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))), F.lit(WINDOW))).distinct().collect()}
        lengths = {n: w for n in lengths if n in have}
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text"))
    wins = keyed.mapInArrow(_windows(lengths, False), _TYPE)
    of_item = ["total", "rich", "is_rich", F.col("wide").alias("bwide"), "w", F.col("slots").alias("bslots")]
    b = bounded(bench.select(F.col("id").alias("item"), F.col("h").alias("ih"), F.col("pos").alias("bpos"), *of_item), 200_000)
    hit = wins.drop("total", "rich", "is_rich").join(b, "w").withColumn("gap", F.col("pos") - F.col("bpos"))
    narrow = ~F.col("wide") & ~F.col("bwide")
    place, zipped = F.struct("bpos", "is_rich"), F.arrays_zip("bslots", "slots")

    def pairs(of: Column) -> Column:
        return F.array_distinct(F.flatten(F.collect_list(of)))

    def consistent_(p: str) -> Column:
        names = F.filter(p, lambda x: x["bslots"].bitwiseAND(F.lit(3)) == IS_NAME)
        forth = F.size(F.array_distinct(F.transform(p, lambda x: x["bslots"]))) >= consistent * F.size(p)
        back = F.size(F.array_distinct(F.transform(names, lambda x: x["slots"]))) >= consistent * F.size(names)
        return forth & back

    key = ["id", "h", "item", "ih", "total", "rich"]
    diag = hit.groupBy(*key, "gap").agg(F.collect_set(place).alias("at"), pairs(zipped).alias("p"), F.collect_set(F.when(narrow, place)).alias("at1"), pairs(F.when(narrow, zipped)).alias("p1"))
    both = consistent_("p")
    diag = diag.where(both | consistent_("p1") & (F.size("at1") > 0))
    diag = diag.select(*key, F.when(both, F.col("at")).otherwise(F.col("at1")).alias("at"), F.when(both, F.col("p")).otherwise(F.col("p1")).alias("p"))
    changed = F.size(F.filter("p", lambda x: x["bslots"] != x["slots"]))
    per = diag.groupBy(*key).agg(F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.min(changed).alias("changed"))
    rich = F.size(F.filter("at", lambda x: x["is_rich"]))
    share = F.greatest(F.size("at") / F.col("total"), F.when(F.col("rich") > 0, rich / F.col("rich")))
    per = per.withColumn("matched", F.size("at")).withColumn("share", share).where(F.col("share") >= coverage)
    return per.groupBy("id", "h", "item").agg(F.max("matched").alias("matched"), F.max("share").alias("share"), F.min("changed").alias("changed"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` without a benchmark item, columns unchanged."""
    bad = table(contaminated(docs, benchmark, **options).select(F.col("id").alias("_i"), F.col("h").alias("_h")).distinct(), "contaminated")
    own = packed(docs, _i2=F.col("_row.doc_id").cast("long"), _h2=F.xxhash64("_row.text"))
    on = F.col("_i2").eqNullSafe(F.col("_i")) & (F.col("_h2") == F.col("_h"))
    return own.join(bounded(bad, 200_000), on, "left_anti").select("_row.*")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contaminated(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(F.col("id").alias("doc_id"), F.col("item").alias("item_id"), F.col("matched").cast("long").alias("n_windows"), F.col("share").alias("coverage"), F.col("changed").cast("long").alias("n_changed"))
