"""Closure of match runs as runs: no row per base, no row per matched pair of bases.

A link run (u, v, len, d) says that base u + i and base v + d * i are one, for
i < len.  Closing runs means pointing every base that has a smaller one in its
component at the smallest, again as runs.  The rounds are those of
``components`` (large star: a parent gives way to its own smallest parent; small
star: a base's other parents go to its smallest), but a round's links stay run-length coded: a run is cut where another
one of the same bases begins, ends or wins, the cuts travel along the links as the rounds go, and pieces that still
say the same stay or grow together, so their number follows the borders of the runs and not the bases.

Runs meet in blocks of ``WIDTH`` positions.  The smallest parents of a block are
an array while they are worked out and runs when they are written or sent:
first within each partition, then over all (the array's minimum is associative, so a block that many
runs cross is aggregated before it is shuffled).  Links and parents meet by block, a few thousand links to
the row, blocks with many rows by ``split_join``: deep or repetitive places stay spread over
all tasks.  Links of ``LOCAL_BASES`` bases at most, proved by the sum seen while they were written, are closed in one task.

Before the first round partitions hold links of neighbouring bases, and components that lie where no other partition's
links reach are done (``reached``): rounds follow the bases that meet across partitions, not all of them.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftgraph.operators.components import smallest_of_part
from weftgraph.operators.intervals import asof_join
from weftgraph.operators.rank import carried, neighbours, running_sum
from weftgraph.operators.sequences import BLOCK
from weftgraph.plans.work import drop, observed, split_join, table

WIDTH = BLOCK
#: Bases that one task may close, or that a partition joins at a time; links and bases of one row.
LOCAL_BASES, LOT_BASES, ROW_LINKS, ROW_BASES = 1 << 21, 1 << 20, 2048, 1 << 17
#: Positions of which one counts as reached by a partition if another does.
ZONE = 1 << 10
LINKS = "u bigint, v bigint, len bigint, d bigint"
_NAMES = ("u", "v", "len", "d")
_NONE = np.iinfo(np.int64).max


def spread(u: np.ndarray, v: np.ndarray, n: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Link runs to pairs of bases."""
    i = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    return np.repeat(u, n) + i, np.repeat(v, n) + np.repeat(d, n) * i


def gathered(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs to link runs: neighbours that go on by one on both sides, in one direction."""
    if not len(a):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    step = np.where(np.diff(a) == 1, np.diff(b), 0)
    step[np.abs(step) > 1] = 0
    turn = step[1:] != step[:-1]
    new = np.append(True, step == 0)
    new[2:] |= turn & (step[:-1] != 0)
    at = np.flatnonzero(new)
    n = np.diff(np.append(at, len(a)))
    d = np.ones(len(at), np.int64)
    d[n > 1] = step[at[n > 1]]
    return a[at], b[at], n, d


def _arrays(batch: pa.RecordBatch, names: tuple[str, ...] = _NAMES) -> list[np.ndarray]:
    return [batch.column(c).to_numpy(zero_copy_only=False) for c in names]


def _batch(links, **more: np.ndarray) -> pa.RecordBatch:
    cols = dict(zip(_NAMES, links, strict=True)) | more
    return pa.RecordBatch.from_arrays([pa.array(c) for c in cols.values()], names=list(cols))


def _slices(n: np.ndarray, most: int):
    """Ranges of runs of about ``most`` bases together."""
    ends, lo = np.cumsum(n), 0
    while lo < len(n):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, side="right")))
        yield lo, hi
        lo = hi


def link_forests(links: DataFrame, lot: int = LOT_BASES) -> DataFrame:
    """Each partition's links as runs from bases to the smallest of their part; ``piece``: what was joined together."""

    def run(batches):
        a = b = np.zeros(0, np.int64)
        new, size = [], 0
        piece = TaskContext.get().partitionId() << 32

        def joined():
            nodes, low = smallest_of_part(np.concatenate([a, *[x for x, _ in new]]), np.concatenate([b, *[y for _, y in new]]))
            keep = nodes != low
            return nodes[keep], low[keep]

        def out(piece: int):
            cols = gathered(a, b)
            return _batch(cols, piece=np.full(len(cols[0]), piece))

        for batch in batches:
            cols = _arrays(batch)
            for lo, hi in _slices(cols[2], lot):
                new.append(spread(*[c[lo:hi] for c in cols]))
                size += len(new[-1][0])
                if size >= lot:
                    a, b = joined()
                    new, size = [], 0
                    if len(a) > 4 * lot:
                        yield out(piece)
                        piece += 1
                        a = b = np.zeros(0, np.int64)
        if new:
            a, b = joined()
        yield out(piece)

    return links.select(*_NAMES).mapInArrow(run, f"{LINKS}, piece bigint")


def reached(forest: DataFrame, zone: int = ZONE) -> DataFrame:
    """The pieces of ``link_forests`` with ``open``: whether a base of the component lies in a zone that several pieces link.

    A component that is not open is whole in its piece.  A task holds one piece at a time, a few ``LOT_BASES``.
    """
    none, zero = (F.lit(x).cast("long") for x in (-1, 0))
    low = F.least("v", F.col("v") + F.col("d") * (F.col("len") - 1))
    zones = lambda at: F.sequence(F.floor(at / zone), F.floor((at + F.col("len") - 1) / zone))
    touched = forest.select("piece", F.explode(F.array_union(zones(F.col("u")), zones(low))).alias("zone")).distinct()
    shared = touched.groupBy("zone").agg(F.count("*").alias("c")).where("c > 1").select("zone")
    marks = touched.join(shared, "zone").select("piece", F.col("zone").alias("u"), none.alias("v"), zero.alias("len"), zero.alias("d"))
    rows = forest.select("piece", *_NAMES).unionByName(marks).repartition("piece").sortWithinPartitions("piece", "len")

    def run(batches):
        own, held = None, []

        def out():
            u, v, n, d = (np.concatenate(x) for x in zip(*held, strict=True))
            some = n > 0
            marked = np.sort(u[~some])
            child, parent = spread(u[some], v[some], n[some], d[some])
            o = np.argsort(child)
            child, parent = child[o], parent[o]
            roots, at = np.unique(parent, return_inverse=True)
            met = np.isin(roots // zone, marked)
            met[at[np.isin(child // zone, marked)]] = True
            for is_open in (False, True):
                own_ = met[at] == is_open
                cols = gathered(child[own_], parent[own_])
                yield _batch(cols, open=np.full(len(cols[0]), is_open))

        for b in batches:
            cols, piece = _arrays(b), b.column("piece").to_numpy()
            for lo, hi in groups(piece) if len(piece) else ():
                if own != int(piece[lo]):
                    if held:
                        yield from out()
                    own, held = int(piece[lo]), []
                held.append([c[lo:hi] for c in cols])
        if held:
            yield from out()

    return rows.mapInArrow(run, f"{LINKS}, open boolean")


def _clipped(links: DataFrame, side: str, width: int) -> DataFrame:
    """Links cut where ``side`` enters another block, with its number."""
    back = (F.col("d") < 0) if side == "v" else F.lit(False)
    lo = F.when(back, F.col("v") - F.col("len") + 1).otherwise(F.col(side))
    x = links.withColumn("_lo", lo).withColumn("_hi", F.col("_lo") + F.col("len") - 1)
    x = x.select("*", F.explode(F.sequence(F.floor(F.col("_lo") / width), F.floor(F.col("_hi") / width))).alias("block"))
    x = x.withColumn("_a", F.greatest("_lo", F.col("block") * width)).withColumn("_z", F.least("_hi", F.col("block") * width + width - 1))
    x = x.withColumn("_i", F.when(back, F.col("v") - F.col("_z")).otherwise(F.col("_a") - F.col(side)))
    return x.select("block", (F.col("u") + F.col("_i")).alias("u"), (F.col("v") + F.col("d") * F.col("_i")).alias("v"), (F.col("_z") - F.col("_a") + 1).alias("len"), "d")


def groups(block: np.ndarray):
    at = np.flatnonzero(np.append(True, block[1:] != block[:-1]))
    return zip(at.tolist(), [*at[1:].tolist(), len(block)], strict=True)


def _parents(links: DataFrame, width: int) -> DataFrame:
    """(block, parents): the smallest parent of every base, as runs in an array."""

    def least(packed: bool):
        def run(batches):
            own, held = None, None

            def out():
                at = np.flatnonzero(held < _NONE)
                cols = gathered(at + own * width, held[at])
                if not packed:
                    return _batch(cols, block=np.full(len(cols[0]), own))
                row = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=list(_NAMES))
                one = pa.ListArray.from_arrays(pa.array([0, len(row)], pa.int32()), row)
                return pa.RecordBatch.from_arrays([pa.array([own], pa.int64()), one], names=["block", "parents"])

            for b in batches:
                cols, block = _arrays(b), b.column("block").to_numpy()
                for lo, hi in groups(block) if len(block) else ():
                    if own != int(block[lo]):
                        if own is not None:
                            yield out()
                        own, held = int(block[lo]), np.full(width, _NONE)
                    part = [c[lo:hi] for c in cols]
                    for i, j in _slices(part[2], LOT_BASES):
                        x, y = spread(*[c[i:j] for c in part])
                        np.minimum.at(held, x - own * width, y)
            if own is not None:
                yield out()

        return run

    some = _clipped(links, "u", width).sortWithinPartitions("block").mapInArrow(least(False), f"{LINKS}, block bigint")
    every = some.repartition("block").sortWithinPartitions("block")
    return every.mapInArrow(least(True), f"block bigint, parents array<struct<{LINKS.replace(' ', ':').replace(',:', ',')}>>")


def _rows(links: DataFrame, side: str, width: int) -> DataFrame:
    """(block, links): links with ``side`` in a block, some thousands a row; a block of many links has many rows, over many partitions."""

    def run(batches):
        for b in batches:
            cols, block = _arrays(b), b.column("block").to_numpy()
            keys, ends = [], [0]
            for lo, hi in groups(block) if len(block) else ():
                for i, j in _slices(cols[2][lo:hi], ROW_BASES):
                    for k in range(lo + i, lo + j, ROW_LINKS):
                        keys.append(int(block[lo]))
                        ends.append(min(k + ROW_LINKS, lo + j))
            row = pa.StructArray.from_arrays([pa.array(c) for c in cols], names=list(_NAMES))
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), row)], names=["block", "links"])

    dealt = _clipped(links, side, width).repartitionByRange("block", "u", "v").sortWithinPartitions("block")
    return table(dealt.mapInArrow(run, f"block bigint, links array<struct<{LINKS.replace(' ', ':').replace(',:', ',')}>>"), "links")


def _star(links: DataFrame, parents: DataFrame, side: str, width: int) -> tuple[DataFrame, DataFrame]:
    """(new links, with ``moved`` bases each; their rows): ``side`` u sends other parents to the smallest one, v sends children there."""
    rows = _rows(links, side, width)
    many = rows.groupBy("block").agg(F.count("*").alias("c"))
    lookup = table(many.join(parents, "block", "left"), "parents")

    def run(batches):
        for b in batches:
            for k in range(b.num_rows):
                own = b.column("block")[k].as_py()
                held = np.full(width, _NONE)
                if (p := b.column("parents")[k]).is_valid:
                    x, y = spread(*[c.to_numpy() for c in p.values.flatten()])
                    held[x - own * width] = y
                child, parent = spread(*[c.to_numpy() for c in b.column("links")[k].values.flatten()])
                if side == "u":
                    low = held[child - own * width]
                    other = parent != low
                    child, low = parent[other], low[other]
                    moved = np.ones(len(low), bool)
                else:
                    low = held[parent - own * width]
                    moved = low < _NONE
                    low = np.where(moved, low, parent)
                cols = gathered(child, low)
                changed = np.add.reduceat(moved.astype(np.int64), np.cumsum(cols[2]) - cols[2]) if len(low) else np.zeros(0, np.int64)
                yield _batch(cols, moved=changed)

    both = split_join(rows, lookup, ["block"], parts=200)
    return both.select("block", "links", "parents").mapInArrow(run, f"{LINKS}, moved bigint"), rows


def _written(links: DataFrame, name: str) -> tuple[DataFrame, int, int]:
    """The links as a table, with the bases they link and those that moved, both seen while writing."""
    t, seen = observed(links, name, runs=F.count(F.lit(1)), bases_linked=F.sum("len"), bases_moved=F.sum("moved"))
    return t, seen["bases_linked"], seen["bases_moved"]


def grown(links: DataFrame) -> DataFrame:
    """Links of disjoint ``u`` that blocks have cut, joined where one goes on as the one before it."""
    step = F.col("d") * F.col("len")
    x = neighbours(links.withColumn("_u", F.col("u") + F.col("len")).withColumn("_v", F.col("v") + step), "u", "v", "d", "_u", "_v")
    on = lambda a, b: F.coalesce((a["_u"] == b["u"]) & (a["_v"] == b["v"]) & (a["d"] == b["d"]), F.lit(False))
    own = {c: F.col(c) for c in ("u", "v", "d", "_u", "_v")}
    x = x.withColumn("_first", ~on(F.col("_prev"), own)).withColumn("_last", ~on(own, F.col("_next"))).drop("_prev", "_next")
    ends = neighbours(x.where("_first OR _last"), "u", "_u").where("_first")
    return ends.select("u", "v", (F.when(F.col("_last"), F.col("_u")).otherwise(F.col("_next._u")) - F.col("u")).alias("len"), "d")


def close_links(links: DataFrame, width: int = WIDTH, local_bases: int = LOCAL_BASES, max_rounds: int = 60) -> DataFrame:
    """(u, v, len, d): every base that is not the smallest of its component, once, with that one."""
    now, n, _ = _written(link_forests(links).withColumn("moved", F.lit(0).cast("long")), "forest")
    done = None
    if n > local_bases:
        whole, seen = observed(reached(now), "reached", bases_open=F.sum(F.when(F.col("open"), F.col("len"))))
        drop(now)
        done, now, n = whole.where("NOT open").select(*_NAMES), whole.where("open").drop("open"), seen["bases_open"]
    for _ in range(max_rounds):
        if n <= local_bases:
            rest = link_forests(now.coalesce(1)).drop("piece")
            return table(rest.unionByName(done) if done else rest, "closed")
        parents = table(_parents(now, width), "parents")
        apart, rows = _star(now, parents, "u", width)
        least = parents.select(F.explode("parents").alias("_p")).select("_p.*", F.lit(0).cast("long").alias("moved"))
        small, _, first = _written(apart.unionByName(least), "small")
        drop(rows)
        jumped, rows = _star(small, table(_parents(small, width), "parents"), "v", width)
        before = now
        now, n, second = _written(jumped, "round")
        drop(rows, small, before)
        if not first and not second:
            rest = now.select(*_NAMES)
            return table(grown(rest.unionByName(done)), "closed")
    raise RuntimeError(f"no fixed point in {max_rounds} rounds")


def run_links(runs: DataFrame) -> DataFrame:
    """Match runs (q, t, len, is_rev) as links with ascending u; runs that say the same are taken once."""
    # a reverse run begins at its last query base: counted up the target, the query goes down
    r = runs.select(F.col("t").alias("u"), F.col("q").alias("v"), "len", F.when(F.col("is_rev"), -1).otherwise(1).cast("long").alias("d"))
    return r.repartitionByRange(*_NAMES).distinct().sortWithinPartitions("u")  # a partition has links of neighbouring bases


def close_runs(runs: DataFrame, **options) -> DataFrame:
    return close_links(run_links(runs), **options)


def _cut(closed: DataFrame, index: DataFrame) -> DataFrame:
    """Links cut where ``u`` enters another sequence, with ``seq_id``."""
    starts = index.where("seq_len > 0")
    inside = asof_join(starts.select(F.col("seq_offset").alias("p")), closed.select(F.col("u").alias("start"), "len")).where("p > start AND p < start + len")
    cuts = inside.groupBy(F.col("start").alias("u")).agg(F.array_sort(F.collect_list(F.col("p") - F.col("start"))).alias("_c"))  # no more than bases of a run
    x = closed.join(cuts, "u", "left").withColumn("_c", F.concat(F.array(F.lit(0).cast("long")), F.coalesce("_c", F.array().cast("array<bigint>"))))
    x = x.select("*", F.posexplode("_c").alias("_k", "_i")).withColumn("_n", F.coalesce(F.get("_c", F.col("_k") + 1), F.col("len")) - F.col("_i"))
    x = x.select((F.col("u") + F.col("_i")).alias("p"), (F.col("v") + F.col("d") * F.col("_i")).alias("v"), F.col("_n").alias("len"), "d")
    return asof_join(x, starts.select(F.col("seq_offset").alias("start"), "seq_id")).select("seq_id", F.col("p").alias("u"), "v", "len", "d")


def segments(closed: DataFrame, index: DataFrame) -> DataFrame:
    """(seq_id, q, len, c, s, d): all bases as segments; base q + i has the component of base c + d * i and the graph position s + d * i.

    Graph positions number the smallest bases of components in order, so such a base's
    is its place less the bases before it that have a smaller one: running sums over the gaps between closed runs.
    """
    spark = closed.sparkSession
    ends = index.agg(F.coalesce(F.max(F.col("seq_offset") + F.col("seq_len")), F.lit(0)).alias("u"))
    zero, one = (F.lit(x).cast("long") for x in (0, 1))
    marks = spark.range(1).select((-one).alias("u"), one.alias("len"), zero.alias("n")).unionByName(ends.select("u", zero.alias("len"), zero.alias("n")))
    held = table(closed.select("u", "len", F.col("len").alias("n")).unionByName(marks), "held")
    gaps = neighbours(running_sum(held, "u", "n", "_gone"), "u").select((F.col("u") + F.col("len")).alias("start"), F.col("_next.u").alias("_end"), F.col("_gone").cast("long").alias("_gone"))
    gaps = table(gaps.where("start < _end"), "gaps")
    own = _cut(gaps.select(F.col("start").alias("u"), F.col("start").alias("v"), (F.col("_end") - F.col("start")).alias("len"), one.alias("d")), index)
    every = _cut(closed, index).unionByName(own).withColumn("p", F.least("v", F.col("v") + F.col("d") * (F.col("len") - 1)))
    at = asof_join(every, gaps.select("start", "_gone"))
    return at.select("seq_id", F.col("u").alias("q"), "len", F.col("v").alias("c"), (F.col("v") - F.col("_gone")).alias("s"), "d")


def expanded(rows: DataFrame, at: str, *along: str) -> DataFrame:
    """One row per base: ``at`` goes up, the columns ``along`` go with ``d``."""
    x = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("len") - 1)).alias("_i"))
    moved = {c: F.col(c) + F.col("d") * F.col("_i") for c in along} | {at: F.col(at) + F.col("_i")}
    return x.withColumns(moved).drop("_i", "len", "d")


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


def strings(codes: np.ndarray, ends: np.ndarray | None = None) -> pa.Array:
    """Strings of code points, from each of ``ends`` to the next; without them one of one character for each."""
    ends = np.arange(len(codes) + 1, dtype=np.int32) if ends is None else ends
    if len(codes) and codes.max() > 127:
        text = "".join(map(chr, codes.tolist()))
        return pa.array([text[i:j] for i, j in zip(ends.tolist(), ends[1:].tolist(), strict=False)], pa.string())
    return pa.StringArray.from_buffers(len(ends) - 1, pa.py_buffer(ends), pa.py_buffer(codes.astype(np.uint8)))


def _flat(lists: pa.Scalar, *names: str) -> list[np.ndarray]:
    """The fields of a list of structs; none if it is null."""
    if not lists.is_valid:
        return [np.zeros(0, np.int64) for _ in names]
    return [lists.values.field(c).to_numpy() for c in names]


def placed(closed: DataFrame, index: DataFrame, block_table: DataFrame, width: int = WIDTH) -> DataFrame:
    """(q, seq_id, base, s, s_base, is_rev, head, first, last): the graph position of every base, worked out a block at a time.

    A smallest base's position is its place less the bases before it that have a smaller one; the others ask
    the block of their smallest base for it.  ``head`` marks the smallest bases, ``first`` and ``last`` the ends of
    intervals: a block learns the bases beside it from one row a block.  No block holds more than ``width`` bases, links of
    disjoint ``u`` or sequences, and questions to one block go some thousands a row.
    """
    own = _clipped(closed, "u", width).groupBy("block").agg(F.collect_list(F.struct("u", "len")).alias("gone"), F.sum("len").alias("n"))
    own = table(block_table.join(own, "block", "left"), "gone")
    before = carried(own.select(F.col("block").alias("_b"), F.coalesce("n", F.lit(0)).alias("_o")), sums=("_o",))
    own = table(own.join(before.select(F.col("_b").alias("block"), F.col("_o").cast("long").alias("before")), "block").drop("n"), "gone")
    rows = _rows(closed, "v", width)
    lookup = table(rows.groupBy("block").agg(F.count("*").alias("c")).join(own, "block"), "asked")

    def numbers(block: int, gone: pa.Scalar, before: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(whether a base has a smaller one, the position of each that has none)."""
        u, k = _flat(gone, "u", "len")
        has = np.zeros(n, np.int64)
        has[spread(u, u, k, np.ones(len(u), np.int64))[0] - block * width] = 1
        return has, block * width + np.arange(n) - before - (np.cumsum(has) - has)

    def answer(batches):
        for b in batches:
            for k in range(b.num_rows):
                at = b.column("block")[k].as_py()
                codes = _codes(b.column("text")[k].as_py())
                s = numbers(at, b.column("gone")[k], b.column("before")[k].as_py(), len(codes))[1]
                child, parent = spread(*[c.to_numpy() for c in b.column("links")[k].values.flatten()])
                o = np.argsort(child // width, kind="stable")
                child, parent = child[o], parent[o] - at * width
                cut = np.flatnonzero(np.append(True, np.diff(child // width) != 0))
                row = pa.StructArray.from_arrays([pa.array(child), pa.array(s[parent]), pa.array(codes[parent].astype(np.int32))], names=["q", "s", "b"])
                lists = pa.ListArray.from_arrays(pa.array(np.append(cut, len(child)), pa.int32()), row)
                yield pa.RecordBatch.from_arrays([pa.array(child[cut] // width), lists], names=["block", "told"])

    told = split_join(rows, lookup, ["block"], parts=200).select("block", "links", "text", "gone", "before")
    told = told.mapInArrow(answer, "block bigint, told array<struct<q:bigint,s:bigint,b:int>>")
    told = told.groupBy("block").agg(F.flatten(F.collect_list("told")).alias("told"))
    ends = F.sequence(F.floor(F.col("seq_offset") / width), F.floor((F.col("seq_offset") + F.col("seq_len") - 1) / width))
    seqs = index.where("seq_len > 0").select(F.explode(ends).alias("block"), F.struct("seq_offset", "seq_id").alias("_s"))
    seqs = seqs.groupBy("block").agg(F.array_sort(F.collect_list("_s")).alias("seqs"))

    def fill(batches):
        for b in batches:
            for k in range(b.num_rows):
                at = b.column("block")[k].as_py()
                codes = _codes(b.column("text")[k].as_py())
                has, s = numbers(at, b.column("gone")[k], b.column("before")[k].as_py(), len(codes))
                spelled = codes.astype(np.int32)
                q, x, base = _flat(b.column("told")[k], "q", "s", "b")
                s[q - at * width], spelled[q - at * width] = x, base
                start, name = _flat(b.column("seqs")[k], "seq_offset", "seq_id")
                seq = name[np.searchsorted(start, at * width + np.arange(len(codes)), side="right") - 1]
                cols = {"seq_id": seq, "s": s, "base": codes.astype(np.int32), "s_base": spelled, "gone": has.astype(np.int8)}
                ends = {f"{c}_{i}": cols[c][[j]] for i, j in ((0, 0), (1, -1)) for c in ("seq_id", "s")} | {f"rev_{i}": (codes != spelled)[[j]] for i, j in ((0, 0), (1, -1))}
                lists = [pa.ListArray.from_arrays(pa.array([0, len(codes)], pa.int32()), pa.array(c)) for c in cols.values()]
                yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), *lists, *[pa.array(c) for c in ends.values()]], names=["block", *cols, *ends])

    arrays = "block bigint, seq_id array<bigint>, s array<bigint>, base array<int>, s_base array<int>, gone array<tinyint>"
    filled = own.join(told, "block", "left").join(seqs, "block").select("block", "text", "gone", "before", "told", "seqs").mapInArrow(fill, f"{arrays}, seq_id_0 bigint, s_0 bigint, seq_id_1 bigint, s_1 bigint, rev_0 boolean, rev_1 boolean")
    filled = table(filled, "filled")
    beside = lambda i, by, name: filled.select((F.col("block") + by).alias("block"), F.struct(F.col(f"seq_id_{i}").alias("seq_id"), F.col(f"s_{i}").alias("s"), F.col(f"rev_{i}").alias("rev")).alias(name))
    filled = filled.join(beside(1, 1, "prev"), "block", "left").join(beside(0, -1, "next"), "block", "left")

    def out(batches):
        for b in batches:
            for k in range(b.num_rows):
                at = b.column("block")[k].as_py()
                seq, s, base, spelled, gone = (b.column(c)[k].values.to_numpy() for c in ("seq_id", "s", "base", "s_base", "gone"))
                rev = base != spelled
                prev, after = (b.column(c)[k].as_py() for c in ("prev", "next"))
                on = np.zeros(len(s) + 1, bool)  # whether base i goes on as the one before it
                on[1:-1] = (seq[1:] == seq[:-1]) & (rev[1:] == rev[:-1]) & (np.diff(s) == np.where(rev[1:], -1, 1))
                if prev:
                    on[0] = prev["seq_id"] == seq[0] and prev["rev"] == rev[0] and s[0] - prev["s"] == (-1 if rev[0] else 1)
                if after:
                    on[-1] = after["seq_id"] == seq[-1] and after["rev"] == rev[-1] and after["s"] - s[-1] == (-1 if rev[-1] else 1)
                cols = [pa.array(at * width + np.arange(len(s))), pa.array(seq), strings(base), pa.array(s), strings(spelled), pa.array(rev), pa.array(gone == 0), pa.array(~on[:-1]), pa.array(~on[1:])]
                yield pa.RecordBatch.from_arrays(cols, names=["q", "seq_id", "base", "s", "s_base", "is_rev", "head", "first", "last"])

    cols = "q bigint, seq_id bigint, base string, s bigint, s_base string, is_rev boolean, head boolean, first boolean, last boolean"
    return filled.select("block", "seq_id", "s", "base", "s_base", "gone", "prev", "next").mapInArrow(out, cols)
