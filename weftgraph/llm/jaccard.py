"""Operator 8: n-gram Jaccard join by a MinHash LSH forest.

A document's set is its runs of ``N`` words (a text of 1 to N - 1 words is one
run; one without words has no set and links to nothing).  Two documents link if
the Jaccard similarity of their sets is ``THRESHOLD`` or more.

Forest: ``TREES`` prefix tries, each over ``LEVELS`` MinHash values of a set.  Rows of a
trie are sorted by prefix, so a task sees a node at the shortest depth with its
children in order, and matches from the full length on: at each depth the sets of a
node are compared with those of its other children, then the prefix is
shortened.  A set takes part at a depth only while a link of it may still be missing:
it stops where the tries, at this depth, find a pair of the smallest similarity that a link of a
set of its size can have (``stop_depths``) with probability ``RECALL``; nodes without
a second child have nothing new and are passed.  A pair met in a node is a candidate
if sizes allow the threshold and ``SKETCH`` one-bit MinHash values don't contradict it (by
``SIGMAS`` standard deviations), so documents that share boilerplate only don't chain.
A node gives the spanning forest of its candidates, never pairs; nodes over ``BLOCK`` sets are dealt as
pairs of blocks.

Verification: components of candidates bring their sets once and every pair inside
is counted exactly: the sizes of all intersections of two blocks of sets are a product
of two 0/1 matrices over the runs that occur more than once, compared with the threshold
in integers.  Verified links give counts and a spanning forest per block pair; components of these are the classes.

Equal sets are collapsed before everything (a group of copies is one node with a
weight).  Runs are compared by 64-bit hashes, sets by 128 bits.

Nulls: a null text is empty; a null id stays null and never names a class unless
the class has no other.  Repeated rows link as copies.  Ties: a class is named by
its smallest id.  Empty table: no rows.  Long texts are handled whole.  Other columns pass by.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import documents, drop, packed, settle, split_join, table
from weftgraph.operators.components import connected_components

N = 5
THRESHOLD = (4, 5)
TREES, LEVELS = 24, 6
RECALL = 0.99999
BLOCK = 1500
SKETCH, SIGMAS = 128, 6.5
_SIG = "id bigint, h bigint, k1 bigint, k2 bigint, size int, x1 bigint, x2 bigint, sig array<bigint>"


def depth_for(similarity: float, trees: int, levels: int, recall: float) -> int:
    """The longest prefix at which the tries find a pair of this similarity with probability ``recall``."""
    d = levels
    while d > 1 and 1 - (1 - similarity**d) ** trees < recall:
        d -= 1
    return d


def stop_depths(threshold: tuple[int, int], trees: int, levels: int, recall: float, sizes: int = 256) -> np.ndarray:
    """For each set size up to ``sizes`` (which stands for all larger ones) the depth at which it stops; levels + 1: it can link to no other set."""
    p, q = threshold
    out = np.full(sizes + 1, levels + 1, np.int64)
    for n in range(1, sizes):
        best = 2.0
        for k in range(max(1, -(-n * p // q)), n + 1):  # k shared runs, a union of at most k * q / p
            union = k * q // p
            if union > max(n, k) or (union == n and k < n):
                best = min(best, k / union)
        if best < 2.0:
            out[n] = depth_for(best, trees, levels, recall)
    out[sizes] = depth_for(p / q, trees, levels, recall)
    return out


def run_sets(buf: np.ndarray, offs: np.ndarray, n: int = N):
    """(row, sorted distinct run hashes) as two flat arrays sorted by row, then hash."""
    s, e, row = tx.words(buf, offs)
    rows = len(offs) - 1
    if not len(s):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    h = tx.span_hash(buf, s, e)
    count = np.bincount(row, minlength=rows)
    grams = tx.gram_hash(h, n)
    ok = np.flatnonzero(row[: len(grams)] == row[n - 1 :]) if len(grams) else np.zeros(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < n))
    first = np.cumsum(count) - count
    small = [tx.mix(np.array([int(np.bitwise_xor.reduce(tx.mix(h[first[r] : first[r] + count[r]] * np.uint64(3) + np.arange(count[r], dtype=np.uint64))))], np.uint64))[0] for r in short]
    r = np.concatenate((row[ok], short))
    g = np.concatenate((grams[ok], np.array(small, np.uint64)))
    o = np.lexsort((g, r))
    r, g = r[o], g[o]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (g[1:] != g[:-1])
    return r[new], g[new]


def _permutations(k: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(11)
    return r.integers(1, 2**63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, k, dtype=np.uint64)


def _signatures(n: int, trees: int, levels: int, low: int):
    """Per document: set key, size, sketch, and per tree the hash of its prefix of ``low`` values and the values below it (one byte each)."""
    mul, add = _permutations(trees * levels)

    def run(batches):
        for b in batches:
            ids, hs = b.column(0), b.column(1)
            for lo, hi, buf, offs in tx.parts(b.column(2)):
                r, g = run_sets(buf, offs, n)
                rows = hi - lo
                size = np.bincount(r, minlength=rows).astype(np.int32)
                has = np.flatnonzero(size)
                start = (np.cumsum(size) - size)[has]
                keys = np.zeros((2, rows), np.int64)
                for i, s in zip(has.tolist(), start.tolist(), strict=True):
                    keys[:, i] = np.frombuffer(hashlib.blake2b(g[s : s + size[i]], digest_size=16).digest(), "<i8")
                sig = np.zeros((rows, trees, 2), np.uint64)
                bits = np.zeros((rows, SKETCH), np.uint8)
                if len(has):
                    for t in range(trees):
                        acc, below = np.full(len(has), t + 1, np.uint64), np.zeros(len(has), np.uint64)
                        for d in range(levels):
                            x = g * mul[t * levels + d] + add[t * levels + d]
                            x ^= x >> np.uint64(32)
                            v = tx.mix(np.minimum.reduceat(x, start))
                            if d < low:
                                acc = tx.mix(acc * np.uint64(31) + v)
                            else:
                                below = below << np.uint64(16) | v >> np.uint64(48)
                            if t * levels + d < SKETCH:
                                bits[has, t * levels + d] = v.astype(np.uint8) & 1
                        sig[has, t, 0], sig[has, t, 1] = acc, below
                sketch = np.packbits(bits, axis=1).view(np.int64)
                k = [pa.array(x, mask=size == 0) for x in keys]
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, 2 * rows * trees + 1, 2 * trees, dtype=np.int32)), pa.array(sig.ravel().view(np.int64)))
                cols = [ids.slice(lo, rows), hs.slice(lo, rows), *k, pa.array(size), *[pa.array(np.ascontiguousarray(sketch[:, i])) for i in range(2)], flat]
                yield pa.RecordBatch.from_arrays(cols, names=["id", "h", "k1", "k2", "size", "x1", "x2", "sig"])

    return run


def _spread(label: np.ndarray, link: np.ndarray) -> np.ndarray:
    """Smallest labels over the links of a symmetric matrix, to a fixed point."""
    label, k = label.astype(np.int32), np.int32(len(label))
    while True:
        low = np.where(link, label[None, :], k).min(axis=1, initial=k)
        new = np.minimum(label, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def climb(below: np.ndarray, size: np.ndarray, sketch: np.ndarray, side: np.ndarray, stop: np.ndarray, low: int, threshold: tuple[int, int], compared: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(label, depth of last comparison) of the sets of one node of depth ``low``, matched at full length first.

    ``below``: the values under the node, columns by depth; ``stop``: depth at which each set stops;
    ``side``: as in ``verify``.  Equal labels are candidates of each other, directly or by others.
    ``compared`` takes the number of comparisons of each node and depth.
    """
    m, extra = below.shape
    p, q = threshold
    least = p / q - SIGMAS * math.sqrt((1 - (p / q) ** 2) / SKETCH)
    most = int((1 - least) / 2 * SKETCH)
    label, depth = np.arange(m), np.full(m, low + extra + 1)
    done = np.zeros((m, 0), np.int64)
    for d in range(low + extra, low - 1, -1):
        at = np.flatnonzero(stop <= d)  # the others have reached the target recall
        if len(at) < 2:
            continue
        node = np.unique(below[at, : d - low], axis=0, return_inverse=True)[1].ravel() if d > low else np.zeros(len(at), np.int64)
        child = done[at, 0] if done.shape[1] else np.arange(len(at))
        new = np.full((m, 1), -1, np.int64)
        new[at, 0] = node
        order = np.argsort(node, kind="stable")
        for g in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
            kids = child[g]
            if len(g) < 2 or (kids >= 0).all() and (kids == kids[0]).all() and d < low + extra:
                continue  # nothing new under this prefix
            i = at[g]
            # sets that a longer prefix has brought together are not compared again: all but the largest class of the node meet the node
            classes_, members = np.unique(label[i], return_inverse=True)
            if len(classes_) == 1:
                continue
            depth[i] = d
            rest = np.flatnonzero(members != np.bincount(members).argmax())
            if compared is not None:
                compared.append(len(rest) * len(i))
            x = sum(np.bitwise_count(w[rest, None] ^ w[None, :]) for w in sketch[i].T)
            a, b = size[i][rest, None].astype(np.int64), size[i][None, :].astype(np.int64)
            half = (x <= most) & (q * np.minimum(a, b) >= p * np.maximum(a, b))
            if side.any():
                half &= side[i][rest, None] != side[i][None, :]
            near = np.zeros((len(i), len(i)), bool)
            near[rest] = half
            near[:, rest] |= half.T
            names, own = np.unique(label[i], return_inverse=True)  # labels of the node, smallest first
            got = _spread(np.arange(len(names)), _merged(near, own, len(names)))
            moved = names[got]
            table_ = np.arange(m)
            table_[names] = moved
            label = table_[label]
        done = new
    return label, depth


def _merged(near: np.ndarray, own: np.ndarray, n: int) -> np.ndarray:
    """Links between labels that have linked members."""
    if n == len(own):
        o = np.argsort(own)
        return near[np.ix_(o, o)]
    out = np.zeros((n, n), bool)
    x, y = np.nonzero(near)
    out[own[x], own[y]] = True
    return out


def _tries(low: int, levels: int, stop: np.ndarray, threshold: tuple[int, int]):
    """Rows (u, v): spanning forests of the candidates of each node (rows sorted by node, then by the values under it)."""

    def solve(rows: list) -> pa.RecordBatch | None:
        node, size, x1, x2, below, side = (np.array([r[i] for r in rows], np.int64) for i in range(1, 7))
        shifts = np.arange(levels - low - 1, -1, -1, dtype=np.int64) * 16
        values = below[:, None] >> shifts & 0xFFFF
        label, _ = climb(values, size, np.stack((x1, x2), axis=1).view(np.uint64), side, stop[np.minimum(size, len(stop) - 1)], low, threshold)
        hit = np.flatnonzero(label != np.arange(len(rows)))
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(node[label[hit]])], names=["u", "v"])

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield solve(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield solve(held)
        tx.release()

    return run


def _sets(n: int):
    """Rows (task, node, m, size, set) of the wanted documents, once for each task of theirs."""

    def run(batches):
        for b in batches:
            tasks, node, m = b.column(1).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            for lo, hi, buf, offs in tx.parts(b.column(0)):
                r, g = run_sets(buf, offs, n)
                cut = np.searchsorted(r, np.arange(hi - lo + 1))
                out = [[] for _ in range(4)]
                for i in range(lo, hi):
                    s = g[cut[i - lo] : cut[i - lo + 1]].tobytes()
                    for t in tasks[i]:
                        for o, v in zip(out, (t, node[i], m[i], s), strict=True):
                            o.append(v)
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(o, k) for o, k in zip(out, kinds, strict=True)], names=["task", "node", "m", "x"])

    return run


def verify(node: np.ndarray, m: np.ndarray, side: np.ndarray, sets: list[np.ndarray], threshold: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(link weight of each row, smallest row of its component in this block pair).

    ``side`` 0: all pairs among the rows; else only pairs of a row of side 1 with one of side 2.
    """
    k = len(sets)
    size = np.array([len(s) for s in sets])
    flat = np.concatenate(sets) if k else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(k), size)
    _, code, count = np.unique(flat, return_inverse=True, return_counts=True)
    more = count[code] > 1
    owner, code = owner[more], code[more]
    code = np.unique(code, return_inverse=True)[1] if len(code) else code
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    inter = np.zeros((k, k), np.int32)
    width = 4096
    for c in range(0, int(code[-1]) + 1 if len(code) else 0, width):
        a, z = np.searchsorted(code, (c, c + width))
        x = np.zeros((k, min(width, int(code[-1]) + 1 - c)), np.float32)
        x[owner[a:z], code[a:z] - c] = 1
        inter += (x @ x.T).astype(np.int32)  # each product counts to 4096 at most, exact in any float
    p, q = threshold
    link = np.zeros((k, k), bool)
    for i in range(0, k, 256):  # integers of 64 bits, a stretch of rows at a time
        link[i : i + 256] = (p + q) * inter[i : i + 256].astype(np.int64) >= p * (size[i : i + 256, None] + size[None, :])
    np.fill_diagonal(link, False)
    if side.any():
        link &= side[:, None] != side[None, :]
    label = _spread(np.arange(k), link)
    return link.astype(np.int64) @ m, label


def _solve(threshold: tuple[int, int]):
    def solve(rows: list) -> pa.RecordBatch:
        task = rows[0][0]
        node, m = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
        sets = [np.frombuffer(r[3], np.uint64) for r in rows]
        i, j = map(int, task.split(":")[1:3])
        side = np.zeros(len(rows), np.int8) if i == j else np.where(np.array([r[4] for r in rows]) == i, 1, 2).astype(np.int8)
        links, label = verify(node, m, side, sets, threshold)
        hit = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(node[hit]), pa.array(links[hit]), pa.array(node[label[hit]])], names=["node", "links", "root"])

    def run(batches):
        held: list = []
        for b in batches:
            for row in zip(*[c.to_pylist() for c in b.columns], strict=True):
                if held and held[0][0] != row[0]:
                    if len(held) > 1:
                        yield solve(held)
                    held = []
                held.append(row)
        if len(held) > 1:
            yield solve(held)

    return run


def _block_pairs(key: Column, node: Column, b: Column) -> Column:
    """Tasks (key:i:j:blocks) of a row: its block with every block, lower number first."""
    own = F.pmod(F.xxhash64(node), b).cast("int")
    return F.transform(F.sequence(F.lit(0), b - 1), lambda j: F.concat_ws(":", key, F.least(own, j), F.greatest(own, j), b))


def candidates(nodes: DataFrame, trees: int = TREES, levels: int = LEVELS, threshold: tuple[int, int] = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """(u, v): spanning forests of the candidate sets of every trie node; ``nodes`` has node, size, x1, x2 and sig."""
    low = depth_for(threshold[0] / threshold[1], trees, levels, recall)
    stop = stop_depths(threshold, trees, levels, recall)
    leaves = nodes.select("node", "size", "x1", "x2", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("t"), "sig")
    leaves = leaves.select("node", "size", "x1", "x2", "t", F.get("sig", 2 * F.col("t")).alias("p"), F.get("sig", 2 * F.col("t") + 1).alias("below"))
    shared = table(leaves.groupBy("t", "p").agg(F.count("*").alias("c")).where("c > 1"), "shared")
    b = F.ceil(F.col("b") / block).cast("int")
    met = split_join(leaves, shared.withColumn("b", F.col("c")), ["t", "p"]).withColumn("b", b)
    met = met.withColumn("task", F.explode(_block_pairs(F.concat_ws(":", "t", "p"), F.col("node"), F.col("b"))))
    ij = F.split("task", ":")
    own = F.pmod(F.xxhash64("node"), F.col("b")).cast("int")
    side = F.when(F.element_at(ij, 3) == F.element_at(ij, 4), 0).when(own == F.element_at(ij, 3).cast("int"), 1).otherwise(2)
    rows = met.select("task", "node", "size", "x1", "x2", "below", side.alias("side"))
    rows = rows.repartition("task").sortWithinPartitions("task", "below", "node")
    return rows.mapInArrow(_tries(low, levels, stop, threshold), "u bigint, v bigint")


def classes(docs: DataFrame, n: int = N, threshold: tuple[int, int] = THRESHOLD, trees: int = TREES, levels: int = LEVELS, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """Rows (id, h, class, n_links): ``class`` is a number shared by linked documents (null: no words)."""
    keyed = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("h"), F.col("text"))
    low = depth_for(threshold[0] / threshold[1], trees, levels, recall)
    sig = table(keyed.mapInArrow(_signatures(n, trees, levels, low), _SIG), "signatures")
    one = [F.first(c).alias(c) for c in ("id", "h", "size", "x1", "x2", "sig")]
    nodes = table(sig.where("size > 0").groupBy("k1", "k2").agg(F.count("*").alias("m"), *one).withColumn("node", F.monotonically_increasing_id()), "nodes")
    pairs = candidates(nodes, trees, levels, threshold, recall, block).distinct()
    groups = table(connected_components(pairs), "groups")
    settle(docs.sparkSession)  # the tries' shuffles go before the sets' come
    sizes = groups.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("b"))
    tasks = _block_pairs(F.col("component").cast("string"), F.col("node"), F.col("b"))
    want = groups.join(sizes, "component").select("node", tasks.alias("tasks")).join(nodes.select("node", "id", "h", "m"), "node")
    near = keyed.alias("d").join(want.hint("shuffle_hash").alias("w"), F.col("d.id").eqNullSafe(F.col("w.id")) & (F.col("d.h") == F.col("w.h"))).select("text", "tasks", "node", "m")
    sets = near.mapInArrow(_sets(n), "task string, node bigint, m bigint, x binary")
    # rows equal in id and text bring their set twice
    sets = sets.repartition("task").dropDuplicates(["task", "node"])
    own = F.pmod(F.xxhash64("node"), F.element_at(F.split("task", ":"), 4).cast("int")).cast("int")
    sets = sets.withColumn("own", own).sortWithinPartitions("task")
    found = table(sets.mapInArrow(_solve(threshold), "node bigint, links bigint, root bigint"), "links")
    joined = connected_components(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    per_set = nodes.select("k1", "k2", "m", "node").join(links, "node", "left").join(joined, "node", "left")
    per_set = per_set.select("k1", "k2", F.coalesce("component", "node").alias("class"), (F.coalesce("links", F.lit(0)) + F.col("m") - 1).alias("n_links"), F.col("m").alias("c"))
    per_set = table(per_set, "per_set")
    known = split_join(sig.where("size > 0").select("id", "h", "k1", "k2"), per_set, ["k1", "k2"]).select("id", "h", "class", "n_links")
    bare = sig.where("size = 0").select("id", "h", F.lit(None).cast("long").alias("class"), F.lit(0).cast("long").alias("n_links"))
    out = table(known.unionByName(bare), "classes")
    drop(sig, nodes, groups, found, per_set)
    return out


def near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """doc_id, class_id (smallest doc_id of the class), n_links for every document."""
    c = classes(docs, **options)
    named = table(c.where("class IS NOT NULL").groupBy("class").agg(F.min("id").alias("class_id"), F.count("*").alias("c")), "names")
    out = split_join(c.where("class IS NOT NULL"), named, ["class"]).select(F.col("id").alias("doc_id"), "class_id", "n_links")
    return out.unionByName(c.where("class IS NULL").select(F.col("id").alias("doc_id"), F.col("id").alias("class_id"), "n_links"))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that stay: of each class the row of the smallest id (ties: text hash), once; all rows without words."""
    c = classes(docs, **options)
    first = c.where("class IS NOT NULL").groupBy("class").agg(F.min(F.struct("id", "h")).alias("k")).select(F.col("k.id").alias("_i"), F.col("k.h").alias("_h"))
    # struct order puts null ids first; a class keeps a row without id only through its hash
    own = packed(docs, _i2=F.col("_row.doc_id").cast("long"), _h2=F.xxhash64("_row.text"))
    kept = own.join(first.hint("shuffle_hash"), F.col("_i2").eqNullSafe(F.col("_i")) & (F.col("_h2") == F.col("_h")), "left_semi").dropDuplicates(["_i2", "_h2"])
    empty = own.where(~F.coalesce(F.col("_row.text"), F.lit("")).rlike(r"[^\x20\x09-\x0D]"))
    return kept.select("_row.*").unionByName(empty.select("_row.*"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir).select("doc_id", "text"))
