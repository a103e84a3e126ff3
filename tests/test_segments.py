"""Closure by runs against union-find over bases."""

import random
from collections import defaultdict

import numpy as np
import pytest

from test_components import plain
from weftgraph.operators import closure, graph
from weftgraph.operators import segments as sg
from weftgraph.operators.sequences import bases
from weftgraph.plans.work import telling


def runs_of(r, total, n, longest):
    out = []
    for _ in range(n):
        k = r.randint(1, longest)
        rev = r.random() < 0.4
        q = r.randint(k - 1, total - 1) if rev else r.randint(0, total - k)
        out.append((rev, q, r.randint(0, total - k), k))
    return out


def pairs(runs):
    return [(q - i if rev else q + i, t + i) for rev, q, t, k in runs for i in range(k)]


def frame(spark, runs):
    return spark.createDataFrame(runs, "is_rev boolean, q long, t long, len long")


def test_runs_and_pairs():
    r = np.random.default_rng(5)
    for _ in range(200):
        n = int(r.integers(0, 40))
        a = np.sort(r.choice(60, n, replace=False))
        b = np.where(r.random(n) < 0.7, a + 5, r.integers(0, 50, n))
        if r.random() < 0.5:
            b = 100 - b
        runs = sg.gathered(a, b)
        x, y = sg.spread(*runs)
        assert x.tolist() == a.tolist() and y.tolist() == b.tolist()
    assert [len(x) for x in sg.gathered(np.arange(50), np.arange(50)[::-1])] == [1] * 4


@pytest.mark.parametrize("local_bases,width,n,longest", [(1 << 21, 64, 40, 6), (0, 7, 40, 6), (60, 16, 14, 60)])
def test_closure_is_that_of_the_bases(spark, local_bases, width, n, longest):
    r = random.Random(local_bases + width)
    runs = runs_of(r, 200, n, longest) + [(False, 0, 3, 60), (True, 99, 60, 40), (False, 5, 5, 1)]  # a repeat, a palindrome, a base with itself
    want = {q: c for q, c in plain(pairs(runs)).items() if q != c}
    got = sg.close_runs(frame(spark, runs).repartition(3), width=width, local_bases=local_bases)
    base = [(x.u, x.v) for x in sg.expanded(got, "u", "v").collect()]
    assert len(base) == len(set(base)) and dict(base) == want


def test_rows_follow_the_borders_not_the_bases(spark):
    """Forty copies of a sequence of 100,000 bases, each linked with the next one: a row or two a run, whichever way it takes."""
    n = 100_000
    runs = [(False, k * n, (k + 1) * n, n) for k in range(39)] + [(True, 41 * n - 1, 7 * n + 20, n - 20)]
    for local in (1 << 30, 0):
        got = sg.close_runs(frame(spark, runs), local_bases=local)
        rows = got.collect()
        assert sum(x.len for x in rows) == 39 * n + (n - 20)
        assert len(rows) <= 42
        assert all(x.v + x.len <= n if x.d > 0 else x.v < n for x in rows)


def test_segments_number_graph_positions(spark):
    r = random.Random(11)
    for seed in (0, 2):
        sizes = [r.choice([1, 2, 9, 40]) for _ in range(12)]
        offsets = np.cumsum([0, *sizes]).tolist()
        total = offsets[-1]
        runs = runs_of(r, total, 10 * seed, min(sizes[0] + 20, total // 3)) if seed else []
        index = spark.createDataFrame([(i + 1, f"s{i}", offsets[i], n) for i, n in enumerate(sizes)], "seq_id long, name string, seq_offset long, seq_len long")
        rows = sg.segments(sg.close_runs(frame(spark, runs), width=16), index)
        label = {q: q for q in range(total)} | plain(pairs(runs))
        place = {c: s for s, c in enumerate(sorted(set(label.values())))}
        seq = [k + 1 for k, n in enumerate(sizes) for _ in range(n)]
        got = sorted((x.q, x.seq_id, x.c, x.s) for x in sg.expanded(rows, "q", "c", "s").collect())
        assert got == [(q, seq[q], label[q], place[label[q]]) for q in range(total)]
        # no segment leaves its sequence
        ends = defaultdict(int) | {i + 1: offsets[i + 1] for i in range(len(sizes))}
        assert all(x.q + x.len <= ends[x.seq_id] for x in rows.collect())


@pytest.mark.parametrize("width,seed", [(7, 1), (16, 2)])
def test_positions_and_nodes_by_blocks(spark, width, seed):
    """``placed`` and ``nodes`` against ``base_map``, ``chained`` and plain slices, with borders everywhere and a base beyond ASCII."""
    r = random.Random(seed)
    lengths = [r.randint(1, 25) for _ in range(12)]
    total = sum(lengths)
    runs = runs_of(r, total, 14, 9)
    group = plain(pairs(runs))
    text = [None] * total
    for q in range(total):  # members of a component have one of two bases, as strands give
        c = group.get(q, q)
        text[q] = r.choice("AĂCG") if c == q else r.choice([text[c], "T"])
    index = spark.createDataFrame([(k + 1, f"n{k}", sum(lengths[:k]), n) for k, n in enumerate(lengths)], "seq_id long, name string, seq_offset long, seq_len long")
    held = spark.createDataFrame([(i // width, "".join(text[i : i + width])) for i in range(0, total, width)], "block long, text string")
    rows = frame(spark, runs)
    members = closure.base_components(bases(index, held, width), rows)
    want = closure.chained(closure.base_map(members))
    cols = ["q", "seq_id", "base", "s", "s_base", "is_rev", "first", "last"]
    got = sg.placed(sg.close_runs(rows), index, held, width)
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))
    spelled = dict(map(tuple, closure.graph_bases(want).collect()))
    assert dict(map(tuple, got.where("head").select("s", "s_base").collect())) == spelled
    cuts = sorted({x.s for x in graph.node_cuts(want).collect()})
    nodes = [(k, a, b, "".join(spelled[s] for s in range(a, b))) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False), 1)]
    for w in (1, width):
        assert sorted(map(tuple, graph.nodes(got, got.where("head").selectExpr("s", "s_base AS base"), w).collect())) == nodes


@pytest.mark.parametrize("far", [[], [(False, 99_980, 19_990, 4), (True, 19_993, 12, 3)]])
def test_whole_components_take_no_rounds(spark, far):
    """Pairs of neighbours, and two runs that join bases of both ends: rounds are only for what meets across partitions."""
    runs = [(k % 2 == 1, 20 * k + 1, 20 * k + 5, 2) for k in range(5000)] + far
    want = {q: c for q, c in plain(pairs(runs)).items() if q != c}
    said = []
    with telling(said.append):
        got = [(x.u, x.v) for x in sg.expanded(sg.close_runs(frame(spark, runs), local_bases=0 if far else 2000), "u", "v").collect()]
    assert len(got) == len(set(got)) and dict(got) == want
    reached = [int(x.split()[1]) for x in said if x.startswith("reached")]
    assert len(reached) == 1 and reached[0] <= 1000 < len(want)
    assert far or not [x for x in said if x.startswith("round")]
