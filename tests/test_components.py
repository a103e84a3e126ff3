"""Components by every way through the rounds, against union-find."""

import random

import numpy as np
import pytest

from weftgraph.operators import components
from weftgraph.operators.components import connected_components, forests, smallest_of_part


def plain(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None and v is not None:
            x, y = sorted((find(u), find(v)))
            parent[y] = x
    return {x: find(x) for x in list(parent)}


def some_edges(seed, hub=400):
    r = random.Random(seed)
    edges = [(r.randint(0, 300), r.randint(0, 300)) for _ in range(120)]
    edges += [(i, i + 1) for i in range(1000, 1200)] + [(7, 7), (5000, 5000), (None, 3), (3, None), (-4, -9)]
    edges += [(9000, 9001 + i) if i % 2 else (9001 + i, 9000) for i in range(hub)]  # a hub with a third of all nodes
    r.shuffle(edges)
    return edges


@pytest.mark.parametrize("local_edges", [0, 150, 1 << 21])
def test_every_way_gives_the_same(spark, local_edges):
    edges = some_edges(local_edges)
    df = spark.createDataFrame(edges, "u long, v long").repartition(5)
    got = connected_components(df, local_edges=local_edges).collect()
    assert len(got) == len({r.node for r in got})
    assert {r.node: r.component for r in got} == plain(edges)


def test_nothing_and_self_loops_only(spark):
    for rows in ([], [(None, 1)], [(4, 4), (4, 4), (2, 2)]):
        df = spark.createDataFrame(rows, "u long, v long")
        for most in (0, 100):
            assert {r.node: r.component for r in connected_components(df, local_edges=most).collect()} == plain(rows)


def test_only_a_forest_is_handed_on(spark):
    r = random.Random(1)
    edges = [(r.randint(0, 40), r.randint(0, 40)) for _ in range(5000)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(4)
    for lot in (100, 1 << 20):
        got = forests(df, lot).collect()
        assert len(got) <= 4 * 41
        assert plain([tuple(x) for x in got]) == plain(edges)
    # a partition with more nodes than it may hold goes on in pieces
    path = spark.range(3000).selectExpr("id AS u", "id + 1 AS v").coalesce(1)
    assert plain([tuple(x) for x in forests(path, 50).collect()]) == plain([(i, i + 1) for i in range(3000)])


def test_fewer_rounds_than_edges_need_alone(spark, monkeypatch):
    """A long path over many partitions: contraction inside them leaves a few rounds."""
    rounds = []
    star = components.large_star
    monkeypatch.setattr(components, "large_star", lambda e, n: rounds.append(n) or star(e, n))
    path = spark.range(0, 4000, 1, 8).selectExpr("id AS u", "id + 1 AS v")
    assert connected_components(path, local_edges=0).where("component != 0").count() == 0
    assert len(rounds) <= 4


def test_arrays():
    r = np.random.default_rng(2)
    for n in (0, 1, 50, 400):
        u, v = r.integers(0, 150, n), r.integers(0, 150, n)
        nodes, low = smallest_of_part(u, v)
        assert dict(zip(nodes.tolist(), low.tolist(), strict=True)) == plain(zip(u.tolist(), v.tolist(), strict=True))
