"""The component store over many batches, against union-find over all edges seen."""

import random

from test_components import plain

from weftgraph.streaming.alignments import ComponentStore


def test_batches_read_what_they_touch(spark, tmp_path):
    r = random.Random(3)
    store = ComponentStore(str(tmp_path / "store"), zone=100, compact_every=4)
    assert store.read(spark) is None
    seen, sizes = [], []

    def add(edges, number):
        store.merge(spark.createDataFrame(edges, "u long, v long"), number)
        return {x.node: x.component for x in store.read(spark).collect()}

    for number in range(6):
        edges = [(n, n + 1) for n in range(5000, 5400)] if not number else []  # one large component that later batches hardly touch
        edges += [(r.randint(0, 60) + 100 * number, r.randint(0, 160) + 100 * number) for _ in range(25)]
        edges += [(5000 + number, 10 * number)] if number > 1 else [(None, 1)]
        seen += edges
        got = add(edges, number)
        assert got == plain(seen)
        sizes.append((len({x for e in edges for x in e}), sum(store.found)))
    # rows found follow the batch, though 400 bases have changed their component with nearly every one
    assert all(found <= 3 * touched + 10 for touched, found in sizes[1:])
    # a batch that is run again, even after a compaction, changes nothing
    assert add(edges, 5) == plain(seen)
    before = {x.node: x.component for x in store.read(spark, 3).collect()}
    assert before.keys() < plain(seen).keys() and all(before[n] >= c for n, c in plain(seen).items() if n in before)
