"""Column functions, sources and interval joins against plain Python."""

import gzip
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftgraph.functions import cigar, dna, positions
from weftgraph.functions.hashing import keep_sparse, match_hash
from weftgraph.functions.text import alignment_list, handy_number
from weftgraph.operators import intervals
from weftgraph.operators.components import connected_components
from weftgraph.operators.matches import both_directions
from weftgraph.operators.rank import numbered, running_sum
from weftgraph.operators.sequences import build_sequences
from weftgraph.sources import alignments as al
from weftgraph.sources import sequences as sq


def one(spark, col, **cols):
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in cols.items()]).select(col).first()[0]


def test_positions(spark):
    p = positions.make_pos(F.lit(12), F.lit(True))
    assert one(spark, p) == 25
    assert one(spark, positions.pos_text(p)) == "12-"
    assert one(spark, positions.pos_offset(positions.incr_pos(p, 3))) == 9
    assert one(spark, positions.pos_offset(positions.decr_pos(p))) == 13
    assert one(spark, positions.flip_pos(p)) == 24
    assert one(spark, positions.pos_in_all(F.lit(100), F.lit(8), F.lit(2), F.lit(True))) == 105


def test_complement(spark):
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZ-#$*"
    assert one(spark, dna.complement(F.lit(letters))) == "TVGHNNCDNNMNKNNNQYWAABSNRN-$#N"
    assert one(spark, dna.reverse_complement(F.lit("AACGN"))) == "NCGTT"
    assert one(spark, dna.base_at(F.lit("ACG"), F.lit(2), F.lit(True))) == "C"


def test_cigar(spark):
    parsed = one(spark, cigar.parse_cigar(F.lit("10M2I3=MX7D5")))
    assert [tuple(x) for x in parsed] == [(10, "M"), (2, "I"), (3, "X"), (7, "D")]
    assert one(spark, cigar.format_cigar(cigar.parse_cigar(F.lit("4=1X")))) == "4=1X"
    assert one(spark, cigar.parse_cigar(F.lit(""))) == []


def test_hash(spark):
    def plain(q, t, n):
        m = (1 << 64) - 1
        seed = q | t | n
        for x, (a, b) in ((q, (17, 9)), (t, (7, 23)), (n, (9, 2))):
            seed ^= (x + 0x9E3779B97F4A7C15 + ((seed << a) & m) + (seed >> b)) & m
        return seed

    r = random.Random(1)
    rows = [(r.getrandbits(40), r.getrandbits(40), r.randint(1, 9999)) for _ in range(200)]
    d = spark.createDataFrame(rows, "q long, t long, n long")
    got = d.select("*", match_hash(d.q, d.t, d.n).alias("h"), keep_sparse(d.q, d.t, d.n, 0.3).alias("k")).collect()
    for x in got:
        h = plain(x.q, x.t, x.n)
        assert x.h % (1 << 64) == h
        assert x.k == bool(np.float32(h) < np.float32(2.0**64) * np.float32(0.3))


def test_text():
    assert [handy_number(x, 7.0) for x in ("10k", "1M", "2.5g", "x", "12", "1.2.3", "")] == [10_000, 1e6, 2.5e9, 7.0, 12, 7.0, 7.0]
    assert alignment_list("a.paf:20,b.paf,c:1:2") == [("a.paf", 20), ("b.paf", 0)]


def test_ranks(spark):
    d = spark.createDataFrame([(x,) for x in random.Random(2).sample(range(1000), 300)], "x long").repartition(4)
    got = sorted((r.x, r.n) for r in numbered(d, "x", name="n").collect())
    assert [n for _, n in got] == list(range(300))
    runs = running_sum(d, "x", "x", "s", block=64).orderBy("x").collect()
    assert [r.s for r in runs] == list(np.cumsum([r.x for r in runs]))


def test_interval_joins(spark):
    r = random.Random(3)
    a = [(i, s, s + r.randint(0, 30)) for i, s in enumerate(r.randint(0, 300) for _ in range(40))]
    b = [(i, s, s + r.randint(0, 30), s * 2 + 50, r.random() < 0.5) for i, s in enumerate(r.randint(0, 300) for _ in range(40))]
    left = spark.createDataFrame(a, "l_id long, l_start long, l_end long")
    right = spark.createDataFrame(b, "r_id long, r_start long, r_end long, pos long, is_rev boolean")
    got = intervals.trimmed(intervals.overlap_join(left, right, 16)).select("l_id", "r_id", "start", "end", "pos").collect()
    want = [(x[0], y[0], max(x[1], y[1]), min(x[2], y[2]), y[3] + (-1 if y[4] else 1) * max(x[1] - y[1], 0)) for x in a for y in b if max(x[1], y[1]) < min(x[2], y[2])]
    assert sorted(map(tuple, got)) == sorted(want)
    points = spark.createDataFrame([(p,) for p in range(0, 330, 7)], "p long")
    got = intervals.point_join(points, right, 16).select("p", "r_id").collect()
    assert sorted(map(tuple, got)) == sorted((p, y[0]) for p in range(0, 330, 7) for y in b if y[1] <= p < y[2])
    starts = spark.createDataFrame([(5, "a"), (90, "b"), (91, "c"), (250, "d")], "start long, name string")
    got = intervals.asof_join(points, starts, block=32).select("p", "name").collect()
    assert dict(map(tuple, got)) == {p: next((n for s, n in ((250, "d"), (91, "c"), (90, "b"), (5, "a")) if s <= p), None) for p in range(0, 330, 7)}


def test_components(spark):
    r = random.Random(4)
    edges = [(r.randint(0, 80), r.randint(0, 80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 160)] + [(7, 7), (None, 3)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for u, v in edges:
        if u is not None:
            x, y = sorted((find(u), find(v)))
            parent[y] = x
    got = connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in got} == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_sequence_files(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">x one\nacg\nT\n>empty\n>y\r\nGG\r\nNN\n")
    with gzip.open(tmp_path / "a.fa.gz", "wt") as f:
        f.write((tmp_path / "a.fa").read_text())
    (tmp_path / "a.fq").write_text("@x one\nACGT\n+\n!!!!\n@y\nGGNN\n+y\n@@@@\n")
    (tmp_path / "bad").write_text("hello\n")
    for name in ("a.fa", "a.fa.gz", "a.fq"):
        s = build_sequences(sq.read_sequences(spark, str(tmp_path / name))).orderBy("seq_id").collect()
        assert [(r.seq_id, r.name, r.seq_offset, r.seq_len, r.seq) for r in s] == [(1, "x", 0, 4, "ACGT"), (2, "y", 4, 4, "GGNN")]
    with pytest.raises(sq.UnknownFormat):
        sq.read_sequences(spark, str(tmp_path / "bad"))
    with pytest.raises(FileNotFoundError):
        sq.read_sequences(spark, str(tmp_path / "none"))
    seqs = build_sequences(sq.read_sequences(spark, str(tmp_path / "a.fa")))
    assert [r.line for r in sq.fasta_lines(seqs, 3).orderBy("seq_id").collect()] == [">x\nACG\nT", ">y\nGGN\nN"]
    sq.save_index(seqs, str(tmp_path / "index"))
    assert sq.load_index(spark, str(tmp_path / "index")).count() == 2


def test_alignment_files(spark, tmp_path):
    row = "a\t8\t0\t8\t+\tb 8\t0\t8\t7\t8\t60\ttp:A:P\tcg:Z:8M\tcg:Z:1M"
    (tmp_path / "a.paf").write_text(f"{row}\n{row}\n\n{row}\n")
    path = str(tmp_path / "a.paf")
    assert al.read_paf(spark, path).count() == 2
    assert al.read_paf(spark, path, on_bad_row="skip").count() == 3
    with pytest.raises(al.BadAlignment):
        al.read_paf(spark, path, on_bad_row="raise")
    two = al.read_paf_list(spark, f"{path}:5,{path}")
    assert sorted(r.min_match_len for r in two.collect()) == [0, 0, 5, 5]
    assert al.paf_lines(two).first().line == "a\t8\t0\t8\t+\tb\t8\t0\t8\t7\t8\t60\tcg:Z:8M"
    (tmp_path / "plain.paf").write_text("a\t8\t0\t8\t-\tb\t8\t0\t8\t7\t8\t60\n")
    with pytest.warns(UserWarning, match="cg:Z:"):
        assert al.read_paf(spark, str(tmp_path / "plain.paf")).first().cigar == []
    with pytest.raises(FileNotFoundError):
        al.read_paf_list(spark, str(tmp_path / "none.paf"))


def test_sxs(spark, tmp_path):
    text = "A\tt\tq\nI\t0\t4\t1\t5\nM\t4\nC\t4M\nT\t100\nQ\t30\nA\tt2\tq2\nI\t2\t3\t0\t1\nC\t1M\n"
    (tmp_path / "x.sxs").write_text(text)
    s = al.read_sxs(spark, str(tmp_path / "x.sxs"))
    assert [(r.target_name, r.query_name, r.target_start, r.query_end, r.num_matches, r.mapq) for r in s.orderBy("rec").collect()] == [("t", "q", 0, 5, 4, 30), ("t2", "q2", 2, 1, None, None)]
    assert al.sxs_lines(s).orderBy("rec").first().line == "A\tt\tq\nI\t0\t4\t1\t5\nM\t4\nC\t4M\nQ\t30"


def test_both_directions(spark):
    runs = spark.createDataFrame([(False, 3, 20, 4), (True, 9, 30, 4)], "is_rev boolean, q long, t long, len long")
    got = {(r.start, r.end, r.pos, r.is_rev) for r in both_directions(runs).collect()}
    assert got == {(3, 7, 20, False), (20, 24, 3, False), (6, 10, 33, True), (30, 34, 9, True)}


def test_streamed_alignments(spark, tmp_path):
    from weftgraph.streaming.alignments import ComponentStore, follow

    (tmp_path / "in").mkdir()
    seqs = build_sequences(spark.createDataFrame([(0, "a", "ACGT"), (1, "b", "ACGT"), (2, "c", "ACGT")], "rec_no long, name string, seq string"))
    store = ComponentStore(str(tmp_path / "store"))
    line = "{}\t4\t0\t4\t+\t{}\t4\t0\t4\t4\t4\t60\tcg:Z:4M\n"
    for n, (q, t) in enumerate((("a", "b"), ("b", "c"))):
        (tmp_path / "in" / f"{n}.paf").write_text(line.format(q, t))
        stream = follow(spark, str(tmp_path / "in"), seqs, store, str(tmp_path / "check"))
        stream.awaitTermination()
    got = {r.node: r.component for r in store.read(spark).collect()}
    assert got == {i: i % 4 for i in range(12)}


@pytest.mark.parametrize("parts", [1, 3, 10_000])
def test_split_join(spark, parts):
    from weftgraph.plans.work import split_join, table

    keys = [1] * 40 + [2] * 5 + [3, 4, None]
    rows = table(spark.createDataFrame([(k, i) for i, k in enumerate(keys)], "k int, i int"), "rows")
    lookup = table(spark.createDataFrame([(k, keys.count(k), f"v{k}") for k in (1, 2, 3, 9)], "k int, c int, v string"), "lookup")
    got = split_join(rows, lookup, ["k"], parts=parts).select("k", "i", "v").collect()
    assert sorted(map(tuple, got)) == [(k, i, f"v{k}") for i, k in enumerate(keys) if k in (1, 2, 3)]
    assert split_join(rows.limit(0), lookup, ["k"]).count() == 0
