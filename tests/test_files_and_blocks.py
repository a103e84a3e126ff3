"""Blocks of sequences, long alignments, files in order, and the command line."""

import random
import re
import time

import pytest

from weftgraph.__main__ import main
from weftgraph.operators import matches, rank, sequences
from weftgraph.operators.graph import map_faults
from weftgraph.plans.induce import induce
from weftgraph.plans.work import table
from weftgraph.sources.alignments import parse_paf
from weftgraph.sources.lines import read_lines
from weftgraph.sources.sequences import read_sequences

COMP = dict(zip("ACGTN", "TGCAN", strict=True))


def records(spark, seqs):
    return sequences.build_sequences(spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "rec_no long, name string, seq string"))


def paf(spark, seqs, alns):
    size = {n: len(s) for n, s in seqs}
    lines = [(f"{q}\t{size[q]}\t{qs}\t{qe}\t{st}\t{t}\t{size[t]}\t{ts}\t{te}\t0\t0\t60\tcg:Z:{c}",) for q, qs, qe, st, t, ts, te, c in alns]
    return parse_paf(spark.createDataFrame(lines, "value string")).selectExpr("*", "0L AS min_match_len")


def plain_runs(seqs, alns):
    off, q = {}, ""
    for n, s in seqs:
        off[n] = len(q)
        q += s
    out = []
    for a, qs, qe, st, b, ts, _, cigar in alns:
        i, d, j = (off[a] + qs, 1, off[b] + ts) if st == "+" else (off[a] + qe - 1, -1, off[b] + ts)
        for n, op in re.findall(r"(\d+)([M=XID])", cigar):
            n = int(n)
            start = None
            for k in range(n + 1) if op in "M=X" else ():
                ok = k < n and i + d * k != j + k and (q[i + d * k] if d == 1 else COMP[q[i + d * k]]) == q[j + k] != "N"
                if ok and start is None:
                    start = k
                if not ok and start is not None:
                    out.append((d == -1, i + d * start, j + start, k - start))
                    start = None
            i += d * n if op != "D" else 0
            j += n if op != "I" else 0
    return sorted(out)


@pytest.mark.parametrize("width", [1, 7, 64])
def test_runs_across_blocks(spark, width):
    r = random.Random(width)
    seqs = [(f"s{i}", "".join(r.choice("ACGTN" if i else "AC") for _ in range(r.randint(12, 60)))) for i in range(5)]
    alns = []
    for _ in range(12):
        (a, x), (b, y) = r.choice(seqs), r.choice(seqs)
        ops, qn, tn = [], 0, 0
        while qn < len(x) and tn < len(y) and len(ops) < 6:
            op = r.choice("MM=XID")
            n = r.randint(1, max(1, min(len(x) - qn, len(y) - tn)))
            ops.append(f"{n}{op}")
            qn, tn = qn + n * (op != "D"), tn + n * (op != "I")
        if qn and tn and qn <= len(x) and tn <= len(y):
            i, j = r.randint(0, len(x) - qn), r.randint(0, len(y) - tn)
            alns.append((a, i, i + qn, r.choice("+-"), b, j, j + tn, "".join(ops)))
    t = records(spark, seqs)
    held, index = sequences.blocks(t, width), t.drop("seq")
    got = matches.match_runs(matches.locate(paf(spark, seqs, alns), index), held, width)
    assert sorted((x.is_rev, x.q, x.t, x.len) for x in got.collect()) == plain_runs(seqs, alns)
    whole = "".join(s for _, s in seqs)
    b = sorted((x.q, x.base) for x in sequences.bases(index, held, width).collect())
    assert [x[0] for x in b] == list(range(len(whole))) and "".join(x[1] for x in b) == whole
    assert {x.name: x.seq for x in sequences.with_text(index, held, width).collect()} == dict(seqs)


def test_no_plan_carries_a_sequence(spark):
    seqs = [("a", "ACGT" * 9), ("b", "ACGT" * 9)]
    t = records(spark, seqs)
    index = t.drop("seq")
    held = spark.createDataFrame([(0, "ACGT" * 18)], "block long, text string")
    runs = matches.match_runs(matches.locate(paf(spark, seqs, [("a", 0, 36, "+", "b", 0, 36, "36M")]), index), held)
    for df in (runs, sequences.bases(index, held)):
        assert not re.search(r"ReadSchema: struct<[^>]*\bseq:", df._jdf.queryExecution().executedPlan().toString())


def test_long_alignment(spark):
    """100,000 CIGAR entries on 20 Mbp."""
    n, entries = 20_000_000, 100_000
    text = ("".join(random.Random(1).choices("ACGT", k=4000)) * (n // 4000 + 1))[:n]
    seqs = [("a", text), ("b", text)]
    t = table(records(spark, seqs), "long")
    held, index = table(sequences.blocks(t), "held"), t.drop("seq")
    lines = paf(spark, seqs, [("a", 0, n, "+", "b", 0, n, f"{n // entries}=" * entries)])
    began = time.monotonic()
    got = matches.match_runs(matches.locate(lines, index), held).agg({"len": "sum", "*": "count"}).first()
    assert (got["sum(len)"], got["count(1)"]) == (n, entries)
    assert time.monotonic() - began < 60


def test_neighbours(spark):
    r = random.Random(3)
    at = sorted(r.sample(range(500), 60))
    d = spark.createDataFrame([(x, -x) for x in at], "q long, v long").repartition(3)
    for block in (1, 7, 1000):
        got = {x.q: (x._prev and x._prev.v, x._next and x._next.v) for x in rank.neighbours(d, "q", "v", block=block).collect()}
        assert got == {x: (-at[i - 1] if i else None, -at[i + 1] if i + 1 < len(at) else None) for i, x in enumerate(at)}


def test_map_faults(spark):
    assert [tuple(x) for x in map_faults(spark.createDataFrame([(1,), (2,), (2,)], "q long")).collect()] == [(2, 2)]


def test_headers_and_files_in_order(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "part-1.fa").write_text(">>c note\nAC\nGT\n>d>e\r\nTT\n")
    (folder / "part-0.fa").write_text(">a\nA\n>>b\n\nC\n")
    got = [(x.name, x.seq) for x in read_sequences(spark, str(folder)).orderBy("rec_no").collect()]
    assert got == [("a", "A"), (">b", "C"), (">c", "ACGT"), ("d>e", "TT")]


def test_written_graph_is_in_order(spark, tmp_path):
    seqs = [("a", "ACGTACGT"), ("b", "ACGAACGT")]
    g = induce(records(spark, seqs), paf(spark, seqs, [("a", 0, 8, "+", "b", 0, 8, "8M")]))
    g.write_gfa(str(tmp_path / "out"))
    lines = [x.value.split("\t")[0] for x in read_lines(spark, str(tmp_path / "out")).orderBy("file", "block", "place").collect()]
    assert lines == ["H", *"SSSS", *"LLLL", *"PP"]


def test_command_line(spark, tmp_path, capsys):
    fa, aln = tmp_path / "s.fa", tmp_path / "a.paf"
    fa.write_text(">a\nACGT\n>b\nACGT\n")
    aln.write_text("a\t4\t0\t4\t+\tb\t4\t0\t4\t4\t4\t60\tcg:Z:4M\n")
    assert main(["-v"]) == 0
    assert main(["-s", str(fa)]) == 1
    assert main(["-s", str(tmp_path / "no.fa"), "-p", str(aln)]) == 2
    assert main(["-s", str(fa), "-p", f"{aln},{tmp_path}/no.paf"]) == 4
    capsys.readouterr()
    assert main(["-s", str(fa), "-p", f"{aln}:2", "-P", "-V", "-B", "10k"]) == 0
    said = capsys.readouterr()
    assert said.out.splitlines() == ["H\tVN:Z:1.0", "S\t1\tACGT", "P\ta\t1+\t*", "P\tb\t1+\t*"]
    assert "4 graph bases of 8, 1 nodes, 0 links" in said.err
    (tmp_path / "twice.fa").write_text(">a\nAC\n>a\nGT\n")
    assert main(["-s", str(tmp_path / "twice.fa"), "-p", str(aln)]) == 1
