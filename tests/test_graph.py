"""Small graphs worked out by hand, and random ones against plain union-find."""

import random

import pytest

from weftgraph.operators.graph import BrokenGraph
from weftgraph.operators.matches import UnknownSequence
from weftgraph.operators.sequences import DuplicateNames, build_sequences
from weftgraph.plans.induce import induce
from weftgraph.sources.alignments import parse_paf

COMP = dict(zip("ACGTN", "TGCAN", strict=True))


def tables(spark, seqs, alns):
    records = spark.createDataFrame([(i, n, s) for i, (n, s) in enumerate(seqs)], "rec_no long, name string, seq string")
    size = {n: len(s) for n, s in seqs}
    lines = [(f"{q}\t{size[q]}\t{qs}\t{qe}\t{st}\t{t}\t{size[t]}\t{ts}\t{te}\t0\t0\t60\tcg:Z:{c}",) for q, qs, qe, st, t, ts, te, c in alns]
    paf = parse_paf(spark.createDataFrame(lines, "value string")).selectExpr("*", "0L AS min_match_len")
    return build_sequences(records), paf


def gfa(spark, seqs, alns, **options):
    g = induce(*tables(spark, seqs, alns), **options)
    lines = [r.line for r in g.gfa.orderBy("kind", "k1", "k2", "k3", "k4").collect()]
    assert lines[0] == "H\tVN:Z:1.0"
    f = [x.split("\t") for x in lines]
    return (
        "; ".join(f"{x[1]} {x[2]}" for x in f if x[0] == "S"),
        "; ".join("".join(x[1:5]) for x in f if x[0] == "L"),
        "; ".join(f"{x[1]} {x[2]}" for x in f if x[0] == "P"),
    )


TANDEM = ([("a", "ACACAC")], [("a", 0, 4, "+", "a", 2, 6, "4=")])
SPLIT = ("1 A; 2 A; 3 A; 4 C; 5 C; 6 C", "1+4+; 2+5+; 3+6+; 4+2+; 5+3+", "a 1+,4+,2+,5+,3+,6+")
GOLDENS = {
    "snp": ([("a", "ACGTACGT"), ("b", "ACGAACGT")], [("a", 0, 8, "+", "b", 0, 8, "8M")], {}, ("1 ACG; 2 T; 3 ACGT; 4 A", "1+2+; 1+4+; 2+3+; 4+3+", "a 1+,2+,3+; b 1+,4+,3+")),
    "insertion": ([("a", "ACGGTT"), ("b", "ACTT")], [("a", 0, 6, "+", "b", 0, 4, "2=2I2=")], {}, ("1 AC; 2 GG; 3 TT", "1+2+; 1+3+; 2+3+", "a 1+,2+,3+; b 1+,3+")),
    "reverse": ([("a", "AACG"), ("b", "CGTT")], [("a", 0, 4, "-", "b", 0, 4, "4=")], {}, ("1 AACG", "", "a 1+; b 1-")),
    "none": ([("a", "ACN"), ("b", "nT")], [], {}, ("1 ACN; 2 NT", "", "a 1+; b 2+")),
    "tandem": (*TANDEM, {}, ("1 AC", "1+1+", "a 1+,1+,1+")),
    "tandem_r1": (*TANDEM, {"repeat_max": 1}, SPLIT),
    "tandem_r2": (*TANDEM, {"repeat_max": 2}, ("1 A; 2 A; 3 C; 4 C", "1+3+; 2+4+; 3+1+; 3+2+", "a 1+,3+,1+,3+,2+,4+")),
    "tandem_l3": (*TANDEM, {"min_repeat_dist": 3}, SPLIT),
    "short_run": ([("a", "ACGTTACG"), ("b", "ACGTAACG")], [("a", 0, 8, "+", "b", 0, 8, "8M")], {"min_match_len": 4}, ("1 ACGT; 2 TACG; 3 AACG", "1+2+; 1+3+", "a 1+,2+; b 1+,3+")),
    "transitive": ([("a", "GATTACA"), ("b", "GATCACA"), ("c", "GATTACA")], [("a", 0, 7, "+", "b", 0, 7, "7M"), ("b", 0, 7, "+", "c", 0, 7, "7M")], {}, ("1 GAT; 2 T; 3 ACA; 4 C; 5 T", "1+2+; 1+4+; 1+5+; 2+3+; 4+3+; 5+3+", "a 1+,2+,3+; b 1+,4+,3+; c 1+,5+,3+")),
    "n_never": ([("a", "ACNGT"), ("b", "ACNGT")], [("a", 0, 5, "+", "b", 0, 5, "5M")], {}, ("1 AC; 2 N; 3 GT; 4 N", "1+2+; 1+4+; 2+3+; 4+3+", "a 1+,2+,3+; b 1+,4+,3+")),
}


@pytest.mark.parametrize("name", GOLDENS)
def test_golden(spark, name):
    seqs, alns, options, want = GOLDENS[name]
    assert gfa(spark, seqs, alns, **options) == want


def plain(seqs, alns, k):
    """Components and spelling by union-find over all bases."""
    off, q = {}, ""
    for n, s in seqs:
        off[n] = len(q)
        q += s
    parent = list(range(len(q)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for qn, qs, qe, st, tn, ts, _, cigar in alns:
        i, j, d = (off[qn] + qs, off[tn] + ts, 1) if st == "+" else (off[qn] + qe - 1, off[tn] + ts, -1)
        n = int(cigar[:-1])
        run = []
        for x in range(n + 1):
            a, b = i + d * x, j + x
            if x < n and a != b and (q[a] if d == 1 else COMP[q[a]]) == q[b] != "N":
                run.append((a, b))
                continue
            if len(run) >= k:
                for u, v in run:
                    u, v = sorted((find(u), find(v)))
                    parent[v] = u
            run = []
    return [find(x) for x in range(len(q))]


def test_random_components(spark):
    r = random.Random(7)
    for _ in range(3):
        seqs = [(f"s{i}", "".join(r.choice("ACGTN") for _ in range(r.randint(3, 14)))) for i in range(4)]
        alns = []
        for _ in range(6):
            (a, x), (b, y) = r.choice(seqs), r.choice(seqs)
            n = r.randint(2, min(len(x), len(y)))
            i, j = r.randint(0, len(x) - n), r.randint(0, len(y) - n)
            alns.append((a, i, i + n, r.choice("+-"), b, j, j + n, f"{n}M"))
        k = r.choice([0, 2])
        g = induce(*tables(spark, seqs, alns), min_match_len=k)
        order = sorted(set(plain(seqs, alns, k)))
        want = [order.index(c) for c in plain(seqs, alns, k)]
        assert [x.s for x in g.base_map.orderBy("q").collect()] == want
        again = induce(*tables(spark, seqs, alns[::-1] + alns), min_match_len=k)
        lines = [sorted(x.line for x in y.gfa.collect()) for y in (g, again)]
        assert lines[0] == lines[1]


def test_errors(spark):
    with pytest.raises(DuplicateNames):
        tables(spark, [("a", "A"), ("a", "C")], [])
    seqs, paf = tables(spark, [("a", "ACGT"), ("b", "ACGT")], [("a", 0, 4, "+", "b", 0, 4, "4M")])
    with pytest.raises(UnknownSequence):
        induce(seqs.where("name = 'a'"), paf)
    with pytest.raises(Exception, match="leaves its sequence"):
        induce(*tables(spark, [("a", "ACGT"), ("b", "ACGT")], [("a", 0, 4, "+", "b", 0, 4, "5M")]))
    with pytest.raises(BrokenGraph):  # U complements to A, A to T: a U that follows an A cannot be spelled
        induce(*tables(spark, [("a", "A"), ("b", "U")], [("b", 0, 1, "-", "a", 0, 1, "1M")]))


def test_empty_tables(spark):
    g = induce(*tables(spark, [("a", "AC"), ("b", "")], []))
    assert [r.name for r in g.sequences.collect()] == ["a"]
    assert g.matches.count() == 0
    assert g.links.count() == 0
