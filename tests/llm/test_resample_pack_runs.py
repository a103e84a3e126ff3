"""Operators 11 to 13 against brute force, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest

from weftgraph.llm import importance, packing, periodic, registry, tokens
from weftgraph.llm import _text as tx

SF = "/root/testdata/sf0.001"
#: Extra columns bear the names that the operators use inside.
SCHEMA = "doc_id long, text string, score string, _w long, _row string, rank long, `a.b` string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
FEATURE_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def make_rows(seed=5, n=60):
    r = random.Random(seed)
    voc = ["the", "Of", "Zeta-x", "é1", "##", "THE", "ça", "42", "x" * 70, "y" * 3000, "end.", "so?", "\x1c"]
    rows = []
    for i in range(n):
        w = [r.choice(voc[: r.choice([2, 6, 13])]) for _ in range(r.choice([0, 1, 5, 25, 90]))]
        if len(w) > 20 and r.random() < 0.5:
            p, k = r.randint(1, 6), r.randrange(len(w))
            for j in range(k + p, len(w)):
                w[j] = w[j - p]
        rows.append((i, "".join(x + r.choice([" ", " ", "\n", "  ", "\t", "\xa0"]) for x in w)))
    rows += [(n, None), (n + 1, ""), (None, rows[7][1]), rows[8], rows[8], (n + 2, "y " * 40_000), (n + 3, " \n "), (-5, "One. Two! " * 900), (2**62, "one two " * 30)]
    return rows


ROWS = make_rows()


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "s", 1, "r", 2, "c") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def counted(df):
    return Counter(tuple(r) for r in df.collect())


# --- 11


def grams(text):
    w = FEATURE_WORD.findall((text or "").translate(LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def brute_scores(rows, target, buckets=10_000, share=5, least=20):
    s, t = (Counter(zlib.crc32(g.encode()) % buckets for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    sn, tn = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (sn + buckets) / ((s[b] + 1) * (tn + buckets))))
    out = []
    for i, x in rows:
        n, g = grams(x)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in g)
        h = int(hashlib.sha256(f"42:{'null' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(g), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0, r[2], r[3]))
    rank = defaultdict(list)
    for k, r in enumerate(able[: len(able) * share // 100], 1):
        rank[r].append(k)
    return Counter((*r, rank[r].pop(0) if rank[r] else None) for r in out)


@pytest.mark.parametrize("share", [5, 60])
def test_scores_and_ranks(spark, docs, share):
    target = [None, "", "the of the of zeta", "é1 THE end", *[t for _, t in ROWS[20:24]]]
    got = counted(importance.scored(docs, frame(spark, list(enumerate(target))), share))
    assert got == brute_scores(ROWS, target, share=share)


def test_nothing_to_score_or_no_target(spark, docs, none):
    assert importance.scored(none, docs).count() == 0
    assert counted(importance.scored(docs, none)) == brute_scores(ROWS, [])
    assert importance.resample(none, docs).count() == 0


def test_resample_keeps_rows_and_columns(spark, docs):
    target = frame(spark, ROWS[:9])
    want = counted(importance.scored(docs, target, 40).where("rank IS NOT NULL").select("doc_id"))
    got = importance.resample(docs, target, 40)
    assert got.columns == docs.columns
    assert counted(got.select("doc_id")) == want
    assert {r._row for r in got.collect()} == {"r"}


def test_crcs_are_composed(monkeypatch):
    r = random.Random(2)
    for _ in range(300):
        a, b = (bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 47, 48, 300, 5000]))) for _ in "ab")
        one = lambda x: np.array([zlib.crc32(x)], np.uint32)
        assert importance.crc_join(one(a), one(b), np.array([len(b)]))[0] == zlib.crc32(a + b)
    # a text cut into stretches has the features of the whole one, none across texts
    texts = [t or "" for _, t in ROWS]
    import pyarrow as pa

    def all_crcs():
        out = []
        for lo, _, buf, offs in tx.parts(pa.array(texts)):
            for row, crc in importance.features(buf, offs)[1]:
                out += [(lo + int(k), int(c)) for k, c in zip(row, crc, strict=True)]
        return Counter(out)

    want = Counter((k, zlib.crc32(g.encode())) for k, t in enumerate(texts) for g in grams(t)[1])
    assert all_crcs() == want
    monkeypatch.setattr(importance, "STRETCH", 7)
    assert all_crcs() == want


# --- 12


def test_best_cuts_are_best():
    r = random.Random(4)
    for _ in range(300):
        width = r.choice([8, 16, 32])
        powers = tuple(p for p in (2, 4, 8, 16) if p < width)
        at = [0]
        while len(at) < r.randint(2, 25):
            at.append(at[-1] + r.randint(1, width))
        cost = [0, *[r.choice([0, 2, 5]) for _ in at[1:]]]
        least = [0] + [math.inf] * (len(at) - 1)

        def price(i, j):
            n = at[j] - at[i]
            return (0 if n in powers else width - n) + cost[j] + packing.SEQUENCE

        for j in range(1, len(at)):
            least[j] = min(least[i] + price(i, j) for i in range(j) if at[j] - at[i] <= width)
        cuts = packing.best_cuts(np.array(at), np.array(cost), width, powers).tolist()
        assert cuts[0] == 0 and cuts[-1] == at[-1]
        where = [at.index(c) for c in cuts]
        assert all(0 < b - a <= width for a, b in zip(cuts, cuts[1:], strict=False))
        assert sum(price(i, j) for i, j in zip(where, where[1:], strict=False)) == least[-1]


def check_pieces(rows, pieces, width=1024):
    """Every id in one piece, sequences gapless; returns the padded share."""
    enc = tokens.Encoder(tokens.public_tokenizer())
    ids = defaultdict(list)
    for i, t in rows:
        ids[i].append(np.frombuffer(enc.plain(t or ""), enc.kind).astype("<u4").tolist() + [0])
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_seq[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, held in ids.items():
        assert sum(p.length for p in by_doc[i]) == sum(map(len, held))
        for p in by_doc[i]:
            assert p.length > 0
            assert any(len(x) == p.doc_tokens and zlib.crc32(np.array(x[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32 for x in held)
        if len(held) == 1:
            at = 0
            for p in sorted(by_doc[i], key=lambda p: p.start):
                assert p.start == at
                at += p.length
    total = padding = 0
    for held in by_seq.values():
        at = 0
        for p in sorted(held, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= width
        total += at
        padding += 0 if at & (at - 1) == 0 else width - at
    return padding / total


def test_pieces(docs, none):
    pieces = packing.pack(docs, chunk=3000).collect()
    check_pieces(ROWS, pieces)
    order = lambda p: (p.doc_id is not None, p.doc_id or 0)
    seen = [order(p) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset))]
    assert seen == sorted(seen)
    assert packing.pack(none).count() == 0


def test_little_padding_on_documents(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert check_pieces(rows, registry.QUERIES["op12_packing"](spark, SF).collect()) < 0.02


def test_sequences_hold_the_ids(docs):
    enc = tokens.Encoder(tokens.public_tokenizer())
    rows = packing.sequences(packing.pack(docs, chunk=2000, with_ids=True)).collect()
    stream = []
    for r in sorted(rows, key=lambda r: r.sequence_id):
        assert len(r.ids) == 4 * r.length
        stream += np.frombuffer(r.ids, "<u4").tolist()
    want = Counter()
    for _, t in ROWS:
        want.update([*np.frombuffer(enc.plain(t or ""), enc.kind).tolist(), 0])
    assert Counter(stream) == want


# --- 13


def brute_runs(w):
    n, out = len(w), []
    for p in range(1, n // 4 + 1):
        k = 0
        while k < n - p:
            s = k
            while k < n - p and w[k] == w[k + p]:
                k += 1
            x = w[s : k + p]
            if k > s and len(x) >= max(6, 4 * p) and not any(x[q:] == x[:-q] for q in range(1, p)):
                out.append((s, len(x), p))
            k += 1
    return sorted(out, key=lambda r: (r[0], r[2]))


def brute_row(i, text):
    w = WORD.findall(text or "")
    n = len(w)
    h = 1 if i is None else zlib.crc32(str(i).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w) if n < 5000 else [(0, n, 1)]
    gone = {k for s, m, p in runs for k in range(s + p, s + m)}
    best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=(None,) * 3)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (i, len(runs), *best, None if best[0] is None else 1000 * best[1] // best[2], sha("".join(f"{s},{m},{p}\n" for s, m, p in runs)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_find_runs():
    r = random.Random(1)
    for _ in range(150):
        made = []
        for _ in range(r.randint(1, 6)):
            d = [r.randint(0, r.choice([1, 2, 8])) for _ in range(r.randint(0, 60))]
            if len(d) > 8 and r.random() < 0.6:
                s, p = r.randrange(len(d)), r.randint(1, len(d) // 5)
                for i in range(s + p, len(d)):
                    d[i] = d[i - p]
            made.append(d)
        got = periodic.find_runs(np.array(sum(made, []), np.int64), np.append(0, np.cumsum([len(d) for d in made])))
        assert [tuple(x) for x in got.tolist()] == [(k, *x) for k, d in enumerate(made) for x in brute_runs(d)]


def test_extensions_and_minima():
    r = np.random.default_rng(3)
    for n in (1, 15, 16, 17, 900):
        v = r.integers(0, 50, n)
        m = periodic.RangeMin(v)
        lo = r.integers(0, n, 200)
        hi = np.minimum(lo + r.integers(0, n, 200), n - 1)
        assert m.query(lo, hi).tolist() == [v[a : b + 1].min() for a, b in zip(lo, hi, strict=True)]
    starts = np.array([0, 40, 40, 41, 160])
    w = r.integers(0, 2, 160)
    e = periodic.Extensions(w, starts)
    for a, b in r.integers(41, 160, (300, 2)).tolist():
        if a != b:
            k = 0
            while max(a, b) + k < 160 and w[a + k] == w[b + k]:
                k += 1
            assert e.between(np.array([a]), np.array([b]))[0] == k


def test_periodic_query(spark, docs, none, tmp_path, monkeypatch):
    more = ROWS + [(k, "a b c d e f g h " * (k % 9 + 1)) for k in range(1000, 1150)]
    frame(spark, more).write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter(brute_row(i, t) for i, t in more)
    assert counted(registry.QUERIES["op13_periodic_runs"](spark, str(tmp_path))) == want
    assert periodic.periodic_runs(none).count() == 0
    plain = {r.doc_id: r.collapsed for r in periodic.periodic_runs(docs.where("doc_id IN (62, 2) OR doc_id IS NULL")).collect()}
    assert plain[62] == "y"


def test_pairs_in_small_lots(monkeypatch):
    monkeypatch.setattr(periodic, "PAIRS", 50)
    test_find_runs()


class Counted:
    """A tokenizer that counts the characters its whole chain is given."""

    def __init__(self, tok):
        self.tok, self.chars = tok, 0

    def __getattr__(self, name):
        return getattr(self.tok, name)

    def encode(self, text, **options):
        self.chars += len(text)
        return self.tok.encode(text, **options)

    def encode_batch_fast(self, given, **options):
        self.chars += sum(map(len, given))
        return self.tok.encode_batch_fast(given, **options)


def test_latin_words_go_straight_to_the_pairs():
    enc = tokens.Encoder(tokens.public_tokenizer(), cache=300)
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    r = random.Random(8)
    texts = ["".join(r.choices(letters, k=r.randint(1, 9))) for _ in range(1500)] + letters
    texts = [r.choice([" ", "\n"]).join(texts[i : i + 7]) for i in range(0, len(texts), 7)]
    whole = [enc.plain(t) for t in texts]
    enc.tok = Counted(enc.tok)
    assert [enc.encode(t) for t in texts] == whole
    assert enc.tok.chars == 0
    assert enc.encode("straße 12, x") == enc.plain("straße 12, x") and enc.tok.chars > 0
