"""The llm operators against brute force on small tables, and their edge cases."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from weftgraph.llm import decontamination, jaccard, language_model, licenses, mixing, pii, quality, substrings, suffixes, tokens
from weftgraph.llm import _text as tx

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def make_rows(seed=3, n=50):
    """Documents with shared passages, exact copies, a null, an empty one and a long one."""
    r = random.Random(seed)
    voc = ["the", "of", "Zeta", "é1", "##", "x|y", "THE", "und", "ça", "42", "mit", "license"]
    base, rows = [], []
    for i in range(n):
        w = []
        goal = r.choice([0, 4, 30, 80, 150])
        while len(w) < goal:
            if r.random() < 0.4 and base:
                b = r.choice(base)
                k = r.randrange(len(b))
                w += b[k : k + r.randint(1, 70)]
            else:
                w += [r.choice(voc) + r.choice(["", "", str(r.randint(0, 30))]) for _ in range(r.randint(1, 9))]
        if w:
            base.append(w)
        text = "".join(x + r.choice([" ", " ", " ", "\n", "  ", "\t"]) for x in w)
        rows.append((i, text, r.choice(["en", "de", None]), r.choice(["a", "b", "b", "b", None]), len(text)))
    rows += [(n, None, "en", "a", 0), (n + 1, "", None, None, 0), (None, rows[7][1], "en", "b", 0), rows[8], rows[8], (n + 2, "y " * 3000, "en", "b", 6000), (n + 3, rows[12][1], "de", "b", 1)]
    return rows


ROWS = make_rows()
TEXTS = [(r[0], r[1] or "") for r in ROWS]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows_of(df):
    return Counter(tuple(r) for r in df.collect())


# --- kernels


def test_minima_and_words():
    r = np.random.default_rng(1)
    for _ in range(200):
        h = r.integers(0, 6, r.integers(1, 60)).astype(np.uint64)
        w = int(r.integers(1, 12))
        want = [i + int(np.argmin(h[i : i + w])) for i in range(len(h) - w + 1)]
        assert tx.minima(h, w).tolist() == want
    text = " a\x1cb\t\xa0c\n\nd "
    buf = np.frombuffer(text.encode(), np.uint8)
    s, e, _ = tx.words(buf, np.array([0, len(buf)]))
    assert [bytes(buf[i:j]).decode() for i, j in zip(s, e, strict=True)] == WORD.findall(text)


# --- 1


def test_mix(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    sizes = Counter()
    for r in ROWS:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    order = sorted([s for s in sizes if s is not None]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    target, full = {}, set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in full)
        open_ = [s for s in order if s not in full]
        target = {s: 3 * sizes[s] if s in full else rest * weight[s] / sum(weight[x] for x in open_) for s in order}
        over = {s for s in open_ if target[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    taken = Counter()
    for r in got:
        assert r._target == pytest.approx(target[r._src])
        assert 0 <= r._copies <= 3
        taken[r._src] += r._copies * r._size
    for s in order:
        assert abs(taken[s] - target[s]) <= max(sum(len(WORD.findall(x[1] or "")) for x in ROWS if x[:2] == r[:2] and x[3] == s) for r in ROWS if r[3] == s)
    assert rows_of(mixing.mix(docs)) == Counter(tuple(r) for r in got)
    assert mixing.mix_documents(docs).agg({"*": "count"}).first()[0] == sum(r._copies for r in got)
    assert mixing.mix(none).count() == 0


def test_inclusion_frequencies(spark):
    """Over many sources alike a document is taken as often as its probability says: by words, the longest for certain."""
    sizes, copies = [5 + 7 * (i % 11) for i in range(40)] + [900], 150
    rows = [(1000 * k + i, " ".join(["w"] * n), f"s{k:03}") for k in range(copies) for i, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(d).collect()
    total = sum(sizes)
    for which, weight in enumerate((5, 2, 1)):
        target = next(r._target for r in got if int(r._src[1:]) % 3 == which)
        assert target == pytest.approx(total * weight * 3 / 8)
        whole, need = divmod(target, total)
        sure, p = set(), []
        while True:  # documents with p >= 1 are certain, the others are rescaled
            lam = (need - sum(sizes[i] for i in sure)) / sum(n * n for i, n in enumerate(sizes) if i not in sure)
            p = [1.0 if i in sure else lam * n for i, n in enumerate(sizes)]
            if max(p) <= 1:
                break
            sure |= {i for i, x in enumerate(p) if x > 1}
        taken = Counter(r._id % 1000 for r in got if int(r._src[1:]) % 3 == which and r._copies > whole)
        rounds = copies // 3
        assert all(taken[i] == rounds for i in sure)
        for low, high in ((0, 30), (30, 60), (60, 99)):
            of = [i for i, n in enumerate(sizes) if low <= n < high]
            want, have = sum(p[i] for i in of) / len(of), sum(taken[i] for i in of) / rounds / len(of)
            assert abs(have - want) < 0.05 + 4 * math.sqrt(want * (1 - want) / rounds / len(of)), (weight, low, have, want)


def test_mix_of_equal_rows(spark):
    rows = [(None, "a b c d", "s")] * 6 + [(1, "e f", "s"), (None, "g h i", "s"), (2, "x " * 50, "t")]
    d = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, _row string")
    got = mixing.mix_documents(d)
    assert got.columns == d.columns
    n = Counter((r.doc_id, r.text) for r in got.collect())
    assert n[(None, "a b c d")] % 6 == 0


# --- 2 and 9


def thue_morse(n, a, b):
    x = [a]
    while len(x) < n:
        x += [b if y == a else a for y in x]
    return x[:n]


def test_no_family_of_texts_collides(spark):
    one, two = ("".join(thue_morse(1024, *ab)) for ab in ("ab", "ba"))
    for joiner in ("", " "):
        x, y = joiner.join(one), joiner.join(two)
        buf = np.frombuffer((x + "\n" + y).encode(), np.uint8)
        s, e = np.array([0, len(x) + 1]), np.array([len(x), len(buf)])
        h = tx.span_hash(buf, s, e)
        assert h[0] != h[1]
        f = quality._features(buf, np.array([0, len(buf)]))
        assert f[3, 0] == 0
    r, g = jaccard.run_sets(np.frombuffer((one + two).encode(), np.uint8), np.array([0, 1024, 2048]))
    assert g[0] != g[1]
    words = [" ".join(thue_morse(1100, *w)) for w in (("xa", "xb"), ("xb", "xa"))]
    d = spark.createDataFrame(list(enumerate([one + " " + "k " * 3, two, *words])), "doc_id long, text string")
    want = Counter((i, n, k, h) for (i, _), (n, k, _, h) in zip(d.collect(), brute_repeats([t.encode().split() for t in (one + " " + "k " * 3, two, *words)], 20, b" ".join), strict=True))
    assert rows_of(substrings.digest(d, 20, 4)) == want


def brute_repeats(seqs, length, join):
    c = Counter(tuple(s[i : i + length]) for s in seqs for i in range(len(s) - length + 1))
    out = []
    for s in seqs:
        gone = [False] * len(s)
        for i in range(len(s) - length + 1):
            if c[tuple(s[i : i + length])] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(s)))
        out.append((len(s), sum(gone), spans, hashlib.sha256(join([x for x, g in zip(s, gone, strict=True) if not g])).hexdigest()))
    return out


@pytest.mark.parametrize("hot", [2_000, 2])
def test_repeats(docs, hot):
    raw = [t.encode() for _, t in TEXTS]
    want = Counter((i, n, k, h) for (i, _), (n, k, _, h) in zip(TEXTS, brute_repeats([t.split() for t in raw], 12, b" ".join), strict=True))
    assert rows_of(substrings.digest(docs, 12, 4, hot=hot, batch_rows=20)) == want
    want = Counter((i, *x) for (i, _), x in zip(TEXTS, brute_repeats(raw, 50, bytes), strict=True))
    assert rows_of(suffixes.digest(docs, 50, 9, hot=hot, batch_rows=20)) == want


def test_repeats_of_nothing(none):
    assert substrings.digest(none).count() == 0
    assert suffixes.digest(none).count() == 0


def test_columns_of_one_group():
    """The aligned construction on random groups, against direct comparison."""
    r = random.Random(2)
    for _ in range(30):
        x, off, n = [], [], []
        for _ in range(r.randint(1, 12)):
            a, b = r.randint(0, 6), r.randint(0, 6)
            x.append(bytes(r.choice(b"ab") for _ in range(a)) + b"KEY" + bytes(r.choice(b"ab") for _ in range(b + 5)))
            off.append(a)
            n.append(len(x[-1]) - 8 + 1)
        group = np.array([r.randint(0, 1) for _ in x])
        got = suffixes.columns(group, np.array(off), np.array(n), x, 8)
        for i in range(len(x)):
            for k in range(n[i]):
                twin = any(j != i and group[j] == group[i] and 0 <= (p := k - off[i] + off[j]) < n[j] and x[j][p : p + 8] == x[i][k : k + 8] for j in range(len(x)))
                assert bool(got[i][k]) == twin


# --- 3


def test_decontamination(spark, none):
    item = "We know John Smith has 12 apples and buys 7 km of rope for Mary each 3 days said Smith again"
    rows = [
        (1, "Noise before. " + item + " after"),
        (2, "We know Tom Jones has 15 apples and buys 9 miles of rope for Ann each 4 days said Jones again"),
        (3, "We know Tom Jones has 15 apples"),
        (4, None),
        (5, ""),
        (None, item),
    ]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(9, item), (10, None), (11, "too short"), (12, "one two three four five six")], "item_id long, text string")
    got = {(r.id, r.item): r.changed for r in decontamination.contaminated(d, bench).collect()}
    assert set(got) == {(1, 9), (2, 9), (None, 9)}
    assert got[(1, 9)] == 0 and got[(2, 9)] > 0
    shuffled = "We know Tom Jones has 15 apples and buys 9 km of rope for Ann each 4 days said Brown again"
    mixed = spark.createDataFrame([(1, shuffled)], "doc_id long, text string")
    assert decontamination.contaminated(mixed, bench, consistent=1.0).count() == 0  # Smith is Jones once, Brown once
    assert decontamination.contaminated(mixed, bench, consistent=0.8).count() == 1
    kept = decontamination.decontaminate(d, bench)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5]
    assert decontamination.decontaminate(none, bench).count() == 0
    assert decontamination.contaminated(d, bench.where("false")).count() == 0
    short = spark.createDataFrame([(1, "x one two three four five six y")], "doc_id long, text string")
    assert decontamination.contaminated(short, bench).count() == 1


def test_decontamination_of_number_rich_items(spark):
    item = "Sort the numbers 34 12 7 95 61 23 88 5 42 16 77 30"
    bare = "34 12 7 95 61 23 88 5 42 16 77 30"
    bench = spark.createDataFrame([(1, item), (2, bare + " 99")], "item_id long, text string")
    rows = [(1, "so we ask. " + item + " now"), (2, "x " + bare + " 99 y"), (3, "1 2 3 4 5 6 7 8 9 10 11 12 13")]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert {(1, 1), (2, 2)} <= {(r.id, r.item) for r in got.collect()}
    assert got.where("id = 3").count() == 0


def test_decontamination_of_names_that_open_sentences(spark):
    item = "Anna has 5 apples. Anna buys 3 more. Bob takes 2 of them. Bob eats 1 himself. Anna counts the rest now."
    german = "der alte Mann sah den Hund und das kleine Kind im Garten neben dem Haus am Fluss"
    bench = spark.createDataFrame([(1, item), (2, german)], "item_id long, text string")
    wrapped = "".join(w + ("\n" if n[:1].isupper() else " ") for w, n in zip(german.split(), [*german.split()[1:], ""], strict=True))
    rows = [(1, item.replace("Anna", "Carla").replace("Bob", "Tom").replace("5", "8")), (2, wrapped), (3, item.lower())]
    got = {(r.id, r.item) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert {(1, 1), (2, 2)} <= got


def test_decontamination_maps_names_both_ways(spark):
    bench = spark.createDataFrame([(1, "we ask whether Anna Bell and Otto Kern and Paul Lenz and Rosa Maus ever met before that day")], "item_id long, text string")
    same = "we ask whether {} and {} and {} and {} ever met before that day"
    rows = [(1, same.format("Ida Ross", "Tom Hill", "Max Wolf", "Eva Stein")), (2, same.format("Ida Ross", "Ida Ross", "Ida Ross", "Ida Ross"))]
    got = decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench)
    assert [r.id for r in got.collect()] == [1]


def test_decontamination_of_periodic_texts(spark):
    bench = spark.createDataFrame([(1, "la " * 40), (2, "one two three four " * 9)], "item_id long, text string")
    rows = [(1, "la " * 3000), (2, "one two three four " * 2000), (3, "la la la la la"), (4, "four three two one " * 50)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (decontamination.FILTER, 0):
        got = {(r.id, r.item): r.share for r in decontamination.contaminated(d, bench, filter_rows=limit).collect()}
        assert got == {(1, 1): 1.0, (2, 2): 1.0}


def brute_template(text):
    """[(word, kind of slot or 0) by reading] and the words, of a text in plain ASCII."""
    readings, low = [[], []], []
    lines = text.split("\n")
    words = [(w, k > 0) for line in lines for k, w in enumerate(WORD.findall(line))]
    previous = None
    for w, inside in words:
        core = w.strip("".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())) or w
        number, name = core[0].isdigit(), core[0].isupper() and len(core) > 1 and not core[1].isupper()
        unit = bool(previous and previous[0].isdigit() and not number and core.lower() in decontamination.UNITS)
        ends = previous_raw[-1] in ".!?:;" if previous else True
        for i, is_name in enumerate((name, name and inside and not ends)):
            kind = 1 if number else 3 if unit else 2 if is_name else 0
            readings[i].append((("#", "number", "name", "unit")[kind] if kind else core.lower(), kind))
        low.append(core.lower())
        previous, previous_raw = core, w
    return readings, low


def brute_leaks(docs, items, n=8):
    """(document, item) by all places against all places."""
    out = set()

    def windows(text, size):
        readings, low = brute_template(text)
        for i in range(len(low) - size + 1):
            rich = [sum(not k for _, k in r[i : i + size]) >= 3 for r in readings]
            for which, r in enumerate(readings):
                if which == 1 and rich[1]:
                    yield i, rich[1], False, ("t", *[w for w, _ in r[i : i + size]]), [(low[i + j], k) for j, (_, k) in enumerate(r[i : i + size]) if k]
                if which == 0:
                    key = ("t", *[w for w, _ in r[i : i + size]]) if rich[0] else ("e", *low[i : i + size])
                    yield i, rich[1], True, key, [(low[i + j], k) for j, (_, k) in enumerate(r[i : i + size]) if k]

    for item, it in items:
        size = min(n, len(brute_template(it)[1]))
        if size < 5:
            continue
        of = defaultdict(list)
        for x in windows(it, size):
            of[x[3]].append(x)
        total = len(brute_template(it)[1]) - size + 1
        rich_total = len({x[0] for xs in of.values() for x in xs if x[1]})
        for doc, text in docs:
            diag = defaultdict(list)
            for x in windows(text, size):
                for y in of.get(x[3], []):
                    diag[x[0] - y[0]].append((y[0], y[1], not x[2] and not y[2], list(zip(y[4], x[4], strict=True))))
            at = set()
            for hits in diag.values():
                for use in (hits, [h for h in hits if h[2]]):
                    pairs = {(b[0], d[0], b[1]) for h in use for b, d in h[3]}
                    names = {p for p in pairs if p[2] == 2}
                    if use and len({(p[0], p[2]) for p in pairs}) >= 0.8 * len(pairs) and len({p[1] for p in names}) >= 0.8 * len(names):
                        at |= {h[:2] for h in use}
                        break
            rich = sum(x[1] for x in at)
            if at and max(len(at) / total, rich / rich_total if rich_total else 0) >= 0.5:
                out.add((doc, item))
    return out


def test_decontamination_against_brute_force(spark):
    r = random.Random(12)
    plain, names, units = "the of we ask how many each has then for much left".split(), "Anna Bob Carla Dirk Otto".split(), ["km", "kg", "days"]

    def sentence(k):
        w = []
        while len(w) < k:
            w += r.choice([[r.choice(plain)], [r.choice(plain)], [r.choice(plain)], [r.choice(names)], [str(r.randint(1, 99)), r.choice(units)], [str(r.randint(1, 99)) + r.choice([".", ",", ""])]])
        return w

    items = [(k, " ".join(sentence(r.choice([4, 6, 9, 14, 30])))) for k in range(25)]
    docs = []
    for k in range(60):
        w = sentence(10)
        for _ in range(2):
            part = r.choice(items)[1].split()
            part = part[: r.randint(max(1, len(part) // 3), len(part))]
            swap = dict(zip(names, r.sample(names, len(names)), strict=True)) if r.random() < 0.5 else {}
            w += [swap.get(x, str(r.randint(1, 99)) if x.isdigit() and swap and r.random() < 0.7 else x) for x in part] + sentence(5)
        docs.append((k, "".join(x + r.choice([" ", " ", " ", "\n"]) for x in w)))
    got = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {(x.id, x.item) for x in got.collect()} == brute_leaks(docs, items)


# --- 4


def test_scores_against_brute_force(docs):
    """The whole model written out: counts, deleted counts, histogram, weights, mixed probabilities."""
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tok = [[*t.encode().translate(lower).split(), None] for _, t in TEXTS]
    fold = [0 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in TEXTS]

    def counts(use):
        uni, bi = Counter(), Counter()
        for t, f in zip(tok, fold, strict=True):
            if use(f):
                uni.update(t)
                bi.update(zip([None, *t], t))
        return uni, bi

    (u, b), (du, db) = counts(lambda f: f != 2), counts(lambda f: f == 3)
    total, classes = sum(u.values()), len(u) + 1
    cells = Counter()
    for (v, w), n in db.items():
        ctx = u[v] - du[v]
        p = ((b[v, w] - n) / ctx if ctx else 0.0, (u[w] - du[w]) / (total - sum(du.values())))
        cells[(math.floor(math.log2(ctx + 1)), *[round(-math.log2(x) * language_model.STEP) if x else -1 for x in p])] += n
    weights = language_model.expectation_maximisation(np.array(sorted((*k, n) for k, n in cells.items()), float), classes)
    assert np.allclose(weights.sum(axis=1), 1)
    want = []
    for (i, _), t in zip(TEXTS, tok, strict=True):
        s = 0.0
        for v, w in zip([None, *t], t):
            l = weights[math.floor(math.log2(u[v] + 1))] if u[v] else weights[0] + [0, weights[0][2], 0]
            s += math.log10(l[2] * (b[v, w] / u[v] if u[v] else 0) + l[1] * u[w] / total + l[0] / classes)
        want.append((str(i), len(t), s))
    for options in ({}, {"head_words": 12, "part_tokens": 300, "stable": False}, {"head_words": 0}):  # the head changes no score
        got = sorted((str(r.doc_id), r.n_tokens, r.score) for r in language_model.score(docs, **options).collect())
        for g, w in zip(got, sorted(want), strict=True):
            assert g[:2] == w[:2] and g[2] == pytest.approx(w[2])
    assert rows_of(language_model.score(docs, stable=False).select("doc_id", "n_known")) == rows_of(language_model.score(docs).select("doc_id", "n_known"))


@pytest.mark.parametrize("head", [1 << 20, 10])
def test_language_model(docs, head):
    lower = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    tok = [[*t.encode().translate(lower).split(), None] for _, t in TEXTS]
    fold = [0 if i is None else zlib.crc32(str(i).encode()) % 7 for i, _ in TEXTS]
    c = Counter(x for t, f in zip(tok, fold, strict=True) if f != 2 for x in t)
    n, v = sum(c.values()), len(c)
    got = sorted((tuple(r) for r in language_model.score(docs, head).collect()), key=str)
    want = sorted(((i, f == 2, len(t), sum(c[x] > 0 for x in t), n, sum(math.log10((c[x] + 1) / (n + v + 1)) for x in t)) for (i, _), f, t in zip(TEXTS, fold, tok, strict=True)), key=str)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[5] == pytest.approx(w[5])
        assert g[6] <= 0
    # repeated passages are more likely under the bigram
    assert sum(g[6] for g in got) > sum(g[5] for g in got)


def test_the_head_changes_no_score(docs):
    got = [{(r.doc_id, r.n_tokens, round(r.base_score, 6)): r.score for r in language_model.score(docs, head).collect()} for head in (1 << 20, 10, 0)]
    assert got[0].keys() == got[1].keys() == got[2].keys()
    for k, v in got[0].items():
        assert got[1][k] == pytest.approx(v) and got[2][k] == pytest.approx(v)


def test_gathered_ranges_of_parts_change_no_score(docs):
    want, got = ({(r.doc_id, r.n_tokens, round(r.base_score, 6)): r for r in language_model.score(docs, 40, **kw).collect()} for kw in ({}, {"part_tokens": 60, "fan": 3}))
    assert want.keys() == got.keys()
    for k, w in want.items():
        assert got[k][:5] == w[:5]
        assert got[k].score == pytest.approx(w.score)


def test_blobs_of_many_chunks_are_gathered_by_part(monkeypatch):
    lm, r = language_model, np.random.default_rng(5)
    slots, parts, width, want, rows = 50, 12, 4, Counter(), []
    for chunk in range(9):
        base = chunk << 40
        doc = np.repeat(np.arange(20), 30)
        pair = r.integers(0, 40, len(doc)) * slots + r.integers(0, 40, len(doc))
        want.update(zip((pair // slots).tolist(), (pair % slots).tolist(), (doc + base).tolist(), strict=True))
        got = lm._grouped(pair, doc, np.zeros(20, np.int64))
        part = lm._part_of(lm.PAIR, [got[0] // slots, got[0] % slots], slots, parts) // width
        rows += [(p, lm.PAIR, base, lm._store(lm.PAIR, [key // slots, key % slots], *rest, 0)) for p, key, *rest in lm._split(part, *got)]
        rows.append((0, lm.DOC, base, b"d"))
    rows.sort(key=lambda x: x[:3])
    monkeypatch.setattr(lm, "GATHER", 3000)

    class Head:
        value = type("", (), {"slots": slots})

    out = [tuple(x) for b in lm._gather(Head, parts)([lm._rows(rows)]) for x in zip(*[c.to_pylist() for c in b.columns], strict=True)]
    assert len({x[0] for x in out if x[1] == lm.PAIR}) == parts and sum(x[1] == lm.DOC for x in out) == 9
    have = Counter()
    for part, kind, base, data in out:
        if kind == lm.PAIR:
            names, train, _, docs, doc, cnt = lm._open(kind, data, base)
            assert (lm._part_of(kind, names, slots, parts) == part).all()
            assert len({*zip(names[0].tolist(), names[1].tolist(), strict=True)}) == len(train) and train.sum() == cnt.sum()
            for v, w, d, n in zip(np.repeat(names[0], docs).tolist(), np.repeat(names[1], docs).tolist(), doc.tolist(), cnt.tolist(), strict=True):
                have[v, w, d] += n
    assert have == want


def test_texts_that_change_between_readings_raise(docs):
    def other(batches):
        for b in batches:
            rows = [f"{t or ''} {random.SystemRandom().random()}" for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows)], names=["doc_id", "text"])

    changing = docs.select("doc_id", "text").mapInArrow(other, "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        language_model.score(changing).collect()
    assert language_model.score(changing, stable=False).count() == len(TEXTS)


def test_expectation_maximisation_prefers_the_good_ratio():
    cells = np.array([[3, 4, 40, 100.0], [5, -1, 8, 100.0]])
    w = language_model.expectation_maximisation(cells, 1000)
    assert w[3][2] > 0.9 and w[5][1] > 0.9
    assert np.allclose(w.sum(axis=1), 1)


def test_language_model_of_nothing(none):
    assert language_model.score(none).count() == 0


# --- 5


def test_token_output(docs, none):
    enc = tokens.Encoder(tokens.public_tokenizer())
    got = sorted((tuple(r) for r in tokens.token_output(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((i for i, _ in TEXTS), key=lambda i: (i is not None, i))
    at = 0
    crc = defaultdict(list)
    for i, t in TEXTS:
        ids = [*enc.tok.encode(t, add_special_tokens=False).ids, 0]
        crc[i].append((len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    for doc, start, n, c in got:
        assert start == at
        assert (n, c) in crc[doc]
        at += n
    assert tokens.token_output(none).count() == 0


def test_one_document_by_its_number(spark, docs, tmp_path):
    path = f"file://{tmp_path}/ids"
    tokens.write_ids(docs, path, tokens.public_tokenizer(), segment_ids=700)
    enc = tokens.Encoder(tokens.public_tokenizer())
    rows = tokens.read_ids(spark, path).orderBy("start").collect()
    for number in (0, 1, len(rows) // 2, len(rows) - 1):
        one = tokens.read_document(spark, path, number).collect()
        assert [(r.doc_id, r.start, len(r.ids)) for r in one] == [tuple(rows[number])[:3]]
        assert any([*enc.tok.encode(t, add_special_tokens=False).ids, 0] == one[0].ids for i, t in TEXTS if i == one[0].doc_id)
    assert tokens.read_document(spark, path, len(rows)).count() == 0


def test_encoder_pieces_equal_whole_texts():
    enc = tokens.Encoder(tokens.public_tokenizer(), cache=40)
    r = random.Random(3)
    parts = ["a", "the", " ", "  ", "\n", "\t", "é", "'s", "1", "23", "!", " ", "\x1c", "\xa0", "ñ.", "<|endoftext|>", " word", " other"]
    for _ in range(4000):
        x = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        assert enc.encode(x) == enc.plain(x)


def test_elias_fano():
    r = random.Random(5)
    for _ in range(200):
        v = np.cumsum([r.choice([0, 1, 2, 50, 3000]) for _ in range(r.randint(1, 300))])
        ef = tokens.EliasFano.encode(v)
        assert ef.values().tolist() == v.tolist()
        assert [ef.select(i) for i in range(0, len(v), 7)] == v[::7].tolist()
    doc, ef, ids = tokens.unpack(tokens.pack([None, -4, -4, 2**63 - 1], np.array([1, 3, 8, 8]), bytes(16), 2))
    assert (doc, ef.values().tolist(), len(ids)) == ([None, -4, -4, 2**63 - 1], [1, 3, 8, 8], 8)
    # ids and ends of 1,000 documents in far less than two 64-bit tables
    ends = np.cumsum(np.random.default_rng(2).integers(1, 900, 1000))
    assert len(tokens.pack(list(range(10**9, 10**9 + 1000)), ends, b"", 2)) < 3_000


def test_foreign_tokenizers_are_not_cut(tmp_path):
    import json

    path = tokens.public_tokenizer()
    with open(path, encoding="utf-8") as f:
        made = json.load(f)
    assert tokens.Encoder(path).byte_level
    made["pre_tokenizer"]["add_prefix_space"] = True
    (tmp_path / "t.json").write_text(json.dumps(made))
    enc = tokens.Encoder(str(tmp_path / "t.json"))
    assert not enc.byte_level
    assert enc.encode("one two. three, four") == enc.plain("one two. three, four")


# --- 6


def test_license_scan(spark, docs, none):
    extra = [(900, "x MIT License y GNU\nGeneral Public-License cc by mit license"), (901, "// SPDX-License-Identifier: (MIT OR GPL-2.0-only) AND Apache-2.0\n"), (902, "cc bye mitlicense")]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = Counter(tuple(r)[:6] for r in d.select("doc_id", licenses.scan(d.text).alias("s")).select("doc_id", "s.*").collect())
    want = Counter()
    for i, t in [*TEXTS, *extra]:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        at = [(k, label) for p, label in licenses.BASE_PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[(i, len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at})))] += 1
    assert got == want
    assert none.select(licenses.scan(none.text)).count() == 0


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("MIT", 1.0), ("MIT OR GPL-3.0-only", 1.0), ("MIT AND GPL-3.0-only", 0.3), ("GPL-2.0-only WITH Classpath-exception-2.0", 0.6),
        ("MIT OR GPL-3.0-only AND AGPL-3.0-only", 1.0), ("(MIT OR GPL-3.0-only) AND AGPL-3.0-only", 0.2), ("GPL-3.0-only AND (", 0.3), ("nonsense", None), ("", None),
    ],
)
def test_expressions(text, value):
    got = licenses.evaluate(text)
    assert (got[1] if got else None) == pytest.approx(value)


def test_long_and_unknown_expressions():
    ac = licenses.automaton(licenses.phrase_table())
    got = licenses.scan_text("SPDX-License-Identifier: " + "MIT AND " * 100 + "(GPL-3.0-only)\n", ac)
    assert got[5] == "gpl-3.0-only,mit" and got[6] == pytest.approx(0.3)
    got = licenses.scan_text("// SPDX-License-Identifier: MIT AND LicenseRef-Proprietary", ac)
    assert got[5] == "licenseref-proprietary,mit" and got[6] == 0
    assert licenses.evaluate("MIT OR EUPL-1.2") == (["mit", "eupl-1.2"], 1.0)
    assert licenses.evaluate("OFL-1.1") == (["ofl-1.1"], 0.0)


@pytest.mark.parametrize(
    ("text", "labels", "value"),
    [
        ('"SPDX-License-Identifier: MIT"', "mit", 1.0), ("<!-- SPDX-License-Identifier: MIT-->", "mit", 1.0), ("SPDX-License-Identifier: MIT,GPL-2.0", "gpl-2.0,mit", 0.3),
        ("SPDX-License-Identifier: MIT/Apache-2.0", "apache-2.0,mit", 1.0), ("SPDX-License-Identifier: MIT, see the notice", "mit", 1.0), ("License: MIT", "mit", 1.0),
        ("under GPLv2 or later", "gpl-2.0", 0.3), ('{"license": "MIT"}', "mit", 1.0), ("License: see below", "", 0.0), ("license:mit;apache-2.0", "apache-2.0,mit", 0.95),
    ],
)
def test_punctuation_around_identifiers(text, labels, value):
    got = licenses.scan_text(text, licenses.automaton(licenses.phrase_table()))
    assert got[5] == labels and got[6] == pytest.approx(value)


def test_random_expressions():
    """Expressions built from trees, dressed up: labels are the leaves, the value is that of the tree."""
    r = random.Random(6)
    ac = licenses.automaton(licenses.phrase_table())
    names = ["MIT", "Apache-2.0", "GPL-3.0-only", "LGPL-2.1+", "AGPL-3.0", "MPL-2.0", "ISC"]

    def tree(depth):
        if not depth or r.random() < 0.3:
            x = r.choice(names)
            return x, {x.lower()}, licenses.value_of(x.lower()), 3
        op = r.choice(["AND", "OR"])
        (a, la, va, pa), (b, lb, vb, pb) = tree(depth - 1), tree(depth - 1)
        own = 2 if op == "AND" else 1
        a, b = (x if p >= own and r.random() < 0.7 else f"({x})" for x, p in ((a, pa), (b, pb)))
        return f"{a} {op} {b}", la | lb, min(va, vb) if op == "AND" else max(va, vb), own

    for _ in range(300):
        x, labels, value, _ = tree(4)
        for left, right in (("SPDX-License-Identifier: ", "\n"), ('"SPDX-License-Identifier: ', '"'), ("/* spdx-license-identifier: ", " */"), ('"license": "', '",')):
            got = licenses.scan_text(left + x + right, ac)
            assert set(got[5].split(",")) == labels and got[6] == pytest.approx(value), left + x + right
            assert not re.search(r"[^a-z0-9.+,-]", got[5])


def test_brackets_take_linear_time():
    import time

    ac = licenses.automaton(licenses.phrase_table())
    for part in ("(", "x(", "license=", "(mit or "):
        took = []
        for n in (1 << 17, 1 << 19):
            began = time.process_time()
            licenses.scan_text("GPL-2.0 " + part * (n // len(part)), ac)
            took.append(time.process_time() - began)
        assert took[1] < 8 * took[0] + 0.2, part


def test_identifiers_in_prose():
    ac = licenses.automaton(licenses.phrase_table())
    for text, labels, value in (
        ("Licensed MIT OR Apache-2.0 at your option.", "apache-2.0,mit", 1.0),
        ("see GPL-2.0-only WITH Classpath-exception-2.0 and more", "gpl-2.0-only", 0.6),
        ("(GPL-2.0-only OR MIT) AND AGPL-3.0", "agpl-3.0,gpl-2.0-only,mit", 0.2),
        ("das kommt mit 0 Kosten oder mit 3", "", 0.0),
        ("apache 2 0 and gpl 3 0", "", 0.0),
    ):
        got = licenses.scan_text(text, ac)
        assert got[5] == labels and got[6] == pytest.approx(value), text
    long = licenses.scan_text("x Apache-2.0 AND " + "MIT AND " * 300 + "(GPL-3.0-only) y", ac)
    assert long[5] == "apache-2.0,gpl-3.0-only,mit" and long[6] == pytest.approx(0.3)


# --- 7


def test_quality_features(docs):
    got = rows_of(docs.select("doc_id", quality.features(docs.text).alias("f")).select("doc_id", *[f"f.{x}" for x in quality.BASE]))
    want = Counter()
    for i, t in TEXTS:
        w = WORD.findall(t)
        lines = [x for x in t.split("\n") if WORD.search(x)]
        grams = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        c = Counter(grams)
        cover = {j for k, g in enumerate(grams) if c[g] > 1 for j in range(k, k + 5)}
        want[(i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover))] += 1
    assert got == want


def test_risk_control():
    assert quality.binomial_cdf(0, 10, 0.5) == pytest.approx(0.5**10)
    assert quality.binomial_cdf(3, 7, 0.2) == pytest.approx(sum(math.comb(7, k) * 0.2**k * 0.8 ** (7 - k) for k in range(4)))
    assert quality.cutoff((3.0, 2.0, 1.0), [0, 1, 400], [5, 50, 50], 1000, 0.01, 0.01) == 2.0
    assert quality.cutoff((3.0,), [0], [5], 10, 0.01, 0.01) is None  # too few labels prove nothing
    # over many draws at exactly the limit, a cutoff is accepted no more often than the level
    r = np.random.default_rng(4)
    hits = sum(quality.cutoff((1.0,), [int(r.binomial(2000, 0.02))], [2000], 2000, 0.02, 0.05) is not None for _ in range(2000))
    assert hits / 2000 <= 0.06


def test_quality_filter(spark, none):
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en", "a", 1, "mine") for i in range(3000)] + [(5000 + i, " ".join(f"w{i}x{k}|" for k in range(40)), "en", "a", 1, "mine") for i in range(60)] + [(9000, None, None, "a", 0, "mine"), (9001, "few words", "en", "a", 0, "mine")]
    d = spark.createDataFrame(rows, SCHEMA + ", _f string")
    labels = spark.createDataFrame([(r[0], int(r[0] < 5000)) for r in rows if r[0] % 2 == 0] + [(None, 1), (4, None)], "doc_id long, quality int")
    kept = quality.quality_filter(d, labels)
    assert kept.columns == d.columns
    assert {r.doc_id for r in kept.collect()} == set(range(3000))
    assert quality.quality_filter(none, labels).count() == 0
    assert quality.quality_filter(d, labels.where("false")).count() == 3060


def test_repeating_rows_and_labels_proves_nothing(spark):
    """100 good documents are 100 trials, however often their rows and labels are repeated."""
    good = [(i, " ".join(f"w{i}x{k}" for k in range(40)), "en") for i in range(100)]
    bad = [(500 + i, " ".join(f"v{i}x{k}|" for k in range(40)), "en") for i in range(50)]
    schema = "doc_id long, text string, lang string"
    once = spark.createDataFrame(good + bad, schema)
    marks = spark.createDataFrame([(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad], "doc_id long, quality int")
    for d, m in ((once, marks), (spark.createDataFrame((good + bad) * 30, schema), marks), (once, spark.createDataFrame(marks.collect() * 30, marks.schema))):
        cuts = quality.thresholds(quality.feature_table(d), m).first()._cut
        assert cuts == [None] * len(quality.RULES)  # 100 trials cannot prove alpha / rules
    # a text with a good and a bad label is good: rejecting it counts
    both = marks.union(spark.createDataFrame([(500 + i, 1) for i in range(50)], marks.schema))
    assert quality.thresholds(quality.feature_table(once), both).first()._cut == [None] * len(quality.RULES)


def test_base_rules_take_their_part_of_the_risk():
    assert quality.base_risk(0, 10_000, 0.05, 0.01) == pytest.approx(0.05 * quality.BASE_RISKS[0])
    assert quality.base_risk(180, 10_000, 0.05, 0.01) == pytest.approx(0.025)
    assert quality.base_risk(600, 10_000, 0.05, 0.01) == 0.05
    for k, n, p in ((3, 40, 0.2), (0, 9, 0.5), (700, 2000, 0.36)):
        want = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert quality.binomial_cdf(k, n, p) == pytest.approx(want)


def test_words_of_one_hash_are_two_words(spark):
    """Two words that a mix without a key takes for one: windows with them do not repeat."""
    a, b = "5FNGKXm1aa00a0aa", "2z8hA5Xrh'E[!XT}"
    text = f"one two {a} three four five six seven one two {b} three four"
    got = spark.createDataFrame([(text,)], "t string").select(quality.features("t").alias("f")).first().f
    assert got.n_words == 13 and got.n_repeat_words == 0
    r = np.random.default_rng(4)
    for n, top in ((0, 3), (3, 3), (400, 3), (400, 2**31 - 2)):
        w = r.integers(0, top, n) if top < 9 else np.where(r.random(n) < 0.5, 7, r.integers(0, top, n))
        g = tx.gram_numbers(w, 5)
        runs = [tuple(w[i : i + 5].tolist()) for i in range(n - 4)]
        assert len(g) == len(runs) and len(set(g.tolist())) == len(set(runs)) == len(set(zip(g.tolist(), runs, strict=True)))


# --- 8


def brute_links(texts):
    sets = []
    for t in texts:
        w = t.encode().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)] if w else []))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    n = [0] * len(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j and a and b and 9 * len(a & b) >= 4 * (len(a) + len(b)):
                n[i] += 1
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return [find(i) for i in range(len(sets))], n


def near_rows():
    r = random.Random(8)
    rows = [(i, t) for i, (_, t) in enumerate(TEXTS)]
    base = [f"k{k}" for k in range(120)]
    for i in range(40):
        w = list(base)
        for _ in range(r.randint(0, 6)):
            w[r.randrange(len(w))] = f"e{r.randint(0, 50)}"
        rows.append((100 + i, " ".join(w)))
    return rows


@pytest.mark.parametrize("block", [1500, 6])
def test_jaccard(spark, none, block):
    rows = near_rows()
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    root, n = brute_links([t for _, t in rows])
    low = {}
    for (i, _), c in zip(rows, root, strict=True):
        low[c] = min(i, low.get(c, i))
    want = Counter((i, low[c], k) for (i, _), c, k in zip(rows, root, n, strict=True))
    assert rows_of(jaccard.near_duplicates(d, block=block)) == want
    if block > 1000:
        assert Counter(r.doc_id for r in jaccard.one_of_each(d).collect()) == Counter(low.values())
        assert jaccard.near_duplicates(none).count() == 0


def test_stop_depths():
    assert jaccard.depth_for(0.8, 24, 6, 0.99999) == 4
    assert jaccard.depth_for(0.8, 24, 6, 0.0) == 6
    stop = jaccard.stop_depths((4, 5), 24, 6, 0.99999)
    # sets of 1 to 3 runs link to no other set; 7 runs link at 6 of 7 at least, 6 at 5 of 6, large ones at 0.8
    assert stop[1:9].tolist() == [7, 7, 7, 4, 4, 5, 6, 4]
    for n in range(1, 40):
        best = min((k / (n + m - k) for m in range(1, 60) for k in range(1, min(n, m) + 1) if 5 * k >= 4 * (n + m - k) and (k < n or m > n)), default=None)
        assert (best is None) == (stop[n] == 7)
        if best:
            assert stop[n] == jaccard.depth_for(best, 24, 6, 0.99999)


def test_the_forest_stops_at_different_depths():
    """One node of depth 4: two sets that share all six values, one that shares four, one that is done at six."""
    below = np.array([[1, 1], [1, 1], [1, 2], [3, 3], [3, 4]])
    sketch = np.zeros((5, 2), np.uint64)
    size = np.array([50, 50, 50, 7, 7])
    stop = np.array([4, 4, 4, 6, 6])
    label, depth = jaccard.climb(below, size, sketch, np.zeros(5, np.int8), stop, 4, (4, 5))
    assert label.tolist() == [0, 0, 0, 3, 4]  # sets of 7 runs only match at full length
    assert depth.tolist() == [4, 4, 4, 6, 6] or depth[3] > 4
    far = sketch.copy()
    far[2] = ~far[2]
    label, _ = jaccard.climb(below, size, far, np.zeros(5, np.int8), stop, 4, (4, 5))
    assert label.tolist()[:3] == [0, 0, 2]  # a sketch that contradicts keeps boilerplate apart
    label, _ = jaccard.climb(below, np.array([50, 50, 90, 7, 7]), sketch, np.zeros(5, np.int8), stop, 4, (4, 5))
    assert label.tolist()[:3] == [0, 0, 2]  # sizes that rule a link out


def test_the_forest_compares_less_than_its_shortest_prefix():
    """Random nodes: the same classes as one flat comparison at the shortest prefix, from fewer comparisons, as longer ones have settled the rest."""
    r = np.random.default_rng(6)
    forest, flat = [], []
    for _ in range(200):
        m = int(r.integers(2, 40))
        group = r.integers(0, max(1, m // 6), m)
        sketch = r.integers(0, 2**63, (m, 2)).astype(np.uint64)[group] ^ (np.uint64(1) << r.integers(0, 63, (m, 2)).astype(np.uint64))
        below = np.where(r.random((m, 2)) < 0.7, group[:, None], r.integers(100, 140, (m, 2)))
        size, stop, side = r.integers(30, 36, m), np.full(m, 4), np.zeros(m, np.int8)
        a, _ = jaccard.climb(below, size, sketch, side, stop, 4, (4, 5), forest)
        b, _ = jaccard.climb(below[:, :0], size, sketch, side, stop, 4, (4, 5), flat)
        assert a.tolist() == b.tolist()
    assert sum(forest) < sum(flat)


def test_threshold_in_integers():
    r = random.Random(4)
    for _ in range(50):
        k = r.randint(20, 60)
        a = np.arange(5 * k, dtype=np.uint64)
        b = np.concatenate((a[: 4 * k + r.choice([-1, 0, 1])], np.arange(10**6, 10**6 + k, dtype=np.uint64)))[: 5 * k]
        inter = len(np.intersect1d(a, b))
        links, _ = jaccard.verify(np.array([0, 1]), np.array([1, 1]), np.zeros(2, np.int8), [a, np.sort(b)], (4, 5))
        assert links[0] == (5 * inter >= 4 * (len(a) + len(b) - inter))


def test_clashing_columns(spark):
    """Extra columns named like the operators' own pass through."""
    extra = "node string, task string, _row string, _i string, _h string, _s string, _x string, _size string, h string, class string, w string"
    rows = [(1, "a b c d e f g", "en", "s"), (2, "a b c d e f g", "en", "s"), (3, "h i j k l m n o p q r", None, None), (None, None, "en", "t")]
    d = spark.createDataFrame([(*r, *["x"] * 11) for r in rows], "doc_id long, text string, lang string, source string, " + extra)
    bench = spark.createDataFrame([(1, "h i j k l m n o p q r")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    for out, n in ((jaccard.one_of_each(d), 3), (decontamination.decontaminate(d, bench), 3), (quality.quality_filter(d, labels), 1), (mixing.mix_documents(d), None)):
        assert out.columns == d.columns
        got = out.collect()
        assert n is None or len(got) == n
        assert all(r.node == r["_row"] == "x" for r in got)


# --- 10


def brute_pii(t):
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t):
        out.append((0, *m.span()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((1, *m.span()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
        d = re.sub("[^0-9]", "", m[0])
        if 16 <= len(d) <= 19 and pii.luhn(d):
            out.append((2, *m.span()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t):
        if 8 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def test_base_detectors():
    r = random.Random(1)
    for _ in range(8000):
        t = "".join(r.choice("ab1.@+-4 2(0)5%é") for _ in range(r.randint(0, 40)))
        assert pii.base_spans(t) == brute_pii(t)
    t = "4111 1111 1111 1111 x 4111-1111-1111-1112"
    assert pii.base_spans(t) == brute_pii(t) == [(2, 0, 19)]


def test_decoding_is_the_best_segmentation():
    """Viterbi against every segmentation and labelling of short regions."""
    model, r = pii.train(), random.Random(6)

    def best(region, i, prev):
        if i == len(region):
            return 0.0
        out = -np.inf
        for k in range(min(pii.MAX_CHUNKS, len(region) - i)):
            s = model.scores(region[i + k][k], k + 1)
            for y in range(len(pii.LABELS)):
                if s[y] > -np.inf:
                    out = max(out, s[y] + model.t[prev, y] + best(region, i + k + 1, y))
        return out

    for _ in range(12):
        before, chunks, _ = pii.template_sentence(r)
        region = pii.lattice_features(chunks[:3], lambda i, j, c=chunks: " ".join(c[i:j]), before)
        total, prev = 0.0, 0
        for i, j, y in model.decode(region):
            total += model.scores(region[j - 1][j - i - 1], j - i)[y] + model.t[prev, y]
            prev = y
        assert total == pytest.approx(best(region, 0, 0))


def test_model_on_held_out_sentences():
    model, r = pii.train(), random.Random(99)
    both = either = 0
    for _ in range(200):
        before, chunks, gold = pii.template_sentence(r)
        got = model.decode(pii.lattice_features(chunks, lambda i, j, c=chunks: " ".join(c[i:j]), before))
        a, b = {x for x in gold if x[2]}, {x for x in got if x[2]}
        both, either = both + len(a & b), either + len(a | b)
    assert both / either > 0.95


def test_pii(spark, docs, none):
    extra = [(900, 'é mail a.b@c.de, +1 (017) 555-7713 or 10.0.0.300 1.2.3.4 token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')]
    d = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id long, text string"))
    got = d.select("doc_id", pii.find(d.text).alias("p")).select("doc_id", "p.*").collect()
    want = Counter((i, *[sum(x[0] == k for x in s) for k in range(4)], hashlib.sha256(pii.digest(s).encode()).hexdigest()) for i, t in [*TEXTS, *extra] for s in [brute_pii(t)])
    assert Counter(tuple(r)[:6] for r in got) == want
    found = next(r.spans for r in got if r.doc_id == 900)
    assert "secret:" in found and "email:7:15" in found
    assert none.select(pii.find(none.text)).count() == 0
