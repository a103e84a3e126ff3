"""Operator 10: personal data by a semi-Markov conditional random field.

Base detectors (fixed patterns of the contract) give e-mail, IP, card and phone
spans.  The model adds spans: a text is cut at white space, and runs of chunks
that hold a digit or ``@`` are regions.  Inside a region every run of up to
``MAX_CHUNKS`` chunks is a candidate segment, scored as a whole (shape, digit
count, Luhn sum, octets, separators, the word before it) for each type, plus a
score for the type of the segment before it.  A Viterbi pass over segment ends
chooses boundaries and types jointly; its cost is chunks x MAX_CHUNKS x types
squared.  A chunk without digit or ``@`` is always outside, so cutting a text
into regions gives the same optimum as one pass over all of it.  Weights are
trained here, by gradient ascent on the conditional log-likelihood (semi-Markov
forward-backward) of seeded template sentences; ``train`` is deterministic.

Nulls and empty texts: no spans, zero counts.  Model spans that overlap a base
span are dropped: base spans stay as they are.  Texts of any length are handled
whole, in linear time.  Ties: of equal scores the Viterbi pass keeps the segment it met first.  Repeated rows give equal results; other columns pass by,
whatever their names.  Empty table: no rows.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import documents

#: Order of kinds in digests: those of the base contract, then the model's own.
KINDS = ("email", "ip", "card", "phone", "secret")
LABELS = ("O", *KINDS)
MAX_CHUNKS = 5
TYPE = "struct<n_email:bigint,n_ip:bigint,n_card:bigint,n_phone:bigint,base_sha256:string,spans:string>"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_STRIP_L, _STRIP_R = "\"'<>[]{},.;:!?#$%&*|=~`", "\"'<>[]{},.;:!?#$%&*|=~`-"
_TRIGGER = np.zeros(256, bool)
_TRIGGER[[*range(48, 58), 64]] = True
_HEAD = (np.arange(256) & 0xC0) != 0x80


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind number, start, end) of the contract's detectors, by kind, then start."""
    out: list[tuple[int, int, int]] = []
    at, floor = text.find("@"), 0
    while at >= 0:
        s = at
        while s > floor and text[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((0, s, m.end()))
        floor = m.end() if m else at + 1  # a failed local part never reaches over this @
        at = text.find("@", floor)
    for m in _CHAIN.finditer(text):
        if m[0].count(".") < 3:
            continue
        pieces, pos = m[0].split("."), m.start()
        for i in range(0, len(pieces) - 3, 4):
            four = pieces[i : i + 4]
            end = pos + sum(map(len, four)) + 3
            if all(len(x.lstrip("0")) <= 3 and int(x[-4:]) <= 255 for x in four):
                out.append((1, pos, end))
            pos = end + 1
    for m in _CARD.finditer(text):
        d = _NOT_DIGIT.sub("", m[0])
        if 16 <= len(d) <= 19 and luhn(d):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def digest(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


# --- the model -----------------------------------------------------------------

_RUN = re.compile(r"[0-9]+|[A-Za-z\u0080-￿]+|\s+")
_HINTS = frozenset(("token", "key", "secret", "password", "passwd", "api", "auth", "tel", "phone", "call", "fax", "mobile", "card", "visa", "ip", "host", "server", "mail", "email", "version", "v", "page", "room", "on", "the", "="))


def _shape(m: re.Match) -> str:
    x = m[0]
    if x[0].isspace():
        return "_"
    if x[0] <= "9":
        return f"9{min(len(x), 20)}"
    return "a"


@lru_cache(maxsize=100_000)
def segment_features(s: str, chunks: int, before: str) -> tuple[str, ...]:
    """Features of a whole candidate span."""
    digits = _NOT_DIGIT.sub("", s)
    d, n = len(digits), len(s)
    letters = sum(c.isalpha() for c in s)
    f = ["bias", f"chunks{chunks}", f"digits{min(d, 22)}", "shape" + _RUN.sub(_shape, s)[:60], f"dots{min(s.count('.'), 5)}", f"dash{min(s.count('-'), 5)}", f"at{min(s.count('@'), 2)}"]
    if s[:1] == "+":
        f.append("plus")
    if "(" in s or ")" in s:
        f.append("paren" if s.count("(") == s.count(")") else "unbalanced")
    if 13 <= d <= 19 and not letters:
        f.append("luhn" if luhn(digits) else "no_luhn")
    if letters and d and n >= 16 and re.fullmatch(r"[0-9A-Za-z_-]+", s):
        f.append("opaque16" if n < 24 else "opaque24")
    four = s.split(".")
    if len(four) == 4 and all(x.isascii() and x.isdigit() for x in four):
        f.append("octets" if all(len(x) < 4 and int(x) < 256 for x in four) else "no_octets")
    f.append("letters" if letters else "no_letters")
    f.append(f"before_{before}" if before in _HINTS else "before")
    return tuple(f)


class SemiCRF:
    """Weights of features by type, and of type pairs."""

    def __init__(self) -> None:
        self.w: dict[str, np.ndarray] = {}
        self.t = np.zeros((len(LABELS), len(LABELS)))

    def scores(self, feats: tuple[str, ...], length: int) -> np.ndarray:
        out = np.zeros(len(LABELS))
        for f in feats:
            v = self.w.get(f)
            if v is not None:
                out = out + v
        if length > 1:
            out = out.copy()
            out[0] = -np.inf  # outside is one chunk at a time
        return out

    def lattice(self, region: list[tuple[str, ...]] | list) -> list[list[np.ndarray]]:
        """scores[end][length - 1] for each candidate; region[end][length - 1] are its features."""
        return [[self.scores(f, k + 1) for k, f in enumerate(ends)] for ends in region]

    def decode(self, region: list) -> list[tuple[int, int, int]]:
        """Best (first chunk, end chunk, label) segments."""
        sc, n = self.lattice(region), len(region)
        best = [np.zeros(len(LABELS))] + [np.full(len(LABELS), -np.inf) for _ in range(n)]
        back: list[list] = [[None] * len(LABELS) for _ in range(n + 1)]
        for end in range(1, n + 1):
            for k, s in enumerate(sc[end - 1]):
                start = end - 1 - k
                prev = best[start][:, None] + self.t if start else self.t[:1]
                by = prev.max(axis=0) + s
                arg = prev.argmax(axis=0)
                for y in np.flatnonzero(by > best[end]):
                    best[end][y], back[end][y] = by[y], (start, int(arg[y]))
        out, end, y = [], n, int(best[n].argmax())
        while end:
            start, py = back[end][y]
            out.append((start, end, y))
            end, y = start, py
        return out[::-1]

    def step(self, region: list, gold: list[tuple[int, int, int]], rate: float, decay: float) -> None:
        """One gradient step on the log-likelihood of ``gold``."""
        sc, n, m = self.lattice(region), len(region), len(LABELS)
        lse = np.logaddexp.reduce
        a = [np.full(m, -np.inf) for _ in range(n + 1)]
        a[0][0] = 0.0
        b = [np.full(m, -np.inf) for _ in range(n)] + [np.zeros(m)]
        with np.errstate(invalid="ignore"):
            for end in range(1, n + 1):
                a[end] = lse([lse(a[end - 1 - k][:, None] + self.t, axis=0) + s for k, s in enumerate(sc[end - 1])], axis=0)
            for start in range(n - 1, -1, -1):
                tails = [lse(self.t + (sc[start + k][k] + b[start + k + 1])[None, :], axis=1) for k in range(n - start) if k < len(sc[start + k])]
                b[start] = lse(tails, axis=0)
            z = lse(a[n])
            for end in range(1, n + 1):
                for k, s in enumerate(sc[end - 1]):
                    joint = np.exp(a[end - 1 - k][:, None] + self.t + (s + b[end])[None, :] - z)
                    self.t -= rate * joint
                    p = joint.sum(axis=0)
                    for f in region[end - 1][k]:
                        self.w.setdefault(f, np.zeros(m))
                        self.w[f] -= rate * p
        prev = 0
        for start, end, y in gold:
            self.t[prev, y] += rate
            for f in region[end - 1][end - start - 1]:
                self.w.setdefault(f, np.zeros(m))[y] += rate
            prev = y
        self.t *= 1 - decay


def lattice_features(chunks: list[str], joined, before: str) -> list[list[tuple[str, ...]]]:
    """Features of every candidate by end and length; ``joined(i, j)`` is the text of chunks i..j-1."""
    out = []
    for end in range(1, len(chunks) + 1):
        row = []
        for k in range(min(MAX_CHUNKS, end)):
            i = end - 1 - k
            word = before if i == 0 else chunks[i - 1]
            span = joined(i, end).lstrip(_STRIP_L).rstrip(_STRIP_R)
            extract = segment_features if len(span) <= 200 else segment_features.__wrapped__  # long spans stay out of the cache
            row.append(extract(span, k + 1, word[:40].strip(_STRIP_L + "-").lower()[:20]))
        out.append(row)
    return out


def template_sentence(r: random.Random) -> tuple[str, list[str], list[tuple[int, int, int]]]:
    """(word before, chunks of a region, gold segments) of a random training example."""
    num = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    word = lambda: "".join(r.choice("abcdefghijklmnoprstuvw") for _ in range(r.randint(2, 9)))

    def card() -> str:
        d = num(15)
        d += next(c for c in "0123456789" if luhn(d + c))
        sep = r.choice(["", "", " ", "-"])
        return sep.join(d[i : i + 4] for i in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return r.choice([f"+{r.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{r.randint(1, 99)} {a} {b} {c}", f"+{r.randint(1, 99)}{a}{b}{c}", f"{a}.{b}.{c}", f"00{r.randint(1, 99)} {a} {b} {c}"])

    def secret() -> str:
        return "".join(r.choice(r.choice(["0123456789abcdef", "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJK"])) for _ in range(r.randint(18, 48))) + num(1)

    makers = {
        1: lambda: f"{word()}{r.choice(['', '.', '_'])}{r.choice(['', num(2)])}@{word()}{r.choice(['', num(1)])}.{r.choice(['com', 'org', word() + '.net'])}",
        2: lambda: ".".join(str(r.randint(0, 255)) for _ in range(4)) + r.choice(["", "", ":" + num(4)]),
        3: card,
        4: phone,
        5: secret,
        0: lambda: r.choice([num(r.randint(1, 5)), num(r.randint(6, 12)), f"{num(1)}.{num(1)}", f"{num(2)}.{num(1)}.{num(1)}", f"{num(4)}-{num(2)}-{num(2)}", f"{num(2)}:{num(2)}", f"${num(3)}.{num(2)}", f"{num(2)}%", f"{word()}{num(2)}", f"@{word()}", f"{num(3)},{num(3)}", f"{num(16)}"]),
    }
    chunks: list[str] = []
    gold: list[tuple[int, int, int]] = []
    for _ in range(r.choice([1, 1, 1, 2, 2, 3])):
        y = r.choice([0, 0, 1, 2, 3, 4, 5])
        got = makers[y]()
        got = r.choice(["", "", "", '"', "'"]) + got if y else got
        got += r.choice(["", "", "", ".", ",", '"', "!!", "###", "$$$"])
        new = got.split(" ")
        if y:
            gold.append((len(chunks), len(chunks) + len(new), y))
        else:
            gold += [(len(chunks) + i, len(chunks) + i + 1, 0) for i in range(len(new))]
        chunks += new
    return r.choice([word(), word(), "the", "on", "token", "call", "version", "="]), chunks, gold


@lru_cache(maxsize=4)
def train(examples: int = 900, epochs: int = 6, seed: int = 5) -> SemiCRF:
    r = random.Random(seed)
    data = []
    for _ in range(examples):
        before, chunks, gold = template_sentence(r)
        data.append((lattice_features(chunks, lambda i, j, c=chunks: " ".join(c[i:j]), before), gold))
    model = SemiCRF()
    for k in range(epochs):
        r.shuffle(data)
        for region, gold in data:
            model.step(region, gold, 0.3 / (1 + k), 1e-4)
    return model


# --- the operator ----------------------------------------------------------------


def model_spans(model: SemiCRF, text: str, chunks: list[tuple[int, int]], before: str) -> list[tuple[int, int, int]]:
    """Spans of one region; ``chunks`` are code-point ranges of ``text``."""
    words = [text[s:e] for s, e in chunks]
    region = lattice_features(words, lambda i, j: text[chunks[i][0] : chunks[j - 1][1]], before)
    out = []
    for i, j, y in model.decode(region):
        if y:
            raw = text[chunks[i][0] : chunks[j - 1][1]]
            s = chunks[i][0] + len(raw) - len(raw.lstrip(_STRIP_L))
            e = chunks[j - 1][1] - (len(raw) - len(raw.rstrip(_STRIP_R)))
            if s < e:
                out.append((y - 1, s, e))
    return out


def _scan(buf: np.ndarray, offs: np.ndarray, model: SemiCRF):
    """(row, base spans, all spans) of the rows that have any trigger."""
    s, e, row = tx.words(buf, offs)
    trig = np.concatenate(([0], np.cumsum(_TRIGGER[buf])))
    hot = np.flatnonzero(trig[e] > trig[s])
    if not len(hot):
        return
    points = np.concatenate(([0], np.cumsum(_HEAD[buf])))
    cs, ce = points[s] - points[offs[row]], points[e] - points[offs[row]]
    cuts = np.flatnonzero(np.diff(row[hot])) + 1
    for group in np.split(hot, cuts):
        r = int(row[group[0]])
        text = buf[offs[r] : offs[r + 1]].tobytes().decode("utf-8", "surrogatepass")
        base = base_spans(text)
        taken = sorted((b, f) for _, b, f in base)
        extra = []
        for region in np.split(group, np.flatnonzero(np.diff(group) > 1) + 1):
            first = int(region[0])
            before = text[cs[first - 1] : ce[first - 1]] if first and row[first - 1] == r else ""
            extra += model_spans(model, text, [(int(cs[i]), int(ce[i])) for i in region], before)
        extra.sort(key=lambda x: x[1])
        i = 0
        kept = []
        for k, b, f in extra:  # both sorted by start: one sweep drops model spans that meet a base span
            while i < len(taken) and taken[i][1] <= b:
                i += 1
            j = i
            while j < len(taken) and taken[j][0] < f and taken[j][1] <= b:
                j += 1
            if j == len(taken) or taken[j][0] >= f:
                kept.append((k, b, f))
        yield r, base, base + kept


def find(text: Column, model: SemiCRF | None = None) -> Column:
    """Struct of the digests of each whole text (Arrow UDF)."""
    fitted = model or train()
    empty = hashlib.sha256(b"").hexdigest()

    @F.arrow_udf(TYPE)
    def run(column: pa.Array) -> pa.Array:
        n = len(column)
        counts = np.zeros((4, n), np.int64)
        shas, spans = [empty] * n, [""] * n
        for lo, _, buf, offs in tx.parts(column):
            for r, base, every in _scan(buf, offs, fitted):
                for k, _, _ in base:
                    counts[k, lo + r] += 1
                shas[lo + r] = hashlib.sha256(digest(base).encode()).hexdigest()
                spans[lo + r] = digest(every)
        cols = [pa.array(c) for c in counts] + [pa.array(shas, pa.string()), pa.array(spans, pa.string())]
        return pa.StructArray.from_arrays(cols, names=["n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run(text)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", find(F.col("text")).alias("_p")).select("doc_id", "_p.*")


