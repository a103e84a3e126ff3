"""Operator 6: licence scan.

One Aho-Corasick automaton over the words of a text finds notice phrases (a
place is where all words of a phrase stand consecutively, overlaps included),
the words of ``SPDX-License-Identifier`` tags and identifiers that no prose has (``IDENTIFIERS``: a family with a version
or a kind).  Where tags or identifiers occur, the raw text around them gives expressions, whatever their length:
of a tag up to the end of its line or a ``*``, of an identifier in prose the run of operands joined by
operators that it stands in (``MIT OR Apache-2.0``).  They are read by a shunting-yard parser: WITH binds
tighter than AND, AND tighter than OR, parentheses group.  An expression's
value is the permissiveness of its best permitted reading: OR takes the larger,
AND the smaller operand, WITH adds an allowance.  Every identifier
is a label; one of no known family is taken as ``UNKNOWN``, the most restrictive
value.  Quotes, arrows and full stops around identifiers are not theirs; ``/`` and ``|`` are OR, ``,``, ``;`` and ``&`` AND, so no
label holds a comma.  Fields such as ``license: MIT`` or ``"license": "MIT"`` count if every name in them is of a known
family; ``GPLv2`` is ``gpl-2.0``.  A malformed expression yields its identifiers as labels and the smallest of
their values.  A lone word of no known family is an identifier only with a ``-``
or a digit in it; else it is prose and the tag is passed over.

``score`` is the smallest value over all expressions and phrases found (the
licence that restricts most), 0 where none is found.

Nulls and empty texts: no words, null places, empty labels, score 0.  Empty table: no rows.  Very long
texts are scanned in one pass, linear in their length.  Rows are independent:
ties and repeated rows give equal results, other columns pass by, whatever their names.
"""

from __future__ import annotations

import re
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm._work import documents

#: Fixed values of the contract: phrase -> label.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Further notices: phrase -> label.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge": "mit",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
    "all rights reserved": "all-rights-reserved",
    "apache license version 2 0": "apache-2.0",
    "licensed under the apache license": "apache-2.0",
    "released under the mit license": "mit",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "cc0": "cc0",
    "creative commons attribution": "cc-by",
}
#: Permissiveness of identifiers, by family prefix (longest prefix wins).
VALUES = {
    "mit": 1.0, "isc": 1.0, "bsd": 1.0, "0bsd": 1.0, "unlicense": 1.0, "cc0": 1.0, "zlib": 1.0, "wtfpl": 1.0,
    "apache": 0.95, "cc-by": 0.9, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.4, "gpl": 0.3, "agpl": 0.2,
    "cc-by-nd": 0.2, "cc-by-nc": 0.1, "all-rights-reserved": 0.0,
}
#: Identifiers that stand alone in prose, by family: versions or kinds.
IDENTIFIERS = {
    "gpl": "1.0 2.0 3.0", "lgpl": "2.0 2.1 3.0", "agpl": "1.0 3.0", "apache": "1.0 1.1 2.0", "mpl": "1.0 1.1 2.0", "epl": "1.0 2.0", "eupl": "1.0 1.1 1.2",
    "bsd": "1-clause 2-clause 3-clause 4-clause", "cc-by": "2.0 2.5 3.0 4.0", "cc-by-sa": "2.0 2.5 3.0 4.0", "cc-by-nc": "2.0 2.5 3.0 4.0", "cc-by-nd": "2.0 2.5 3.0 4.0",
    "cc0": "1.0", "ofl": "1.0 1.1", "cddl": "1.0 1.1", "artistic": "1.0 2.0", "bsl": "1.0", "mit": "0",
}
WITH_ALLOWANCE = 0.3
UNKNOWN = 0.0
TAG = "spdx license identifier"
TYPE = "struct<n_words:bigint,n_base:bigint,first_word:bigint,last_word:bigint,base_labels:string,labels:string,score:double>"
_TAG = re.compile(r"spdx-license-identifier:[ \t]*([^\n\r*]+)")
#: A licence field of a manifest or header; its value has to be of a known family.
_FIELD = re.compile(r"\blicen[sc]e[\"']?[ \t]*[:=][ \t]*([^\n\r*]+)")
_TOKEN = re.compile(r"[(),;/|&]|[a-z0-9][a-z0-9.+-]*")
_OPERAND = re.compile(r"[a-z0-9][a-z0-9.+-]*")
#: What may stand between the operands and operators of an expression in prose.
_BETWEEN = " \t\n\r\x0b\x0c\"'`()"
#: Short spellings of versions: family, then what the identifier ends in.
_SHORT = re.compile(r"(a?gpl|lgpl)v([123])(\.[0-9])?(\+?)")
#: A-Z lower-cased; every other ASCII byte outside 0-9 and a-z ends a word.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_PRECEDENCE = {"or": 1, "and": 2, "with": 3}


@lru_cache(maxsize=1 << 16)
def value_of(identifier: str) -> float | None:
    """Permissiveness of one identifier, None if no family is known."""
    x = identifier.rstrip("+")
    known = [k for k in VALUES if x == k or x.startswith(f"{k}-")]
    return VALUES[max(known, key=len)] if known else None


def to_postfix(tokens: list[str]) -> list[str] | None:
    """Shunting-yard: infix licence expression to postfix; None if it is malformed."""
    out: list[str] = []
    stack: list[str] = []
    operand = True  # whether an operand comes next
    for t in tokens:
        if t in _PRECEDENCE:
            if operand:
                return None
            while stack and stack[-1] != "(" and _PRECEDENCE[stack[-1]] >= _PRECEDENCE[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif t == "(":
            if not operand:
                return None
            stack.append(t)
        elif t == ")":
            if operand:
                return None
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            if not operand:
                return None
            out.append(t)
            operand = False
    if operand or "(" in stack:
        return None
    return out + stack[::-1]


@lru_cache(maxsize=1 << 16)
def clean(token: str) -> str:
    """An operand without the punctuation behind it, short spellings written out (``gplv2`` is ``gpl-2.0``)."""
    t = token.rstrip(".-")
    m = _SHORT.fullmatch(t)
    return f"{m[1]}-{m[2]}{m[3] or '.0'}{m[4]}" if m else t


def lex(expression: str) -> list[str]:
    """Operands, operators and brackets of a lower-cased expression, up to where prose begins: where two operands meet.

    Quotes, arrows and the like are passed over.  ``/`` and ``|`` between operands are OR, ``,``, ``;`` and ``&`` AND, if
    a known family follows or, without a space, what looks like an identifier; else they end the expression.
    """
    out: list[str] = []
    was, joint, end = False, "", 0
    for m in _TOKEN.finditer(expression):
        t = m[0]
        if t in ",;/|&":
            if not was:
                break
            joint, end = t, m.end()
            continue
        if t in "()":
            if was and (t == "(" or joint):
                if t == ")":
                    joint = ""
                else:
                    break
            out.append(t)
            was = t == ")"
            continue
        t = clean(t)
        operator = t in _PRECEDENCE
        if joint and not operator:
            near = m.start() == end and (joint in "/|&" or re.search(r"[-0-9]", t))
            if value_of(t) is None and not near:
                break
            out.append("or" if joint in "/|" else "and")
        elif was and not operator:
            break
        out.append(t)
        was, joint = not operator, ""
    return out


def evaluate(expression: str, known_only: bool = False) -> tuple[list[str], float] | None:
    """Labels and value of an expression; None if it names no licence (``known_only``: or one of no known family)."""
    tokens = lex(expression.lower())
    exceptions = {i + 1 for i, t in enumerate(tokens) if t == "with"}
    labels = [t for i, t in enumerate(tokens) if i not in exceptions and t not in _PRECEDENCE and t not in "()"]
    if known_only and any(value_of(x) is None for x in labels):
        return None
    if not any(value_of(x) is not None for x in labels) and (not labels or len(tokens) == 1 and not re.search(r"[-0-9]", labels[0])):
        return None

    def value(x: str) -> float:
        known = value_of(x)
        return UNKNOWN if known is None else known

    post = to_postfix(tokens)
    if post is None:
        return labels, min(map(value, labels))
    stack: list[float] = []
    for t in post:
        if t in _PRECEDENCE:
            b, a = stack.pop(), stack.pop()
            if t == "with":
                stack.append(min(1.0, a + WITH_ALLOWANCE))
            else:
                stack.append(max(a, b) if t == "or" else min(a, b))
        else:
            stack.append(value(t))
    return labels, stack[0]


def automaton(phrases: dict[str, list[tuple[str, bool]]]) -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for phrase, labels in phrases.items():
        a.add_word(f" {phrase} ", (len(phrase) + 2, labels))
    for word in (TAG, " license", " licence"):  # tags, and names of fields
        a.add_word(f"{word} ", (len(word) + 1, None))
    for family in ("gpl", "lgpl", "agpl"):
        for version in ("v1", "v2", "v3"):
            a.add_word(f" {family}{version}", (0, ()))
    for name in identifiers():
        words = " ".join(re.findall(r"[a-z0-9]+", name))
        key = f" {words} "
        if key not in a:
            a.add_word(key, (len(key), ()))
    a.make_automaton()
    return a


def identifiers() -> set[str]:
    return {f"{family}-{v}" for family, versions in IDENTIFIERS.items() for v in versions.split()}


_KNOWN = identifiers()


def named(token: str) -> bool:
    """Whether a token of prose is one of ``IDENTIFIERS``, with or without a suffix."""
    x = clean(token).rstrip("+")
    return x in _KNOWN or x.removesuffix("-only").removesuffix("-or-later") in _KNOWN


def in_prose(lower: str) -> list[str]:
    """Expressions of a lower-cased text that hold an identifier outside tags, in one pass over its words."""
    out: list[str] = []
    chain: list[tuple[str, int, int]] = []  # operand, operator, operand, ...

    def close() -> None:
        if len(chain) % 2 == 0 and chain:
            chain.pop()
        where = [i for i in range(0, len(chain), 2) if named(chain[i][0])]
        if where:
            # operands beside an identifier belong to it as long as they are of a known family or follow WITH
            lo, hi = where[0], where[-1]
            belongs = lambda i: value_of(chain[i][0]) is not None or i > 0 and chain[i - 1][0] == "with"
            while lo > 1 and belongs(lo - 2):
                lo -= 2
            while hi + 2 < len(chain) and belongs(hi + 2):
                hi += 2
            inner = lower[chain[lo][1] : chain[hi][2]]
            depth = least = 0
            for c in inner:
                depth += (c == "(") - (c == ")")
                least = min(least, depth)
            out.append("(" * -least + inner + ")" * (depth - least))  # brackets around several expressions are not theirs
        chain.clear()

    for m in _OPERAND.finditer(lower):
        raw = m[0]
        word = clean(raw)
        stop = m.start() + len(raw.rstrip(".-"))
        if not word:
            continue
        joins = bool(chain) and not lower[chain[-1][2] : m.start()].strip(_BETWEEN)
        operator = word in _PRECEDENCE
        if not joins or operator != (len(chain) % 2 == 1):
            close()
        if chain or not operator:
            chain.append((word, m.start(), stop))
    close()
    return out


def phrase_table(extra: dict[str, str] | None = None) -> dict[str, list[tuple[str, bool]]]:
    """Phrase -> [(label, whether it is a base phrase)]."""
    out: dict[str, list[tuple[str, bool]]] = {}
    for table, base in ((BASE_PHRASES, True), (NOTICES if extra is None else extra, False)):
        for phrase, label in table.items():
            out.setdefault(phrase, []).append((label, base))
    return out


def scan_text(text: str | None, ac: ahocorasick.Automaton) -> tuple:
    raw = (text or "").encode("utf-8", "surrogatepass")
    ws = raw.translate(_WORDS).split()
    line = (b" " + b" ".join(ws) + b" ").decode("utf-8", "surrogatepass")
    base: set[str] = set()
    found: set[str] = set()
    n_base, first, last, seen, words, tagged, prose = 0, None, None, 0, 0, False, False
    for end, (length, labels) in ac.iter(line):
        if labels is None:
            tagged = True
            continue
        prose |= not labels
        start = end - length + 1
        for label, is_base in labels:
            found.add(label)
            if is_base:
                base.add(label)
                n_base += 1
                at = words + line.count(" ", seen, start) if start >= seen else words - line.count(" ", start, seen)
                words, seen = at, start
                first = at if first is None else min(first, at)
                last = at if last is None else max(last, at)
    values = [v for v in map(value_of, found) if v is not None]
    if tagged or prose:
        lower = raw.translate(_LOWER).decode("utf-8", "surrogatepass")
        texts = [(m[1], False) for m in _TAG.finditer(lower)]
        rest = _TAG.sub("\n", lower)
        texts += [(m[1], True) for m in _FIELD.finditer(rest)] + ([(x, False) for x in in_prose(rest)] if prose else [])
        for expression, known_only in texts:
            if got := evaluate(expression, known_only):
                found.update(got[0])
                values.append(got[1])
    return len(ws), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(found)), min(values, default=0.0)


def scan(text: Column, notices: dict[str, str] | None = None) -> Column:
    """Struct of the scan of each whole text (Arrow UDF around the automaton)."""
    phrases = phrase_table(notices)
    kept: list = []

    @F.arrow_udf(TYPE)
    def run(column: pa.Array) -> pa.Array:
        if not kept:
            kept.append(automaton(phrases))
        rows = [scan_text(x, kept[0]) for x in column.to_pylist()]
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

    return run(text)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir).select("doc_id", scan(F.col("text")).alias("_s")).select("doc_id", "_s.*")
