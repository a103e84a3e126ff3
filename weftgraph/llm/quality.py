"""Operator 7: quality rules with risk-controlled thresholds.

Each rule is a number per document that grows with badness.  For every stratum
(``lang``) and rule a cutoff is chosen from a fixed grid, going from the
loosest to stricter ones as long as the labelled holdout proves, by an exact
one-sided binomial (Clopper-Pearson) test, that the share of good documents
above the cutoff is under the rule's part of the risk.  The base rules are fixed and reject good
documents too: the smallest of ``BASE_RISKS`` that their share is proved to stay under is taken off ``alpha`` first,
the rest is shared by the rules; a stratum where nothing is left gets no cutoffs.
The level ``delta`` is divided by strata x (rules + 1) (Bonferroni), for the base by its grid too;
walking a rule's grid in a fixed order and stopping at
the first failure needs no further correction.  So with probability 1 - delta
no stratum with cutoffs loses more than ``alpha`` of its good documents to all rules, base rules included.

Trials: one for each distinct text of a stratum, however many rows, copies or labels it has,
so repeating rows proves nothing; a text is good if any of its labels says so (which can only raise the counted risk).

Nulls: a null text counts as empty (no words, so it fails the base rules); a
null stratum is a stratum of its own; labels with a null id, quality or no
document are ignored.  Ties at a cutoff are kept (a rule rejects strictly
above it).  Repeated document rows get equal results.  A stratum without enough
labels gets no cutoffs: only base rules reject there.  Texts of any length are counted whole, in about six
bytes a byte.  Empty tables: no rows, or no cutoffs.  Other columns pass by, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import _text as tx
from weftgraph.llm._work import bounded, documents, packed, table

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (*BASE, "n_upper", "n_punct", "n_lines")
FEATURE_TYPE = "struct<" + ",".join(f"{x}:bigint" for x in FEATURES) + ">"
SYMBOLS = b"#*$%&|<>"
#: Rule name -> (expression over the features, grid of cutoffs from loose to strict).
RULES: dict[str, tuple[str, tuple[float, ...]]] = {
    "symbols": ("_f.n_symbols / greatest(_f.n_words, 1)", (2.0, 1.0, 0.5, 0.3, 0.2, 0.1, 0.05, 0.02)),
    "dup_lines": ("_f.n_dup_lines / greatest(_f.n_lines, 1)", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "repeats": ("_f.n_repeat_words / greatest(_f.n_words, 1)", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "shouting": ("_f.n_upper / greatest(_f.word_chars, 1)", (0.9, 0.7, 0.5, 0.3, 0.2, 0.1, 0.05)),
    "punctuation": ("_f.n_punct / greatest(_f.n_words, 1)", (4.0, 2.0, 1.0, 0.7, 0.5, 0.4, 0.3)),
    "long_words": ("_f.word_chars / greatest(_f.n_words, 1)", (40.0, 20.0, 15.0, 12.0, 10.0, 9.0, 8.0)),
    "short_words": ("_f.n_words / greatest(_f.word_chars, 1)", (0.9, 0.7, 0.5, 0.4, 0.3, 0.27, 0.25)),
    "short_text": ("1 / greatest(_f.n_words, 1)", (0.1, 0.07, 0.05, 0.04, 0.03, 0.02)),
}
ALPHA, DELTA = 0.05, 0.05
#: Shares of ``alpha`` that may go to the base rules.
BASE_RISKS = (0.0625, 0.125, 0.25, 0.5, 0.75)
_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS, np.uint8))
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)
_LETTER = _UPPER | ((np.arange(256) >= 97) & (np.arange(256) <= 122)) | (np.arange(256) >= 128)
_DIGIT = (np.arange(256) >= 48) & (np.arange(256) <= 57)
_PUNCT = ~(_LETTER | _DIGIT | tx.SPACE)
_HEAD = (np.arange(256) & 0xC0) != 0x80


def _features(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    n = len(offs) - 1
    out = np.zeros((len(FEATURES), n), np.int64)
    if not len(buf):
        return out
    s, e, row = tx.words(buf, offs)
    out[0] = np.bincount(row, minlength=n)
    out[1] = tx.per_row(_HEAD[buf] & ~tx.SPACE[buf], offs)
    out[2] = tx.per_row(_SYMBOL[buf], offs)
    out[5] = tx.per_row(_UPPER[buf], offs)
    out[6] = tx.per_row(_PUNCT[buf], offs)
    for i, (lo, hi) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
        lines = [x for x in buf[lo:hi].tobytes().split(b"\n") if x and not x.isspace()]
        out[7, i], out[3, i] = len(lines), len(lines) - len(set(lines))
    # words inside 5-word windows that occur twice or more in their row
    runs = tx.gram_numbers(tx.numbers(buf, s, e)[0], 5)  # words are numbered, so no two windows are mixed up
    if len(runs):
        at = np.flatnonzero(row[4:] == row[: len(row) - 4])
        dup = at[tx.duplicated(runs[at] * n + row[at])]
        out[4] = np.bincount(row[tx.covered(dup, 5, len(s))], minlength=n)
    return out


def features(text: Column) -> Column:
    """Struct of the counts of ``FEATURES`` for each whole text (Arrow UDF, numpy inside)."""

    @F.arrow_udf(FEATURE_TYPE)
    def run(column: pa.Array) -> pa.Array:
        got = [_features(buf, offs) for _, _, buf, offs in tx.parts(column)]
        cols = np.concatenate(got, axis=1) if got else np.zeros((len(FEATURES), 0), np.int64)
        return pa.StructArray.from_arrays([pa.array(c) for c in cols], names=list(FEATURES))

    return run(text)


def base_failed(f: str = "_f") -> Column:
    return F.expr(f"{f}.n_words < 10 OR 100 * {f}.n_repeat_words > 20 * {f}.n_words")


def binomial_cdf(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Bin(n, p), summed in log space from k down; terms 40 standard deviations below add nothing."""
    if k >= n:
        return 1.0
    top = math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p)
    i = np.arange(k, max(0, k - 1000 - int(40 * math.sqrt(n * p * (1 - p)))), -1)
    down = np.cumsum(np.log(i * (1 - p)) - np.log((n - i + 1) * p))  # from i to i - 1
    return float(min(1.0, np.exp(top) + np.exp(top + down).sum()))


def proved(k: int, n: int, risk: float, level: float) -> bool:
    """Whether k rejections of n good documents prove, at this level, that the share is under ``risk``."""
    return n > 0 and k < n * risk and binomial_cdf(int(k), int(n), risk) <= level


def cutoff(grid: tuple[float, ...], good: list[int], bad: list[int], n: int, risk: float, level: float) -> float | None:
    """Of the cutoffs proved safe, the loosest that rejects the most bad over good documents; None if none gains."""
    best, chosen = 0, None
    for cut, k, b in zip(grid, good, bad, strict=True):
        if not proved(k, n, risk, level):
            break
        if b - k > best:
            best, chosen = b - k, cut
    return chosen


def base_risk(k: int, n: int, alpha: float, level: float) -> float:
    """The risk to set aside for the base rules: the smallest of the grid that is proved, else all of it."""
    return next((alpha * x for x in BASE_RISKS if proved(k, n, alpha * x, level / len(BASE_RISKS))), alpha)


def feature_table(docs: DataFrame, stratum: str = "lang") -> DataFrame:
    """(_id, _h, _s, _f) of every document: written once, so joins with labels never move texts."""
    return table(docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_h"), F.col(f"`{stratum}`").alias("_s"), features(F.col("text")).alias("_f")), "features")


def thresholds(feats: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """One row per stratum of ``feature_table``: ``_s`` and ``_cut``, an array with a cutoff (or null) for each rule."""
    marks = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality") == 1).alias("_g"))
    trials = feats.join(marks, "_id").groupBy("_s", "_h", "_f").agg(F.max("_g").alias("_g"))
    trials = trials.withColumn("_good", F.col("_g").cast("int")).withColumn("_bad", 1 - F.col("_good")).withColumn("_base", base_failed())
    counts = [F.sum(F.expr(f"IF(NOT _base AND {expr} > {c}D, {kind}, 0)")).alias(f"{name}{kind}{i}") for name, (expr, grid) in RULES.items() for i, c in enumerate(grid) for kind in ("_good", "_bad")]
    summed = table(trials.groupBy("_s").agg(F.sum("_good").alias("_n"), F.sum(F.expr("IF(_base, _good, 0)")).alias("_lost"), *counts), "holdout")
    level = delta / (max(1, summed.count()) * (len(RULES) + 1))

    def choose(batches):
        for b in batches:
            cuts = []
            for r in b.to_pylist():
                n = r["_n"] or 0
                left = alpha - base_risk(r["_lost"] or 0, n, alpha, level)
                risk = left / len(RULES)
                cuts.append([cutoff(grid, *[[r[f"{name}{kind}{i}"] for i in range(len(grid))] for kind in ("_good", "_bad")], n, risk, level) if left > 0 else None for name, (_, grid) in RULES.items()])
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("_s")), pa.array(cuts, pa.list_(pa.float64()))], names=["_s", "_cut"])

    return summed.mapInArrow(choose, f"_s {dict(feats.dtypes)['_s']}, _cut array<double>")


def judge(rows: DataFrame, stratum: str, cuts: DataFrame) -> DataFrame:
    """``rows`` (with ``_f``) plus ``_base`` (base rules reject) and ``_kept`` (the verdict)."""
    cuts = bounded(cuts.withColumnRenamed("_s", "_s2"), 100_000)
    out = rows.join(cuts, F.col(stratum).eqNullSafe(F.col("_s2")), "left")
    over = " OR ".join(f"coalesce({expr} > _cut[{i}], false)" for i, (expr, _) in enumerate(RULES.values()))
    return out.withColumn("_base", base_failed()).withColumn("_kept", F.expr(f"NOT _base AND NOT ({over})")).drop("_s2", "_cut")


def quality_filter(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = ALPHA, delta: float = DELTA) -> DataFrame:
    """The rows of ``docs`` that pass base rules and thresholds, columns unchanged; one pass counts the features."""
    text = F.col("_row.text")
    rows = table(packed(docs, _id=F.col("_row.doc_id"), _h=F.xxhash64(text), _s=F.col(f"_row.`{stratum}`"), _f=features(text)), "judged")
    cuts = table(thresholds(rows.select("_id", "_h", "_s", "_f"), labels, alpha, delta), "cuts")
    return judge(rows, "_s", cuts).where("_kept").select("_row.*")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    feats = feature_table(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    out = judge(feats, "_s", table(thresholds(feats, labels), "cuts"))
    return out.select(F.col("_id").alias("doc_id"), *[f"_f.{x}" for x in BASE], F.col("_base").alias("base_failed"), F.col("_kept").alias("kept"))
