"""Operator 1: mixing sources to target weights by Pareto order sampling.

Targets: sources in code-point order (null last) weigh 5, 2, 1, 5, 2, 1, ...
and share the words of the whole corpus by weight; a source gets at most
``max_copies`` times its own words, and what it cannot take is shared again by
weight until no source is above its limit.

A source with target T and S words gives every document ``floor(T / S)`` certain whole
copies; the other R words are a Pareto sample with unequal probabilities.  A document's
size measure is its number of words (or another whole number, ``measure``); its inclusion
probability is p = lambda * measure, with lambda such that the expected words are R.
Documents with p of 1 or more are taken for certain and the others rescaled, until none is
above 1 (``_sources``).  The others are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)).  The sample has a fixed size, in words: the lowest ranks are taken as
long as they fit into R, and the one group among the next ones that brings the total closest rounds it off.
u is a hash of the id and the text, so reruns agree.

Scale: only (id, source, size, u) rows are handled.  Ranks are cut into per-source
buckets of about ``BUCKET`` documents by value; bucket sums are aggregated and
cumulated per source, and just the bucket where a source's target falls is
ordered, so a hot source never sits in one task.  What comes out is one
row per source with its cut; documents meet it by broadcast, texts are never shuffled.

Nulls: null text has size 0; null source is a source, null id is hashed as text
'null'.  Ties: rows equal in id, source and text are drawn together; of equal ranks the lower id
(null first), then the smaller size is first.  Documents of size 0 add no words.  A source
without words has target 0 and gives nothing.  Empty table: no rows.  Texts of any length count whole.
Other columns pass by, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._work import bounded, documents, drop, packed, table

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
BUCKET = 4_096
_TWO52 = 1 << 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES) -> DataFrame:
    """One row per source of ``sizes`` (_src, _size): _src, _total, _docs, _target.

    Sources fill up in order of limit over weight: with the first k full, the
    rest share the remaining words by weight; k is the number of sources whose
    limit is under their share with all before them full.  The windows run over
    one row per source.
    """
    src = sizes.groupBy("_src").agg(F.sum("_size").alias("_total"), F.count("*").alias("_docs"))
    order = W.orderBy(F.col("_src").asc_nulls_last())
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    src = src.withColumn("_w", pick).withColumn("_lim", (F.col("_total") * max_copies).cast("double"))
    by = W.orderBy((F.col("_lim") / F.col("_w")).asc(), F.col("_src").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    src = src.withColumn("_all", F.sum("_total").over(whole)).withColumn("_wall", F.sum("_w").over(whole))
    src = src.withColumn("_rest", F.col("_all") - F.coalesce(F.sum("_lim").over(before), F.lit(0.0))).withColumn("_wrest", F.col("_wall") - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    src = src.withColumn("_share", F.col("_rest") / F.col("_wrest")).withColumn("_full", F.col("_lim") <= F.col("_w") * F.col("_share"))
    src = src.withColumn("_o", F.row_number().over(by))
    level = F.min(F.when(~F.col("_full"), F.struct(F.col("_o"), F.col("_share").alias("_v")))).over(whole)
    src = src.withColumn("_level", level["_v"])
    return src.select("_src", "_total", "_docs", F.when(F.col("_full"), F.col("_lim")).otherwise(F.col("_w") * F.col("_level")).alias("_target"))


def uniform(key: Column) -> Column:
    """A number in (0, 1) from the first 13 hex digits of an md5."""
    h = F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("null")).cast("binary")), 1, 13), 16, 10).cast("long")
    return (h.cast("double") + 0.5) / float(_TWO52)


def draw(key: Column, text: Column, seed: str) -> Column:
    """The uniform number of a document."""
    return uniform(F.concat_ws(":", F.lit(seed), F.coalesce(key.cast("string"), F.lit("null")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))))


def _sources(base: DataFrame, weights: tuple[int, ...], max_copies: int) -> DataFrame:
    """One row per source: ``source_targets`` with ``_whole`` copies, ``_need`` words beside them, ``_lam`` and ``_most``, the largest measure that isn't certain.

    Rows per source and measure; from the largest measure on, those with p >= 1 are certain.
    """
    src = table(source_targets(base, weights, max_copies), "targets")
    rate = F.when(F.col("_total") > 0, F.col("_target") / F.col("_total")).otherwise(F.lit(0.0))
    src = src.withColumn("_whole", F.floor(rate)).withColumn("_need", F.col("_target") - F.floor(rate) * F.col("_total"))
    big = "decimal(38,0)"
    by = base.groupBy("_src", "_x").agg(F.sum("_size").alias("_w"), F.sum(F.col("_size").cast(big) * F.col("_x").cast("decimal(18,0)")).cast(big).alias("_wx"))
    larger = W.partitionBy("_src").orderBy(F.col("_x").desc()).rowsBetween(W.unboundedPreceding, -1)
    rest = W.partitionBy("_src").orderBy("_x").rowsBetween(W.unboundedPreceding, 0)
    by = by.withColumn("_c", F.coalesce(F.sum("_w").over(larger), F.lit(0))).withColumn("_q", F.sum("_wx").over(rest).cast("double"))
    by = by.where("_q > 0").withColumnRenamed("_src", "_s2").join(F.broadcast(src.select(F.col("_src").alias("_s3"), "_need")), F.col("_s2").eqNullSafe(F.col("_s3")))
    by = by.withColumn("_lam", (F.col("_need") - F.col("_c")) / F.col("_q")).where("_lam * _x <= 1")
    lam = by.groupBy("_s2").agg(F.max(F.struct("_x", "_lam")).alias("_m"))
    out = src.join(lam, F.col("_src").eqNullSafe(F.col("_s2")), "left")
    return out.select("_src", "_total", "_docs", "_target", "_whole", "_need", F.col("_m._lam").alias("_lam"), F.col("_m._x").alias("_most"))


def _ranked(rows: DataFrame) -> DataFrame:
    """Adds rank and bucket (certain ones: 0 and -1) to rows with the columns of their source."""
    p = F.greatest(F.col("_lam") * F.col("_x"), F.lit(1e-12))
    sure = F.coalesce((F.col("_x") > F.col("_most")) | (p >= 1), F.lit(False))
    rank = (F.col("_u") / (F.lit(1.0) - F.col("_u"))) / (p / (F.lit(1.0) - p))
    out = rows.withColumn("_rank", F.when(sure, F.lit(0.0)).otherwise(rank))
    buckets = F.ceil(F.col("_docs") / F.lit(BUCKET))
    return out.withColumn("_b", F.when(sure, F.lit(-1)).otherwise(F.floor(F.col("_rank") / (F.col("_rank") + 1.0) * buckets)).cast("long"))


def _of_source(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    return rows.join(bounded(cuts.withColumnRenamed("_src", "_s2"), 100_000), F.col("_src").eqNullSafe(F.col("_s2")), "left").drop("_s2")


def cuts(docs: DataFrame, id_col: str, source: Column, size: Column, text: Column, measure: Column | None = None, weights: tuple[int, ...] = WEIGHTS, max_copies: int = MAX_COPIES, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(slim rows _id, _src, _size, _x, _u; one row per source that says which of them are taken)."""
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), source.alias("_src"), size.cast("long").alias("_size"), (size if measure is None else measure).cast("long").alias("_x"), draw(F.col(f"`{id_col}`"), text, seed).alias("_u"))
    base = table(base, "sizes")
    src = table(_sources(base, weights, max_copies), "sources")
    d = _ranked(_of_source(base, src))
    sums = d.where("_need > 0").groupBy("_src", "_b").agg(F.sum("_size").alias("_in"), F.first("_need").alias("_goal"))
    upto = W.partitionBy("_src").orderBy("_b")
    sums = sums.withColumn("_before", F.sum("_in").over(upto) - F.col("_in"))
    edge = sums.where("_b >= 0 AND _before <= _goal AND _before + _in >= _goal").groupBy("_src").agg(F.min(F.struct("_b", "_before")).alias("_e"))
    edge = table(edge.select("_src", F.col("_e._b").alias("_eb"), F.col("_e._before").alias("_eu")), "edges")
    key = ["_rank", "_id", "_size"]
    inside = _of_source(d, edge).where("_b = _eb").groupBy("_src", *key).agg(F.sum("_size").alias("_words"), F.first("_eu").alias("_eu"), F.first("_need").alias("_goal"))
    inside = inside.withColumn("_cum", F.col("_eu") + F.sum("_words").over(W.partitionBy("_src").orderBy(*key).rowsBetween(W.unboundedPreceding, 0)))
    inside = table(inside.withColumn("_fits", F.col("_cum") <= F.col("_goal")), "edge_rows")
    got = inside.groupBy("_src").agg(F.max(F.when(F.col("_fits"), F.struct(*key))).alias("_cut"), (F.first("_goal") - F.coalesce(F.max(F.when(F.col("_fits"), F.col("_cum"))), F.first("_eu"))).alias("_gap"))
    got = table(got, "gaps")
    off = F.abs(F.col("_gap") - F.col("_words"))
    late = _of_source(inside.where("NOT _fits AND _words > 0"), got.select("_src", "_gap")).where(off < F.col("_gap"))
    one = late.groupBy("_src").agg(F.min(F.struct(off.alias("_d"), *key)).alias("_m")).select(F.col("_src").alias("_s1"), F.struct(*[F.col(f"_m.{k}") for k in key]).alias("_round"))
    out = src
    for name, part in (("_s3", edge.select("_src", "_eb")), ("_s4", got.select("_src", "_cut"))):
        out = out.join(part.withColumnRenamed("_src", name), F.col("_src").eqNullSafe(F.col(name)), "left").drop(name)
    out = table(out.join(one, F.col("_src").eqNullSafe(F.col("_s1")), "left").drop("_s1").withColumn("_limit", F.lit(max_copies)), "cuts")
    drop(src, edge, inside, got)
    return base, out


def taken(rows: DataFrame, cut: DataFrame) -> DataFrame:
    """Adds ``_copies`` to rows with _id, _src, _size, _x and _u."""
    d = _ranked(_of_source(rows, cut))
    key = F.struct("_rank", "_id", "_size")
    at = F.col("_b") == F.col("_eb")
    either = (F.col("_b") < F.col("_eb"), at & (key <= F.col("_cut")), at & key.eqNullSafe(F.col("_round")))
    more = reduce(lambda x, y: x | y, [F.coalesce(c, F.lit(False)) for c in either])
    return d.withColumn("_copies", F.least(F.col("_whole") + F.when(more, 1).otherwise(0), F.col("_limit")).cast("long"))


def mix(docs: DataFrame, id_col: str = "doc_id", source: str | Column = "source", size: Column | None = None, text: str = "text", **options) -> DataFrame:
    """Rows (_id, _src, _size, _total, _target, _copies), one for each row of ``docs``."""
    source = F.col(f"`{source}`") if isinstance(source, str) else source
    base, cut = cuts(docs, id_col, source, word_count(F.col(f"`{text}`")) if size is None else size, F.col(f"`{text}`"), **options)
    return taken(base, cut).select("_id", "_src", "_size", "_total", "_target", "_copies")


def mix_documents(docs: DataFrame, id_col: str = "doc_id", seed: str = "mix", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it, columns unchanged; texts stay where they are."""
    row = packed(docs)
    source, text = F.col("_row.source"), F.col("_row.text")
    slim = row.select(F.col(f"_row.{id_col}").alias("doc_id"), source.alias("source"), text.alias("text"))
    base, cut = cuts(slim, "doc_id", F.col("source"), word_count(F.col("text")), F.col("text"), seed=seed, **options)
    own = row.select("_row", F.col(f"_row.{id_col}").alias("_id"), source.alias("_src"), word_count(text).alias("_size"), draw(F.col(f"_row.{id_col}"), text, seed).alias("_u")).withColumn("_x", F.col("_size"))
    out = taken(own, cut).where("_copies > 0").select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies").cast("int"))))
    drop(base)
    return out.select("_row.*")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return m.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_total").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).alias("taken"))
