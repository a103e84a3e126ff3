"""Components kept up to date while alignment files arrive.

The store holds labels (node, component) and is only ever added to.  A
micro-batch turns its new PAF rows into a forest of base links, looks up the
labels of the bases it touches, follows those to their components, joins both and
appends what it learned: a label for each base it touched, and one for each
component that another one took in.  All other bases of such a component keep
their label, which leads on to the new one, so a batch reads and writes as many
rows as it touches, not as many as are stored.

Labels lie in zones of ``ZONE`` positions, folders of which a lookup reads only those it needs.
From time to time (``compact_every`` batches) the labels are brought to one base version without detours.
A batch that is run again after a failure sees only what was stored before it and writes the same again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weftgraph.operators.components import connected_components, forests
from weftgraph.operators.matches import base_edges, unpack, valid_row
from weftgraph.operators.sequences import blocks
from weftgraph.plans.work import bounded, drop, table
from weftgraph.sources.alignments import parse_paf

ZONE = 1 << 20
#: Zones that a lookup names one by one; more are read by a join.
NAMED = 10_000


@dataclass
class ComponentStore:
    """Labels of bases under one folder: ``base/upto=N`` (all labels after batch N) and ``delta/batch=N``."""

    path: str
    zone: int = ZONE
    compact_every: int = 16
    #: Rows that the lookups of the last batch found, for those who watch.
    found: list[int] = field(default_factory=list)

    def _part(self, spark: SparkSession, kind: str, key: str) -> DataFrame | None:
        try:
            return spark.read.schema(f"node bigint, component bigint, zone bigint, {key} bigint").parquet(f"{self.path}/{kind}")
        except AnalysisException:
            return None

    def _labels(self, spark: SparkSession, before: int | None) -> DataFrame | None:
        """(node, component, zone, at): every label stored before a batch; the newest one of a node counts."""
        base, delta, upto = self._part(spark, "base", "upto"), self._part(spark, "delta", "batch"), -1
        if base is not None:
            if before is not None:
                base = base.where(F.col("upto") < before)
            upto = max((r[0] for r in base.select("upto").distinct().collect()), default=-1)  # one row a compaction, from the folders' names
            base = base.where(F.col("upto") == upto).select("node", "component", "zone", F.lit(-1).cast("long").alias("at"))
        if delta is not None:
            delta = delta.where(F.col("batch") > upto)
            delta = (delta if before is None else delta.where(F.col("batch") < before)).select("node", "component", "zone", F.col("batch").alias("at"))
        if base is None or delta is None:
            return delta if base is None else base
        return base.unionByName(delta)

    def _lookup(self, labels: DataFrame, nodes: DataFrame) -> DataFrame:
        """The newest labels of ``nodes`` (distinct, written); only their zones are read."""
        zones = nodes.select(F.floor(F.col("node") / self.zone).alias("zone")).distinct()
        named = [r.zone for r in zones.limit(NAMED + 1).collect()]
        near = labels.where(F.col("zone").isin(named)) if len(named) <= NAMED else labels.join(zones, "zone", "left_semi")
        newest = near.join(bounded(nodes, 1_000_000), "node", "left_semi").groupBy("node").agg(F.max(F.struct("at", "component"))["component"].alias("component"))
        return table(newest, "labels")

    def _followed(self, labels: DataFrame, nodes: DataFrame) -> DataFrame:
        """(u, v): the labels of ``nodes``, the labels of those, and so on, as links."""
        out, todo = None, nodes
        while True:
            got = self._lookup(labels, todo)
            n = got.count()
            self.found.append(n)
            out = got if out is None else out.unionByName(got)
            if not n:
                return out.select(F.col("node").alias("u"), F.col("component").alias("v"))
            seen = out.select("node").distinct()
            todo = table(got.where("node != component").select(F.col("component").alias("node")).distinct().join(seen, "node", "left_anti"), "todo")

    def read(self, spark: SparkSession, before: int | None = None) -> DataFrame | None:
        """(node, component) of all bases that any batch (before one) has touched; None before the first."""
        labels = self._labels(spark, before)
        if labels is None:
            return None
        newest = labels.groupBy("node").agg(F.max(F.struct("at", "component"))["component"].alias("component"))
        return connected_components(newest.select(F.col("node").alias("u"), F.col("component").alias("v")))

    def merge(self, edges: DataFrame, batch: int) -> None:
        """Add the links (u, v) of a batch."""
        spark = edges.sparkSession
        self.found = []
        new = table(forests(edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")).where("u IS NOT NULL AND v IS NOT NULL")), "forest")
        labels, links = self._labels(spark, batch), new
        if labels is not None:
            touched = table(new.select(F.col("u").alias("node")).unionByName(new.select(F.col("v").alias("node"))).distinct(), "touched")
            links = new.unionByName(self._followed(labels, touched))
        self._write(connected_components(links), f"delta/batch={batch}")
        drop(new)
        if self.compact_every and batch % self.compact_every == self.compact_every - 1:
            self._write(self.read(spark, batch + 1), f"base/upto={batch}")

    def _write(self, stars: DataFrame, place: str) -> None:
        rows = stars.withColumn("zone", F.floor(F.col("node") / self.zone))
        rows.repartition("zone", F.floor(F.col("node") / (self.zone // 64 or 1))).write.partitionBy("zone").mode("overwrite").parquet(f"{self.path}/{place}")


def follow(spark: SparkSession, folder: str, sequences: DataFrame, store: ComponentStore, checkpoint: str, min_match_len: int = 0) -> StreamingQuery:
    """Reads the files that are in ``folder`` and not yet done, then ends; rows that are not valid are skipped."""
    held = table(blocks(sequences), "blocks")
    index = sequences.drop("seq")

    def batch(lines: DataFrame, number: int) -> None:
        paf = parse_paf(lines).withColumn("min_match_len", F.lit(0).cast("long")).where(valid_row())
        store.merge(base_edges(unpack(paf, index, held, min_match_len)), number)

    return spark.readStream.text(folder).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
