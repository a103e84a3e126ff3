"""Session factory with settings that suit the engine's plans."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "weftgraph", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution, skew-join splitting and UTC; ``conf`` keys use ``_`` for ``.``."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    fixed = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for k, v in (fixed | {k.replace("_", "."): v for k, v in conf.items()}).items():
        b = b.config(k, v)
    return b.getOrCreate()
