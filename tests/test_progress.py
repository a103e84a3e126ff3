"""Progress that the writes themselves have seen, version strings, and numbered matches."""

import re

from pyspark.sql import functions as F

from weftgraph import __version__, version
from weftgraph.operators.components import connected_components
from weftgraph.operators.matches import match_index
from weftgraph.plans.work import observed, tell, telling


def test_observed_tables(spark):
    said = []
    with telling(said.append):
        t, seen = observed(spark.range(10), "ten", rows=F.count(F.lit(1)), id_sum=F.sum("id"))
        assert seen == {"rows": 10, "id_sum": 45} and t.count() == 10
        assert observed(spark.range(0), "none", id_sum=F.sum("id"))[1] == {"id_sum": 0}
    tell("nobody hears this")
    assert said == ["ten: 10 rows, 45 id sum", "none: 0 id sum"]


def test_rounds_are_told_while_they_run(spark):
    said = []
    path = spark.range(0, 60, 1, 6).selectExpr("id AS u", "id + 1 AS v")
    with telling(said.append):
        connected_components(path, local_edges=0)
    assert len(said) >= 2 and all(re.match(r"components: \d+ links, ", x) for x in said)


def test_versions():
    assert version.version().startswith(__version__)
    assert version.release("1.2-5-gabc") == "1.2" and version.release("1.2") == "1.2"
    assert version.codename("0.3.0-g1") == "runs" and version.codename("9-1") == ""
    assert version.short("0.3.0-g1") == '0.3.0-g1 "runs"' and version.short("9") == "9"


def test_match_numbers(spark):
    runs = spark.createDataFrame([(False, 30, 2, 4), (True, 9, 20, 3), (False, 0, 40, 2)], "is_rev boolean, q long, t long, len long")
    got = match_index(runs).orderBy("n").collect()
    rows = [(r.start, r.end, r.pos, r.is_rev) for r in got]
    assert [r.n for r in got] == list(range(6)) and rows == sorted(rows)
    assert match_index(runs).where("n = 1").first().start == 2
