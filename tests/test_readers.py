"""Sequence files read by splits, and probes that read first bytes only."""

import gzip
import random
import warnings

import pytest

from weftgraph.operators.sequences import DuplicateNames
from weftgraph.sources import sequences as sq
from weftgraph.sources.alignments import read_paf
from weftgraph.sources.lines import exists, first_bytes, read_lines


@pytest.fixture
def small_splits(spark):
    for k, v in (("spark.sql.files.maxPartitionBytes", "300"), ("spark.sql.files.openCostInBytes", "1"), ("spark.sql.files.minPartitionNum", "1")):
        spark.conf.set(k, v)
    yield
    for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes", "spark.sql.files.minPartitionNum"):
        spark.conf.unset(k)


def wrapped(rows, width, end="\n"):
    return "".join(f">{n} note{end}" + "".join(s[i : i + width] + end for i in range(0, len(s), width)) for n, s in rows)


def held(index, block_table):
    text = "".join(r.text for r in block_table.orderBy("block").collect())
    return [(r.seq_id, r.name, text[r.seq_offset : r.seq_offset + r.seq_len]) for r in index.orderBy("seq_id").collect()]


def test_a_record_over_many_splits(spark, tmp_path, small_splits):
    r = random.Random(9)
    rows = [(f"s{i}", "".join(r.choice("ACGTNacgt") for _ in range(n))) for i, n in enumerate((70, 0, 2000, 1))]
    (tmp_path / "a.fa").write_bytes(wrapped(rows, 37, "\r\n").encode())
    with gzip.open(tmp_path / "c.fa.gz", "wt") as f:
        f.write(wrapped(rows, 60))
    assert read_lines(spark, str(tmp_path / "a.fa")).rdd.getNumPartitions() > 5
    want = [(k + 1, n, s.upper()) for k, (n, s) in enumerate(x for x in rows if x[1])]
    for name in ("a.fa", "c.fa.gz"):
        path = str(tmp_path / name)
        assert held(*sq.read_blocks(spark, path)) == want
    lines = sq.record_lines(spark, str(tmp_path / "a.fa"))
    assert lines.selectExpr("max(length(text))").first()[0] == 37  # no row holds a record


def test_fastq_over_splits(spark, tmp_path, small_splits):
    r = random.Random(1)
    rows = [(f"r{i}", "".join(r.choice("ACGT") for _ in range(r.randint(1, 90)))) for i in range(40)]
    (tmp_path / "a.fq").write_text("".join(f"@{n} x\n{s}\n+\n{'>' * len(s)}\n" for n, s in rows))
    assert [(n, s) for _, n, s in held(*sq.read_blocks(spark, str(tmp_path / "a.fq")))] == rows


def test_repeated_names_and_other_formats(spark, tmp_path):
    (tmp_path / "a.fa").write_text(">a\nAC\n>a x\nC\n")
    with pytest.raises(DuplicateNames):
        sq.read_blocks(spark, str(tmp_path / "a.fa"))
    (tmp_path / "b").write_text("ACGT\n")
    (tmp_path / "c").write_text("")
    for name in ("b", "c"):
        with pytest.raises(sq.UnknownFormat):
            sq.sniff(spark, str(tmp_path / name))
    with pytest.raises(FileNotFoundError):
        sq.sniff(spark, str(tmp_path / "none"))
    assert exists(spark, str(tmp_path)) and not exists(spark, str(tmp_path / "none"))


def test_first_bytes_run_no_job(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    (folder / "_SUCCESS").write_text("no")
    (folder / "a").write_text("")
    (folder / "b").write_bytes(gzip.compress(b">x\nACGT\n" * 5000))  # packed, without a name that says so
    (folder / "c").write_text("@late")
    spark.sparkContext.setJobGroup("probe", "probe")
    assert first_bytes(spark, str(folder), 4) == b">x\nA"
    assert sq.sniff(spark, str(folder)) == "fasta"
    assert not spark.sparkContext.statusTracker().getJobIdsForGroup("probe")
    spark.sparkContext.setJobGroup("rest", "rest")


def test_missing_tag_is_a_warning(spark, tmp_path):
    row = "a\t4\t0\t4\t+\tb\t4\t0\t4\t4\t4\t60"
    (tmp_path / "a.paf").write_text(f"\n\n{row}\n{row}\tcg:Z:4M\n")
    (tmp_path / "b.paf").write_text(f"{row}\ttp:A:P\tcg:Z:4M\n")
    with pytest.warns(UserWarning, match="no cg:Z: tag"):
        assert read_paf(spark, str(tmp_path / "a.paf"), on_bad_row="skip").count() == 2
    with warnings.catch_warnings():
        warnings.simplefilter("error")
        assert read_paf(spark, str(tmp_path / "b.paf")).count() == 1
