"""Text lines with their place in the file, and small checks on paths."""

from __future__ import annotations

import zlib

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str, line_sep: str | None = None) -> DataFrame:
    """(value, file, block, place): order by the last three is file order, files of a folder by name.  ``.gz`` is decoded by its extension."""
    reader = spark.read.option("lineSep", line_sep) if line_sep else spark.read
    try:
        df = reader.text(path)
    except AnalysisException as e:
        raise FileNotFoundError(path) from e
    return df.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("place"))


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a file or folder is there; nothing of it is read."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def first_bytes(spark: SparkSession, path: str, n: int = 1 << 16) -> bytes:
    """The first ``n`` bytes of a file, or of the first file of a folder or pattern by name, that holds any; nothing more is read.

    Packed files are known by their content, not by their name.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    todo = sorted((str(x.getPath()), x) for x in (fs.globStatus(root) or []))
    if not todo:
        raise FileNotFoundError(path)
    while todo:
        _, status = todo.pop(0)
        p = status.getPath()
        if p.getName()[:1] in ("_", ".") and p != root:
            continue
        if status.isDirectory():
            todo = sorted((str(x.getPath()), x) for x in fs.listStatus(p)) + todo
        elif status.getLen():
            stream = fs.open(p)
            try:
                head = bytes(stream.readNBytes(max(n, 1 << 16)))
            finally:
                stream.close()
            if head[:2] == b"\x1f\x8b":  # what a cut gzip stream gives before its end
                head = zlib.decompressobj(16 + zlib.MAX_WBITS).decompress(head, n)
            if head:
                return head[:n]
    return b""
