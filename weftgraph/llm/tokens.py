"""Operator 5: token ids and binary output with Elias-Fano boundaries.

File format (``write_ids``): a folder with two Parquet tables.

* ``segments``: one row per segment: ``part`` (range of ids, ascending), ``seg``
  (number in the part), ``n_docs``, ``n_ids`` and ``data``, which holds

      "EFID" | version u8 | id width u8 | 0 u16
      n_docs u64 | n_ids u64 | least document id i64
      document ends | document ids | id-is-null bits | ids

  The concatenated ids of all documents of the segment (2 bytes each where the
  vocabulary has at most 65,536 entries, else 4, little-endian) end the blob.
  Document ends, and document ids (ascending, less the least; a null's is 0), are Elias-Fano coded, each as

      low bits u8 | bytes of low u64 | bytes of high u64 | low | high | samples u32[]

  ``low`` has the low bits of each value,
  packed, ``high`` the unary coded rest, ``samples`` the place of every 64th one
  bit, so ``EliasFano.select(i)`` reads a value without decoding the others; ``read_ids`` reads all
  offsets so.  No table of 64-bit numbers is in the file.
* ``parts``: ``part``, ``start``: ids before the part, over the whole output.

Documents are in ascending id order (null first; ties by a hash of the text):
Spark range-partitions and sorts the texts, each partition is encoded as a
stream, and a segment closes after ``SEGMENT_IDS`` ids, always between documents.
Only one number per part is summed across the output.

Encoding: each whole text by the ``tokenizers`` library.  A byte-level
pre-tokenizer never joins characters across a lone space or line end, so texts
are cut there, and a bounded cache holds the ids of pieces; pieces not in it are
encoded together, words of Latin letters by the pairs alone, as the pre-tokenizer would not cut them.  Texts with runs of white space or special-token strings, and all texts under a
tokenizer of another make (``Encoder.byte_level``), are encoded as they are.

Nulls: null text is empty (only the end id); a null id is kept as null.  Repeated
rows are written each.  Empty table: no segments, no rows.  A text of any length is encoded whole and stays in one
segment.  Other columns are not written, whatever their names.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from weftgraph.llm._work import bounded, documents, work_dir

END_ID = 0
SEGMENT_IDS = 1 << 20
CACHE_PIECES = 800_000
_SEGMENT_TYPE = "part int, seg int, n_docs bigint, n_ids bigint, data binary"
_RUNS = re.compile(r"\s\s")
#: How the byte-level form writes the bytes of letters beyond ASCII that are no printable Latin-1.
_BYTES = {i: chr(162 + i) for i in range(128, 161)} | {173: chr(323)}


def _letters(text: str) -> bool:
    """Letters of the Latin blocks only, which are letters in every version of Unicode."""
    return text.isalpha() and (text.isascii() or max(text) < "\u0250")


class EliasFano:
    """A non-decreasing sequence in about 2 + log2(u / n) bits a value, with select."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, samples: np.ndarray) -> None:
        self.n, self.low_bits, self.low, self.high, self.samples = n, low_bits, low, high, samples
        self._low, self._high = low.tobytes(), high.tobytes()

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n = len(v)
        bits = max(0, int(int(v[-1]) // n).bit_length() - 1) if n else 0
        shifts = np.arange(bits, dtype=np.uint64)
        low = np.packbits(((v[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little")
        at = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(at[-1]) + 1 if n else 0, np.uint8)
        high[at] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), at[::64].astype(np.uint32))

    def select(self, i: int) -> int:
        """Value ``i``, from the nearest sample on."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // 64]), i % 64
        if left:  # the ``left``-th one bit after the sample: whole bytes, then bits
            at += 1
            k = at >> 3
            byte = self._high[k] >> (at & 7) << (at & 7)
            while (ones := byte.bit_count()) < left:
                left -= ones
                k += 1
                byte = self._high[k]
            for _ in range(left - 1):
                byte &= byte - 1
            at = k * 8 + (byte & -byte).bit_length() - 1
        b = i * self.low_bits
        low = int.from_bytes(self._low[b >> 3 : (b + self.low_bits + 7) >> 3], "little") >> (b & 7)
        return (at - i) << self.low_bits | low & ((1 << self.low_bits) - 1)

    def to_bytes(self) -> bytes:
        return b"".join((struct.pack("<BQQ", self.low_bits, len(self._low), len(self._high)), self._low, self._high, self.samples.astype("<u4").tobytes()))

    @classmethod
    def from_bytes(cls, data: bytes, at: int, n: int) -> tuple[EliasFano, int]:
        """The sequence of ``n`` values at a place of ``data``, and the place behind it."""
        bits, n_low, n_high = struct.unpack_from("<BQQ", data, at)
        at += struct.calcsize("<BQQ")
        out = []
        for kind, count in (("u1", n_low), ("u1", n_high), ("<u4", (n + 63) // 64)):
            out.append(np.frombuffer(data, kind, count, at))
            at += out[-1].nbytes
        return cls(n, bits, *out), at

    def values(self) -> np.ndarray:
        at = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n]
        out = (at - np.arange(self.n)).astype(np.int64) << self.low_bits
        if self.low_bits:
            low = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out += low.astype(np.int64) @ (np.int64(1) << np.arange(self.low_bits, dtype=np.int64))
        return out


def pack(doc_ids: list[int | None], ends: np.ndarray, ids: bytes, width: int) -> bytes:
    """A segment; document ids ascend, nulls first."""
    null = np.packbits(np.array([x is None for x in doc_ids], np.uint8), bitorder="little").tobytes()
    least = next((x for x in doc_ids if x is not None), 0)
    names = np.array([0 if x is None else x - least for x in doc_ids], np.uint64)
    head = b"EFID" + struct.pack("<BBHQQq", 2, width, 0, len(doc_ids), len(ids) // width, least)
    return b"".join((head, EliasFano.encode(ends).to_bytes(), EliasFano.encode(names).to_bytes(), null, ids))


def unpack(data: bytes) -> tuple[list[int | None], EliasFano, np.ndarray]:
    """(document ids, boundaries, ids) of a segment."""
    if data[:4] != b"EFID" or data[4] != 2:
        raise ValueError("not a segment of this format")
    _, width, _, n, n_ids, least = struct.unpack_from("<BBHQQq", data, 4)
    ends, at = EliasFano.from_bytes(data, 4 + struct.calcsize("<BBHQQq"), n)
    names, at = EliasFano.from_bytes(data, at, n)
    null = np.unpackbits(np.frombuffer(data, "u1", (n + 7) // 8, at), bitorder="little")[:n]
    ids = np.frombuffer(data, f"<u{width}", n_ids, at + (n + 7) // 8)
    return [None if z else names.select(i) + least for i, z in enumerate(null.tolist())], ends, ids


class Encoder:
    """Whole texts to little-endian id bytes, with a bounded cache of pieces."""

    def __init__(self, path: str, cache: int = CACHE_PIECES) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        vocab = self.tok.get_vocab(with_added_tokens=True)
        size = max(vocab.values()) + 1
        self.width = 2 if size <= 65_536 else 4
        self.kind = f"<u{self.width}"
        self.starts = np.zeros(size, bool)  # ids whose token begins with a space or a line end
        self.starts[[i for t, i in vocab.items() if t[0] in "ĠĊ"]] = True
        self.model, self.codes = self.tok.model, [i.to_bytes(self.width, "little") for i in range(size)]
        self.line = self.plain("\n")
        self.ends = {c: self.plain(c) for c in ".,"}
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.limit = cache
        self.byte_level = self._is_byte_level(path)
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    @staticmethod
    def _is_byte_level(path: str) -> bool:
        """Whether pieces may be encoded apart: byte-level pairs, split by the plain rule, nothing added or normalised."""
        with open(path, encoding="utf-8") as f:
            made = json.load(f)
        pre, model = made.get("pre_tokenizer") or {}, made.get("model") or {}
        plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        return plain and not made.get("normalizer") and model.get("type") == "BPE" and not model.get("dropout")

    def plain(self, text: str) -> bytes:
        return self._ids(text).tobytes()

    def _ids(self, text: str) -> np.ndarray:
        # the batch form, as it keeps no offsets
        return np.array(self.tok.encode_batch_fast([text], add_special_tokens=False)[0].ids if text else [], self.kind)

    def _word(self, word: str, space: str = "") -> bytes:
        """Ids of Latin letters, after a space or nothing: one word to the plain rule, so it goes straight to the pairs."""
        if not word.isascii():
            word = word.encode().decode("latin-1").translate(_BYTES)
        return b"".join([self.codes[t.id] for t in self.model.tokenize(space + word)])

    def _learn(self, missing: list[str]) -> None:
        """Ids of new pieces: taken from the older half of the cache, put together from a known stem, or encoded, all in one text."""
        old, new, need, derived = self.old, self.new, set(), []
        for p in missing:
            if p in old:
                new[p] = old[p]
            elif p[-1] in self.ends and p[-2:-1].isalnum():  # a letter or digit never joins . or ,
                derived.append(p)
                stem = p[:-1]
                if stem in old:
                    new[stem] = old[stem]
                elif stem not in new:
                    need.add(stem)
            else:
                need.add(p)
        if need:
            rest = []
            for p in need:
                word = p[1:] if p[0] == "\n" else p
                if not _letters(word):
                    rest.append(p)
                else:
                    new[p] = self._word(p, "Ġ") if word is p else self.line + self._word(word)
            ids = self._ids("".join([p if p[0] == "\n" else " " + p for p in rest]))
            cut = np.flatnonzero(self.starts[ids])
            if len(cut) != len(rest):
                raise ValueError("pieces and ids do not agree")
            data, cut = ids.tobytes(), (np.append(cut, len(ids)) * self.width).tolist()
            new.update(zip(rest, [data[i:j] for i, j in zip(cut, cut[1:], strict=False)], strict=True))
        for p in derived:
            new[p] = new[p[:-1]] + self.ends[p[-1]]

    def encode(self, text: str) -> bytes:
        if not self.byte_level or _RUNS.search(text) or any(s in text for s in self.special) or text[-1:].isspace():
            return self.plain(text)
        first, *tail = text.replace("\n", " \n").split(" ")
        if not tail:
            return self.plain(first)
        found = list(map(self.new.get, tail))  # one look a piece: the cache is far larger than a processor's
        at = [i for i, ids in enumerate(found) if ids is None]
        if at:
            missing = list({tail[i] for i in at})
            if len(self.new) + len(missing) > self.limit:
                self.old, self.new = self.new, {}
            self._learn(missing)
            for i in at:
                found[i] = self.new[tail[i]]
        return (self._word(first) if _letters(first) else self.plain(first)) + b"".join(found)


@lru_cache(maxsize=2)
def encoder(path: str, cache: int) -> Encoder:
    """One encoder for each Python worker: its cache outlives a task."""
    return Encoder(path, cache)


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID, segment_ids: int = SEGMENT_IDS, cache: int = CACHE_PIECES) -> None:
    """Encode ``docs`` (doc_id, text) and write the format above to ``path``."""

    def encode(batches):
        from pyspark import TaskContext

        enc = encoder(tokenizer, cache)
        end = np.array([end_id], enc.kind).tobytes()
        part, seg = TaskContext.get().partitionId(), 0
        names: list = []
        blobs: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(b) for b in blobs]) // enc.width
            row = [[part], [seg], [len(names)], [int(ends[-1])], [pack(names, ends, b"".join(blobs), enc.width)]]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, kinds, strict=True)], names=["part", "seg", "n_docs", "n_ids", "data"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                blobs.append(enc.encode(text.as_py() or "") + end)
                names.append(doc)
                size += len(blobs[-1]) // enc.width
                if size >= segment_ids:
                    yield close()
                    seg, names, blobs, size = seg + 1, [], [], 0
        if names:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    rows.mapInArrow(encode, _SEGMENT_TYPE).write.option("compression", "zstd").parquet(f"{path}/segments")
    spark = docs.sparkSession
    totals = spark.read.schema(_SEGMENT_TYPE).parquet(f"{path}/segments").groupBy("part").agg(F.sum("n_ids").alias("n"))
    w = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)  # one row per partition of the write
    totals.select("part", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("start")).write.parquet(f"{path}/parts")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of a written folder."""
    seg = spark.read.schema(_SEGMENT_TYPE).parquet(f"{path}/segments")
    starts = bounded(spark.read.schema("part int, start bigint").parquet(f"{path}/parts"), 1_000_000)
    before = W.partitionBy("part").orderBy("seg").rowsBetween(W.unboundedPreceding, -1)
    offsets = seg.select("part", "seg", "n_ids").withColumn("_b", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    offsets = offsets.join(starts, "part").select("part", "seg", (F.col("start") + F.col("_b")).alias("at"))
    offsets = bounded(offsets, 1_000_000)  # one row per segment of about a million ids

    def decode(batches):
        for b in batches:
            for at, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                doc, ef, ids = unpack(data.as_py())
                ends = np.array([ef.select(i) for i in range(ef.n)], np.int64)
                heads = np.concatenate(([0], ends[:-1]))
                wide = ids.astype("<u4")
                crc = [zlib.crc32(wide[s:e]) for s, e in zip(heads.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(at + heads), pa.array(ends - heads), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return seg.join(offsets, ["part", "seg"]).select("at", "data").mapInArrow(decode, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def read_document(spark: SparkSession, path: str, number: int) -> DataFrame:
    """(doc_id, start, ids) of document ``number`` of a written folder, from 0 in the order of writing; no row if there are not so many.

    Counts of documents lead to its segment, ``select`` to its two ends there: nothing but that one segment's blob is read, no other end decoded.
    """
    seg = spark.read.schema(_SEGMENT_TYPE).parquet(f"{path}/segments")
    ends = bounded(spark.read.schema("part int, start bigint").parquet(f"{path}/parts"), 1_000_000)
    parts = seg.groupBy("part").agg(F.sum("n_docs").alias("n"))  # one row per partition of the write
    parts = parts.select("part", "n", F.sum("n").over(W.orderBy("part")).alias("to"))
    where = parts.where(F.col("to") > number).orderBy("part").first()
    left = number - (where.to - where.n) if where else 0
    own = W.partitionBy("part").orderBy("seg")
    found = seg.where(F.col("part") == (where.part if where else -1)).select("part", "seg", "n_docs", "n_ids")
    found = found.select("*", F.sum("n_docs").over(own).alias("to"), (F.sum("n_ids").over(own) - F.col("n_ids")).alias("_b"))
    found = found.where((F.col("to") > left) & (F.col("to") - F.col("n_docs") <= left)).join(ends, "part")
    found = F.broadcast(found.select("part", "seg", (F.lit(left) - F.col("to") + F.col("n_docs")).alias("i"), (F.col("start") + F.col("_b")).alias("at")))  # one row

    def pick(batches):
        for b in batches:
            for i, at, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                doc, ef, ids = unpack(data.as_py())
                lo = ef.select(i - 1) if i else 0
                row = [[doc[i]], [at + lo], [ids[lo : ef.select(i)].astype(np.int64)]]
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["doc_id", "start", "ids"])

    return seg.join(found, ["part", "seg"]).select("i", "at", "data").mapInArrow(pick, "doc_id bigint, start bigint, ids array<bigint>")


def public_tokenizer(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def token_output(docs: DataFrame, tokenizer: str | None = None, path: str | None = None, cache: int = CACHE_PIECES) -> DataFrame:
    """Write ``docs`` in the format and return what the files say."""
    spark = docs.sparkSession
    path = path or f"{work_dir(spark)}/weft-ids-{uuid.uuid4().hex}"
    write_ids(docs, path, tokenizer or public_tokenizer(), cache=cache)
    return read_ids(spark, path)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(documents(spark, sf_dir).select("doc_id", "text"))
