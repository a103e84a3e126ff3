"""Vectorised byte kernels over Arrow text columns.

Texts stay UTF-8 bytes in one buffer; words are maximal runs of bytes other than
space and ``\\x09-\\x0D`` (ASCII, so bytes and code points agree on them).

Hashes: ``span_hash`` mixes eight bytes a round by multiplication and xor-shift
(spans over ``LONG`` bytes: blake2b), so no family of texts collides whatever the
constants, as it does under a plain polynomial modulo 2**64; two different words
agree with probability 2**-64.  ``rolling`` is such a polynomial: it only chooses
and groups anchors, and what it brings together is compared by other means.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LONG = 128
_ODD = np.uint64(0x9E3779B97F4A7C15)
_MUL = np.uint64(0xD6E8FEB86659FD93)
_BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240607).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def release() -> None:
    """Hands freed memory back to the system: Python workers live on between tasks, beside each other in one executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim:
        trim(0)


def parts(column: pa.Array, limit: int = 1 << 19):
    """(first row, last row + 1, bytes, offsets) over runs of rows of about ``limit`` bytes; a null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type):
        kind = np.int64
    else:
        kind = np.int32
    n = len(column)
    if not n:
        return
    bufs = column.buffers()
    offs = np.frombuffer(bufs[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi
    release()


def words(buf: np.ndarray, offs: np.ndarray, gap: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end (bytes) and row of every word: maximal runs of bytes that are not in ``gap``."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, z
    inside = ~gap[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offs[:-1][offs[:-1] < n]
    first[heads] = inside[heads]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    tails = offs[1:][offs[1:] > 0] - 1
    last[tails] = inside[tails]
    s = np.flatnonzero(first)
    return s, np.flatnonzero(last) + 1, np.searchsorted(offs, s, side="right") - 1


def numbers(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """A number for each word (equal for equal words only) and the words by number; some numbers belong to gaps.

    Arrow's dictionary compares the bytes themselves, so no two words share a number.
    """
    if not len(s):
        return np.zeros(0, np.int32), pa.array([], pa.binary())
    ends = np.stack((s, e), axis=1).ravel().astype(np.int32)  # words and the gaps between them, in turn
    both = pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(buf))])
    coded = both.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False)[::2], coded.dictionary


def digest64(data: bytes | memoryview) -> int:
    """Eight bytes of blake2b as a number."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little")


def span_hash(buf: np.ndarray, s: np.ndarray, e: np.ndarray, stretch: int = 1 << 18) -> np.ndarray:
    """A 64-bit hash of each byte span [s, e), a bounded number of spans at a time."""
    if not len(s):
        return np.zeros(0, np.uint64)
    padded = np.concatenate((buf, np.zeros(8, np.uint8)))
    return np.concatenate([_span_hash(padded, s[i : i + stretch], e[i : i + stretch]) for i in range(0, len(s), stretch)])


def _span_hash(padded: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    view = np.ndarray((len(padded) - 7,), "<u8", buffer=padded, strides=(1,))  # eight bytes from every place on
    left = e - s
    out = left.astype(np.uint64) * _ODD + np.uint64(1)
    long = np.flatnonzero(left > LONG)
    todo = np.flatnonzero(left <= LONG)
    head, left, acc, at = s[todo], left[todo], out[todo], 0
    while len(todo):  # eight bytes of every span that has more
        c = view[head + at] & _MASKS[np.clip(left - at, 0, 8)]
        acc = (acc ^ c) * _MUL
        acc ^= acc >> np.uint64(32)
        acc *= _ODD
        acc ^= acc >> np.uint64(29)
        more = left - at > 8
        done = ~more
        out[todo[done]] = acc[done]
        todo, left, head, acc = todo[more], left[more], head[more], acc[more]
        at += 8
    for k in long.tolist():
        out[k] = digest64(memoryview(padded)[int(s[k]) : int(e[k])])
    return mix(out)


def rolling(buf: np.ndarray, n: int) -> np.ndarray:
    """A hash of each run of ``n`` bytes (len(buf) - n + 1 values), from running sums."""
    m = len(buf) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    p, q = (np.full(len(buf) + 1, b, np.uint64) for b in (_BASE, pow(_BASE, -1, 1 << 64)))
    p[0] = q[0] = 1
    np.multiply.accumulate(p, out=p)
    np.multiply.accumulate(q, out=q)
    pre = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(_TABLE[buf] * p[:-1], out=pre[1:])
    return mix((pre[n:] - pre[:m]) * q[:m])


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of ``n`` neighbours in ``h`` (len(h) - n + 1 values)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : i + m]) * _MUL
        out ^= out >> np.uint64(32)
    return mix(out)


def gram_numbers(number: np.ndarray, n: int) -> np.ndarray:
    """A number for each run of ``n`` neighbours (len(number) - n + 1 values), equal for equal runs only."""
    if len(number) < n:
        return np.zeros(0, np.int64)
    number = number.astype(np.int64)
    out, width = number, int(number.max()) + 1
    for i in range(1, n):
        if (int(out.max()) + 1) * width >= 1 << 62:
            out = np.unique(out, return_inverse=True)[1]
        out = out[:-1] * width + number[i:]
    return np.unique(out, return_inverse=True)[1]


def per_row(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many true values each row has."""
    out = np.zeros(len(offs) - 1, np.int64)
    some = np.flatnonzero(offs[1:] > offs[:-1])
    if len(some):
        out[some] = np.add.reduceat(mask.view(np.uint8), offs[:-1][some], dtype=np.int64)
    return out


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Which of ``n`` places lie in a window of ``length`` from one of ``starts``."""
    d = np.zeros(n + 1, np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + length, n), -1)
    return np.cumsum(d[:-1]) > 0


def duplicated(keys: np.ndarray) -> np.ndarray:
    """Which entries have an equal one elsewhere in ``keys``."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        o = np.argsort(keys)
        same = keys[o[1:]] == keys[o[:-1]]
        out[o[1:][same]] = True
        out[o[:-1][same]] = True
    return out


def minima(h: np.ndarray, w: int) -> np.ndarray:
    """Place of the leftmost minimum in each window of ``w`` values (len(h) - w + 1 places): block-wise running minima from both sides."""
    m = len(h) - w + 1
    if m <= 0:
        return np.zeros(0, np.int64)
    blocks = -(-len(h) // w)
    g = np.full(blocks * w, np.iinfo(np.uint64).max, np.uint64)
    g[: len(h)] = h
    g = g.reshape(blocks, w)
    col = np.arange(w)
    base = (np.arange(blocks) * w)[:, None]

    def run(a: np.ndarray, better) -> tuple[np.ndarray, np.ndarray]:
        low = np.minimum.accumulate(a, axis=1)
        new = np.ones(a.shape, bool)
        new[:, 1:] = better(a[:, 1:], low[:, :-1])
        return low, np.maximum.accumulate(np.where(new, col, 0), axis=1)

    low, at = run(g, np.less)
    pre, pre_at = low.ravel(), (at + base).ravel()
    low, at = run(g[:, ::-1], np.less_equal)
    suf, suf_at = low[:, ::-1].ravel(), (w - 1 - at + base[:])[:, ::-1].ravel()
    left = suf[:m] <= pre[w - 1 : w - 1 + m]
    return np.where(left, suf_at[:m], pre_at[w - 1 : w - 1 + m])
