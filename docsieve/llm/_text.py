"""Vectorised byte-level text kernels shared by the Arrow operators.

Everything works on the value buffer of an Arrow string column, so no Python
string is built for a document, and on slices of about ``CHUNK`` bytes, so the
memory of a task does not depend on the batch it is handed.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text that a kernel handles at once; one longer text is a slice of its own.
CHUNK = 1 << 20

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_BASE_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 2**64))
_powers: list[np.ndarray] = []


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of the base and of its inverse modulo 2**64, kept per worker up to CHUNK."""
    if _powers and len(_powers[0]) > n:
        return _powers[0], _powers[1]
    m = max(n, CHUNK) + 1
    out = []
    for b in (_BASE, _BASE_INV):
        p = np.full(m, b, np.uint64)
        p[0] = 1
        np.multiply.accumulate(p, out=p)
        out.append(p)
    if n <= 4 * CHUNK:
        _powers[:] = out
    return out[0], out[1]


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(word: bytes | None = None, sep: bytes | None = None) -> np.ndarray:
    """A 256-entry mask of the bytes that belong to words."""
    t = np.zeros(256, bool) if sep is None else np.ones(256, bool)
    t[list(word if sep is None else sep)] = sep is None
    return t


#: Words are runs of anything but ASCII white space.
NON_SPACE = byte_table(sep=bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, lower-case letters and anything outside ASCII (after A-Z are lowered).
ALNUM = byte_table(word=bytes([*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]))
#: A-Z to a-z, all other bytes as they are.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def slices(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) over runs of rows of about ``limit`` bytes; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return
    wide = pa.types.is_large_string(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    off = np.frombuffer(offs, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, raw[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each document, with the total at last); a word never crosses documents."""
    is_word = table[data]
    if not len(data):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    new = np.zeros(len(data) + 1, bool)
    new[off] = True
    before = np.empty(len(data), bool)
    before[0] = False
    before[1:] = is_word[:-1]
    starts = np.flatnonzero(is_word & (~before | new[:-1]))
    after = np.empty(len(data), bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    ends = np.flatnonzero(is_word & (~after | new[1:])) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the words, A-Z lowered: a polynomial over random byte values, then mixed."""
    up, down = _pow(len(data))
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * up[: len(data)], out=c[1:])
    return mix((c[ends] - c[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def shingles(words: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles as (hashes sorted within documents, offsets).

    A document of fewer than k words, but not none, has its whole sequence as its one shingle.
    """
    n = np.diff(first)
    count = np.where(n == 0, 0, np.maximum(n - k + 1, 1))
    off = np.concatenate(([0], np.cumsum(count)))
    doc = np.repeat(np.arange(len(n)), count)
    at = np.arange(off[-1]) - off[doc] + first[doc]
    h = np.zeros(len(at), np.uint64)
    length = np.minimum(n, k)[doc]
    for i in range(k):
        inside = length > i
        if inside.all():
            h = mix(h * np.uint64(0x9FB21C651E98DF25) + words[at + i])
        else:
            h[inside] = mix(h[inside] * np.uint64(0x9FB21C651E98DF25) + words[at[inside] + i])
    h = mix(h + length.astype(np.uint64))
    order = np.argsort(h)
    few = np.uint16 if len(n) < 1 << 16 else np.int64
    order = order[np.argsort(doc[order].astype(few), kind="stable")]
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[keep], np.concatenate(([0], np.cumsum(np.bincount(doc[keep], minlength=len(n)))))


def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Skips the empty batches that Spark hands over; after the last one, memory that is not used goes back to the system.

    Workers live on from task to task, and what they hold counts against the executor.
    """
    for b in it:
        if b.num_rows:
            yield b
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def _libc_trim():
    """The call of the C library that gives free memory back; other systems have none."""
    try:
        return ctypes.CDLL("libc.so.6").malloc_trim
    except (OSError, AttributeError):
        return None


_trim = _libc_trim()
