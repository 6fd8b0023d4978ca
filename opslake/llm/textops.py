"""Vectorised text kernels shared by the operators of this subpackage.

Everything works on an Arrow string column as one flat UTF-8 buffer plus
offsets, so a task does numpy passes over a slice of many documents and no
per-word Python.  Slices hold at most ``SLICE_BYTES`` of text (or one document)
and a longer document is hashed in pieces cut at separators, so the temporary
arrays stay bounded whatever the Arrow batch or text size.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
PIECE_BYTES = 4 << 20
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_pow: dict[str, np.ndarray] = {}

#: words are runs of bytes other than blank and \t \n \v \f \r
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[0x20, 9, 10, 11, 12, 13]] = False
#: words are runs of ASCII letters, digits and non-ASCII bytes
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: A-Z to a-z on bytes
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser (bijective); wraps silently."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def give_back() -> None:
    """Free memory that Arrow and the C library hold for later goes back to the system.

    A Python worker outlives its tasks; without this it stays as large as its largest task, beside the executor's JVM.
    """
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row ranges of at most ``limit`` text bytes (one row at least); see ``give_back`` for what follows the last."""
    for b in batches:
        if not b.num_rows:
            continue
        n = pc.fill_null(pc.binary_length(b.column(b.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(n.astype(np.int64))
        at = 0
        while at < b.num_rows:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield b.slice(at, to - at)
            at = to
        del b
    give_back()


def keep_rows(docs, mask):
    """The rows of ``docs`` (all columns as they are) where ``mask`` (string array -> bool array) holds for the text."""
    def run(batches):
        for b in slices(batches):
            yield b.filter(pa.array(mask(b.column(b.schema.get_field_index("text"))), pa.bool_()))
    return docs.mapInArrow(run, docs.schema)


def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    col = pc.fill_null(col, "")
    col = col.cast(pa.large_string())
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "p" not in _pow or len(_pow["p"]) < n:
        m = max(n, SLICE_BYTES + 1)
        with np.errstate(over="ignore"):
            for k, v in (("p", _P), ("i", _PINV)):
                a = np.full(m, v, np.uint64)
                a[0] = 1
                _pow[k] = np.cumprod(a, dtype=np.uint64)
    return _pow["p"], _pow["i"]


def words(raw: np.ndarray, offsets: np.ndarray, kind: np.ndarray = SPACE_WORDS, lower: bool = True):
    """Words of every document: (document index, start byte, end byte, 64-bit hash), in text order.

    ``kind`` is a 256-entry table of word bytes; a document boundary always
    ends a word.  A-Z count as a-z in the hash if ``lower``.
    """
    n = len(raw)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, z, np.empty(0, np.uint64)
    w = kind[raw]
    first = w.copy()
    first[1:] &= ~w[:-1]
    cuts = offsets[(offsets > 0) & (offsets < n)]
    first[cuts] = w[cuts]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[cuts - 1] = w[cuts - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return doc, starts, ends, span_hashes(raw, starts, ends, lower)


def span_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the byte spans (in text order, not overlapping), by prefix sums of a polynomial."""
    out = np.empty(len(starts), np.uint64)
    at = 0
    while at < len(starts):  # pieces of bounded size, cut between spans
        base = starts[at]
        to = max(at + 1, int(np.searchsorted(ends, base + PIECE_BYTES, side="right")))
        stop = ends[to - 1]
        p, inv = _powers(int(stop - base))
        b = raw[base:stop]
        if lower:
            b = LOWER[b]
        acc = np.empty(len(b) + 1, np.uint64)
        acc[0] = 0
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * p[:len(b)], out=acc[1:])
        s, e = starts[at:to] - base, ends[at:to] - base
        out[at:to] = mix((acc[e] - acc[s]) * inv[s])
        at = to
    return out


def stem_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the first ``size`` code points of every word; 0 for shorter words."""
    chars = np.flatnonzero((raw & 0xC0) != 0x80)
    nth = np.searchsorted(chars, starts) + size
    stop = np.r_[chars, np.full(size + 1, len(raw))][nth]
    ok = stop <= ends
    out = np.zeros(len(starts), np.uint64)
    out[ok] = span_hashes(raw, starts[ok], stop[ok])
    return out


def shingles(doc: np.ndarray, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles: (index of the first word, hash).

    A document of 1 to k-1 words has one shingle, its whole word sequence.
    """
    if not len(h):
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    n = len(h) - k + 1
    if n > 0:
        acc = h[:n].copy()
        for j in range(1, k):
            acc = mix(acc * np.uint64(3) + h[j:j + n])
        at = np.flatnonzero(doc[:n] == doc[k - 1:])
        acc = acc[at]
    else:
        at, acc = np.empty(0, np.int64), np.empty(0, np.uint64)
    begin = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[begin, len(doc)])
    short = begin[size < k]
    if len(short):
        more = np.empty(len(short), np.uint64)
        for i, b in enumerate(short):
            x = h[b:b + 1].copy()
            for j in range(1, int(size[np.searchsorted(begin, b)])):
                x = mix(x * np.uint64(3) + h[b + j:b + j + 1])
            more[i] = mix(x + np.uint64(k))[0]
        at, acc = np.r_[at, short], np.r_[acc, more]
        order = np.argsort(at, kind="stable")
        at, acc = at[order], acc[order]
    return at, acc


def by_doc(doc: np.ndarray, n: int) -> np.ndarray:
    """Offsets of each of ``n`` documents into a sorted document-index array."""
    return np.searchsorted(doc, np.arange(n + 1))
