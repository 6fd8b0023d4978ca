"""Benchmark decontamination: size-partitioned MinHash containment search, exact verification.

Short items are looked for inside whole documents.  An item's word shingles are a
set of ``n`` hashes and a document contains it if it has at least
``ceil(containment * n)`` of them.  Items are partitioned by size (powers of two);
a partition with upper size ``u`` sketches each item by its ``floor((1 - c) u) + 1``
smallest hashes (a bottom-k MinHash).  Fewer hashes than that can be missing, so a
document that contains the item holds at least one sketch value: the search misses
nothing, at any document length.  Candidates are verified by exact containment.

Documents are read once per block of items and never shuffled; items come in blocks
of bounded bytes, so the driver and the tasks hold one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import textops as T


def _grams(text: pa.Array, ks: list[int]) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Per k: offsets of the documents and hashes of their k-word shingles (no short form); and words per document."""
    raw, off = T.flat(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), "")))
    doc, _, _, h = T.words(raw, off, T.ALNUM_WORDS, lower=False)
    count = np.diff(T.by_doc(doc, len(off) - 1))
    out = {}
    for k in ks:
        n = len(h) - k + 1
        if n <= 0:
            out[k] = np.zeros(len(off), np.int64), np.empty(0, np.uint64)
            continue
        acc = h[:n].copy()
        for j in range(1, k):
            acc = T.mix(acc * np.uint64(3) + h[j:j + n])
        at = np.flatnonzero(doc[:n] == doc[k - 1:])
        out[k] = T.by_doc(doc[at], len(off) - 1), acc[at]
    return count, out


class ItemIndex:
    """Sketch index over one block of items, per shingle length."""

    def __init__(self, ids: np.ndarray, texts: list[str], ngram: int, containment: float):
        count, _ = _grams(pa.array(texts, pa.string()), [])
        size = np.minimum(count, ngram)
        self.ids, self.sets, self.need = ids, {}, {}
        sketch: dict[int, list[tuple[int, int]]] = {}
        for k in sorted({int(x) for x in size if x}):
            at, h = _grams(pa.array(texts, pa.string()), [k])[1][k]
            for i in np.flatnonzero(size == k):
                s = np.unique(h[at[i]:at[i + 1]])
                upper = 1 << int(len(s) - 1).bit_length()
                keep = int((1 - containment) * upper + 1e-9) + 1
                self.sets[i], self.need[i] = s, int(np.ceil(containment * len(s) - 1e-9))
                sketch.setdefault(k, []).extend((int(x), int(i)) for x in s[:keep])
        self.ks = sorted(sketch)
        self.keys, self.rows, self.seen = {}, {}, {}
        for k, v in sketch.items():
            v.sort()
            self.keys[k], self.rows[k] = np.array([x for x, _ in v], np.uint64), np.array([i for _, i in v])
            self.seen[k] = np.zeros(1 << 20, bool)
            self.seen[k][(self.keys[k] >> np.uint64(44)).astype(np.int64)] = True

    def matches(self, text: pa.Array):
        """(document index, item index, shared shingles) of every contained item."""
        _, grams = _grams(text, self.ks)
        for k in self.ks:
            off, h = grams[k]
            maybe = np.flatnonzero(self.seen[k][(h >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            lo, hi = np.searchsorted(self.keys[k], h[maybe], "left"), np.searchsorted(self.keys[k], h[maybe], "right")
            doc = np.searchsorted(off, maybe, "right") - 1
            hit = np.flatnonzero(hi > lo)
            cand = {(int(doc[j]), int(i)) for j in hit for i in self.rows[k][lo[j]:hi[j]]}
            last, have = -1, None
            for d, i in sorted(cand):
                if d != last:
                    last, have = d, np.unique(h[off[d]:off[d + 1]])
                s = self.sets[i]
                at = np.minimum(np.searchsorted(have, s), len(have) - 1)
                shared = int((have[at] == s).sum())
                if shared >= self.need[i]:
                    yield d, i, shared


def _blocks(items: DataFrame, ngram: int, containment: float, block_bytes: int):
    """Index of one block of distinct item texts after the other; a block holds about ``block_bytes``."""
    texts = items.where("text is not null").select("text", F.xxhash64("text").alias("tid")).dropDuplicates(["tid"])
    total = texts.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    for k in range(blocks):
        part = texts.where(F.pmod("tid", F.lit(blocks)) == k).toPandas()
        yield ItemIndex(part["tid"].to_numpy(np.int64), part["text"].tolist(), ngram, containment)


def remove_contaminated(docs: DataFrame, items: DataFrame, ngram: int = 5, containment: float = 0.8,
                        block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of ``docs`` that contain no item (see ``contained_items``), all columns unchanged."""
    def clean(index):
        def mask(text):
            ok = np.ones(len(text), bool)
            ok[[d for d, _, _ in index.matches(text)]] = False
            return ok
        return mask
    for index in _blocks(items, ngram, containment, block_bytes):
        docs = T.keep_rows(docs, clean(index))
    return docs


def contained_items(docs: DataFrame, items: DataFrame, ngram: int = 5, containment: float = 0.8,
                    block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs (doc_id, item_id) with the item contained in the document: n_item_shingles, n_shared, containment.

    Words are runs of letters, digits and non-ASCII characters, lower case.  An
    item of fewer than ``ngram`` words is one shingle of all its words.  Items
    without a word (null, empty) are in no document, nor are items in null or
    empty documents.  Repeated document rows give repeated pairs; equal items
    each get their pairs.  Extra columns are ignored; an empty side gives an
    empty result.
    """
    schema = "doc_id long, tid long, n_item_shingles long, n_shared long"
    out = None
    for index in _blocks(items, ngram, containment, block_bytes):

        def run(batches, index=index):
            for b in T.slices(batches):
                got = list(index.matches(b.column("text")))
                d = pa.array([x for x, _, _ in got], pa.int32())
                yield pa.record_batch([b.column("doc_id").take(d), pa.array([int(index.ids[i]) for _, i, _ in got], pa.int64()),
                                       pa.array([len(index.sets[i]) for _, i, _ in got], pa.int64()),
                                       pa.array([s for _, _, s in got], pa.int64())],
                                      ["doc_id", "tid", "n_item_shingles", "n_shared"])
        got = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = got if out is None else out.unionByName(got)
    named = items.where("text is not null").select("item_id", F.xxhash64("text").alias("tid"))
    return out.join(named, "tid").select("doc_id", "item_id", "n_item_shingles", "n_shared",
                                         (F.col("n_shared") / F.col("n_item_shingles")).alias("containment"))
