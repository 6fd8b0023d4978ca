"""Harmonic packing of tokenised documents into sequences of a fixed capacity.

A document is cut into pieces whose lengths lie just under ``capacity / k``; the
pieces of class ``k`` fill sequences with exactly ``k`` pieces each.  Classes are
cut into groups of about ``group_rows`` pieces and every group fills its sequences
on its own, so a hot class is spread over many tasks.  What a group cannot fill
(fewer than k pieces) is fitted together with the other leftovers of the same group
number.
"""

from __future__ import annotations

import bisect
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm import textops as T
from opslake.sources.sinks import materialize

#: texts with other characters (or with an added token's string) go through the tokenizer as a whole; what is
#: left is NFC already, and its lower case does not depend on context
_ODD = r"[^\t\n\v\f\r\x20-\x7e\x{a1}-\x{12f}\x{131}-\x{24f}\x{2010}-\x{2027}]"
#: bounds the memory of a worker's cache; chunks beyond it are encoded for each slice anew
_CACHE_WORDS = 250_000


class WordTokenizer:
    """Ids of whole texts by a ``tokenizers`` file whose words are encoded independently.

    For a file that normalises (NFC, white space, lower case), splits with a
    pattern and merges inside words only, the ids of a text are the ids of its
    words in order; word ids are cached.  Other files, and texts with characters
    or added tokens the word path does not cover, are encoded as a whole.
    """

    def __init__(self, path: str):
        import json

        import regex
        self.path, self._whole, self._parts = path, None, None
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        norm = [(x["type"], x.get("pattern"), x.get("content")) for x in (spec["normalizer"] or {}).get("normalizers", [])]
        pre = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        self.by_word = (norm == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
                        and [x["type"] for x in pre] == ["Split", "ByteLevel"]
                        and pre[0]["invert"] and pre[0]["behavior"] == "Removed" and not pre[1]["use_regex"])
        self.odd = "|".join([_ODD, *(re.escape(x["content"]) for x in spec["added_tokens"])])
        if self.by_word:  # every word ends in exactly one token with the suffix
            vocab = spec["model"]["vocab"]
            self.word_end = np.zeros(max(vocab.values()) + 1, bool)
            self.word_end[[v for k, v in vocab.items() if k.endswith(spec["model"]["end_of_word_suffix"])]] = True
            self.split = regex.compile(pre[0]["pattern"]["Regex"]).findall
        # chunk hashes, rising, and their rows of the pool: arrays take a tenth of a dict's memory
        self.known, self.place = np.empty(0, np.uint64), np.empty(0, np.int64)
        self.pool, self.at = np.empty(0, np.uint32), np.zeros(1, np.int64)

    @property
    def whole(self):
        if self._whole is None:
            from tokenizers import Tokenizer
            self._whole = Tokenizer.from_file(self.path)
        return self._whole

    @property
    def parts(self):
        """The words' own model, without the steps that are done by then."""
        if self._parts is None:
            from tokenizers import Tokenizer, normalizers, pre_tokenizers
            self._parts = Tokenizer.from_file(self.path)
            self._parts.normalizer = normalizers.Sequence([])
            self._parts.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(
                add_prefix_space=False, use_regex=False)])
        return self._parts

    def close(self) -> None:
        """Drops the loaded models, which are read again when needed; the words stay."""
        self._whole = self._parts = None
        T.give_back()

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of blank-free chunks and where each ends: all words in one call, cut behind every word-end token."""
        words = [[x] if x.isalpha() else [x[:-1], x[-1]] if x[-1] in ".,;:!?" and x[:-1].isalpha() else self.split(x) for x in chunks]
        flat = [y for x in words for y in x]
        uniq = dict.fromkeys(flat)
        ids = np.array(self.parts.encode_batch_fast([" ".join(uniq)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.word_end[ids]) + 1
        n = np.diff(ends, prepend=0)
        row = np.fromiter(map(dict(zip(uniq, range(len(uniq)), strict=True)).__getitem__, flat), np.int64, len(flat))
        stop = np.cumsum(n[row])
        ids = ids[np.repeat(ends[row] - stop, n[row]) + np.arange(stop[-1])]
        return ids, stop[np.cumsum([len(x) for x in words]) - 1]

    def ids(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text (null: none).

        Chunks between blanks are looked up by hash, one look-up for each
        distinct chunk of the slice; ids are gathered by position in numpy.
        """
        texts = pc.fill_null(texts.cast(pa.string()), "")
        odd = pc.match_substring_regex(texts, self.odd) if self.by_word else pa.array([True] * len(texts))
        raw, off = T.flat(pc.utf8_lower(pc.if_else(odd, "", texts)))
        doc, start, end, h = T.words(raw, off, lower=False)
        uniq, first, inverse = np.unique(h, return_index=True, return_inverse=True)
        spot = np.searchsorted(self.known, uniq)
        row = np.full(len(uniq), -1, np.int64)
        hit = np.flatnonzero(np.r_[self.known, np.uint64(0)][spot] == uniq)
        hit = hit[spot[hit] < len(self.known)]
        row[hit] = self.place[spot[hit]]
        miss = np.flatnonzero(row < 0)
        pool, at = self.pool, self.at
        if len(miss):
            ids, ends = self._learn([raw[start[i]:end[i]].tobytes().decode() for i in first[miss]])
            row[miss] = np.arange(len(at) - 1, len(at) - 1 + len(miss))
            pool, at = np.r_[pool, ids], np.r_[at, at[-1] + ends]
            if len(self.known) < _CACHE_WORDS:
                self.known, self.place = np.insert(self.known, spot[miss], uniq[miss]), np.insert(self.place, spot[miss], row[miss])
                self.pool, self.at = pool, at
        row = row[inverse]
        size = at[row + 1] - at[row]
        stop = np.cumsum(size)
        out = pool[np.repeat(at[row] - stop + size, size) + np.arange(stop[-1] if len(stop) else 0)].astype("<u4", copy=False)
        cut = np.r_[0, stop][T.by_doc(doc, len(texts))] * 4
        out = out.tobytes()
        got = [out[cut[i]:cut[i + 1]] for i in range(len(texts))]
        for i in np.flatnonzero(odd.to_numpy(zero_copy_only=False)):
            got[i] = self._encode([texts[int(i)].as_py()])[0]
        return got


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per Python worker, kept with its word cache; its models are loaded for each task."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def cuts(n: int, capacity: int, waste: float) -> list[tuple[int, int]]:
    """(length, class) of the pieces of a document of ``n`` tokens.

    Full sequences first; then the rest r is one piece of class k = capacity // r
    if k of them leave at most ``waste`` of a sequence empty, else a piece of
    capacity // (k + 1) tokens is cut off and the rule is applied to what is left.
    """
    out = [(capacity, 1)] * (n // capacity)
    r = n % capacity
    while r:
        k = capacity // r
        if capacity - k * r <= waste * capacity:
            out.append((r, k))
            break
        cut = capacity // (k + 1)
        out.append((cut, k + 1))
        r -= cut
    return out


def _pieces(path: str, end_id: int, capacity: int, waste: float):
    def run(batches):
        tok, plans = tokenizer(path), {}
        for b in T.slices(batches):
            ids = tok.ids(b.column("text"))
            row, start, length, total, kind, data = [], [], [], [], [], []
            for i, raw in enumerate(ids):
                raw += int(end_id).to_bytes(4, "little")
                n, at = len(raw) // 4, 0
                if n not in plans:
                    plans[n] = cuts(n, capacity, waste)
                for size, k in plans[n]:
                    row.append(i)
                    start.append(at)
                    length.append(size)
                    total.append(n)
                    kind.append(k)
                    data.append(raw[4 * at:4 * (at + size)])
                    at += size
            yield pa.record_batch([b.column("doc_id").take(pa.array(row, pa.int32())), pa.array(start, pa.int64()),
                                   pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(kind, pa.int32()),
                                   pa.array(data, pa.binary())], ["doc_id", "start", "length", "doc_tokens", "class", "ids"])
        tok.close()
    return run


def tokenize_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, waste: float = 0.02) -> DataFrame:
    """Pieces of every document: doc_id, start, length, doc_tokens, class, ids (binary, little-endian uint32).

    A document's ids are the tokenizer's ids of its whole text and then
    ``end_id``; null and empty texts have ``end_id`` alone.  Extra columns are
    ignored, repeated rows give their pieces once each.
    """
    return docs.select("doc_id", "text").mapInArrow(
        _pieces(tokenizer_path, end_id, capacity, waste),
        "doc_id long, start long, length long, doc_tokens long, class int, ids binary")


def _fit_leftovers(capacity: int):
    """First-fit decreasing over the leftovers of one group number (fewer than k pieces of each class, whatever the input)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "class", "r"], ascending=[False, True, True], kind="stable")
        room: list[tuple[int, int]] = []   # (free tokens, bin), sorted: the fullest bin that still fits comes first
        bins, offset, n = [], [], 0
        for size in pdf["length"]:
            i = bisect.bisect_left(room, (size, -1))
            free, b = room.pop(i) if i < len(room) else (capacity, n)
            n += b == n
            bins.append(b)
            offset.append(capacity - free)
            if free > size:
                bisect.insort(room, (free - size, b))
        return pdf.assign(offset=offset, sequence_id=pdf["grp"] * (1 << 26) + bins).drop(columns=["class", "grp", "r"])
    return run


def pack(pieces: DataFrame, capacity: int = 2048, group_rows: int = 20_000) -> DataFrame:
    """Place pieces (length, class and any payload columns) into sequences.

    Returns the payload with ``sequence_id`` and ``offset`` (gapless from 0 in
    every sequence).  The payload travels with the pieces: give short columns, or
    the ids themselves.  An empty table gives an empty result.
    """
    p = pieces.withColumn("salt", F.pmod(F.spark_partition_id() * 7919 + F.monotonically_increasing_id(), F.lit(1 << 16)))
    p = materialize(p, "pack-pieces")
    groups = p.groupBy("class").agg(F.ceil(F.count("*") / F.lit(group_rows)).cast("long").alias("parts"))
    # one row per class and there are at most ``capacity`` classes
    p = p.join(F.broadcast(groups), "class").withColumn("grp", F.col("salt") % F.col("parts")).drop("parts", "salt")
    # a stable order within the group, so that a task that runs again gives the same places
    order = [c for c in ("doc_id", "start", "length") if c in p.columns]
    g = Window.partitionBy("class", "grp")
    k = F.col("class").cast("long")
    p = p.withColumn("r", (F.row_number().over(g.orderBy(*order)) - 1).cast("long")).withColumn("m", F.count("*").over(g))
    p = materialize(p.withColumn("fits", F.col("r") < F.col("m") - F.col("m") % k).drop("m"), "pack-ranked")

    keep = [c for c in pieces.columns if c != "class"]
    inside = Window.partitionBy("class", "grp", "bin").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    full = p.where("fits").withColumn("bin", F.floor(F.col("r") / k))
    # ids: class in the high digits (0: leftovers), then group, then bin
    full = full.select(*keep, F.coalesce(F.sum("length").over(inside), F.lit(0)).cast("long").alias("offset"),
                       (k * F.lit(1 << 50) + F.col("grp") * F.lit(1 << 26) + F.col("bin")).alias("sequence_id"))
    rest = p.where("not fits").select(*keep, "class", "grp", "r")
    schema = _schema(rest.select(*keep), "offset long, sequence_id long")
    return full.unionByName(rest.groupBy("grp").applyInPandas(_fit_leftovers(capacity), schema))


def _schema(df: DataFrame, more: str) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", " + more


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, waste: float = 0.02,
                   group_rows: int = 20_000) -> DataFrame:
    """Placed pieces with their ids: doc_id, start, length, doc_tokens, ids, sequence_id, offset."""
    return pack(tokenize_pieces(docs, tokenizer_path, capacity, end_id, waste), capacity, group_rows)


def packed_sequences(placed: DataFrame, capacity: int = 2048, pad_id: int = 0) -> DataFrame:
    """Training rows: sequence_id, input_ids (binary uint32, padded to the capacity), document borders."""
    s = placed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(F.struct("offset", "doc_id", "length", "ids"))).alias("p"))
    pad = F.unhex(F.lit(int(pad_id).to_bytes(4, "little").hex()))
    used = F.aggregate("p", F.lit(0).cast("long"), lambda a, x: a + x["length"])
    body = F.aggregate("p", F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    fill = F.aggregate(F.slice(F.array_repeat(F.lit(0), capacity), F.lit(1), (F.lit(capacity) - used).cast("int")),
                       F.unhex(F.lit("")), lambda a, _: F.concat(a, pad))
    return s.select("sequence_id", F.concat(body, fill).alias("input_ids"),
                    F.transform("p", lambda x: F.struct(x["doc_id"], x["offset"], x["length"])).alias("documents"))
