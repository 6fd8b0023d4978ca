"""Language identification: averaged hashed subword embeddings, linear softmax, calibrated rejection.

A text's subwords are its UTF-8 byte n-grams (2 to 4 bytes, lower case, every
run of non-letters one blank) hashed into ``BUCKETS`` rows of an embedding
table; the text is the average of its rows and a linear softmax gives language
probabilities.  The model is small and is trained by stochastic gradient descent
in numpy on a bounded sample of labelled rows (``rows_per_lang``); features and
predictions are computed inside tasks over every whole text.  A held-back part of
the sample sets the softmax temperature and the rejection threshold.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm import textops as T

BUCKETS = 4096
_LETTER = np.full(256, 0x20, np.uint8)
_LETTER[97:123] = np.arange(97, 123)
_LETTER[128:] = np.arange(128, 256)


def subword_counts(texts: pa.Array) -> np.ndarray:
    """(documents, BUCKETS) float32 shares of the hashed subwords; zero rows for texts without a letter."""
    blank, none = pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string())
    padded = pc.binary_join_element_wise(none, pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), "")), none, blank)
    raw, off = T.flat(padded)
    b = _LETTER[raw]
    keep = np.ones(len(b), bool)
    keep[1:] = (b[1:] != 0x20) | (b[:-1] != 0x20)
    keep[off[:-1]] = True
    off = np.r_[0, np.cumsum(keep)][off]
    b = b[keep].astype(np.uint32)
    out = np.zeros((len(off) - 1, BUCKETS), np.float32)
    grams, g = [], b
    for n in (2, 3, 4):
        g = g[:-1] * np.uint32(0x01000193) ^ b[n - 1:]
        grams.append(((g * np.uint32(0x9E3779B1)) >> np.uint32(20)).astype(np.int64))
    for i in range(len(off) - 1):
        lo, hi = off[i], off[i + 1]
        c = sum(np.bincount(x[lo:max(lo, hi - n + 1)], minlength=BUCKETS) for n, x in zip((2, 3, 4), grams, strict=True))
        out[i] = c / max(1, c.sum())
    return out


@dataclass
class Model:
    langs: list[str] = field(default_factory=list)
    emb: np.ndarray | None = None
    weight: np.ndarray | None = None
    bias: np.ndarray | None = None
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return (x @ self.emb) @ self.weight + self.bias


def _softmax(z: np.ndarray) -> np.ndarray:
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _sgd(x: np.ndarray, y: np.ndarray, use: np.ndarray, n_lang: int, dim: int, epochs: int, seed: int):
    r = np.random.default_rng(seed)
    emb = r.normal(0, 0.1, (x.shape[1], dim)).astype(np.float32)
    w, b = r.normal(0, 0.1, (dim, n_lang)).astype(np.float32), np.zeros(n_lang, np.float32)
    for epoch in range(epochs):
        rate = 20.0 * (1 - epoch / epochs)
        order = r.permutation(use)
        for at in range(0, len(order), 32):
            i = order[at:at + 32]
            hid = x[i] @ emb
            g = _softmax(hid @ w + b)
            g[np.arange(len(i)), y[i]] -= 1
            g /= len(i)
            up = g @ w.T
            w -= 0.1 * rate * hid.T @ g
            b -= 0.01 * rate * g.sum(0)
            emb -= rate * x[i].T @ up
    return emb, w, b


def _sample(rows: DataFrame, n: dict[str, int], size: int) -> DataFrame:
    """The ``size`` rows of the smallest ``h`` of every language (all, if it has fewer); rows of equal ``h`` count once.

    Only hashes are ranked.  Those that are surely too large for the ``n`` rows
    of a language are left out first; if too few are left, all are ranked.
    """
    def least(part):
        by = Window.partitionBy("lang").orderBy("h")
        rank = part.select("lang", "h").distinct().select("*", F.row_number().over(by).alias("rank")).where(F.col("rank") <= size)
        return {r["lang"]: (r["n"], r["h"]) for r in rank.groupBy("lang").agg(F.count("*").alias("n"), F.max("h").alias("h")).collect()}

    def upto(limit):
        return rows.where(F.col("h") <= F.element_at(F.create_map(*[F.lit(v) for k in sorted(limit) for v in (k, limit[k])]), F.col("lang")))
    limit = {k: -(1 << 63) + min((1 << 64) - 1, ((2 * size + 64) << 64) // v) for k, v in n.items()}
    got = least(upto(limit))
    if any(got.get(k, (0,))[0] < min(size, v) for k, v in n.items()):
        got = least(rows)
    return upto({k: h for k, (_, h) in got.items()}).dropDuplicates(["lang", "h"])


def fit(labelled: DataFrame, rows_per_lang: int = 500, reject_rate: float = 0.001, dim: int = 16, epochs: int = 20,
        seed: int = 7) -> Model:
    """Train on ``labelled`` (doc_id, text, lang).

    ``rows_per_lang`` rows of each language (all, if it has fewer) are used, those
    of the smallest hash of doc_id and text, repeated rows once; a quarter of them
    is kept for calibration.  Rows without
    language or without text are not used; without any row the model knows no
    language.
    """
    rows = labelled.where("lang is not null and text is not null")
    n = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not n:
        return Model()
    pick = _sample(rows.select("doc_id", "text", "lang", F.xxhash64("doc_id", "text", F.lit(seed)).alias("h")), n, rows_per_lang)

    def features(batches):
        for b in T.slices(batches):
            x = subword_counts(b.column("text"))
            at = [np.flatnonzero(v) for v in x]
            yield pa.record_batch([b.column("doc_id"), b.column("lang"), b.column("h"), pa.array([a.astype(np.int32) for a in at], pa.list_(pa.int32())),
                                   pa.array([v[a] for v, a in zip(x, at, strict=True)], pa.list_(pa.float32()))],
                                  ["doc_id", "lang", "h", "at", "share"])
    schema = "doc_id long, lang string, h long, at array<int>, share array<float>"
    got = (pick.select("doc_id", "lang", "h", "text").mapInArrow(features, schema)
           .toPandas().sort_values(["doc_id", "lang", "h"], kind="stable", ignore_index=True))
    langs = sorted(set(got["lang"]))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, (a, s) in enumerate(zip(got["at"], got["share"], strict=True)):
        x[i, a] = s
    y = np.array([langs.index(v) for v in got["lang"]], np.int64)
    del got
    if not len(x):
        return Model()
    held = np.arange(len(x)) % 4 == 3
    use = ~held if held.any() else np.ones(len(x), bool)
    m = Model(langs, *_sgd(x, y, np.flatnonzero(use), len(langs), dim, epochs, seed))
    if held.any():
        z, t = m.logits(x[held]), y[held]
        grid = np.geomspace(0.2, 20, 60)
        loss = [-np.log(_softmax(z / k)[np.arange(len(t)), t] + 1e-12).mean() for k in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
        right = _softmax(z / m.temperature)[np.arange(len(t)), z.argmax(1)][z.argmax(1) == t]
        m.threshold = float(min(0.5, np.quantile(right, reject_rate))) if len(right) else 0.0
    return m


def _predict(model: Model, text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(language index, score, rejected) per text; the index after the last language is ``und``."""
    letter = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    if model.langs:
        p = _softmax(model.logits(subword_counts(text)).astype(np.float64) / model.temperature)
        best, score = p.argmax(1), p.max(1)
    else:
        best, score, letter = np.zeros(len(text), int), np.zeros(len(text)), np.zeros(len(text), bool)
    best, score = np.where(letter, best, len(model.langs)), np.where(letter, score, 0.0)
    return best, score, ~letter | (score < model.threshold)


def keep_identified(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that ``identify`` does not reject, all columns unchanged."""
    return T.keep_rows(docs, lambda text: ~_predict(model, text)[2])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, rejected for every row of ``docs`` (doc_id, text; other columns are ignored).

    ``lang_pred`` is a learned language and ``score`` its calibrated probability;
    null texts and texts without a letter are ``und`` with score 0 and rejected,
    and so is every row if nothing was learned.  ``rejected`` also marks scores
    under the calibrated threshold.  Repeated rows give equal results.
    """
    langs = np.array([*model.langs, "und"], object)

    def run(batches):
        for b in T.slices(batches):
            best, score, rejected = _predict(model, b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.array(langs[best], pa.string()), pa.array(score), pa.array(rejected)],
                                  ["doc_id", "lang_pred", "score", "rejected"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, rejected boolean")
