"""Quality classifier: random Fourier features over document statistics, ridge regression, isotonic calibration.

One pass over the texts gives a short row of statistics per document; that slim
table is written once.  Training joins it with the labels, maps it through random
Fourier features (a Gaussian kernel) and solves ridge regression from normal
equations that are summed per partition and then per matrix row, so the driver
only receives a matrix of the number of features.  Isotonic regression over score
bins of a separate part of the labels turns ridge scores into probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import textops as T
from opslake.sources.sinks import materialize

STATS = ("log_words", "word_len", "word_len_sd", "upper", "digit", "space", "newline", "accent", "sentence_mark", "shout", "bar",
         "symbol", "other_mark", "distinct", "top_word", "repeat", "distinct_pairs", "upper_words", "mark_words",
         "short_words", "distinct_lines", "worst_window")
_KIND = np.full(256, 9, np.uint8)                    # other marks
_KIND[97:123] = 0
_KIND[65:91] = 1
_KIND[48:58] = 2
_KIND[[32, 9, 11, 12, 13]] = 3
_KIND[10] = 4
_KIND[128:] = 5
_KIND[[44, 46, 58, 59, 63]] = 6                      # , . : ; ?
_KIND[33] = 7
_KIND[124] = 8
_KIND[[35, 36, 37, 38, 42, 64, 94, 126]] = 10        # # $ % & * @ ^ ~
_LINES = np.ones(256, bool)
_LINES[[10, 13]] = False
WINDOW = 50


def statistics(text: pa.Array) -> np.ndarray:
    """(documents, len(STATS)) float64; zeros for empty texts."""
    raw, off = T.flat(text)
    kind = _KIND[raw]
    doc, s, e, h = T.words(raw, off)
    ldoc, _, _, lh = T.words(raw, off, _LINES, lower=False)
    cut, lcut = T.by_doc(doc, len(off) - 1), T.by_doc(ldoc, len(off) - 1)
    size = e - s
    is_up = np.r_[0, np.cumsum(kind == 1)]
    up = is_up[e] - is_up[s] > 0.6 * size
    tail = kind[e - 1] if len(e) else np.empty(0, np.uint8)
    out = np.zeros((len(off) - 1, len(STATS)))
    for i in range(len(out)):
        n = off[i + 1] - off[i]
        a, b = cut[i], cut[i + 1]
        m = b - a
        if not m:
            continue
        k = np.bincount(kind[off[i]:off[i + 1]], minlength=11) / n
        w, z = h[a:b], size[a:b]
        _, c = np.unique(w, return_counts=True)
        pairs = w[1:] * np.uint64(3) + w[:-1]
        first = np.zeros(m, bool)
        first[np.unique(w, return_index=True)[1]] = True
        seen = np.r_[0, np.cumsum(w[1:] == w[:-1]), 0][:m]
        far = np.minimum(np.arange(m) + WINDOW, m - 1)
        worst = (seen[far] - seen).max() / WINDOW
        lines = lh[lcut[i]:lcut[i + 1]]
        out[i] = (np.log1p(m), z.mean(), z.std(), k[1], k[2], k[3], k[4], k[5], k[6], k[7], k[8], k[10], k[9],
                  len(c) / m, c.max() / m, (w[1:] == w[:-1]).sum() / m, len(np.unique(pairs)) / max(1, m - 1),
                  up[a:b].mean(), np.isin(tail[a:b], (7, 8, 10)).mean(), (z <= 3).mean(),
                  len(np.unique(lines)) / max(1, len(lines)), worst)
    return out


def document_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` (array) of every row; null and empty texts give zeros, other columns are ignored."""
    def run(batches):
        for b in T.slices(batches):
            x = statistics(b.column("text"))
            yield pa.record_batch([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(STATS)).cast(
                pa.list_(pa.float64()))], ["doc_id", "stats"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, stats array<double>")


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    freq: np.ndarray
    phase: np.ndarray
    beta: np.ndarray
    knots: np.ndarray
    values: np.ndarray

    def features(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.c_[np.sqrt(2 / len(self.phase)) * np.cos(z @ self.freq + self.phase), np.ones(len(x))]

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.features(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.knots):
            return np.full(len(x), float(self.values[0]))
        return np.interp(self.raw(x), self.knots, self.values)


def isotonic(score: np.ndarray, weight: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: (mean score, mean label) of the blocks, in rising order."""
    blocks: list[list[float]] = []
    for s, w, v in zip(score, weight, y, strict=True):
        blocks.append([s * w, w, v * w])
        while len(blocks) > 1 and blocks[-2][2] / blocks[-2][1] >= blocks[-1][2] / blocks[-1][1]:
            top = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], top, strict=True)]
    return np.array([b[0] / b[1] for b in blocks]), np.array([b[2] / b[1] for b in blocks])


def _matrix(batches, col: str = "stats"):
    for b in batches:
        if b.num_rows:
            yield b, np.array(b.column(col).flatten()).reshape(b.num_rows, -1)


def fit(rows: DataFrame, features: int = 256, ridge: float = 1e-3, seed: int = 11, bins: int = 2000) -> Model:
    """Train on ``rows`` (doc_id, stats, label 0/1).

    Rows whose crc32(doc_id) mod 5 is 1 are kept for calibration, all others go
    into the normal equations.  All rows are used.  Without rows of both kinds
    every score is the mean label (0.5 without any row).
    """
    d = len(STATS)
    rows = materialize(rows.where("label is not null").select("doc_id", "stats", "label"), "quality-train")
    cal = F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 = 1")
    agg = [F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(d)] + [F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(d)]
    one = rows.agg(F.count("*").alias("n"), F.avg("label").alias("p"), *agg).first()
    r = np.random.default_rng(seed)
    m = Model(np.zeros(d), np.ones(d), r.normal(0, 1 / np.sqrt(d), (d, features)), r.uniform(0, 2 * np.pi, features),
              np.zeros(features + 1), np.empty(0), np.array([0.5 if one["p"] is None else one["p"]]))
    if not one["n"] or one["p"] in (0.0, 1.0):
        return m
    m.mean = np.array([one[f"m{i}"] for i in range(d)])
    m.scale = np.maximum(np.array([one[f"s{i}"] for i in range(d)]), 1e-6)

    def partial(batches):
        total = None
        for b, x in _matrix(batches):
            z = m.features(x)
            y = np.asarray(b.column("label").to_numpy(zero_copy_only=False), float)
            part = np.c_[z.T @ z, z.T @ y]
            total = part if total is None else total + part
        if total is not None:
            yield pa.record_batch([pa.array(np.arange(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), 0)]})

    parts = rows.where(~cal).select("stats", "label").mapInArrow(partial, "i int, v array<double>")
    got = parts.groupBy("i").applyInPandas(add, "i int, v array<double>").toPandas().sort_values("i")
    if not len(got):
        return m
    a = np.stack(got["v"].to_list())
    n = a[-1, features]
    m.beta = np.linalg.solve(a[:, :-1] + ridge * n * np.diag(np.r_[np.ones(features) / features, 0] + 1e-9), a[:, -1])

    def binned(batches):
        for b, x in _matrix(batches):
            at = np.clip(((m.raw(x) + 0.5) / 2 * bins).astype(int), 0, bins - 1)
            yield pa.record_batch([pa.array(at, pa.int32()), b.column("label").cast(pa.float64())], ["bin", "label"])
    cells = (rows.where(cal).select("stats", "label").mapInArrow(binned, "bin int, label double")
             .groupBy("bin").agg(F.count("*").alias("n"), F.avg("label").alias("y")).toPandas().sort_values("bin"))
    if len(cells):
        m.knots, m.values = isotonic((cells["bin"].to_numpy() + 0.5) / bins * 2 - 0.5, cells["n"].to_numpy(float), cells["y"].to_numpy())
    return m


def score(stats: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1) of every row of a statistics table; empty texts are scored like any other row."""
    def run(batches):
        for b, x in _matrix(batches):
            yield pa.record_batch([b.column("doc_id"), pa.array(np.clip(model.score(x), 0.0, 1.0))], ["doc_id", "score"])
    return stats.select("doc_id", "stats").mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs`` whose score reaches ``threshold``, all columns unchanged, repeated rows and null ids included.

    Learns from ``labels`` (doc_id, label); the second pass scores inside the
    tasks, so no text is shuffled.  Empty labels score 0.5.
    """
    model = fit(document_statistics(docs).join(labels.select("doc_id", "label"), "doc_id"))
    return T.keep_rows(docs, lambda text: model.score(statistics(text)) >= threshold)


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score for every row of ``docs``, learned from ``labels`` (doc_id, label); pass training labels only.

    Null and empty texts, repeated rows and extra columns: see ``document_statistics``
    and ``score``; an empty ``docs`` gives an empty result, empty labels score 0.5.
    """
    stats = materialize(document_statistics(docs), "quality-stats")
    rows = stats.join(labels.select("doc_id", "label"), "doc_id")
    return score(stats, fit(rows))
