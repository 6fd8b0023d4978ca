"""Exact top-k inner products by multi-resolution segment statistics.

Over a segment of L dimensions, a vector has a mean m and a deviation s, and

    sum (q_i - c_i)^2  >=  L ((m_q - m_c)^2 + (s_q - s_c)^2)

bounds the distance from below, which for known lengths bounds the inner
product from above by ``sum L (m_q m_c + s_q s_c)``.  More and shorter segments
give tighter bounds.  The search goes from coarse to fine: cells of the table
by the envelope of their members' statistics, then vectors by 4 segments, then
by 16, and exact inner products for what is left.

Candidates are dealt into blocks of bounded size (cell and a hash chunk of it),
each block to one task, as single rows; the queries follow as rows of the same
key and are read as a stream after the block's candidates, so a task holds one
block and one batch of queries.  First each query visits its own cell, which
gives it a lower bound of its k-th score; then it goes on only to the blocks
whose envelope can still reach that.  Nothing is dropped that the bounds do
not exclude.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from opslake.llm import vectors
from opslake.sources.sinks import materialize

#: candidates of a block at least and at most; in between, the table is cut into BLOCKS blocks
BLOCK_ROWS = (4096, 1 << 19)
BLOCKS = 128
#: rows that the cells' centres are learned from
SAMPLE_ROWS = 4096
_NONE = -(1 << 63)


def segment_bounds(dim: int, segments: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(segments, dim) + 1).astype(int))


def statistics(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of each row's segments, both times sqrt(L), so that bounds are plain inner products."""
    cut = segment_bounds(x.shape[1], segments)
    size = np.diff(cut)
    total = np.add.reduceat(x, cut[:-1], axis=1)
    rest = x - np.repeat(total / size, size, axis=1)
    return total / np.sqrt(size), np.sqrt(np.add.reduceat(rest * rest, cut[:-1], axis=1))


def features(x: np.ndarray, segments: int) -> np.ndarray:
    """``features(q) @ features(c).T`` is the upper bound of the inner products."""
    return np.hstack(statistics(x, segments))


def products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact integer inner products: in doubles where every sum is below 2^53, else in longs or Python integers."""
    most = float(np.abs(q).max(initial=0)) * float(np.abs(c).max(initial=0)) * max(q.shape[1], 1)
    if most < 1 << 53:
        return (q.astype(float) @ c.astype(float).T).astype(np.int64)
    if most < 1 << 62:
        return q @ c.T
    got = q.astype(object) @ c.astype(object).T
    return np.clip(got, _NONE + 1, (1 << 63) - 1).astype(np.int64)


@dataclass
class Cells:
    """Centres learned from a bounded sample, with the envelope of every row of each cell; at most BLOCKS cells."""
    centres: np.ndarray
    chunks: np.ndarray
    low: np.ndarray
    high: np.ndarray
    dev: np.ndarray

    def bound(self, q: np.ndarray) -> np.ndarray:
        """Upper bounds of the inner products of each query with every row of each cell."""
        mean, dev = statistics(q, 16)
        pos, neg = np.maximum(mean, 0), np.minimum(mean, 0)
        # around the centre: q.c = q.centre + q.(c - centre)
        out = q @ self.centres.T + pos @ self.high.T + neg @ self.low.T + dev @ self.dev.T
        return out + _slack(out)


def _slack(bound):
    return 1e-3 + 1e-9 * np.abs(bound)


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    x = x.astype(float)
    out = np.empty(len(x), np.int32)
    for at in range(0, len(x), 8192):
        out[at:at + 8192] = (x[at:at + 8192] @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)
    return out


def _centres(rows: DataFrame, dim: int, count: int) -> np.ndarray:
    """Centres from the SAMPLE_ROWS distinct vectors of smallest hash; they only steer the search, never its result."""
    got = rows.select("x").distinct().orderBy(F.xxhash64("x"), "x").limit(SAMPLE_ROWS).toPandas()["x"]
    x = vectors.unpack(pa.array([bytes(b) for b in got], pa.binary()), dim).astype(float)
    count = min(count, len(x))
    centres = x[:count]
    for _ in range(8):
        home = nearest(x, centres)
        size = np.bincount(home, minlength=count)
        sums = np.zeros_like(centres)
        np.add.at(sums, home, x)
        centres = np.where(size[:, None] > 0, sums / np.maximum(size, 1)[:, None], centres)
    return centres


def _cells(rows: DataFrame, centres: np.ndarray, dim: int, block_rows: int) -> Cells:
    def run(batches):
        best = {}
        for b in batches:
            home = b.column("cell").to_numpy()
            x = vectors.unpack(b.column("x"), dim).astype(float)
            mean, dev = statistics(x - centres[home], 16)
            for k in np.unique(home):
                at = home == k
                new = (int(at.sum()), mean[at].min(axis=0), mean[at].max(axis=0), dev[at].max(axis=0))
                old = best.get(k)
                best[k] = new if old is None else (old[0] + new[0], np.minimum(old[1], new[1]), np.maximum(old[2], new[2]),
                                                  np.maximum(old[3], new[3]))
        for k, (n, *sides) in best.items():
            yield pa.RecordBatch.from_arrays([pa.array([int(k)] * len(sides[0]), pa.int32()), pa.array(np.arange(len(sides[0])), pa.int32()),
                                              pa.array([n] * len(sides[0]), pa.int64()), *(pa.array(s) for s in sides)],
                                             ["cell", "seg", "n", "low", "high", "dev"])
    got = (rows.mapInArrow(run, "cell int, seg int, n long, low double, high double, dev double").groupBy("cell", "seg")
           .agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.max("dev").alias("dev"))
           .orderBy("cell", "seg").toPandas())
    segs = len(segment_bounds(dim, 16)) - 1
    side = {c: np.zeros((len(centres), segs)) for c in ("low", "high", "dev")}
    chunks = np.zeros(len(centres), int)
    for c, v in side.items():
        v[got["cell"], got["seg"]] = got[c]
    chunks[got["cell"]] = -(-got["n"] // block_rows)
    return Cells(centres, chunks, **side)


def _search(dim: int, k: int):
    """Map over rows sorted by (block, kind): a block's candidates (kind 0), then its queries (kind 1)."""
    def run(batches):
        block, held, ready = None, [], None
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("block").to_numpy() * 2 + b.column("kind").to_numpy()
            cuts = np.r_[0, np.flatnonzero(np.diff(key)) + 1, len(key)]
            for lo, hi in zip(cuts[:-1], cuts[1:], strict=True):
                part = b.slice(lo, hi - lo)
                if key[lo] // 2 != block:
                    block, held, ready = key[lo] // 2, [], None
                if key[lo] % 2 == 0:
                    held.append((part.column("vec_id").to_pandas().astype("Int64"), vectors.unpack(part.column("x"), dim)))
                    continue
                if ready is None:
                    ready, held = _Block(held, dim), []
                for at in range(0, part.num_rows, 512):
                    yield from ready.best(part.slice(at, 512), k)
    return run


class _Block:
    """The candidates of one block, in pieces of 4096 with their statistics."""
    PIECE = 4096

    def __init__(self, held, dim):
        self.dim = dim
        x = np.concatenate([v for _, v in held]) if held else np.empty((0, dim), np.int64)
        ids = pd.concat([i for i, _ in held]) if held else pd.Series([], dtype="Int64")
        # ties go to the smaller vec_id, null last: in this order the first of equal scores wins
        order = np.argsort(ids.fillna(2 ** 63 - 1).to_numpy(np.int64), kind="stable")
        self.null = ids.isna().to_numpy()[order]
        self.ids = ids.fillna(2 ** 63 - 1).to_numpy(np.int64)[order]
        x = x[order]
        self.pieces = []
        for at in range(0, len(x), self.PIECE):
            p = x[at:at + self.PIECE]
            f = p.astype(float)
            self.pieces.append((at, p, features(f, 4), features(f, 16)))

    def best(self, part, k):
        qid = part.column("vec_id").to_numpy()
        q = vectors.unpack(part.column("x"), self.dim)
        floor = part.column("floor").to_numpy().copy()
        qf = q.astype(float)
        coarse, fine = features(qf, 4), features(qf, 16)
        kept = [None] * len(q)  # (scores, places) of the best so far, by falling score and then place
        for at, x, c4, c16 in self.pieces:
            rows, cols = np.arange(len(q)), np.arange(len(x))
            for mine, theirs in ((coarse, c4), (fine, c16)):
                bound = mine[rows] @ theirs[cols].T
                can = bound + _slack(bound) >= floor[rows, None]
                live, seen = can.any(axis=1), can.any(axis=0)
                rows, cols = rows[live], cols[seen]
                can = can[np.ix_(live, seen)]
                if not len(rows):
                    break
            if not len(rows):
                continue
            score = products(q[rows], x[cols])
            can &= score >= floor[rows, None]
            can &= (self.ids[at + cols][None, :] != qid[rows, None]) | self.null[at + cols][None, :]
            for r, mask, s in zip(rows, can, score, strict=True):
                c = np.flatnonzero(mask)
                if not len(c):
                    continue
                s, place = s[c], at + cols[c]
                if kept[r] is not None:
                    s, place = np.r_[kept[r][0], s], np.r_[kept[r][1], place]
                if len(s) > k:
                    last = np.partition(s, len(s) - k)[len(s) - k]
                    keep = s >= last
                    s, place = s[keep], place[keep]
                order = np.lexsort((place, -s))[:k]
                kept[r] = s[order], place[order]
                if len(order) == k:
                    floor[r] = max(floor[r], s[order[-1]])
        found = [(i, v) for i, v in enumerate(kept) if v is not None]
        if found:
            place = np.concatenate([v[1] for _, v in found])
            each = np.repeat([i for i, _ in found], [len(v[0]) for _, v in found])
            yield pa.RecordBatch.from_arrays([pa.array(qid[each]), part.column("x").take(pa.array(each)),
                                              pa.array(self.ids[place], mask=self.null[place]),
                                              pa.array(np.concatenate([v[0] for _, v in found]))],
                                             ["query_id", "qx", "vec_id", "score"])


def _best(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query; a window-group limit keeps at most k a task before the shuffle."""
    w = Window.partitionBy("query_id", "qx").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_k(df: DataFrame, k: int = 20, every: int = 20, scale: int = 64, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` largest inner products of floor(scale * v) for every query.

    Queries are the rows whose vec_id is divisible by ``every``; candidates are
    all rows of another vec_id.  Ties go to the smaller vec_id, null last.
    Rows that do not take part (``vectors.usable``) are neither.  A null
    vec_id is no query.  Repeated candidate rows each count; repeated query
    rows of one vec_id and vector are one query, and a vec_id with several
    vectors has one list for each.  An empty table gives no rows; other columns
    are not read.
    """
    spark = df.sparkSession
    rows, dim, n = vectors.usable(df, vector, id_col)
    if not dim:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    size = min(max(n // BLOCKS, BLOCK_ROWS[0]), BLOCK_ROWS[1])
    plain = vectors.packed(rows, dim, scale)
    centres = _centres(plain, dim, max(1, min(BLOCKS, n // size)))

    def home(batches):
        for b in batches:
            cell = nearest(vectors.unpack(b.column("x"), dim), centres)
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), b.column("x"), pa.array(cell), pa.array(np.arange(len(cell)))],
                                             ["vec_id", "x", "cell", "spot"])

    placed = materialize(plain.mapInArrow(home, "vec_id long, x binary, cell int, spot long"), "topk-vectors")
    cells = _cells(placed, centres, dim, size)
    first = np.r_[0, np.cumsum(cells.chunks)[:-1]]
    blocks = int(cells.chunks.sum())
    per_cell = F.array(*[F.lit(int(max(c, 1))) for c in cells.chunks])
    start = F.array(*[F.lit(int(c)) for c in first])

    def block(*by):
        chunk = F.pmod(F.xxhash64(*by), F.element_at(per_cell, F.col("cell") + 1).cast("long"))
        return (F.element_at(start, F.col("cell") + 1) + chunk).cast("int")

    # the written place of a row takes part, so that copies of one row are spread over the chunks of their cell
    cand = placed.select(block("vec_id", "x", "spot").alias("block"), F.lit(0).alias("kind"), "vec_id", "x", F.lit(_NONE + 1).alias("floor"))
    queries = placed.where(F.col("vec_id") % every == 0).select("vec_id", "x", "cell").distinct()
    schema = "query_id long, qx binary, vec_id long, score long"

    def searched(ask):
        both = cand.unionByName(ask.select("block", F.lit(1).alias("kind"), "vec_id", "x", "floor"))
        dealt = both.repartition(max(blocks, 1), "block").sortWithinPartitions("block", "kind")
        return dealt.mapInArrow(_search(dim, k), schema)

    at_home = queries.select(block("vec_id", "x").alias("block"), "vec_id", "x", F.lit(_NONE + 1).alias("floor"))
    near = materialize(_best(searched(at_home), k).drop("rank"), "topk-near")
    floors = near.groupBy("query_id", "qx").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(_NONE + 1).alias("floor"))

    def onward(batches):
        for b in batches:
            q = vectors.unpack(b.column("x"), dim)
            # what is not known yet has the lowest floor and goes everywhere
            can = cells.bound(q.astype(float)) >= b.column("floor").to_numpy()[:, None]
            own = b.column("own").to_numpy()
            width = np.where(can, cells.chunks, 0)
            each = np.repeat(np.arange(len(q)), width.sum(axis=1))
            todo = np.concatenate([np.arange(first[c], first[c] + cells.chunks[c]) for c in np.nonzero(can)[1]]
                                  or [np.empty(0, int)]).astype(np.int32)
            keep = todo != own[each]
            each = pa.array(each[keep])
            yield pa.RecordBatch.from_arrays([pa.array(todo[keep]), b.column("vec_id").take(each), b.column("x").take(each),
                                              b.column("floor").take(each)], ["block", "vec_id", "x", "floor"])

    known = (queries.select("vec_id", "x", block("vec_id", "x").alias("own"))
             .join(floors.withColumnsRenamed({"query_id": "vec_id", "qx": "x"}), ["vec_id", "x"], "left")
             .withColumn("floor", F.coalesce("floor", F.lit(_NONE + 1))))
    far = searched(known.mapInArrow(onward, "block int, vec_id long, x binary, floor long"))
    return _best(near.unionByName(far), k).select("query_id", "rank", "vec_id", "score")
