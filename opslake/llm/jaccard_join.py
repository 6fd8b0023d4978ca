"""N-gram Jaccard join: count vectors over shingle groups, R-tree bound, exact verification.

Method.  A document's shingle hashes are dealt into groups by their high bits;
the counts per group are its point.  Two sets of Jaccard similarity >= t differ
in at most ``D = 2N(1-t)/(1+t)`` shingles (N: largest size of their size class),
so with more than D groups at least one group is the same in both.  That cell
(size class, group, content checksum) places points in buckets without missing
a pair; an R-tree over the count vectors of a bucket bounds the overlap by
``sum(min(query, node maximum))`` and only pairs whose bound reaches the needed
overlap are verified, by intersecting the exact hash sets.

Hot groups.  Equal sets are one class (one point) from the start.  Members of a
bucket are first tried against its two extreme members; what that connects is one
component, and a bucket of one component needs nothing more.  Of buckets with the
same members one is kept.  The rest goes to the
R-tree, which only looks for pairs of different components; a bucket of more than
``bucket_rows`` points is cut into blocks that are searched block against block.  A
search reports a forest of the pairs that pass the bound; buckets whose forest has a
pair that fails the exact test are searched again with the exact test inside, by
families of components that such forests connect, in blocks of the same size.  No pair
is capped or sampled, and no group's pairs are all written out.

Hash sets are stored only for sets of a pair to be verified: a pass over the documents
makes them again where a bitmap of fixed size has the text's hash.  Texts are not
shuffled, but for those of the rows that ``one_per_group`` may drop, which such a
bitmap picks as well.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from contextlib import contextmanager
from fractions import Fraction
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm import textops as T
from opslake.llm.graph import connected_components
from opslake.sources.sinks import materialize

CLASS_RATIO = 2 ** 0.5


def _bounds(upto: int) -> list[int]:
    """Upper sizes of the size classes: 1, 2, 3, 4, 6, 8, 12, 16 ..."""
    out, x = [1], 1.0
    while out[-1] < upto:
        x *= CLASS_RATIO
        out.append(max(out[-1] + 1, int(x)))
    return out


_BOUNDS = _bounds(1 << 40)
BOUNDS = np.array(_BOUNDS, np.int64)
#: the low bits of a cell's key are its size class
KC = 128
#: bits of the map of wanted texts: 2 MiB, whatever the input
WANTED_BITS = 1 << 24
#: bytes of rows that a task hands to Python at a time, and of what a search step makes at a time
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"
STEP_BYTES = 1 << 19
#: a set or point of more bytes counts as several rows when buckets are cut into blocks
ROW_BYTES = 1 << 13
#: every other byte of a word of eight counts
_LANES = np.uint64(0x00FF00FF00FF00FF)


def _fine(t: Fraction) -> int:
    """Coordinates of an indexed point for each cell group: some three shingles a coordinate bound the overlap well enough."""
    return max(1, round(0.3 / max(0.01, float(2 * (1 - t) / (1 + t)))))


@lru_cache(None)
def _groups(c: int, t: Fraction) -> tuple[int, int]:
    """(number of groups, empty groups allowed) of size class ``c``."""
    diff = math.floor(2 * int(BOUNDS[c]) * (1 - t) / (1 + t))
    spare = diff // 32 + (diff > 0)
    return diff + 1 + spare, spare


def _classes(n: int, t: Fraction) -> list[int]:
    """Own size class and, if a set as similar as ``t`` can lie in it, the next ones."""
    out = [bisect_left(_BOUNDS, n)]
    while (_BOUNDS[out[-1]] + 1) * t.numerator <= n * t.denominator:
        out.append(out[-1] + 1)
    return out


@lru_cache(None)
def _names(c: int, m: int) -> np.ndarray:
    return T.mix(np.arange(m, dtype=np.uint64) * np.uint64(1 << 20) + np.uint64(c))


def _counts(s: np.ndarray, m: int) -> np.ndarray:
    """Count vector of a sorted hash set over ``m`` groups of equal hash ranges."""
    return np.diff(_edges(s, m))


def _edges(s: np.ndarray, m: int) -> np.ndarray:
    g = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
    return np.searchsorted(g, np.arange(m + 1, dtype=np.uint64))


def _cells(s: np.ndarray, t: Fraction) -> np.ndarray:
    """Keys of a set's cells: one per size class and non-empty group (empty groups only if more than the spare)."""
    out = [np.empty(0, np.uint64)]
    sums = np.zeros(len(s) + 1, np.uint64)
    np.cumsum(T.mix(s + np.uint64(77)), out=sums[1:])
    for c in _classes(len(s), t):
        m, spare = _groups(c, t)
        if m == 1:  # no difference is allowed: only equal sets link, and they are one class already
            continue
        at = _edges(s, m)
        n = np.diff(at)
        keys = T.mix((sums[at[1:]] - sums[at[:-1]]) ^ _names(c, m)) & ~np.uint64(KC - 1) | np.uint64(c)
        out.append(keys if (n == 0).sum() > spare else keys[n > 0])
    return np.concatenate(out).view(np.int64)


@lru_cache(1 << 16)
def _cell_count(n: int, t: Fraction) -> int:
    """About as many cells as a set of ``n`` shingles has."""
    return sum(m for m in (_groups(c, t)[0] for c in _classes(n, t)) if m > 1) if n else 0


def _hash_sets(b: pa.RecordBatch, k: int):
    """Sorted shingle hashes of every text of a batch."""
    raw, off = T.flat(b.column("text"))
    doc, _, _, h = T.words(raw, off)
    at, sh = T.shingles(doc, h, k)
    cut = T.by_doc(doc[at], b.num_rows)
    return (np.unique(sh[cut[i]:cut[i + 1]]) for i in range(b.num_rows))


def _set_id(s: np.ndarray) -> int | None:
    """64-bit id of a hash set; None for the empty set."""
    if not len(s):
        return None
    f = np.array([s.sum(dtype=np.uint64), T.mix(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64), len(s)], np.uint64)
    return int(T.mix(T.mix(T.mix(f[:1]) + f[1:2]) + f[2:]).view(np.int64)[0])


def _signatures(k: int, t: Fraction):
    def run(batches):
        for b in T.slices(batches):
            sets = [(len(s), _set_id(s)) for s in _hash_sets(b, k)]
            yield pa.record_batch([
                b.column("doc_id"), b.column("text_hash"), pa.array([n for n, _ in sets], pa.int64()),
                pa.array([c for _, c in sets], pa.int64()), pa.array([_cell_count(n, t) for n, _ in sets], pa.int64())],
                ["doc_id", "text_hash", "n_shingles", "cid", "k"])
    return run


def _distinct_sets(batches, k: int, remember: int = 200_000):
    """(id, hashes) of every non-empty set, slice by slice; a set that the task has given before is left out, as far as it remembers."""
    seen: set[int] = set()
    for b in T.slices(batches):
        out = []
        for s in _hash_sets(b, k):
            cid = _set_id(s)
            if cid is not None and cid not in seen:
                if len(seen) >= remember:
                    seen.clear()
                seen.add(cid)
                out.append((cid, s))
        yield out


def _cell_rows(k: int, t: Fraction):
    """One row per set and cell."""
    def run(batches):
        for sets in _distinct_sets(batches, k):
            cells = [_cells(s, t) for _, s in sets]
            cids = np.repeat(np.array([c for c, _ in sets], np.int64), [len(x) for x in cells])
            yield pa.record_batch([pa.array(cids), pa.array(np.concatenate([np.empty(0, np.int64), *cells]))], ["cid", "cell"])
    return run


def _spots(cid: np.ndarray) -> np.ndarray:
    return (T.mix(cid.view(np.uint64)) % np.uint64(WANTED_BITS)).astype(np.int64)


def _wanted(hashes: DataFrame):
    """Broadcast bitmap of a column of hashes; the driver gets its words, never the hashes."""
    def run(batches):
        bits = np.zeros(WANTED_BITS // 64, np.uint64)
        for b in batches:
            at = _spots(b.column(0).to_numpy())
            np.bitwise_or.at(bits, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        at = np.flatnonzero(bits)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], ["at", "bits"])
    got = hashes.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    bits = np.zeros(WANTED_BITS // 64, np.uint64)
    bits[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return hashes.sparkSession.sparkContext.broadcast(bits)


def _remade(src: DataFrame, reps: DataFrame, ids: DataFrame, k: int, make, schema: str, keys: list[str]) -> DataFrame:
    """``make(cid, hashes)`` -> rows, for the sets with the given ids (and a few more, by chance of the bitmap), each once.

    A text is looked up by its hash before it is read, so only texts with a wanted set are cut into words.
    """
    bits = _wanted(reps.join(ids, "cid", "left_semi").select("text_hash"))
    kinds = [f.split()[1] for f in schema.split(", ")]
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    names = [f.split()[0] for f in schema.split(", ")]

    def wanted(batches):
        have = bits.value
        for b in batches:
            at = _spots(b.column("text_hash").to_numpy())
            yield b.filter(pa.array((have[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))

    def run(batches):
        for sets in _distinct_sets(wanted(batches), k):
            rows = [row for s in sets for row in make(*s)]
            cols = list(zip(*rows, strict=True)) or [()] * len(names)
            yield pa.record_batch([pa.array(c, types[x]) for c, x in zip(cols, kinds, strict=True)], names)

    made = src.select("text", "text_hash").mapInArrow(run, schema)
    return made.dropDuplicates(keys)


def _set_row(cid: int, s: np.ndarray):
    return [(cid, s.tobytes())]


@contextmanager
def _small_batches(spark, size: int = BATCH_BYTES):
    """Rows go to Python by their bytes, not by their number: what a task holds of them does not follow the length of texts."""
    before = spark.conf.get(BATCH_SETTING, None)
    spark.conf.set(BATCH_SETTING, str(size))
    try:
        yield
    finally:
        spark.conf.unset(BATCH_SETTING) if before is None else spark.conf.set(BATCH_SETTING, before)


def _verify(num: int, den: int):
    """``ok`` per pair: whether its sets reach the similarity."""
    def run(batches):
        for b in batches:
            ok = [_similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), num, den)
                  for x, y in zip(b.column("ha"), b.column("hb"), strict=True)]
            yield pa.record_batch([b.column("a"), b.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "ok"])
    return run


def _sums(x: np.ndarray) -> np.ndarray:
    """Sums over the last axis; bytes (a multiple of eight of them) are added a word at a time, in lanes of 16 bits."""
    if x.dtype != np.uint8:
        return x.sum(-1, dtype=np.int64)
    w = x.view(np.uint64)
    w = (w & _LANES) + ((w >> np.uint64(8)) & _LANES)
    out = np.zeros(w.shape[:-1], np.int64)
    for i in range(0, w.shape[-1], 128):  # a lane takes 128 times 2 * 255
        lanes = np.ascontiguousarray(w[..., i:i + 128].sum(-1, dtype=np.uint64))
        out += lanes.view(np.uint16).reshape(*out.shape, 4).sum(-1, dtype=np.int64)
    return out


def _as_points(counts: np.ndarray) -> np.ndarray:
    """Count vectors as bytes, filled up to words of eight, if they fit."""
    if counts.dtype != np.uint8:
        if counts.max(initial=0) > 255:
            return counts
        counts = counts.astype(np.uint8)
    if counts.shape[1] % 8 == 0:
        return counts
    out = np.zeros((len(counts), counts.shape[1] + -counts.shape[1] % 8), np.uint8)
    out[:, :counts.shape[1]] = counts
    return out


def _portions(at: np.ndarray, row_bytes: int):
    step = max(1, STEP_BYTES // max(1, row_bytes))
    return (at[i:i + step] for i in range(0, len(at), step))


class RTree:
    """Packed R-tree over count vectors: a node keeps the coordinate maxima, the least size and its component."""

    LEAF = 32

    def __init__(self, points: np.ndarray, sizes: np.ndarray, comps: np.ndarray):
        self.points, self.sizes, self.comps = points, sizes, comps
        self.root = self._build(np.arange(len(points)))

    def _build(self, ids):
        p = self.points[ids]
        node = {"max": p.max(0), "n": self.sizes[ids].min(), "ids": ids,
                "comp": self.comps[ids[0]] if (self.comps[ids] == self.comps[ids[0]]).all() else None}
        if len(ids) > self.LEAF:
            axis = int(np.argmax(node["max"].astype(np.int64) - p.min(0)))
            order = ids[np.argsort(p[:, axis], kind="stable")]
            half = len(order) // 2
            node["kids"] = [self._build(order[:half]), self._build(order[half:])]
        return node

    def search(self, q, qn, qc, num, den):
        """(query, points) whose overlap bound reaches the needed overlap, the query's own component left out."""
        size = q.shape[1] * q.itemsize
        stack = [(self.root, np.arange(len(q)))]
        while stack:
            node, at = stack.pop()
            if node["comp"] is not None:
                at = at[qc[at] != node["comp"]]
            if not len(at):
                continue
            at = np.concatenate([x[_sums(np.minimum(q[x], node["max"])) * (num + den) >= num * (qn[x] + node["n"])]
                                 for x in _portions(at, size)])
            if "kids" in node:
                stack += [(x, at) for x in node["kids"]]
                continue
            ids = node["ids"]
            points, sizes, comps = self.points[ids], self.sizes[ids], self.comps[ids]
            for x in _portions(at, size * len(ids)):
                bound = _sums(np.minimum(q[x][:, None], points))
                ok = (bound * (num + den) >= num * (qn[x][:, None] + sizes)) & (comps != qc[x][:, None])
                for i in np.flatnonzero(ok.any(1)):
                    yield x[i], ids[ok[i]]


def _similar(p: np.ndarray, q: np.ndarray, num: int, den: int) -> bool:
    """Exact test on two sorted hash sets; the size ratio is looked at first."""
    if den * min(len(p), len(q)) < num * max(len(p), len(q)):
        return False
    both = np.sort(np.concatenate([p, q]), kind="stable")
    same = int((both[1:] == both[:-1]).sum())
    return den * same >= num * (len(p) + len(q) - same)


def _values(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary column without nulls, not copied."""
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int64 if pa.types.is_large_binary(col.type) else np.int32)[col.offset:col.offset + len(col) + 1]
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8), offsets


def _search_bucket(rows: list, num: int, den: int, exact: bool) -> list[tuple[int, int, int, int]]:
    """Forest of the pairs of a bucket (or of two of its blocks: side 0 is indexed, side 1 asks, side 2 does both).

    ``rows``: pieces of (n, comp, cid, side, bytes, offsets).  A pair is reported
    unless pairs reported before connect it already.  With ``exact`` a pair has
    to pass the exact test, else only the bound.
    """
    n, comp, cid, side = (np.concatenate(x) if len(x) > 1 else x[0] for x in list(zip(*rows, strict=True))[:4])
    tree, probe = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(tree) or not len(probe):
        return []
    if exact:  # sets of several size classes: points of one size for all of them
        sets = [raw[lo:hi].view(np.uint64) for *_, raw, off in rows for lo, hi in zip(off, off[1:], strict=False)]
        m = int(np.clip(n.max() // 4, 64, 4096))
        pts = np.stack([_counts(x, m).astype(np.int32) for x in sets])
    else:
        sets = None
        pts = np.concatenate([raw[off[0]:off[-1]].reshape(len(off) - 1, -1) for *_, raw, off in rows])
    pts = _as_points(pts)
    root, out = comp.copy(), []
    asks = pts[probe] if len(probe) < len(pts) else pts
    for i, js in RTree(pts[tree] if len(tree) < len(pts) else pts, n[tree], comp[tree]).search(asks, n[probe], comp[probe], num, den):
        x = probe[i]
        for y in tree[js]:
            if root[x] != root[y] and (sets is None or _similar(sets[x], sets[y], num, den)):
                root[root == root[y]] = root[x]
                (a, ca), (b, cb) = sorted([(int(cid[x]), int(comp[x])), (int(cid[y]), int(comp[y]))])
                out.append((a, b, ca, cb))
    return out


def _search(num: int, den: int, exact: bool):
    """Over rows sorted by bucket: one R-tree per bucket, also if a bucket spans batches."""
    def run(batches):
        held: list[tuple] = []
        last, pairs = None, []

        def close():
            pairs.extend((*last, *p) for p in _search_bucket(held, num, den, exact))

        def out():
            kinds = {"cell": pa.int64(), "i": pa.int32(), "j": pa.int32(), "a": pa.int64(), "b": pa.int64(), "ca": pa.int64(), "cb": pa.int64()}
            cols = list(zip(*pairs, strict=True)) or [()] * len(kinds)
            return pa.record_batch([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))
        for b in batches:
            key = np.stack([b.column(c).to_numpy() for c in ("cell", "i", "j")])
            cols = [b.column(c).to_numpy() for c in ("n", "comp", "cid", "side")]
            raw, off = _values(b.column("hashes" if exact else "vec"))
            cuts = [0, *(np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)) + 1), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:], strict=False):
                if hi == lo:
                    continue
                now = tuple(int(x) for x in key[:, lo])
                if now != last and held:
                    close()
                    held = []
                last = now
                held.append((*(x[lo:hi] for x in cols), raw, off[lo:hi + 1]))
            if len(pairs) > 50_000:
                yield out()
                pairs.clear()
        if held:
            close()
        yield out()
    return run


def _vectors(t: Fraction):
    """Points of a set, one for each of its size classes."""
    def make(cid: int, s: np.ndarray):
        return [(cid, c, len(s), np.minimum(_counts(s, _fine(t) * _groups(c, t)[0]), 255).astype(np.uint8).tobytes()) for c in _classes(len(s), t)]
    return make


def _point_rows(t: Fraction):
    """How many rows a point of class ``c`` counts for in its block."""
    sizes = [_fine(t) * _groups(c, t)[0] for c in range(len(_BOUNDS))]
    return F.array(*[F.lit(-(-x // ROW_BYTES)) for x in sizes])[F.col("c")]


def _in_blocks(rows: DataFrame, bucket_rows: int) -> DataFrame:
    """Rows of buckets (``cell``, of ``m`` rows of some ``ROW_BYTES`` at most) dealt into blocks i and j that are searched against each other; see ``_search_bucket``."""
    parts = F.ceil(F.col("m") / F.lit(bucket_rows)).cast("int")
    rows = rows.select("*", F.pmod(F.xxhash64("cid"), parts).cast("int").alias("blk"), parts.alias("nb")).drop("m")
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("oth"))
    return rows.select("*", F.least("blk", "oth").alias("i"), F.greatest("blk", "oth").alias("j"),
                       F.when(F.col("blk") == F.col("oth"), 2).when(F.col("blk") < F.col("oth"), 0).otherwise(1).alias("side")
                       ).drop("blk", "nb", "oth")


def _pairs_with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    return (pairs.join(sets.select(F.col("cid").alias("a"), F.col("hashes").alias("ha")), "a")
            .join(sets.select(F.col("cid").alias("b"), F.col("hashes").alias("hb")), "b").select("a", "b", "ha", "hb"))


def jaccard_components(docs: DataFrame, ngram: int = 5, similarity: float = 0.8, bucket_rows: int = 2048) -> DataFrame:
    """Component of every document under "Jaccard similarity of the word n-gram sets >= similarity".

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored.  Returns
    one row per input row: doc_id, n_shingles, set_id (equal sets share it, null
    for an empty set), component_id (smallest doc_id of the component).

    * words: runs of bytes other than blank and \\t-\\r, A-Z lower-cased; fewer
      than ``ngram`` words make one shingle; null, empty and blank texts have no
      shingle, link with nothing and are their own component;
    * repeated rows: equal texts are one point; rows that share a doc_id keep it;
    * a null doc_id takes part in links but never names a component unless all
      ids of it are null; an empty table gives an empty result.

    Sets are compared by 64-bit shingle hashes.
    """
    sig, labelled = _labelled(docs, ngram, similarity, bucket_rows)
    least = labelled.groupBy("label").agg(F.min("first_id").alias("component_id"))
    named = labelled.join(least, "label").select("cid", "component_id")
    return (sig.select("doc_id", "n_shingles", "cid").join(named, "cid", "left")
            .select("doc_id", "n_shingles", F.col("cid").alias("set_id"),
                    F.coalesce("component_id", "doc_id").alias("component_id")))


def _labelled(docs: DataFrame, ngram: int, similarity: float, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, text_hash, n_shingles, cid) and sets (cid, first_id: smallest doc_id, label: set that names the component)."""
    with _small_batches(docs.sparkSession):
        return _label(docs, ngram, Fraction(str(similarity)), bucket_rows)


def _label(docs: DataFrame, ngram: int, t: Fraction, bucket_rows: int) -> tuple[DataFrame, DataFrame]:
    num, den = t.numerator, t.denominator
    src = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    sig = materialize(src.mapInArrow(_signatures(ngram, t), "doc_id long, text_hash long, n_shingles long, cid long, k long"), "jaccard-sig")
    reps = materialize(sig.where("cid is not null").groupBy("cid").agg(
        F.min("doc_id").alias("first_id"), F.first("k").alias("k"), F.min("text_hash").alias("text_hash")), "jaccard-class")

    # cells are never stored: of all of them only those that several sets share are written
    w = Window.partitionBy("cell")
    multi = (src.select("text").mapInArrow(_cell_rows(ngram, t), "cid long, cell long")
             .select("*", F.min("cid").over(w).alias("lo"), F.max("cid").over(w).alias("hi"))
             .where("lo <> hi").dropDuplicates(["cid", "cell"]))
    multi = materialize(multi, "jaccard-cells")

    def verified(pairs):
        """The pairs with ``ok``; the sets are made again for these pairs only."""
        ends = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        sets = materialize(_remade(src, reps, ends, ngram, _set_row, "cid long, hashes binary", ["cid"]), "jaccard-sets")
        return materialize(_pairs_with_sets(pairs, sets).mapInArrow(_verify(num, den), "a long, b long, ok boolean"), "jaccard-links")

    # only likely pairs are tried here (an eighth of the cells shared); the R-tree search looks at all others
    star = multi.select(F.col("cid").alias("a"), F.explode(F.array("lo", "hi")).alias("b")).where("a <> b")
    star = star.groupBy("a", "b").agg(F.count("*").alias("shared")).join(reps.select(F.col("cid").alias("a"), "k"), "a").where("8 * shared >= k")
    star = materialize(star.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "jaccard-star")
    links = verified(star).where("ok").select("a", "b")
    comp = connected_components(links)

    comped = (multi.select("cid", "cell").join(comp.withColumnRenamed("id", "cid"), "cid", "left")
              .select("cid", "cell", F.coalesce("label", "cid").alias("comp")))
    comped = materialize(comped, "jaccard-comped")
    # buckets of several components; of those with the same members (and class) the one of the smallest key
    per = (comped.groupBy("cell").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("m"),
                                      F.bit_xor(F.xxhash64("cid")).alias("x"), F.bit_xor(F.xxhash64("cid", F.lit(7))).alias("y")).where("lo <> hi"))
    once = per.groupBy((F.col("cell").bitwiseAND(KC - 1)).cast("int").alias("c"), "m", "x", "y").agg(F.min("cell").alias("cell"))
    once = once.select("cell", "c", (F.col("m") * _point_rows(t)).alias("m"))
    left = materialize(comped.join(once, "cell"), "jaccard-left")
    vec = _remade(src, reps, left.select("cid").distinct(), ngram, _vectors(t), "cid long, c int, n long, vec binary", ["cid", "c"])
    vec = materialize(vec, "jaccard-points")
    points = _in_blocks(left, bucket_rows).join(vec, ["cid", "c"]).select("cell", "i", "j", "side", "cid", "comp", "n", "vec")
    pair = "cell long, i int, j int, a long, b long, ca long, cb long"

    def search(rows, exact):
        rows = rows.repartition("cell", "i", "j").sortWithinPartitions("cell", "i", "j")
        return rows.mapInArrow(_search(num, den, exact), pair)
    # forests of the pairs that pass the bound; if all pairs of a bucket's forest are links, the bucket is settled
    cand = materialize(search(points, False), "jaccard-forest")
    more = verified(cand.select("a", "b").distinct())
    # buckets with a pair that is no link are searched again with the exact test inside.  Pairs that pass the bound lie
    # between components that the bucket's forest connects, so the search goes by such families: a set travels once
    # for its family, not once for every bucket
    again = cand.join(more.where("not ok"), ["a", "b"]).select("cell", "i", "j").distinct()
    again = materialize(cand.join(again, ["cell", "i", "j"]).select("cell", "i", "j", "ca", "cb").distinct(), "jaccard-again")
    family = connected_components(again, "ca", "cb").select(F.col("id").alias("comp"), F.col("label").alias("cell"))
    ends = again.select("cell", "i", "j", F.explode(F.array("ca", "cb")).alias("comp")).distinct()
    blocks = _in_blocks(left, bucket_rows)
    members = materialize(blocks.join(ends, ["cell", "i", "j", "comp"]).select("cid", "comp").distinct().join(family, "comp"), "jaccard-members")
    sets = materialize(_remade(src, reps, members.select("cid").distinct(), ngram, _set_row, "cid long, hashes binary", ["cid"]), "jaccard-sets")
    rows = F.ceil(F.octet_length("hashes") / F.lit(ROW_BYTES))
    many = members.join(sets.select("cid", rows.alias("rows")), "cid").groupBy("cell").agg(F.sum("rows").alias("m"))
    members = _in_blocks(members.join(many, "cell"), bucket_rows)
    redo = members.join(sets, "cid").select("cell", "i", "j", "side", "cid", "comp", "hashes",
                                            F.expr("octet_length(hashes) div 8").alias("n"))
    redo = materialize(search(redo, True).select("a", "b").distinct(), "jaccard-links")
    more = more.where("ok").select("a", "b").unionByName(redo)
    hook = comp.select(F.col("id").alias("a"), F.col("label").alias("b"))
    final = connected_components(hook.unionByName(more)).withColumnRenamed("id", "cid")

    return sig, reps.select("cid", "first_id").join(final, "cid", "left").withColumn("label", F.coalesce("label", "cid"))


def one_per_group(docs: DataFrame, ngram: int = 5, similarity: float = 0.8) -> DataFrame:
    """One row of ``docs`` of each component, that of the smallest (doc_id, text hash), all columns unchanged.

    Rows are decided by doc_id and text, so a doc_id with several texts loses
    only those that are copies; a row repeated in full stays once.  Rows without
    shingles stay.  A row with a null doc_id does not count as a copy of one with
    an id: of those in a component one stays, beside the one with the smallest id.
    """
    sig, labelled = _labelled(docs, ngram, similarity, 2048)
    names = ["`" + c.replace("`", "``") + "`" for c in docs.columns]
    rows = sig.where("cid is not null").groupBy("cid", "doc_id", "text_hash").agg(F.count("*").alias("copies"))
    row = F.struct("doc_id", "text_hash", "copies")
    kept = (rows.join(labelled.select("cid", "label"), "cid").groupBy("label")
            .agg(F.min(F.when(F.col("doc_id").isNotNull(), row)).alias("id"), F.min(F.when(F.col("doc_id").isNull(), row)).alias("no_id"))
            .select(F.explode(F.array("id", "no_id")).alias("row")).where("row is not null").select("row.*"))
    kept = materialize(kept, "jaccard-kept")

    # only rows that a bitmap of the other side's keys has are joined; all others stay where they are, texts and all
    def parted(left, right):
        spot = F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(WANTED_BITS))
        bits = right.select(spot.alias("spot")).groupBy(F.shiftright("spot", 6).alias("_at")).agg(
            F.bit_or(F.expr("shiftleft(1L, cast(spot & 63 AS int))")).alias("_bits"))
        spot = F.pmod(F.xxhash64(F.col("doc_id").cast("long"), F.xxhash64("text")), F.lit(WANTED_BITS))
        have = left.select("*", spot.alias("_spot")).join(F.broadcast(bits), F.shiftright("_spot", 6) == F.col("_at"), "left")
        have = have.withColumn("_have", F.coalesce(F.expr("getbit(_bits, cast(_spot & 63 AS int))"), F.lit(0)))
        return have.where("_have = 0").select(*names), have.where("_have = 1").select(*names)

    def matching(left, right, how):
        right = right.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"))
        return left.join(right, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash")), how)
    gone = rows.join(kept.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")),
                     F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left_anti")
    gone = materialize(gone.select("doc_id", "text_hash"), "jaccard-gone")
    stay, maybe = parted(docs, gone)
    out = stay.unionByName(matching(maybe, gone, "left_anti"))
    twice = kept.where("copies > 1")
    if not twice.isEmpty():
        stay, maybe = parted(out, twice)
        once = matching(maybe, twice, "left_semi").dropDuplicates(["doc_id", "text"])
        out = stay.unionByName(matching(maybe, twice, "left_anti")).unionByName(once)
    return out
