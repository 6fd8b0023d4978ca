"""Phrase collocations by best-first branch-and-bound growth over prefix counts.

A phrase is grown word by word from its prefix.  For every extension p of a
prefix u, f(p) <= f(u), and the cut after the first j words of u gives

    score(p) <= 2,000,000 f(p) / (f(u_j) + f(p)) <= 2,000,000 f(u) / (f(u_j) + f(u))

so counts of prefixes bound the scores of all that can grow from them.  Each
language has a threshold, first the score of a bigram rank; the frontier's
prefixes whose bound reaches it are expanded, best first in batches: one pass
over the corpus counts the extensions of a whole batch.  A phrase is settled
once the longer phrases that could drop it are counted, and a language once at
least ``top`` settled phrases reach its threshold, so that no unexpanded
prefix can reach the last of them, ties included.  Otherwise its threshold
falls and the next batch of its frontier is expanded.

Words are 64-bit hashes of (language, word), so that a phrase's key is up to
four longs and its parts' keys are columns of it.  The word table keeps the
texts; two words of one hash are found there, and the run then takes another
seed, so that counts are exact.  Which phrases a pass counts is told to the
tasks as bitmaps of fixed size; a bit set by chance costs a few counts that an
exact join then removes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.llm import textops
from opslake.sources.sinks import materialize

#: bits of a bitmap: 4 MiB, whatever the input
BITS = 1 << 25
#: phrases or words that a task holds before it sums equal ones
HELD = 1 << 19
SCALE = 2_000_000

BREAKS = np.zeros(256, bool)
BREAKS[[*b".,;:!?\n\x0b\x0c\r"]] = True
WORDS = ~BREAKS
WORDS[[0x20, 9]] = False


def gram_hash(cols: list[np.ndarray]) -> np.ndarray:
    h = cols[0].view(np.uint64)
    for c in cols[1:]:
        h = textops.mix(h * np.uint64(3) + c.view(np.uint64))
    return h


def _words(b: pa.RecordBatch, seed: int):
    """(word keys as signed longs, 'the next word follows in the same piece', document of each word, its span, bytes)."""
    raw, off = textops.flat(b.column(0))
    doc, start, end, h = textops.words(raw, off, WORDS)
    langs = b.column(1).dictionary_encode()
    salt = np.array([xxhash.xxh64_intdigest(str(v).encode(), seed) for v in langs.dictionary.to_pylist()], np.uint64)
    code = langs.indices.to_numpy()
    with np.errstate(over="ignore"):
        w = textops.mix(h ^ salt[code[doc]]).view(np.int64) if len(h) else np.empty(0, np.int64)
    piece = np.cumsum(BREAKS[raw], dtype=np.int32)[start] if len(raw) else np.empty(0, np.int32)
    follows = np.zeros(len(w), bool)
    if len(w) > 1:
        follows[:-1] = (doc[1:] == doc[:-1]) & (piece[1:] == piece[:-1])
    return w, follows, code[doc] if len(doc) else doc, start, end, raw, langs.dictionary


def _texts(raw: np.ndarray, start: np.ndarray, size: np.ndarray) -> pa.Array:
    """The lower-cased words at the spans as a string column."""
    offsets = np.r_[0, np.cumsum(size)].astype(np.int64)
    at = np.repeat(start - offsets[:-1], size) + np.arange(offsets[-1])
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(textops.LOWER[raw[at]]))


def _differ(raw, start, size, code, first, which) -> np.ndarray:
    """Places of words whose language or bytes are not those of the first word of their key."""
    other = first[which]
    odd = (size != size[other]) | (code != code[other])
    same = np.flatnonzero(~odd)
    n = size[same]
    begin = np.cumsum(n) - n
    step = np.arange(int(n.sum())) - np.repeat(begin, n)
    unlike = textops.LOWER[raw[np.repeat(start[same], n) + step]] != textops.LOWER[raw[np.repeat(start[other[same]], n) + step]]
    odd[same[np.repeat(np.arange(len(same)), n)[unlike]]] = True
    return np.flatnonzero(odd)


def word_counts(docs: DataFrame, seed: int) -> DataFrame:
    """(w, lang, word, f) of every word; a key that two words share has a row of each."""
    def summed(held):
        t = pa.Table.from_batches(held).group_by(["w", "lang", "word"]).aggregate([("f", "sum")])
        return t.rename_columns(["w", "lang", "word", "f"])

    def run(batches):
        held, n = [], 0
        for b in textops.slices(batches):
            w, _, code, start, end, raw, langs = _words(b, seed)
            if not len(w):
                continue
            _, first, which, count = np.unique(w, return_index=True, return_inverse=True, return_counts=True)
            odd = _differ(raw, start, end - start, code, first, which)
            at = np.r_[first, odd]
            held.append(pa.RecordBatch.from_arrays(
                [pa.array(w[at]), langs.take(pa.array(code[at])).cast(pa.large_string()), _texts(raw, start[at], (end - start)[at]),
                 pa.array(np.r_[count, np.zeros(len(odd), np.int64)])], ["w", "lang", "word", "f"]))
            n += len(at)
            if n > HELD:
                t = summed(held)
                held, n = t.to_batches(), t.num_rows
                if n > HELD // 2:
                    yield from out(t)
                    held, n = [], 0
        if held:
            yield from out(summed(held))

    def out(t):
        schema = pa.schema([("w", pa.int64()), ("lang", pa.string()), ("word", pa.string()), ("f", pa.int64())])
        for b in t.to_batches(max_chunksize=1 << 16):
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema, strict=True)], schema=schema)

    # equal keys meet once; the check for two words of one key needs no further shuffle
    return (docs.mapInArrow(run, "w long, lang string, word string, f long").repartition("w")
            .groupBy("w", "lang", "word").agg(F.sum("f").alias("f")))


class _Sums:
    """Counts of phrases of one length in a task; equal ones are summed when HELD are kept."""

    def __init__(self, size):
        self.size, self.cols, self.counts, self.held = size, [], [], 0

    def add(self, cols):
        self.cols.append(cols)
        self.counts.append(np.ones(len(cols[0]), np.int64))
        self.held += len(cols[0])
        if self.held > HELD:
            self.shrink()
            if self.held > HELD // 2:
                yield from self.flush()

    def shrink(self):
        cols = [np.concatenate([c[i] for c in self.cols]) for i in range(self.size)]
        counts = np.concatenate(self.counts)
        order = np.argsort(gram_hash(cols))
        cols, counts = [c[order] for c in cols], counts[order]
        new = reduce(np.logical_or, [c[1:] != c[:-1] for c in cols])
        at = np.flatnonzero(np.r_[True, new])
        self.cols, self.counts = [[c[at] for c in cols]], [np.add.reduceat(counts, at)]
        self.held = len(at)

    def flush(self):
        if self.held:
            self.shrink()
            names = [f"w{i + 1}" for i in range(self.size)] + ["a"]
            whole = pa.RecordBatch.from_arrays([pa.array(c) for c in (*self.cols[0], self.counts[0])], names)
            for at in range(0, whole.num_rows, 1 << 16):
                yield whole.slice(at, 1 << 16)
        self.cols, self.counts, self.held = [], [], 0


def _has(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    spot = (h >> np.uint64(7)) % np.uint64(BITS)
    return (bits[(spot >> np.uint64(6)).astype(np.int64)] >> (spot & np.uint64(63))) & np.uint64(1) > 0


def bitmap(keys: DataFrame):
    """A broadcast bitmap of the phrases (columns w1, w2, ...): BITS bits; the driver gets its words, never the phrases."""
    def run(batches):
        bits = np.zeros(BITS // 64, np.uint64)
        for b in batches:
            spot = (gram_hash([c.to_numpy() for c in b.columns]) >> np.uint64(7)) % np.uint64(BITS)
            np.bitwise_or.at(bits, (spot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (spot & np.uint64(63)))
        at = np.flatnonzero(bits)
        if len(at):
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bits[at].view(np.int64))], ["at", "bits"])
    got = keys.mapInArrow(run, "at int, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(BITS // 64, np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return keys.sparkSession.sparkContext.broadcast(out)


def phrase_counts(docs: DataFrame, seed: int, size: int, first, last) -> DataFrame:
    """(w1 ... w<size>, a) of the phrases whose first size - 1 words are in ``first`` and whose last part is in ``last``.

    ``last`` holds single words for ``size`` 2, else pairs of words.
    """
    back = 1 if size == 2 else 2

    def run(batches):
        one, two = first.value, last.value
        sums = _Sums(size)
        for b in textops.slices(batches):
            w, follows = _words(b, seed)[:2]
            n = len(w) - size + 1
            if n <= 0:
                continue
            ok = reduce(np.logical_and, [follows[i:i + n] for i in range(size - 1)])
            at = np.flatnonzero(ok)
            at = at[_has(one, gram_hash([w[at + i] for i in range(size - 1)]))]
            at = at[_has(two, gram_hash([w[at + i] for i in range(size - back, size)]))]
            if len(at):
                yield from sums.add([w[at + i] for i in range(size)])
        yield from sums.flush()

    keys = [f"w{i + 1}" for i in range(size)]
    found = docs.mapInArrow(run, ", ".join(f"{c} long" for c in keys) + ", a long")
    return found.repartition(*keys).groupBy(*keys).agg(F.sum("a").alias("a"))


def _d(name: str):
    return F.col(name).cast("decimal(20,0)")


def _score(df: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """The lowest cut's score with its l and r, in decimals beyond 64 bits; ties to the first cut."""
    each = [F.struct(F.expr(f"(cast(a as decimal(20,0)) * {SCALE}) div (cast({left} as decimal(20,0)) + cast({right} as decimal(20,0)))")
                     .alias("score"), F.lit(i).alias("cut"), F.col(left).alias("l"), F.col(right).alias("r"))
            for i, (left, right) in enumerate(cuts)]
    low = F.array_min(F.array(*each))
    return df.withColumns({"score": low["score"], "l": low["l"], "r": low["r"]})


def _reaches(lefts: list[str]):
    """An extension of the phrase (count a, counts of its first parts ``lefts``) may score t."""
    return reduce(lambda x, y: x & y, [_d("a") * SCALE >= _d("t") * (_d(c) + _d("a")) for c in lefts])


def _part(df: DataFrame, part: DataFrame, at: list[int], name: str, value: str) -> DataFrame:
    """Add ``value`` of ``part`` (keys w1, w2, ...) for the words ``at`` of ``df`` as column ``name``."""
    keys = [f"w{i}" for i in at]
    side = part.select(*[F.col(f"w{i + 1}").alias(k) for i, k in enumerate(keys)], F.col(value).alias(name))
    return df.join(side, keys)


def mine(df: DataFrame, top: int = 2000, least: int = 30, drop_percent: int = 80, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first ``top`` collocations of 2 to 4 words.

    Only ``text`` and ``lang`` are read.  Null text counts as empty and null
    lang as ``und``; repeated rows count each.  Empty texts and tables give no
    rows.  Words and texts may be of any length.  Equal scores rank by count
    and then by the phrase's bytes, so there are no ties left.  All counts are
    over all documents.
    """
    spark = df.sparkSession
    docs = df.select(F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
                     F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    seed = 0
    while True:
        words = materialize(word_counts(docs, seed), "colloc-words")
        if words.groupBy("w").count().where("count > 1").limit(1).count() == 0:
            break
        seed += 1
    totals = words.groupBy("lang").agg(F.sum("f").alias("n"))
    known = materialize(words.where(F.col("f") >= least).select(F.col("w").alias("w1"), "lang", "word", "f"), "colloc-known")
    frequent = bitmap(known.select("w1"))
    two = phrase_counts(docs, seed, 2, frequent, frequent).where(F.col("a") >= least)
    two = _part(_part(two, known, [1], "f1", "f"), known, [2], "f2", "f").join(known.select("w1", "lang"), "w1")
    two = materialize(_score(two, [("f1", "f2")]), "colloc-two")
    pairs = bitmap(two.select("w1", "w2"))

    open_ = totals.select("lang")  # languages that are not settled
    rank, three, four, done2, done3 = 2 * top, None, None, None, None
    result = None
    while True:
        limits = materialize(_limits(two, open_, rank), "colloc-limits")
        here = two.join(limits, "lang")
        grow2 = materialize(_frontier_two(here, drop_percent), "colloc-grow")
        new2 = grow2 if done2 is None else grow2.join(done2, ["w1", "w2"], "left_anti")
        more = phrase_counts(docs, seed, 3, bitmap(new2), pairs).where(F.col("a") >= least).join(new2, ["w1", "w2"], "left_semi")
        three = _grown(three, more, "colloc-three")
        done2 = _grown(done2, new2, "colloc-done")
        part = _part(_part(three, two.withColumn("f12", F.col("a")), [1, 2], "f12", "f12"), two, [2, 3], "f23", "a")
        part = _part(_part(part, known, [1], "f1", "f"), known, [3], "f3", "f").join(known.select("w1", "lang"), "w1")
        scored3 = materialize(_score(part, [("f1", "f23"), ("f12", "f3")]).join(limits, "lang"), "colloc-scored")
        grow3 = materialize(_frontier_three(scored3, drop_percent), "colloc-grow")
        new3 = grow3 if done3 is None else grow3.join(done3, ["w1", "w2", "w3"], "left_anti")
        more = (phrase_counts(docs, seed, 4, bitmap(new3), pairs).where(F.col("a") >= least)
                .join(new3, ["w1", "w2", "w3"], "left_semi"))
        four = _grown(four, more, "colloc-four")
        done3 = _grown(done3, new3, "colloc-done")
        part = _part(_part(four, three, [1, 2, 3], "f123", "a"), three, [2, 3, 4], "f234", "a")
        part = _part(_part(part, two, [1, 2], "f12", "a"), two, [3, 4], "f34", "a")
        part = _part(_part(part, known, [1], "f1", "f"), known, [4], "f4", "f").join(known.select("w1", "lang"), "w1")
        scored4 = _score(part, [("f1", "f234"), ("f12", "f34"), ("f123", "f4")]).join(limits, "lang")

        reached = [_undropped(here.where("score >= t"), three, 2, drop_percent),
                   _undropped(scored3.where("score >= t"), four, 3, drop_percent), scored4.where("score >= t")]
        cols = ["lang", "a", "l", "r", "score", "t"]
        alive = reduce(DataFrame.unionByName, [
            r.select(F.array(*[f"w{i + 1}" for i in range(k)]).alias("key"), *cols) for k, r in zip((2, 3, 4), reached, strict=True)])
        alive = materialize(alive, "colloc-alive")
        count = limits.join(alive.groupBy("lang").count(), "lang", "left")
        settled = materialize(count.select("lang", ((F.col("t") == 0) | (F.coalesce("count", F.lit(0)) >= top)).alias("ok")), "colloc-settled")
        part = alive.join(settled.where("ok").select("lang"), "lang", "left_semi").drop("t")
        result = part if result is None else result.unionByName(part)
        open_ = settled.where(~F.col("ok")).select("lang")
        if not open_.limit(1).count():
            break
        rank *= 8
    return _report(result, known, totals, top)


def _grown(old: DataFrame | None, more: DataFrame, name: str) -> DataFrame:
    return materialize(more if old is None else old.unionByName(more), name)


def _limits(two: DataFrame, open_: DataFrame, rank: int) -> DataFrame:
    """(lang, t): the score of the bigram of this rank, 0 for a language with fewer; at most ``rank`` rows a language and task."""
    w = Window.partitionBy("lang").orderBy(F.desc("score"), "w1", "w2")
    best = two.select("lang", "score", "w1", "w2").withColumn("p", F.row_number().over(w)).where(F.col("p") <= rank)
    t = best.groupBy("lang").agg(F.when(F.max("p") == rank, F.min("score")).otherwise(0).alias("t"))
    return open_.join(t, "lang", "left").select("lang", F.coalesce("t", F.lit(0)).cast("long").alias("t"))


def _frontier_two(here: DataFrame, percent: int) -> DataFrame:
    """Pairs to expand: those whose bound reaches the threshold, and those whose extensions settle or score them.

    A phrase from w1 that reaches t has a >= t f1 / (2,000,000 - t), so what
    could drop it from the left begins with a pair (x, w1) of ``percent`` of
    that, and its part without the first word with a pair (w2, y) of at least that.
    """
    live = here.where(_reaches(["f1"]))
    own = live.select("w1", "w2")
    first = live.select(F.col("w1").alias("w2")).distinct()
    left = (here.join(first, "w2").where(_d("a") * 100 * (SCALE - _d("t")) >= _d("t") * percent * _d("f2")).select("w1", "w2"))
    second = live.groupBy(F.col("w2").alias("w1")).agg(F.min("f1").alias("fx"))
    right = here.join(second, "w1").where(_d("a") * (SCALE - _d("t")) >= _d("t") * _d("fx")).select("w1", "w2")
    return own.unionByName(left).unionByName(right).distinct()


def _frontier_three(scored: DataFrame, percent: int) -> DataFrame:
    """Triples to expand: by bound, and (x, w1, w2) that could drop a triple (w1, w2, w3) that reaches the threshold."""
    keys = ["w1", "w2", "w3"]
    own = scored.where(_reaches(["f1", "f12"])).select(*keys)
    need = (scored.where("score >= t").groupBy(F.col("w1").alias("w2"), F.col("w2").alias("w3")).agg(F.min("a").alias("low")))
    left = scored.join(need, ["w2", "w3"]).where(_d("a") * 100 >= _d("low") * percent).select(*keys)
    return own.unionByName(left).distinct()


def _undropped(cand: DataFrame, longer: DataFrame, size: int, percent: int) -> DataFrame:
    """Candidates that no phrase of one word more holds with ``percent`` of their count.

    Still longer ones need no look: the phrase between is at least as frequent.
    """
    out = cand
    keys = [f"w{i + 1}" for i in range(size)]
    for shift in (0, 1):
        most = longer.groupBy(*[F.col(f"w{i + 1 + shift}").alias(k) for i, k in enumerate(keys)]).agg(F.max("a").alias("most"))
        out = out.join(most, keys, "left").where(F.col("most").isNull() | (_d("most") * 100 < _d("a") * percent)).drop("most")
    return out


def _report(alive: DataFrame, known: DataFrame, totals: DataFrame, top: int) -> DataFrame:
    each = alive.select("*", F.posexplode("key").alias("pos", "w1")).join(known.select("w1", "word"), "w1")
    text = (each.groupBy("key", "lang", "a", "l", "r", "score")
            .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "word"))), lambda s: s["word"]), " ").alias("phrase")))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    out = text.withColumn("rank", F.row_number().over(w).cast("long")).where(F.col("rank") <= top).join(totals, "lang")
    return out.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
