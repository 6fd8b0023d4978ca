"""Order MinHash fingerprints in DataFrame operations only.

A text is cut into tokens: a run of up to 16 non-blank code points with the blanks
behind it, and in a longer run every code point on its own, so that an inserted or
deleted character never shifts the cuts of what follows it; the k-mer of a position is the hash of the token and its k - 1 successors, and
equal k-mers are numbered by occurrence.  Every numbered k-mer falls into one of
2**BIN_BITS bins by the high bits of its hash (one permutation serves all bins).  A
bin keeps its ORDER smallest ones, retains their text order and hashes their k-mers as
a tuple.  Two texts agree in a bin only if the same k-mers were selected in the same
order, so the share of agreeing bins falls with the edit distance.

Positions take the low POS_BITS of a 64-bit word, so that plain long arrays are
sorted; no array is longer than that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TOKEN = r"(?<!\S)\S{1,16}+(?!\S)\s*|\S\s*|\s+"
KMER, BIN_BITS, ORDER, POS_BITS = 3, 5, 2, 31
_POS = (1 << POS_BITS) - 1
#: of a long text, about so many words a bin are sorted for its smallest
SOME = 16


def _let(value: Column, body) -> Column:
    """``body(value)``, the value computed once however often the body (or its lambdas) uses it."""
    return F.transform(F.array(value), body)[0]


def _bin(x: Column) -> Column:
    return F.shiftrightunsigned(x, 64 - BIN_BITS)


def _packed(high: Column, pos: Column) -> Column:
    """High bits of one long above the position in another."""
    return high.bitwiseAND(F.lit(~_POS)).bitwiseOR(pos)


def _differ(x: Column, y: Column, low: int) -> Column:
    """Whether two words differ above their ``low`` low bits; null if one is null."""
    return F.shiftrightunsigned(x.bitwiseXOR(y), low) != 0


def _starts(v: Column, low: int) -> Column:
    """Indices of a sorted array at which runs of words begin that are equal above their ``low`` low bits."""
    return F.filter(F.transform(v, lambda x, j: F.when((j == 0) | _differ(x, F.get(v, j - 1), low), j)), lambda j: j.isNotNull())


def _numbered(kmers: Column) -> Column:
    """Longs in no order: selection hash of every occurrence-numbered k-mer above its position."""
    high = lambda x: F.shiftrightunsigned(x, POS_BITS)

    def number(v: Column) -> Column:
        # v: sorted (k-mer hash, position) words; runs of one hash are the occurrences of a k-mer in text order
        def join(again: Column) -> Column:
            # most k-mers come once: only what follows the first of a run is counted
            first = F.when(F.size(again) == 0, v).otherwise(F.filter(v, lambda x, j: (j == 0) | _differ(x, F.get(v, j - 1), POS_BITS)))
            later = _let(_starts(again, POS_BITS), lambda st: F.flatten(F.transform(st, lambda a, q: F.transform(
                F.sequence(a, F.coalesce(F.get(st, q + 1), F.size(again)) - 1),
                lambda j: _packed(F.xxhash64(high(F.get(again, j)), j - a + 1), F.get(again, j).bitwiseAND(F.lit(_POS)))))))
            return F.concat(F.transform(first, lambda x: _packed(F.xxhash64(high(x), F.lit(0)), x.bitwiseAND(F.lit(_POS)))), later)
        return _let(F.filter(v, lambda x, j: ~_differ(x, F.get(v, j - 1), POS_BITS)), join)
    return _let(F.sort_array(F.transform(kmers, lambda x, i: _packed(x, i.cast("long")))), number)


def _least(words: Column) -> Column:
    """The ORDER smallest words of every bin, sorted."""
    low = 64 - BIN_BITS

    def of(v: Column) -> Column:
        return _let(F.sort_array(v), lambda s: F.filter(s, lambda x, j: F.coalesce(_differ(x, F.get(s, j - ORDER), low), F.lit(True))))

    def some(v: Column) -> Column:
        # words below a limit that leaves some SOME a bin; unless every bin is full, all words are looked at
        limit = (F.lit(float(SOME << 64)) / F.size(v)).cast("long")
        few = _let(limit, lambda t: F.filter(v, lambda x: x.bitwiseAND(F.lit((1 << low) - 1)) < t))
        return _let(of(few), lambda k: F.when(F.size(k) == ORDER << BIN_BITS, k).otherwise(of(v)))
    return _let(words, lambda v: F.when(F.size(v) > 4 * SOME << BIN_BITS, some(v)).otherwise(of(v)))


def fingerprint(text: Column) -> Column:
    """Blank-separated entries (2 hex digits of the bin, 8 of its tuple) of the bins that have a k-mer; '' for empty or null."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(TOKEN), F.lit(0))

    def of(h: Column) -> Column:
        def sketch(v: Column) -> Column:
            def entry(j: Column) -> Column:
                kept = F.filter(F.slice(v, j + 1, ORDER), lambda y: _bin(y) == _bin(F.get(v, j)))
                in_order = F.sort_array(F.transform(kept, lambda y: y.bitwiseAND(F.lit(_POS))))
                code = F.xxhash64(F.transform(in_order, lambda i: F.get(h, i.cast("int"))))
                return F.concat(F.lpad(F.hex(_bin(F.get(v, j))), 2, "0"), F.right(F.lpad(F.hex(code), 16, "0"), F.lit(8)))
            return F.concat_ws(" ", F.transform(_starts(v, 64 - BIN_BITS), entry))
        return _let(_least(_numbered(h)), sketch)
    kmers = _let(tokens, lambda t: F.transform(t, lambda x, i: F.xxhash64(x, *[F.get(t, i + k) for k in range(1, KMER)])))
    return F.lower(_let(kmers, of))


def likeness(a: Column, b: Column) -> Column:
    """0 to 1: the ORDER-th root of the share of agreeing bins among the bins of either; 1 for two empty fingerprints."""
    both = F.transform(F.array(F.struct(F.split(a, " ").alias("x"), F.split(b, " ").alias("y"))), lambda p: F.pow(
        F.size(F.array_intersect(p["x"], p["y"]))
        / F.size(F.array_union(F.transform(p["x"], lambda e: F.substring(e, 1, 2)), F.transform(p["y"], lambda e: F.substring(e, 1, 2)))),
        F.lit(1.0 / ORDER)))[0]
    return F.when((a == "") & (b == ""), 1.0).when((a == "") | (b == ""), 0.0).otherwise(both).cast("double")


def with_next(docs: DataFrame, rows_per_bucket: int = 200, max_buckets: int = 1 << 16) -> tuple[DataFrame, object]:
    """Rows dealt into doc_id ranges, each with the first row of the next range behind it, and the window over a range.

    Range borders are doc_ids of the data (approximate quantiles), so a bucket holds
    about ``rows_per_bucket`` rows and no window spans the table.  The smallest
    row also follows the last one.  Copies have ``extra`` = true.
    """
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)).cast("long"))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), order.alias("ord"))
    n, least = rows.agg(F.count("*"), F.min("ord")).first()
    k = min(max_buckets, -(-n // rows_per_bucket))
    bounds = []
    if k > 1:
        cut = rows.agg(F.percentile_approx("ord", [i / k for i in range(1, k)], F.lit(max(10_000, 20 * k)))).first()[0]
        bounds = sorted({x for x in cut if x > least})
    step = 256
    # folded to a literal as it is (already sorted); a sort here would run for every row
    arr = F.from_json(F.lit(str(bounds)), "array<bigint>")
    coarse = F.from_json(F.lit(str(bounds[::step])), "array<bigint>")
    at = F.greatest(F.size(F.filter(coarse, lambda b: b <= F.col("ord"))) - 1, F.lit(0)) * step
    rows = rows.withColumn("at", at).withColumn("bucket", F.col("at") + F.size(F.filter(F.slice(arr, F.col("at") + 1, step), lambda b: b <= F.col("ord"))))
    first = (F.col("bucket") > 0) & (F.get(arr, F.col("bucket") - 1) == F.col("ord"))
    copy = lambda b, wrap, extra: F.struct(b.cast("int").alias("bucket"), F.lit(wrap).alias("wrap"), F.lit(extra).alias("extra"))
    places = F.filter(F.array(copy(F.col("bucket"), False, False), F.when(first, copy(F.col("bucket") - 1, False, True)),
                              F.when(F.col("ord") == F.lit(least), copy(F.lit(len(bounds)), True, True))), lambda x: x.isNotNull())
    rows = rows.withColumn("tie", F.xxhash64("text")).select("doc_id", "text", "ord", "tie", F.inline(places))
    return rows, Window.partitionBy("bucket").orderBy("wrap", "ord", "tie")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited text.

    doc_id, n_chars (code points), edited (text whose last floor(n_chars / 4)
    code points are the first as many, or all, of the next document's), fingerprint,
    edited_fingerprint, near_edited, near_next.  The next document is the next by
    doc_id (null first; equal ids by a hash of the text; the first after the last,
    a single row after itself).  Null texts count as empty; repeated rows follow
    one another; extra columns are ignored; an empty table gives an empty result.
    """
    rows, w = with_next(docs)
    rows = rows.withColumn("next_text", F.lead("text").over(w)).withColumn("n_chars", F.length("text").cast("long"))
    tail = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - tail),
                                              F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), tail)))
    rows = rows.select("doc_id", "n_chars", "edited", "bucket", "wrap", "ord", "tie", "extra",
                       fingerprint(F.col("text")).alias("fingerprint"), fingerprint(F.col("edited")).alias("edited_fingerprint"))
    rows = rows.withColumn("next_fingerprint", F.lead("fingerprint").over(w)).where(~F.col("extra"))
    return rows.select("doc_id", "n_chars", "edited", "fingerprint", "edited_fingerprint",
                       likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
                       likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
