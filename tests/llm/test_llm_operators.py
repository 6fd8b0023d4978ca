"""Every operator on a small hostile fixture (nulls, empty and long texts, ties, repeated rows, clashing columns), on an
empty table, and against a brute-force version."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from opslake.llm import (chat, decontaminate, graph, jaccard_join, lang_id, licenses, order_minhash, packing, quality, sharding,
                         textops, toxicity)
from opslake.llm.queries import TOKENIZER

SCHEMA = "doc_id long, text string, lang string, cid long, bucket int, score double, salt int, `class` string"
VOCAB = [f"{a}{b}" for a in ("al", "be", "cor", "du", "em", "fi") for b in ("ra", "lo", "mi", "nust", "ke", "ix", "ton")]


def prose(r, n):
    return " ".join(r.choice(VOCAB) for _ in range(n))


def edited(r, text, n):
    w = text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = r.choice(VOCAB)
    return " ".join(w)


def texts():
    r = random.Random(3)
    base = [prose(r, n) for n in (6, 30, 120, 400)]
    out = [None, "", "   \n", "One", "one two", "Äpfel, Öl!", "x" * 3000, prose(r, 20_000), "日本語 の テキスト", "a\\b <|end|> </s>[INST]"]
    for b in base:
        out += [b, b, b.upper(), *(edited(r, b, k) for k in (0, 1, 1, 2, 3, 6, 12))]
    out += [prose(r, r.randrange(5, 200)) for _ in range(30)]
    out += [edited(r, base[2], r.randrange(1, 4)) for _ in range(60)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en" if i % 2 else None, 1, 2, 0.5, 3, "k") for i, t in enumerate(texts())]
    rows += [rows[12], rows[12], (None, rows[11][1], "en", 1, 2, 0.5, 3, "k")]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def table(df):
    return {r["doc_id"]: r for r in df.collect()}


def word_sets(rows, k):
    low = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})
    out = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        out[i] = {tuple(w[j:j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    return out


def brute_components(sets, t):
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b]) - 1e-12:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


@pytest.mark.parametrize(("ngram", "similarity", "block"), [(3, 0.9, 2048), (5, 0.8, 2048), (2, 0.6, 7)])
def test_jaccard_components(docs, ngram, similarity, block):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").distinct().collect() if r["doc_id"] is not None]
    sets = word_sets(rows, ngram)
    want = brute_components(sets, similarity)
    got = jaccard_join.jaccard_components(docs, ngram, similarity, bucket_rows=block).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is not None:
            assert (r["n_shingles"], r["component_id"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]])
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {want[11]}


def test_jaccard_edges(none, docs):
    assert jaccard_join.jaccard_components(none).count() == 0
    kept = jaccard_join.one_per_group(docs)
    assert kept.columns == docs.columns
    comp = jaccard_join.jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct().count()
    assert kept.where("doc_id is not null").select("doc_id").distinct().count() == len(texts()) - comp
    assert kept.where("doc_id is null").count() == 1


def test_one_per_group_by_row(spark):
    r = random.Random(4)
    a, b, c, d = (prose(r, 60) for _ in range(4))
    rows = [(1, a), (2, edited(r, a, 1)), (2, b), (3, c), (3, edited(r, c, 1)), (3, c), (4, c), (5, None), (5, None),
            (None, d), (None, edited(r, d, 1)), (None, d), (None, c), (None, c), (None, None), (6, ""), (6, "")]
    df = spark.createDataFrame([(*x, "en") for x in rows], "doc_id long, text string, lang string").repartition(3)
    kept = jaccard_join.one_per_group(df)
    assert kept.columns == df.columns
    got = [(x["doc_id"], x["text"]) for x in kept.collect()]
    assert [t for i, t in got if i == 1] == [a] and [t for i, t in got if i == 2] == [b]
    assert [t in (c, rows[4][1]) for i, t in got if i == 3] == [True] and not [1 for i, _ in got if i == 4]
    assert got.count((5, None)) == 2 and got.count((6, "")) == 2
    assert sorted(t in (d, rows[10][1]) for i, t in got if i is None and t) == [False, True] and got.count((None, c)) == 1
    assert got.count((None, None)) == 1 and len(got) == 10


def test_cells_never_miss_a_pair():
    r = np.random.default_rng(1)
    for t in ("0.9", "0.8", "0.5"):
        f = jaccard_join.Fraction(t)
        for n in (1, 2, 9, 10, 40, 500):
            a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
            b = a.copy()
            while True:
                c = b.copy()
                c[r.integers(len(c))] = r.integers(0, 1 << 63, dtype=np.uint64)
                c = np.unique(c)
                if not jaccard_join._similar(a, c, f.numerator, f.denominator):
                    break
                b = c
            same = np.array_equal(a, b)
            assert same or len(np.intersect1d(jaccard_join._cells(a, f), jaccard_join._cells(b, f)))


def test_jaccard_batches_are_bounded_in_bytes(spark):
    rows = spark.range(0, 300, 1, 1).selectExpr("id", "repeat('x', 100000) AS text")

    def size(batches):
        for b in batches:
            yield pa.record_batch([pa.array([b.nbytes])], ["n"])
    with jaccard_join._small_batches(spark):
        got = [r["n"] for r in rows.mapInArrow(size, "n long").collect()]
    assert sum(got) >= 30_000_000 and max(got) < 5_000_000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) is None


def test_jaccard_sums_of_counts():
    r = np.random.default_rng(2)
    for n, m in ((1, 1), (3, 8), (5, 1031), (4, 2100)):
        for x in (r.integers(0, 256, (n, m)), np.full((n, m), 255), r.integers(0, 70_000, (n, m))):
            assert jaccard_join._sums(jaccard_join._as_points(x.astype(np.int32))).tolist() == x.sum(1).tolist()


@pytest.mark.parametrize("exact", [False, True])
def test_jaccard_search_in_pieces(exact):
    """Buckets that come in several batches, searched whole and as two blocks: every pair that passes is connected."""
    r = np.random.default_rng(3)
    sets, t = [], jaccard_join.Fraction("0.8")
    while len(sets) < 120:
        x = r.integers(0, 1 << 63, 250, np.uint64)
        sets += [np.unique(np.r_[x[k:], r.integers(0, 1 << 63, k, np.uint64)]) for k in (0, 9, 70)]
    pts = [jaccard_join._counts(x, 61).astype(np.uint8) for x in sets]

    def passes(i, j):
        if exact:
            return jaccard_join._similar(sets[i], sets[j], 4, 5)
        return 9 * int(np.minimum(pts[i], pts[j]).astype(int).sum()) >= 4 * (len(sets[i]) + len(sets[j]))
    for sides in (np.full(120, 2), np.arange(120) % 2):
        want = brute_links([(i, j) for i in range(120) for j in range(i) if (sides[i] == 2 or sides[i] != sides[j]) and passes(i, j)])
        cols = [pa.array(x) for x in ([7] * 120, [0] * 120, [1] * 120)]
        b = pa.record_batch([pa.array(cols[0], pa.int64()), cols[1].cast(pa.int32()), cols[2].cast(pa.int32()), pa.array(sides.astype(np.int32)),
                             pa.array(range(120)), pa.array(range(120)), pa.array([len(x) for x in sets]),
                             pa.array([x.tobytes() for x in (sets if exact else pts)], pa.binary())],
                            ["cell", "i", "j", "side", "cid", "comp", "n", "hashes" if exact else "vec"])
        out = list(jaccard_join._search(t.numerator, t.denominator, exact)([b.slice(0, 50), b.slice(50, 3), b.slice(53)]))
        got = [(x["a"], x["b"]) for o in out for x in o.to_pylist()]
        assert brute_links(got) == want and want and len(got) == sum(len(x) - 1 for x in want)


def brute_links(pairs):
    groups = []
    for a, b in pairs:
        near = [g for g in groups if a in g or b in g]
        groups = [g for g in groups if g not in near] + [{a, b}.union(*near)]
    return sorted(map(sorted, groups))


def test_jaccard_long_points_count_for_more_rows(spark):
    t = jaccard_join.Fraction("0.8")
    got = spark.createDataFrame([(1,), (20,), (28,), (44,)], "c int").select(jaccard_join._point_rows(t).alias("n")).collect()
    n = [r["n"] for r in got]
    assert n[:3] == [1, 1, 1] and n[3] > 50  # 44: some four million shingles


def test_connected_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (None, 3)]
    got = {r["id"]: r["label"] for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 90: 90, 95: 90, 100: 90}


def test_lang_id(spark, docs, none):
    r = random.Random(5)
    kinds = {"en": "the and ing tion with", "de": "der und ung keit nicht", "fr": "la et é eau que"}
    rows = [(i, " ".join(r.choice(w.split()) + r.choice(w.split()) for _ in range(r.randrange(3, 60))), k)
            for i, (k, w) in enumerate(list(kinds.items()) * 120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    m = lang_id.fit(df.where("doc_id % 4 <> 2"), rows_per_lang=80)
    got = table(lang_id.identify(df.where("doc_id % 4 = 2"), m))
    assert sum(got[i]["lang_pred"] == k for i, _, k in rows if i % 4 == 2) >= 0.95 * len(got)
    seen = table(lang_id.identify(docs, m))
    assert all(seen[i]["lang_pred"] == "und" and seen[i]["rejected"] and seen[i]["score"] == 0 for i in (0, 1, 2))
    assert all(0 <= x["score"] <= 1 for x in seen.values()) and seen[3]["lang_pred"] in kinds
    empty = lang_id.fit(none)
    assert {x["lang_pred"] for x in lang_id.identify(docs, empty).collect()} == {"und"}
    assert lang_id.identify(none, m).count() == 0
    kept = lang_id.keep_identified(docs, m)
    assert kept.columns == docs.columns and kept.where("doc_id in (0, 1, 2)").count() == 0


def test_lang_id_sample(spark):
    # one doc_id (or null) holds most rows of a language; a language of 600 million rows has a share of 0 in a million
    rows = [(7, f"one {i}", "en") for i in range(300)] + [(None, f"deux {i}", "fr") for i in range(300)] + [(9, "drei", "de")] * 50
    rows += [(i, f"uno {i}", "es") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    df = df.select("*", F.xxhash64("doc_id", "text", F.lit(7)).alias("h"))
    n = {"en": 300, "fr": 300, "de": 50, "es": 20}
    want = {k: sorted({r["h"] for r in df.collect() if r["lang"] == k})[:40] for k in n}
    for counts in (n, dict.fromkeys(n, 600_000_000)):
        got = lang_id._sample(df, counts, 40).collect()
        assert {k: sorted(r["h"] for r in got if r["lang"] == k) for k in n} == want
    assert lang_id.fit(df, rows_per_lang=40).langs == ["de", "en", "es", "fr"]


def test_quality(spark, docs, none):
    r = random.Random(6)
    rows = []
    for i in range(600):
        t, good = prose(r, r.randrange(30, 300)), i % 3 > 0
        rows.append((i, t if good else r.choice([t.upper().replace(" ", "!! "), t.replace(" ", " | "), " ".join([t.split()[0]] * 60)]), int(good)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = table(quality.quality_scores(df, df.where("doc_id % 5 <> 0")))
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows if i % 5 == 0) >= 0.97 * 120
    some = quality.quality_scores(docs, df).collect()
    assert len(some) == docs.count() and all(0 <= x["score"] <= 1 for x in some)
    assert quality.quality_scores(none, df).count() == 0
    assert {x["score"] for x in quality.quality_scores(docs, df.where("false")).collect()} == {0.5}
    assert quality.keep_good(docs, df.where("false"), 0.4).count() == docs.count()


def test_isotonic():
    s, v = quality.isotonic(np.arange(5.0), np.ones(5), np.array([0, 1, 0, 1, 1.0]))
    assert np.allclose(s, [0, 1.5, 3.5]) and np.allclose(v, [0, 0.5, 1])


def test_sharding(docs, none):
    n = docs.count()
    got = sharding.shard(docs, shards=7, virtual_nodes=8).collect()
    count = Counter(r["shard"] for r in got)
    assert len(got) == n and max(count.values()) - min(count.values()) <= 1 and set(count) == set(range(7))
    for s in range(7):
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(count[s]))
    text = dict(enumerate(texts()))
    for r in got:
        if r["doc_id"] is not None:
            raw = (text[r["doc_id"]] or "").encode()
            assert (r["size"], r["text_crc32"]) == (len(raw) + 16, zlib.crc32(raw))
    assert sharding.shard(none).count() == 0


def test_sharding_moves_little():
    r = np.random.default_rng(2)

    def place(shards):
        owner = r2.integers(0, shards, 64 * shards)
        return owner
    r2 = np.random.default_rng(3)
    arcs = [(i, int(o), int(c)) for i, (o, c) in enumerate(zip(place(10), r.poisson(50, 640), strict=True))]
    seg = sharding.settle(arcs, 10)
    owner = {a: o for a, o, _ in arcs}
    assert sum(hi - lo for _, lo, hi, _, _ in seg) == sum(c for _, _, c in arcs)
    assert sum(hi - lo for a, lo, hi, s, _ in seg if owner[a] == s) >= 0.8 * sum(c for _, _, c in arcs)


def test_tokenizer_equals_library():
    tok = packing.tokenizer(TOKENIZER)
    odd = [*texts(), "<|endoftext|> hi", "İstanbul ΑΣ σ", "áb", "x\x00y\x1cz", "1²3½ a_b--c's", "  a\xa0b ", "don't'S 'd''s..!!'re"]
    assert tok.by_word and tok.ids(pa.array(odd, pa.string())) == tok._encode([x or "" for x in odd])


def test_cuts():
    for n in range(1, 5000):
        c = packing.cuts(n, 2048, 0.02)
        assert sum(x for x, _ in c) == n and all(k * x <= 2048 < (k + 1) * x or k * x <= 2048 and 2048 // x == k for x, k in c)


def test_packing(docs, none):
    want = {r["doc_id"]: packing.tokenizer(TOKENIZER).ids(pa.array([r["text"]], pa.string()))[0] + b"\1\0\0\0" for r in docs.collect()}
    got = packing.pack_documents(docs, TOKENIZER, group_rows=30).collect()
    seq, doc = defaultdict(list), defaultdict(dict)
    for r in got:
        assert len(r["ids"]) == 4 * r["length"] and r["doc_tokens"] * 4 == len(want[r["doc_id"]])
        seq[r["sequence_id"]].append((r["offset"], r["length"]))
        doc[r["doc_id"]][r["start"]] = bytes(r["ids"])
    assert {i: b"".join(v[k] for k in sorted(v)) for i, v in doc.items()} == want
    for v in seq.values():
        at = 0
        for off, n in sorted(v):
            assert off == at
            at += n
        assert at <= 2048
    tokens = sum(r["length"] for r in got)
    assert len(seq) <= 1.1 * tokens / 2048 + 2
    rows = packing.packed_sequences(packing.pack_documents(docs, TOKENIZER)).collect()
    assert all(len(r["input_ids"]) == 4 * 2048 for r in rows)
    assert packing.pack_documents(none, TOKENIZER).count() == 0


def brute_contained(rows, items, k=5, c=0.8):
    def words(t):
        return re.findall("[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())
    out = set()
    for j, item in items:
        w = words(item)
        n = min(k, len(w))
        s = {tuple(w[x:x + n]) for x in range(len(w) - n + 1)} if n else set()
        for i, t in rows:
            d = words(t)
            g = {tuple(d[x:x + n]) for x in range(len(d) - n + 1)} if n else set()
            if s and len(s & g) >= c * len(s) - 1e-9:
                out.add((i, j, len(s & g)))
    return out


def test_decontaminate(spark, docs, none):
    r = random.Random(9)
    long_ = texts()[7].split()
    items = [(0, " ".join(long_[500:540])), (1, edited(r, " ".join(long_[100:160]), 1)), (2, prose(r, 30)), (3, None), (4, ""),
             (5, "One"), (6, "ÄPFEL öl"), (7, " ".join(long_[500:540])), (8, "日本語 の テキスト")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(x["doc_id"], x["text"]) for x in docs.select("doc_id", "text").distinct().collect()]
    for block in (16 << 20, 300):
        got = decontaminate.contained_items(docs, bench, block_bytes=block)
        assert {(x["doc_id"], x["item_id"], x["n_shared"]) for x in got.collect()} == brute_contained(rows, items)
        bad = {i for i, _, _ in brute_contained(rows, items)}
        kept = decontaminate.remove_contaminated(docs, bench, block_bytes=block)
        assert kept.columns == docs.columns
        assert {x["doc_id"] for x in kept.collect()} == {x["doc_id"] for x in docs.collect()} - bad
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.contained_items(docs, bench.where("false")).count() == 0


def test_licenses(spark, docs, none):
    r = random.Random(10)
    rows, want = [], set()
    for i in range(60):
        t = prose(r, r.randrange(0, 300))
        if i % 3 == 0:
            j = r.randrange(len(licenses.LICENSE_TEMPLATES))
            t = t + "\n" + licenses.LICENSE_TEMPLATES[j][1].upper() + "\n" + prose(r, r.randrange(0, 50))
            want.add((i, j))
        rows.append((i, t))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = licenses.license_matches(df).collect()
    assert want <= {(x["doc_id"], x["template"]) for x in got}
    assert brute_contained(rows, [(j, t) for j, (_, t) in enumerate(licenses.LICENSE_TEMPLATES)]) >= {
        (x["doc_id"], x["template"], n) for x in got for n in [round(x["containment"] * len(licenses.TemplateIndex(
            licenses.LICENSE_TEMPLATES, 5, 0.8, 0.99).sets[x["template"]]))]}
    low = dict(rows)
    for x in got:
        span = low[x["doc_id"]].lower().encode()[x["start"]:x["end"]].decode()
        assert re.findall(r"\w+", span)[0] in licenses.LICENSE_TEMPLATES[x["template"]][1].lower()
    assert licenses.license_matches(docs).count() == 0 and licenses.license_matches(none).count() == 0
    assert licenses.bands(1, 1, 0.8, 0.999) >= 1


def test_short_licenses(spark):
    r = random.Random(11)
    body = prose(r, 400)
    rows = [(0, body + "\nAll rights reserved."), (1, "All rights"), (2, "ALL RIGHTS RESERVED"), (3, body),
            (4, "All rights are reserved. " + body), (5, body + " all"), (6, "rights reserved " + body), (7, None),
            (8, f"SPDX-License-Identifier: MIT\n{body} All rights reserved. {body}"), (9, body + " CC0 1.0")]
    got = licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x["doc_id"], x["license"]) for x in got) == [
        (0, "All-Rights-Reserved"), (2, "All-Rights-Reserved"), (8, "All-Rights-Reserved"), (8, "MIT"), (9, "CC0-1.0")]
    spans = {(x["doc_id"], x["license"]): dict(rows)[x["doc_id"]][x["start"]:x["end"]] for x in got}
    assert spans[0, "All-Rights-Reserved"] == spans[8, "All-Rights-Reserved"] == "All rights reserved"
    assert spans[8, "MIT"] == "SPDX-License-Identifier: MIT" and spans[9, "CC0-1.0"] == "CC0 1.0"


def test_chat(spark):
    say = "</s>[INST] ok [/INST] \\ <|turn|> <\\| [\\INST] <"
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", say), (1, 2, "assistant", say), (1, 2, "assistant", "tie é"), (2, 0, "user", None),
            (2, None, None, "x"), (None, 0, "assistant", ""), (3, 5, "<|end|>", "odd"), (3, 5, "<|end|>", "odd"),
            *[(4, i, "assistant" if i % 2 else "user", f"{i} " + "ü" * 5000) for i in range(300)]]
    df = spark.createDataFrame([(*x, "n", 1) for x in rows], "conv_id long, turn long, role string, text string, loss string, formatted int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(df)).collect()}
    for c in (None, 1, 2, 3, 4):
        mine = sorted((x for x in rows if x[0] == c), key=lambda x: (x[1] is not None, x[1] or 0, x[2] is not None, x[2] or "", x[3] or ""))
        text = "".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in mine)
        loss = "".join(x[3] or "" for x in mine if x[2] == "assistant")
        r = got[c]
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == (
            len(mine), hashlib.sha256(text.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert len(got) == 5 and chat.format_chats(df.where("false")).count() == 0
    assert -7 in {r["conv_id"] for r in chat.format_chats(chat.with_probe(df)).collect()}


def test_toxicity_grammar():
    s = {w: x for x, ws in ((toxicity.INSULT, toxicity.INSULTS), (toxicity.THREAT, toxicity.THREATS), (toxicity.TARGET, toxicity.TARGETS),
                            (toxicity.NEGATION, toxicity.NEGATIONS), (toxicity.REPORT, toxicity.REPORTS)) for w in ws}

    def score(text):
        sym = [s.get(w, toxicity.OTHER) for w in text.split()]
        return toxicity.clause_score(sym, [1.0] * len(sym))[0]
    assert score("you are an idiot") > score("an idiot") > score("he said idiot") > 0
    assert score("you are not an idiot") < score("you are an idiot")
    assert score("i will kill you") > score("kill the process") > 0 == score("a fine day")


def test_toxicity_flags():
    """Each flag alone and under negation and report, where factors multiply to inexact products."""
    kinds = {"T": toxicity.TARGET, "N": toxicity.NEGATION, "R": toxicity.REPORT, "I": toxicity.INSULT, "K": toxicity.THREAT, "o": toxicity.OTHER}
    want = {"I": (False, False, False), "TI": (True, False, False), "TNI": (True, False, True), "TRI": (True, False, True),
            "TRNI": (True, False, True), "NI": (False, False, True), "TooooI": (False, False, False), "K": (False, True, False),
            "TK": (False, True, False), "TRK": (False, True, True), "NK": (False, True, True), "KT": (True, True, False),
            "NKT": (True, True, True), "RKoT": (True, True, True), "KooooooT": (False, True, False), "NooooI": (False, False, False)}
    for text, flags in want.items():
        assert toxicity.clause_score([kinds[x] for x in text], [1.0] * len(text))[1:] == flags, text


def test_toxicity(spark, docs, none):
    r = random.Random(12)
    rows = []
    for i in range(500):
        w = prose(r, r.randrange(20, 150)).split()
        if i % 5 == 1 or i % 7 == 1:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["idiot", "zorgach" + r.choice(VOCAB)]))
        rows.append((i, " ".join(w), int(i % 5 == 1 or i % 7 == 1)))
    df = spark.createDataFrame(rows, "doc_id long, text string, label int")
    got = table(toxicity.toxicity_scores(df, df.where("doc_id % 3 <> 0")))
    assert sum((got[i]["score"] >= 0.5) == bool(y) for i, _, y in rows if i % 3 == 0) >= 0.95 * 167
    some = toxicity.toxicity_scores(docs, df).collect()
    assert len(some) == docs.count() and all(0 <= x["score"] <= 1 for x in some)
    assert toxicity.toxicity_scores(none, df).count() == 0
    assert {x["score"] for x in toxicity.toxicity_scores(docs, df.where("false")).collect()} == {0.5}


def test_order_minhash(spark, docs, none):
    one = docs.where("doc_id is not null").dropDuplicates(["doc_id"])
    t = sorted((r["doc_id"], r["text"] or "") for r in one.collect())
    got = table(order_minhash.edited_fingerprints(one))
    by_text = defaultdict(set)
    for i, (k, x) in enumerate(t):
        q = len(x) // 4
        want = x[:len(x) - q] + t[(i + 1) % len(t)][1][:q]
        r = got[k]
        assert (r["n_chars"], r["edited"]) == (len(x), want)
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        by_text[x].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and got[0]["fingerprint"] == "" and got[0]["near_next"] == 1
    long_ = [k for k, x in t if len(x) > 600]
    assert np.mean([got[k]["near_edited"] for k in long_]) > 0.35
    assert order_minhash.edited_fingerprints(docs).count() == docs.count()
    assert order_minhash.edited_fingerprints(none).count() == 0
    alone = order_minhash.edited_fingerprints(docs.where("doc_id = 5")).first()
    assert alone["near_next"] == 1 and alone["edited"] == "Äpfel, Öl!"[:8] + "Äp"


def test_order_minhash_is_sensitive_to_edits_only(spark):
    """One character inserted, deleted or changed, in front or inside, with and without blanks."""
    r = random.Random(8)
    texts = [prose(r, 700), "".join(r.choice("abcdefghijklmnopqrstuvwxyz0123456789") for _ in range(4000)),
             "".join(chr(0x4E00 + r.randrange(3000)) for _ in range(3000)), "x" * 40 + " " + prose(r, 300) + " " + "".join(r.choice("acgt") for _ in range(2000))]
    rows = []
    for t in texts:
        for at in (0, 1, 17, len(t) // 2):
            rows += [(t, t[:at] + "Q" + t[at:]), (t, t[:at] + t[at + 1:]), (t, t[:at] + "Q" + t[at + 1:])]
        rows.append((t, "".join(r.sample(t, len(t)))))
    df = spark.createDataFrame([(i, *x) for i, x in enumerate(rows)], "i int, a string, b string")
    got = [x[0] for x in df.orderBy("i").select(order_minhash.likeness(order_minhash.fingerprint(F.col("a")), order_minhash.fingerprint(F.col("b")))).collect()]
    for k in range(len(texts)):
        part = got[13 * k:13 * k + 13]
        assert min(part[:12]) > 0.8 and part[12] < 0.5, (k, part)


def test_order_minhash_brute_force(spark):
    """The native expression against a plain version built on the same k-mer hashes."""
    words = "a b a b a b c d e f g h i j k l m n o p a b a".split()
    df = spark.createDataFrame([(0, " ".join(words))], "doc_id long, text string")
    tok = re.findall(r"(?<!\S)\S{1,16}(?!\S)\s*|\S\s*|\s+", " ".join(words))
    hs = [r[0] for r in spark.createDataFrame([(i, *(tok[i + k] if i + k < len(tok) else None for k in range(3))) for i in range(len(tok))],
                                              "i int, a string, b string, c string").orderBy("i").select(F.xxhash64("a", "b", "c")).collect()]
    pos = (1 << order_minhash.POS_BITS) - 1
    u = lambda x: x & ((1 << 64) - 1)
    seen, numbered = Counter(), []
    for i, h in enumerate(hs):
        numbered.append((u(h) >> order_minhash.POS_BITS, seen[u(h) >> order_minhash.POS_BITS], i))
        seen[u(h) >> order_minhash.POS_BITS] += 1
    sel = spark.createDataFrame(numbered, "h long, occ int, i int").select("i", F.xxhash64("h", "occ").alias("p")).collect()
    bins = defaultdict(list)
    for r in sel:
        packed = u(r["p"]) & ~pos | r["i"]
        bins[packed >> (64 - order_minhash.BIN_BITS)].append((packed - (1 << 64) if packed >> 63 else packed, r["i"]))
    want = set()
    for b, v in bins.items():
        kept = sorted(i for _, i in sorted(v)[:order_minhash.ORDER])
        code = spark.range(1).select(F.xxhash64(F.array(*[F.lit(hs[i]) for i in kept]))).first()[0]
        want.add(f"{b:02x}{u(code):016x}"[:2] + f"{u(code):016x}"[8:])
    assert set(df.select(order_minhash.fingerprint(F.col("text"))).first()[0].split()) == want


def test_order_minhash_ranges(spark):
    """The table's range borders are a literal, sorted once and not for every row; ranges and copies are those of the sorted ids."""
    ids = [None, *random.Random(4).sample(range(-500, 500), 400)]
    df = spark.createDataFrame([(i, f"t {i}") for i in ids], "doc_id long, text string").repartition(3)
    rows, w = order_minhash.with_next(df, rows_per_bucket=5)
    assert "array_sort" not in rows._jdf.queryExecution().optimizedPlan().toString()
    got = rows.withColumn("after", F.lead("doc_id").over(w)).where("not extra").collect()
    order = sorted((i for i in ids if i is not None)) + [None]
    assert len(got) == len(ids) and len({r["bucket"] for r in got}) > 50
    assert {r["doc_id"]: r["after"] for r in got} == dict(zip([None, *order[:-1]], order, strict=True))


def test_order_minhash_of_long_and_repeated_texts(spark, monkeypatch):
    """Few words a bin are sorted for long texts, and all of them where a bin has too few: the same fingerprint."""
    r = random.Random(6)
    texts = ["a " * 3000, " ".join(r.choice("abcd") for _ in range(3000)), prose(r, 5000), "\n".join([prose(r, 40)] * 60), prose(r, 300) * 9]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").orderBy("i")
    some = [x[0] for x in df.select(order_minhash.fingerprint(F.col("text"))).collect()]
    monkeypatch.setattr(order_minhash, "SOME", 1 << 20)   # every text is short: all words are sorted
    assert some == [x[0] for x in df.select(order_minhash.fingerprint(F.col("text"))).collect()]
    monkeypatch.setattr(order_minhash, "SOME", 1)         # too few: bins are not full
    assert some == [x[0] for x in df.select(order_minhash.fingerprint(F.col("text"))).collect()]


def test_words_of_long_texts(monkeypatch):
    text = " ".join(f"w{i}" for i in range(5000))
    raw, off = textops.flat(pa.array([text, None, "a b"]))
    a = textops.words(raw, off)
    monkeypatch.setattr(textops, "PIECE_BYTES", 64)
    b = textops.words(raw, off)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True)) and math.isclose(len(a[0]), 5002)


def test_connected_components_match_union_find(spark):
    """Paths, hot stars, random graphs, repeated edges, self loops and nulls; every end of an edge gets the smallest id."""
    import random

    from opslake.llm.graph import connected_components
    rnd = random.Random(3)
    path = rnd.sample(range(300), 300)
    cases = [[], [(1, 1), (None, 2), (3, None)], list(zip(path, path[1:], strict=False)),
             [(rnd.randrange(900), rnd.randrange(900)) for _ in range(700)],
             [(-5, i) for i in range(200)] + [(-7, 200), (200, -5), (200, -5)]]
    for edges in cases:
        parent = {}

        def find(x, parent=parent):
            parent.setdefault(x, x)
            while parent[x] != x:
                x = parent[x]
            return x
        for a, b in edges:
            if a is not None and b is not None and a != b:
                a, b = sorted((find(a), find(b)))
                parent[b] = a
        got = connected_components(spark.createDataFrame(edges, "a long, b long")).collect()
        assert sorted(map(tuple, got)) == sorted((x, find(x)) for x in parent)


def test_one_per_group_shuffles_no_text_that_stays(spark):
    r = random.Random(8)
    base = [prose(r, 40) for _ in range(30)]
    rows = [(i, t, "en") for i, t in enumerate(base)] + [(100 + i, base[i], "de") for i in range(3)] + [(0, base[0], "fr"), (None, base[1], None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string").repartition(3)
    kept = jaccard_join.one_per_group(df)
    got = kept.collect()
    assert kept.schema == df.schema
    assert sorted((x["doc_id"], x["text"]) for x in got if x["doc_id"] is not None) == list(enumerate(base))
    assert [x["text"] for x in got if x["doc_id"] is None] == [base[1]]
    # every anti join has a filter by the bitmap below it, on the side of the documents
    plan = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    anti = [i for i, x in enumerate(plan) if "Join LeftAnti" in x]
    assert anti and all("getbit" in "".join(plan[i:i + 5]) for i in anti)


def test_worker_gives_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(textops, "give_back", lambda: calls.append(1))
    b = pa.record_batch([pa.array([1, 2]), pa.array(["some words", None])], ["doc_id", "text"])
    assert sum(x.num_rows for x in textops.slices(iter([b, b]))) == 4 and calls == [1]
    monkeypatch.setattr(packing, "_tokenizers", {})
    first = [x.to_pydict() for x in packing._pieces(TOKENIZER, 1, 2048, 0.02)(iter([b]))]
    tok = packing.tokenizer(TOKENIZER)
    assert tok._whole is None and tok._parts is None and len(tok.known) == 2
    assert first == [x.to_pydict() for x in packing._pieces(TOKENIZER, 1, 2048, 0.02)(iter([b]))]


def test_tokenizer_beyond_its_cache(monkeypatch):
    monkeypatch.setattr(packing, "_CACHE_WORDS", 5)
    tok = packing.WordTokenizer(TOKENIZER)
    for part in (texts()[:14], texts()[14:40], texts()[10:]):
        assert tok.ids(pa.array(part, pa.string())) == tok._encode([x or "" for x in part])
