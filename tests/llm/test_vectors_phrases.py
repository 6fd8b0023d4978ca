"""Whitening, exact top-k and collocations: brute force, hostile rows, empty tables, and the registered queries against SQL."""

import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from opslake.llm import collocations, queries, topk, vectors, whitening

SF = "/root/testdata/sf0.001"
VSCHEMA = "vec_id long, embedding array<float>, component int, x string, rank int, cell int, i int"


def vector_rows(seed=1, n=300, d=7):
    r = np.random.default_rng(seed)
    x = np.float32(r.normal(size=(n, d)) * np.array([5, 3, 3, 1, .5, .1, 0]) + np.array([900, 0, 0, 0, 0, 0, 3]))
    rows = [(i, [float(v) for v in x[i]]) for i in range(n)]
    rows += [rows[0], rows[0], rows[20], (1000, rows[20][1]), (1020, rows[20][1]), (None, rows[21][1])]  # repeated rows, equal vectors
    rows += [(2000, None), (2020, [None] * d), (2040, [1.0, float("nan")] + [0.0] * (d - 2)), (2060, [float("inf")] + [0.0] * (d - 1)),
             (2080, []), (2100, [1.0])]
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "k", 2, 3, 4) for r in rows], VSCHEMA).repartition(5)


def used(rows, scale):
    return [(i, tuple(int(np.floor(scale * float(v))) for v in x)) for i, x in rows
            if x is not None and len(x) == 7 and all(v is not None and np.isfinite(v) for v in x)]


@pytest.mark.parametrize("kind", ["plain", "equal", "near", "steep", "zero"])
@pytest.mark.parametrize("d", [1, 2, 5, 40])
def test_spectrum_slicing(kind, d):
    r = np.random.default_rng(d)
    q, _ = np.linalg.qr(r.normal(size=(d, d)))
    e = np.sort(np.abs(r.normal(size=d)))[::-1].copy()
    if kind == "equal":
        e[:3] = e[0]
    if kind == "near" and d > 1:
        e[1] = e[0] * (1 - 1e-13)
        e[2:] = 0
    if kind == "steep":
        e *= 10.0 ** -np.arange(d)
    if kind == "zero":
        e[:] = 0
    v = (q * e) @ q.T
    v = (v + v.T) / 2
    values, vecs = whitening.leading(v, 4)
    want = np.linalg.eigvalsh(v)[::-1][:len(values)]
    assert np.allclose(values, want, rtol=1e-8, atol=1e-14 * (e[0] or 1))
    assert np.abs(vecs.T @ vecs - np.eye(len(values))).max(initial=0) < 1e-12
    assert np.abs(v @ vecs - vecs * values).max(initial=0) < 1e-13 * d * (e[0] or 1)
    assert len(values) == (0 if kind == "zero" else min(2, d) if kind == "near" else min(4, d))


def test_inertia_counts():
    r = np.random.default_rng(5)
    for d in (1, 2, 3, 8, 30):
        a = r.normal(size=(d, d))
        a = a + a.T
        np.fill_diagonal(a, 0)  # zero pivots: 2 x 2 blocks are needed
        w = np.linalg.eigvalsh(a)
        for s in [0.0, *((w[1:] + w[:-1]) / 2)]:
            assert whitening.count_above(a, s) == (w > s).sum()


def test_whitening(spark):
    rows = vector_rows()
    df = frame(spark, rows)
    got = whitening.whiten(df, whitening.fit(df)).collect()
    keep = used(rows, 256)
    assert sorted((r["vec_id"] is None, r["vec_id"] or 0, r["component"]) for r in got) == sorted(
        (i is None, i or 0, c) for i, _ in keep for c in (1, 2, 3, 4))
    once = np.array(sorted({x for _, x in keep}), dtype=object)
    n, s = len(once), once.sum(axis=0)
    f = once.astype(float)
    v = np.cov(f.T, bias=True)
    e, q = np.linalg.eigh(v)
    by_id = {i: x for i, x in keep}
    for c in (1, 2, 3, 4):
        mine = [r for r in got if r["component"] == c]
        z = np.array([r["whitened"] for r in mine])
        want = np.array([(np.array(by_id[r["vec_id"]], float) - f.mean(axis=0)) @ q[:, -c] / np.sqrt(e[-c]) for r in mine])
        assert min(np.abs(z - want).max(), np.abs(z + want).max()) < 1e-8
        for r in mine:
            assert r["n"] == n and r["deviation"] == sum((n * a - b) ** 2 for a, b in zip(by_id[r["vec_id"]], s))
            assert abs(r["explained"] - e[-c] / np.trace(v)) < 1e-9 and r["identity_error"] < 1e-9


def test_whitening_edges(spark):
    empty = spark.createDataFrame([], VSCHEMA)
    assert whitening.whiten(empty, whitening.fit(empty)).count() == 0
    same = frame(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)])
    assert whitening.whiten(same, whitening.fit(same)).count() == 0  # no variance
    line = frame(spark, [(i, [float(i), 0.0]) for i in range(9)])
    got = whitening.whiten(line, whitening.fit(line)).collect()
    assert {r["component"] for r in got} == {1} and all(abs(r["explained"] - 1) < 1e-12 for r in got)
    wide = frame(spark, [(i, [float((-1) ** i) * 1e14 * (1 + i), 1.0]) for i in range(4)])
    got = whitening.whiten(wide, whitening.fit(wide)).collect()
    assert len(got) == 4 and {r["deviation"] for r in got} == {None}  # beyond 63 bits


def test_deviation_beyond_doubles():
    x = np.array([[1 << 20, -5], [3, 1 << 20], [7, 7]], np.int64)
    sums = [int(a) for a in x.sum(axis=0)]
    m = whitening.Whitening(2, 3, sums, np.ones(1), np.ones((2, 1)), 1.0)
    assert m.deviation(x) == [sum((3 * int(a) - s) ** 2 for a, s in zip(r, sums)) for r in x]
    big = x << 35
    m = whitening.Whitening(2, 3, [s << 35 for s in sums], np.ones(1), np.ones((2, 1)), 1.0)
    assert m.deviation(big) == [sum((3 * (int(a) << 35) - (s << 35)) ** 2 for a, s in zip(r, sums)) for r in x]


def test_packed_vectors():
    r = np.random.default_rng(2)
    x = np.concatenate([r.integers(-w, w, (20, 3)) for w in (128, 1 << 15, 1 << 31, 1 << 62)])
    r.shuffle(x)
    x[0] = [-128, 127, 0]
    got = vectors.pack(x)
    assert (vectors.unpack(got, 3) == x).all() and len(got[0].as_py()) == 3
    assert (vectors.unpack(got.slice(7, 30), 3) == x[7:37]).all()


def brute_top_k(rows, k, every, scale):
    keep = used(rows, scale)
    out = Counter()
    for qid, q in {r for r in keep if r[0] is not None and r[0] % every == 0}:
        got = sorted((-sum(a * b for a, b in zip(q, x)), i is None, i or 0) for i, x in keep if i != qid)[:k]
        out.update((qid, n, None if null else i, -s) for n, (s, null, i) in enumerate(got, 1))
    return out


@pytest.mark.parametrize("block", [(4096, 1 << 19), (16, 32)])
def test_top_k(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)  # small blocks: cells, chunks and the second visit take part
    for seed, n in ((1, 300), (2, 15)):
        rows = vector_rows(seed, max(n, 22))
        got = Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame(spark, rows)).collect())
        assert got == brute_top_k(rows, 20, 20, 64)


def test_top_k_edges(spark):
    assert topk.top_k(spark.createDataFrame([], VSCHEMA)).count() == 0
    assert topk.top_k(frame(spark, [(20, [1.0] * 7)])).count() == 0  # no other row
    few = [(20, [1.0] * 7), (3, [-1.0] * 7), (2, [-1.0] * 7)]
    got = topk.top_k(frame(spark, few)).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, -7 * 4096), (3, -7 * 4096)]


def test_segment_bound_holds():
    r = np.random.default_rng(3)
    q, c = r.integers(-90, 90, (50, 13)).astype(float), r.integers(-90, 90, (70, 13)).astype(float)
    exact = q @ c.T
    coarse, fine = (topk.features(q, s) @ topk.features(c, s).T for s in (3, 8))
    assert (coarse >= exact - 1e-6).all() and (fine >= exact - 1e-6).all() and fine.sum() < coarse.sum()


def brute_phrases(rows, top, least, percent=80):
    counts, n = defaultdict(Counter), Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall(r"[^ \t]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3, 4):
                for i in range(len(w) - k + 1):
                    counts[lang][tuple(w[i:i + k])] += 1
    out = []
    for lang, c in counts.items():
        cand = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        most = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    most[p[i:i + k]] = max(most[p[i:i + k]], a)
        found = []
        for p, a in cand.items():
            if most[p] and 100 * most[p] >= percent * a:
                continue
            score, k = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), c[p[:k]], c[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, r, n[lang], -s) for i, (s, a, p, left, r) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def phrase_rows():
    r = random.Random(4)
    vocab = ["a", "B", "b", "cc", "Äd", "äd", "e-f", "日", "g'h", "i" * 50]
    rows = []
    for i in range(400):
        w = []
        for _ in range(r.randrange(0, 30)):
            w.append(r.choice(vocab[:r.randrange(2, len(vocab))]) + r.choice(["", "", "", ".", ",", ";", "!", "?", ":"]))
            if r.random() < 0.2:
                w.append("red House of\tcards")
        rows.append((r.choice([" ", "  ", "\t", "\n", "\x0b", " \r "]).join(w), r.choice(["en", "en", "de", None, "und", ""])))
    rows += [(None, "en"), ("", None), (" \t ", "x"), ("...", "x"), ("one", "x"), ("z" * 5000 + " y", "en"), ("la " * 9000, "it")]
    return rows + [rows[3]] * 5


@pytest.mark.parametrize("top,least", [(2000, 30), (4, 2), (1, 3), (30, 2)])
def test_collocations(spark, top, least):
    rows = phrase_rows()
    df = spark.createDataFrame([(t, lang, 1, 2, 3, "k") for t, lang in rows],
                               "text string, lang string, w1 int, a int, t int, word string").repartition(4)
    got = sorted(tuple(r) for r in collocations.mine(df, top, least).collect())
    assert got == brute_phrases(rows, top, least)


def test_collocations_empty(spark):
    schema = "text string, lang string"
    assert collocations.mine(spark.createDataFrame([], schema)).count() == 0
    assert collocations.mine(spark.createDataFrame([(None, None), ("", "en")], schema)).count() == 0


@pytest.mark.parametrize("name,table", [("op12_topk", "embeddings"), ("op13_collocations", "documents")])
def test_queries_against_sql(spark, name, table):
    con = duckdb.connect()
    con.execute(f"create view {table} as select * from '{SF}/{table}.parquet'")
    want = con.execute(queries.ORACLES[name])
    names = [c[0] for c in want.description]
    got = queries.QUERIES[name](spark, SF)
    assert got.columns == names and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_whitening_query(spark):
    got = queries.op11_whitening(spark, SF)
    assert got.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    rows = got.collect()
    assert len(rows) == 4 * spark.read.parquet(f"{SF}/embeddings.parquet").count() and rows[0]["identity_error"] < 1e-4
