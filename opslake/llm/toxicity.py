"""Toxicity: a weighted finite-state grammar over clauses, with a logistic calibration.

Words map to symbols (insult, threat, target, negation, report, other).  Five small
transducers read the symbols of a clause: insult and threat emit weights, target
raises what stands near a person, negation and reported speech lower what follows.
They are composed once into one table of (next state, kind, factor); clauses without
an insult or threat are never run.  A document's matched clauses give a few
features, and logistic regression on the training labels (gradients and Hessians
summed per partition) turns them into a probability.

Besides the fixed word lists, words that mark toxic training documents, and stems
(first letters of words) that mark them when they occur twice, are learned as insults
from a bounded sample of labelled rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.llm import textops as T
from opslake.sources.sinks import materialize

# fixed values: the grammar's word lists (lower case)
INSULTS = """idiot idiots moron morons stupid loser losers worthless pathetic disgusting trash scum clown vermin filth imbecile
dumb dumbass fool bastard bitch asshole jerk creep retard retarded freak pig swine degenerate parasite
idioten dumm dummkopf trottel abschaum versager arschloch wertlos ekelhaft schwachkopf
imbécile crétin débile connard salaud ordure minable abruti
idiota imbécil estúpido estúpida basura escoria inútil asqueroso patético perdedor""".split()
THREATS = """kill hurt destroy beat smash burn hang shoot stab strangle crush
töten umbringen schlagen verprügeln tuer frapper écraser matar golpear destruir""".split()
TARGETS = """you your yours yourself he him she her they them their people everyone
du dich dir ihr euch sie ihn tu toi vous ton ta elle ils tú te usted ustedes él ella ellos""".split()
NEGATIONS = "not no never isn aren wasn don doesn didn nobody hardly nicht kein keine nie pas jamais nunca jamás tampoco".split()
REPORTS = """said says say called calls wrote writes quoted quote claimed claims reported allegedly told accused
sagte nannte schrieb zitiert angeblich disait écrit appelé dijo llamó escribió""".split()
OTHER, INSULT, THREAT, TARGET, NEGATION, REPORT = range(6)
_SPLIT = np.zeros(256, bool)
_SPLIT[[ord(c) for c in ".!?;\n"]] = True
FEATURES = ("weight", "strongest", "clauses", "targeted", "threats", "softened", "rate", "stems", "repeated")
STEMS = (4, 5, 6, 7)


def hash_words(words: list[str]) -> np.ndarray:
    raw, off = T.flat(pa.array(words, pa.string()))
    return T.words(raw, off, T.ALNUM_WORDS, lower=False)[3]


# Each transducer: number of states, step(state, symbol) -> state, factor(state, symbol) -> what it multiplies
# the weight of an insult or threat read in that state by.
def _scope(opener: int, length: int, factor: float):
    """Open for ``length`` words after the opener (0: to the end of the clause)."""
    if not length:
        return 2, lambda s, x: 1 if x == opener else s, lambda s, x: factor if s else 1.0
    return length + 1, lambda s, x: length if x == opener else max(0, s - 1), lambda s, x: factor if s else 1.0


def _near(length: int, symbol: int, up: float, down: float):
    """A target among the last ``length`` words raises, none lowers, the weight of ``symbol``."""
    return (length + 1, lambda s, x: length if x == TARGET else max(0, s - 1),
            lambda s, x: (up if s else down) if x == symbol else 1.0)


TRANSDUCERS = [_scope(NEGATION, 4, 0.3), _scope(REPORT, 0, 0.5), _near(3, INSULT, 1.5, 1.0), _near(4, THREAT, 1.0, 0.4)]


def compose() -> tuple[list, list, list]:
    """next[state][symbol], factor[state][symbol] and flags[state] of the product automaton; state 0 is the start.

    The flags tell which transducers are open: (negated or reported, a target is near an insult, near a threat).
    """
    states = list(product(*(range(n) for n, _, _ in TRANSDUCERS)))
    number = {s: i for i, s in enumerate(states)}
    nxt = [[number[tuple(t[1](p, x) for t, p in zip(TRANSDUCERS, s, strict=True))] for x in range(6)] for s in states]
    fac = [[float(np.prod([t[2](p, x) for t, p in zip(TRANSDUCERS, s, strict=True)])) for x in range(6)] for s in states]
    return nxt, fac, [(bool(s[0] or s[1]), bool(s[2]), bool(s[3])) for s in states]


_NEXT, _FACTOR, _FLAGS = compose()


def clause_score(symbols: list[int], weights: list[float]) -> tuple[float, bool, bool, bool]:
    """(weight, near a target, has a threat, softened by negation or report) of one clause.

    A threat also counts in full if a target follows within four words.
    """
    state, total, targeted, threat, soft, open_threat, left = 0, 0.0, False, False, False, 0.0, 0
    for x, w in zip(symbols, weights, strict=True):
        if x in (INSULT, THREAT):
            f = _FACTOR[state][x]
            softened, by_target, threat_by_target = _FLAGS[state]
            total += f * w
            soft |= softened
            targeted |= x == INSULT and by_target
            if x == THREAT:
                threat, open_threat, left = True, 0.0 if threat_by_target else 0.6 * w * f / 0.4, 5
        elif x == TARGET and left and open_threat:
            total, targeted, open_threat = total + open_threat, True, 0.0
        left = max(0, left - 1)
        state = _NEXT[state][x]
    return total, targeted, threat, soft


@dataclass
class Lexicon:
    """Sorted word hashes with their symbol and weight (a learned word: its log-odds, 1 at most), and learned stems."""
    hashes: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    symbols: np.ndarray = field(default_factory=lambda: np.empty(0, np.int8))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    stems: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))
    stem_weights: np.ndarray = field(default_factory=lambda: np.empty(0))

    @staticmethod
    def build(learned: dict[int, float] | None = None, stems: dict[int, float] | None = None) -> Lexicon:
        entry = {int(h): (INSULT, w) for h, w in (learned or {}).items()}
        for symbol, words in ((INSULT, INSULTS), (THREAT, THREATS), (TARGET, TARGETS), (NEGATION, NEGATIONS), (REPORT, REPORTS)):
            entry.update({int(h): (symbol, 1.0) for h in hash_words(words)})
        keys = sorted(entry)
        return Lexicon(np.array(keys, np.uint64), np.array([entry[k][0] for k in keys], np.int8), np.array([entry[k][1] for k in keys]),
                       np.array(sorted(stems or {}), np.uint64), np.array([stems[k] for k in sorted(stems or {})]))


def _look_up(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index into h, index into the sorted keys) of the hashes that are keys."""
    if not len(keys) or not len(h):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    seen = np.zeros(1 << 16, bool)
    seen[(keys >> np.uint64(48)).astype(np.int64)] = True
    maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(keys, h[maybe]), len(keys) - 1)
    ok = keys[at] == h[maybe]
    return maybe[ok], at[ok]


def _words(text: pa.Array):
    raw, off = T.flat(pc.utf8_lower(pc.fill_null(text.cast(pa.large_string()), "")))
    return raw, off, *T.words(raw, off, T.ALNUM_WORDS, lower=False)


def features(text: pa.Array, lex: Lexicon) -> np.ndarray:
    """(documents, len(FEATURES)) from the matched clauses of every whole text; zeros if none matches."""
    raw, off, doc, s, e, h = _words(text)
    out = np.zeros((len(off) - 1, len(FEATURES)))
    if not len(h):
        return out
    symbol, weight = np.zeros(len(h), np.int8), np.zeros(len(h))
    if len(lex.stems):
        for size in STEMS:
            at, key = _look_up(lex.stems, T.stem_hashes(raw, s, e, size))
            symbol[at], weight[at] = INSULT, np.maximum(weight[at], lex.stem_weights[key])
    stemmed = symbol == INSULT
    at, key = _look_up(lex.hashes, h)
    symbol[at], weight[at] = lex.symbols[key], lex.weights[key]
    clause = np.r_[0, np.cumsum(_SPLIT[raw])][s] + doc  # a document border also ends a clause
    hits = np.flatnonzero((symbol == INSULT) | (symbol == THREAT))
    n_words = np.diff(T.by_doc(doc, len(off) - 1))
    for c in np.unique(clause[hits]):
        a, b = np.searchsorted(clause, [c, c + 1])
        w, target, threat, soft = clause_score(symbol[a:b].tolist(), weight[a:b].tolist())
        row = out[doc[a]]
        row[[0, 2, 3, 4, 5]] += (w, 1, target, threat, soft)
        row[1] = max(row[1], w)
        if not soft:  # learned stems count in clauses that are neither negated nor reported
            row[7] += stemmed[a:b].sum()
    out[:, 8] = out[:, 7] >= 2
    out[:, 6] = 100 * out[:, 0] / np.maximum(n_words, 20)
    return np.log1p(out)


def _marks(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, hash, occurrences) of the distinct words and stems of every text."""
    raw, off, doc, s, e, h = _words(text)
    parts = [(doc, h)]
    for size in STEMS:
        x = T.stem_hashes(raw, s, e, size)
        parts.append((doc[x > 0], x[x > 0]))
    d, k = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    order = np.lexsort((k, d))
    d, k = d[order], k[order]
    new = np.flatnonzero(np.r_[True, (d[1:] != d[:-1]) | (k[1:] != k[:-1])]) if len(d) else np.empty(0, np.int64)
    return d[new], k[new], np.diff(np.r_[new, len(d)])


def learn_lexicon(labelled: DataFrame, min_share: float = 0.03, least: int = 5, precision: float = 0.8) -> Lexicon:
    """Lexicon with words and stems that mark the toxic rows of ``labelled`` (text, label 0/1).

    A word counts if it is in at least ``least`` and ``min_share`` of the toxic rows
    and ``precision`` of the rows with it (smoothed) are toxic; a stem likewise among the
    rows that have it twice.  At most (words per row / min_share) of them can reach the
    share of toxic rows, so what the driver collects is bounded.
    """
    def count(keys: np.ndarray | None):
        def run(batches):
            for b in T.slices(batches):
                y = b.column("label").to_numpy(zero_copy_only=False) == 1
                d, k, n = _marks(b.column("text"))
                if keys is not None:
                    d, k, n = (x[np.isin(k, keys)] for x in (d, k, n))
                u, inv = np.unique(k, return_inverse=True)
                sums = [np.bincount(inv, w, len(u)).astype(np.int64) for w in (y[d], np.ones(len(d)), y[d] & (n > 1), n > 1)]
                yield pa.record_batch([pa.array(u.view(np.int64)), *map(pa.array, sums)], ["mark", "bad", "n", "bad2", "n2"])
        return run
    total = [F.sum(c).alias(c) for c in ("bad", "n", "bad2", "n2")]
    schema = "mark long, bad long, n long, bad2 long, n2 long"
    rows = labelled.select("text", "label")
    floor = max(least, int(min_share * rows.where("label = 1").count()))
    often = rows.where("label = 1").mapInArrow(count(None), schema).groupBy("mark").agg(*total).where(F.col("bad") >= floor)
    keys = np.array([r["mark"] for r in often.select("mark").collect()], np.int64).view(np.uint64)
    got = rows.mapInArrow(count(keys), schema).groupBy("mark").agg(*total).collect()
    words, stems = {}, {}
    for r in got:
        key, odds = int(np.int64(r["mark"]).view(np.uint64)), np.log((r["bad"] + 1) / (r["n"] - r["bad"] + 1)) / 3
        if (r["bad"] + 1) / (r["n"] + 2) >= precision:
            words[key] = float(min(1.0, odds))
        if r["bad2"] >= floor and (r["bad2"] + 1) / (r["n2"] + 2) >= precision:
            stems[key] = float(min(1.0, max(0.1, odds)))
    return Lexicon.build(words, stems)


def _rows(batches):
    for b in batches:
        if b.num_rows:
            yield b, np.c_[np.array(b.column("features").flatten()).reshape(b.num_rows, -1), np.ones(b.num_rows)]


def fit_logistic(rows: DataFrame, rounds: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Newton steps on (features, label); each step sums one small matrix per partition.  No rows: zeros (score 0.5)."""
    d = len(FEATURES) + 1
    beta = np.zeros(d)
    rows = materialize(rows.where("label is not null").select("features", F.col("label").cast("double").alias("label")), "toxic-train")
    for _ in range(rounds):
        def part(batches, beta=beta):
            total = np.zeros((d, d + 1))
            for b, x in _rows(batches):
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                y = b.column("label").to_numpy(zero_copy_only=False)
                total += np.c_[(x * (p * (1 - p))[:, None]).T @ x, x.T @ (y - p)]
            yield pa.record_batch([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "v"])
        got = rows.mapInArrow(part, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()
        if not got:
            return beta
        a = np.array([r["v"] for r in got]).reshape(d, d + 1)
        step = np.linalg.solve(a[:, :d] + ridge * np.diag(np.r_[np.ones(d - 1), 1e-6]), a[:, d] - ridge * np.r_[beta[:-1], 0])
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


def toxicity_scores(docs: DataFrame, labels: DataFrame, sample_rows: int = 10_000) -> DataFrame:
    """doc_id, score (0 to 1), matched_clauses, weight for every row of ``docs`` (doc_id, text).

    ``labels`` (doc_id, label 0/1) are training labels only.  Words and stems are
    learned from at most ``sample_rows`` of them (picked by a hash of doc_id), the
    calibration uses all.  Null and empty texts have no clause and get the score
    of a text without matches; repeated rows give equal results; without labels
    every score is 0.5; extra columns are ignored.
    """
    labels = labels.where("label is not null").select("doc_id", "label")
    picked = labels.orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(sample_rows)
    # a bounded number of (doc_id, label) rows
    picked = F.broadcast(materialize(picked, "toxic-picked"))
    lex = learn_lexicon(materialize(docs.select("doc_id", "text").join(picked, "doc_id"), "toxic-sample"))

    def run(batches):
        for b in T.slices(batches):
            x = features(b.column("text"), lex)
            yield pa.record_batch([b.column("doc_id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(
                pa.list_(pa.float64()))], ["doc_id", "features"])
    feats = materialize(docs.select("doc_id", "text").mapInArrow(run, "doc_id long, features array<double>"), "toxic-features")
    beta = fit_logistic(feats.join(labels, "doc_id"))
    z = sum((F.col("features")[i] * F.lit(float(v)) for i, v in enumerate(beta[:-1])), F.lit(float(beta[-1])))
    return feats.select("doc_id", (1 / (1 + F.exp(-z))).alias("score"),
                        F.round(F.expm1(F.col("features")[2])).cast("long").alias("matched_clauses"),
                        F.expm1(F.col("features")[0]).alias("weight"))
