"""Toxicity: a factorization machine over hashed terms.

Terms of a text are its distinct lower-cased words and their prefixes of 4 to 6 characters, so that inflected
forms meet; they are hashed into 2^30 places, of which only those kept by training hold weights. The machine's
score is a bias, a weight for each term present, and for each pair of present terms the product of their factor
vectors, so that two terms that are harmless alone can be harmful together.

Training reads at most about MAX_DOCS labelled rows (those with the lowest hash of their id), whole texts, as hashed
terms made on the executors, and fits in one task. It keeps at most MAX_TERMS terms: those whose share of label 1
is significantly high or low, and those of pairs whose share differs from what both terms announce alone, so that
a pair is learned even if neither of its terms tells anything by itself. Weights and factors are fitted by Adam
on the logistic loss. Scores read nothing but the text: null and empty texts get the bias alone, very long texts
are read whole. Rows with a null label are not learned from; a document labelled twice counts by its highest
label; without any labelled row every score is 0. Repeated document rows are scored each, and train once if
their texts are equal; an empty table gives no rows; toxicity() ignores extra columns, score() keeps them and
raises ValueError if they clash with its own.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fit_apart, fold

MAX_DOCS = 6_000  # labelled rows that training reads
MAX_TERMS = 1_024  # terms with weights
PAIR_TERMS = 2_048  # terms whose pairs are looked at
LEAST = 6.0  # standard deviations from the base rate that a term needs
LEAST_PAIR = 12.0  # and a pair, from what its two terms announce
PAIRED = 10  # documents in which a pair must stand
FACTORS, STEPS = 8, 150
PLACES = (1 << 30) - 1
CACHE, LONGEST = 400_000, 64  # words that a worker keeps, and their characters
_words = re.compile(r"\w+").findall


def word_terms(word: str) -> list[int]:
    """Hashed terms of a lower-cased word: the word and its prefixes of 4 to 6 characters."""
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass")) & PLACES]
    out += [zlib.crc32(b"p" + word[:n].encode("utf-8", "surrogatepass")) & PLACES for n in (4, 5, 6) if len(word) >= n]
    return out


class Machine:
    """A fitted machine: kept terms, bias, weights and factors."""

    def __init__(self, terms: np.ndarray, bias: float, weights: np.ndarray, factors: np.ndarray):
        self.place = {int(t): i for i, t in enumerate(terms)}
        self.bias, self.weights, self.factors = bias, weights, factors
        self.known: dict[str, tuple[int, ...]] = {}

    def score(self, text: str) -> float:
        known, found = self.known, set()
        for w in set(_words(text.lower())):
            if (at := known.get(w)) is None:
                if len(known) >= CACHE:
                    known.clear()
                at = tuple(self.place[t] for t in word_terms(w) if t in self.place)
                if len(w) <= LONGEST:
                    known[w] = at
            if at:
                found.update(at)
        if not found:
            return _sigmoid(self.bias)
        i = sorted(found)
        v = self.factors[i]
        pairs = 0.5 * float((v.sum(0) ** 2).sum() - (v * v).sum())
        return _sigmoid(self.bias + float(self.weights[i].sum()) + pairs)

    def __getstate__(self):
        return self.__dict__ | {"known": {}}


def _sigmoid(x: float) -> float:
    return float(1 / (1 + np.exp(-np.clip(x, -60, 60))))


def _telling(x: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """For the columns of x [row, term]: deviations of each term alone, and of each pair from what its two terms announce."""
    df, hits = x.sum(0), x.T @ y
    alone = (hits - df * base) / np.sqrt(df * base * (1 - base))
    logit = np.log((hits + base) / (df - hits + 1 - base))  # smoothed towards the base rate
    n = x.T @ x
    h = (x * y[:, None]).T @ x
    announced = 1 / (1 + np.exp(-np.clip(logit[:, None] + logit[None, :] - np.log(base / (1 - base)), -30, 30)))
    announced = np.clip(announced, base / 10, 1 - base / 10)
    z = (h - n * announced) / np.sqrt(np.maximum(n * announced * (1 - announced), 1e-9))
    z[n < PAIRED] = 0
    np.fill_diagonal(z, 0)
    return alone, z


def choose(flat: np.ndarray, owner: np.ndarray, y: np.ndarray, base: float) -> tuple[np.ndarray, np.ndarray]:
    """(all distinct terms, places among them of those that get weights).

    Kept are the terms that stand out alone, in either direction, and the terms of pairs that stand out together
    from what both announce alone, among the PAIR_TERMS terms that stand out most or are the most frequent.
    """
    terms, place, df = np.unique(flat, return_inverse=True, return_counts=True)
    hits = np.bincount(place, weights=y[owner], minlength=len(terms))
    z = np.abs((hits - df * base) / np.sqrt(df * base * (1 - base)))
    alone = np.flatnonzero((z >= LEAST) & (df >= 5))
    alone = alone[np.argsort(-z[alone], kind="stable")][:MAX_TERMS]
    often = np.flatnonzero((df >= PAIRED) & (df <= 0.9 * len(y)))
    often = often[np.argsort(-df[often], kind="stable")]
    asked = np.concatenate([alone[: PAIR_TERMS // 2], often[~np.isin(often, alone)]])[:PAIR_TERMS]
    column = np.full(len(terms), -1)
    column[asked] = np.arange(len(asked))
    x = np.zeros((len(y), len(asked)), np.float32)
    at = column[place]
    x[owner[at >= 0], at[at >= 0]] = 1
    together = np.abs(_telling(x, y.astype(np.float32), base)[1]) if len(asked) else np.zeros((0, 0))
    u, v = np.nonzero(np.triu(together >= LEAST_PAIR))
    best = np.argsort(-together[u, v], kind="stable")
    paired = asked[np.column_stack([u[best], v[best]]).ravel()]
    kept = list(dict.fromkeys([*alone.tolist(), *paired.tolist()]))[:MAX_TERMS]
    return terms, np.sort(np.array(kept, dtype=np.int64))


def fit(docs: list[tuple[np.ndarray, int]], seed: int = 11) -> Machine:
    """Fit on (distinct hashed terms, label) rows."""
    seen: dict[bytes, tuple[np.ndarray, int]] = {}
    for terms, y in docs:  # copies of a text must not make its words look telling
        seen.setdefault(terms.tobytes(), (terms, y))
    rows = list(seen.values())
    y = np.array([r[1] for r in rows], dtype=np.float64)
    if not len(y):
        return Machine(np.zeros(0, np.int64), -60.0, np.zeros(0), np.zeros((0, FACTORS)))
    base = (y.sum() + 0.5) / (len(y) + 1)
    flat, owner = np.concatenate([r[0] for r in rows]), np.repeat(np.arange(len(rows)), [len(r[0]) for r in rows])
    terms, keep = choose(flat, owner, y, base)
    column = np.full(len(terms), -1)
    column[keep] = np.arange(len(keep))
    at = column[np.searchsorted(terms, flat)]
    x = np.zeros((len(rows), len(keep)), dtype=np.float32)
    x[owner[at >= 0], at[at >= 0]] = 1
    x, which = np.unique(np.column_stack([x, y.astype(np.float32)]), axis=0, return_counts=True)
    x, yy = x[:, :-1], x[:, -1]
    rng = np.random.default_rng(seed)
    p = [np.array([np.log(base / (1 - base))]), np.zeros(len(keep)), rng.normal(0, 0.05, (len(keep), FACTORS))]
    m, s = [np.zeros_like(q) for q in p], [np.zeros_like(q) for q in p]
    for step in range(1, STEPS + 1):
        xv = x @ p[2]
        f = p[0] + x @ p[1] + 0.5 * ((xv**2).sum(1) - x @ (p[2] ** 2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(f, -60, 60))) - yy) * which / len(rows)
        gx = x.T @ g
        grads = [np.array([g.sum()]), gx + 1e-5 * p[1], x.T @ (g[:, None] * xv) - gx[:, None] * p[2] + 1e-4 * p[2]]
        for i, d in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * d
            s[i] = 0.999 * s[i] + 0.001 * d * d
            p[i] -= 0.08 * (m[i] / (1 - 0.9**step)) / (np.sqrt(s[i] / (1 - 0.999**step)) + 1e-9)
    return Machine(terms[keep], float(p[0][0]), p[1], p[2])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", key: str = "doc_id", text: str = "text", max_docs: int = MAX_DOCS) -> Machine:
    """Fit on at most about ``max_docs`` labelled documents, whole texts; both frames may be filtered by the caller."""
    marked = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("int").alias("_y"))
    n = marked.count()
    if n > max_docs:
        marked = marked.where(F.pmod(F.xxhash64(F.lit(3), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * max_docs / n))

    def make(texts):
        return [[np.array(sorted({t for w in set(_words(x.lower())) for t in word_terms(w)}), dtype=np.int32).tobytes() for x in texts]]

    rows = docs.select(key, F.coalesce(F.col(text), F.lit("")).alias("_t")).join(F.broadcast(marked), key).select("_t", "_y")  # about max_docs rows of two numbers
    hashed = add_columns(rows, ["_t"], {"t": "binary"}, lambda: make, ["_y"])

    def run(pdf):
        return fit([(np.frombuffer(t, dtype=np.int32), int(y)) for t, y in sorted(zip(pdf["t"], pdf["_y"], strict=True))])

    return fit_apart(hashed, run, lambda: fit([]))


def score(docs: DataFrame, machine: Machine, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a toxicity score from 0 to 1 for every whole text."""
    return add_columns(docs, [text], {out: "double"}, lambda: lambda texts: [[machine.score(t or "") for t in texts]])


def toxicity(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", cut: float = 0.3) -> DataFrame:
    """Per document: key, held_out (crc32 of the id mod 4 is 2: never learned from), score, predicted."""
    learn = labels.where(fold(key, 4) != 2)
    scored = score(docs.select(F.col(key), F.col(text)), train(docs, learn, key=key, text=text), text)
    return scored.select(key, (fold(key, 4) == 2).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
