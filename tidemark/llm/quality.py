"""Quality classifier: a weak-label model over overlapping heuristic labellers trains a hashed linear scorer.

Every labeller votes good, bad or abstains on figures of the whole text. The vote patterns of all documents are
counted; expectation-maximisation on those counts estimates each labeller's accuracies and the share of good
documents, and gives each pattern's posterior. About MAX_DOCS documents, by a hash of their text, with their
patterns' posteriors as labels, train a linear scorer on hashed word features (their mean over the words) and
hashed bins of the figures; together they hold at most about MAX_ENTRIES features, or fewer of them train. Documents
whose score is below KEEP are rejected.

Null and empty texts get score 0 and are rejected; very long texts are read whole, words beyond 64 characters in
parts; repeated rows vote as often as they stand, are scored each and train once; an empty table gives no rows;
quality() ignores extra columns, score() keeps them and raises ValueError if they clash with its own. No label,
language, source or id is read.
"""

from __future__ import annotations

import operator
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, fit_apart
from .hashed import PLACES, Adam, WordScores, features, pieces

MAX_DOCS = 4_000  # documents that train the scorer
MAX_ENTRIES = 8_000_000  # features of these documents, all together; beyond, fewer documents
GRAMS = (3,)  # a word's features: itself and its byte triplets, borders included
SCALE = 1 << 40  # of the hash that draws the sample
ROUNDS, STEPS = 50, 60
KEEP = 0.5
BINS = 8
#: name, the figure is bad from, good up to (or the other way round where bad < good)
LABELLERS = (
    ("symbols", 0.08, 0.02),  # share of symbol characters
    ("noise", 0.15, 0.05),  # runs of symbols, and words of one symbol, a word
    ("capitals", 0.5, 0.2),  # share of capitals among ASCII letters
    ("shouts", 0.5, 0.1),  # exclamation and question marks a word
    ("repeats", 0.2, 0.05),  # share of words that repeat their neighbour, or one two places before
    ("distinct", 0.15, 0.4),  # share of distinct words among the first of every 64, so that length matters little
    ("long_words", 14.0, 9.0),  # mean characters a word
    ("digits", 0.6, 0.4),  # share of digits
    ("letters", 0.3, 0.5),  # share of letters (and non-ASCII bytes)
)
_runs = re.compile(r"[#$%&*@^~<>{}|\\=+_]{2,}").findall
_BARE = frozenset("#$%&*@^~<>{}|\\=+_-")
_SYMBOLS = np.frombuffer(b"#$%&*@^~<>{}|\\=+_", dtype=np.uint8)


def figures(text: str, words: list[str]) -> list[float]:
    """The labellers' figures of a text with these words (at least one)."""
    b = np.bincount(np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8), minlength=256)
    n, solid = len(words), max(1, int(b[33:].sum()))
    upper, lower = int(b[65:91].sum()), int(b[97:123].sum())
    again = max(sum(map(operator.eq, words, words[k:])) for k in (1, 2)) / n
    stretches = range(0, n, 64)
    distinct = sum(len(set(words[i : i + 64])) for i in stretches) / n
    return [
        float(b[_SYMBOLS].sum()) / solid,
        (len(_runs(text)) + sum(map(_BARE.__contains__, words))) / n,
        upper / max(1, upper + lower),
        float(b[33] + b[63]) / n,
        again,
        distinct,
        len(text) / n,
        float(b[48:58].sum()) / solid,
        float(upper + lower + b[128:].sum()) / solid,
    ]


def votes(x: list[float]) -> str:
    """One character for each labeller: + good, - bad, 0 none."""
    out = []
    for v, (_, bad, good) in zip(x, LABELLERS, strict=True):
        out.append("-" if (v >= bad if bad > good else v <= bad) else "+" if (v <= good if bad > good else v >= good) else "0")
    return "".join(out)


def em(patterns: dict[str, int]) -> dict[str, float]:
    """Posterior of good for each vote pattern, by EM with votes independent given the class; an abstention tells nothing."""
    if not patterns:
        return {}
    keys = sorted(patterns)
    v = np.array([["-0+".index(c) for c in p] for p in keys])
    onehot = np.array([[1.0, 0.0], [0.0, 0.0], [0.0, 1.0]])[v]
    count = np.array([patterns[p] for p in keys], dtype=np.float64)
    # start: a labeller that votes is right four times in five, and one bad vote outweighs the good ones
    q = np.where((v == 0).any(1), 0.1, 0.9)
    for _ in range(ROUNDS):
        like = []
        for w, prior in ((count * q, 0), (count * (1 - q), 1)):
            seen = (w[:, None, None] * onehot).sum(0) + (np.array([0.2, 0.8]) if prior == 0 else np.array([0.8, 0.2]))
            like.append(np.log(w.sum() + 1) + (onehot * np.log(seen / seen.sum(1, keepdims=True))).sum((1, 2)))
        q = 1 / (1 + np.exp(np.clip(like[1] - like[0], -50, 50)))
    return dict(zip(keys, q.tolist(), strict=True))


def bins(x: list[float]) -> list[int]:
    """Places of the figures' bins in the scorer's second table."""
    out = []
    for i, (v, (_, bad, good)) in enumerate(zip(x, LABELLERS, strict=True)):
        at = (v - good) / (bad - good)  # 0 where good begins, 1 where bad does
        out.append(i * BINS + int(np.clip(np.floor(at * 4) + 2, 0, BINS - 1)))
    return out


class Scorer:
    """A fitted linear scorer."""

    def __init__(self, table: np.ndarray, by_bin: np.ndarray, bias: float):
        self.words, self.by_bin, self.bias = WordScores(table, GRAMS), by_bin, bias

    def __call__(self, texts: list[str | None]) -> list[float]:
        words, counts, rest = [], [], []
        for t in texts:
            w = (t or "").split()
            rest.append(self.by_bin[bins(figures(t, w))].sum() if w else 0.0)
            found = pieces(w)
            words += found
            counts.append(len(found))
        n = np.array(counts)
        e = self.words(words)[:, 0] if words else np.zeros(0)
        mean = np.bincount(np.repeat(np.arange(len(n)), n), weights=e, minlength=len(n)) / np.maximum(n, 1)
        f = np.clip(self.bias + mean + np.array(rest), -50, 50)
        return [float(x) if k else 0.0 for x, k in zip(1 / (1 + np.exp(-f)), counts, strict=True)]


def pack(texts: list[str]) -> tuple[list[bytes], list[bytes], list[bytes], list[int]]:
    """(places, their shares of the text, bins, number of places) of every text: what training knows of it."""
    places, shares, in_bins, entries = [], [], [], []
    for t in texts:
        words = t.split()
        found = pieces(words)
        number = {w: i for i, w in enumerate(dict.fromkeys(found))}
        count = np.bincount(np.fromiter(map(number.__getitem__, found), np.int64, len(found)), minlength=len(number))
        place, owner = features(list(number), GRAMS)
        p, at = np.unique(place, return_inverse=True)
        places.append(p.astype(np.int32).tobytes())
        shares.append((np.bincount(at, weights=count[owner]) / len(found)).astype(np.float32).tobytes())
        in_bins.append(np.array(bins(figures(t, words)), np.int32).tobytes())
        entries.append(len(p))
    return places, shares, in_bins, entries


def fit(places: list[np.ndarray], shares: list[np.ndarray], in_bins: np.ndarray, y: np.ndarray) -> Scorer:
    """Logistic regression of soft labels on the features of pack()."""
    n = len(LABELLERS) * BINS
    table, by_bin, bias = Adam(np.zeros(PLACES, np.float32), 0.02), Adam(np.zeros(n), 0.1), Adam(np.zeros(1), 0.1)
    if not len(y):
        return Scorer(table.value[:, None], by_bin.value, 0.0)
    place, share = np.concatenate(places), np.concatenate(shares)
    doc = np.repeat(np.arange(len(y), dtype=np.int32), [len(p) for p in places])
    weight = np.where(y > 0.5, 0.5 / max(1e-9, y.sum()), 0.5 / max(1e-9, (1 - y).sum()))  # both classes count alike
    for _ in range(STEPS):
        f = bias.value + np.bincount(doc, weights=table.value[place] * share, minlength=len(y)) + by_bin.value[in_bins].sum(1)
        g = (1 / (1 + np.exp(-np.clip(f, -50, 50))) - y) * weight
        table.step((np.bincount(place, weights=g[doc] * share, minlength=PLACES) + 1e-6 * table.value).astype(np.float32))
        by_bin.step(np.bincount(in_bins.ravel(), weights=np.repeat(g, in_bins.shape[1]), minlength=n) + 1e-4 * by_bin.value)
        bias.step(np.array([g.sum()]))
    return Scorer(table.value[:, None], by_bin.value, float(bias.value[0]))


def train(docs: DataFrame, text: str = "text", max_docs: int = MAX_DOCS, max_entries: int = MAX_ENTRIES) -> tuple[Scorer, dict[str, float]]:
    """The scorer, and the posterior of every vote pattern in all of ``docs``.

    The sample is hashed where it lies and fitted in one task: the driver sees vote counts, the sample's hashes
    with their numbers of entries, and the model.
    """

    def vote(texts):
        return [[votes(figures(t, w)) if t and (w := t.split()) else None for t in texts]]

    voted = add_columns(docs.select(F.col(text).alias("_t")), ["_t"], {"_v": "string"}, lambda: vote, [])
    patterns = {r["_v"]: r["n"] for r in voted.where("_v IS NOT NULL").groupBy("_v").agg(F.count("*").alias("n")).collect()}  # at most 3 to the power of the labellers
    posterior = em(patterns)
    total = sum(patterns.values())
    share = min(SCALE, int(SCALE * max_docs / max(1, total)) + 1)

    def learn(texts):
        texts = [t if t.split() else "" for t in texts]
        solid = [i for i, t in enumerate(texts) if t]
        out = [[b""] * len(texts), [b""] * len(texts), [b""] * len(texts), [0] * len(texts), [0.0] * len(texts)]
        for i, *row in zip(solid, *pack([texts[i] for i in solid]), strict=True):
            for column, x in zip(out, row, strict=False):
                column[i] = x
            out[4][i] = posterior.get(votes(figures(texts[i], texts[i].split())), 0.5)
        return out

    hashed = docs.select(F.col(text).alias("_t"), F.pmod(F.xxhash64(F.lit(13), F.col(text)), F.lit(SCALE)).alias("_h"))
    sample = hashed.where(F.col("_t").isNotNull() & (F.col("_h") < share))
    packed = add_columns(sample, ["_t"], {"p": "binary", "s": "binary", "b": "binary", "e": "int", "y": "double"}, lambda: learn, ["_h"])
    packed = cut(packed.where("e > 0").dropDuplicates(["p", "s", "b"]))
    sizes = sorted((r["_h"], r["e"]) for r in packed.select("_h", "e").collect())  # about max_docs rows of two numbers
    held = np.cumsum([e for _, e in sizes])
    if len(sizes) and held[-1] > max_entries:
        packed = packed.where(F.col("_h") < sizes[max(1, int(np.searchsorted(held, max_entries)))][0])

    def run(pdf):
        pdf = pdf.sort_values(["_h", "p"], ignore_index=True)
        arrays = lambda c, kind: [np.frombuffer(x, kind) for x in pdf[c]]
        return fit(arrays("p", np.int32), arrays("s", np.float32), np.array(arrays("b", np.int32)), pdf["y"].to_numpy())

    return fit_apart(packed, run, lambda: fit([], [], np.zeros((0, 0), np.int32), np.zeros(0))), posterior


def score(docs: DataFrame, scorer: Scorer, text: str = "text", out: str = "score", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with a quality score from 0 to 1 for every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(scorer)

    def start():
        s = model.value
        return lambda texts: [s(texts)]

    return add_columns(docs, [text], {out: "double"}, start, keep)


def quality(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = KEEP) -> DataFrame:
    """Per document: key, score, keep (1 if score >= ``least``, else 0)."""
    scored = score(docs.select(key, text), train(docs, text)[0], text, keep=[key])
    return scored.select(key, "score", (F.col("score") >= least).cast("int").alias("keep"))
