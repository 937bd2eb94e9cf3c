"""Language ID of code-switched text: a linear-chain conditional random field over words.

A word's state scores come from hashed affixes, n-grams and the word itself (its lexicon entry); transitions
between neighbouring words' languages are learned with them, on sequences of which half switch between two
documents' languages. Forward-backward gives each word's posterior; a document's language is the one with the
largest mean posterior over all its words, and that mean is the score.

Whole texts are read; chains run over stretches of STRETCH words. Training reads about QUOTA documents of each
language (by a hash of the id), two windows of WINDOW words from each, and fits in one task. Null texts and texts
without a letter (numeric signs are none) are ``und`` with score 0; ties go to the language first in order; without
any training row all is ``und``. Chains of a very long text begin anew at every STRETCH words, all of which count;
words beyond 64 characters are read in parts. Repeated rows give one result each; an empty table gives no rows;
language_id() ignores extra columns, predict() keeps them and raises ValueError if they clash with its own.
"""

from __future__ import annotations

import re

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, fit_apart, fold
from .hashed import PLACES, Adam, WordScores, features, pieces

QUOTA = 500  # training documents of a language
WINDOW = 48  # words of a training window
STRETCH = 128  # words of a chain
STEPS = 40
FEW = 10_000  # languages whose table is broadcast
_ascii = re.compile(r"[A-Za-z]+").findall
_letters = regex.compile(r"\p{L}[\p{L}\p{M}]*").findall


def words_of(text: str) -> list[str]:
    """Runs of letters with the marks that follow them; numeric signs are no letters."""
    return _ascii(text) if text.isascii() else _letters(text)


def _messages(scores: np.ndarray, inside: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Scores and transitions out of logs, and the forward and backward messages of padded chains."""
    n, steps, k = scores.shape
    e = np.exp(scores - scores.max(2, keepdims=True))
    e[~inside] = 1.0
    a = np.exp(transition - transition.max())
    forward, backward = np.empty_like(e), np.empty_like(e)
    x = e[:, 0] / e[:, 0].sum(1, keepdims=True)
    forward[:, 0] = x
    for t in range(1, steps):
        x = (x @ a) * e[:, t]
        x /= x.sum(1, keepdims=True)
        forward[:, t] = x
    y = np.full((n, k), 1.0 / k, dtype=e.dtype)
    backward[:, -1] = y
    for t in range(steps - 2, -1, -1):
        z = (e[:, t + 1] * y) @ a.T
        z /= z.sum(1, keepdims=True)
        y = np.where(inside[:, t + 1, None], z, np.float32(1.0 / k))  # nothing comes after a chain's end
        backward[:, t] = y
    return e, a, forward, backward


def posteriors(scores: np.ndarray, inside: np.ndarray, transition: np.ndarray) -> np.ndarray:
    """Word posteriors [chain, step, state] by forward-backward over padded chains.

    scores [chain, step, state], inside [chain, step] (true up to a chain's end), transition [state, state], all
    in logs.
    """
    _, _, forward, backward = _messages(scores, inside, transition)
    post = forward * backward
    return post / post.sum(2, keepdims=True)


def expectations(scores: np.ndarray, inside: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """posteriors(), and the expected transitions summed over all chains [state, state], which learning needs."""
    e, a, forward, backward = _messages(scores, inside, transition)
    post = forward * backward
    post /= post.sum(2, keepdims=True)
    pair = forward[:, :-1, :, None] * a * (e[:, 1:] * backward[:, 1:])[:, :, None, :]
    pair /= pair.sum((2, 3), keepdims=True)
    return post, (pair * inside[:, 1:, None, None]).sum((0, 1))


class Tagger:
    """A fitted field: the languages, the feature table, the transitions."""

    def __init__(self, langs: list[str], table: np.ndarray, transition: np.ndarray):
        self.langs, self.words, self.transition = langs, WordScores(table), transition.astype(np.float32)

    def __call__(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        words, counts = [], []
        for t in texts:
            found = pieces(words_of(t.lower())) if t else []
            words += found
            counts.append(len(found))
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if not words or not self.langs:
            return pred, score
        e = self.words(words)
        n = np.array(counts)
        chains = -(-n // STRETCH)
        begin = np.repeat(np.cumsum(n) - n, chains) + STRETCH * (np.arange(chains.sum()) - np.repeat(np.cumsum(chains) - chains, chains))
        end = np.minimum(begin + STRETCH, np.repeat(np.cumsum(n), chains))
        sums = np.zeros((len(begin), len(self.langs)))
        order = np.argsort(end - begin, kind="stable")
        for at in np.array_split(order, max(1, len(order) // 256)):  # chains of like length together
            steps = np.arange((end - begin)[at].max())
            inside = steps < (end - begin)[at, None]
            post = self.forward_backward(e[np.minimum(begin[at, None] + steps, len(e) - 1)], inside)
            sums[at] = (post * inside[:, :, None]).sum(1)
        owner = np.repeat(np.arange(len(n)), chains)
        total = np.stack([np.bincount(owner, weights=sums[:, k], minlength=len(n)) for k in range(sums.shape[1])], axis=1)
        for i in np.flatnonzero(n):
            k = int(total[i].argmax())
            pred[i], score[i] = self.langs[k], min(1.0, float(total[i, k] / n[i]))
        return pred, score

    def forward_backward(self, scores: np.ndarray, inside: np.ndarray) -> np.ndarray:
        return posteriors(scores, inside, self.transition)


def fit(windows: list[tuple[str, str]], seed: int = 5) -> Tagger:
    """Fit on (language, text of at most WINDOW words) rows."""
    langs = sorted({g for g, _ in windows})
    if not langs:
        return Tagger([], np.zeros((PLACES, 0), np.float32), np.zeros((0, 0)))
    rng = np.random.default_rng(seed)
    rows = [(langs.index(g), pieces(words_of(t.lower()))) for g, t in sorted(windows)]
    rows = [r for r in rows if r[1]]
    chains = []
    for i, j in enumerate(rng.permutation(len(rows))):
        (g, a), (h, b) = rows[i], rows[j]
        if i % 2:
            x, y = rng.integers(0, len(a) + 1), rng.integers(0, len(b) + 1)
            a, b = a[:x], b[y:]
        else:
            b = []
        if a or b:
            chains.append((a + b, [g] * len(a) + [h] * len(b)))
    vocabulary = {w: i for i, w in enumerate(sorted({w for c, _ in chains for w in c}))}
    place, owner = features(list(vocabulary))
    steps, k = max(len(c) for c, _ in chains), len(langs)
    at, gold, inside = np.zeros((len(chains), steps), np.int64), np.zeros((len(chains), steps), np.int64), np.zeros((len(chains), steps), bool)
    for i, (c, g) in enumerate(chains):
        at[i, : len(c)], gold[i, : len(c)], inside[i, : len(c)] = [vocabulary[w] for w in c], g, True
    truth = np.eye(k, dtype=np.float32)[gold]
    pairs = np.zeros((k, k))
    np.add.at(pairs, (gold[:, :-1][inside[:, 1:]], gold[:, 1:][inside[:, 1:]]), 1)
    table, trans, n = Adam(np.zeros((PLACES, k), np.float32), 0.03), Adam(np.zeros((k, k)), 0.1), inside.sum()
    for _ in range(STEPS):
        e = np.stack([np.bincount(owner, weights=table.value[place, c], minlength=len(vocabulary)) for c in range(k)], axis=1).astype(np.float32)
        post, expected = expectations(e[at], inside, trans.value.astype(np.float32))
        g = (post - truth) * inside[:, :, None]
        by_word = np.stack([np.bincount(at.ravel(), weights=g[:, :, c].ravel(), minlength=len(vocabulary)) for c in range(k)], axis=1)
        table.step((np.stack([np.bincount(place, weights=by_word[owner, c], minlength=PLACES) for c in range(k)], axis=1) / n).astype(np.float32) + np.float32(1e-7) * table.value)
        trans.step((expected - pairs) / n + 1e-4 * trans.value)
    return Tagger(langs, table.value, trans.value)


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quota: int = QUOTA) -> Tagger:
    """Fit on about ``quota`` documents of each language, the lowest hashes of their ids."""
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("_k"), F.col(lang).alias("_g"), F.col(text).alias("_t"))
    share = known.groupBy("_g").agg((F.lit(quota * 1e6) / F.count("*") + 1).alias("_share"))
    # a row for each language; beyond FEW (a column that holds no languages) the join is a shuffle
    share = F.broadcast(share) if share.count() <= FEW else share
    sample = known.join(share, "_g").where(F.pmod(F.xxhash64(F.lit(9), F.col("_k")), F.lit(1_000_000)) < F.col("_share")).drop("_share")

    def cut(texts, hashes):
        out = []
        for t, h in zip(texts, hashes, strict=True):
            words = words_of(t)
            half = max(1, len(words) - WINDOW)
            out.append([" ".join(words[i : i + WINDOW]) for i in sorted({h % half, h // 7919 % half})] if words else [])
        return [out]

    rows = add_columns(sample.withColumn("_h", F.pmod(F.xxhash64("_k", "_t"), F.lit(1 << 40))), ["_t", "_h"], {"w": "array<string>"}, lambda: cut, ["_g"])
    return fit_apart(rows, lambda pdf: fit([(g, w) for g, ws in zip(pdf["_g"], pdf["w"], strict=True) for w in ws]), lambda: fit([]))


def predict(docs: DataFrame, tagger: Tagger, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``docs`` with lang_pred and score (mean posterior of that language, 0 to 1)."""
    model = docs.sparkSession.sparkContext.broadcast(tagger)

    def start():
        tag = model.value
        return lambda texts: list(tag(texts))

    return add_columns(docs, [text], {"lang_pred": "string", "score": "double"}, start, keep)


def language_id(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Per document: key, held_out (crc32 of the id mod 5 is 0: never learned from), lang_pred, score."""
    tagger = train(docs.where(fold(key, 5) != 0), key, text, lang)
    return predict(docs.select(key, text), tagger, text, [key]).select(key, (fold(key, 5) == 0).alias("held_out"), "lang_pred", "score")
