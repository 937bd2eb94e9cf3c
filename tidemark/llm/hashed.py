"""Hashed word features: a word's byte n-grams with its borders (so that affixes are n-grams too) and the word itself."""

from __future__ import annotations

import zlib

import numpy as np

PLACES = 1 << 17
GRAMS = (2, 3, 4, 5)
LONGEST = 64  # characters; longer words are read as several
CACHE = 200_000


def features(words: list[str], grams: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(place of each feature, the index of its word), for all words at once."""
    raw = [w.encode("utf-8", "surrogatepass") for w in words]
    buf = np.frombuffer(b"".join([b"\x02" + w + b"\x03" for w in raw]), dtype=np.uint8).astype(np.uint32)
    owner = np.repeat(np.arange(len(raw)), np.array([len(w) + 2 for w in raw], dtype=np.int64))
    places = [np.array([zlib.crc32(w) for w in raw], dtype=np.uint32) >> 15]
    owners = [np.arange(len(raw))]
    for n in grams:
        m = len(buf) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for k in range(n):
            h = h * np.uint32(16777619) ^ buf[k : k + m]
        h = (h ^ h >> np.uint32(15)) * np.uint32(2246822519)
        inside = owner[:m] == owner[n - 1 :]
        places.append((h >> np.uint32(15))[inside])
        owners.append(owner[:m][inside])
    return np.concatenate(places).astype(np.int64), np.concatenate(owners)


def pieces(words: list[str]) -> list[str]:
    """``words`` with those beyond LONGEST cut into parts, all kept."""
    if words and max(map(len, words)) > LONGEST:
        return [w[i : i + LONGEST] for w in words for i in range(0, len(w), LONGEST)]
    return words


class WordScores:
    """Summed weights [word, class] of words under a table [PLACES, class]; known words are kept up to CACHE."""

    def __init__(self, table: np.ndarray, grams: tuple[int, ...] = GRAMS):
        self.table, self.grams = table, grams
        self.known: dict[str, int] = {}
        self.rows = np.zeros((0, table.shape[1]), dtype=np.float32)

    def __call__(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.known))
        if new:
            if len(self.known) + len(new) > CACHE and self.known:
                self.known, self.rows = {}, self.rows[:0]
                new = list(set(words))
            place, owner = features(new, self.grams)
            made = np.stack([np.bincount(owner, weights=self.table[place, c], minlength=len(new)) for c in range(self.table.shape[1])], axis=1)
            at = len(self.rows)
            self.rows = np.concatenate([self.rows, made.astype(np.float32)])
            self.known.update(zip(new, range(at, at + len(new)), strict=True))
        return self.rows[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))]

    def __getstate__(self):
        return {"table": self.table, "grams": self.grams, "known": {}, "rows": self.rows[:0]}


class Adam:
    """One parameter array under Adam."""

    def __init__(self, value: np.ndarray, rate: float):
        self.value, self.rate, self.m, self.s, self.t = value, rate, np.zeros_like(value), np.zeros_like(value), 0

    def step(self, grad: np.ndarray) -> None:
        self.t += 1
        self.m += 0.1 * (grad - self.m)
        self.s += 0.01 * (grad * grad - self.s)
        self.value -= self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.s / (1 - 0.99**self.t)) + 1e-8)
