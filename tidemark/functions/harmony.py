"""Harmonic measures of chroma, spectrum and key as array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scalar import NOTES

#: Consonance weight of each interval in semitones; fixed values.
INTERVAL_WEIGHT = {0: 1.0, 1: 0.30, 2: 0.50, 3: 0.75, 4: 0.80, 5: 0.90, 6: 0.25, 7: 0.95, 8: 0.65, 9: 0.70, 10: 0.50, 11: 0.40}
#: Krumhansl-Kessler key profiles; fixed values.
MAJOR = [6.35, 2.23, 3.48, 2.33, 4.38, 4.09, 2.52, 5.19, 2.39, 3.66, 2.29, 2.88]
MINOR = [6.33, 2.68, 3.52, 5.38, 2.60, 3.53, 2.54, 4.75, 3.98, 2.69, 3.34, 3.17]


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(total(F.transform(a, lambda x: x * x)))


def temperament(chroma: Column) -> Column:
    """max(0, 1 - entropy / log2 12) of the normalised chroma; 0 below 0.001 of energy."""
    p = F.transform(chroma, lambda x: x / total(chroma))
    h = -total(F.transform(p, lambda x: x * F.log2(x + 1e-10)))
    return F.when(total(chroma) < 0.001, 0.0).otherwise(F.greatest(F.lit(0.0), 1 - h / F.log2(F.lit(12.0))))


def series(chroma: Column) -> Column:
    """Energy-weighted interval consonance of the pitch classes above a tenth of the largest; one alone is 1, none 0."""
    peak = F.array_max(chroma)
    table = F.create_map(*[F.lit(x) for kv in INTERVAL_WEIGHT.items() for x in kv])
    active = F.filter(F.transform(chroma, lambda x, i: F.struct(i.alias("pc"), x.alias("e"))), lambda s: s.e > 0.1 * peak)
    pairs = F.flatten(
        F.transform(
            active,
            lambda a: F.transform(F.filter(active, lambda b: b.pc > a.pc), lambda b: F.struct((a.e * b.e).alias("w"), F.element_at(table, b.pc - a.pc).alias("c"))),
        )
    )
    weight = total(F.transform(pairs, lambda p: p.w))
    mean = total(F.transform(pairs, lambda p: p.w * p.c)) / F.nullif(weight, F.lit(0.0))
    return F.when(total(chroma) < 0.001, 0.0).when(F.size(active) == 0, 0.0).when(F.size(active) == 1, 1.0).otherwise(F.coalesce(mean, F.lit(0.0)))


def _profiles() -> list[tuple[str, str, int, list[float]]]:
    """(name, mode, root, profile) in order C major, C minor, C# major, ..."""
    turned = lambda p, k: p[-k:] + p[:-k] if k else p
    return [x for k in range(12) for x in ((NOTES[k], "major", k, turned(MAJOR, k)), (NOTES[k], "minor", k, turned(MINOR, k)))]


def _bound(value: Column, then) -> Column:
    """``then(value)`` with the value computed once, however often ``then`` names it."""
    return F.transform(F.array(value), then)[0]


def detect_key(chroma: Column) -> Column:
    """struct<key, mode, root, confidence>: the best correlated of 24 profiles, the first of equals; ``?`` for a flat or silent chroma."""
    rows = []
    for i, (key, mode, root, profile) in enumerate(_profiles()):
        centre = [x - sum(profile) / 12 for x in profile]
        size = sum(x * x for x in centre) ** 0.5
        rows.append(F.struct(F.lit(-i).alias("i"), F.lit(key).alias("key"), F.lit(mode).alias("mode"), F.lit(root).alias("root"), F.array(*map(F.lit, centre)).alias("c"), F.lit(size).alias("size")))
    profiles = F.array(*rows)
    none = F.struct(F.lit("?").alias("key"), F.lit("?").alias("mode"), F.lit(-1).alias("root"), F.lit(0.0).alias("confidence"))

    def best(b: Column) -> Column:
        scored = F.transform(profiles, lambda p: F.struct(F.round(dot(b.c, p.c) / (b.spread * p.size), 10).alias("r"), p.i, p.key, p.mode, p.root))
        found = _bound(F.array_max(scored), lambda w: F.struct(w.key.alias("key"), w["mode"].alias("mode"), w.root.alias("root"), F.round(F.greatest(F.lit(0.0), w.r), 4).alias("confidence")))
        return F.when((b.sum < 0.001) | (b.spread < 1e-12), none).otherwise(found)

    centred = lambda s: F.struct(s.alias("sum"), F.transform(chroma, lambda x: x - s / 12).alias("c"))
    spread = lambda b: F.struct(b.sum.alias("sum"), b.c.alias("c"), norm(b.c).alias("spread"))
    return _bound(_bound(_bound(total(chroma), centred), spread), best)


def cosine_distance(a: Column, b: Column) -> Column:
    """max(0, 1 - cosine); 0 when either norm is at most 1e-6."""
    return F.when((norm(a) > 1e-6) & (norm(b) > 1e-6), F.greatest(F.lit(0.0), 1 - dot(a, b) / (norm(a) * norm(b)))).otherwise(0.0)


def tonnetz(chroma: Column) -> Column:
    """The six tonal centroid coordinates of an L1-normed chroma (fifths, minor thirds, major thirds)."""
    import math

    rows = []
    for radius, step in ((1.0, 7 * math.pi / 6), (1.0, 3 * math.pi / 2), (0.5, 2 * math.pi / 3)):
        rows += [[radius * math.sin(step * k) for k in range(12)], [radius * math.cos(step * k) for k in range(12)]]
    s = F.greatest(total(chroma), F.lit(1e-12))
    return F.array(*[dot(chroma, F.array(*[F.lit(round(x, 12)) for x in row])) / s for row in rows])
