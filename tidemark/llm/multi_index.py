"""Approximate nearest neighbours by inner product: an inverted multi-index.

The two halves of the vectors are quantised separately (k-means on at most SAMPLE rows); a pair of centroids is
a cell, and every row is filed under its cell. A query walks the pairs by falling summed inner product with its
two halves, best first from a heap, until the share of near neighbours expected in the walked cells reaches
1 - MISS: a cell's expectation is its number of rows times the normal tail of its centroids' residual spread
beyond the query's estimated k-th score. The entries of the walked cells are reranked by the exact inner product
in double precision.

Of equal vectors only the k + 1 smallest ids are filed, which is exact for the top k, and equal queries are searched
once. Cells lie in order of nearness (a Morton curve over both halves' centroids along their first principal axis)
and are packed in this order into blocks of at most BLOCK_BYTES; a larger cell gets several. Queries travel to the
blocks that they walk, in parts of about ASKED queries, so no task holds more than a block and a part. A query's
first block gives it a score that its k nearest reach; from its other blocks only rows that reach it come back.
With N rows, Q queries and a walked share f, N Q f (1 / ASKED + 1 / rows of a block) rows are shuffled.

Vectors that are null, empty, all zero, of another length than most, or hold null or non-finite components take
no part, neither do null ids. Rows equal in id and vector count once; an id with several vectors is a query for each
of them, and its other rows are candidates. Fewer than k candidates are all returned; ties go to the smaller id;
an empty table gives no rows; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import heapq
from math import erf

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import add_columns, cut, give_back

SAMPLE = 20_000
BLOCK_BYTES = 16 << 20  # vectors of a block
BLOCKS = 64  # as many blocks at least, if they hold SMALL rows
SMALL = 2_048
ASKED = 32_768  # queries of a part
MISS = 0.04
LEAST = 64  # entries that every query sees at least, if there are so many
_tail_x = np.linspace(-8, 8, 1601)
_tail_y = np.array([0.5 * (1 - erf(x / 2**0.5)) for x in _tail_x])


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 3) -> np.ndarray:
    """Lloyd's centroids of the rows of x."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        for d in range(x.shape[1]):
            s = np.bincount(near, weights=x[:, d], minlength=len(c))
            c[:, d] = np.where(n > 0, s / np.maximum(n, 1), c[:, d])
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(x[i : i + 4096] @ c.T * -2 + (c * c).sum(1)).argmin(1) for i in range(0, max(1, len(x)), 4096)])


class MultiIndex:
    """Centroids of both halves, their residual spread, and the number of rows in each cell."""

    def __init__(self, sample: np.ndarray, rows: int):
        self.half, self.rows, self.sample = max(1, sample.shape[1] // 2), rows, sample
        k = int(np.clip((rows / 48) ** 0.5, 2, 256))
        self.c1, self.c2 = kmeans(sample[:, : self.half], k), kmeans(sample[:, self.half :], k)
        self.v1, self.v2 = (self._spread(x, c) for x, c in ((sample[:, : self.half], self.c1), (sample[:, self.half :], self.c2)))
        self.counts = np.zeros((len(self.c1), len(self.c2)))

    @staticmethod
    def _spread(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Residual variance per dimension around each centroid."""
        near = nearest(x, c)
        n = np.bincount(near, minlength=len(c))
        s = np.bincount(near, weights=((x - c[near]) ** 2).sum(1) / max(1, x.shape[1]), minlength=len(c))
        return (s + s.sum() / len(x)) / (n + 1)

    def cells(self, x: np.ndarray) -> np.ndarray:
        return nearest(x[:, : self.half], self.c1) * len(self.c2) + nearest(x[:, self.half :], self.c2)

    def order(self) -> np.ndarray:
        """All cells, those with near centroids near each other."""
        place = np.zeros((len(self.c1), len(self.c2)), np.int64)
        for shift, c in ((1, self.c1), (0, self.c2)):
            axis = np.linalg.svd(c - c.mean(0), full_matrices=False)[2][:1] if c.shape[1] else np.zeros((1, 0))
            at = np.argsort(np.argsort((c @ axis.T).sum(1), kind="stable"), kind="stable")
            spread = sum((at >> i & 1) << 2 * i + shift for i in range(16))
            place += spread[:, None] if shift else spread[None, :]
        return np.argsort(place.ravel(), kind="stable")

    def walk(self, q: np.ndarray, k: int) -> list[int]:
        """The cells that a query visits, best first; its own vector, where it is in the sample, does not count as near."""
        a, b = self.c1 @ q[: self.half], self.c2 @ q[self.half :]
        s = self.sample @ q
        own = [i for i in np.flatnonzero(np.abs(s - q @ q) <= 1e-9 * (1 + abs(q @ q))) if (self.sample[i] == q).all()]
        s = np.sort(np.delete(s, own[:1]))
        rank = max(1, round(k * len(self.sample) / max(1, self.rows)))
        least = s[-min(rank, len(s))] if len(s) else -np.inf
        sigma = np.sqrt((q[: self.half] ** 2).sum() * self.v1[:, None] + (q[self.half :] ** 2).sum() * self.v2[None, :]) + 1e-12
        expected = self.counts * np.interp((least - a[:, None] - b[None, :]) / sigma, _tail_x, _tail_y)
        goal, entries = (1 - MISS) * expected.sum(), min(max(LEAST, k + 1), self.rows)
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        heap, seen, out, found, held = [(-(a[oa[0]] + b[ob[0]]), 0, 0)], {(0, 0)}, [], 0.0, 0.0
        while heap and (found < goal or held < entries):
            _, i, j = heapq.heappop(heap)
            x, y = oa[i], ob[j]
            if self.counts[x, y]:
                out.append(int(x) * len(b) + int(y))
                found += expected[x, y]
                held += self.counts[x, y]
            for i, j in ((i + 1, j), (i, j + 1)):
                if i < len(a) and j < len(b) and (i, j) not in seen:
                    seen.add((i, j))
                    heapq.heappush(heap, (-(a[oa[i]] + b[ob[j]]), i, j))
        return out


def rerank(q: np.ndarray, least: np.ndarray, probes: list[np.ndarray], vid: np.ndarray, v: np.ndarray, cell: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the query, row id, score) of each query's k best rows in its probed cells that score ``least``, ties to the smaller id."""
    order = np.lexsort((vid, cell))
    vid, v, cell = vid[order], v[order], cell[order]
    cells, begin = np.unique(cell, return_index=True)
    begin = np.append(begin, len(cell))
    out = []
    for at in range(0, len(q), 256):
        x, part = q[at : at + 256], probes[at : at + 256]
        owner = np.repeat(np.arange(len(x)), [len(p) for p in part])
        probe = np.concatenate(part)
        by = np.argsort(probe, kind="stable")
        owner, probe = owner[by], probe[by]
        s = np.full((len(x), len(v)), -np.inf)
        for c, i, j in zip(cells, begin[:-1], begin[1:], strict=True):
            rows = owner[np.searchsorted(probe, c) : np.searchsorted(probe, c, "right")]
            if len(rows):
                s[rows, i:j] = x[rows] @ v[i:j].T
        edge = np.maximum(np.partition(s, max(0, len(v) - k), axis=1)[:, max(0, len(v) - k)], least[at : at + 256])
        r, c = np.nonzero((s >= edge[:, None] - 1e-9 * (1 + np.abs(np.where(np.isfinite(edge), edge, 0)[:, None]))) & (s > -np.inf))
        exact = (x[r] * v[c]).sum(1)  # the same sum for equal vectors wherever they stand
        by = np.lexsort((vid[c], -exact, r))
        r, c, exact = r[by], c[by], exact[by]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        out.append((r[top] + at, vid[c[top]], exact[top]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _as_rows(packed) -> np.ndarray:
    return np.frombuffer(b"".join(packed)).reshape(len(packed), -1)


def search(rows: DataFrame, queries, k: int = 20, key: str = "vec_id", vector: str = "embedding", sample: int = SAMPLE) -> DataFrame:
    """For each row that the condition ``queries`` holds for: its k nearest other rows.

    query_id long, rank int from 1, ``key`` long, score double (the inner product).
    """
    spark = rows.sparkSession
    x = F.col(vector).cast("array<double>")
    ok = F.col(key).isNotNull() & ~F.exists(x, lambda e: e.isNull() | F.isnan(e) | (F.abs(e) == float("inf"))) & F.exists(x, lambda e: e != 0)
    found = rows.where(ok).select(F.col(key).cast("long").alias("id"), x.alias("x"), queries.alias("is_query"))
    sizes = {r["d"]: r["n"] for r in found.groupBy(F.size("x").alias("d")).agg(F.count("*").alias("n")).collect()}  # one row for each length
    if not sizes:
        return spark.createDataFrame([], f"query_id long, rank int, {key} long, score double")
    dim = max(sizes, key=lambda d: (sizes[d], d))
    found, n = found.where(F.size("x") == dim), sizes[dim]
    if not found.groupBy("id").count().where("count > 1").isEmpty():
        found = found.groupBy("id", "x").agg(F.max("is_query").alias("is_query"))
    pack = lambda xs: [[r.tobytes() for r in np.array(xs)]]
    share = min(1_000_000, int(1_000_000 * sample / n) + 1)
    drawn = found.where(F.pmod(F.xxhash64(F.lit(17), "id"), F.lit(1_000_000)) < share)  # about ``sample`` rows
    drawn = found.limit(sample) if drawn.isEmpty() else drawn
    taken = sorted((r["id"], r["v"]) for r in add_columns(drawn, ["x"], {"v": "binary"}, lambda: pack, ["id"]).collect())
    index = MultiIndex(_as_rows([v for _, v in taken]), n)
    coarse = spark.sparkContext.broadcast(index)  # SAMPLE rows and the centroids

    def file(xs):
        m = np.array(xs)
        return [[r.tobytes() for r in m], coarse.value.cells(m).tolist()]

    least = F.row_number().over(Window.partitionBy("x").orderBy("id"))
    few = found.select("id", "x").withColumn("_r", least).where(F.col("_r") <= k + 1).select("id", "x", F.xxhash64("x").alias("o"))
    filed = cut(add_columns(few, ["x"], {"v": "binary", "cell": "int"}, lambda: file, ["id", "o"]))
    held = {r["cell"]: r["n"] for r in filed.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # at most 256 * 256 cells
    room_of = int(np.clip(sum(held.values()) // BLOCKS, min(SMALL, BLOCK_BYTES // (8 * dim) + 1), BLOCK_BYTES // (8 * dim) + 1))
    first: dict[int, tuple[int, int]] = {}
    block, room = -1, 0
    for c in index.order().tolist():
        if c not in held:
            continue
        index.counts[divmod(c, len(index.c2))] = held[c]
        if held[c] > room_of:
            first[c] = (block + 1, -(-held[c] // room_of))
            block, room = block + first[c][1], 0
            continue
        if held[c] > room:
            block, room = block + 1, room_of
        first[c] = (block, 1)
        room -= held[c]
    directory = F.broadcast(spark.createDataFrame([(c, *f) for c, f in first.items()], "cell int, _first int, _parts int"))
    blocked = filed.join(directory, "cell").select("id", "o", "v", "cell", (F.col("_first") + F.pmod(F.xxhash64("id"), F.col("_parts")).cast("int")).alias("block"))
    walked = spark.sparkContext.broadcast((index, first))

    def walk(xs):
        idx, places = walked.value
        out = []
        for q in np.array(xs):
            by_block: dict[int, list[int]] = {}
            for c in idx.walk(q, k):
                start, parts = places[c]
                for b in range(start, start + parts):
                    by_block.setdefault(b, []).append(c)
            out.append([(b, np.array(cs, dtype=np.int32).tobytes()) for b, cs in by_block.items()])
        return [pack(xs)[0], out]

    hashed = found.where("is_query").select("id", "x", F.xxhash64("x").alias("h"), F.xxhash64(F.lit(1), "x").alias("g"))
    # a walk is long for its few bytes, so it is not left to partitions sized by bytes
    asked = hashed.select("h", "g", "x").dropDuplicates(["h", "g"]).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    asked = add_columns(asked, ["x"], {"v": "binary", "w": "array<struct<b: int, cells: binary>>"}, lambda: walk, ["h", "g"])
    asked = cut(asked.select("h", "g", "v", F.posexplode("w").alias("turn", "w")).select("h", "g", "v", "turn", F.col("w.b").alias("block"), "w.cells"))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        right = right.sort_values(["id", "o"])
        if not len(left) or not len(right):
            return pd.DataFrame({"h": [], "g": [], "id": [], "o": [], "score": []})
        probes = [np.frombuffer(c, dtype=np.int32) for c in left["cells"]]
        at, near, exact = rerank(_as_rows(left["v"]), left["least"].to_numpy(), probes, np.arange(len(right)), _as_rows(right["v"]), right["cell"].to_numpy(), k + 1)
        give_back()
        return pd.DataFrame({"h": left["h"].to_numpy()[at], "g": left["g"].to_numpy()[at], "id": right["id"].to_numpy()[near], "o": right["o"].to_numpy()[near], "score": exact})

    def scored(part: DataFrame) -> DataFrame:
        """The best rows of the queries (h, g, v, least, block, cells) in one block each."""
        parts = part.groupBy("block").agg(F.ceil(F.count("*") / F.lit(ASKED)).cast("int").alias("parts"))
        left = part.join(parts, "block").select("h", "g", "v", "least", "cells", "block", F.pmod("g", F.col("parts")).cast("int").alias("part"))
        right = blocked.join(parts, "block").select("id", "o", "v", "cell", "block", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        return left.groupBy("block", "part").cogroup(right.groupBy("block", "part")).applyInPandas(score, "h long, g long, id long, o long, score double")

    first_found = cut(scored(asked.where("turn = 0").withColumn("least", F.lit(-np.inf))))
    reached = first_found.groupBy("h", "g").agg(F.when(F.count("*") > k, F.min("score")).otherwise(F.lit(-np.inf)).alias("least"))
    later = asked.where("turn > 0").join(reached, ["h", "g"], "left").withColumn("least", F.coalesce("least", F.lit(-np.inf)))
    found_all = first_found.unionByName(scored(later))
    best = F.row_number().over(Window.partitionBy("h", "g").orderBy(F.desc("score"), "id", "o"))
    best = found_all.withColumn("_r", best).where(F.col("_r") <= k + 1).groupBy("h", "g").agg(F.sort_array(F.collect_list(F.struct("_r", "id", "o", "score"))).alias("near"))
    others = F.slice(F.filter("near", lambda t: (t.id != F.col("query_id")) | (t.o != F.col("h"))), 1, k)
    out = hashed.select(F.col("id").alias("query_id"), "h", "g").join(best, ["h", "g"]).select("query_id", F.posexplode(others).alias("rank", "t"))
    return out.select("query_id", (F.col("rank") + 1).alias("rank"), F.col("t.id").alias(key), "t.score")
