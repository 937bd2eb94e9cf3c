"""Mixing sources to target weights by subset-sum budget fitting.

Sources share a word budget by weight; a target stops at twice its source's size and the excess is reshared.
A source's documents are taken whole as often as the target holds all of them; the rest of its budget is fitted
on the histogram of exact document sizes: a proportional share of every size, larger documents while much is
left, then a bounded-knapsack dynamic programme on the remaining budget. Of the documents of one size, a seeded
order picks those that the fit counts.

Everything stays distributed: one row for each source, one for each source and size; the water level that the
targets share is found by aggregates. The sources' table is broadcast while it has at most FEW rows, the
table of partly taken sizes while it has at most FEW_EDGES, and both are joined by shuffle beyond. Null text has size 0 and is never taken, very long texts count with all their words; null sources
form a source of their own, last in order. Rows equal in id and text are counted as a group, of which as many are
taken as the fit asks for, those first that are least by a hash of all their columns; an empty table gives no rows.
Extra columns are kept; those named like the results raise ValueError.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5  # of all sizes
CAP = 2.0  # times a source's size
SALTS = 1024  # parts in which documents of one size are ordered, so that none holds a large group
WINDOW = 8192  # words of budget left to the dynamic programme
FEW = 10_000  # sources whose table is broadcast
FEW_EDGES = 100_000  # rows of 40 bytes, one for each source and size, whose table is broadcast


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_s, n) of all sources with ``target``; sources take ``weights`` in turn, in order of _s (null last).

    A target is the water level times the weight, but at most ``cap`` times n: the level rises until the sources
    that it doesn't fill hold all the budget that is left.
    """
    spark = sizes.sparkSession
    ordered = sizes.select("_s", "n").orderBy(F.col("_s").asc_nulls_last())
    numbered = spark.createDataFrame(ordered.rdd.zipWithIndex().map(lambda x: (x[0][0], int(x[0][1]), x[1])), "_s string, n long, i long")
    weight = F.get(F.array(*map(F.lit, weights)), F.pmod("i", F.lit(len(weights))).cast("int"))
    rows = cut(numbered.select("_s", "n", weight.alias("w")))
    whole = min(share, cap) * float(rows.agg(F.sum("n")).first()[0] or 0)
    level, filled = 0.0, None
    while True:
        full = F.lit(level) * F.col("w") >= cap * F.col("n")
        r = rows.agg(F.count_if(full), F.sum(F.when(full, cap * F.col("n"))), F.sum(F.when(~full, F.col("w")))).first()
        if r[0] == filled or not r[2]:
            break
        filled, level = r[0], max(0.0, whole - (r[1] or 0.0)) / r[2]
    return rows.select("_s", "n", F.when(full, cap * F.col("n")).otherwise(F.lit(level) * F.col("w")).cast("double").alias("target"))


def fit(lengths: np.ndarray, counts: np.ndarray, budget: float) -> np.ndarray:
    """How many documents of each length to take so that their words come as near under ``budget`` as can be found."""
    order = np.argsort(-lengths, kind="stable")
    size, have = lengths[order].astype(np.int64), counts[order].astype(np.int64)
    goal, whole = int(round(budget)), int((size * have).sum())
    take = np.zeros_like(have)
    if goal <= 0 or whole == 0:
        return take
    if goal >= whole:
        return counts.astype(np.int64).copy()
    if goal > 2 * WINDOW:  # a smaller budget is left to the dynamic programme as a whole
        take = np.minimum(have, (have * (goal / whole)).astype(np.int64))
    left = goal - int((take * size).sum())
    for floor, enough in ((WINDOW, 2 * WINDOW), (0, 4 * WINDOW)):  # the second only where all that is left is larger
        for i, n in enumerate(size):
            if left <= enough:
                break
            k = min(int(have[i] - take[i]), max(0, left - floor) // int(n))
            take[i] += k
            left -= k * int(n)
    if left > 0:
        items, reach = [], [1]  # reach: bit b is set when b words can be made of the items so far
        mask = (1 << min(left, 4 * WINDOW) + 1) - 1
        for i, n in enumerate(size):
            if n > left:
                continue
            rest, k = int(min(have[i] - take[i], left // n)), 1
            while rest:
                k = min(k, rest)
                items.append((i, k))
                reach.append((reach[-1] | reach[-1] << k * int(n)) & mask)
                rest -= k
                k *= 2
        at = reach[-1].bit_length() - 1
        for j in range(len(items) - 1, -1, -1):
            if not reach[j] >> at & 1:
                i, k = items[j]
                take[i] += k
                at -= k * int(size[i])
    out = np.empty_like(take)
    out[order] = take
    return out


def mix(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, seed: int = 7) -> DataFrame:
    """``df`` with size, source_size, target (its source's) and taken: words the mix takes of the row, repeats counted."""
    if clash := {"size", "source_size", "target", "taken"} & {c.lower() for c in df.columns}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    keyed = df.withColumns({
        "size": F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long"),
        "_s": F.col(source).cast("string"),
        "_h": F.xxhash64(F.lit(seed), F.col(key), F.col(text)),
    }).withColumn("_b", F.pmod(F.xxhash64(F.lit(seed + 1), F.col("_h")), F.lit(SALTS)).cast("int"))
    small = cut(keyed.groupBy("_s", "size", "_b", "_h").agg(F.count("*").alias("c")))  # equal rows count once
    goal = targets(small.groupBy("_s").agg(F.sum(F.col("size") * F.col("c")).alias("n")), weights, share, cap)
    base = F.when(F.col("n") > 0, F.floor(F.col("target") / F.col("n"))).otherwise(0)
    plan = cut(goal.select(F.col("_s").alias("_p"), F.col("n").alias("source_size"), "target", base.cast("int").alias("_base")))
    near = F.broadcast if plan.count() <= FEW else (lambda x: x)
    of = F.col("_s").eqNullSafe(F.col("_p"))

    counted = small.where("size > 0").groupBy("_s", "size", "_b").agg(F.sum("c").alias("c"))
    by_size = counted.groupBy("_s", "size").agg(F.sum("c").alias("c"))
    by_size = by_size.join(near(plan.select("_p", (F.col("target") - F.col("_base") * F.col("source_size")).alias("_rest"))), of).drop("_p")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        return pd.DataFrame({"_s": pdf["_s"], "size": pdf["size"], "x": fit(pdf["size"].to_numpy(), pdf["c"].to_numpy(), float(pdf["_rest"].iloc[0]))})

    fitted = by_size.groupBy("_s").applyInPandas(run, "_s string, size long, x long").where("x > 0")
    fitted = fitted.select(F.col("_s").alias("_fs"), F.col("size").alias("_fn"), "x")
    # the part, then the group of equal rows within it, in which the x-th document of a size stands
    upto = F.sum("c").over(Window.partitionBy("_s", "size").orderBy("_b"))
    part = counted.withColumn("upto", upto).join(fitted, F.col("_s").eqNullSafe(F.col("_fs")) & (F.col("size") == F.col("_fn")))
    part = part.where("upto - c < x AND x <= upto").select(F.col("_s").alias("_ps"), F.col("size").alias("_pn"), F.col("_b").alias("_pb"), (F.col("x") - F.col("upto") + F.col("c")).alias("_need"))
    within = F.sum("c").over(Window.partitionBy("_s", "size", "_b").orderBy("_h"))
    placed = small.join(part, F.col("_s").eqNullSafe(F.col("_ps")) & (F.col("size") == F.col("_pn")) & (F.col("_b") == F.col("_pb"))).withColumn("_u", within)
    edge = placed.where("_u - c < _need AND _need <= _u").select(F.col("_s").alias("_es"), F.col("size").alias("_en"), F.col("_b").alias("_eb"), F.col("_h").alias("_eh"), (F.col("_need") - F.col("_u") + F.col("c")).alias("_left"), (F.col("_need") < F.col("_u")).alias("_split"))
    edge = cut(edge)
    small_edge = F.broadcast(edge) if edge.count() <= FEW_EDGES else edge  # at most a row for each source and size

    before = (F.col("_b") < F.col("_eb")) | ((F.col("_b") == F.col("_eb")) & (F.col("_h") <= F.col("_eh")))
    out = keyed.join(near(plan), of).join(small_edge, F.col("_s").eqNullSafe(F.col("_es")) & (F.col("size") == F.col("_en")), "left")
    names = [*df.columns, "size", "source_size", "target", "taken"]
    whole = out.withColumn("taken", F.col("size") * (F.col("_base") + F.when(before, 1).otherwise(0)))
    if edge.where("_split").isEmpty():
        return whole.select(*names)
    # a group of equal rows of which some are taken: one row of each kind, repeated
    halved = F.coalesce(F.col("_split") & (F.col("_b") == F.col("_eb")) & (F.col("_h") == F.col("_eh")), F.lit(False))
    kinds = out.where(halved).withColumn("_k", F.xxhash64(F.to_json(F.struct(*df.columns))))
    kinds = kinds.groupBy("_es", "_en", "_left", "_k").agg(F.count("*").alias("_c"), F.first(F.struct(*df.columns, "size", "source_size", "target", "_base")).alias("_row"))
    first = F.sum("_c").over(Window.partitionBy("_es", "_en").orderBy("_k")) - F.col("_c")
    split = kinds.withColumn("_f", first).withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_c"))))
    split = split.select("_row.*", (F.col("_f") + F.col("_i") <= F.col("_left")).cast("int").alias("_t")).withColumn("taken", F.col("size") * (F.col("_base") + F.col("_t")))
    return whole.where(~halved).select(*names).unionByName(split.select(*names))


def copies(mixed: DataFrame, columns: list[str]) -> DataFrame:
    """The mixed corpus: every row as often as it is taken."""
    times = F.when(F.col("size") > 0, F.col("taken") / F.greatest(F.col("size"), F.lit(1))).otherwise(0).cast("int")
    return mixed.where("taken > 0").withColumn("_n", F.explode(F.sequence(F.lit(1), times))).select(*columns)
