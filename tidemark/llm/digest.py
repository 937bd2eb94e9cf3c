"""Document fingerprints: quartile bucket digests of hashed byte triplets.

Triplets are three bytes of the UTF-8 text at fixed distances, slid over the whole text; each is hashed into
one of BUCKETS counters. The digest holds a logarithmic length code and, for every bucket, the quartile of its
count among the digest's buckets (two bits). Two digests are compared by the summed quartile distances and the
length codes' distance, bounded and turned into a likeness from 0 to 1.

Null text counts as the empty text, whose digest is all zero; equal texts have equal digests; texts shorter
than a triplet's span count what fits, very long ones are read whole. fingerprint_pairs() orders rows by key (null
first) and, of equal keys, by a hash of the text; repeated rows give a row each; an empty table gives no rows; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, cut, give_back

BUCKETS = 512
#: Distances of a triplet's second and third byte from its first; wide ones depend less on the language's own letter groups.
SPANS = ((1, 2), (2, 5), (3, 9), (5, 13), (7, 17), (11, 23))
LOWEST = -(1 << 63)
ROWS = 8_192  # of a range of keys
FEW = 10_000  # ranges whose successors are broadcast


def _tables() -> np.ndarray:
    """Hash tables [span, place, byte] from a fixed rule."""
    x = np.arange(len(SPANS) * 3 * 256, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(by)
    return ((x ^ (x >> np.uint64(31))) % np.uint64(BUCKETS)).astype(np.uint16).reshape(len(SPANS), 3, 256)


_TABLES = _tables()


def codes(text: str) -> np.ndarray:
    """Quartile codes of the buckets (uint8, 0 to 3), after the length code in place 0."""
    b = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    count = np.zeros(BUCKETS, dtype=np.int64)
    for (near, far), (t0, t1, t2) in zip(SPANS, _TABLES, strict=True):
        n = len(b) - far
        if n > 0:
            count += np.bincount(t0[b[:n]] ^ t1[b[near : near + n]] ^ t2[b[far:]], minlength=BUCKETS)
    out = np.empty(BUCKETS + 1, dtype=np.uint8)
    out[0] = min(255, int(round(8 * np.log2(1 + len(b)))))
    ordered = np.partition(count, (BUCKETS // 4, BUCKETS // 2, 3 * BUCKETS // 4))
    q1, q2, q3 = ordered[BUCKETS // 4], ordered[BUCKETS // 2], ordered[3 * BUCKETS // 4]
    out[1:] = (count > q1).astype(np.uint8) + (count > q2) + (count > q3)
    return out


def packed(code: np.ndarray) -> bytes:
    """The digest of codes() as bytes: the length code, then four quartiles a byte."""
    q = code[1:].reshape(-1, 4)
    return bytes([code[0]]) + (q[:, 0] << 6 | q[:, 1] << 4 | q[:, 2] << 2 | q[:, 3]).astype(np.uint8).tobytes()


def digest(code: np.ndarray) -> str:
    """The digest of codes() in lowercase hex."""
    return packed(code).hex()


def fingerprint(text: str | None) -> str:
    return digest(codes(text or ""))


def parse(fp: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(fp), dtype=np.uint8)
    q = raw[1:, None] >> np.array([6, 4, 2, 0], dtype=np.uint8) & 3
    return np.concatenate([raw[:1], q.ravel()])


#: Mean distance of two independent codes is 1.25; at that sum and beyond the likeness is 0.
BOUND = 1.25 * BUCKETS


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """1 for equal codes, falling with the bounded difference score."""
    d = a.astype(np.int16) - b
    diff = float(np.abs(d[1:]).sum()) + max(0, abs(int(d[0])) - 4)
    return 1.0 - min(diff, BOUND) / BOUND


def _compared(text: str, code: np.ndarray, after: str, code_after: np.ndarray) -> tuple:
    """The columns of fingerprint_pairs() for a text and the one after it."""
    part = len(text) // 4
    edited = text[: len(text) - part] + after[:part]
    e = codes(edited)
    return len(text), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).digest(), packed(code), packed(e), likeness(code, e), likeness(code, code_after)


MADE = {"n_chars": "long", "edited_sha256": "binary", "fingerprint": "binary", "edited_fingerprint": "binary", "near_edited": "double", "near_next": "double"}
DONE, LAST, HEAD = 0, 1, 2


def fingerprint_pairs(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For every row: its digest, its edited text's (the last quarter replaced from the next row), and both likenesses.

    Rows are dealt by ranges of the key, ROWS each, and walked in order, each text digested once. Only a range's first
    and last row meet another range: they are kept with their texts, and the last is joined with the next range's first.
    The driver sees the numbers of the ranges that hold rows.
    """
    spark = df.sparkSession
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // ROWS))
    rows = df.select(F.col(key).alias("_key"), F.coalesce(F.col(key).cast("long"), F.lit(LOWEST)).alias("_k"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    order = ["_k", "_h", "_m"]  # the last, so that a large group of equal rows is dealt to several ranges
    rows = rows.withColumns({"_h": F.xxhash64("_text"), "_m": F.monotonically_increasing_id()})
    rows = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).select("_key", "_text")

    def walk(batches):
        at, waiting = TaskContext.get().partitionId(), None
        for pdf in batches:
            for i in range(0, len(pdf), 256):
                out = []
                for k, t in zip(pdf["_key"].iloc[i : i + 256], pdf["_text"].iloc[i : i + 256], strict=True):
                    code = codes(t)
                    if waiting is None:
                        out.append((k, *[None] * 6, at, HEAD, t))
                    else:
                        out.append((waiting[0], *_compared(*waiting[1:], t, code), at, DONE, None))
                    waiting = (k, t, code)
                yield pd.DataFrame(out, columns=names)
            give_back()
        if waiting is not None:
            yield pd.DataFrame([(waiting[0], *[None] * 6, at, LAST, waiting[1])], columns=names)

    names = ["_key", *MADE, "_part", "_kind", "_text"]
    shape = ", ".join(f"{n} {t}" for n, t in ({"_key": dict(rows.dtypes)["_key"]} | MADE | {"_part": "int", "_kind": "int", "_text": "string"}).items())
    walked = cut(rows.mapInPandas(walk, shape))
    shown = [F.lower(F.hex(n)).alias(n) if t == "binary" else n for n, t in MADE.items()]
    heads = walked.where(F.col("_kind") == HEAD).select(F.col("_part").alias("_next"), F.col("_text").alias("_after"))
    held = sorted(r["_next"] for r in heads.select("_next").collect())
    if not held:
        return walked.select(F.col("_key").alias(key), *shown)
    follows = spark.createDataFrame(list(zip(held, held[1:] + held[:1], strict=True)), "_part int, _next int")
    follows = F.broadcast(follows) if len(held) <= FEW else follows
    last = walked.where(F.col("_kind") == LAST).select("_key", "_part", "_text").join(follows, "_part").join(heads, "_next")

    def finish(texts, afters):
        out = [_compared(t, codes(t), n, codes(n)) for t, n in zip(texts, afters, strict=True)]
        return list(zip(*out, strict=True)) if out else [[]] * len(MADE)

    closed = add_columns(last, ["_text", "_after"], MADE, lambda: finish, ["_key"])
    return walked.where(F.col("_kind") == DONE).select("_key", *MADE).unionByName(closed).select(F.col("_key").alias(key), *shown)
