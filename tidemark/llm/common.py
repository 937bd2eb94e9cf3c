"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = r"[^\x20\x09-\x0D]+"  # the contract's word: a run without ASCII white space


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only in local mode without that setting (tests).

    On a cluster without ``spark.checkpoint.dir`` this raises RuntimeError.
    """
    where = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="tidemark-ckpt-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared checkpoint folder: short lineage that survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def fold(column: str, m: int):
    """crc32 of the id as text, modulo ``m``; null ids count as fold of the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % F.lit(m)


_kept: dict[tuple, object] = {}  # at most one object that a Python worker keeps from task to task
_asked: list[tuple] = []  # its key, where the present task has asked for it


def keep_one(key: tuple, make: Callable[[], object]):
    """The object of ``key``, made if the worker doesn't hold it; it takes the place of any other."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = make()
    _asked.append(key)
    return _kept[key]


def give_back() -> None:
    """Returns what this process has freed to the system: Python workers live through many tasks, and each would keep its largest batch."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim is not None:
        trim(0)


def fit_apart(rows: DataFrame, fit: Callable, spare: Callable[[], object]):
    """What ``fit`` makes of ``rows`` (a bounded sample, as one pandas frame), fitted in one task; ``spare()`` of no rows.

    The driver sees the fitted model alone, never the sample, and a lost executor costs one retry.
    """
    import pandas as pd

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"model": [pickle.dumps(fit(pdf), protocol=5)]})
        give_back()
        return out

    found = rows.withColumn("_one", F.lit(0)).groupBy("_one").applyInPandas(run, "model binary").first()
    return spare() if found is None else pickle.loads(bytes(found["model"]))


def add_columns(df: DataFrame, inputs: list[str], made: dict[str, str], start: Callable[[], Callable], keep: list[str] | None = None, rows: int = 256) -> DataFrame:
    """``df`` (its columns in ``keep``, or all) with the columns ``made`` (name: type) that Python makes of ``inputs``.

    ``start()`` runs once in each task and returns a function from lists of input values to lists of results.
    Arrow batches are worked through in slices of ``rows``, so a worker holds few texts as Python objects.
    A name in ``made`` that is there already raises ValueError.
    """
    import pyarrow as pa
    from pyspark.sql.pandas.types import to_arrow_type

    keep = list(df.columns) if keep is None else list(keep)
    if clash := {c.lower() for c in keep} & {c.lower() for c in made}:
        raise ValueError(f"columns {sorted(clash)} are there already")
    new = T._parse_datatype_string(", ".join(f"`{n}` {t}" for n, t in made.items()))
    kinds = [to_arrow_type(f.dataType) for f in new.fields]
    fields = [df.schema[c] for c in keep] + new.fields

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from tidemark.llm.common import _asked, _kept, give_back  # the worker's own, not copies sent with this function

        _asked.clear()
        make = start()
        if not _asked:  # what another operator kept is of no use here
            _kept.clear()
        for batch in batches:
            part = out = None
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                out = make(*[part.column(f"_in{i}").to_pylist() for i in range(len(inputs))])
                yield pa.RecordBatch.from_arrays([part.column(f"_keep{i}") for i in range(len(keep))] + [pa.array(v, type=k) for v, k in zip(out, kinds, strict=True)], names=names)
            del batch, part, out
            give_back()

    names = [f.name for f in fields]
    sent = df.select(*[F.col(c).alias(f"_keep{i}") for i, c in enumerate(keep)], *[F.col(c).alias(f"_in{i}") for i, c in enumerate(inputs)])
    return sent.mapInArrow(run, T.StructType(fields))
