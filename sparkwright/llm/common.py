"""Helpers shared by the operators: row keys, written tables, per-process tables, tokens."""

from __future__ import annotations

import sys
import types
import zlib
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def ship(module: str) -> None:
    """Send the functions of ``module`` to the executors with the task, so that they need not have the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


ship(__name__)


def _store() -> dict:
    return sys.modules.setdefault("_sparkwright_llm_tables", types.ModuleType("_sparkwright_llm_tables")).__dict__


def release(*families: str) -> None:
    """Give up what an earlier operator's tasks have left in this Python process, but for these families of tables.

    Spark hands a worker from one stage to the next, so without this the tables of all stages of a pipeline would add up.
    """
    store = _store()
    old = [k for k, v in store.items() if k.startswith("table ") and v[0] not in families]
    if old:
        for k in old:
            del store[k]
        trim()


def trim() -> None:
    """Give the memory that this Python process has freed back to the system."""
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)  # freed memory goes back to the system where the C library can do that
    except (AttributeError, OSError):
        pass


def trimmed(task: Callable, *given):
    """``task(*given)``; then the process is trimmed. Spark keeps idle workers and takes them in turn, so what each one has
    freed but kept would add up on an executor."""
    found = task(*given)
    trim()
    return found


def tidy(task: Callable) -> Callable:
    """A function for ``mapInArrow`` that trims the process after ``task``, as ``trimmed`` does."""

    def run(batches):
        yield from task(batches)
        trim()

    return run


def per_process(key: str, build: Callable):
    """``build()``, made once in a Python process and kept there for later tasks of the same worker.

    A key's part before its first colon is its family: tables of one family stay together, those of others go.
    """
    store, family, key = _store(), key.split(":")[0], f"table {key}"
    if key not in store:
        release(family)
        store[key] = (family, build())
    return store[key][1]


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """Key of a row by id and content: rows that repeat an id with another text stay apart, a null id is a value.

    128 bits as a string of two hashes; rows that agree in id and text share the key and get the same result.
    """
    body = text_or_empty(text_col)
    mark = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return F.concat_ws(":", mark, F.hex(F.xxhash64(body)), F.hex(F.xxhash64(F.lit(1), body, F.length(body))))


def written(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write ``df`` under the cluster's shared folder and read it back.

    The folder is the one that spark.checkpoint.dir names, so the rows survive the loss of any executor.
    """
    from sparkwright.session import fresh_location  # for the driver alone: this module goes to workers without the package

    spark = df.sparkSession
    where = fresh_location(spark, label)
    df.write.parquet(where)
    return spark.read.schema(df.schema).parquet(where)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


class Remembered(dict):
    """Results of ``make`` for short keys seen before; emptied when it holds ``most``, so memory is bounded."""

    def __init__(self, make, most: int):
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key: str):
        value = self.make(key)
        if len(key) <= 64:
            if len(self) >= self.most:
                self.clear()
            self[key] = value
        return value


class WordHashes(dict):
    """64-bit hashes of words (bytes), kept for words seen before; emptied when it holds ``most`` of them."""

    def __init__(self, most: int = 120_000):
        super().__init__()
        self.most = most

    def __missing__(self, word):
        import xxhash

        if len(self) >= self.most:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def mix64(x):
    """A bijective 64-bit finaliser over a numpy uint64 array."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def crc_fold(doc_id) -> int:
    """crc32 of the id as text, modulo 10."""
    return zlib.crc32(str(doc_id).encode()) % 10
