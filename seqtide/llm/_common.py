"""Helpers shared by the text operators: shared-folder tables, word hashing, Arrow plumbing."""

from __future__ import annotations

import ctypes
import gc

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_dir, written

__all__ = ["LONG", "Memo", "Powers", "WordHash", "crc_mod", "documents", "held", "i64", "mix", "release", "shared_dir", "small_batches", "texts", "word_hashes", "written"]

ARROW_ROWS, ARROW_BYTES = 500, 4 << 20
HASH_CACHE = 100_000
#: Longer words are not remembered, so that what a worker or a broadcast holds is bounded in bytes.
LONG = 64
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows and about ARROW_BYTES bytes, so that neither many nor long texts fill a worker.

    Spark reads the settings when it plans, after the operator has returned, so they stay in the session; smaller ones are left.
    """
    for name, most in (("maxRecordsPerBatch", ARROW_ROWS), ("maxBytesPerBatch", ARROW_BYTES)):
        now = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.execution.arrow.{name}"))
        if not 0 < now <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{name}", str(most))


_HELD: list = [None, None]
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)


def held(key, make):
    """What a worker keeps between tasks: one object, that of the operator that ran last."""
    if _HELD[0] != key:
        release()
        _HELD[:] = [key, make()]
    return _HELD[1]


def release() -> None:
    """Forget what an operator before has left in this worker, and give free memory back to the machine."""
    _HELD[:] = [None, None]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


class Memo(dict):
    """Remembers make(key) for keys of late, at most 2 * limit of at most LONG bytes or characters each: once `limit` keys are new, the older ones go. Changes no value."""

    def __init__(self, make, limit: int) -> None:
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        v = self.old.get(key)
        if v is None:
            v = self.make(key)
        if len(key) <= LONG:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[key] = v
        return v


class WordHash(Memo):
    """bytes -> 64-bit hash."""

    def __init__(self) -> None:
        super().__init__(xxhash.xxh3_64_intdigest, HASH_CACHE)


def word_hashes(words: list[bytes], cache: WordHash) -> np.ndarray:
    return np.fromiter(map(cache.__getitem__, words), dtype=np.uint64, count=len(words))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit (the splitmix64 finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown as longer texts come."""

    def __init__(self, base: int) -> None:
        self.base, self.inv = base, pow(base, -1, 1 << 64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def need(self, n: int) -> None:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inv, k, 1 << 64))])

    def prefix(self, h: np.ndarray) -> np.ndarray:
        self.need(len(h) + 1)
        out = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(h * self.up[: len(h)], out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Hash of the words [start, end) of the text of that prefix, the same wherever they stand."""
        return mix((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))


def texts(batch: pa.RecordBatch, column: str = "text") -> list[bytes | None]:
    return batch.column(batch.schema.get_field_index(column)).cast(pa.binary()).to_pylist()


def i64(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def crc_mod(column, k: int):
    """crc32 of the id as text, modulo k."""
    return F.crc32(column.cast("string")) % F.lit(k)
