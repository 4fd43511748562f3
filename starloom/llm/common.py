"""Helpers shared by the operators of this package."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from starloom.session import scratch_path

SLICE_BYTES = 4 << 20
ROW_GROUP = 32 << 20  # a writer holds one in memory
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only; elsewhere the allocator decides


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write once to the shared folder and read back: cuts lineage, fixes the rows, survives executors.

    What the driver's Python no longer needs goes back to the system first.
    """
    give_back()
    path = scratch_path(df.sparkSession, name)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path, compression=compression)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def fold(column: str, of: int) -> Column:
    """crc32 of the id written as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % of


def text_key() -> list[Column]:
    """Two columns that stand for a text: equal texts, equal keys."""
    return [F.xxhash64(text_of()).alias("k1"), F.crc32(text_of().cast("binary")).alias("k2")]


def give_back() -> None:
    """Return freed memory to the system: a worker lives on for other tasks and stages."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def small_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches so that the texts of a slice stay near ``limit`` bytes; a longer text is alone.

    Freed memory goes back to the system before each batch and at the end.
    """
    for batch in batches:
        give_back()
        size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        start, held = 0, 0
        for i, n in enumerate(size):
            if held and held + n > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(n)
        if start < batch.num_rows:
            yield batch.slice(start)
        del batch
    give_back()


def sliced(texts: pd.Series, work: Callable[[list], Any]) -> list:
    """Results of ``work`` on runs of texts of about two million characters each."""
    give_back()
    size = texts.fillna("").str.len().cumsum() // (1 << 21)
    return [work([t if isinstance(t, str) else None for t in part]) for _, part in texts.groupby(size.to_numpy(), sort=False)]


def encode_words(docs: list[list]) -> tuple[list, np.ndarray, np.ndarray]:
    """Distinct words in order of appearance, the code of every token, tokens per document."""
    known: dict = {}
    put = known.setdefault
    codes = np.fromiter((put(w, len(known)) for words in docs for w in words), dtype=np.int32)
    return list(known), codes, np.fromiter((len(x) for x in docs), dtype=np.int64, count=len(docs))


def sums_by(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each run of rows; an empty run is zero. ``values``: (rows,) or (rows, k)."""
    total = np.concatenate([np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]


FILTER_BITS = 26  # a bit table of 8 MB, whatever it is made of


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two places of a hash in a bit table."""
    return (h >> np.uint64(64 - FILTER_BITS)).astype(np.int64), (h & np.uint64((1 << FILTER_BITS) - 1)).astype(np.int64)


def bit_table(hashes: DataFrame) -> np.ndarray:
    """Bits of all hashes in ``seed``; merged in Spark as 64-bit words, so at most 2^20 of them come to the driver."""
    low = F.col("seed").bitwiseAND(F.lit((1 << FILTER_BITS) - 1).cast("long"))
    place = F.explode(F.array(F.shiftrightunsigned("seed", 64 - FILTER_BITS), low)).alias("p")
    words = hashes.select(place).groupBy(F.shiftright("p", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 64 AS int))")).alias("bits")).toPandas()
    out = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out.view(np.uint64)


def in_table(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in a bit table; those that are in it always."""
    held = lambda p: (table[p >> 6] >> (p & 63).astype(np.uint64)) & np.uint64(1) == 1
    a, b = _places(hashes)
    found = held(a)
    some = np.flatnonzero(found)
    found[some] = held(b[some])
    return found


def mixed(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """Finaliser of a 64-bit hash (splitmix64)."""
    with np.errstate(over="ignore"):
        x = h + np.uint64((salt + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
