"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.plans.folders import cut_lineage
from cuetable.plans.shipping import ship
from cuetable.plans.sizes import broadcast_if_small

SLICE_BYTES = 1 << 20
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and whole ``text``, null as empty, and the columns named."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), *more)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    return cut_lineage(df, name)


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """``docs`` less the rows named by ``doc_id`` and ``place`` in ``dropped``."""
    gone = broadcast_if_small(written(dropped.select(F.col("doc_id").alias("_doc"), F.col("place").alias("_place")).distinct(), "dropped"))
    return docs.join(gone, docs["doc_id"].cast("bigint").eqNullSafe(gone["_doc"]) & (place_of(docs) == gone["_place"]), "left_anti")


def place_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def given_back() -> None:
    """Returns to the system what a Python worker has freed."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # where the C library has it
        trim(0)


def tidied(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, giving back at its end what a worker would hold until its next task."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        gc.collect()
        given_back()

    return task


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text; one longer row comes alone."""
    _, offsets = text_buffer(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and its row offsets, from 0."""
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0]:offsets[-1]], offsets - offsets[0]


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit hash."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Rolling:
    """Hashes of any substrings of a buffer by prefix sums modulo 2**64."""

    BASE = 0x9E3779B97F4A7C15 | 1
    _powers: np.ndarray | None = None
    _inverse: np.ndarray | None = None

    def __init__(self, data: np.ndarray, seed: int = 1):
        n = len(data) + 1
        if Rolling._powers is None or len(Rolling._powers) < n:
            steps = np.full(n, np.uint64(Rolling.BASE))
            steps[0] = 1
            back = np.full(n, np.uint64(pow(Rolling.BASE, -1, 1 << 64)))
            back[0] = 1
            Rolling._powers, Rolling._inverse = np.multiply.accumulate(steps), np.multiply.accumulate(back)
        values = np.random.default_rng(seed).integers(1, 1 << 63, 256, dtype=np.uint64)
        self.sums = np.zeros(n, np.uint64)
        np.cumsum(values[data] * Rolling._powers[:n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * Rolling._inverse[start] + (end - start).astype(np.uint64))


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word between ASCII blanks, and the number of words of each row."""
    inside = ~SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets] = True
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (first[:-1] | ~before))
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (first[1:] | ~after)) + 1
    return starts, ends, np.diff(np.searchsorted(starts, offsets))


def hex_of(binary: Column) -> Column:
    return F.lower(F.hex(binary))
