"""Exact duplicates through mergeable counting quotient filters.

Each partition packs the 64-bit fingerprints of its texts into counting quotient filters, one per slice of the fingerprint
range: the high bits of a fingerprint choose slice and quotient, the low bits are kept as sorted remainders with counts. Filters
of one slice merge without loss by merging their remainders. Only documents whose fingerprint counts above one are compared byte
by byte, all others are known to be alone.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import table, texts, tidied, written
from cuetable.plans.sizes import broadcast_if_small

QUOTIENT_BITS = 12
FLUSH = 500_000


def pack(prints: np.ndarray, counts: np.ndarray, slice_bits: int) -> bytes:
    """Sorted distinct fingerprints of one slice as occupied bits, run ends, remainders and counts."""
    rest = np.uint64(64 - slice_bits - QUOTIENT_BITS)
    quotient = ((prints >> rest) & np.uint64((1 << QUOTIENT_BITS) - 1)).astype(np.int64)
    occupied = np.zeros(1 << QUOTIENT_BITS, bool)
    occupied[quotient] = True
    run_end = np.append(quotient[1:] != quotient[:-1], True)
    remainders = prints & np.uint64((1 << int(rest)) - 1)
    return b"".join((np.int64(len(prints)).tobytes(), np.packbits(occupied).tobytes(), np.packbits(run_end).tobytes(),
                     remainders.astype("<u8").tobytes(), counts.astype("<i8").tobytes()))


def unpack(raw: bytes, part: int, slice_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The fingerprints and counts that ``pack`` was given."""
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    at, width = 8, (1 << QUOTIENT_BITS) // 8
    occupied = np.flatnonzero(np.unpackbits(np.frombuffer(raw, np.uint8, width, at)))
    at += width
    run_end = np.unpackbits(np.frombuffer(raw, np.uint8, -(-n // 8), at))[:n]
    at += -(-n // 8)
    remainders = np.frombuffer(raw, "<u8", n, at)
    counts = np.frombuffer(raw, "<i8", n, at + 8 * n)
    quotient = occupied[np.cumsum(run_end) - run_end].astype(np.uint64)
    rest = np.uint64(64 - slice_bits - QUOTIENT_BITS)
    high = np.uint64(part) << np.uint64(64 - slice_bits) if slice_bits else np.uint64(0)
    return high | (quotient << rest) | remainders, counts


def merge(filters: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sorted remainders of several filters run together; counts of equal ones add up."""
    prints, counts = np.concatenate([f[0] for f in filters]), np.concatenate([f[1] for f in filters])
    order = np.argsort(prints, kind="stable")
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])[:len(prints)])
    return prints[first], np.add.reduceat(counts, first) if len(first) else counts


def repeated_fingerprints(marks: DataFrame, rows: int) -> DataFrame:
    """Fingerprints held by more than one row of ``marks``, with their counts."""
    slice_bits = max(5, math.ceil(math.log2(max(rows, 1) / FLUSH)))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def filters(held: list[np.ndarray]) -> pa.RecordBatch:
            prints, counts = np.unique(np.concatenate(held), return_counts=True)
            parts = (prints >> np.uint64(64 - slice_bits)).astype(np.int64)
            cut = np.flatnonzero(np.append(True, parts[1:] != parts[:-1])[:len(parts)])
            ends = np.append(cut[1:], len(parts))
            return pa.RecordBatch.from_arrays([
                pa.array(parts[cut], pa.int64()),
                pa.array([pack(prints[a:b], counts[a:b], slice_bits) for a, b in zip(cut, ends, strict=True)], pa.binary())], ["part", "filter"])

        held, n = [], 0
        for batch in batches:
            held.append(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            n += batch.num_rows
            if n >= FLUSH:
                yield filters(held)
                held, n = [], 0
        if n:
            yield filters(held)

    def merged(rows: pd.DataFrame) -> pd.DataFrame:
        part = int(rows["part"].iloc[0])
        prints, counts = merge([unpack(f, part, slice_bits) for f in rows["filter"]])
        many = counts > 1
        return pd.DataFrame({"print": prints[many].view(np.int64), "copies": counts[many]})

    packed = marks.select("print").mapInArrow(tidied(build), "part bigint, filter binary")
    return packed.groupBy("part").applyInPandas(merged, "print bigint, copies bigint")


def _marked(print_of: Callable[[bytes], int], with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            normal = pc.ascii_lower(batch.column("text"))
            raw = [v.encode() for v in normal.to_pylist()]
            prints = np.fromiter((print_of(v) for v in raw), np.uint64, len(raw)).view(np.int64)
            last = normal.cast(pa.string()) if with_text else pa.array([hashlib.sha256(v).hexdigest() for v in raw], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("place"), pa.array(prints, pa.int64()), last],
                                             ["doc_id", "place", "print", "normal" if with_text else "text_sha256"])
    return tidied(run)


def exact_groups(docs: DataFrame, print_of: Callable[[bytes], int] = xxhash.xxh3_64_intdigest) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, place, keep_id, group_size, kept, text_sha256``; ``place`` is a hash of the raw text.

    Texts are equal when identical after lower-casing A-Z; a null text is empty, and empty texts equal each other. The row with
    the largest ``doc_id`` stays; rows that repeat this ``doc_id`` stay with it. A null ``doc_id`` stays only where its group has no other.
    ``print_of`` gives the fingerprint; a weak one costs time, not correctness. Other columns are not read.
    """
    docs = texts(docs).withColumn("place", F.xxhash64("text"))
    marks = written(docs.mapInArrow(_marked(print_of, False), "doc_id bigint, place bigint, print bigint, text_sha256 string"), "marks")
    repeated = written(repeated_fingerprints(marks, marks.count()), "repeated")
    candidates = docs.mapInArrow(_marked(print_of, True), "doc_id bigint, place bigint, print bigint, normal string")
    candidates = candidates.join(broadcast_if_small(repeated.select("print")), "print", "left_semi")
    versions = candidates.groupBy("print", "normal").agg(F.lit(1).alias("one")).groupBy("print").agg(F.sum("one").alias("versions"))
    versions = written(versions, "versions")
    accidental = versions.filter("versions > 1").select("print")
    same = versions.filter("versions = 1").select("print")
    groups = marks.join(broadcast_if_small(same), "print", "left_semi").groupBy("print").agg(
        F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    met = not accidental.isEmpty()  # different texts with one fingerprint: the texts themselves are their key
    own = marks.join(accidental, "print", "left_anti") if met else marks
    out = own.join(groups, "print", "left").select(
        "doc_id", "place", F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"), "text_sha256")
    if met:
        rows = candidates.join(accidental, "print", "left_semi").select("doc_id", "place", "normal")
        by_text = rows.groupBy("normal").agg(F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        out = out.unionByName(rows.join(by_text, "normal").select("doc_id", "place", "keep_id", "group_size", F.sha2("normal", 256).alias("text_sha256")))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


SQL = """
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER g AS kept, sha256(normal) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS normal FROM documents)
WINDOW g AS (PARTITION BY normal)"""
QUERIES = {"op2_exact_dedup": op2_exact_dedup}
ORACLES = {"op2_exact_dedup": SQL}
