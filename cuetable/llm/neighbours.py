"""Approximate nearest neighbours by cross-polytope hashing.

Each table turns the unit vectors by three rounds of random signs and a fast Hadamard transform; the bucket is the nearest
signed axis. Every vector lies in one bucket of each table, a query looks into the buckets of its nearest axes. A bucket is cut
into blocks of vectors and blocks of queries of bounded size; every pair of blocks is one group, scored exactly by a matrix product
of which only each query's best stay.

The largest inner product is the nearest angle only among vectors of like length: where lengths differ, vectors lie in bands of length, each
hashed for itself, and queries look into all of them. A query that
found too few goes on to its next buckets that hold any.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetable.llm.common import table, tidied, written
from cuetable.plans.shipping import ship
from cuetable.plans.sizes import broadcast_if_small

TABLES, PROBES, NEAREST, QUERY_EVERY = 4, 32, 20, 20
VECTOR_BLOCK, QUERY_BLOCK = 20_000, 4_000
#: Bands of length to a factor of two.
BANDS = 3


def hadamard(rows: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of every row, scaled to keep lengths."""
    out, d, half = rows.copy(), rows.shape[1], 1
    while half < d:
        pairs = out.reshape(len(out), d // (2 * half), 2, half)
        out = np.stack((pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]), 2).reshape(len(out), d)
        half *= 2
    return out / np.sqrt(d)


def axes(unit: np.ndarray, tables: int, probes: int) -> np.ndarray:
    """The nearest signed axes of every row in each table, nearest first: rows x tables x probes."""
    n, d = unit.shape
    size = 1 << max(1, (d - 1).bit_length())
    padded = np.zeros((n, size))
    padded[:, :d] = unit
    out = np.empty((n, tables, min(probes, 2 * size)), np.int64)
    for t in range(tables):
        signs, turned = np.random.default_rng(t).choice([-1.0, 1.0], (3, size)), padded
        for s in signs:
            turned = hadamard(turned * s)
        out[:, t] = np.argsort(np.concatenate([-turned, turned], 1), 1, kind="stable")[:, :out.shape[2]]
    return out


def best(query: np.ndarray, vectors: np.ndarray, query_ids: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every query its ``k`` rows of largest inner product, as query id, id and product; ties go to smaller ids, equal vectors share one product."""
    order = np.argsort(ids, kind="stable")
    ids, vectors = ids[order], np.ascontiguousarray(vectors[order])
    _, first, which = np.unique(vectors.view(f"V{vectors.strides[0]}").ravel(), return_index=True, return_inverse=True)
    members = np.argsort(which, kind="stable")
    sizes = np.bincount(which)
    begin = np.cumsum(sizes) - sizes
    different, take = vectors[first], min(k + 1, len(first))  # one more, as the query may meet itself
    out: list[tuple[np.ndarray, ...]] = []
    for at in range(0, len(query), 256):
        q = query[at:at + 256]
        close = np.argpartition(-(q @ different.T), take - 1, 1)[:, :take]
        row, kind = np.repeat(np.arange(len(q)), take), close.ravel()
        score = np.einsum("ij,ij->i", q[row], different[kind])
        many = np.minimum(sizes[kind], k + 1)
        nth = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        own, score = np.repeat(query_ids[at:at + 256][row], many), np.repeat(score, many)
        found = ids[members[np.repeat(begin[kind], many) + nth]]
        other = own != found
        own, score, found = own[other], score[other], found[other]
        order = np.lexsort((found, -score, own))
        own, score, found = own[order], score[order], found[order]
        head = np.flatnonzero(np.append(True, own[1:] != own[:-1])[:len(own)])
        keep = np.arange(len(own)) - np.repeat(head, np.diff(np.append(head, len(own)))) < k
        out.append((own[keep], found[keep], score[keep]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def nearest(vectors: DataFrame, is_query, k: int = NEAREST, tables: int = TABLES, probes: int = PROBES, whole: int = 0) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows of ``vectors`` (``vec_id, embedding``) that meet ``is_query``.

    Vectors that are null, zero or hold null or non-finite components take no part, nor do null ids; shorter vectors count as
    padded with zeros. Rows that repeat a vec_id are one id with its best product. Every query
    has ``k`` rows, or all other ids where there are fewer. Bands of up to ``whole`` vectors are not hashed but looked through; by default all
    are hashed. Other columns are not read; an empty table gives no row.
    """
    ship(vectors.sparkSession)
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"), is_query.alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0))
    largest = F.array_max(F.transform("v", F.abs))
    length = F.log2(largest) + F.log2(F.aggregate(F.transform("v", lambda x: x / largest), F.lit(0.0), lambda a, x: a + x * x)) / 2
    d, shortest, longest = rows.agg(F.max(F.size("v")), F.min(length), F.max(length)).first()
    d = d or 1
    longer = bool(longest is not None and longest - shortest > 1.5e-3)
    rows = rows.withColumn("band", F.floor((F.lit(longest) - length) * BANDS).cast("int") if longer else F.lit(0))
    held = {r.band: r["count"] for r in rows.groupBy("band").count().collect()}  # as many as lengths have bands
    whole_bands = np.array([b for b, n in held.items() if n <= whole], np.int64)
    hashing, size = len(whole_bands) < len(held), 2 << max(1, (d - 1).bit_length())

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2_000):
                batch = whole.slice(at, 2_000)
                x = np.zeros((batch.num_rows, d))
                column = batch.column("v")
                sizes = column.value_lengths().to_numpy(zero_copy_only=False)
                x[np.arange(d) < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
                unit = x / np.abs(x).max(1, keepdims=True)
                yield batch, x, unit / np.linalg.norm(unit, axis=1, keepdims=True)

    def listed(*parts: tuple, raw: list, ids: np.ndarray) -> pa.RecordBatch:
        """Entries from parts of table, bucket, asks, row, band and place."""
        tables_, buckets, asks, owner, band, place = (np.concatenate(x) for x in zip(*parts, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(tables_.astype(np.int32)), pa.array(buckets.astype(np.int32)), pa.array(asks.astype(bool)), pa.array(ids[owner]),
                                           pa.array([raw[i] for i in owner], pa.binary()), pa.array(band.astype(np.int32)), pa.array(place.astype(np.int32))],
                                          ["table", "bucket", "asks", "vec_id", "v", "band", "place"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, x, unit in read(batches):
            ids, asks, band = batch.column("vec_id").to_numpy(), np.flatnonzero(batch.column("asks").to_numpy(zero_copy_only=False)), batch.column("band").to_numpy()
            alone = np.isin(band, whole_bands)
            one, many = np.flatnonzero(alone), np.flatnonzero(~alone)
            zero = lambda n: np.zeros(n, np.int64)
            parts = [(zero(len(one)) - 1, zero(len(one)), zero(len(one)), one, band[one], zero(len(one)))]
            if len(whole_bands):
                parts.append((zero(len(asks)) - 1, zero(len(asks)), zero(len(asks)) + 1, asks, zero(len(asks)), zero(len(asks))))
            if hashing:
                home, probe = axes(unit[many], tables, 1)[:, :, 0], axes(unit[asks], tables, probes)
                n, q, p = len(many), len(asks), probe.shape[2]
                parts.append((np.tile(np.arange(tables), n), home.ravel(), zero(n * tables), np.repeat(many, tables), np.repeat(band[many], tables), zero(n * tables)))
                parts.append((np.tile(np.repeat(np.arange(tables), p), q), probe.ravel(), zero(q * tables * p) + 1, np.repeat(asks, tables * p), zero(q * tables * p), zero(q * tables * p)))
            yield listed(*parts, raw=[r.tobytes() for r in x], ids=ids)

    def every_axis(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries with all buckets of the first table in order of ``place``."""
        for batch, x, unit in read(batches):
            probe = axes(unit, 1, size)[:, 0]
            n, p = probe.shape
            yield listed((np.zeros(n * p), probe.ravel(), np.ones(n * p), np.repeat(np.arange(n), p), np.zeros(n * p), np.tile(np.arange(p), n)),
                         raw=[r.tobytes() for r in x], ids=batch.column("vec_id").to_numpy())

    form = "table int, bucket int, asks boolean, vec_id bigint, v binary, band int, place int"
    entries = written(rows.mapInArrow(tidied(hashed), form), "entries")
    homes = entries.filter(~F.col("asks"))
    buckets = written(homes.groupBy("band", "table", "bucket").agg(F.count(F.lit(1)).alias("held")), "held")

    def search(queries: DataFrame) -> DataFrame:
        """``query_id, vec_id, score`` of the best in the buckets that ``queries`` look into."""
        asked = queries.groupBy("table", "bucket").agg(F.count(F.lit(1)).alias("asked"))
        sizes = buckets.join(asked, ["table", "bucket"])
        sizes = sizes.select("band", "table", "bucket", F.ceil(F.col("held") / VECTOR_BLOCK).cast("int").alias("blocks"), F.ceil(F.col("asked") / QUERY_BLOCK).cast("int").alias("query_blocks"))
        sizes = broadcast_if_small(written(sizes, "buckets"))
        every_block, every_query = F.sequence(F.lit(0), F.col("blocks") - 1), F.sequence(F.lit(0), F.col("query_blocks") - 1)
        one, columns = F.xxhash64("vec_id"), ["band", "table", "bucket", "asks", "vec_id", "v", "blocks", "query_blocks"]
        placed = homes.join(sizes, ["band", "table", "bucket"]).select(*columns).unionAll(queries.drop("band").join(sizes, ["table", "bucket"]).select(*columns))
        placed = placed.withColumn("block", F.explode(F.when(F.col("asks"), every_block).otherwise(F.array(F.pmod(one, "blocks").cast("int")))))
        placed = placed.withColumn("query_block", F.explode(F.when(F.col("asks"), F.array(F.pmod(one, "query_blocks").cast("int"))).otherwise(every_query)))
        pairs = placed.groupBy("band", "table", "bucket", "block", "query_block").applyInPandas(scored, "query_id bigint, vec_id bigint, score double")
        return pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    def scored(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy(bool)
        x, ids = np.frombuffer(b"".join(group["v"]), np.float64).reshape(len(group), -1), group["vec_id"].to_numpy(np.int64)
        if asks.all() or not asks.any():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        own, found, score = best(x[asks], x[~asks], ids[asks], ids[~asks], k)
        return pd.DataFrame({"query_id": own, "vec_id": found, "score": score})

    def ranked(pairs: DataFrame) -> DataFrame:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
        return pairs.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

    found = ranked(search(entries.filter("asks")))
    if not hashing:
        return found
    found, rows_held, want = written(found, "found"), sum(held.values()), k + 1
    others = min(k, rows.select("vec_id").distinct().count() - 1)
    asking = rows.filter("asks").select("vec_id", "v")
    first_table = buckets.filter(F.col("table") == 0).groupBy("bucket").agg(F.sum("held").alias("held"))
    while True:  # a few times, as what is looked into grows
        full = found.groupBy("query_id").count().filter(F.col("count") >= others).select(F.col("query_id").alias("vec_id"))
        lacking = written(asking.join(full, "vec_id", "left_anti"), "lacking")
        if others <= 0 or lacking.isEmpty():
            return found
        before = F.sum("held").over(W.partitionBy("vec_id", "v").orderBy("place").rowsBetween(W.unboundedPreceding, -1))  # of one query
        more = lacking.mapInArrow(tidied(every_axis), form).join(first_table, "bucket").withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < want)
        more = search(written(more.drop("held", "before"), "more")).unionAll(found.select("query_id", "vec_id", "score"))
        found = written(ranked(more.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))), "found")
        if want > rows_held:
            return found
        want *= 4


def op1_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0)


QUERIES = {"op1_nearest": op1_nearest}
ORACLES: dict[str, str] = {}
