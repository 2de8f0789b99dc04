"""Packing by concatenating all documents and cutting fixed windows.

First pass: every task tokenises its documents, adds the end id and keeps a running sum; the table written holds each document's
ids with its place in its part. The totals of the parts are summed up, and the second pass adds the total before each part, which
gives every document its place in one long stream. Windows of that stream are the sequences; a document crossing a window's edge
comes in several pieces.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetable.llm.common import slices, table, texts, tidied, written
from cuetable.llm.lexicon import Merges, described
from cuetable.llm.token_counts import Encoder, vocabulary_path, whole_tokens
from cuetable.plans.sizes import broadcast_if_small

LENGTH, END = 4096, 2
#: Words merged side by side, and bytes of text encoded at a time.
TOGETHER, AT_ONCE = 20_000, 1 << 20


class Writer(Encoder):
    """Token ids by the vocabulary's merges, word by word; the library is loaded only for texts that go to it whole."""

    remembered = 130_000

    def __init__(self, path: str, whole: dict[str, int], merges: Merges):
        self.path, self.ids, self.merges, self.kind = path, True, merges, merges.kind
        self.whole = {s: self.value([i]) for s, i in whole.items()}
        self.words = dict(self.whole)

    def merged(self, pieces: list[str]) -> list:
        out: list = []
        for at in range(0, len(pieces), TOGETHER):
            ids, first = self.merges.merged([p.encode() for p in pieces[at:at + TOGETHER]])
            raw, to = ids.astype(self.kind).tobytes(), (first * np.dtype(self.kind).itemsize).tolist()
            out += [raw[a:b] for a, b in zip(to[:-1], to[1:], strict=True)]
        return out


def tokenised(docs: DataFrame, path: str, end: int = END) -> DataFrame:
    """``part, at, doc_id, n, ids``: every document's ids as bytes and where they begin among those of its part."""
    whole, merges = whole_tokens(path), Merges(described(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, at = Writer(path, whole, merges), TaskContext.get().partitionId(), 0
        last, width = own.value([end]), len(own.value([end]))
        for batch in batches:
            for rows in slices(batch, limit=AT_ONCE):
                ids = [x + last for x in own.encoded(rows.column("text").to_pylist())]
                n = np.fromiter((len(x) // width for x in ids), np.int64, len(ids))
                before = at + np.cumsum(n) - n
                at += int(n.sum())
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), part, np.int32)), pa.array(before), rows.column("doc_id"), pa.array(n), pa.array(ids, pa.binary())],
                                                 ["part", "at", "doc_id", "n", "ids"])

    return texts(docs).mapInArrow(tidied(run), "part int, at bigint, doc_id bigint, n bigint, ids binary")


def pack(docs: DataFrame, path: str, length: int = LENGTH, end: int = END) -> DataFrame:
    """Pieces ``doc_id, start, length, doc_tokens, sequence_id, offset, ids``; ``ids`` are little-endian unsigned 32-bit.

    Every sequence but the last is full, so there is next to no padding. Null and empty texts are the end id alone. Each row is packed
    once, repeated rows and null ids too; an empty table gives no piece. Other columns are not read. One number per input split is
    summed in one task.
    """
    wide = np.dtype(Merges(described(path)).kind)
    stream = written(tokenised(docs, path, end), "ids")
    totals = stream.groupBy("part").agg(F.max(F.col("at") + F.col("n")).alias("total"))
    before = F.sum("total").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    totals = written(totals.select("part", F.coalesce(before, F.lit(0)).alias("base")), "totals")
    placed = stream.join(broadcast_if_small(totals), "part").select("doc_id", (F.col("base") + F.col("at")).alias("place"), "n", "ids")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch, "ids"):
                doc = rows.column("doc_id").to_pylist()
                out: list[tuple] = []
                for d, place, n, raw in zip(doc, rows.column("place").to_pylist(), rows.column("n").to_pylist(), rows.column("ids").to_pylist(), strict=True):
                    ids, start = np.frombuffer(raw, wide).astype("<u4"), 0
                    while start < n:
                        sequence, offset = divmod(place + start, length)
                        size = min(length - offset, n - start)
                        out.append((d, start, size, n, sequence, offset, ids[start:start + size].tobytes()))
                        start += size
                names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset"]
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:6]), pa.array(columns[6], pa.binary())], [*names, "ids"])

    return placed.mapInArrow(tidied(cut), "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary")


def op8_pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = pack(table(spark, sf_dir, "documents"), vocabulary_path())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


QUERIES = {"op8_pack_sequences": op8_pack_sequences}
ORACLES: dict[str, str] = {}
