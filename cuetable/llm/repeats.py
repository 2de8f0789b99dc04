"""Repeated passages through the interval tree of an enhanced suffix array.

Bytes are removed that lie in a string of ``LENGTH`` bytes which also starts earlier. Not every suffix is sorted: each window of ``LENGTH`` bytes
picks its smallest gram as anchor, so equal windows pick equal anchors at equal places, and the suffixes beginning at anchors meet every
repeat. An anchor is looked at with its context, the bytes that any of its windows can reach.

1. Occurrences of one anchor with equal contexts: all but the earliest are covered as far as the context goes. They meet by hashes.
2. The earliest ones of different contexts go through an enhanced suffix array per anchor: sorted right contexts with the lengths of
   their common prefixes, scanned with a stack into the tree of intervals. Each interval's occurrences are scanned again by their left
   contexts; where left extensions differ, a maximal repeat ends. Every maximal repeat group covers all its occurrences but the earliest.
3. Anchors with too many contexts for one task, as at the edge of a passage that very many documents share, spell out their windows; these meet by hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import Rolling, mixed, slices, table, text_buffer, texts, tidied, written

LENGTH, GRAM = 100, 24
LEFT = LENGTH - GRAM
CROWDED, FLUSH, PER_SLICE = 20_000, 1_000_000, 250_000
ANCHOR, WINDOW, CONTEXTS = 0, 1, 2


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, Rolling]:
    """Anchor positions in the buffer, the row of each, gram and context hashes."""
    n, windows = len(data), LENGTH - GRAM + 1
    none = np.zeros(0, np.int64)
    rolling = Rolling(data)
    if n < LENGTH:
        return none, none, none.view(np.uint64), none.view(np.uint64), rolling
    at = np.arange(n - GRAM + 1)
    gram = rolling.of(at, at + GRAM)
    ranked = (gram & np.uint64(~((1 << 30) - 1) & ((1 << 64) - 1))) | at.astype(np.uint64)  # the leftmost of equals
    padded = np.full(-(-(n - GRAM + 1) // windows) * windows, np.uint64((1 << 64) - 1))
    padded[:len(ranked)] = ranked
    blocks = padded.reshape(-1, windows)
    head = np.minimum.accumulate(blocks, 1).ravel()
    tail = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].ravel()
    least = np.minimum(tail[:n - LENGTH + 1], head[windows - 1:windows - 1 + n - LENGTH + 1])
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    inside = row[:n - LENGTH + 1] == row[LENGTH - 1:]
    where = (least[inside] & np.uint64((1 << 30) - 1)).astype(np.int64)
    where = where[np.append(True, where[1:] != where[:-1])[:len(where)]]
    own = row[where] if len(where) else none
    start, end = np.maximum(where - LEFT, offsets[own]), np.minimum(where + LENGTH, offsets[own + 1])
    context = mixed(rolling.of(start, end) + (where - start).astype(np.uint64))
    return where, own, gram[where], context, rolling


def order_of(a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order by the two hashes, then place, each place once; and which of them begin a pair of hashes."""
    order = np.lexsort((at, doc, b, a))
    differ = np.zeros(len(order), bool)
    differ[:1] = True
    for v in (a, b, doc, at):
        differ[1:] |= v[order[1:]] != v[order[:-1]]
    order = order[differ]
    x, y = a[order], b[order]
    return order, np.append(True, (x[1:] != x[:-1]) | (y[1:] != y[:-1]))[:len(x)]


def crowded_anchors(docs: DataFrame) -> tuple[np.ndarray, int]:
    """Anchors with more than ``CROWDED`` contexts, counted where a task sees several; and the number of all anchors.

    An anchor seen once a task at most has no more contexts than there are tasks. There are fewer crowded ones than anchors by the bound.
    """
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        total = n = 0

        def several() -> pa.RecordBatch:
            gram, context = (np.concatenate(x) for x in zip(*held, strict=True))
            order, first = order_of(gram, context, gram, gram)
            found, counts = np.unique(gram[order][first], return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(found[counts > 1].view(np.int64)), pa.array(counts[counts > 1])], ["gram", "n"])

        for batch in batches:
            for rows in slices(batch):
                _, _, gram, context, _ = anchors(*text_buffer(rows.column("text")))
                held.append((gram, context))
                n += len(gram)
                total += len(gram)
                if n >= FLUSH:
                    yield several()
                    held, n = [], 0
        if n:
            yield several()
        yield pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([total], pa.int64())], ["gram", "n"])

    counts = docs.select("text").mapInArrow(tidied(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))
    counts = written(counts, "contexts")
    total = counts.filter("gram IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = counts.filter(f"gram IS NOT NULL AND n > {CROWDED}").select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64)), total


def met(docs: DataFrame, crowded: np.ndarray, parts: int) -> DataFrame:
    """``what, gram, doc, at``: covered anchors, covered windows, and the earliest of each context where an anchor has several."""
    def pack(what: int, a: np.ndarray, b: np.ndarray, doc: np.ndarray, at: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
        part = (mixed(a) % np.uint64(parts)).astype(np.int64)
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.append(True, np.diff(part[order]) != 0)[:len(part)])
        for x, y in zip(edge, np.append(edge[1:], len(part)), strict=True):
            k = order[x:y]
            yield int(part[k[0]]), what, b"".join((a[k].tobytes(), b[k].tobytes(), doc[k].tobytes(), at[k].astype(np.int32).tobytes()))

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush(held: dict[int, list]) -> Iterator[pa.RecordBatch]:
            out: list[tuple[int, int, bytes]] = []
            for what, lists in held.items():
                if lists:
                    a, b, doc, at = (np.concatenate(x) for x in zip(*lists, strict=True))
                    order, first = order_of(a, b, doc, at)
                    k, again = order[first], order[~first]
                    out += pack(what, a[k], b[k], doc[k], at[k])
                    if len(again):  # covered already here
                        out.append((int(a[again[0]] % np.uint64(parts)), what + 10, doc[again].tobytes() + at[again].astype(np.int32).tobytes()))
            columns = list(zip(*out, strict=True))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], ["part", "what", "packed"])

        held: dict[int, list] = {ANCHOR: [], WINDOW: []}
        n = 0
        for batch in batches:
            for rows in slices(batch):
                data, offsets = text_buffer(rows.column("text"))
                where, own, gram, context, rolling = anchors(data, offsets)
                doc = rows.column("doc").to_numpy()
                many = np.isin(gram, crowded)
                few = ~many
                held[ANCHOR].append((gram[few], context[few], doc[own[few]], where[few] - offsets[own[few]]))
                n += int(few.sum())
                if many.any():
                    second = Rolling(data, seed=2)
                    for o in range(LEFT + 1):
                        start = where[many] - o
                        fits = (start >= offsets[own[many]]) & (start + LENGTH <= offsets[own[many] + 1])
                        start, row = start[fits], own[many][fits]
                        held[WINDOW].append((rolling.of(start, start + LENGTH), second.of(start, start + LENGTH), doc[row], start - offsets[row]))
                        n += len(start)
                if n >= FLUSH:
                    yield from flush(held)
                    held, n = {ANCHOR: [], WINDOW: []}, 0
        yield from flush(held)

    def meet(rows: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[np.ndarray, ...]] = []
        for what in (ANCHOR, WINDOW):
            raw = rows.loc[rows["what"] == what, "packed"]
            if len(raw):
                sizes = [len(x) // 28 for x in raw]
                a, b = (np.concatenate([np.frombuffer(x, np.uint64, n, 8 * k * n) for x, n in zip(raw, sizes, strict=True)]) for k in (0, 1))
                doc = np.concatenate([np.frombuffer(x, np.int64, n, 16 * n) for x, n in zip(raw, sizes, strict=True)])
                at = np.concatenate([np.frombuffer(x, np.int32, n, 24 * n) for x, n in zip(raw, sizes, strict=True)])
                order, first = order_of(a, b, doc, at)
                again = order[~first]
                out.append((np.full(len(again), what), a[again], doc[again], at[again]))
                if what == ANCHOR:
                    k = order[first]
                    _, which, sizes = np.unique(a[k], return_inverse=True, return_counts=True)
                    k = k[sizes[which] > 1]
                    out.append((np.full(len(k), CONTEXTS), a[k], doc[k], at[k]))
            for x in rows.loc[rows["what"] == what + 10, "packed"]:
                n = len(x) // 12
                out.append((np.full(n, what), np.zeros(n, np.uint64), np.frombuffer(x, np.int64, n), np.frombuffer(x, np.int32, n, 8 * n)))
        what, gram, doc, at = (np.concatenate(x) for x in zip(*out, strict=True))
        return pd.DataFrame({"what": what.astype(np.int32), "gram": gram.view(np.int64), "doc": doc, "at": at.astype(np.int32)})

    packed = docs.select("doc", "text").mapInArrow(tidied(local), "part bigint, what int, packed binary")
    return packed.groupBy("part").applyInPandas(meet, "what int, gram bigint, doc bigint, at int")


def intervals(common: np.ndarray, least: int) -> Iterator[tuple[int, int, int]]:
    """Intervals ``(depth, first, last)`` of at least ``least`` of an array of common prefix lengths, by one scan with a stack.

    ``common[i]`` is shared by the sorted entries ``i`` and ``i + 1``.
    """
    stack: list[tuple[int, int]] = []  # depth, first
    for i, depth in enumerate([*common.tolist(), -1]):
        first = i
        while stack and stack[-1][0] > depth:
            deeper, first = stack.pop()
            if deeper >= least:
                yield deeper, first, i
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, first))


def sorted_common(text: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of padded byte rows, and the length of prefix each shares with the next, at most their sizes."""
    wide = np.zeros((len(text), -(-text.shape[1] // 8) * 8), np.uint8)
    wide[:, :text.shape[1]] = text
    keys = wide.view(">u8").astype(np.uint64)
    order = np.lexsort((size, *keys.T[::-1]))
    t, s = text[order], size[order]
    differ = t[1:] != t[:-1]
    common = np.where(differ.any(1), differ.argmax(1), text.shape[1])
    return order, np.minimum(common, np.minimum(s[1:], s[:-1]))


def maximal_repeats(right: np.ndarray, right_size: np.ndarray, left: np.ndarray, left_size: np.ndarray) -> Iterator[tuple[np.ndarray, int, int]]:
    """Maximal repeat groups of at least ``LENGTH`` bytes among occurrences of one anchor: who has it, bytes left and right of the anchor.

    ``left`` is reversed; occurrences come in order of their places.
    """
    order, common = sorted_common(right, right_size)
    for r, a, b in intervals(common, GRAM):
        inside = np.sort(order[a:b + 1])
        by_left, left_common = sorted_common(left[inside], left_size[inside])
        if r == LENGTH:  # an empty left extension is enough
            yield inside, 0, r
        for x, c, d in intervals(left_common, max(LENGTH - r, 1)):
            yield inside[by_left[c:d + 1]], x, r


def covered_by_groups(contexts: DataFrame) -> DataFrame:
    """``doc, start, end`` covered in ``contexts`` (``gram, doc, at, left, right``), rows of one gram together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def matrix(values: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
            return np.frombuffer(b"".join(v.ljust(width, b"\0") for v in values), np.uint8).reshape(-1, width), np.fromiter(map(len, values), np.int64, len(values))

        def covered(part: pa.Table) -> Iterator[pa.RecordBatch]:
            gram = part.column("gram").to_numpy()
            doc, at = part.column("doc").to_numpy(), part.column("at").to_numpy().astype(np.int64)
            order = np.lexsort((at, doc, gram))
            gram, doc, at = gram[order], doc[order], at[order]
            right, right_size = matrix(part.column("right").to_pylist(), LENGTH)
            left, left_size = matrix([v[::-1] for v in part.column("left").to_pylist()], LEFT)
            right, right_size, left, left_size = right[order], right_size[order], left[order], left_size[order]
            first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1]))
            size = np.diff(np.append(first, len(gram)))
            out = []
            two = first[size == 2]  # one interval: the pair
            r, x = ((np.where((d := m[two] != m[two + 1]).any(1), d.argmax(1), m.shape[1])) for m in (right, left))
            r, x = np.minimum(r, np.minimum(right_size[two], right_size[two + 1])), np.minimum(x, np.minimum(left_size[two], left_size[two + 1]))
            k = r + x >= LENGTH
            out.append((doc[two + 1][k], (at[two + 1] - x)[k], (at[two + 1] + r)[k]))
            for a, n in zip(first[size > 2].tolist(), size[size > 2].tolist(), strict=True):
                starts, ends = np.full(n, 1 << 30), np.zeros(n, np.int64)
                for who, x, r in maximal_repeats(right[a:a + n], right_size[a:a + n], left[a:a + n], left_size[a:a + n]):
                    later = who[who != who.min()]
                    # Covers of one occurrence all hold its anchor, so their union is one stretch.
                    starts[later], ends[later] = np.minimum(starts[later], at[a + later] - x), np.maximum(ends[later], at[a + later] + r)
                k = ends > 0
                out.append((doc[a:a + n][k], starts[k], ends[k]))
            columns = [np.concatenate(c).astype(np.int64) for c in zip(*out, strict=True)]
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["doc", "start", "end"])

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column("gram").to_numpy()
            cut = int(np.flatnonzero(gram != gram[-1])[-1]) + 1 if gram[0] != gram[-1] else 0
            if held and (cut or held[-1].column("gram")[-1].as_py() != gram[0]):
                ready = pa.Table.from_batches([*held, batch.slice(0, cut)])
                yield from covered(ready)
                held = [batch.slice(cut)]
            elif cut:
                yield from covered(pa.Table.from_batches([batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            else:
                held.append(batch)
        if held:
            yield from covered(pa.Table.from_batches(held))

    return contexts.mapInArrow(tidied(run), "doc bigint, start bigint, end bigint")


def contexts_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """``gram, doc, at, left, right`` for the anchors in ``wanted`` (``gram, doc, at``)."""
    lists = wanted.groupBy("doc").agg(F.collect_list(F.struct("gram", "at")).alias("wanted"))  # no longer than the document

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                out: list[tuple] = []
                for doc, text, marks in zip(rows.column("doc").to_pylist(), rows.column("text"), rows.column("wanted").to_pylist(), strict=True):
                    raw = text.as_buffer().to_pybytes()
                    out += [(m["gram"], doc, m["at"], raw[max(0, m["at"] - LEFT):m["at"]], raw[m["at"]:m["at"] + LENGTH]) for m in marks]
                for k in range(0, len(out), 20_000):
                    c = list(zip(*out[k:k + 20_000], strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.int64()), pa.array(c[1], pa.int64()), pa.array(c[2], pa.int32()), pa.array(c[3], pa.binary()), pa.array(c[4], pa.binary())],
                                                     ["gram", "doc", "at", "left", "right"])

    return docs.select("doc", "text").join(lists, "doc").select("doc", "text", "wanted").mapInArrow(tidied(run), "gram bigint, doc bigint, at int, left binary, right binary")


def with_order(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``doc, text`` with distinct ``doc`` in the order that says which text is earlier, and whether ``doc`` is doc_id itself."""
    rows = texts(docs)
    if rows.filter("doc_id IS NULL").isEmpty() and rows.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return rows.withColumnRenamed("doc_id", "doc"), True

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = TaskContext.get().partitionId() << 36
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + b.num_rows)), *b.columns], ["doc", "doc_id", "place", "text"])
            at += b.num_rows

    rows = rows.select("doc_id", F.xxhash64("text").alias("place"), "text").dropDuplicates(["doc_id", "place"])
    rows = rows.sort(F.col("doc_id").asc_nulls_last(), "place")
    return written(rows.mapInArrow(number, "doc bigint, doc_id bigint, place bigint, text string"), "ordered"), False


def remove_repeats(docs: DataFrame) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, spans, text`` for every row of ``docs``.

    Every byte of the UTF-8 text is removed that a string of 100 bytes covers which also starts earlier, at a smaller doc_id or further up
    in the same text; strings are judged on the input and never cross texts. ``spans`` are the removed stretches ``(start, end)``, ends
    exclusive, ``text`` the bytes that remain. Null and empty texts lose nothing. A null doc_id comes last; texts under one doc_id
    follow each other by their hash; rows alike in doc_id and text are one document and get the same answer. Other columns are not read.
    """
    own, plain_ids = with_order(docs)
    crowded, total = crowded_anchors(own)
    parts = max(24, total // PER_SLICE)
    found = written(met(own, crowded, parts), "met")
    contexts = contexts_of(own, found.filter(F.col("what") == CONTEXTS).select("gram", "doc", "at"))
    contexts = contexts.repartition("gram").sortWithinPartitions("gram")
    groups = written(covered_by_groups(contexts), "groups")
    covers = found.filter(F.col("what") == ANCHOR).select("doc", (F.col("at") - LEFT).cast("bigint").alias("start"), (F.col("at") + LENGTH).cast("bigint").alias("end"))
    covers = covers.unionAll(found.filter(F.col("what") == WINDOW).select("doc", F.col("at").cast("bigint"), (F.col("at") + LENGTH).cast("bigint"))).unionAll(groups)
    covers = covers.groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("covers"))  # no longer than the document

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for rows in slices(batch):
                out: list[tuple] = []
                for doc, text, covers in zip(rows.column("doc").to_pylist(), rows.column("text"), rows.column("covers"), strict=True):
                    raw = text.as_buffer().to_pybytes() if text.is_valid else b""
                    spans = []
                    if covers.is_valid:
                        s, e = (covers.values.field(k).to_numpy() for k in (0, 1))
                        s, e = np.maximum(s, 0), np.minimum(e, len(raw))
                        order = np.argsort(s, kind="stable")
                        s, e = s[order], np.maximum.accumulate(e[order])
                        new = np.append(True, s[1:] > e[:-1])
                        spans = list(zip(s[new].tolist(), e[np.append(new[1:], True)].tolist(), strict=True))
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(raw[last:a])
                        last = b
                    left = b"".join([*kept, raw[last:]])
                    out.append((doc, len(raw), len(raw) - len(left), len(spans), [{"start": a, "end": b} for a, b in spans], left))
                c = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in c[:4]), pa.array(c[4], spans_type), pa.array(c[5], pa.binary())],
                                                 ["doc", "n_bytes", "n_removed", "n_spans", "spans", "text"])

    kept = own.select("doc", "text").join(covers, "doc", "left").select("doc", "text", "covers").mapInArrow(
        tidied(cut), "doc bigint, n_bytes bigint, n_removed bigint, n_spans bigint, spans array<struct<start:bigint,end:bigint>>, text binary")
    if plain_ids:
        return kept.withColumnRenamed("doc", "doc_id")
    kept = kept.join(own.select("doc", F.col("doc_id").alias("_doc"), "place"), "doc").drop("doc")
    rows = texts(docs).select("doc_id", F.xxhash64("text").alias("_place"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("place") == F.col("_place"))).drop("_doc", "place", "_place")


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("text", 256).alias("kept_sha256"))


QUERIES = {"op6_repeats": op6_repeats}
ORACLES: dict[str, str] = {}
