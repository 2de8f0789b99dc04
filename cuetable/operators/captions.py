"""Captions from text and from timed characters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.text import PUNCT_CLASS, WORD_CHAR, is_word_char, normalize_text, text_limit
from cuetable.operators.timeline import allocate_time
from cuetable.plans.folders import cut_lineage
from cuetable.plans.ordered import EvenTime, by_position, ordered
from cuetable.plans.shipping import ship
from cuetable.plans.spread import spread

#: Characters of a segment that are worked through at a time.
CHUNK_CHARS = 2_048
EDGE_MARKS = "，。！？；,.!?; "


def _chunk_pattern(limit: int) -> str:
    """Pieces of a clause: up to its last inner mark, or to the limit and the end of the word there."""
    a = "[A-Za-z0-9]"
    longer = f"(?=.{{{limit + 1}}})"
    inside_word = f"(?:(?<={a})(?:(?={a})|(?=['’\\-]{a})|(?=\\.\\d))|(?<={a}['’\\-])(?={a})|(?<={a}\\.)(?=\\d))"
    rest_of_word = f"(?:{inside_word}['’.\\-]?{a}*(?:['’\\-]{a}+|\\.\\d+)*)?(?:(?<={WORD_CHAR}){WORD_CHAR}+)?"
    return f"(?s){longer}.{{3,{limit}}}[，；、]|{longer}.{{{limit}}}{rest_of_word}|.{{1,{limit}}}\\z"


def _chunks(clause: Column, limit: int) -> Column:
    """Trimmed pieces of one clause; what is left after the last cut must hold more than marks."""
    found = F.regexp_extract_all(clause, F.lit(_chunk_pattern(limit)), F.lit(0))
    last = F.size(found) - 1
    tagged = F.transform(found, lambda c, i: F.struct(c.alias("c"), ((i == last) & (F.length(c) <= limit)).alias("rest")))
    kept = F.filter(tagged, lambda t: ~t["rest"] | (F.btrim(t["c"], F.lit(EDGE_MARKS)) != ""))
    return F.transform(kept, lambda t: F.when(t["rest"], F.btrim(t["c"])).otherwise(F.btrim(t["c"], F.lit("，；、 "))))


def split_text(texts: DataFrame, limit: int = 13) -> DataFrame:
    """Text rows cut into caption-sized pieces at clause marks, else near the limit, never inside a word.

    ``texts(video_id, seg_id, text, start_ms, end_ms)`` gives
    ``(video_id, seg_id, piece, text, seg_start_ms, seg_end_ms)``.
    """
    clean = F.btrim(normalize_text(F.col("text")), F.lit(EDGE_MARKS))
    rows = texts.select("video_id", "seg_id", clean.alias("_t"), F.col("start_ms").alias("seg_start_ms"), F.col("end_ms").alias("seg_end_ms"))
    rows = rows.filter((F.col("_t") != "") & (F.col("seg_end_ms") > F.col("seg_start_ms")))
    long_limit = max(42, limit)
    is_long = text_limit(F.col("_t"), limit) == long_limit
    clauses = F.transform(F.filter(F.split("_t", "(?<=[，。！？；,!?;])|(?<=\\.)(?!\\d)"), lambda c: c != ""), lambda c: F.btrim(c))
    pieces = F.when(is_long, F.flatten(F.transform(clauses, lambda c: _chunks(c, long_limit)))).otherwise(
        F.flatten(F.transform(clauses, lambda c: _chunks(c, limit))))
    return rows.select("video_id", "seg_id", F.posexplode(pieces).alias("piece", "text"), "seg_start_ms", "seg_end_ms")


def estimated_captions(texts: DataFrame, limit: int = 13, rows: int = 50_000) -> DataFrame:
    """Captions of text without token times: pieces sharing their segment by length."""
    return allocate_time(split_text(texts, limit), rows).withColumn("timestamp_source", F.lit("estimated_segment"))


def strip_marks(texts: DataFrame) -> DataFrame:
    """Punctuation runs with their position in the text without punctuation, row by row."""
    ship(texts.sparkSession)
    rows = spread(texts).select("video_id", "seg_id", F.col("text").cast("binary").alias("text"))

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches):
            row, pos, marks = _mark_runs(part.column("text"))
            own = pa.array(row)
            yield pa.RecordBatch.from_arrays([part.column("video_id").take(own), part.column("seg_id").take(own), pa.array(pos), marks], ["video_id", "seg_id", "pos", "mark"])

    return rows.mapInArrow(runs, f"{_key_ddl(texts)}, pos bigint, mark string")


def _stretches(batches: Iterator[pa.RecordBatch], most: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Batches in slices of about ``most`` bytes of text."""
    for batch in batches:
        sizes = np.cumsum(pc.binary_length(batch.column("text")).fill_null(0).to_numpy(zero_copy_only=False))
        cuts = [0, *(np.flatnonzero(np.diff(sizes // most)) + 1).tolist(), batch.num_rows]
        yield from (batch.slice(lo, hi - lo) for lo, hi in zip(cuts, cuts[1:]) if hi > lo)


def _mark_runs(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row, position and characters of every run of punctuation, over all texts at once."""
    decoded = [(t or b"").decode("utf-8", "replace") for t in texts.to_pylist()]
    sizes = np.array([len(t) for t in decoded], np.int64)
    points = np.frombuffer("".join(decoded).encode("utf-32-le"), np.uint32)
    marked = np.append(np.isin(np.arange(0x10000), [ord(c) for c in fixed.PUNCTUATION]), False)[np.minimum(points, 0x10000)]
    first = (np.cumsum(sizes) - sizes)[sizes > 0]
    opens = marked.copy()
    opens[1:] &= ~marked[:-1]
    opens[first] = marked[first]
    at = np.flatnonzero(opens)
    row = np.repeat(np.arange(len(sizes)), sizes)[at]
    content = np.append(0, np.cumsum(~marked))
    found = points[marked]
    widths = np.append(0, np.cumsum(1 + (found > 0x7F).astype(np.int64) + (found > 0x7FF)))
    offsets = np.append(widths[np.cumsum(marked)[at] - 1], widths[-1]).astype(np.int32)
    data = found.tobytes().decode("utf-32-le").encode()
    marks = pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)])
    return row, content[at] - content[(np.cumsum(sizes) - sizes)[row]], marks


def _fingerprint(pos: Column, char: Column) -> Column:
    return F.xxhash64(pos.cast("bigint"), F.lower(char))


def marks_by_chunk(texts: DataFrame, chunk: int) -> DataFrame:
    """Marks of each text as lists, those after the ``chunk`` characters of a chunk in one row."""
    ship(texts.sparkSession)
    rows = texts.select("video_id", "seg_id", F.col("text").cast("binary").alias("text"))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _stretches(batches):
            row, pos, marks = _mark_runs(part.column("text"))
            place = np.maximum(pos - 1, 0) // chunk
            first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (place[1:] != place[:-1]))[:len(row)])
            items = pa.StructArray.from_arrays([pa.array(pos), marks], ["pos", "mark"])
            own = pa.array(row[first])
            yield pa.RecordBatch.from_arrays([part.column("video_id").take(own), part.column("seg_id").take(own), pa.array(place[first]),
                                              pa.ListArray.from_arrays(pa.array(np.append(first, len(row)).astype(np.int32)), items)], ["video_id", "seg_id", "chunk", "_m"])

    return rows.mapInArrow(lists, f"{_key_ddl(texts)}, chunk bigint, _m array<struct<pos:bigint,mark:string>>")


def segment_captions(
    chars: DataFrame, texts: DataFrame, limit: int = 13, timestamp_source: str = "sensevoice_token", *,
    gap_ms: int = 380, longest_ms: int = 4200, rows: int = 50_000, lone_tail: bool = True, chunk: int = CHUNK_CHARS,
) -> DataFrame:
    """Timed characters grouped into captions.

    A caption ends at a strong mark, a pause, the length or duration limit, or the end of
    its segment, but never inside a word and, mark or pause, never on a single character.
    Segments without characters fall back to :func:`estimated_captions`.

    Marks come from the punctuated text where that, without its marks, spells the same characters; otherwise, or when it has none, from the spaces
    the tokens carried. Spelling is compared by count and a 64-bit fingerprint of positions and characters.

    Characters are gathered once, in chunks of ``chunk`` wherever these fall. Segments of one chunk are run at once, side by side. What a chunk of a longer
    one does depends on how many characters wait before it, up to the limit, beyond which they count alike; so it is run for each of these numbers at once,
    one walk links the numbers, and then each chunk is run from the right one. Captions over a cut are put together by their number.
    """
    ship(chars.sparkSession)
    key, most = ["video_id", "seg_id"], max(42, limit)
    chunk = max(chunk, most + 1)
    pos, char = F.col("pos").cast("bigint"), F.col("text")
    plain = F.ascii(char)
    word = F.when(plain.between(97, 122) | plain.between(65, 90), 1).when(plain.between(48, 57), 3).when(plain < 128, 0)
    kind = F.coalesce(word, F.when(is_word_char(char), 1).otherwise(0) + F.when(char.rlike("^\\p{N}"), 2).otherwise(0))
    placed = chars.select(*key, F.floor(pos / chunk).cast("bigint").alias("chunk"), pos.alias("pos"), char.alias("char"), F.col("start_ms").cast("bigint").alias("start_ms"),
                          F.col("end_ms").cast("bigint").alias("end_ms"), F.coalesce("prefix", F.lit("")).alias("prefix"), kind.cast("tinyint").alias("kind"), _fingerprint(pos, char).alias("_h"))
    dealt = placed.repartition(*key, "chunk").sortWithinPartitions(*key, "chunk", "pos")
    chunks = cut_lineage(dealt.mapInArrow(lambda batches: _gathered(batches, most), f"{_key_ddl(chars)}, {PACKED}, _held bigint, _h bigint"), "caption-chars")
    heard = chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("_parts"), F.sum("_held").alias("_cn"), F.bit_xor("_h").alias("_ch"))
    content = F.filter(F.split(F.regexp_replace("text", PUNCT_CLASS, ""), ""), lambda c: c != "")
    spelled = texts.select(*key, F.posexplode(content).alias("_at", "_char")).groupBy(*key).agg(
        F.count(F.lit(1)).alias("_tn"), F.bit_xor(_fingerprint(F.col("_at"), F.col("_char"))).alias("_th"))
    spans = texts.select(*key, F.col("start_ms").alias("seg_start_ms"), F.col("end_ms").alias("seg_end_ms"), text_limit(F.col("text"), limit).alias("_limit"), F.col("text").rlike(PUNCT_CLASS).alias("_has"))
    told = F.coalesce(F.col("_has") & (F.col("_tn") == F.col("_cn")) & (F.col("_th") == F.col("_ch")), F.lit(False))
    marks = marks_by_chunk(texts, chunk)
    spans = spans.join(heard, key).join(spelled, key, "left").select(*key, "seg_start_ms", "seg_end_ms", "_limit", "_parts", told.alias("_told"))
    # A told text whose characters are one chunk has all its marks in chunk 0.
    spans = spans.join(marks.filter("chunk = 0").select(*key, "_m"), key, "left")
    spans = cut_lineage(spans, "caption-spans")
    held = chunks.drop("_h").join(spans.hint("merge"), key)
    alone = F.lit(None).cast(held.schema["_first"].dataType).alias("_next"), F.array().cast("array<bigint>").alias("_lead")
    whole = held.filter("_parts = 1").select("*", *alone)
    kinds = {f.name: f.dataType.simpleString() for f in held.schema.fields}
    made_ddl = ", ".join(f"{c} {kinds[c]}" for c in (*key, "chunk", "seg_start_ms", "seg_end_ms", "_limit")) + ", piece bigint, s bigint, e bigint, n bigint, text string"

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 500) for at in range(0, batch.num_rows, 500)):
                run = _Chunks(part, gap_ms, longest_ms)
                _, _, number = run.through(np.arange(part.num_rows), part.column("entry").to_numpy())
                row = np.repeat(np.arange(part.num_rows), run.size)
                number = number + part.column("before").to_numpy()[row]
                first = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (number[1:] != number[:-1]))[:len(row)])
                last = np.append(first[1:], len(row)) - 1
                own = pa.array(row[first])
                yield pa.RecordBatch.from_arrays([
                    *(part.column(c).take(own) for c in (*key, "chunk", "seg_start_ms", "seg_end_ms", "_limit")), pa.array(number[first]), pa.array(run.start[first]), pa.array(run.end[last]),
                    pa.array(run.after[last], mask=run.final[last]), run.texts(first)],
                    [*key, "chunk", "seg_start_ms", "seg_end_ms", "_limit", "piece", "s", "e", "n", "text"])

    none = F.lit(0).cast("bigint")
    made = whole.withColumn("entry", none).withColumn("before", none).mapInArrow(pieces, made_ddl)
    ended = made.select(*key, "piece", F.col("s").alias("_s"), F.col("e").alias("_e"), F.col("n").alias("_n"), "seg_start_ms", "seg_end_ms", "_limit", F.col("text").alias("_text"))
    longer = held.filter("_parts > 1")
    if not spans.filter("_parts > 1").isEmpty():
        ended = ended.unionByName(_over_cuts(longer.drop("_m").join(marks, [*key, "chunk"], "left"), key, rows, gap_ms, longest_ms, pieces, made_ddl))
    start = F.greatest(F.col("seg_start_ms"), F.col("_s") - 30)
    end = F.least(F.col("seg_end_ms"), F.col("_e") + 120, F.coalesce(F.col("_n") - 30, F.col("seg_end_ms")))
    timed = ended.select(*key, "piece", F.btrim("_text").alias("text"), start.alias("start_ms"), F.least(F.col("seg_end_ms"), F.greatest(start + 60, end)).alias("end_ms"), "_limit")
    if lone_tail:
        timed = merge_short_tail(cut_lineage(timed, "timed-captions"), "_limit", rows)
    timed = timed.select(*key, "piece", "text", "start_ms", "end_ms", F.lit(timestamp_source).alias("timestamp_source"))
    silent = texts.join(heard.select(*key), key, "left_anti")
    return timed.unionByName(estimated_captions(silent, limit, rows).withColumn("piece", F.col("piece").cast("bigint")))


#: A chunk of characters, its columns packed, with its first character and its last starts for the chunks beside it.
PACKED = ("chunk bigint, _pos binary, _starts binary, _ends binary, _kind binary, _char string, _char_sizes binary, _prefix string, _prefix_sizes binary, "
          "_first struct<pos:bigint,start_ms:bigint,prefix:string,kind:tinyint>, _tail array<bigint>")


def _gathered(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted characters as one row a chunk with their number and fingerprint; a chunk is held until the next one begins."""
    keys, held = ["video_id", "seg_id", "chunk"], None

    def rows(part: pa.RecordBatch, first: np.ndarray) -> pa.RecordBatch:
        ends, own = np.append(first, part.num_rows), pa.array(first)
        columns = {k: part.column(k).take(own) for k in keys}
        for name, column in (("_pos", "pos"), ("_starts", "start_ms"), ("_ends", "end_ms"), ("_kind", "kind")):
            columns[name] = _packed(part.column(column).to_numpy(), ends)
        for name, column in (("_char", "char"), ("_prefix", "prefix")):
            data, offsets = _bytes_of(pc.fill_null(part.column(column), ""))
            columns[name] = pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets[ends].astype(np.int32)), pa.py_buffer(data)])
            columns[f"{name}_sizes"] = _packed(np.diff(offsets).astype(np.int32), ends)
        columns["_first"] = pa.StructArray.from_arrays([part.column(c).take(own) for c in ("pos", "start_ms", "prefix", "kind")], ["pos", "start_ms", "prefix", "kind"])
        sizes = np.minimum(np.diff(ends), most)
        cuts = np.append(0, np.cumsum(sizes))
        tail = np.arange(cuts[-1]) + np.repeat(ends[1:] - cuts[1:], sizes)
        columns["_tail"] = pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), part.column("start_ms").take(pa.array(tail)))
        columns["_held"], columns["_h"] = pa.array(np.diff(ends)), pa.array(np.bitwise_xor.reduceat(part.column("_h").to_numpy(), first))
        return pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    for batch in batches:
        part = batch if held is None else pa.concat_batches([held, batch])
        if part.num_rows == 0:
            continue
        new = np.ones(part.num_rows, bool)
        new[1:] = np.logical_or.reduce([pc.fill_null(pc.not_equal(c[1:], c[:-1]), True).to_numpy(zero_copy_only=False) for c in (part.column(k) for k in keys)])
        first = np.flatnonzero(new)
        cut = int(first[-1])
        if cut:
            yield rows(part.slice(0, cut), first[:-1])
        held = part.slice(cut)
    if held is not None and held.num_rows:
        yield rows(held, np.array([0]))


def _over_cuts(chunks: DataFrame, key: list[str], rows: int, gap_ms: int, longest_ms: int, pieces, made_ddl: str) -> DataFrame:
    """Captions of segments of several chunks."""
    chunks = ordered(cut_lineage(chunks, "caption-cuts"), key, ["chunk"], by_position("chunk", rows), is_last="_last", lead={"_next": F.col("_first")}, lag={"_lead": F.col("_tail")})
    chunks = cut_lineage(chunks.withColumn("_lead", F.coalesce("_lead", F.array().cast("array<bigint>"))), "caption-items")

    def transitions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(at, 200) for at in range(0, batch.num_rows, 200)):
                run = _Chunks(part, gap_ms, longest_ms)
                size = run.limit + 1
                lane = np.repeat(np.arange(part.num_rows), size)
                entry = np.arange(len(lane)) - np.repeat(np.cumsum(size) - size, size)
                waiting, breaks, _ = run.through(lane, entry)
                cuts = np.concatenate([[0], np.cumsum(size)]).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(cuts), pa.array(x.astype(np.int64))) for x in (waiting, breaks)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in (*key, "chunk")), *lists], [*key, "chunk", "exits", "breaks"])

    ddl = _key_ddl(chunks)
    passed = chunks.filter("NOT _last").mapInArrow(transitions, f"{ddl}, chunk bigint, exits array<bigint>, breaks array<bigint>")
    linked = cut_lineage(passed.repartition(*key).sortWithinPartitions(*key, "chunk").mapInPandas(_entries, f"{ddl}, chunk bigint, entry bigint, before bigint"), "caption-entries")
    placed = chunks.join(linked, [*key, "chunk"], "left").withColumn("entry", F.coalesce("entry", F.lit(0))).withColumn("before", F.coalesce("before", F.lit(0)))
    made = placed.mapInArrow(pieces, made_ddl)
    return made.groupBy(*key, "piece").agg(
        F.min_by("s", "chunk").alias("_s"), F.max_by("e", "chunk").alias("_e"), F.max_by(F.struct("n"), F.col("chunk"))["n"].alias("_n"), F.first("seg_start_ms").alias("seg_start_ms"),
        F.first("seg_end_ms").alias("seg_end_ms"), F.first("_limit").alias("_limit"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), "").alias("_text"))


def _key_ddl(chars: DataFrame) -> str:
    return ", ".join(f"{c} {chars.schema[c].dataType.simpleString()}" for c in ("video_id", "seg_id"))


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Stretches of an array as bytes."""
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a column without nulls, and where each value begins and ends in them."""
    column = column.cast(pa.binary())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset:column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0]:offsets[-1]], offsets - offsets[0]


def _strings(data: pa.Array, sizes: pa.Array) -> pa.Array:
    """Strings that were put together, by their sizes."""
    cuts = np.append(0, np.cumsum(_bytes_of(sizes)[0].view(np.int32), dtype=np.int64)).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(cuts) - 1, [None, pa.py_buffer(cuts), pa.py_buffer(_bytes_of(data)[0])])


class _Chunks:
    """Chunks of characters as columns, and the rule for captions run over all of them side by side."""

    def __init__(self, rows: pa.RecordBatch, gap_ms: int, longest_ms: int):
        after, self.longest_ms = rows.column("_next"), longest_ms
        self.size = rows.column("_held").to_numpy()
        self.begin = np.cumsum(self.size) - self.size
        pos, self.start, self.end = (_bytes_of(rows.column(c))[0].view(np.int64) for c in ("_pos", "_starts", "_ends"))
        kind = _bytes_of(rows.column("_kind"))[0].view(np.int8)
        self.char, self.prefix = (_strings(rows.column(c), rows.column(f"{c}_sizes")) for c in ("_char", "_prefix"))
        last = self.begin + self.size - 1

        def following(own: np.ndarray, name: str) -> np.ndarray:
            """The same value of the character after each."""
            out = np.append(own[1:], own[:1])
            out[last] = pc.struct_field(after, name).fill_null(0).to_numpy(zero_copy_only=False)
            return out

        self.after = following(self.start, "start_ms")
        self.final = np.zeros(len(pos), bool)
        self.final[last] = after.is_null().to_numpy(zero_copy_only=False)
        self._mark(rows, pos, following(pos, "pos"), last)
        joint = np.array([1 if m in ("", "'", "’", "-") else 2 if m == "." else 0 for m in self.names])[self.mark]
        strong = np.array([any(c in fixed.STRONG_MARKS for c in m) for m in self.names])[self.mark]
        both = kind & following(kind, "kind")
        self.boundary = self.final | ~(((both & 1) > 0) & ((joint == 1) | ((joint == 2) & ((both & 2) > 0))))
        self.signal = self.final | strong | (self.after - self.end >= gap_ms)
        self.limit = rows.column("_limit").to_numpy(zero_copy_only=False).astype(np.int64)
        lead = rows.column("_lead")
        self.lead_size = lead.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        self.lead_end, self.lead = np.cumsum(self.lead_size), lead.flatten().to_numpy(zero_copy_only=False)

    def _mark(self, rows: pa.RecordBatch, pos: np.ndarray, next_pos: np.ndarray, last: np.ndarray) -> None:
        """Number of the mark after each character, and before the first of a segment: the text's where it is told, else what the next one carries."""
        told, lists, n = rows.column("_told").to_numpy(zero_copy_only=False), rows.column("_m"), len(pos)
        written = lists.flatten()
        coded = pa.concat_arrays([pa.array([""]), self.prefix, pc.struct_field(rows.column("_next"), "prefix").fill_null(""), written.field("mark")]).dictionary_encode()
        self.names, code = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        own, carried, code = code[1:n + 1], np.append(code[2:n + 1], code[:1])[:n], code[n + 1:]
        carried[last] = code[:len(last)]
        row = np.repeat(np.arange(len(last)), self.size)
        spaced = ~told[row]
        self.mark = np.where(spaced & (next_pos == pos + 1) & ~self.final, carried, 0)
        self.head = np.where(spaced & (pos == 0), own, 0)
        at_row = np.repeat(np.arange(len(last)), lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at, code = written.field("pos").to_numpy(zero_copy_only=False).astype(np.int64), code[len(last):]
        wide = max(int(pos.max(initial=0)), int(at.max(initial=0))) + 2
        for names, target in ((self.mark, at - 1), (self.head, np.where(at == 0, 0, -1))):
            found = np.searchsorted(row * wide + pos, at_row * wide + target)
            there = told[at_row] & (target >= 0) & (found < n)
            there[there] = (row * wide + pos)[found[there]] == (at_row * wide + target)[there]
            names[found[there]] = code[there]

    def texts(self, first: np.ndarray) -> pa.Array:
        """The captions that begin at ``first`` and reach to the next one, with their marks."""
        names = pa.array(self.names, pa.string())
        joined = pc.binary_join_element_wise(names.take(pa.array(self.head)), self.char, names.take(pa.array(self.mark)), "")
        _, offsets, data = joined.buffers()
        offsets = np.frombuffer(offsets, np.int32)[joined.offset:joined.offset + len(joined) + 1]
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(np.append(offsets[first], offsets[-1]).astype(np.int32)), data])

    def through(self, chunk: np.ndarray, waiting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many characters wait after each run and how many captions ended in it; with one run a chunk, also the number of each character's caption."""
        limit = self.limit[chunk]
        waiting, breaks, began = np.minimum(waiting, limit), np.zeros(len(chunk), np.int64), np.zeros(len(chunk), np.int64)
        known = (waiting > 0) & (waiting <= self.lead_size[chunk])
        began[known] = self.lead[self.lead_end[chunk[known]] - waiting[known]]
        number = np.zeros(len(self.start), np.int64)
        for t in range(int(self.size[chunk].max(initial=0))):
            live = np.flatnonzero(self.size[chunk] > t)
            at = self.begin[chunk[live]] + t
            n = waiting[live] + 1
            began[live] = np.where(n == 1, self.start[at], began[live])
            full = (n >= limit[live]) | self.final[at]
            enough = (n >= 2) & (self.signal[at] | (self.end[at] - began[live] >= self.longest_ms))
            broken = self.boundary[at] & (full | enough)
            number[at] = breaks[live]
            breaks[live] += broken
            waiting[live] = np.where(broken, 0, np.minimum(n, limit[live]))
        return waiting, breaks, number


def _entries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """How many characters wait before each chunk but a segment's first, and how many captions ended earlier; rows come in order, one number is held."""
    segment, waiting, before = None, 0, 0
    for frame in frames:
        out = []
        for video, seg, chunk, exits, breaks in frame.itertuples(index=False):
            if (video, seg) != segment:
                segment, waiting, before = (video, seg), 0, 0
            before += int(breaks[waiting])
            waiting = int(exits[waiting])
            out.append((video, seg, chunk + 1, waiting, before))
        yield pd.DataFrame(out, columns=["video_id", "seg_id", "chunk", "entry", "before"])


def merge_short_tail(captions: DataFrame, limit: str | int = 13, rows: int = 50_000) -> DataFrame:
    """A segment's last caption of at most one character joins the one before, if that stays near the limit."""
    key = ["video_id", "seg_id"]
    cap = F.col(limit) if isinstance(limit, str) else F.lit(limit)
    lone = F.length(F.regexp_replace("text", PUNCT_CLASS, "")) <= 1
    w = ordered(captions, key, ["piece"], by_position("piece", rows), number="_at", is_last="_last",
                lag={"_before": F.length("text")}, lead={"_tail": F.col("text"), "_tail_end": F.col("end_ms")}, total={"_all": F.lit(1)})
    goes = F.col("_last") & (F.col("_at") > 0) & lone & (F.col("_before") + F.length("text") <= cap + 3)
    tail_lone = F.length(F.regexp_replace("_tail", PUNCT_CLASS, "")) <= 1
    takes = F.coalesce((F.col("_at") == F.col("_all") - 2) & tail_lone & (F.length("text") + F.length("_tail") <= cap + 3), F.lit(False))
    seam = F.concat(F.substring(F.col("text"), -1, 1), F.substring(F.col("_tail"), 1, 1))
    joined = F.concat(F.col("text"), F.when(seam.rlike("[A-Za-z]"), " ").otherwise(""), F.col("_tail"))
    replaced = {"text": F.when(takes, joined).otherwise(F.col("text")), "end_ms": F.when(takes, F.col("_tail_end")).otherwise(F.col("end_ms"))}
    return w.filter(~goes).select(*[replaced.get(c, F.col(c)).alias(c) for c in captions.columns])


def gap_captions(tokens: DataFrame, gap_ms: int = 380, by: list[str] | None = None, span_ms: int = 3_600_000) -> DataFrame:
    """Tokens ``(…, id, start_ms, end_ms)`` grouped at pauses alone: first start, last end and count per group."""
    by = by or ["video_id"]
    t = ordered(tokens, by, ["start_ms", "id"], EvenTime("start_ms", span_ms), lag={"_prev_end": F.col("end_ms")})
    opens = F.when(F.coalesce(F.col("start_ms") - F.col("_prev_end") >= gap_ms, F.lit(True)), 1).otherwise(0)
    t = ordered(t.withColumn("_opens", opens), by, ["start_ms", "id"], EvenTime("start_ms", span_ms), before={"_past": F.col("_opens")})
    group = F.col("_past") + F.col("_opens") - 1
    return t.groupBy(*by, group.alias("piece")).agg(
        F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.count(F.lit(1)).alias("n_tokens"))
