"""Interval tables on a timeline: repair, overlaps, padding, token and character times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable.functions.text import clean_token, content_chars
from cuetable.functions.timing import div, round_div
from cuetable.plans.ordered import EvenTime, by_position, ordered

SPAN_MS = 3_600_000


def normalize_timeline(captions: DataFrame, media: DataFrame | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """Captions in the order of their own times, without overlaps.

    Starts at 0 or later, 200 ms long at least, overlaps cut at their midpoint (10 ms
    apart), ends no later than the media, ids renumbered. A row's raw end never depends
    on its neighbours, so one pass with the previous end and the next start is enough.
    """
    rows = captions.filter(F.coalesce(F.col("text"), F.lit("")) != "")
    start = F.greatest(F.lit(0), F.col("start_ms"))
    end = F.greatest(start + 200, F.col("end_ms"))
    if media is not None:
        rows = rows.join(media.select("video_id", "duration_ms"), "video_id", "left")
        end = F.least(end, F.col("duration_ms"))
    rows = rows.select(*captions.columns, F.col("start_ms").alias("_raw_s"), F.col("end_ms").alias("_raw_e"), start.alias("_s"), end.alias("_e"))
    rows = ordered(rows, ["video_id"], ["_raw_s", "_raw_e", "id"], EvenTime("_raw_s", span_ms), number="_id",
                   lag={"_prev_e": F.col("_e")}, lead={"_next_s": F.col("_s")})
    s, e = F.col("_s"), F.col("_e")
    new_start = F.when(s < F.col("_prev_e"), div(s + F.col("_prev_e") + 1, 2)).otherwise(s)
    boundary = div(F.col("_next_s") + e + 1, 2)
    new_end = F.when(F.col("_next_s") < e, F.greatest(new_start + 200, boundary - 10)).otherwise(e)
    replaced = {"id": F.col("_id"), "start_ms": new_start, "end_ms": new_end}
    return rows.select(*[replaced.get(c, F.col(c)).alias(c) for c in captions.columns])


def overlaps(captions: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Selected captions starting more than 20 ms before the previous one ends."""
    rows = captions.filter(_selected(captions))
    rows = ordered(rows, ["video_id"], ["start_ms", "id"], EvenTime("start_ms", span_ms),
                   number="position", lag={"prev_end_ms": F.col("end_ms")})
    return rows.filter(F.col("start_ms") < F.col("prev_end_ms") - 20)


def _selected(captions: DataFrame) -> Column:
    return F.coalesce(F.col("selected"), F.lit(True)) if "selected" in captions.columns else F.lit(True)


def renumber(rows: DataFrame, by: list[str], order: list[str], chunk: Column | None, name: str = "id") -> DataFrame:
    """Rows with a dense 0-based number in the given order."""
    return ordered(rows.drop(name) if name not in order else rows.withColumnRenamed(name, f"_{name}"),
                   by, [f"_{c}" if c == name else c for c in order], chunk, number=name).drop(f"_{name}")


def timeline_order(captions: DataFrame) -> DataFrame:
    """Captions with text, sorted by video, start and end."""
    return (captions.filter(F.btrim(F.coalesce(F.col("text"), F.lit(""))) != "")
            .orderBy("video_id", "start_ms", "end_ms", "id"))


def pad_regions(
    regions: DataFrame, media: DataFrame, pad_ms: int = 200, retry_ms: int = 250, span_ms: int = SPAN_MS,
) -> DataFrame:
    """Speech regions widened on both sides, up to the media and halfway to their neighbours.

    ``retry_*`` widens once more, held by the media alone.
    """
    rows = ordered(regions, ["video_id"], ["start_ms", "region_id"], EvenTime("start_ms", span_ms),
                   lag={"_prev_end": F.col("end_ms")}, lead={"_next_start": F.col("start_ms")})
    rows = rows.join(media.select("video_id", "duration_ms"), "video_id")
    start, end = F.col("start_ms"), F.col("end_ms")
    padded_start = F.greatest(F.lit(0), start - pad_ms, div(F.col("_prev_end") + start, 2))
    padded_end = F.least(F.col("duration_ms"), end + pad_ms, div(end + F.col("_next_start"), 2))
    rows = rows.select("video_id", "region_id", padded_start.alias("start_ms"), padded_end.alias("end_ms"), "duration_ms")
    return rows.select(
        "video_id", "region_id", "start_ms", "end_ms",
        F.greatest(F.lit(0), F.col("start_ms") - retry_ms).alias("retry_start_ms"),
        F.least(F.col("duration_ms"), F.col("end_ms") + retry_ms).alias("retry_end_ms"))


def _usable(tokens: DataFrame, segments: DataFrame) -> DataFrame:
    """Tokens with content, cleaned, their starts held inside the segment."""
    spans = segments.select("video_id", "seg_id", F.col("start_ms").alias("seg_start_ms"),
                            F.col("end_ms").alias("seg_end_ms"))
    return (tokens.withColumn("text", clean_token(F.col("text")))
            .filter(content_chars(F.col("text")) != "")
            .join(spans, ["video_id", "seg_id"])
            .withColumn("start_ms", F.greatest(F.col("seg_start_ms"), F.least(F.col("seg_end_ms"), F.col("start_ms")))))


def typical_step(
    tokens: DataFrame, low_ms: int = 35, high_ms: int = 800, default_ms: float = 180.0, rows: int = 50_000,
) -> DataFrame:
    """Median gap between token starts per segment, over the gaps in range."""
    gaps = ordered(tokens, ["video_id", "seg_id"], ["pos"], by_position("pos", rows),
                   lead={"_next": F.col("start_ms")})
    return _median_gap(gaps, low_ms, high_ms, default_ms)


def _median_gap(gaps: DataFrame, low_ms: int, high_ms: int, default_ms: float) -> DataFrame:
    gap = F.col("_next") - F.col("start_ms")
    usable = F.when(gap.between(low_ms, high_ms), gap)
    return (gaps.groupBy("video_id", "seg_id")
            .agg(F.coalesce(F.median(usable), F.lit(float(default_ms))).alias("typical_ms")))


def token_intervals(
    tokens: DataFrame, segments: DataFrame, *, close_ms: int = 500, low_ms: int = 35, high_ms: int = 800,
    default_ms: float = 180.0, shortest_ms: int = 120, longest_ms: int = 380, floor_ms: int = 60, rows: int = 50_000,
) -> DataFrame:
    """Token starts turned into intervals inside their segment.

    A token runs to the next one when that is close; otherwise for 1.65 typical steps,
    within limits.
    """
    usable = ordered(_usable(tokens, segments), ["video_id", "seg_id"], ["pos"], by_position("pos", rows),
                     lead={"_next": F.col("start_ms")})
    typical = _median_gap(usable, low_ms, high_ms, default_ms)
    timed = usable.join(typical, ["video_id", "seg_id"])
    start, seg_end = F.col("start_ms"), F.col("seg_end_ms")
    guess = F.greatest(F.lit(shortest_ms), F.least(F.lit(longest_ms), F.round(F.col("typical_ms") * 1.65, 0))).cast("bigint")
    end = F.when(F.col("_next") - start <= close_ms, F.col("_next")).otherwise(F.least(seg_end, start + guess))
    return timed.select("video_id", "seg_id", "pos", "text", "start_ms",
                        F.greatest(start + floor_ms, F.least(seg_end, end)).alias("end_ms"))


def word_intervals(words: DataFrame, segments: DataFrame, floor_ms: int = 60, tail_ms: int = 20) -> DataFrame:
    """Intervals of words that already carry both times, held inside their segment."""
    spans = segments.select("video_id", "seg_id", F.col("start_ms").alias("_s"), F.col("end_ms").alias("_e"))
    start = F.greatest(F.col("_s"), F.least(F.col("_e"), F.col("start_ms")))
    end = F.greatest(start + floor_ms, F.least(F.col("_e"), F.coalesce("end_ms", "start_ms") + tail_ms))
    return (words.filter(content_chars(F.col("text")) != "").join(spans, ["video_id", "seg_id"])
            .select("video_id", "seg_id", "pos", "text", start.alias("start_ms"), end.alias("end_ms")))


def expand_chars(intervals: DataFrame) -> DataFrame:
    """One row per content character, sharing its token's interval equally."""
    content = content_chars(F.col("text"))
    length = F.greatest(F.lit(1), F.col("end_ms") - F.col("start_ms"))
    rows = intervals.filter(content != "").select(
        "video_id", "seg_id", F.col("pos").alias("token_pos"), "start_ms", length.alias("_len"),
        F.length(content).alias("_n"), F.startswith(F.col("text"), F.lit(" ")).alias("_spaced"),
        F.posexplode(F.filter(F.split(content, ""), lambda c: c != "")).alias("char_pos", "text"))
    at = F.col("char_pos")
    return rows.select(
        "video_id", "seg_id", "token_pos", "char_pos", "text",
        (F.col("start_ms") + round_div(F.col("_len") * at, F.col("_n"))).alias("start_ms"),
        (F.col("start_ms") + round_div(F.col("_len") * (at + 1), F.col("_n"))).alias("end_ms"),
        F.when((at == 0) & F.col("_spaced"), F.lit(" ")).otherwise(F.lit("")).alias("prefix"))


def number_chars(chars: DataFrame, rows: int = 50_000) -> DataFrame:
    """Characters of :func:`expand_chars` with their dense position in the segment."""
    return (ordered(chars, ["video_id", "seg_id"], ["token_pos", "char_pos"], by_position("token_pos", rows), number="pos")
            .select("video_id", "seg_id", "pos", "text", "start_ms", "end_ms", "prefix"))


def allocate_time(pieces: DataFrame, rows: int = 50_000) -> DataFrame:
    """A span shared among its text pieces in proportion to their length.

    ``pieces(video_id, seg_id, piece, text, seg_start_ms, seg_end_ms)``; the pieces tile the span.
    """
    size = F.length("text")
    out = ordered(pieces, ["video_id", "seg_id"], ["piece"], by_position("piece", rows),
                  before={"_done": size}, total={"_all": size}, is_last="_last")
    span = F.col("seg_end_ms") - F.col("seg_start_ms")
    whole = F.greatest(F.lit(1), F.col("_all"))
    at = lambda chars: F.col("seg_start_ms") + round_div(span * chars, whole)
    return out.select(
        "video_id", "seg_id", "piece", "text", at(F.col("_done")).alias("start_ms"),
        F.when(F.col("_last"), F.col("seg_end_ms")).otherwise(at(F.col("_done") + size)).alias("end_ms"))


def nearest_gap(points: DataFrame, by: list[str] | None = None, span_ms: int = SPAN_MS) -> DataFrame:
    """Each point with its distance to the nearest neighbour on either side."""
    rows = ordered(points, by or ["video_id"], ["time_ms", "id"], EvenTime("time_ms", span_ms),
                   lag={"_prev": F.col("time_ms")}, lead={"_next": F.col("time_ms")})
    return rows.select(*points.columns, F.least(F.col("time_ms") - F.col("_prev"), F.col("_next") - F.col("time_ms")).alias("nearest_ms"))


def first_distinct(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Keys in order of first appearance."""
    return rows.groupBy(key).agg(F.min(position).alias("first_position"))
