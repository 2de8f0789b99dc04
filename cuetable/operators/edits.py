"""The edit list: clips of a source laid end to end, and cuts that ripple through a project."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.timing import remap, snap_to_frame
from cuetable.operators.markers import with_duration
from cuetable.plans.folders import cut_lineage
from cuetable.plans.ordered import by_position, by_time, ordered
from cuetable.plans.ranges import point_join
from cuetable.plans.shipping import ship

BIN_MS = 600_000


def normalize_clips(clips: DataFrame, media: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid clips, and the videos whose list is rejected.

    ``media`` carries ``has_edit``: without an edit list a video is one clip over its whole
    source, an empty list stays empty. One bad clip rejects the video's whole list.
    """
    start, end, length = F.col("src_start_ms"), F.col("src_end_ms"), F.col("duration_ms")
    finite = [c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")) for c in (start, end)]
    good = F.coalesce(finite[0] & finite[1] & (start >= 0) & (start < length) & (end > start) & (end <= length + 50),
                      F.lit(False))
    edited = media.filter(F.col("has_edit")).select("video_id", "duration_ms")
    rows = clips.join(edited, "video_id").withColumn("_good", good)
    rejected = rows.filter(~F.col("_good")).groupBy("video_id").agg(F.count(F.lit(1)).alias("bad_clips"))
    kept = rows.join(rejected, "video_id", "left_anti").select(
        "video_id", F.col("ord").cast("int").alias("ord"), F.coalesce(F.col("clip_id"), F.col("ord").cast("string")).alias("clip_id"),
        start.cast("bigint").alias("src_start_ms"), F.least(end, length).cast("bigint").alias("src_end_ms"))
    whole = media.filter(~F.col("has_edit")).select(
        "video_id", F.lit(0).cast("int").alias("ord"), F.lit("original").alias("clip_id"),
        F.lit(0).cast("bigint").alias("src_start_ms"), length.cast("bigint").alias("src_end_ms"))
    return kept.unionByName(whole), rejected


def edit_duration(clips: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """Edited length per video; 0 for the given videos without clips."""
    lengths = clips.groupBy("video_id").agg(F.sum(F.col("src_end_ms") - F.col("src_start_ms")).alias("edit_ms"))
    if videos is None:
        return lengths
    return videos.select("video_id").join(lengths, "video_id", "left").select(
        "video_id", F.coalesce("edit_ms", F.lit(0)).alias("edit_ms"))


def layout(clips: DataFrame, rows: int = 50_000, totals: bool = False) -> DataFrame:
    """Clips with their place on the edited timeline."""
    size = F.col("src_end_ms") - F.col("src_start_ms")
    out = ordered(clips, ["video_id"], ["ord"], by_position("ord", rows), before={"out_start_ms": size},
                  total={"edit_ms": size} if totals else None)
    return out.withColumn("out_end_ms", F.col("out_start_ms") + size)


def is_contiguous(clips: DataFrame, media: DataFrame, rows: int = 50_000) -> DataFrame:
    """Whether a video's clips are its source uncut, so that no new encode is needed."""
    out = ordered(clips, ["video_id"], ["ord"], by_position("ord", rows),
                  lag={"_prev": F.col("src_end_ms")}, lead={"_next": F.col("src_start_ms")})
    joined = out.join(media.select("video_id", "duration_ms"), "video_id")
    meets = F.coalesce(F.col("_prev"), F.lit(0)) == F.col("src_start_ms")
    reaches = F.col("_next").isNotNull() | (F.abs(F.col("src_end_ms") - F.col("duration_ms")) < 50)
    return joined.groupBy("video_id").agg(F.bool_and(meets & reaches).alias("contiguous"))


def locate(times: DataFrame, clips: DataFrame, bin_ms: int = BIN_MS, rows: int = 50_000) -> DataFrame:
    """Clip and source time shown at each edited time ``t_ms``; times are held to the timeline."""
    laid = layout(clips, rows).select("video_id", "ord", "clip_id", "src_start_ms", "out_start_ms", "out_end_ms")
    held = times.join(edit_duration(clips), "video_id").withColumn(
        "_t", F.greatest(F.lit(0), F.least(F.col("edit_ms"), F.col("t_ms"))))
    held = held.withColumn("_at", F.least(F.col("_t"), F.col("edit_ms") - 1))
    found = point_join(held, laid, ["video_id"], "_at", ("out_start_ms", "out_end_ms"), bin_ms)
    inside = F.least(F.col("out_end_ms") - F.col("out_start_ms"), F.col("_t") - F.col("out_start_ms"))
    return found.select(*times.columns, "ord", "clip_id", (F.col("src_start_ms") + inside).alias("source_ms"))


def to_output_time(source_times: DataFrame, clips: DataFrame, rows: int = 50_000) -> DataFrame:
    """Edited time of a source time ``src_ms`` inside the clip numbered ``ord``; 0 if there is no such clip."""
    laid = layout(clips, rows).select("video_id", "ord", "src_start_ms", "out_start_ms", "out_end_ms")
    inside = F.greatest(F.lit(0), F.least(F.col("out_end_ms") - F.col("out_start_ms"), F.col("src_ms") - F.col("src_start_ms")))
    return (source_times.join(laid, ["video_id", "ord"], "left")
            .select(*source_times.columns, F.coalesce(F.col("out_start_ms") + inside, F.lit(0)).alias("t_ms")))


def _with_cut(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    spans = cuts.select("video_id", F.col("cut_start_ms").alias("_s"), F.col("cut_end_ms").alias("_e"))
    return rows.join(spans, "video_id", "left")


def _kept(rows: DataFrame, columns: list[str], **replaced: Column) -> DataFrame:
    return rows.select(*[replaced.get(c, F.col(c)).alias(c) for c in columns])


def cut_clips(clips: DataFrame, cuts: DataFrame, rows: int = 50_000) -> DataFrame:
    """Clips after one cut of the edited timeline per video: each leaves up to two pieces."""
    laid = _with_cut(layout(clips, rows), cuts)
    s, e, a, b = F.col("_s"), F.col("_e"), F.col("out_start_ms"), F.col("out_end_ms")
    start, end, name = F.col("src_start_ms"), F.col("src_end_ms"), F.col("clip_id")

    def piece(order, exists, clip_id, src_start, src_end):
        return F.struct(F.lit(order).alias("part"), exists.alias("exists"), clip_id.alias("clip_id"),
                        src_start.alias("src_start_ms"), src_end.alias("src_end_ms"))

    untouched = s.isNull() | (b <= s) | (a >= e)
    pieces = F.when(untouched, F.array(piece(0, F.lit(True), name, start, end))).otherwise(F.array(
        piece(0, a < s, name, start, start + s - a),
        piece(1, b > e, F.concat(name, F.lit("-r")), start + e - a, end)))
    cut = laid.select("video_id", F.col("ord").alias("_ord"), F.explode(F.filter(pieces, lambda p: p["exists"])).alias("p"))
    cut = cut.select("video_id", "_ord", "p.part", "p.clip_id", "p.src_start_ms", "p.src_end_ms")
    out = ordered(cut, ["video_id"], ["_ord", "part"], by_position("_ord", rows), number="ord")
    return out.select("video_id", F.col("ord").cast("int").alias("ord"), "clip_id", "src_start_ms", "src_end_ms")


def cut_captions(captions: DataFrame, cuts: DataFrame) -> DataFrame:
    """Captions after the cut; what is left under 30 ms goes, what the cut touched is flagged."""
    rows = _with_cut(captions, cuts)
    s, e = F.col("_s"), F.col("_e")
    touched = F.coalesce((F.col("start_ms") < e) & (F.col("end_ms") > s), F.lit(False))
    moved = rows.select("*", _moved("start_ms").alias("_a"), _moved("end_ms").alias("_b"), touched.alias("_touched"))
    flag = F.col("_touched") | (F.coalesce(F.col("edit_review"), F.lit(False)) if "edit_review" in captions.columns else F.lit(False))
    columns = captions.columns + ([] if "edit_review" in captions.columns else ["edit_review"])
    return _kept(moved.filter(s.isNull() | (F.col("_b") - F.col("_a") >= 30)), columns,
                 start_ms=F.col("_a"), end_ms=F.col("_b"), edit_review=flag)


def _moved(col: str) -> Column:
    return F.when(F.col("_s").isNull(), F.col(col)).otherwise(remap(F.col(col), F.col("_s"), F.col("_e")))


def cut_markers(markers: DataFrame, cuts: DataFrame, catalog: DataFrame | None = None) -> DataFrame:
    """Markers after the cut: one whose start is cut goes, one running into it is shortened."""
    if catalog is not None:
        markers = with_duration(markers, catalog)
    rows = _with_cut(markers, cuts)
    s, e, at = F.col("_s"), F.col("_e"), F.col("time_ms")
    length = F.coalesce(F.col("duration_ms"), F.lit(fixed.DEFAULT_EFFECT_MS).cast("bigint"))
    shortened = F.when((at < s) & (at + length > s), s - at).otherwise(length)
    rows = rows.select("*", shortened.alias("_len"))
    kept = rows.filter(s.isNull() | (~((at >= s) & (at < e)) & (F.col("_len") >= 80)))
    return _kept(kept, markers.columns, time_ms=_moved("time_ms"),
                 duration_ms=F.when(s.isNull(), F.col("duration_ms")).otherwise(F.col("_len")))


def cut_samples(samples: DataFrame, cuts: DataFrame) -> DataFrame:
    rows = _with_cut(samples, cuts)
    inside = F.coalesce((F.col("time_ms") >= F.col("_s")) & (F.col("time_ms") < F.col("_e")), F.lit(False))
    return _kept(rows.filter(~inside), samples.columns, time_ms=_moved("time_ms"))


def cut_segments(segments: DataFrame, cuts: DataFrame) -> DataFrame:
    rows = _with_cut(segments, cuts).select("*", _moved("start_ms").alias("_a"), _moved("end_ms").alias("_b"))
    return _kept(rows.filter(F.col("_s").isNull() | (F.col("_b") > F.col("_a"))), segments.columns,
                 start_ms=F.col("_a"), end_ms=F.col("_b"))


def cut_settings(settings: DataFrame, cuts: DataFrame) -> DataFrame:
    rows = _with_cut(settings, cuts).withColumn("hook_end_ms", F.coalesce(F.nullif(F.col("hook_end_ms"), F.lit(0)), F.lit(8000)))
    return _kept(rows, settings.columns, hook_end_ms=_moved("hook_end_ms"))


def cut_quality(quality: DataFrame, cuts: DataFrame) -> DataFrame:
    """Quality records with ``edit_review``: those of cut videos are to be looked at again."""
    cut = cuts.select("video_id").distinct().withColumn("_cut", F.lit(True))
    held = F.coalesce(F.col("edit_review"), F.lit(False)) if "edit_review" in quality.columns else F.lit(False)
    columns = quality.columns + ([] if "edit_review" in quality.columns else ["edit_review"])
    return _kept(quality.join(cut, "video_id", "left"), columns, edit_review=held | F.coalesce(F.col("_cut"), F.lit(False)))


def ripple_delete(project: dict[str, DataFrame], cuts: DataFrame, rows: int = 50_000) -> dict[str, DataFrame]:
    """A project's relations after ``cuts(video_id, cut_start_ms, cut_end_ms)``, one cut per video.

    Every relation joins the cuts by video and moves on its own; relations not given are skipped.
    """
    steps = {
        "clips": lambda df: cut_clips(df, cuts, rows), "captions": lambda df: cut_captions(df, cuts),
        "markers": lambda df: cut_markers(df, cuts, project.get("catalog")), "samples": lambda df: cut_samples(df, cuts),
        "segments": lambda df: cut_segments(df, cuts), "settings": lambda df: cut_settings(df, cuts), "quality": lambda df: cut_quality(df, cuts),
    }
    return {name: steps[name](df) if name in steps else df for name, df in project.items()}


# ---- histories of cuts: composed once, applied once

HISTORY, BLOCK = 512, 256
SPAN_DDL = "video_id string, _group bigint, a bigint, b bigint, step bigint"


def folded_cuts(cuts: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ordered cuts ``(step, start, end)``, each on the line the last one left, as disjoint removed spans ``(start, end, step)`` of the first line."""
    spans: list[tuple[int, int, int]] = []
    for step, start, end in cuts:
        gone, low, new = 0, None, []
        for a, b, _ in [*spans, (None, None, None)]:
            x, y = start + gone, end + gone
            x, y = x if low is None else max(x, low), y if a is None else min(y, a)
            if y > x:
                new.append((x, y, step))
            if a is not None:
                gone, low = gone + b - a, b
        spans = sorted(spans + new)
    return spans


def _folded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of groups of cuts, from rows sorted by group and step."""
    key, own, out = None, [], []

    def fold() -> None:
        out.extend((*key, *x) for x in (folded_cuts(own) if len(own) > 1 else [(own[0][1], own[0][2], own[0][0])]))

    names = ["video_id", "_group", "a", "b", "step"]
    for frame in frames:
        for video, group, step, start, end in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
            if (video, group) != key:
                if own:
                    fold()
                key, own = (video, group), []
            own.append((step, start, end))
        yield pd.DataFrame(out, columns=names)
        out.clear()
    if own:
        fold()
    yield pd.DataFrame(out, columns=names)


def removed_spans(cuts: DataFrame, rows: int = 50_000, history: int = HISTORY) -> DataFrame:
    """Spans ``(video_id, a, b, step)`` of the first timeline that ordered cuts remove, disjoint, each with the step that removed it.

    Up to ``history`` steps are folded in one call. Longer histories are joined two by two: the borders of the later half and the seams of
    the earlier one lie on the same line, so one ordered pass over both gives how far each span moves back and where seams part it.
    """
    ship(cuts.sparkSession)
    real = cuts.filter(F.col("cut_end_ms") > F.col("cut_start_ms")).select("video_id", "seq", "cut_start_ms", "cut_end_ms")
    steps = ordered(real, ["video_id"], ["seq"], by_position("seq", rows), number="step").withColumn("_group", F.floor(F.col("step") / history))

    # Most histories are short, so groups share calls: rows come sorted and are folded as they pass.
    steps = steps.select("video_id", "_group", "step", "cut_start_ms", "cut_end_ms").repartition("video_id", "_group").sortWithinPartitions("video_id", "_group", "step")
    spans = cut_lineage(steps.mapInPandas(_folded, SPAN_DDL), "edit-spans")
    while spans.filter("_group > 0").limit(1).count():  # halves what is left of the longest history
        later = F.col("_group") % 2 == 1
        halves = spans.withColumn("_pair", F.floor(F.col("_group") / 2))
        earlier = ordered(halves.filter(~later), ["video_id", "_pair"], ["a"], by_time("a"), before={"_gone": F.col("b") - F.col("a")})
        seams = earlier.select("video_id", "_pair", (F.col("a") - F.col("_gone")).alias("p"), F.lit(1).alias("kind"), F.col("a").alias("tie"), (F.col("b") - F.col("a")).alias("size"), F.lit(None).cast("bigint").alias("open"))
        borders = halves.filter(later).select("video_id", "_pair", F.explode(F.array(
            F.struct(F.col("a").alias("p"), F.lit(2).alias("kind"), F.col("step").alias("open")),
            F.struct(F.col("b").alias("p"), F.lit(0).alias("kind"), F.lit(-1).cast("bigint").alias("open")))).alias("x"))
        line = seams.unionByName(borders.select("video_id", "_pair", "x.p", "x.kind", F.lit(0).cast("bigint").alias("tie"), F.lit(0).cast("bigint").alias("size"), "x.open"))
        line = ordered(line, ["video_id", "_pair"], ["p", "kind", "tie"], by_time("p"), before={"_before": F.col("size")}, last_seen={"_open": F.col("open")}, lead={"_next": F.col("p")})
        gone = F.col("_before") + F.col("size")
        back = line.filter((F.col("_open") >= 0) & (F.col("_next") > F.col("p"))).select(
            "video_id", F.col("_pair").alias("_group"), (F.col("p") + gone).alias("a"), (F.col("_next") + gone).alias("b"), F.col("_open").alias("step"))
        kept = halves.filter(~later).select("video_id", F.col("_pair").alias("_group"), "a", "b", "step")
        spans = cut_lineage(kept.unionByName(back), "edit-spans")
    return spans.select("video_id", "a", "b", "step")


def span_blocks(spans: DataFrame) -> DataFrame:
    """Spans in runs of ``BLOCK`` with the stretch of the line each run answers for: ``(video_id, _from, _to, _gone, _spans)``.

    The first run's stretch begins before all times (null), the last one's never ends (null); ``_gone`` is removed before the run.
    """
    placed = ordered(spans, ["video_id"], ["a"], by_time("a"), number="_k", before={"_gone": F.col("b") - F.col("a")})
    blocks = placed.groupBy("video_id", F.floor(F.col("_k") / BLOCK).alias("_block")).agg(
        F.min("a").alias("_first"), F.min("_gone").alias("_gone"), F.sort_array(F.collect_list(F.struct("a", "b", "step"))).alias("_spans"))
    blocks = ordered(blocks, ["video_id"], ["_block"], by_position("_block"), lead={"_to": F.col("_first")})
    return blocks.select("video_id", F.when(F.col("_block") > 0, F.col("_first")).alias("_from"), "_to", "_gone", "_spans")


def _at_block(rows: DataFrame, blocks: DataFrame, at: str) -> DataFrame:
    """Rows with the block that answers for their time ``at``; null columns in videos without cuts."""
    own = blocks.withColumnRenamed("video_id", "_video")
    here = (F.col("_from").isNull() | (F.col(at) >= F.col("_from"))) & (F.col("_to").isNull() | (F.col(at) < F.col("_to")))
    return rows.join(own, (F.col("video_id") == F.col("_video")) & here, "left")


def _shifted(at: str) -> Column:
    """Where a time lies after all cuts; inside a removed span, at its seam."""
    t = F.col(at)
    inside = F.aggregate("_spans", F.lit(0).cast("bigint"), lambda n, x: n + F.greatest(F.lit(0), F.least(t, x["b"]) - F.least(t, x["a"])))
    return F.when(F.col("_video").isNull(), t).otherwise(t - F.col("_gone") - inside)


_BLOCK_COLUMNS = ("_video", "_from", "_to", "_gone", "_spans")


def _moved_by(rows: DataFrame, blocks: DataFrame, **columns: str) -> DataFrame:
    for new, at in columns.items():
        rows = _at_block(rows, blocks, at).withColumn(new, _shifted(at)).withColumn("_cut", F.col("_video").isNotNull()).drop(*_BLOCK_COLUMNS)
    return rows


def _pieces(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What is left of clips, from rows of a clip and a removed span in it, sorted by clip and span.

    A piece is the right one of every cut that touched what lay before it then: going left from it, of each step that comes before all
    steps met so far. The stack holds those steps.
    """
    last: tuple | None = None
    at, n, stack, out = 0, 0, [], []

    def piece(until: int) -> None:
        nonlocal n
        if until > at:
            video, order, name, start, _, source = last
            out.append((video, order, n, name + "-r" * len(stack), source + at - start, source + until - start))
            n += 1

    names = ["video_id", "_ord", "part", "clip_id", "src_start_ms", "src_end_ms"]
    for frame in frames:
        for video, order, name, start, end, source, a, b, step in zip(*(frame[c].tolist() for c in frame.columns), strict=True):
            if last is None or (video, order) != last[:2]:
                if last is not None:
                    piece(last[4])
                last, at, n, stack = (video, order, name, start, end, source), start, 0, []
            piece(a)
            while stack and stack[-1] >= step:
                stack.pop()
            stack.append(step)
            at = b
        yield pd.DataFrame(out, columns=names)
        out = []
    if last is not None:
        piece(last[4])
    yield pd.DataFrame(out, columns=names)


def _clips_left(clips: DataFrame, blocks: DataFrame, rows: int) -> DataFrame:
    laid = layout(clips, rows).select("video_id", "ord", "clip_id", "out_start_ms", "out_end_ms", "src_start_ms", "src_end_ms")
    own = blocks.withColumnRenamed("video_id", "_video")
    meets = (F.col("_from").isNull() | (F.col("out_end_ms") > F.col("_from"))) & (F.col("_to").isNull() | (F.col("out_start_ms") < F.col("_to")))
    hit = laid.join(own, (F.col("video_id") == F.col("_video")) & meets)
    hit = hit.select("video_id", "ord", "clip_id", "out_start_ms", "out_end_ms", "src_start_ms", F.explode("_spans").alias("x")).filter((F.col("x.a") < F.col("out_end_ms")) & (F.col("x.b") > F.col("out_start_ms")))
    hit = cut_lineage(hit.select("video_id", "ord", "clip_id", "out_start_ms", "out_end_ms", "src_start_ms", "x.a", "x.b", "x.step"), "edit-hits")
    left = hit.repartition("video_id", "ord").sortWithinPartitions("video_id", "ord", "a").mapInPandas(
        _pieces, "video_id string, _ord bigint, part int, clip_id string, src_start_ms bigint, src_end_ms bigint")
    whole = laid.join(hit.select("video_id", "ord").distinct(), ["video_id", "ord"], "left_anti").select(
        "video_id", F.col("ord").cast("bigint").alias("_ord"), F.lit(0).alias("part"), "clip_id", "src_start_ms", "src_end_ms")
    out = ordered(whole.unionByName(left), ["video_id"], ["_ord", "part"], by_position("_ord", rows), number="ord")
    return out.select("video_id", F.col("ord").cast("int").alias("ord"), "clip_id", "src_start_ms", "src_end_ms")


def _captions_left(captions: DataFrame, blocks: DataFrame) -> DataFrame:
    rows = _moved_by(captions, blocks, _a="start_ms", _b="end_ms")
    touched = F.col("_b") - F.col("_a") < F.col("end_ms") - F.col("start_ms")
    flag = touched | (F.coalesce(F.col("edit_review"), F.lit(False)) if "edit_review" in captions.columns else F.lit(False))
    columns = captions.columns + ([] if "edit_review" in captions.columns else ["edit_review"])
    return _kept(rows.filter(~F.col("_cut") | (F.col("_b") - F.col("_a") >= 30)), columns, start_ms=F.col("_a"), end_ms=F.col("_b"), edit_review=flag)


def _removed(at: str) -> Column:
    return F.coalesce(F.exists("_spans", lambda x: (x["a"] <= F.col(at)) & (F.col(at) < x["b"])), F.lit(False))


def _markers_left(markers: DataFrame, blocks: DataFrame, catalog: DataFrame | None) -> DataFrame:
    if catalog is not None:
        markers = with_duration(markers, catalog)
    rows = _at_block(markers, blocks, "time_ms")
    at, cut = F.col("time_ms"), F.col("_video").isNotNull()
    length = F.coalesce(F.col("duration_ms"), F.lit(fixed.DEFAULT_EFFECT_MS).cast("bigint"))
    following = F.coalesce(F.array_min(F.transform(F.filter("_spans", lambda x: x["a"] > at), lambda x: x["a"])), F.col("_to"))
    rows = rows.withColumn("_len", F.least(length, following - at)).filter(~cut | (~_removed("time_ms") & (F.col("_len") >= 80)))
    return _kept(rows, markers.columns, time_ms=_shifted("time_ms"), duration_ms=F.when(cut, F.col("_len")).otherwise(F.col("duration_ms")))


def _samples_left(samples: DataFrame, blocks: DataFrame) -> DataFrame:
    return _kept(_at_block(samples, blocks, "time_ms").filter(~_removed("time_ms")), samples.columns, time_ms=_shifted("time_ms"))


def _segments_left(segments: DataFrame, blocks: DataFrame) -> DataFrame:
    rows = _moved_by(segments, blocks, _a="start_ms", _b="end_ms")
    return _kept(rows.filter(~F.col("_cut") | (F.col("_b") > F.col("_a"))), segments.columns, start_ms=F.col("_a"), end_ms=F.col("_b"))


def _hooks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hook ends after all cuts, from a hook and its cuts in order; a hook at 0 stands for the default at the next cut, so steps cannot be joined."""
    video, hook = None, 0
    for frame in frames:
        out = []
        for own, step, start, end in frame.itertuples(index=False):
            if own != video or step < 0:
                if video is not None:
                    out.append((video, hook))
                video, hook = own, start
            else:
                hook = hook or 8000
                hook = hook if hook <= start else hook - (end - start) if hook >= end else start
        yield pd.DataFrame(out, columns=["video_id", "_hook"])
    yield pd.DataFrame([(video, hook)] if video is not None else [], columns=["video_id", "_hook"])


def _settings_left(settings: DataFrame, cuts: DataFrame) -> DataFrame:
    real = cuts.filter(F.col("cut_end_ms") > F.col("cut_start_ms")).join(settings.select("video_id"), "video_id", "left_semi")
    hooks = settings.join(real.select("video_id"), "video_id", "left_semi").select(
        "video_id", F.lit(-1).cast("bigint").alias("seq"), F.coalesce(F.col("hook_end_ms"), F.lit(0)).cast("bigint").alias("cut_start_ms"), F.lit(0).cast("bigint").alias("cut_end_ms"))
    line = hooks.unionByName(real.select("video_id", F.col("seq").cast("bigint").alias("seq"), "cut_start_ms", "cut_end_ms"))
    line = cut_lineage(line, "edit-hooks")  # joined halves count as dealt by video already, but not alike
    moved = line.repartition("video_id").sortWithinPartitions("video_id", "seq").mapInPandas(_hooks, "video_id string, _hook bigint")
    return _kept(settings.join(moved, "video_id", "left"), settings.columns, hook_end_ms=F.coalesce("_hook", "hook_end_ms"))


def apply_edits(project: dict[str, DataFrame], cuts: DataFrame, rows: int = 50_000, history: int = HISTORY) -> dict[str, DataFrame]:
    """Ordered cuts ``(video_id, seq, cut_start_ms, cut_end_ms)``, each on the timeline the last one left; ``seq`` is 0 or more.

    The history of a video is composed once into the spans of the first timeline that it removes; then every relation moves in one pass,
    however many cuts there are. Cuts that remove nothing are passed over.
    """
    spans = cut_lineage(removed_spans(cuts, rows, history), "edit-composed")
    return _spans_left(project, spans, cuts, rows)


def _spans_left(project: dict[str, DataFrame], spans: DataFrame, cuts: DataFrame, rows: int) -> dict[str, DataFrame]:
    """A project's relations without ``spans`` of its first timeline, which are what ``cuts`` remove."""
    blocks = cut_lineage(span_blocks(spans), "edit-blocks")
    steps = {
        "clips": lambda df: _clips_left(df, blocks, rows), "captions": lambda df: _captions_left(df, blocks),
        "markers": lambda df: _markers_left(df, blocks, project.get("catalog")), "samples": lambda df: _samples_left(df, blocks),
        "segments": lambda df: _segments_left(df, blocks), "settings": lambda df: _settings_left(df, cuts), "quality": lambda df: cut_quality(df, cuts),
    }
    return {name: steps[name](df) if name in steps else df for name, df in project.items()}


def split_clip(clips: DataFrame, points: DataFrame, rows: int = 50_000) -> DataFrame:
    """Clips cut in two at ``points(video_id, ord, t_ms)``; within 25 ms of an edge nothing happens."""
    laid = layout(clips, rows).join(points.select("video_id", "ord", "t_ms"), ["video_id", "ord"], "left")
    t = F.col("t_ms")
    inside = F.coalesce((t > F.col("out_start_ms") + 25) & (t < F.col("out_end_ms") - 25), F.lit(False))
    at = F.col("src_start_ms") + t - F.col("out_start_ms")

    def piece(order, clip_id, src_start, src_end):
        return F.struct(F.lit(order).alias("part"), clip_id.alias("clip_id"), src_start.alias("src_start_ms"), src_end.alias("src_end_ms"))

    name, start, end = F.col("clip_id"), F.col("src_start_ms"), F.col("src_end_ms")
    pieces = F.when(inside, F.array(piece(0, name, start, at), piece(1, F.concat(name, F.lit("-s")), at, end))
                    ).otherwise(F.array(piece(0, name, start, end)))
    cut = laid.select("video_id", F.col("ord").alias("_ord"), F.explode(pieces).alias("p")).select("video_id", "_ord", "p.*")
    out = ordered(cut, ["video_id"], ["_ord", "part"], by_position("_ord", rows), number="ord")
    return out.select("video_id", F.col("ord").cast("int").alias("ord"), "clip_id", "src_start_ms", "src_end_ms")


def trim_clip(project: dict[str, DataFrame], bounds: DataFrame, media: DataFrame, rows: int = 50_000) -> dict[str, DataFrame]:
    """New in and out points ``bounds(video_id, ord, new_start_ms, new_end_ms)`` for one clip per video.

    The tail goes first, so the head still finds the clip where it was. Points snap to
    frames; a result under 40 ms leaves the video as it is.
    """
    fps = media.select("video_id", "fps_num", "fps_den")
    laid = layout(project["clips"], rows).join(bounds, ["video_id", "ord"]).join(fps, "video_id", "left")
    snap = lambda c: snap_to_frame(F.col(c), F.col("fps_num"), F.col("fps_den"))
    laid = laid.select("video_id", "src_start_ms", "src_end_ms", "out_start_ms", "out_end_ms",
                       F.greatest(F.col("src_start_ms"), snap("new_start_ms")).alias("_in"),
                       F.least(F.col("src_end_ms"), snap("new_end_ms")).alias("_out"))
    laid = laid.filter(F.col("_out") - F.col("_in") >= 40)
    base = F.col("out_start_ms") - F.col("src_start_ms")
    tail = laid.filter(F.col("_out") < F.col("src_end_ms") - 1).select(
        "video_id", (base + F.col("_out")).alias("cut_start_ms"), F.col("out_end_ms").alias("cut_end_ms"))
    head = laid.filter(F.col("_in") > F.col("src_start_ms") + 1).select(
        "video_id", F.col("out_start_ms").alias("cut_start_ms"), (base + F.col("_in")).alias("cut_end_ms"))
    # The tail lies behind the head, so its going leaves the head where it was: both are spans of the first timeline as they are.
    cuts = cut_lineage(tail.select("*", F.lit(0).cast("bigint").alias("seq")).unionByName(head.select("*", F.lit(1).cast("bigint").alias("seq"))), "trims")
    return _spans_left(project, cuts.select("video_id", F.col("cut_start_ms").alias("a"), F.col("cut_end_ms").alias("b"), F.col("seq").alias("step")), cuts, rows)


def edit_history(snapshots: DataFrame, state: str = "state") -> DataFrame:
    """Saved states that differ from the one before them."""
    rows = ordered(snapshots, ["video_id"], ["seq"], by_position("seq"), lag={"_prev": F.col(state)})
    return rows.filter(~F.col(state).eqNullSafe(F.col("_prev"))).drop("_prev")


def changed_rows(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows of ``after`` that ``before`` does not hold."""
    return after.exceptAll(before.select(*after.columns))
