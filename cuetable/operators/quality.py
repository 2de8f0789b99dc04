"""Speech coverage, recognition candidates, alignment, and the project rules."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.text import incomplete_ending, normalize_text
from cuetable.plans.ordered import by_time, ordered
from cuetable.plans.ranges import overlap_join

SPAN_MS = 3_600_000


def _recognized() -> Column:
    return (F.coalesce(F.col("text"), F.lit("")) != "") & F.coalesce(F.col("has_token_timestamps"), F.lit(False))


def coverage_quality(segments: DataFrame, mode: str = "token") -> DataFrame:
    """Per video: how much detected speech got text and times, and whether that is enough."""
    length = F.greatest(F.lit(0), F.col("end_ms") - F.col("start_ms"))
    sums = segments.groupBy("video_id").agg(
        F.count(F.lit(1)).alias("vad_segments"), F.count_if(_recognized()).alias("recognized_segments"),
        F.sum(length).alias("speech_ms"), F.coalesce(F.sum(F.when(_recognized(), length)), F.lit(0)).alias("recognized_ms"))
    ratio = F.when(F.col("speech_ms") > 0, F.col("recognized_ms") / F.col("speech_ms")).otherwise(1.0)
    good = (F.col("vad_segments") == F.col("recognized_segments")) & (ratio >= 0.985)
    return sums.select(
        "video_id", F.when(good, "ok").otherwise("needs_review").alias("status"), F.lit(mode).alias("timestamp_mode"), "vad_segments",
        "recognized_segments", "speech_ms", "recognized_ms", (F.col("speech_ms") - F.col("recognized_ms")).alias("uncovered_ms"),
        F.round(ratio, 4).alias("coverage_ratio"))


def unresolved_segments(segments: DataFrame) -> DataFrame:
    """The segments behind a low coverage, one row each rather than a list per video."""
    return segments.filter(~_recognized()).select("video_id", "seg_id", "start_ms", "end_ms")


def coverage_tail(chars: DataFrame, media: DataFrame, aligned: DataFrame | None = None) -> DataFrame:
    """Coverage measured to the last character: its end over the duration, the tail left, the shift by alignment.

    It counts gaps before the last character as covered; ``coverage_quality`` does not.
    """
    # The last character is the one latest in order, and max_by keeps one row per task before the shuffle.
    ends = chars.groupBy("video_id").agg(F.max_by("end_ms", F.struct("seg_id", "pos")).alias("native_end_ms"))
    rows = media.select("video_id", "duration_ms").join(ends, "video_id", "left")
    if aligned is not None:
        shifted = aligned.groupBy("video_id").agg(F.max_by("end_ms", F.struct("seg_id", "pos")).alias("end_ms"))
        rows = rows.join(shifted, "video_id", "left")
    else:
        rows = rows.withColumn("end_ms", F.col("native_end_ms"))
    end, d = F.col("end_ms"), F.col("duration_ms")
    return rows.select(
        "video_id", F.coalesce(end, F.lit(0)).alias("recognized_ms"), F.greatest(F.lit(0), d - F.coalesce(end, F.lit(0))).alias("uncovered_ms"),
        F.when(d > 0, F.round(F.least(F.lit(1.0), F.coalesce(end, d) / d), 4)).otherwise(0.0).alias("coverage_ratio"),
        F.when((F.coalesce("native_end_ms", F.lit(0)) != 0) & (F.coalesce(end, F.lit(0)) != 0), F.col("native_end_ms") - end)
        .otherwise(0).alias("alignment_delta_ms"))


def detected_languages(segments: DataFrame) -> DataFrame:
    """Distinct non-empty languages per video, sorted; as many as there are language codes at most."""
    named = segments.filter(F.coalesce(F.col("language"), F.lit("")) != "")
    return named.groupBy("video_id").agg(F.array_sort(F.collect_set("language")).alias("languages"))


def best_candidate(candidates: DataFrame) -> DataFrame:
    """The best attempt per segment: with times, then most characters, then longest text, then earliest."""
    rank = F.struct(F.col("has_token_timestamps").cast("int").alias("a"), F.col("n_chars").alias("b"),
                    F.length(normalize_text(F.col("text"))).alias("c"), (-F.col("attempt")).alias("d"))
    rest = [c for c in candidates.columns if c not in ("video_id", "seg_id")]
    best = candidates.groupBy("video_id", "seg_id").agg(F.max_by(F.struct(*rest), rank).alias("_b"))
    return best.select("video_id", "seg_id", "_b.*")


def needs_fallback(candidates: DataFrame) -> DataFrame:
    """Candidates to send to another recogniser: no text, no times, or too few characters for their length."""
    seconds = F.greatest(F.lit(10), F.col("end_ms") - F.col("start_ms")) / 1000
    sparse = (seconds >= 1.2) & (F.col("n_chars") / seconds < 0.45)
    return candidates.filter((F.coalesce(F.col("text"), F.lit("")) == "") | ~F.coalesce(F.col("has_token_timestamps"), F.lit(False)) | sparse)


def all_attempts(*attempts: DataFrame) -> DataFrame:
    """Candidates of several recognisers in one table, numbered by attempt."""
    out = attempts[0].withColumn("attempt", F.lit(0))
    for i, rows in enumerate(attempts[1:], 1):
        out = out.unionByName(rows.withColumn("attempt", F.lit(i)))
    return out


def chars_in_regions(chars: DataFrame, regions: DataFrame, bin_ms: int = 60_000) -> DataFrame:
    """Characters with every region their interval overlaps."""
    spans = regions.select("video_id", "region_id", F.col("start_ms").alias("region_start_ms"), F.col("end_ms").alias("region_end_ms"))
    return overlap_join(chars, spans, ["video_id"], ("start_ms", "end_ms"), ("region_start_ms", "region_end_ms"), bin_ms)


def alignment_accept(
    selected: DataFrame, aligned: DataFrame, native: DataFrame, region_share: float = 0.8, video_share: float = 0.9,
) -> DataFrame:
    """Forced-alignment times where they can be trusted, native ones elsewhere.

    ``selected(video_id, region_id, pos, start_ms)`` are the characters of each region,
    ``aligned(video_id, region_id, pos, rel_start_ms, rel_end_ms)`` the aligner's pairs in
    order from 0. A region counts with four fifths of its characters aligned; its times are
    anchored to its first native character. A video takes them with nine tenths of its
    characters aligned.
    """
    want = selected.groupBy("video_id", "region_id").agg(F.count(F.lit(1)).alias("_want"), F.min_by("start_ms", "pos").alias("_anchor"))
    have = aligned.groupBy("video_id", "region_id").agg(F.count(F.lit(1)).alias("_have"), F.min_by("rel_start_ms", "pos").alias("_first"))
    good = want.join(have, ["video_id", "region_id"]).filter(
        F.col("_have") >= F.greatest(F.lit(1), F.floor(F.col("_want") * F.lit(region_share) + 1e-9)))
    used = aligned.join(good, ["video_id", "region_id"]).filter(F.col("pos") < F.col("_want"))
    shift = F.col("_anchor") - F.col("_first")
    timed = used.select("video_id", "region_id", "pos", (F.col("rel_start_ms") + shift).alias("start_ms"), (F.col("rel_end_ms") + shift).alias("end_ms"))
    kept = good.groupBy("video_id").agg(F.sum(F.least("_have", "_want")).alias("_aligned"))
    verdict = native.groupBy("video_id").agg(F.count(F.lit(1)).alias("_native")).join(kept, "video_id", "left")
    enough = F.coalesce("_aligned", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("_native") * F.lit(video_share) + 1e-9))
    verdict = verdict.select("video_id", enough.alias("_enough"))
    from_aligner = timed.join(verdict.filter("_enough"), "video_id", "left_semi").withColumn("timestamp_mode", F.lit("fa_zh_vad_corrected"))
    from_native = native.join(verdict.filter("NOT _enough"), "video_id", "left_semi").select(
        "video_id", F.lit(None).cast("bigint").alias("region_id"), "pos", "start_ms", "end_ms", F.lit("paraformer_char_fallback").alias("timestamp_mode"))
    return from_aligner.select(from_native.columns).unionByName(from_native)


def frame_risk(contours: DataFrame) -> DataFrame:
    """Risk of a text board per frame, from measured contours.

    ``contours(video_id, time_ms, corners, area, image_area, width, height, y, frame_height, density)``.
    """
    ratio = F.col("width") / F.greatest(F.col("height"), F.lit(1))
    fits = ((F.col("corners") == 4) & (F.col("area") >= F.col("image_area") * 0.035) & (F.col("area") <= F.col("image_area") * 0.55)
            & ratio.between(0.55, 3.2) & (F.col("y") <= F.col("frame_height") * 0.86))
    place = F.when(F.col("y") + F.col("height") / 2 > F.col("frame_height") * 0.25, 1.0).otherwise(0.7)
    risk = F.least(F.lit(1.0), F.col("density") * 7.0) * place
    rows = contours.groupBy("video_id", "time_ms").agg(F.round(F.coalesce(F.max(F.when(fits, risk)), F.lit(0.0)), 3).alias("board_risk"))
    return rows.withColumn("overlay_allowed", F.col("board_risk") < 0.48)


def hook_has_benefit(captions: DataFrame, settings: DataFrame) -> DataFrame:
    """Videos with a selected labelled caption starting inside the hook."""
    spoken = captions.filter(F.coalesce(F.col("selected"), F.lit(True)) & F.col("label").isin(*fixed.PRIMARY))
    first = spoken.groupBy("video_id").agg(F.min("start_ms").alias("_first"))
    hooks = settings.select("video_id", F.coalesce("hook_end_ms", F.lit(0)).alias("_end")).groupBy("video_id").agg(F.max("_end").alias("_end"))
    return hooks.join(first, "video_id").filter(F.col("_first") < F.col("_end")).select("video_id")


def validate(
    projects: DataFrame, captions: DataFrame, samples: DataFrame | None = None, quality: DataFrame | None = None,
    connectives: Sequence[str] | None = None, span_ms: int = SPAN_MS,
) -> DataFrame:
    """Rule breaks ``(video_id, rule, level, detail)``; a video without any gets one ``ok`` row.

    ``projects(video_id, duration_ms, hook_end_ms, font_size, subtitle_x, subtitle_y, has_edit, has_model)``.
    The native fallback of the aligner reports status ok and yet is not among the exact
    timestamp modes, so it draws a warning; both rules are kept as they are.
    """
    def issue(rows: DataFrame, rule: str, level: Column | str, detail: Column | None = None) -> DataFrame:
        return rows.select("video_id", F.lit(rule).alias("rule"), (F.lit(level) if isinstance(level, str) else level).alias("level"),
                           (F.lit("") if detail is None else detail.cast("string")).alias("detail"))

    hook = F.coalesce(F.col("hook_end_ms"), F.lit(0))
    packaged = F.coalesce(F.col("has_model"), F.lit(False)) | ~F.col("has_edit")
    soft = F.when(F.col("has_edit"), "warning").otherwise("error")
    d = F.col("duration_ms")
    finite = d.isNotNull() & ~F.isnan(d.cast("double")) & (d > 0)
    issues = [
        issue(projects.filter(~finite), "duration", "error", d),
        issue(projects.filter(packaged & ~hook.between(3000, 10000)), "hook_length", soft, hook),
        issue(projects.filter(~F.coalesce("font_size", F.lit(54)).between(16, 160)), "font_size", "error", F.col("font_size")),
        issue(projects.filter(~F.coalesce("subtitle_x", F.lit(50.0)).between(0, 100)), "subtitle_x", "error", F.col("subtitle_x")),
        issue(projects.filter(~F.coalesce("subtitle_y", F.lit(90.0)).between(0, 100)), "subtitle_y", "error", F.col("subtitle_y")),
    ]
    chosen = captions.filter(F.coalesce(F.col("selected"), F.lit(True)) if "selected" in captions.columns else F.lit(True))
    rows = ordered(chosen, ["video_id"], ["start_ms", "id"], by_time("start_ms", span_ms), number="_at",
                   lag={"_prev_end": F.col("end_ms")}, is_last="_last")
    rows = rows.join(projects.select("video_id", "duration_ms"), "video_id")
    start, end, at = F.col("start_ms"), F.col("end_ms"), F.col("_at") + 1
    review = F.coalesce(F.col("edit_review"), F.lit(False)) if "edit_review" in captions.columns else F.lit(False)
    # All caption rules read the ordered captions once.
    broken = F.filter(F.array(
        F.when((start < 0) | (end <= start) | (end > d + 100), F.struct(F.lit("caption_time").alias("rule"), F.lit("error").alias("level"))),
        F.when(start < F.col("_prev_end") - 20, F.struct(F.lit("caption_overlap").alias("rule"), F.lit("warning").alias("level"))),
        F.when(review, F.struct(F.lit("edit_review").alias("rule"), F.lit("warning").alias("level"))),
        F.when(F.col("_last") & incomplete_ending(F.coalesce(F.col("text"), F.lit("")), connectives),
               F.struct(F.lit("unfinished_ending").alias("rule"), F.lit("error").alias("level")))), lambda r: r.isNotNull())
    issues.append(rows.select("video_id", at.cast("string").alias("detail"), F.explode(broken).alias("r")).select(
        "video_id", "r.rule", "r.level", "detail"))
    spoken = hook_has_benefit(captions if "selected" in captions.columns else captions.withColumn("selected", F.lit(True)), projects)
    issues.append(issue(projects.filter(packaged).join(spoken, "video_id", "left_anti"), "hook_label", soft))
    if quality is not None:
        uncovered = F.coalesce(F.col("uncovered_ms"), F.lit(0))
        issues += [
            issue(quality.filter(~F.coalesce(F.col("timestamp_mode"), F.lit("")).isin(*fixed.EXACT_TIMESTAMP_MODES)), "timestamp_mode", "warning", F.col("timestamp_mode")),
            issue(quality.filter((F.col("status") == "needs_review") | (uncovered > 450)), "coverage", "warning", uncovered),
        ]
        if "fallback_error" in quality.columns:
            issues.append(issue(quality.filter(F.coalesce(F.col("fallback_error"), F.lit("")) != ""), "fallback_error", "warning", F.col("fallback_error")))
    if samples is not None:
        hidden = samples.filter(~F.coalesce(F.col("host_visible"), F.lit(False))).join(projects.select("video_id", hook.alias("_hook")), "video_id")
        issues.append(issue(hidden.filter(F.col("time_ms") <= F.col("_hook")).select("video_id").distinct(), "hook_host", "warning"))
    found = issues[0]
    for rows in issues[1:]:
        found = found.unionByName(rows)
    # One row per video of the issues is enough to tell who has none.
    flagged = found.groupBy("video_id").agg(F.lit(True).alias("_flagged"))
    clean = projects.join(flagged, "video_id", "left_anti")
    return found.unionByName(issue(clean, "ok", "ok"))


def blocking_issues(issues: DataFrame) -> DataFrame:
    """Errors per video; a video listed here cannot be exported."""
    return issues.filter("level = 'error'").groupBy("video_id").agg(F.count(F.lit(1)).alias("errors"))


def export_length_check(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Exports without a video stream, or off by more than a second and one per cent."""
    rows = expected.select("video_id", F.col("duration_ms").alias("expected_ms")).join(
        actual.select("video_id", F.col("duration_ms").alias("actual_ms"), "video_codec"), "video_id")
    off = F.abs(F.col("actual_ms") - F.col("expected_ms")) > F.greatest(F.lit(1000.0), F.col("expected_ms") * 0.01)
    return rows.withColumn("complete", ~((F.coalesce(F.col("video_codec"), F.lit("")) == "") | off))
