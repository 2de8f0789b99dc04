"""Sound markers: candidates, placement, effect lengths, schedule and load."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.text import has_signal
from cuetable.functions.timing import div, marker_target
from cuetable.operators.classify import assign_effect
from cuetable.plans.folders import cut_lineage
from cuetable.plans.ordered import by_time, ordered
from cuetable.plans.ranges import covered_bins
from cuetable.plans.shipping import ship

LEAD_IN_MS = 300
SPACING_MS = 4000
CLOSEST_MS = 3000
SPAN_MS = 3_600_000
GAP_ROWS = 50_000


def effect_catalog(spark) -> DataFrame:
    """The effects as a table; a fixed 29 rows, so it may be broadcast."""
    return spark.createDataFrame([tuple(e) for e in fixed.EFFECTS], "id string, label string, `group` string, duration_ms bigint").withColumn(
        "library_version", F.lit(fixed.EFFECT_LIBRARY_VERSION))


def with_duration(markers: DataFrame, catalog: DataFrame) -> DataFrame:
    """Markers with a length: their own, else their effect's, else 300 ms."""
    natural = catalog.select(F.col("id").alias("type"), F.col("duration_ms").alias("_natural"))
    rows = markers if "duration_ms" in markers.columns else markers.withColumn("duration_ms", F.lit(None).cast("bigint"))
    length = F.coalesce("duration_ms", "_natural", F.lit(fixed.DEFAULT_EFFECT_MS).cast("bigint"))
    return rows.join(natural, "type", "left").select(*[length.alias(c) if c == "duration_ms" else F.col(c) for c in rows.columns])


def _numbered(captions: DataFrame, span_ms: int) -> DataFrame:
    """Captions with their position by start among all of the video."""
    return ordered(captions, ["video_id"], ["start_ms", "id"], by_time("start_ms", span_ms), number="index")


def _in_window(captions: DataFrame, plan: DataFrame) -> DataFrame:
    """Selected captions starting after the hook and before the end, with the video's plan."""
    label = F.coalesce(F.col("label"), F.lit("other"))
    selected = F.coalesce(F.col("selected"), F.lit(True)) if "selected" in captions.columns else F.lit(True)
    origin = F.col("hook_end_ms") + LEAD_IN_MS
    return (captions.join(plan, "video_id")
            .filter(selected & (label != "remove") & (F.col("start_ms") >= origin) & (F.col("start_ms") < F.col("duration_ms"))))


def eligible_candidates(
    captions: DataFrame, plan: DataFrame, patterns=None, candidate_pattern: str | None = None, span_ms: int = SPAN_MS,
) -> DataFrame:
    """Captions fit for an effect, with position and score.

    ``plan(video_id, hook_end_ms, duration_ms)``. Labelled captions qualify at once, others
    need four characters and something worth marking. The score counts in hundredths:
    400 or 100, 100 for highlights, one per character up to 20.
    """
    return _scored(_in_window(_numbered(captions, span_ms), plan), patterns, candidate_pattern).filter("_fits").drop("_fits", "_long")


def _scored(rows: DataFrame, patterns, candidate_pattern) -> DataFrame:
    patterns = fixed.SIGNAL_PATTERNS if patterns is None else patterns
    text = F.btrim(F.coalesce(F.col("text"), F.lit("")))
    primary = F.coalesce(F.col("label"), F.lit("other")).isin(*fixed.PRIMARY)
    marked = F.coalesce(F.size("highlight_words"), F.lit(0)) > 0
    telling = marked | has_signal(text, "|".join(f"(?:{p})" for p in patterns.values())) | text.rlike(
        fixed.CANDIDATE_PATTERN if candidate_pattern is None else candidate_pattern)
    score = F.when(primary, 400).otherwise(100) + F.when(marked, 100).otherwise(0) + F.least(F.length(text), F.lit(20))
    return rows.select(*[c for c in rows.columns if c != "score"], score.cast("bigint").alias("score"), (primary | ((F.length(text) >= 4) & telling)).alias("_fits"),
                       (F.length(text) >= 4).alias("_long"))


def _slotted(candidates: DataFrame) -> DataFrame:
    """Candidates with their slot of the video and their distance to its middle.

    All in whole numbers: a slot is ``room / target`` wide, so everything is scaled by the target.
    """
    origin = F.col("hook_end_ms") + LEAD_IN_MS
    room, past, target = F.col("duration_ms") - origin, F.col("start_ms") - origin, F.col("target")
    slot = F.least(target - 1, div(past * target, room))
    rows = candidates.withColumn("slot", slot)
    return rows.withColumn("off_centre", F.abs(past * target * 2 - (F.col("slot") * 2 + 1) * room))


def best_per_slot(candidates: DataFrame, plan_target: Column | None = None) -> DataFrame:
    """Each slot's preferred candidate: highest score, then nearest the middle, then earliest.

    An aggregate, so slots are reduced before they are shuffled.
    """
    rows = candidates if plan_target is None else candidates.withColumn("target", plan_target)
    rows = _slotted(rows.filter("target > 0"))
    rank = F.struct((-F.col("score")).alias("a"), F.col("off_centre").alias("b"), F.col("index").alias("c"))
    return rows.groupBy("video_id", "slot").agg(F.min_by(F.struct("index", "start_ms", "score"), rank).alias("best")).select(
        "video_id", "slot", "best.*")


def _first_free(candidates: DataFrame, runs: DataFrame) -> DataFrame:
    """Slot by slot of a run, the first preferred option far enough from those taken before it."""
    option = F.struct("slot", (-F.col("score")).alias("rank"), "off_centre", "index", "start_ms")
    sorted_runs = (candidates.join(runs, ["video_id", "slot"]).groupBy("video_id", "_run")
                   .agg(F.sort_array(F.collect_list(option)).alias("_options")))
    begin = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(-1).cast("bigint").alias("filled"), F.array().cast("array<bigint>").alias("picks"))

    def take(state: Column, o: Column) -> Column:
        fits = (o["slot"] != state["filled"]) & F.coalesce(o["start_ms"] - state["last"] >= SPACING_MS, F.lit(True))
        return F.when(fits, F.struct(o["start_ms"].alias("last"), o["slot"].alias("filled"), F.array_append(state["picks"], o["index"]).alias("picks"))).otherwise(state)

    return sorted_runs.select("video_id", F.explode(F.aggregate("_options", begin, take)["picks"]).alias("index"))


def _by_score(clusters: DataFrame) -> DataFrame:
    """Of each cluster the best score first, then the earliest, each kept if no kept one is too near."""
    option = F.struct((-F.col("score")).alias("rank"), "start_ms", "index")
    grouped = clusters.groupBy("video_id", "_cluster").agg(F.sort_array(F.collect_list(option)).alias("_options"))

    def keep(kept: Column, o: Column) -> Column:
        near = F.exists(kept, lambda k: F.abs(k["start_ms"] - o["start_ms"]) < SPACING_MS)
        return F.when(near, kept).otherwise(F.array_append(kept, o))

    picks = F.aggregate("_options", F.slice("_options", 1, 0), keep)
    return grouped.select("video_id", F.explode(F.transform(picks, lambda k: k["index"])).alias("index"))


def _split_long_gaps(rows: DataFrame, gap_rows: int) -> tuple[DataFrame | None, DataFrame]:
    """Picks of gaps holding more than ``gap_rows`` captions, and the rows left to fill.

    A gap's next pick depends on that gap alone, so each round every long gap gives up its
    farthest caption by an aggregate and falls apart in two there.
    """
    key = ["video_id", "_before", "_after"]
    # Gaps are named by their ends; a missing end, at the rim of a video, by a time no caption has.
    rows = rows.withColumn("_before", F.coalesce("_before", F.lit(OPEN))).withColumn("_after", F.coalesce("_after", F.lit(OPEN)))
    done = None
    while True:
        long_gaps = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("_rows"), F.max_by(
            F.struct("index", "start_ms"), F.struct(_distance().alias("d"), (-F.col("start_ms")).alias("t"), (-F.col("index")).alias("i"))).alias("_pick"),
            F.max(_distance()).alias("distance")).filter(F.col("_rows") > gap_rows)
        long_gaps = cut_lineage(long_gaps, "marker-long-gaps")
        if long_gaps.isEmpty():
            return done, rows
        picked = long_gaps.select("video_id", F.col("_pick.index").alias("index"), "distance").filter(F.col("distance") >= CLOSEST_MS)
        done = picked if done is None else done.unionByName(picked)
        at, start = F.col("_pick.start_ms"), F.col("start_ms")
        split = rows.join(long_gaps.select(*key, "_pick"), key, "left")
        split = split.withColumn("_after2", F.when(at.isNotNull() & (start < at), at).otherwise(F.col("_after"))).withColumn(
            "_before", F.when(at.isNotNull() & (start >= at), at).otherwise(F.col("_before"))).withColumn("_after", F.col("_after2")).drop("_after2", "_pick")
        rows = cut_lineage(split.filter(_distance() >= CLOSEST_MS), "marker-gaps")


OPEN = -1


def _distance() -> Column:
    start = F.col("start_ms")
    left = F.when(F.col("_before") != OPEN, start - F.col("_before"))
    right = F.when(F.col("_after") != OPEN, F.col("_after") - start)
    return F.coalesce(F.least(left, right), F.col("duration_ms"))


def _fill_gaps(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Fills gaps between chosen markers: in each, always the caption farthest from any marker. Rows come in order, one gap is held."""
    columns = ["video_id", "_before", "_after", "start_ms", "index", "duration_ms"]
    gap, held = None, []
    for frame in frames:
        out = []
        for video, before, after, at, index, duration in frame[columns].itertuples(index=False, name=None):
            if (video, before, after) != gap:
                _fill(gap, held, out)
                gap, held = (video, before, after), []
            held.append((at, index, duration))
        yield pd.DataFrame(out, columns=["video_id", "index", "distance"])
    out = []
    _fill(gap, held, out)
    yield pd.DataFrame(out, columns=["video_id", "index", "distance"])


def _fill(gap: tuple | None, held: list[tuple[int, int, int]], out: list[tuple]) -> None:
    """Adds the captions to mark in one gap, whose own are ``(start, index, duration)`` in order."""
    if gap is None:
        return
    video, before, after = gap
    spans = [(0, len(held), None if before == OPEN else before, None if after == OPEN else after)]
    while spans:
        first, stop, left, right = spans.pop()
        best, far = None, CLOSEST_MS - 1
        for i in range(first, stop):
            at, _, duration = held[i]
            ends = [abs(at - end) for end in (left, right) if end is not None]
            near = min(ends) if ends else duration
            if near > far:
                best, far = i, near
        if best is not None:
            out.append((video, held[best][1], far))
            spans += [(first, best, left, held[best][0]), (best + 1, stop, held[best][0], right)]


def place_markers(
    captions: DataFrame, plan: DataFrame, *, max_markers: int | None = None, patterns=None, cues=None,
    candidate_pattern: str | None = None, span_ms: int = SPAN_MS, gap_rows: int = GAP_ROWS,
) -> DataFrame:
    """Effects spread over each video after its hook, four seconds apart.

    First one per time slot, then by score wherever there is room, then, while the target
    is not met, the captions farthest from any marker down to three seconds.

    Each step depends only on what lies near, so each is worked out in small independent
    groups of a video: runs of slots that can touch, clusters of candidates that can touch,
    gaps between markers. Only the final cut to the target ranks a whole video, and that
    is by chunks.
    """
    target = F.lit(max(0, max_markers)).cast("bigint") if max_markers is not None else marker_target(F.col("duration_ms"))
    plan = plan.select("video_id", "hook_end_ms", "duration_ms", target.alias("target")).filter(
        (F.col("target") > 0) & (F.col("duration_ms") > F.col("hook_end_ms") + LEAD_IN_MS))
    rows = _scored(_in_window(_numbered(captions, span_ms), plan), patterns, candidate_pattern)
    rows = assign_effect(rows, patterns, cues).filter("_fits or _long")
    rows = cut_lineage(rows.select("video_id", "index", "start_ms", "score", "_fits", "_long", "type", "effect_reason",
                                   "hook_end_ms", "duration_ms", "target"), "marker-captions")
    candidates = _slotted(rows.filter("_fits"))

    # 1. One per slot. A slot whose preferred option clears everything earlier starts a new run.
    rank = F.struct((-F.col("score")).alias("a"), F.col("off_centre").alias("b"), F.col("index").alias("c"))
    slots = candidates.groupBy("video_id", "slot").agg(F.min_by("start_ms", rank).alias("_top"), F.max("start_ms").alias("_latest"))
    slots = cut_lineage(slots, "marker-slots")  # a small table, read by both passes below
    chunk = by_time("slot", 10_000)
    slots = ordered(slots, ["video_id"], ["slot"], chunk, lag={"_past": F.col("_latest")})
    apart = F.coalesce(F.col("_top") - F.col("_past") >= SPACING_MS, F.lit(True))
    slots = ordered(slots.withColumn("_apart", F.when(apart, 1).otherwise(0)), ["video_id"], ["slot"], chunk, before={"_runs": F.col("_apart")})
    runs = slots.select("video_id", "slot", (F.col("_runs") + F.col("_apart")).alias("_run"))
    first = _first_free(candidates, runs)
    state = cut_lineage(rows.join(first.withColumn("_first", F.lit(True)), ["video_id", "index"], "left"), "marker-first")

    # 2. By score among candidates the first step left room for, cluster by cluster.
    chosen_at = F.when(F.col("_first"), F.col("start_ms"))
    order, chunk = ["start_ms", "index"], by_time("start_ms", span_ms)
    near = ordered(state, ["video_id"], order, chunk, last_seen={"_l": chosen_at}, next_seen={"_r": chosen_at})
    start = F.col("start_ms")
    free = F.coalesce(start - F.col("_l") >= SPACING_MS, F.lit(True)) & F.coalesce(F.col("_r") - start >= SPACING_MS, F.lit(True))
    open_ = cut_lineage(near.filter(F.col("_fits") & F.col("_first").isNull() & free).select(
        "video_id", "index", "start_ms", "score", "target"), "marker-open")
    open_ = ordered(open_, ["video_id"], order, chunk, lag={"_prev": start})
    parts = F.when(F.coalesce(start - F.col("_prev") >= SPACING_MS, F.lit(True)), 1).otherwise(0)
    open_ = ordered(open_.withColumn("_part", parts), ["video_id"], order, chunk, before={"_parts": F.col("_part")})
    second = _by_score(open_.withColumn("_cluster", F.col("_parts") + F.col("_part")))
    counts = state.groupBy("video_id").agg(F.count_if(F.col("_first")).alias("_n"), F.first("target").alias("_target"))
    second = second.join(state.select("video_id", "index", "start_ms", "score"), ["video_id", "index"])
    second = _first_ranked(cut_lineage(second, "marker-second"), counts, [(-F.col("score")).alias("_rank")], span_ms)
    state = cut_lineage(state.join(second.withColumn("_second", F.lit(True)), ["video_id", "index"], "left"), "marker-second-chosen")

    # 3. Farthest first in the gaps that are left.
    taken = F.coalesce(F.col("_first"), F.col("_second"), F.lit(False))
    counts = state.groupBy("video_id").agg(F.count_if(taken).alias("_n"), F.first("target").alias("_target"))
    chosen_at = F.when(taken, start)
    near = ordered(state, ["video_id"], order, chunk, last_seen={"_before": chosen_at}, next_seen={"_after": chosen_at})
    wanting = near.join(counts.filter("_n < _target").select("video_id"), "video_id", "left_semi")
    # A caption starting with a chosen one is at distance 0 and never viable.
    wanting = wanting.filter(F.col("_long") & ~taken & (F.coalesce(start - F.col("_before"), F.lit(CLOSEST_MS)) >= CLOSEST_MS)
                             & (F.coalesce(F.col("_after") - start, F.lit(CLOSEST_MS)) >= CLOSEST_MS))
    ship(state.sparkSession)
    gaps = cut_lineage(wanting.select("video_id", "index", "start_ms", "_before", "_after", "duration_ms"), "marker-wanting")
    early, gaps = _split_long_gaps(gaps, gap_rows)
    # Gaps are dealt by their ends and filled one after the other as they pass.
    gap = ["video_id", "_before", "_after"]
    third = (gaps.repartition(*gap).sortWithinPartitions(*gap, "start_ms", "index").mapInPandas(_fill_gaps, "video_id string, index bigint, distance bigint"))
    third = third if early is None else third.unionByName(early)
    third = third.join(state.select("video_id", "index", "start_ms"), ["video_id", "index"])
    third = _first_ranked(cut_lineage(third, "marker-third"), counts, [(-F.col("distance")).alias("_rank")], span_ms)

    extra = third.withColumn("_third", F.lit(True))
    out = state.join(extra, ["video_id", "index"], "left").filter(taken | F.col("_third"))
    return out.select("video_id", (F.bround(start / 10, 0) * 10).cast("bigint").alias("time_ms"), "type", F.lit(True).alias("enabled"),
                      F.lit(1.0).alias("volume"), F.col("effect_reason").alias("reason"), F.lit("auto").alias("source"))


def _first_ranked(picks: DataFrame, counts: DataFrame, rank: list[Column], span_ms: int) -> DataFrame:
    """Keys of the first picks by rank and time, as many as the video still lacks."""
    rows = picks.select("video_id", "index", "start_ms", *rank)
    # The order starts with the rank, so its chunks are a rank level and a time span in it.
    level = F.struct(F.col("_rank"), by_time("start_ms", span_ms))
    rows = ordered(rows, ["video_id"], ["_rank", "start_ms", "index"], level, number="_at")
    lacking = counts.select("video_id", (F.col("_target") - F.col("_n")).alias("_lack"))
    return rows.join(lacking, "video_id").filter(F.col("_at") < F.col("_lack")).select("video_id", "index")


def marker_order(markers: DataFrame, target: DataFrame, span_ms: int = SPAN_MS) -> DataFrame:
    """Markers by time, cut to ``target(video_id, target)``."""
    rows = ordered(markers, ["video_id"], ["time_ms", "id"], by_time("time_ms", span_ms), number="position")
    return rows.join(target, "video_id").filter(F.col("position") < F.col("target")).drop("target")


def supplemental(candidates: DataFrame, chosen: DataFrame) -> DataFrame:
    """Candidates at times nothing was chosen for."""
    return candidates.join(chosen.select("video_id", "time_ms"), ["video_id", "time_ms"], "left_anti")


def effect_schedule(markers: DataFrame, catalog: DataFrame, media: DataFrame, default_master: float = 0.5) -> DataFrame:
    """Markers that sound: when, what, how long and how loud.

    ``media(video_id, duration_ms, sfx_volume)``. Unknown effects become ``pop``, volumes and
    lengths are held to their limits, disabled, silent and late ones go.
    """
    known = catalog.select(F.col("id").alias("type"), F.col("duration_ms").alias("_natural"), F.lit(True).alias("_known"))
    pop = dict((e[0], e[3]) for e in fixed.EFFECTS)["pop"]
    rows = (markers.withColumnRenamed("duration_ms", "_own").join(known, "type", "left").join(media, "video_id"))
    master = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("sfx_volume", F.lit(default_master))))
    gain = master * F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce("volume", F.lit(1.0))))
    length = F.coalesce("_own", "_natural", F.lit(pop).cast("bigint"))
    rows = rows.filter(F.coalesce(F.col("enabled"), F.lit(True))).select(
        *[c for c in ("video_id", "id") if c in markers.columns], F.greatest(F.lit(0), F.col("time_ms")).alias("start_ms"),
        F.when(F.col("_known"), F.col("type")).otherwise("pop").alias("type"),
        F.greatest(F.lit(80), F.least(F.lit(8000), length)).alias("length_ms"), gain.alias("gain"), "duration_ms")
    return rows.filter((F.col("start_ms") < F.col("duration_ms")) & (F.col("gain") != 0)).drop("duration_ms")


def concurrency_mix(schedule: DataFrame, bin_ms: int = 1000) -> DataFrame:
    """Per block of time: how many effects sound and their summed gain times milliseconds."""
    start, end = F.col("start_ms"), F.col("start_ms") + F.col("length_ms")
    opened = schedule.select("video_id", "gain", start.alias("start_ms"), end.alias("_end"), F.explode(covered_bins(start, end, bin_ms)).alias("block"))
    inside = F.least(F.col("_end"), (F.col("block") + 1) * bin_ms) - F.greatest(F.col("start_ms"), F.col("block") * bin_ms)
    return opened.groupBy("video_id", "block").agg(F.count(F.lit(1)).alias("active"), F.sum(F.col("gain") * inside).alias("gain_ms"))
