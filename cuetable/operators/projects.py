"""Project documents: put together, hashed, measured, compared, written as caption scripts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.text import ass_color, ass_time, highlight_markup
from cuetable.functions.timing import default_y_percent, marker_target, position_px
from cuetable.operators.classify import hook_end
from cuetable.plans.ordered import by_position, ordered

PART_ROWS = 10_000
HASH_PART = 4_096


def _dense(rows: DataFrame, order: Sequence[str], chunk: Column | None, name: str, by: Sequence[str] = ("video_id",)) -> DataFrame:
    return ordered(rows, list(by), list(order), by_position(order[0]) if chunk is None else chunk, number=name)


def ordered_digest(rows: DataFrame, by: Sequence[str], text: Column, number: str, part: int = HASH_PART, levels: int = 3) -> DataFrame:
    """SHA-256 over the rows of each key in order of ``number``, as a tree.

    Each level hashes groups of ``part``, so a key of any size is hashed in bounded pieces.
    """
    out = rows.select(*by, F.col(number).alias("_n"), F.sha2(text, 256).alias("digest"))
    for level in range(levels):
        group = F.floor(F.col("_n") / part) if level < levels - 1 else F.lit(0).cast("bigint")
        out = out.groupBy(*by, group.alias("_g")).agg(F.sha2(F.array_join(F.transform(
            F.sort_array(F.collect_list(F.struct("_n", "digest"))), lambda d: d["digest"]), ","), 256).alias("digest")).withColumnRenamed("_g", "_n")
    return out.select(*by, "digest")


def revision(sections: Mapping[str, tuple[DataFrame, Sequence[str]]], part: int = HASH_PART, levels: int = 3) -> DataFrame:
    """Content hash of every project over its sections, each ``(rows, order)`` with a ``video_id``.

    Rows count in their order with their columns by name; sections by name. Our own
    canonical form: equal content gives an equal hash. Only the fields that make up a
    revision count; other sections may change freely.
    """
    hashed = None
    for field in (f for f in fixed.REVISION_FIELDS if f in sections):
        rows, order = sections[field]
        columns = sorted(c for c in rows.columns if c != "video_id")
        numbered = _dense(rows, order, None, "_n").withColumn("_field", F.lit(field))
        digest = ordered_digest(numbered, ["video_id", "_field"], F.to_json(F.struct(*columns)), "_n", part, levels)
        hashed = digest if hashed is None else hashed.unionByName(digest)
    return hashed.groupBy("video_id").agg(F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct("_field", "digest"))), lambda s: F.concat(s["_field"], F.lit("="), s["digest"])), ";"), 256).alias("revision"))


def edit_key(clips: DataFrame, part: int = HASH_PART, levels: int = 3) -> DataFrame:
    """Short hash of a video's spans, the cache identity of its edit."""
    numbered = _dense(clips, ["ord"], None, "_n")
    spans = F.concat_ws("-", "src_start_ms", "src_end_ms")
    return ordered_digest(numbered, ["video_id"], spans, "_n", part, levels).select("video_id", F.substring("digest", 1, 16).alias("edit_key"))


def render_projection(projects: DataFrame) -> DataFrame:
    """What an export needs of a project: no speech segments, of the model's output only the quality record."""
    quality = F.col("model_output.asr.quality")
    kept = F.when(F.col("model_output.asr").isNotNull(), F.struct(F.struct(quality.alias("quality")).alias("asr")))
    rest = [c for c in projects.columns if c not in ("speech_segments", "model_output")]
    return projects.select(*rest, kept.alias("model_output"))


def project_measures(projects: DataFrame, captions: DataFrame, quality: DataFrame) -> DataFrame:
    """Caption count, quality status and readiness per project."""
    counts = captions.groupBy("video_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = projects.select("video_id", "has_model").join(counts, "video_id", "left").join(quality.select("video_id", "status"), "video_id", "left")
    n, model = F.coalesce("_n", F.lit(0)), F.coalesce("has_model", F.lit(False))
    return rows.select("video_id", n.alias("subtitle_count"), F.coalesce("status", F.lit("")).alias("quality_status"),
                       model.alias("has_analysis"), ((n > 0) | model).alias("ready"))


def preferred_captions(analysed: DataFrame, transcribed: DataFrame) -> DataFrame:
    """Analysed captions where a video has any, its transcribed ones otherwise."""
    missing = transcribed.join(analysed.select("video_id").distinct(), "video_id", "left_anti")
    return analysed.unionByName(missing, allowMissingColumns=True)


def derived_settings(media: DataFrame, captions: DataFrame) -> DataFrame:
    """Settings that follow from a video: the end of its hook, how many effects its length asks for, and the language it was heard in.

    ``media(video_id, duration_ms, language)``; a video without captions has the default hook, one without a language ``auto``.
    """
    hooks = hook_end(captions, media)
    return media.join(hooks, "video_id").select("video_id", "hook_end_ms", marker_target(F.col("duration_ms")).alias("sfx_target_count"), F.coalesce("language", F.lit("auto")).alias("asr_language"))


def assemble_projects(media: DataFrame, sections: Mapping[str, tuple[DataFrame, Sequence[str]]], part_rows: int = PART_ROWS, derived: DataFrame | None = None) -> DataFrame:
    """Nested project documents, one row per video and part of at most ``part_rows`` rows per section.

    Part 0 always exists; longer videos go on in further parts, so no document outgrows a task. Every part carries the media columns and the
    settings: the default ones and those ``derived`` (see ``derived_settings``).
    """
    nested, spine = {}, media.select("video_id", F.lit(0).cast("bigint").alias("part"))
    for name, (rows, order) in sections.items():
        columns = [c for c in rows.columns if c != "video_id"]
        numbered = _dense(rows, order, None, "_n").withColumn("part", F.floor(F.col("_n") / part_rows))
        item = F.struct(F.col("_n").alias("_n"), F.struct(*columns).alias("item"))
        # The position leads the sort key and is unique, so the item itself never decides.
        nested[name] = numbered.groupBy("video_id", "part").agg(
            F.transform(F.array_sort(F.collect_list(item), lambda a, b: (a["_n"] - b["_n"]).cast("int")), lambda s: s["item"]).alias(name))
        spine = spine.unionByName(nested[name].filter("part > 0").select("video_id", "part"))
    out = spine.distinct().join(media, "video_id", "left")
    for name, rows in nested.items():
        empty = F.array().cast(rows.schema[name].dataType)
        out = out.join(rows, ["video_id", "part"], "left").withColumn(name, F.coalesce(F.col(name), empty))
    settings = [F.lit(v).alias(k) for k, v in fixed.DEFAULT_SETTINGS.items()]
    own = [] if derived is None else [c for c in derived.columns if c != "video_id"]
    out = out if derived is None else out.join(derived.select("video_id", *[F.col(c).alias(f"_{c}") for c in own]), "video_id", "left")
    return out.withColumn("settings", F.struct(*settings, *[F.col(f"_{c}").alias(c) for c in own])).drop(*[f"_{c}" for c in own])


def training_pairs(model: DataFrame, human: DataFrame) -> DataFrame:
    """Model and human captions of each video side by side, with what became of them.

    Positive: kept or corrected and not marked for removal. Negative: unselected or marked for
    removal. Captions the human deleted stay without a verdict.
    """
    m = model.select("video_id", "id", F.col("text").alias("model_text"), F.col("label").alias("model_label"))
    h = human.select("video_id", "id", F.col("text").alias("human_text"), F.col("label").alias("human_label"), "selected", F.lit(True).alias("_there"))
    rows = m.join(h, ["video_id", "id"], "full_outer")
    same = F.col("model_text").eqNullSafe(F.col("human_text")) & F.col("model_label").eqNullSafe(F.col("human_label"))
    change = (F.when(F.col("_there").isNull(), "deleted").when(F.col("model_label").isNull() & F.col("model_text").isNull(), "added")
              .when(same, "kept").otherwise("corrected"))
    refused = ~F.coalesce(F.col("selected"), F.lit(True)) | (F.col("human_label") == "remove")
    verdict = F.when(F.col("_there").isNull(), F.lit(None)).when(F.coalesce(refused, F.lit(False)), "negative").otherwise("positive")
    return rows.select("video_id", "id", "model_text", "model_label", "human_text", "human_label", change.alias("change"), verdict.alias("verdict"))


def caption_events(captions: DataFrame, settings: DataFrame) -> DataFrame:
    """Lines of each video's caption script: ``(video_id, section, start_ms, id, line)``.

    ``settings(video_id, width, height, font, font_size, margin_v, text_color, highlight_color,
    outline_color, subtitle_x, subtitle_y)``. Header lines are section 0, events section 1;
    one row per line, so a long script is never one string.
    """
    d = fixed.DEFAULT_SETTINGS

    def setting(name: str, default=None) -> Column:
        value = d.get(name) if default is None else default
        return F.coalesce(F.col(name), F.lit(value)) if name in settings.columns else F.lit(value)

    width, height = setting("width", 1080).cast("int"), setting("height", 1920).cast("int")
    margin = setting("margin_v").cast("int")
    own_y = F.col("subtitle_y") if "subtitle_y" in settings.columns else F.lit(None).cast("double")
    x, y = position_px(setting("subtitle_x"), width), position_px(F.coalesce(own_y, default_y_percent(margin, height)), height)
    look = settings.select(
        "video_id", width.alias("_w"), height.alias("_h"), setting("font").alias("_font"), setting("font_size").cast("int").alias("_size"), margin.alias("_margin"),
        ass_color(setting("text_color")).alias("_normal"), ass_color(setting("highlight_color")).alias("_accent"), ass_color(setting("outline_color")).alias("_outline"),
        F.format_string("{\\an2\\pos(%d,%d)}", x, y).alias("_pos"))
    values = {"width": "_w", "height": "_h", "font": "_font", "size": "_size", "normal": "_normal", "outline": "_outline", "margin": "_margin"}

    def filled(line: str) -> Column:
        made = F.lit(line)
        for name, col in values.items():
            if "{" + name + "}" in line:
                made = F.replace(made, F.lit("{" + name + "}"), F.col(col).cast("string"))
        return made

    head = look.select("video_id", F.posexplode(F.array(*[filled(line) for line in fixed.EVENT_HEADER])).alias("id", "line")).select(
        "video_id", F.lit(0).alias("section"), F.lit(0).cast("bigint").alias("start_ms"), F.col("id").cast("bigint").alias("id"), "line")
    shown = captions.filter((F.btrim(F.coalesce(F.col("text"), F.lit(""))) != "") & (F.coalesce(F.col("selected"), F.lit(True)) if "selected" in captions.columns else F.lit(True)))
    words = F.coalesce(F.col("highlight_words"), F.array().cast("array<string>")) if "highlight_words" in captions.columns else F.array().cast("array<string>")
    line = F.concat(F.lit("Dialogue: 0,"), ass_time(F.col("start_ms")), F.lit(","), ass_time(F.col("end_ms")), F.lit(",Default,,0,0,0,,"), F.col("_pos"),
                    highlight_markup(F.col("text"), words, F.col("_normal"), F.col("_accent")))
    events = shown.join(look, "video_id").select("video_id", F.lit(1).alias("section"), "start_ms", "id", line.alias("line"))
    return head.unionByName(events)


def write_event_scripts(lines: DataFrame, folder: str) -> None:
    """All scripts in a few files, sorted by video and line, so that the bounds of their row groups lead to a video."""
    order = ("video_id", "section", "start_ms", "id")
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(folder)


def event_script(spark: SparkSession, folder: str, video_id: str) -> DataFrame:
    """The lines of one video's script in order; only row groups that may hold the video are read."""
    rows = spark.read.parquet(folder).filter(F.col("video_id") == video_id)
    return rows.orderBy("section", "start_ms", "id").select("line")


def export_event_script(spark: SparkSession, folder: str, video_id: str, target: str) -> None:
    """One video's script as a text file below ``target``."""
    event_script(spark, folder, video_id).coalesce(1).write.mode("overwrite").text(target)
