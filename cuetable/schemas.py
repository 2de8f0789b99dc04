"""Relations of the data model and the projection that applies their defaults.

Timeline times are BIGINT milliseconds; audit times are TIMESTAMP.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

DDL = {
    "media": "video_id STRING, path STRING, duration_ms BIGINT, width INT, height INT, fps_num INT, fps_den INT, "
             "video_codec STRING, audio_codec STRING",
    "captions": "video_id STRING, id BIGINT, start_ms BIGINT, end_ms BIGINT, text STRING, label STRING, score DOUBLE, "
                "highlight_words ARRAY<STRING>, selected BOOLEAN, reason STRING, timestamp_source STRING, "
                "timestamp_locked BOOLEAN, edit_review BOOLEAN",
    "tokens": "video_id STRING, seg_id BIGINT, pos INT, text STRING, start_ms BIGINT",
    "words": "video_id STRING, seg_id BIGINT, pos INT, text STRING, start_ms BIGINT, end_ms BIGINT",
    "chars": "video_id STRING, seg_id BIGINT, pos INT, text STRING, start_ms BIGINT, end_ms BIGINT, prefix STRING",
    "segments": "video_id STRING, seg_id BIGINT, attempt INT, start_ms BIGINT, end_ms BIGINT, text STRING, n_chars INT, "
                "engine STRING, has_token_timestamps BOOLEAN, language STRING, model_language STRING",
    "regions": "video_id STRING, region_id BIGINT, start_ms BIGINT, end_ms BIGINT",
    "clips": "video_id STRING, ord INT, clip_id STRING, src_start_ms BIGINT, src_end_ms BIGINT",
    "markers": "video_id STRING, time_ms BIGINT, type STRING, enabled BOOLEAN, volume DOUBLE, duration_ms BIGINT, "
               "reason STRING, source STRING",
    "effect_catalog": "id STRING, label STRING, `group` STRING, duration_ms BIGINT",
    "visual_samples": "video_id STRING, time_ms BIGINT, host_visible BOOLEAN, face_count INT, board_risk DOUBLE, "
                      "overlay_allowed BOOLEAN",
    "quality": "video_id STRING, status STRING, timestamp_mode STRING, vad_segments INT, recognized_segments INT, "
               "speech_ms BIGINT, recognized_ms BIGINT, uncovered_ms BIGINT, coverage_ratio DOUBLE, fallback_error STRING",
    "settings": "video_id STRING, font STRING, font_size INT, margin_v INT, subtitle_x DOUBLE, subtitle_y DOUBLE, "
                "hook_end_ms BIGINT, sfx_volume DOUBLE, text_color STRING, highlight_color STRING, outline_color STRING",
    "lexicon": "label STRING, term STRING, ord INT, is_regex BOOLEAN",
    "queue_events": "item_id STRING, ts TIMESTAMP, seq BIGINT, action STRING, revision STRING, status STRING, "
                    "error STRING, output STRING",
    "jobs": "id STRING, parent_id STRING, kind STRING, video STRING, status STRING, quality_status STRING, progress INT, "
            "message STRING, created_at TIMESTAMP",
    "assets": "folder STRING, name STRING, path STRING, ext STRING",
}

# Defaults used where a document leaves a value out.
DEFAULTS = {
    "captions": {"label": "other", "score": 0.0, "selected": True, "edit_review": False, "timestamp_locked": False},
    "markers": {"type": "pop", "enabled": True, "volume": 1.0},
    "jobs": {"status": "error", "quality_status": "error"},
}


def schema(name: str) -> StructType:
    return StructType.fromDDL(DDL[name])


def conform(df: DataFrame, name: str) -> DataFrame:
    """``df`` with exactly the columns of a relation: missing ones added, defaults filled in."""
    defaults = DEFAULTS.get(name, {})
    cols = []
    for field in schema(name).fields:
        col = F.col(f"`{field.name}`") if field.name in df.columns else F.lit(None)
        col = col.cast(field.dataType)
        if field.name in defaults:
            col = F.coalesce(col, F.lit(defaults[field.name]))
        if name == "captions" and field.name == "highlight_words":
            col = F.coalesce(col, F.array().cast(field.dataType))
        cols.append(col.alias(field.name))
    return df.select(*cols)
