from cuetable.operators import edits
from cuetable.schemas import schema


def project(spark):
    return {
        "clips": spark.createDataFrame([("v", 0, "a", 10000, 20000)], schema("clips")),
        "captions": spark.createDataFrame([("v", i, s, e, t) for i, (s, e, t) in enumerate([(0, 2000, "keep"), (3000, 5000, "remove"), (2000, 7000, "cross"), (8000, 10000, "later")])],
                                          "video_id string, id bigint, start_ms bigint, end_ms bigint, text string"),
        "markers": spark.createDataFrame([("v", 1000, 4000), ("v", 4000, 500), ("v", 8000, 1000)], "video_id string, time_ms bigint, duration_ms bigint"),
        "samples": spark.createDataFrame([("v", 4000), ("v", 9000)], "video_id string, time_ms bigint"),
        "settings": spark.createDataFrame([("v", 8000)], "video_id string, hook_end_ms bigint")}


def cut(spark, *spans):
    return spark.createDataFrame([("v", i, s, e) for i, (s, e) in enumerate(spans)], "video_id string, seq bigint, cut_start_ms bigint, cut_end_ms bigint")


def test_ripple_golden(spark):
    after = edits.ripple_delete(project(spark), cut(spark, (3000, 6000)))
    clips = after["clips"]
    assert [(r["src_start_ms"], r["src_end_ms"]) for r in clips.orderBy("ord").collect()] == [(10000, 13000), (16000, 20000)]
    assert edits.edit_duration(clips).first()["edit_ms"] == 7000
    rows = after["captions"].orderBy("start_ms").collect()
    assert [(r["start_ms"], r["end_ms"], r["text"], r["edit_review"]) for r in rows] == [(0, 2000, "keep", False), (2000, 4000, "cross", True), (5000, 7000, "later", False)]
    assert [(r["time_ms"], r["duration_ms"]) for r in after["markers"].orderBy("time_ms").collect()] == [(1000, 2000), (5000, 1000)]
    assert [r["time_ms"] for r in after["samples"].collect()] == [6000] and after["settings"].first()["hook_end_ms"] == 5000
    times = spark.createDataFrame([("v", 3000), ("v", 7000), ("v", 99999), ("v", -5)], "video_id string, t_ms bigint")
    assert {r["t_ms"]: (r["ord"], r["source_ms"]) for r in edits.locate(times, clips).collect()} == {
        3000: (1, 16000), 7000: (1, 20000), 99999: (1, 20000), -5: (0, 10000)}
    asked = spark.createDataFrame([("v", 1, 18000), ("v", 5, 1)], "video_id string, ord int, src_ms bigint")
    assert {r["ord"]: r["t_ms"] for r in edits.to_output_time(asked, clips).collect()} == {1: 5000, 5: 0}
    for at, n in ((5000, 3), (3000, 2)):
        points = spark.createDataFrame([("v", 1, at)], "video_id string, ord int, t_ms bigint")
        out = edits.split_clip(clips, points)
        assert out.count() == n and edits.edit_duration(out).first()["edit_ms"] == 7000


def test_ordered_cuts(spark):
    after = edits.apply_edits(project(spark), cut(spark, (3000, 6000), (0, 7000)))
    assert all(after[name].count() == 0 for name in ("clips", "captions", "markers"))
    after = edits.apply_edits(project(spark), cut(spark, (3000, 6000), (1000, 2000)))
    assert [(r["src_start_ms"], r["src_end_ms"]) for r in after["clips"].orderBy("ord").collect()] == [(10000, 11000), (12000, 13000), (16000, 20000)]


def test_trim(spark):
    media = spark.createDataFrame([("v", 25, 1)], "video_id string, fps_num int, fps_den int")
    bounds = spark.createDataFrame([("v", 0, 12010, 17990)], "video_id string, ord int, new_start_ms bigint, new_end_ms bigint")
    after = edits.trim_clip(project(spark), bounds, media)
    assert [(r["src_start_ms"], r["src_end_ms"]) for r in after["clips"].collect()] == [(12000, 18000)]
    short = spark.createDataFrame([("v", 0, 12010, 12015)], "video_id string, ord int, new_start_ms bigint, new_end_ms bigint")
    assert edits.trim_clip(project(spark), short, media)["clips"].first()["src_end_ms"] == 20000


def test_invalid_clips_reject_the_video(spark):
    ranges = [(-1.0, 3000.0), (4000.0, 2000.0), (2000.0, 11000.0), (10010.0, 10020.0), (float("nan"), 2000.0)]
    clips = spark.createDataFrame([(f"bad{i}", 0, None, s, e) for i, (s, e) in enumerate(ranges)] + [("good", 0, None, 1000.0, 10040.0)],
                                  "video_id string, ord int, clip_id string, src_start_ms double, src_end_ms double")
    media = spark.createDataFrame([(f"bad{i}", 10000, True) for i in range(5)] + [("good", 10000, True), ("whole", 10000, False), ("empty", 10000, True)],
                                  "video_id string, duration_ms bigint, has_edit boolean")
    valid, rejected = edits.normalize_clips(clips, media)
    assert sorted((r["video_id"], r["clip_id"], r["src_start_ms"], r["src_end_ms"]) for r in valid.collect()) == [("good", "0", 1000, 10000), ("whole", "original", 0, 10000)]
    assert {r["video_id"] for r in rejected.collect()} == {f"bad{i}" for i in range(5)}
    lengths = {r["video_id"]: r["edit_ms"] for r in edits.edit_duration(valid, media).collect()}
    assert lengths["whole"] == 10000 and lengths["empty"] == 0


def test_trims_are_not_composed(spark, monkeypatch):
    """Both ends of a trimmed clip are spans of the first timeline already."""
    monkeypatch.setattr(edits, "removed_spans", None)
    media = spark.createDataFrame([("v", 25, 1)], "video_id string, fps_num int, fps_den int")
    bounds = spark.createDataFrame([("v", 0, 12010, 17990)], "video_id string, ord int, new_start_ms bigint, new_end_ms bigint")
    after = edits.trim_clip(project(spark), bounds, media)
    assert [(r["clip_id"], r["src_start_ms"], r["src_end_ms"]) for r in after["clips"].collect()] == [("a-r", 12000, 18000)]
    assert sorted((r["start_ms"], r["end_ms"]) for r in after["captions"].collect()) == [(0, 5000), (1000, 3000)]
    assert after["settings"].first()["hook_end_ms"] == 6000
