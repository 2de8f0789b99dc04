import datetime as dt
import json

import pytest
from pyspark.sql.types import StructType

from cuetable.operators import review
from cuetable.plans.commits import committed
from cuetable.sources import documents, media
from cuetable.streaming import streams

LOG = [("add", None, None, None), ("claim", None, None, None), ("save", "r1", None, None), ("analysis", "r1", None, None), ("approve", "zz", None, None), ("approve", "r1", None, None),
       ("export", None, None, None), ("remove", None, None, None), ("export_status", "r1", None, "done"), ("save", "r2", "r0", None), ("save", "r2", "r1", None), ("export", None, None, None)]


def log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(item, start + dt.timedelta(seconds=i), i, a, r, e, s, None, "out.mp4" if s == "done" else None) for item in "xy" for i, (a, r, e, s) in enumerate(LOG)]
    rows.append(("y", start + dt.timedelta(hours=1), 99, "remove", None, None, None, None, None))
    return spark.createDataFrame(rows, "item_id string, ts timestamp, seq bigint, action string, revision string, expected string, status string, error string, output string")


def test_event_log(spark):
    outcomes = review.review_outcomes(log(spark))
    x = outcomes.filter("item_id = 'x'").orderBy("seq").collect()
    assert [r["conflict"] for r in x] == ["", "", "processing", "", "revision changed", "", "", "work under way", "", "changed elsewhere", "", "not reviewed"]
    state = {r["item_id"]: r for r in review.review_state(outcomes).collect()}
    assert set(state) == {"x"} and state["x"]["revision"] == "r2" and state["x"]["exported_revision"] == "r1" and state["x"]["output"] == "out.mp4"


def test_media_listing(spark, tmp_path):
    for name in ("b.MP4", "a.mov", "notes.txt", "sub/c.mkv"):
        path = tmp_path / name
        path.parent.mkdir(exist_ok=True)
        path.write_bytes(b"x")
    assert [r["name"] for r in media.media_files(spark, str(tmp_path)).collect()] == ["a.mov", "b.MP4"]
    assert media.media_files(spark, str(tmp_path), recursive=True).count() == 3
    plan = media.media_files(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "content" not in plan
    (tmp_path / "none").mkdir()
    (tmp_path / "none" / "x.txt").write_text("x")
    with pytest.raises(ValueError):
        media.media_files(spark, str(tmp_path / "none"))
    assert media.recent_media(media.media_files(spark, str(tmp_path)), 1).first()["name"] == "b.MP4"


def test_asset_listing(spark, tmp_path):
    for name in ("洗衣凝珠/a.jpg", "洗衣凝珠/deep/b.MP4", "图片素材/c.png", "other/d.txt", "top.jpg"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x")
    rows = media.asset_files(spark, str(tmp_path)).collect()
    assert sorted((r["folder"], r["name"], r["ext"]) for r in rows) == [("洗衣凝珠", "a.jpg", "jpg"), ("洗衣凝珠", "b.MP4", "mp4")]


def test_malformed_documents_are_passed_over(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"video_id": "a", "product_name": "p"}, indent=1))
    (tmp_path / "bad.json").write_text('{"video_id": "b", ')
    (tmp_path / "_review_queue.json").write_text('{"video_id": "q"}')
    rows = documents.read_projects(spark, str(tmp_path), StructType.fromDDL("video_id string, product_name string"), multi_line=True)
    assert [tuple(r) for r in rows.collect()] == [("a", "p")]


def test_probe_defaults(spark):
    rows = spark.createDataFrame([("a", '{"format":{"duration":"12.3456"},"streams":[{"codec_type":"audio","codec_name":"aac"},{"codec_type":"video","codec_name":"h264","width":1080,"height":1920,"r_frame_rate":"30000/1001"}]}'),
                                  ("b", "{}")], "video_id string, probe string")
    got = [tuple(r) for r in media.flatten_probe(rows).orderBy("video_id").collect()]
    assert got == [("a", 12346, 1080, 1920, 30000, 1001, "h264", "aac"), ("b", 0, 0, 0, 0, 0, "", "")]


def test_cache_key_depends_on_language(spark):
    rows = spark.createDataFrame([("v", 5, "en"), ("v", 5, "zh"), ("v", 5, "auto")], "id string, size int, language string")
    assert rows.select(media.fingerprint(["id", "size", "language"])).distinct().count() == 3


def test_new_media_stream(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "items")
    root.mkdir()
    for name in ("a.mp4", "b.txt"):
        (root / name).write_bytes(b"x")
    for expected in (1, 2):
        streams.keep_items(streams.stream_new_media(spark, str(root)), table, str(tmp_path / "ck")).awaitTermination()
        assert committed(spark, table).select("item_id").distinct().count() == committed(spark, table).count() == expected
        (root / "c.mov").write_bytes(b"x")


def test_jobs_and_batches(spark):
    items = spark.createDataFrame([("a", ["b1"]), ("b", None)], "item_id string, batches array<string>")
    ids = spark.createDataFrame([("b",)], "item_id string")
    grown = {r["item_id"]: r["batches"] for r in review.add_to_batch(items, ids, "b2").collect()}
    assert grown == {"a": ["b1"], "b": ["b2"]}
    assert review.batch_members(items, "b1").count() == 1 and review.batch_members(items).count() == 2
    jobs = spark.createDataFrame([("1", "running", "m"), ("2", "running", "m"), ("3", "done", "m")], "id string, status string, message string")
    live = spark.createDataFrame([("2",)], "id string")
    assert {r["id"]: r["status"] for r in review.orphaned_jobs(jobs, live).collect()} == {"1": "error", "2": "running", "3": "done"}
    assert review.active_jobs(jobs).first()[0] == 2
