from pyspark.sql import functions as F

from cuetable.operators import classify, model, names, projects, quality
from cuetable.schemas import conform


def captions(spark, rows):
    return conform(spark.createDataFrame(rows, "video_id string, id bigint, start_ms bigint, end_ms bigint, text string, label string"), "captions")


def test_english_labels_keep_case(spark):
    texts = ["Keeps your skin SOFT with a Long-Lasting scent.", "A certified organic formula.", "Please subscribe and follow me.", "The software makes a descent.", "持久留香，上车"]
    df = spark.createDataFrame([("v", i, t) for i, t in enumerate(texts)], "video_id string, id bigint, text string")
    rows = classify.classify(df).orderBy("id").collect()
    assert [r["label"] for r in rows] == ["benefit", "selling_point", "remove", "other", "benefit"]
    assert {"SOFT", "Long-Lasting"} <= set(rows[0]["highlight_words"])
    assert rows[4]["highlight_words"] == ["留香", "香", "持久"] and round(rows[4]["score"], 2) == 0.84


def test_name_correction(spark):
    df = spark.createDataFrame([("v", 0, "这个站家香水很好"), ("v", 1, "绽家香氛洗衣凝猪"), ("v", 2, "无关")], "video_id string, id bigint, text string")
    products = spark.createDataFrame([("v", "绽家香水油洗衣凝珠2026")], "video_id string, product_name string")
    plain = {r["id"]: r["text"] for r in names.correct_names(df, products).collect()}
    assert plain == {0: "这个绽家香水很好", 1: "绽家香氛洗衣凝猪", 2: "无关"}
    sounds = spark.createDataFrame([("猪", "zhu"), ("珠", "zhu"), ("站", "zhan"), ("绽", "zhan")], "char string, sound string")
    rows = {r["id"]: r for r in names.correct_names(df, products, sounds).collect()}
    assert rows[1]["text"] == "绽家香氛洗衣凝珠" and [(c["from"], c["to"]) for c in rows[1]["name_changes"]] == [("洗衣凝猪", "洗衣凝珠")]


def test_model_replies(spark):
    df = spark.createDataFrame([("v", i, i * 1000, i * 1000 + 900, t) for i, t in enumerate(["Keeps skin soft all day", "Hello there friend", "plain words only", "missing one"])] + [("w", 0, 0, 900, "soft")],
                               "video_id string, id bigint, start_ms bigint, end_ms bigint, text string")
    raw = spark.createDataFrame([("v", 0, 'ok [{"id":0,"text":"保持柔软","label":"other","score":0.9,"highlight_words":["soft"],"reason":"x"},'
                                           '{"id":1,"text":"Hello there, friend","label":"benefit","score":0.7,"highlight_words":["there","zzz"],"reason":"r"},'
                                           '{"id":2,"text":"同上","label":"nonsense","score":0.8},{"id":99,"text":"stray"}] done')], "video_id string, batch bigint, raw string")
    rows = {(r["video_id"], r["id"]): r for r in model.reconcile_model(df, model.parse_responses(raw)).collect()}
    assert rows["v", 0]["text"] == "Keeps skin soft all day" and rows["v", 0]["label"] == "benefit" and rows["v", 0]["score"] == 0.9
    assert rows["v", 1]["text"] == "Hello there, friend" and rows["v", 1]["label"] == "benefit" and rows["v", 1]["highlight_words"] == ["there"]
    assert rows["v", 2]["text"] == "plain words only" and rows["v", 2]["label"] == "other" and rows["v", 2]["score"] == 0.42
    assert rows["v", 3]["label"] == "other" and rows["v", 3]["reason"] != "" and rows["v", 3]["start_ms"] == 3000
    assert rows["w", 0]["label"] == "benefit" and all(r["timestamp_locked"] for r in rows.values())


def check(spark, rows, **settings):
    base = {"video_id": "v", "duration_ms": 70000, "hook_end_ms": 6000, "font_size": 52, "subtitle_x": 25.0, "subtitle_y": 75.0, "has_edit": False, "has_model": False} | settings
    ddl = "video_id string, duration_ms bigint, hook_end_ms bigint, font_size int, subtitle_x double, subtitle_y double, has_edit boolean, has_model boolean"
    df = spark.createDataFrame([tuple(base.values())], ddl)
    samples = spark.createDataFrame([("v", 1000, True)], "video_id string, time_ms bigint, host_visible boolean")
    return {(r["rule"], r["level"]) for r in quality.validate(df, captions(spark, rows), samples).collect()}


def test_validation_goldens(spark):
    assert check(spark, [("v", 0, 0, 6000, "持久留香", "benefit")]) == {("ok", "ok")}
    long = [("v", 0, 0, 8000, "产品能够持久留香", "benefit"), ("v", 1, 1795000, 1799000, "介绍到这里结束。", "other")]
    assert not any(level == "error" for _, level in check(spark, long, duration_ms=1800000, hook_end_ms=8000))
    assert not any(level == "error" for _, level in check(spark, [], duration_ms=2000, hook_end_ms=0, has_edit=True))
    assert ("caption_time", "error") in check(spark, [("v", 0, 1000, 5000, "outside", "other")], duration_ms=2000, hook_end_ms=0, has_edit=True)
    assert {("unfinished_ending", "error"), ("hook_label", "error"), ("caption_overlap", "warning")} <= check(
        spark, [("v", 0, 0, 3000, "好的", "other"), ("v", 1, 2000, 4000, "但是，", "other")])


def test_event_script(spark, tmp_path):
    rows = captions(spark, [("v", 0, 0, 6000, "持久留香", "benefit")]).withColumn("highlight_words", F.array(F.lit("留香")))
    settings = spark.createDataFrame([("v", 1080, 1920, 25.0, 75.0)], "video_id string, width int, height int, subtitle_x double, subtitle_y double")
    lines = projects.caption_events(rows, settings)
    script = "\n".join(r["line"] for r in lines.orderBy("section", "id").collect())
    assert "\\pos(270,1440)" in script and "\\c&H" in script and "PlayResX: 1080" in script
    many = lines.unionByName(lines.withColumn("video_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(40)), lambda i: F.concat(F.lit("w"), i)))))
    folder = str(tmp_path / "scripts")
    projects.write_event_scripts(many, folder)
    for video in ("v", "w7"):
        assert "\n".join(r["line"] for r in projects.event_script(spark, folder, video).collect()) == script
    assert len(spark.read.parquet(folder).inputFiles()) <= 8 and projects.event_script(spark, folder, "none").count() == 0
    projects.export_event_script(spark, folder, "v", str(tmp_path / "one"))
    assert "\n".join(r["value"] for r in spark.read.text(str(tmp_path / "one")).collect()) == script


def test_edit_keys_differ(spark):
    a = spark.createDataFrame([("a", 0, 0, 10000), ("b", 0, 1000, 3000), ("b", 1, 6000, 8000), ("c", 0, 0, 10000)], "video_id string, ord int, src_start_ms bigint, src_end_ms bigint")
    keys = {r["video_id"]: r["edit_key"] for r in projects.edit_key(a).collect()}
    assert keys["a"] != keys["b"] and keys["a"] == keys["c"] and len(keys["a"]) == 16
