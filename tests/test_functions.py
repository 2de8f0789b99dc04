import math

from pyspark.sql import functions as F

from cuetable.functions import ids, text, timing


def one(spark, col, **values):
    df = spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()]) if values else spark.range(1)
    return df.select(col.alias("x")).first()["x"]


def each(spark, col, values, ddl):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {ddl}")
    return [r["x"] for r in rows.select("i", col.alias("x")).orderBy("i").collect()]


def test_product_from_name(spark):
    names = ["D:\\videos\\2026.8.27绽家香水油五腔香氛洗衣凝珠-1.mp4", "/a/12_面膜_v3_final.mp4", "2024-1-2洗发水_功效精剪第二版.mov"]
    assert each(spark, ids.product_from_name(F.col("v")), names, "string") == ["绽家香水油五腔香氛洗衣凝珠", "面膜", "洗发水"]


def test_safe_stem(spark):
    paths = ["/x/a<b>:c|d.mp4", "/x/ ._.mp4", "/x/" + "y" * 150 + ".mp4", "noext"]
    assert each(spark, ids.safe_stem(F.col("v")), paths, "string") == ["a_b_c_d", "video", "y" * 100, "noext"]


def test_normalize_text(spark):
    texts = ["<|en|>  Easy  to\nuse. ", "这 款产品 contains organic ingredients。", "a\u3000b ,c", "好 ，的"]
    assert each(spark, text.normalize_text(F.col("v")), texts, "string") == ["Easy to use.", "这款产品 contains organic ingredients。", "a b,c", "好，的"]


def test_marker_target(spark):
    pairs = [(0, 0), (30, 5), (60, 10), (75, 10), (75.1, 12), (100, 12), (100.1, 14), (120, 14), (121, 15), (180, 21), (300, 35), (600, 70),
             (1800, 210), (3600, 420), (-5, 0), (1, 1)]
    got = each(spark, timing.marker_target(F.col("v")), [int(d * 1000) for d, _ in pairs], "bigint")
    assert got == [t for _, t in pairs]
    assert each(spark, timing.marker_target(F.col("v")), [float("nan"), float("inf"), None], "double") == [0, 0, 0]


def test_fallback_language(spark):
    assert each(spark, text.fallback_language(F.col("v")), ["auto", "en", "zh", "yue", "ja"], "string") == [None, "en", "zh", "zh", "ja"]


def test_tempo_chain(spark):
    rows = spark.createDataFrame([(180, 4000), (850, 80), (300, 300), (100, 8000), (8000, 80)], "s bigint, d bigint")
    for r in rows.select("s", "d", timing.tempo_chain(F.col("s"), F.col("d")).alias("c")).collect():
        assert all(0.5 <= f <= 2.0 for f in r["c"])
        assert math.isclose(math.prod(r["c"]), max(0.01, r["s"] / r["d"]), rel_tol=1e-5)


def test_caption_script_values(spark):
    assert each(spark, text.ass_time(F.col("v")), [-50, 0, 61230, 3600000, 3725450], "bigint") == [
        "0:00:00.00", "0:00:00.00", "0:01:01.23", "1:00:00.00", "1:02:05.45"]
    assert each(spark, text.ass_color(F.col("v")), ["#FFD43B", "#abc", ""], "string") == ["&H003BD4FF", "&H00FFCFAB", "&H00FFFFFF"]
    assert each(spark, text.ass_escape(F.col("v")), ["a{b}\\c\nd"], "string") == ["a\\{b\\}\\\\c\\Nd"]
    marked = text.highlight_markup(F.lit("持久留香留"), F.array(F.lit("留"), F.lit("留香"), F.lit(" ")), F.lit("N"), F.lit("A"))
    assert one(spark, marked) == "持久{\\cA}{\\cA}留{\\cN}香{\\cN}{\\cA}留{\\cN}"


def test_extract_json(spark):
    raw = ["noise [1] then {\"items\":[{\"id\":1}]} end", "{broken [2, 3]", "nothing", "[[1,2],[3]] {\"a\":1}"]
    assert each(spark, text.extract_json(F.col("v")), raw, "string") == ['{"items": [{"id": 1}]}', "[2, 3]", None, "[[1, 2], [3]]"]


def test_text_ratio(spark):
    rows = spark.createDataFrame([("abcd", "bcde"), ("", ""), ("a", "b")], "a string, b string")
    assert [r[0] for r in rows.select(text.text_ratio(F.col("a"), F.col("b"))).collect()] == [0.75, 1.0, 0.0]


def test_word_continues(spark):
    rows = spark.createDataFrame([("a", "b", ""), ("1", "5", "."), ("a", "b", "."), ("n", "t", "'"), ("好", "b", ""), ("a", "b", " "), ("é", "a", "-")],
                                 "l string, r string, s string")
    assert [r[0] for r in rows.select(text.word_continues(F.col("l"), F.col("r"), F.col("s"))).collect()] == [True, True, False, True, False, False, True]


def test_incomplete_ending(spark):
    assert each(spark, text.incomplete_ending(F.col("v")), ["就这样。", "但是，", "这个", "给！"], "string") == [False, True, True, True]


def test_frames(spark):
    rows = spark.createDataFrame([(1010, 25, 1), (1010, 30000, 1001), (1010, 0, 0), (1010, None, None)], "ms bigint, n int, d int")
    assert [r[0] for r in rows.select(timing.snap_to_frame(F.col("ms"), F.col("n"), F.col("d"))).collect()] == [1000, 1001, 1000, 1000]


def test_sample_times(spark):
    media = spark.createDataFrame([("a", 5000), ("b", 400), ("c", 500)], "video_id string, duration_ms bigint")
    got = sorted(tuple(r) for r in timing.sample_times(media, 2000).collect())
    assert got == [("a", 500), ("a", 2500), ("a", 4500)]


def test_name_score(spark):
    rows = spark.createDataFrame([("香水油", "香水"), ("abc", "xyz"), ("abc", "cab")], "q string, n string")
    got = [round(r[0], 3) for r in rows.select(text.name_score(F.col("q"), F.col("n"))).collect()]
    assert got == [round(2 / 3 + 1, 3), 0.0, 1.0]
