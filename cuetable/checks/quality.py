"""Coverage, alignment and validation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable.checks.captions import LABELS, PATTERNS, TERMS
from cuetable.operators import classify, quality

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# Events as recognised segments: errors have no text, signups no times.
SEGMENTS = b.with_sql("intervals") + """, segments AS (SELECT video_id, id AS seg_id, start_ms, end_ms, CASE WHEN kind = 'error' THEN '' ELSE kind END AS text,
  kind <> 'signup' OR weight > 20 AS timed, CAST(floor(weight) AS BIGINT) AS n_chars FROM intervals)"""


def segments(spark, sf):
    return b.intervals(spark, sf).select(
        "video_id", F.col("id").alias("seg_id"), "start_ms", "end_ms", F.when(F.col("kind") == "error", "").otherwise(F.col("kind")).alias("text"),
        ((F.col("kind") != "signup") | (F.col("weight") > 20)).alias("has_token_timestamps"), F.floor("weight").alias("n_chars"), F.col("kind").alias("language"))


COVERAGE = SEGMENTS + """, sums AS (SELECT video_id, count(*) AS vad_segments, count(*) FILTER (text <> '' AND timed) AS recognized_segments,
  CAST(sum(end_ms - start_ms) AS BIGINT) AS speech_ms, CAST(coalesce(sum(end_ms - start_ms) FILTER (text <> '' AND timed), 0) AS BIGINT) AS recognized_ms FROM segments GROUP BY video_id),
quality AS (SELECT video_id, CASE WHEN vad_segments = recognized_segments AND recognized_ms / speech_ms >= 0.985 THEN 'ok' ELSE 'needs_review' END AS status, 'token' AS timestamp_mode,
  vad_segments, recognized_segments, speech_ms, recognized_ms, speech_ms - recognized_ms AS uncovered_ms, round(recognized_ms / speech_ms, 4) AS coverage_ratio FROM sums)"""


@check("coverage_quality", COVERAGE + " SELECT * FROM quality")
def _(spark, sf):
    return quality.coverage_quality(segments(spark, sf))


@check("unresolved_segments", SEGMENTS + " SELECT video_id, seg_id, start_ms, end_ms FROM segments WHERE text = '' OR NOT timed")
def _(spark, sf):
    return quality.unresolved_segments(segments(spark, sf))


@check("coverage_tail", b.with_sql("intervals") + """, ends AS (SELECT video_id, arg_max(end_ms, id) AS n, arg_max(end_ms, id) FILTER (kind <> 'error') - 1234 AS a,
  max(end_ms) + 7000000 AS d FROM intervals GROUP BY video_id)
SELECT video_id, a AS recognized_ms, greatest(0, d - a) AS uncovered_ms, round(least(1.0, a / d), 4) AS coverage_ratio, n - a AS alignment_delta_ms FROM ends""")
def _(spark, sf):
    rows = b.intervals(spark, sf).withColumn("seg_id", F.lit(0)).withColumn("pos", F.col("id"))
    aligned = rows.filter("kind <> 'error'").withColumn("end_ms", F.col("end_ms") - 1234)
    return quality.coverage_tail(rows, b.media_of(rows, slack_ms=7_000_000), aligned)


@check("detected_languages", "SELECT source, string_agg(DISTINCT lang, '|' ORDER BY lang) AS languages FROM documents WHERE lang <> '' GROUP BY source")
def _(spark, sf):
    docs = b.table(spark, sf, "documents").select(F.col("source").alias("video_id"), F.col("lang").alias("language"))
    return quality.detected_languages(docs).select(F.col("video_id").alias("source"), F.array_join("languages", "|").alias("languages"))


@check("best_candidate", """SELECT CAST(conv_id AS VARCHAR) AS video_id, attempt, n_chars, md5(text) AS digest FROM (
  SELECT conv_id, turn AS attempt, length(text) // 100 AS n_chars, text, role <> 'system' AS timed,
         row_number() OVER (PARTITION BY conv_id ORDER BY role = 'user' DESC, length(text) // 100 DESC,
           length(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' +([，。！？；、,.!?;:])', '\\1', 'g')) DESC, turn) AS r FROM conversations) WHERE r = 1""")
def _(spark, sf):
    rows = b.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.lit(0).alias("seg_id"), F.col("turn").alias("attempt"), "text",
        F.floor(F.length("text") / 100).alias("n_chars"), (F.col("role") == "user").alias("has_token_timestamps"))
    return quality.best_candidate(rows).select("video_id", "attempt", "n_chars", F.md5("text").alias("digest"))


@check("needs_fallback", SEGMENTS + """ SELECT video_id, seg_id FROM segments WHERE text = '' OR NOT timed
  OR ((end_ms - start_ms) / 1000.0 >= 1.2 AND n_chars / (greatest(10, (end_ms - start_ms)) / 1000.0) < 0.0019999) """)
def _(spark, sf):
    # The events' values are far sparser than speech; times are scaled so that the threshold of 0.45 splits them.
    rows = segments(spark, sf).withColumn("n_chars", F.col("n_chars") * (0.45 / 0.0019999))
    return quality.needs_fallback(rows).select("video_id", "seg_id")


@check("all_attempts", SEGMENTS + """ SELECT video_id, seg_id, 0 AS attempt FROM segments UNION ALL SELECT video_id, seg_id, 1 FROM segments WHERE text = ''""")
def _(spark, sf):
    rows = segments(spark, sf)
    return quality.all_attempts(rows, rows.filter("text = ''")).select("video_id", "seg_id", "attempt")


REGIONS = b.with_sql("intervals") + """, chars AS (SELECT video_id, id AS pos, start_ms, end_ms, kind FROM intervals WHERE end_ms > start_ms),
regions AS (SELECT video_id, id AS region_id, start_ms - 20000000 AS rs, start_ms + 10000000 AS re FROM intervals WHERE kind = 'purchase'),
selected AS (SELECT video_id, pos, start_ms, end_ms, kind, region_id FROM chars JOIN regions USING (video_id) WHERE end_ms > rs AND start_ms < re)"""


def _regions(spark, sf):
    rows = b.intervals(spark, sf)
    chars = rows.filter("end_ms > start_ms").select("video_id", F.col("id").alias("pos"), "start_ms", "end_ms", "kind")
    regions = rows.filter("kind = 'purchase'").select("video_id", F.col("id").alias("region_id"), (F.col("start_ms") - 20_000_000).alias("start_ms"),
                                                      (F.col("start_ms") + 10_000_000).alias("end_ms"))
    return chars, quality.chars_in_regions(chars, regions, bin_ms=20_000_000)


@check("chars_in_regions", REGIONS + " SELECT video_id, pos, region_id FROM selected")
def _(spark, sf):
    return _regions(spark, sf)[1].select("video_id", "pos", "region_id")


@check("alignment_accept", REGIONS + """, numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id, region_id ORDER BY start_ms, pos) - 1 AS k,
  count(*) OVER (PARTITION BY video_id, region_id) AS want FROM selected),
aligned AS (SELECT * FROM numbered WHERE NOT (kind = 'view' AND want > 3)),
renum AS (SELECT *, row_number() OVER (PARTITION BY video_id, region_id ORDER BY k) - 1 AS ak, count(*) OVER (PARTITION BY video_id, region_id) AS have FROM aligned),
good AS (SELECT video_id, region_id, any_value(want) AS want, any_value(have) AS have FROM renum WHERE have >= greatest(1, floor(want * 0.8)) GROUP BY ALL),
anchors AS (SELECT video_id, region_id, arg_min(start_ms, k) AS anchor FROM numbered GROUP BY ALL),
firsts AS (SELECT video_id, region_id, arg_min(start_ms + 77, ak) AS f FROM renum GROUP BY ALL),
video AS (SELECT n.video_id, coalesce(g.a, 0) >= greatest(1, floor(n * 0.45)) AS enough FROM (SELECT video_id, count(*) AS n FROM chars GROUP BY video_id) n
  LEFT JOIN (SELECT video_id, sum(least(have, want)) AS a FROM good GROUP BY video_id) g USING (video_id))
SELECT r.video_id, CAST(r.region_id AS BIGINT) AS region_id, ak AS pos, start_ms + 77 - f + anchor AS start_ms, end_ms + 77 - f + anchor AS end_ms, 'fa_zh_vad_corrected' AS timestamp_mode
FROM renum r JOIN good USING (video_id, region_id) JOIN anchors USING (video_id, region_id) JOIN firsts USING (video_id, region_id) JOIN video USING (video_id) WHERE enough
UNION ALL SELECT video_id, NULL, pos, start_ms, end_ms, 'paraformer_char_fallback' FROM chars JOIN video USING (video_id) WHERE NOT enough""")
def _(spark, sf):
    from pyspark.sql import Window
    chars, found = _regions(spark, sf)
    w = Window.partitionBy("video_id", "region_id")
    rows = found.select("video_id", "region_id", "kind", "start_ms", "end_ms",
                        (F.row_number().over(w.orderBy("start_ms", "pos")) - 1).cast("bigint").alias("pos"), F.count(F.lit(1)).over(w).alias("want"))
    # The aligner misses the views of the larger regions.
    kept = rows.filter(~((F.col("kind") == "view") & (F.col("want") > 3)))
    aligned = kept.select("video_id", "region_id", (F.row_number().over(w.orderBy("pos")) - 1).cast("bigint").alias("pos"),
                          (F.col("start_ms") + 77).alias("rel_start_ms"), (F.col("end_ms") + 77).alias("rel_end_ms"))
    return quality.alignment_accept(rows, aligned, chars, video_share=0.45)


@check("frame_risk", """SELECT l_orderkey AS video_id, l_linenumber AS time_ms, round(coalesce(max(CASE WHEN l_suppkey % 3 <> 0 AND l_quantity >= 100 * 0.035 AND l_quantity <= 100 * 0.55
  AND l_partkey % 90 / greatest(l_suppkey % 40, 1) BETWEEN 0.55 AND 3.2 AND l_partkey % 100 <= 100 * 0.86
  THEN least(1.0, l_discount * 7.0) * CASE WHEN l_partkey % 100 + l_suppkey % 40 / 2 > 100 * 0.25 THEN 1.0 ELSE 0.7 END END), 0), 3) AS board_risk, coalesce(max(CASE WHEN l_suppkey % 3 <> 0 AND l_quantity >= 100 * 0.035 AND l_quantity <= 100 * 0.55
  AND l_partkey % 90 / greatest(l_suppkey % 40, 1) BETWEEN 0.55 AND 3.2 AND l_partkey % 100 <= 100 * 0.86
  THEN least(1.0, l_discount * 7.0) * CASE WHEN l_partkey % 100 + l_suppkey % 40 / 2 > 100 * 0.25 THEN 1.0 ELSE 0.7 END END), 0) < 0.48 AS overlay_allowed FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    contours = b.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("video_id"), F.col("l_linenumber").alias("time_ms"), F.when(F.col("l_suppkey") % 3 != 0, 4).otherwise(5).alias("corners"),
        F.col("l_quantity").alias("area"), F.lit(100).alias("image_area"), (F.col("l_partkey") % 90).alias("width"), (F.col("l_suppkey") % 40).alias("height"),
        (F.col("l_partkey") % 100).alias("y"), F.lit(100).alias("frame_height"), F.col("l_discount").alias("density"))
    return quality.frame_risk(contours)


# ---- validation: conversations as projects, settings and quality read off the conversation number's customer

PROJECTS = b.with_sql("captions") + f", {LABELS}" + """, projects AS (SELECT video_id, max(end_ms) AS spoken_ms FROM captions GROUP BY video_id),
settings AS (SELECT p.video_id, CASE WHEN c_nationkey = 3 THEN 0 ELSE spoken_ms - c_nationkey * 50 END AS d, c_nationkey * 500 AS h, c_nationkey * 9 AS font, c_acctbal / 80 AS x, c_acctbal / 100 AS y,
  c_nationkey > 15 AS has_edit, c_nationkey > 20 AS has_model, c_nationkey FROM projects p JOIN customer ON video_id = CAST(c_custkey AS VARCHAR)),
n AS (SELECT l.*, d, row_number() OVER w AS k, lag(end_ms) OVER w AS pe, count(*) OVER (PARTITION BY video_id) AS total FROM labelled l JOIN settings USING (video_id)
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id)),
issues AS (
  SELECT video_id, 'duration' AS rule, 'error' AS level, CAST(d AS VARCHAR) AS detail FROM settings WHERE d <= 0
  UNION ALL SELECT video_id, 'hook_length', CASE WHEN has_edit THEN 'warning' ELSE 'error' END, CAST(h AS VARCHAR) FROM settings WHERE (has_model OR NOT has_edit) AND NOT h BETWEEN 3000 AND 10000
  UNION ALL SELECT video_id, 'font_size', 'error', CAST(font AS VARCHAR) FROM settings WHERE NOT font BETWEEN 16 AND 160
  UNION ALL SELECT video_id, 'subtitle_x', 'error', CAST(CAST(floor(x * 1000) AS BIGINT) AS VARCHAR) FROM settings WHERE NOT x BETWEEN 0 AND 100
  UNION ALL SELECT video_id, 'subtitle_y', 'error', CAST(CAST(floor(y * 1000) AS BIGINT) AS VARCHAR) FROM settings WHERE NOT y BETWEEN 0 AND 100
  UNION ALL SELECT video_id, 'caption_time', 'error', CAST(k AS VARCHAR) FROM n WHERE start_ms < 0 OR end_ms <= start_ms OR end_ms > d + 100
  UNION ALL SELECT video_id, 'caption_overlap', 'warning', CAST(k AS VARCHAR) FROM n WHERE start_ms < pe - 20
  UNION ALL SELECT video_id, 'edit_review', 'warning', CAST(k AS VARCHAR) FROM n WHERE length(text) > 700
  UNION ALL SELECT video_id, 'unfinished_ending', 'error', CAST(k AS VARCHAR) FROM n WHERE k = total AND regexp_matches(regexp_replace(text, '[，。！？；,.!?; ]+$', ''), '(n|e)$')
  UNION ALL SELECT s.video_id, 'hook_label', CASE WHEN has_edit THEN 'warning' ELSE 'error' END, '' FROM settings s WHERE (has_model OR NOT has_edit)
    AND NOT EXISTS (SELECT 1 FROM labelled l WHERE l.video_id = s.video_id AND label IN ('benefit', 'selling_point') AND start_ms < h)
  UNION ALL SELECT video_id, 'timestamp_mode', 'warning', 'estimated' FROM settings WHERE c_nationkey % 2 = 0
  UNION ALL SELECT video_id, 'coverage', 'warning', CAST(c_nationkey * 40 AS VARCHAR) FROM settings WHERE c_nationkey = 5 OR c_nationkey * 40 > 450
  UNION ALL SELECT video_id, 'fallback_error', 'warning', 'failed' FROM settings WHERE c_nationkey = 7
  UNION ALL SELECT DISTINCT n.video_id, 'hook_host', 'warning', '' FROM n JOIN settings USING (video_id) WHERE length(text) < 200 AND start_ms <= h)"""


def _projects(spark, sf):
    rows = classify.classify(b.captions(spark, sf), TERMS, PATTERNS).withColumn("edit_review", F.length("text") > 700)
    spoken = rows.groupBy("video_id").agg(F.max("end_ms").alias("spoken_ms"))
    nation = F.col("c_nationkey")
    people = b.table(spark, sf, "customer").select(F.col("c_custkey").cast("string").alias("video_id"), nation, "c_acctbal")
    made = spoken.join(people, "video_id").select(
        "video_id", F.when(nation == 3, 0).otherwise(F.col("spoken_ms") - nation * 50).alias("duration_ms"), (nation * 500).alias("hook_end_ms"),
        (nation * 9).alias("font_size"), (F.col("c_acctbal") / 80).alias("subtitle_x"), (F.col("c_acctbal") / 100).alias("subtitle_y"),
        (nation > 15).alias("has_edit"), (nation > 20).alias("has_model"), "c_nationkey")
    measured = made.select(
        "video_id", F.when(nation == 5, "needs_review").otherwise("ok").alias("status"), F.when(nation % 2 == 0, "estimated").otherwise("token").alias("timestamp_mode"),
        (nation * 40).alias("uncovered_ms"), F.when(nation == 7, "failed").otherwise("").alias("fallback_error"))
    samples = rows.select("video_id", F.col("start_ms").alias("time_ms"), (F.length("text") >= 200).alias("host_visible"))
    return made, rows, samples, measured


@check("validate", PROJECTS + """ SELECT video_id, rule, level, detail FROM issues
UNION ALL SELECT video_id, 'ok', 'ok', '' FROM settings WHERE video_id NOT IN (SELECT video_id FROM issues)""")
def validated(spark, sf):
    made, rows, samples, measured = _projects(spark, sf)
    found = quality.validate(made, rows, samples, measured, connectives=("n", "e"))
    thousandths = F.floor(F.col("detail").try_cast("double") * 1000).cast("bigint").cast("string")  # numbers are written in different ways
    return found.withColumn("detail", F.when(F.col("rule").isin("subtitle_x", "subtitle_y"), thousandths).otherwise(F.col("detail")))


@check("blocking_issues", PROJECTS + " SELECT video_id, count(*) AS errors FROM issues WHERE level = 'error' GROUP BY video_id")
def _(spark, sf):
    return quality.blocking_issues(validated(spark, sf))


@check("hook_has_benefit", PROJECTS + " SELECT DISTINCT video_id FROM labelled JOIN settings USING (video_id) WHERE label IN ('benefit', 'selling_point') AND start_ms < h")
def _(spark, sf):
    made, rows, _, _ = _projects(spark, sf)
    return quality.hook_has_benefit(rows.withColumn("selected", F.lit(True)), made)


@check("export_length_check", """SELECT o_orderkey AS video_id, expected_ms, actual_ms, video_codec, NOT (video_codec = '' OR abs(actual_ms - expected_ms) > greatest(1000, expected_ms * 0.01)) AS complete FROM (
  SELECT o_orderkey, o_custkey * 1000 AS expected_ms, o_custkey * 1000 + o_orderkey % 2001 - 1000 + o_custkey AS actual_ms, CASE WHEN o_orderstatus = 'P' THEN '' ELSE 'h264' END AS video_codec FROM orders)""")
def _(spark, sf):
    rows = b.table(spark, sf, "orders")
    expected = rows.select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") * 1000).alias("duration_ms"))
    actual = rows.select(F.col("o_orderkey").alias("video_id"), (F.col("o_custkey") * 1001 + F.col("o_orderkey") % 2001 - 1000).alias("duration_ms"),
                         F.when(F.col("o_orderstatus") == "P", "").otherwise("h264").alias("video_codec"))
    return quality.export_length_check(expected, actual)
