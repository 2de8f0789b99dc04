"""Timeline and edit-list queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable.functions.timing import sample_times
from cuetable.operators import edits, timeline
from cuetable.plans.ordered import by_time

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


DAY = 86_400_000
NORMAL = b.with_sql("intervals") + """,
raw AS (SELECT video_id, id, start_ms AS rs, end_ms AS re, greatest(0, start_ms) AS s, least(greatest(greatest(0, start_ms) + 200, end_ms), d) AS e
  FROM (SELECT *, max(end_ms) OVER (PARTITION BY video_id) - 1000 AS d FROM intervals)),
near AS (SELECT *, lag(e) OVER w AS pe, lead(s) OVER w AS ns, row_number() OVER w - 1 AS new_id FROM raw
  WINDOW w AS (PARTITION BY video_id ORDER BY rs, re, id)),
cut AS (SELECT *, CASE WHEN s < pe THEN (s + pe + 1) // 2 ELSE s END AS ns2 FROM near),
normal AS (SELECT video_id, new_id AS id, ns2 AS start_ms,
  CASE WHEN ns < e THEN greatest(ns2 + 200, (ns + e + 1) // 2 - 10) ELSE e END AS end_ms FROM cut)
"""


def _normal(spark, sf):
    rows = b.intervals(spark, sf)
    return timeline.normalize_timeline(rows.select("video_id", "id", "start_ms", "end_ms", "text"),
                                       b.media_of(rows, slack_ms=-1000), span_ms=DAY)


@check("normalize_timeline", NORMAL + "SELECT * FROM normal")
def _(spark, sf):
    return _normal(spark, sf).drop("text")


@check("overlap_counts", NORMAL + """SELECT video_id, count(*) AS n_overlaps, CAST(sum(pe - start_ms) AS BIGINT) AS overlap_ms
FROM (SELECT *, lag(end_ms) OVER (PARTITION BY video_id ORDER BY start_ms, id) AS pe FROM normal)
WHERE start_ms < pe - 20 GROUP BY video_id""")
def overlap_counts(spark, sf):
    rows = timeline.overlaps(_normal(spark, sf), span_ms=DAY)
    return rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n_overlaps"),
                                        F.sum(F.col("prev_end_ms") - F.col("start_ms")).alias("overlap_ms"))


@check("overlaps", b.with_sql("intervals") + """SELECT video_id, id, position, prev_end_ms FROM (
  SELECT video_id, id, start_ms, row_number() OVER w - 1 AS position, lag(end_ms) OVER w AS prev_end_ms FROM intervals
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id)) WHERE start_ms < prev_end_ms - 20""")
def _(spark, sf):
    return timeline.overlaps(b.intervals(spark, sf), span_ms=DAY).select("video_id", "id", "position", "prev_end_ms")


@check("pad_regions", b.with_sql("intervals") + """, near AS (
  SELECT *, lag(end_ms) OVER w AS pe, lead(start_ms) OVER w AS ns, max(end_ms) OVER (PARTITION BY video_id) AS d FROM intervals
  WINDOW w AS (PARTITION BY video_id ORDER BY start_ms, id)),
padded AS (SELECT video_id, id, d, greatest(0, start_ms - 5000000, coalesce((pe + start_ms) // 2, 0)) AS s,
  least(d, end_ms + 5000000, coalesce((end_ms + ns) // 2, d)) AS e FROM near)
SELECT video_id, id AS region_id, s AS start_ms, e AS end_ms, greatest(0, s - 250000) AS retry_start_ms,
  least(d, e + 250000) AS retry_end_ms FROM padded""")
def _(spark, sf):
    rows = b.intervals(spark, sf)
    return timeline.pad_regions(rows.withColumnRenamed("id", "region_id"), b.media_of(rows), 5_000_000, 250_000, span_ms=DAY)


# Tokens from events: the user's events of one day are a segment; times are scaled by 10,000.
TOKENS = b.with_sql("points") + """,
tokens AS (SELECT video_id, time_ms // 86400000 AS seg_id, id AS pos, kind AS text, time_ms AS start_ms FROM points),
gaps AS (SELECT *, lead(start_ms) OVER (PARTITION BY video_id, seg_id ORDER BY pos) AS ns FROM tokens),
typical AS (SELECT video_id, seg_id, coalesce(median(CASE WHEN ns - start_ms BETWEEN 350000 AND 8000000 THEN ns - start_ms END),
  1800000.0) AS typical_ms FROM gaps GROUP BY ALL),
timed AS (SELECT *, seg_id * 86400000 AS seg_s, seg_id * 86400000 + 86400000 AS seg_e FROM gaps JOIN typical USING (video_id, seg_id)),
token_intervals AS (SELECT video_id, seg_id, pos, text, start_ms, greatest(start_ms + 600000, least(seg_e,
  CASE WHEN ns - start_ms <= 5000000 THEN ns ELSE least(seg_e, start_ms + CAST(greatest(1200000, least(3800000,
    round(typical_ms * 1.65))) AS BIGINT)) END)) AS end_ms FROM timed)
"""


def _tokens(spark, sf):
    return b.points(spark, sf).select("video_id", F.floor(F.col("time_ms") / DAY).alias("seg_id"), F.col("id").alias("pos"),
                                      F.col("kind").alias("text"), F.col("time_ms").alias("start_ms"))


def _segments(spark, sf):
    return _tokens(spark, sf).select("video_id", "seg_id").distinct().select(
        "*", (F.col("seg_id") * DAY).alias("start_ms"), (F.col("seg_id") * DAY + DAY).alias("end_ms"))


def _intervals(spark, sf):
    return timeline.token_intervals(
        _tokens(spark, sf), _segments(spark, sf), close_ms=5_000_000, low_ms=350_000, high_ms=8_000_000, default_ms=1_800_000,
        shortest_ms=1_200_000, longest_ms=3_800_000, floor_ms=600_000)


@check("typical_step", TOKENS + "SELECT * FROM typical")
def _(spark, sf):
    return timeline.typical_step(_tokens(spark, sf), 350_000, 8_000_000, 1_800_000)


@check("token_intervals", TOKENS + "SELECT * FROM token_intervals")
def _(spark, sf):
    return _intervals(spark, sf)


@check("expand_chars", TOKENS + """, split AS (SELECT *, length(text) AS n, greatest(1, end_ms - start_ms) AS len,
  unnest(range(0, length(text))) AS char_pos FROM token_intervals)
SELECT video_id, seg_id, pos AS token_pos, char_pos, text[char_pos + 1] AS text, start_ms + (2 * len * char_pos + n) // (2 * n) AS start_ms,
  start_ms + (2 * len * (char_pos + 1) + n) // (2 * n) AS end_ms, '' AS prefix FROM split""")
def _(spark, sf):
    return timeline.expand_chars(_intervals(spark, sf)).withColumn("char_pos", F.col("char_pos").cast("bigint"))


@check("number_chars", TOKENS + """, split AS (SELECT *, unnest(range(0, length(text))) AS c FROM token_intervals)
SELECT video_id, seg_id, row_number() OVER (PARTITION BY video_id, seg_id ORDER BY pos, c) - 1 AS pos, text[c + 1] AS text FROM split""")
def _(spark, sf):
    return timeline.number_chars(timeline.expand_chars(_intervals(spark, sf))).select("video_id", "seg_id", "pos", "text")


@check("word_intervals", b.with_sql("intervals") + """SELECT video_id, id // 1000 AS seg_id, id AS pos, kind AS text,
  greatest(600000000, least(1800000000, start_ms)) AS start_ms,
  greatest(greatest(600000000, least(1800000000, start_ms)) + 60, least(1800000000, end_ms + 20)) AS end_ms FROM intervals""")
def _(spark, sf):
    words = b.intervals(spark, sf).select("video_id", F.floor(F.col("id") / 1000).alias("seg_id"), F.col("id").alias("pos"), "text", "start_ms", "end_ms")
    segments = words.select("video_id", "seg_id").distinct().select(
        "*", F.lit(600_000_000).cast("bigint").alias("start_ms"), F.lit(1_800_000_000).cast("bigint").alias("end_ms"))
    return timeline.word_intervals(words, segments)


@check("allocate_time", """WITH lines AS (SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS seg_id,
  unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS piece FROM conversations),
sized AS (SELECT *, coalesce(sum(length(text)) OVER (PARTITION BY video_id, seg_id ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
  greatest(1, sum(length(text)) OVER (PARTITION BY video_id, seg_id)) AS whole, max(piece) OVER (PARTITION BY video_id, seg_id) AS final FROM lines)
SELECT video_id, seg_id, piece, text, CAST(seg_id * 1000 + (2 * 60000 * done + whole) // (2 * whole) AS BIGINT) AS start_ms,
  CAST(CASE WHEN piece = final THEN seg_id * 1000 + 60000 ELSE seg_id * 1000 + (2 * 60000 * (done + length(text)) + whole) // (2 * whole) END AS BIGINT) AS end_ms FROM sized""")
def _(spark, sf):
    lines = b.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("seg_id"),
        F.posexplode(F.split("text", "\n", -1)).alias("piece", "text"))
    lines = lines.select("*", (F.col("seg_id") * 1000).alias("seg_start_ms"), (F.col("seg_id") * 1000 + 60000).alias("seg_end_ms"))
    return timeline.allocate_time(lines).withColumn("piece", F.col("piece").cast("bigint"))


@check("nearest_gap", b.with_sql("points") + """SELECT video_id, id, least(time_ms - lag(time_ms) OVER w, lead(time_ms) OVER w - time_ms) AS nearest_ms
FROM points WINDOW w AS (PARTITION BY video_id ORDER BY time_ms, id)""")
def _(spark, sf):
    return timeline.nearest_gap(b.points(spark, sf), span_ms=DAY).select("video_id", "id", "nearest_ms")


@check("renumber", b.with_sql("points") + "SELECT video_id, time_ms, row_number() OVER (PARTITION BY video_id ORDER BY time_ms, id) - 1 AS id FROM points")
def _(spark, sf):
    return timeline.renumber(b.points(spark, sf).select("video_id", "time_ms", "id"), ["video_id"], ["time_ms", "id"], by_time("time_ms", DAY))


@check("timeline_order", b.with_sql("captions") + "SELECT video_id, id, start_ms, end_ms FROM captions WHERE trim(text) <> '' ORDER BY video_id, start_ms, end_ms, id")
def _(spark, sf):
    return timeline.timeline_order(b.captions(spark, sf)).select("video_id", "id", "start_ms", "end_ms")


@check("first_distinct", "SELECT user_id, min(event_id) AS first_position FROM events GROUP BY user_id")
def _(spark, sf):
    return timeline.first_distinct(b.table(spark, sf, "events"), "user_id", "event_id")


@check("sample_times", b.with_sql("captions") + """, media AS (SELECT video_id, max(end_ms) AS d FROM captions GROUP BY video_id)
SELECT video_id, CAST(round_even(t / 10.0, 0) * 10 AS BIGINT) AS time_ms
FROM (SELECT video_id, unnest(generate_series(500, d - 1, 2005)) AS t FROM media WHERE d > 500)""")
def _(spark, sf):
    return sample_times(b.media_of(b.captions(spark, sf)), 2005)


# ---- edit lists

@check("layout", b.with_sql("clips", "laid") + "SELECT video_id, ord, clip_id, out_start_ms, out_end_ms FROM laid")
def _(spark, sf):
    return edits.layout(b.clips(spark, sf)).select("video_id", F.col("ord").cast("bigint").alias("ord"), "clip_id", "out_start_ms", "out_end_ms")


@check("edit_duration", b.with_sql("clips", "totals") + """SELECT CAST(o_orderkey AS VARCHAR) AS video_id, coalesce(edit_ms, 0) AS edit_ms
FROM orders LEFT JOIN totals ON video_id = CAST(o_orderkey AS VARCHAR)""")
def _(spark, sf):
    videos = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"))
    return edits.edit_duration(b.clips(spark, sf), videos)


@check("is_contiguous", b.with_sql("clips") + """SELECT video_id, bool_and(coalesce(p, 0) = src_start_ms AND (n IS NOT NULL OR abs(src_end_ms - d) < 50)) AS contiguous
FROM (SELECT *, lag(src_end_ms) OVER w AS p, lead(src_start_ms) OVER w AS n, max(src_end_ms) OVER (PARTITION BY video_id) AS d FROM clips
      WINDOW w AS (PARTITION BY video_id ORDER BY ord)) GROUP BY video_id""")
def _(spark, sf):
    rows = b.clips(spark, sf)
    return edits.is_contiguous(rows, b.media_of(rows, "src_end_ms"))


# Orders of low priority have no edit list.
CLIP_MEDIA = """, media AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(floor(o_totalprice * 10) AS BIGINT) AS duration_ms,
  o_orderpriority <> '5-LOW' AS has_edit FROM orders),
judged AS (SELECT video_id, ord, clip_id, src_start_ms, src_end_ms, duration_ms,
  src_start_ms >= 0 AND src_start_ms < duration_ms AND src_end_ms > src_start_ms AND src_end_ms <= duration_ms + 50 AS good
  FROM clips JOIN media USING (video_id) WHERE has_edit),
bad AS (SELECT video_id, count(*) AS bad_clips FROM judged WHERE NOT good GROUP BY video_id)
"""


def _clip_media(spark, sf):
    return b.table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("video_id"), F.floor(F.col("o_totalprice") * 10).alias("duration_ms"),
        (F.col("o_orderpriority") != "5-LOW").alias("has_edit"))


@check("normalize_clips", b.with_sql("clips") + CLIP_MEDIA + """SELECT video_id, ord, clip_id, src_start_ms, least(src_end_ms, duration_ms) AS src_end_ms
FROM judged WHERE video_id NOT IN (SELECT video_id FROM bad)
UNION ALL SELECT video_id, 0, 'original', 0, duration_ms FROM media WHERE NOT has_edit""")
def _(spark, sf):
    return edits.normalize_clips(b.clips(spark, sf), _clip_media(spark, sf))[0].withColumn("ord", F.col("ord").cast("bigint"))


@check("rejected_clips", b.with_sql("clips") + CLIP_MEDIA + "SELECT video_id, bad_clips FROM bad")
def _(spark, sf):
    return edits.normalize_clips(b.clips(spark, sf), _clip_media(spark, sf))[1]


@check("locate", b.with_sql("clips", "laid", "totals") + """, times AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_custkey * 400 - 5000 AS BIGINT) AS t_ms FROM orders),
held AS (SELECT video_id, t_ms, edit_ms, greatest(0, least(edit_ms, t_ms)) AS t FROM times JOIN totals USING (video_id))
SELECT video_id, t_ms, ord, clip_id, src_start_ms + least(out_end_ms - out_start_ms, t - out_start_ms) AS source_ms
FROM held JOIN laid USING (video_id) WHERE out_start_ms <= least(t, edit_ms - 1) AND least(t, edit_ms - 1) < out_end_ms""")
def _(spark, sf):
    times = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_custkey") * 400 - 5000).alias("t_ms"))
    return edits.locate(times, b.clips(spark, sf), bin_ms=60_000).withColumn("ord", F.col("ord").cast("bigint"))


@check("to_output_time", b.with_sql("clips", "laid") + """, asked AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_orderpriority[1] AS BIGINT) - 1 AS ord, CAST(o_custkey * 1500 AS BIGINT) AS src_ms FROM orders)
SELECT a.video_id, a.ord, src_ms, coalesce(out_start_ms + greatest(0, least(out_end_ms - out_start_ms, src_ms - src_start_ms)), 0) AS t_ms
FROM asked a LEFT JOIN laid l ON a.video_id = l.video_id AND a.ord = l.ord""")
def _(spark, sf):
    asked = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.substring("o_orderpriority", 1, 1).cast("bigint") - 1).alias("ord"),
                                                (F.col("o_custkey") * 1500).alias("src_ms"))
    return edits.to_output_time(asked, b.clips(spark, sf))


@check("split_clip", b.with_sql("clips", "laid") + """, asked AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS video_id, CAST(o_orderpriority[1] AS BIGINT) - 1 AS ord, CAST(o_custkey * 100 AS BIGINT) AS t FROM orders),
marked AS (SELECT l.*, t, coalesce(t > out_start_ms + 25 AND t < out_end_ms - 25, false) AS cut FROM laid l LEFT JOIN asked a ON a.video_id = l.video_id AND a.ord = l.ord),
pieces AS (SELECT video_id, ord AS o, 0 AS part, clip_id, src_start_ms, CASE WHEN cut THEN src_start_ms + t - out_start_ms ELSE src_end_ms END AS src_end_ms FROM marked
  UNION ALL SELECT video_id, ord, 1, clip_id || '-s', src_start_ms + t - out_start_ms, src_end_ms FROM marked WHERE cut)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY o, part) - 1 AS ord, clip_id, src_start_ms, src_end_ms FROM pieces""")
def _(spark, sf):
    asked = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), (F.substring("o_orderpriority", 1, 1).cast("bigint") - 1).alias("ord"),
                                                (F.col("o_custkey") * 100).alias("t_ms"))
    return edits.split_clip(b.clips(spark, sf), asked).withColumn("ord", F.col("ord").cast("bigint"))


CUTS = """, cuts AS (SELECT CAST(o_orderkey AS VARCHAR) AS video_id, o_custkey * 40 AS s, o_custkey * 40 + 20000 AS e FROM orders WHERE o_orderstatus <> 'P')"""


def _cuts(spark, sf):
    rows = b.table(spark, sf, "orders").filter("o_orderstatus <> 'P'")
    return rows.select(F.col("o_orderkey").cast("string").alias("video_id"), (F.col("o_custkey") * 40).alias("cut_start_ms"),
                       (F.col("o_custkey") * 40 + 20000).alias("cut_end_ms"))


@check("ripple_clips", b.with_sql("clips", "laid") + CUTS + """, hit AS (SELECT l.*, s, e, s IS NULL OR out_end_ms <= s OR out_start_ms >= e AS whole FROM laid l LEFT JOIN cuts USING (video_id)),
pieces AS (SELECT video_id, ord AS o, 0 AS part, clip_id, src_start_ms, src_end_ms FROM hit WHERE whole
  UNION ALL SELECT video_id, ord, 0, clip_id, src_start_ms, src_start_ms + s - out_start_ms FROM hit WHERE NOT whole AND out_start_ms < s
  UNION ALL SELECT video_id, ord, 1, clip_id || '-r', src_start_ms + e - out_start_ms, src_end_ms FROM hit WHERE NOT whole AND out_end_ms > e)
SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY o, part) - 1 AS ord, clip_id, src_start_ms, src_end_ms FROM pieces""")
def _(spark, sf):
    return edits.ripple_delete({"clips": b.clips(spark, sf)}, _cuts(spark, sf))["clips"].withColumn("ord", F.col("ord").cast("bigint"))


VIDEO_CUTS = """, cuts AS (SELECT CAST(user_id AS VARCHAR) AS video_id, min(epoch_us(ts)) // 1000 - 1704067200000 + 300000000 AS s,
  min(epoch_us(ts)) // 1000 - 1704067200000 + 900000000 AS e FROM events GROUP BY user_id)"""
MOVED = "CASE WHEN {0} <= s THEN {0} WHEN {0} >= e THEN {0} - (e - s) ELSE s END"


def _video_cuts(spark, sf):
    first = b.points(spark, sf).groupBy("video_id").agg(F.min("time_ms").alias("t"))
    return first.select("video_id", (F.col("t") + 300_000_000).alias("cut_start_ms"), (F.col("t") + 900_000_000).alias("cut_end_ms"))


@check("ripple_captions", b.with_sql("intervals") + VIDEO_CUTS + f""", moved AS (SELECT video_id, id, {MOVED.format('start_ms')} AS a,
  {MOVED.format('end_ms')} AS z, start_ms < e AND end_ms > s AS edit_review FROM intervals JOIN cuts USING (video_id))
SELECT video_id, id, a AS start_ms, z AS end_ms, edit_review FROM moved WHERE z - a >= 30""")
def _(spark, sf):
    return edits.ripple_delete({"captions": b.intervals(spark, sf).select("video_id", "id", "start_ms", "end_ms")}, _video_cuts(spark, sf))["captions"]


@check("apply_edits", b.with_sql("intervals").replace("WITH ", "WITH RECURSIVE ", 1) + VIDEO_CUTS + f""", steps AS (SELECT video_id, 0 AS seq, s, e FROM cuts
  UNION ALL SELECT video_id, 1, s - 200000000, s - 50000000 FROM cuts WHERE CAST(video_id AS BIGINT) % 2 = 0
  UNION ALL SELECT video_id, 2, s + 100000000, s + 130000000 FROM cuts WHERE CAST(video_id AS BIGINT) % 4 = 0),
walk AS (SELECT video_id, id, 0 AS step, start_ms AS a, end_ms AS z, false AS edit_review FROM intervals
  UNION ALL SELECT w.video_id, w.id, w.step + 1, {MOVED.format('w.a')}, {MOVED.format('w.z')}, w.edit_review OR (w.a < s AND w.z > s) OR (w.a >= s AND w.a < e)
  FROM walk w JOIN steps t ON t.video_id = w.video_id AND t.seq = w.step WHERE ({MOVED.format('w.z')}) - ({MOVED.format('w.a')}) >= 30)
SELECT video_id, id, a AS start_ms, z AS end_ms, edit_review FROM walk JOIN (SELECT video_id, count(*) AS n FROM steps GROUP BY ALL) USING (video_id) WHERE step = n""")
def _(spark, sf):
    """Up to three cuts of a video, each on the timeline the last one left."""
    first, number = _video_cuts(spark, sf), F.col("video_id").cast("bigint")
    steps = first.withColumn("seq", F.lit(0)).unionByName(first.filter(number % 2 == 0).select(
        "video_id", (F.col("cut_start_ms") - 200_000_000).alias("cut_start_ms"), (F.col("cut_start_ms") - 50_000_000).alias("cut_end_ms"), F.lit(1).alias("seq"))).unionByName(
        first.filter(number % 4 == 0).select("video_id", (F.col("cut_start_ms") + 100_000_000).alias("cut_start_ms"), (F.col("cut_start_ms") + 130_000_000).alias("cut_end_ms"), F.lit(2).alias("seq")))
    return edits.apply_edits({"captions": b.intervals(spark, sf).select("video_id", "id", "start_ms", "end_ms")}, steps)["captions"]


HISTORIES = b.with_sql("intervals", "points").replace("WITH ", "WITH RECURSIVE ", 1) + """, first AS (SELECT video_id, min(time_ms) AS t0 FROM points GROUP BY video_id),
steps AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY id) - 1 AS seq, t0 + id * 7919 * 1009 % 2000000000 AS s, t0 + id * 7919 * 1009 % 2000000000 + (id % 9) * 1500000 AS e FROM points JOIN first USING (video_id)),
n AS (SELECT video_id, count(*) AS n FROM steps GROUP BY video_id)"""


def _histories(spark, sf):
    """Every event is a cut, in order of its number, on the timeline that the one before left."""
    points = b.points(spark, sf)
    rows = points.join(points.groupBy("video_id").agg(F.min("time_ms").alias("t")), "video_id")
    start = F.col("t") + F.col("id") * (7919 * 1009) % 2_000_000_000
    return rows.select("video_id", F.col("id").alias("seq"), start.alias("cut_start_ms"), (start + F.col("id") % 9 * 1_500_000).alias("cut_end_ms"))


@check("edit_histories", HISTORIES + f""", walk AS (SELECT video_id, id, 0 AS step, start_ms AS a, end_ms AS z, false AS edit_review FROM intervals
  UNION ALL SELECT w.video_id, w.id, w.step + 1, {MOVED.format('w.a')}, {MOVED.format('w.z')}, w.edit_review OR (e > s AND w.a < e AND w.z > s)
  FROM walk w JOIN steps t ON t.video_id = w.video_id AND t.seq = w.step WHERE e <= s OR ({MOVED.format('w.z')}) - ({MOVED.format('w.a')}) >= 30)
SELECT video_id, id, a AS start_ms, z AS end_ms, edit_review FROM walk JOIN n USING (video_id) WHERE step = n""")
def _(spark, sf):
    return edits.apply_edits({"captions": b.intervals(spark, sf).select("video_id", "id", "start_ms", "end_ms")}, _histories(spark, sf))["captions"]


@check("edit_histories_markers", HISTORIES + f""", walk AS (SELECT video_id, id, 0 AS step, start_ms AS t, end_ms - start_ms AS len FROM intervals
  UNION ALL SELECT w.video_id, w.id, w.step + 1, {MOVED.format('w.t')}, CASE WHEN e > s AND t < s AND t + len > s THEN s - t ELSE len END
  FROM walk w JOIN steps c ON c.video_id = w.video_id AND c.seq = w.step WHERE e <= s OR (NOT (t >= s AND t < e) AND CASE WHEN t < s AND t + len > s THEN s - t ELSE len END >= 80))
SELECT video_id, id, t AS time_ms, len AS duration_ms FROM walk JOIN n USING (video_id) WHERE step = n""")
def _(spark, sf):
    markers = b.intervals(spark, sf).select("video_id", "id", F.col("start_ms").alias("time_ms"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return edits.apply_edits({"markers": markers}, _histories(spark, sf))["markers"]


@check("edit_quality", b.with_sql("points") + ", cut AS (SELECT DISTINCT CAST(o_orderkey AS VARCHAR) AS video_id FROM orders) SELECT DISTINCT video_id, video_id IN (SELECT video_id FROM cut) AS edit_review FROM points")
def _(spark, sf):
    """Orders cut the users of the same number: their quality records are to be reviewed."""
    cuts = b.table(spark, sf, "orders").select(F.col("o_orderkey").cast("string").alias("video_id"), F.lit(0).cast("bigint").alias("seq"), F.lit(0).cast("bigint").alias("cut_start_ms"), F.lit(10).cast("bigint").alias("cut_end_ms"))
    return edits.ripple_delete({"quality": b.points(spark, sf).select("video_id").distinct()}, cuts)["quality"]


@check("ripple_markers", b.with_sql("intervals") + VIDEO_CUTS + f""", cut AS (SELECT video_id, id, start_ms AS t, s, e,
  CASE WHEN start_ms < s AND end_ms > s THEN s - start_ms ELSE end_ms - start_ms END AS len FROM intervals JOIN cuts USING (video_id))
SELECT video_id, id, {MOVED.format('t')} AS time_ms, len AS duration_ms FROM cut WHERE NOT (t >= s AND t < e) AND len >= 80""")
def _(spark, sf):
    markers = b.intervals(spark, sf).select("video_id", "id", F.col("start_ms").alias("time_ms"), (F.col("end_ms") - F.col("start_ms")).alias("duration_ms"))
    return edits.ripple_delete({"markers": markers}, _video_cuts(spark, sf))["markers"]


@check("ripple_samples", b.with_sql("points") + VIDEO_CUTS + f"""SELECT video_id, id, {MOVED.format('time_ms')} AS time_ms
FROM points JOIN cuts USING (video_id) WHERE time_ms < s OR time_ms >= e""")
def _(spark, sf):
    return edits.ripple_delete({"samples": b.points(spark, sf).select("video_id", "id", "time_ms")}, _video_cuts(spark, sf))["samples"]


@check("ripple_segments", b.with_sql("intervals") + VIDEO_CUTS + f""", moved AS (SELECT video_id, id, {MOVED.format('start_ms')} AS start_ms,
  {MOVED.format('end_ms')} AS end_ms FROM intervals JOIN cuts USING (video_id)) SELECT * FROM moved WHERE end_ms > start_ms""")
def _(spark, sf):
    return edits.ripple_delete({"segments": b.intervals(spark, sf).select("video_id", "id", "start_ms", "end_ms")}, _video_cuts(spark, sf))["segments"]


@check("ripple_hook", b.with_sql("points") + VIDEO_CUTS + f""", hooks AS (SELECT video_id, max(time_ms) - 800000000 AS h FROM points GROUP BY video_id)
SELECT video_id, {MOVED.format('h')} AS hook_end_ms FROM hooks JOIN cuts USING (video_id)""")
def _(spark, sf):
    hooks = b.points(spark, sf).groupBy("video_id").agg((F.max("time_ms") - 800_000_000).alias("hook_end_ms"))
    return edits.ripple_delete({"settings": hooks}, _video_cuts(spark, sf))["settings"]


@check("trim_clip", b.with_sql("clips", "laid") + """, target AS (SELECT video_id, out_start_ms AS o_s, src_start_ms AS c_s, src_end_ms AS c_e, out_end_ms AS o_e,
  greatest(src_start_ms, ((2 * (src_start_ms + 1510) * 25 + 1000) // 2000 * 2000 + 25) // 50) AS i,
  least(src_end_ms, ((2 * (src_end_ms - 2010) * 25 + 1000) // 2000 * 2000 + 25) // 50) AS o FROM laid WHERE ord = 1),
trimmed AS (SELECT * FROM target WHERE o - i >= 40)
SELECT l.video_id, l.ord, l.clip_id || CASE WHEN t.video_id IS NOT NULL AND l.ord = 1 THEN '-r' ELSE '' END AS clip_id,
  CASE WHEN t.video_id IS NOT NULL AND l.ord = 1 THEN i ELSE src_start_ms END AS src_start_ms,
  CASE WHEN t.video_id IS NOT NULL AND l.ord = 1 THEN o ELSE src_end_ms END AS src_end_ms FROM laid l LEFT JOIN trimmed t USING (video_id)""")
def _(spark, sf):
    rows = b.clips(spark, sf)
    bounds = rows.filter("ord = 1").select("video_id", "ord", (F.col("src_start_ms") + 1510).alias("new_start_ms"), (F.col("src_end_ms") - 2010).alias("new_end_ms"))
    media = bounds.select("video_id", F.lit(25).alias("fps_num"), F.lit(1).alias("fps_den"))
    return edits.trim_clip({"clips": rows}, bounds, media)["clips"].withColumn("ord", F.col("ord").cast("bigint"))


@check("changed_rows", """SELECT c_custkey, c_name, c_nationkey FROM customer EXCEPT ALL
SELECT c_custkey, CASE WHEN c_nationkey > 12 THEN 'x' ELSE c_name END, c_nationkey FROM customer""")
def _(spark, sf):
    after = b.table(spark, sf, "customer").select("c_custkey", "c_name", "c_nationkey")
    before = after.withColumn("c_name", F.when(F.col("c_nationkey") > 12, "x").otherwise(F.col("c_name")))
    return edits.changed_rows(before, after)


@check("edit_history", b.with_sql("points") + """SELECT video_id, id AS seq, kind AS state FROM (SELECT *, lag(kind) OVER (PARTITION BY video_id ORDER BY id) AS p FROM points)
WHERE kind IS DISTINCT FROM p""")
def _(spark, sf):
    return edits.edit_history(b.points(spark, sf).select("video_id", F.col("id").alias("seq"), F.col("kind").alias("state")))
