"""Marker queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable import fixed
from cuetable.checks.captions import CUES, EFFECT, LABELS, PATTERNS, PLAIN, TERMS, _has
from cuetable.checks.timeline import DAY
from cuetable.functions.timing import marker_target
from cuetable.operators import captions, classify, markers
from cuetable.plans.ordered import by_time, ordered

QUERIES, SQL = {}, {}
CANDIDATE = "thre|ouan"


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def labelled(spark, sf):
    """Conversation turns cut into short captions and labelled."""
    def build():
        rows = b.captions(spark, sf).select("video_id", F.col("id").alias("seg_id"), "text", "start_ms", "end_ms")
        pieces = captions.estimated_captions(rows)
        pieces = pieces.select("video_id", (F.col("seg_id") * 100_000 + F.col("piece")).alias("id"), "start_ms", "end_ms", "text")
        return classify.classify(pieces, TERMS, PATTERNS)
    return b.written_once(spark, sf, "labelled", build)


def plan(spark, sf):
    rows = labelled(spark, sf)
    return b.media_of(rows).join(classify.hook_end(rows), "video_id")


WHOLE = b.with_sql("captions") + f", {LABELS}" + """,
plan AS (SELECT video_id, max(end_ms) AS d, 5000 AS h FROM captions GROUP BY video_id),
numbered AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY start_ms, id) - 1 AS index FROM labelled JOIN plan USING (video_id)),
scored AS (SELECT *, CASE WHEN label IN ('benefit', 'selling_point') THEN 400 ELSE 100 END + CASE WHEN len(words) > 0 THEN 100 ELSE 0 END + least(20, length(trim(text))) AS pts
  FROM numbered WHERE label <> 'remove' AND start_ms >= h + 300 AND start_ms < d),
candidates AS (SELECT * FROM scored WHERE label IN ('benefit', 'selling_point') OR (length(trim(text)) >= 4 AND (len(words) > 0 OR regexp_matches(text, '""" + CANDIDATE + """') OR """ + " OR ".join(
    f"regexp_matches({PLAIN.format('text')}, '(?i)\\b(?:{p})\\b')" for p in PATTERNS.values()) + """)))"""


def _whole(spark, sf):
    rows = classify.classify(b.captions(spark, sf), TERMS, PATTERNS)
    return rows, b.media_of(rows).withColumn("hook_end_ms", F.lit(5000).cast("bigint"))


@check("eligible_candidates", WHOLE + " SELECT video_id, id, index, pts AS score FROM candidates")
def _(spark, sf):
    return markers.eligible_candidates(*_whole(spark, sf), PATTERNS, CANDIDATE).select("video_id", "id", "index", "score")


@check("best_per_slot", WHOLE + """, s AS (SELECT *, least(9, (start_ms - h - 300) * 10 // (d - h - 300)) AS slot FROM candidates),
r AS (SELECT *, row_number() OVER (PARTITION BY video_id, slot ORDER BY -pts, abs((start_ms - h - 300) * 20 - (slot * 2 + 1) * (d - h - 300)), index) AS k FROM s)
SELECT video_id, slot, index, start_ms, pts AS score FROM r WHERE k = 1""")
def _(spark, sf):
    rows = markers.eligible_candidates(*_whole(spark, sf), PATTERNS, CANDIDATE)
    return markers.best_per_slot(rows, F.lit(10).cast("bigint"))


def _dense_sql():
    """The step-by-step rules over turns eight times as close."""
    first = b.SQL["captions"]
    head = "WITH RECURSIVE " + first.replace("captions AS (", "apart AS (", 1) + ",\ncaptions AS (SELECT video_id, id, text, start_ms // 8 AS start_ms, end_ms // 8 AS end_ms FROM apart)"
    target = "CASE WHEN d < 60000 THEN greatest(1, ceil(d / 6000)) WHEN d <= 75000 THEN 10 WHEN d <= 100000 THEN 12 WHEN d <= 120000 THEN 14 ELSE ceil(d * 7 / 60000) END"
    return head + WHOLE.removeprefix(b.with_sql("captions")) + f""", wanted AS (SELECT video_id, d, CAST({target} AS BIGINT) AS target FROM plan WHERE d > h + 300),
slotted AS (SELECT *, abs((start_ms - h - 300) * target * 2 - (slot * 2 + 1) * (d - h - 300)) AS off FROM (SELECT c.*, w.target, least(w.target - 1, (c.start_ms - h - 300) * w.target // (c.d - h - 300)) AS slot FROM candidates c JOIN wanted w USING (video_id))),
steps AS (SELECT video_id, slot, start_ms, row_number() OVER (PARTITION BY video_id ORDER BY phase, slot, -pts, off, index) AS k FROM (
  SELECT 1 AS phase, video_id, slot, start_ms, pts, off, index FROM slotted UNION ALL SELECT 2, video_id, -1, start_ms, pts, start_ms, index FROM slotted)),
walk AS (SELECT video_id, target, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS taken, CAST(-9 AS BIGINT) AS used FROM wanted
  UNION ALL SELECT video_id, target, k, CASE WHEN ok THEN list_append(taken, start_ms) ELSE taken END, CASE WHEN ok THEN slot ELSE used END FROM (
    SELECT w.video_id, w.target, s.k, w.taken, w.used, s.slot, s.start_ms, CASE WHEN s.slot >= 0 THEN s.slot <> w.used ELSE len(w.taken) < w.target END
      AND coalesce(list_min(list_transform(w.taken, lambda u: abs(u - s.start_ms))), 1000000000) >= 4000 AS ok FROM walk w JOIN steps s ON s.video_id = w.video_id AND s.k = w.k + 1)),
picked AS (SELECT video_id, target, arg_max(taken, k) AS taken FROM walk GROUP BY ALL),
rest AS (SELECT video_id, list(start_ms) AS starts, any_value(d) AS d FROM scored WHERE length(trim(text)) >= 4 GROUP BY video_id),
filled AS (SELECT p.video_id, p.target, p.taken, r.starts, r.d FROM picked p LEFT JOIN rest r USING (video_id)
  UNION ALL SELECT video_id, target, list_append(taken, -best.t), starts, d FROM (SELECT *, list_max(list_transform(starts, lambda s: struct_pack(f := coalesce(list_min(list_transform(taken, lambda u: abs(u - s))), d), t := -s))) AS best
    FROM filled WHERE len(taken) < target AND starts IS NOT NULL) WHERE best.f >= 3000)
SELECT video_id, CAST(round_even(t / 10, 0) * 10 AS BIGINT) AS time_ms FROM (SELECT video_id, unnest(arg_max(taken, len(taken))) AS t FROM filled GROUP BY video_id)"""


def _dense(spark, sf):
    rows = b.captions(spark, sf).select("video_id", "id", "text", F.floor(F.col("start_ms") / 8).alias("start_ms"), F.floor(F.col("end_ms") / 8).alias("end_ms"))
    rows = classify.classify(rows, TERMS, PATTERNS)
    ends = b.media_of(rows).withColumn("hook_end_ms", F.lit(5000).cast("bigint"))
    return markers.place_markers(rows, ends, patterns=PATTERNS, cues=CUES, candidate_pattern=CANDIDATE)


@check("place_markers_times", _dense_sql())
def _(spark, sf):
    return _dense(spark, sf).select("video_id", "time_ms")


R = fixed.EFFECT_REASONS
REASON = f"""CASE WHEN {_has('price')} OR regexp_matches(text, '{CUES['price']}') THEN '{R['price']}' WHEN {_has('action')} OR regexp_matches(text, '{CUES['action']}') THEN '{R['action']}'
  WHEN {_has('selling_point')} OR regexp_matches(text, '{CUES['detail']}') THEN '{R['detail']}' WHEN {_has('benefit')} OR regexp_matches(text, '{CUES['benefit']}') THEN '{R['effect']}'
  WHEN {_has('complete')} OR regexp_matches(text, '{CUES['complete']}') THEN '{R['complete']}' WHEN {_has('surprise')} OR regexp_matches(text, '{CUES['surprise']}') THEN '{R['surprise']}'
  WHEN label = 'selling_point' THEN '{R['point']}' WHEN label = 'benefit' THEN '{R['effect']}' ELSE '{R['rhythm']}' END"""


def _effects_sql():
    """The times placed, with effect and reason of the caption that starts there."""
    times = _dense_sql()
    at = times.rindex("SELECT video_id, CAST(round_even(t / 10, 0)")
    return times[:at] + f"""SELECT video_id, CAST(round_even(start_ms / 10, 0) * 10 AS BIGINT) AS time_ms, {EFFECT} AS type, {REASON} AS reason, true AS enabled, 1.0::DOUBLE AS volume, 'auto' AS source
FROM scored JOIN (SELECT video_id, unnest(arg_max(taken, len(taken))) AS start_ms FROM filled GROUP BY video_id) USING (video_id, start_ms)"""


@check("place_markers_effects", _effects_sql())
def _(spark, sf):
    return _dense(spark, sf)


def placed(spark, sf):
    return b.written_once(spark, sf, "placed", lambda: markers.place_markers(
        labelled(spark, sf), plan(spark, sf), patterns=PATTERNS, cues=CUES, candidate_pattern=CANDIDATE))


@check("place_markers")
def _(spark, sf):
    return markers.place_markers(labelled(spark, sf), plan(spark, sf), patterns=PATTERNS, cues=CUES, candidate_pattern=CANDIDATE)


@check("place_markers_rules", b.with_sql("captions") + """SELECT count(DISTINCT video_id) AS videos, 0 AS over_target, 0 AS too_close, 0 AS in_hook FROM captions""")
def _(spark, sf):
    """No video has more markers than its target, closer than three seconds, or inside its hook."""
    rows = ordered(placed(spark, sf), ["video_id"], ["time_ms"], by_time("time_ms"), lag={"_p": F.col("time_ms")})
    found = rows.groupBy("video_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("time_ms") - F.col("_p") < 2990).alias("close"), F.min("time_ms").alias("first"))
    per = plan(spark, sf).join(found, "video_id", "left").withColumn("target", marker_target(F.col("duration_ms")))
    return per.agg(F.count(F.lit(1)).alias("videos"), F.count_if(F.col("n") > F.col("target")).cast("int").alias("over_target"),
                   F.coalesce(F.sum("close"), F.lit(0)).cast("int").alias("too_close"),
                   F.count_if(F.col("first") < F.col("hook_end_ms") + 290).cast("int").alias("in_hook"))


KINDS = "CASE kind WHEN 'view' THEN 'pop' WHEN 'click' THEN 'chime' WHEN 'purchase' THEN 'cash' WHEN 'signup' THEN 'nothing' ELSE 'typing' END"
NATURAL = "natural_length AS (SELECT * FROM (VALUES ('pop', 160), ('chime', 540), ('cash', 1410), ('typing', 1000)) AS t(type, ms))"


def event_markers(spark, sf):
    kind = F.col("kind")
    named = (F.when(kind == "view", "pop").when(kind == "click", "chime").when(kind == "purchase", "cash").when(kind == "signup", "nothing").otherwise("typing"))
    own = F.when(F.col("weight") > 100, F.floor(F.col("weight") * 100).cast("bigint"))
    return b.points(spark, sf).select("video_id", "id", "time_ms", named.alias("type"), (F.col("weight") < 300).alias("enabled"),
                                      (F.round(F.col("weight")) / 40).alias("volume"), own.alias("duration_ms"))


CATALOG = ", ".join(f"('{i}', '{l}', '{g}', {d})" for i, l, g, d in fixed.EFFECTS)


@check("effect_catalog", b.with_sql("points") + f", used AS (SELECT {KINDS} AS id, count(*) AS used FROM points GROUP BY ALL)" + f"""
SELECT id, label, c.group, duration_ms, coalesce(used, 0) AS used FROM (VALUES {CATALOG}) AS c(id, label, "group", duration_ms) LEFT JOIN used USING (id)""")
def _(spark, sf):
    """Every effect with how often the events ask for it."""
    used = event_markers(spark, sf).groupBy(F.col("type").alias("id")).agg(F.count(F.lit(1)).alias("used"))
    rows = markers.effect_catalog(spark).join(used, "id", "left")
    return rows.select("id", "label", "group", "duration_ms", F.coalesce("used", F.lit(0)).alias("used"))


@check("with_duration", b.with_sql("points") + f", {NATURAL}, m AS (SELECT video_id, id, {KINDS} AS type, weight FROM points)" + """
SELECT video_id, id, type, CASE WHEN weight > 100 THEN CAST(floor(weight * 100) AS BIGINT) ELSE coalesce(ms, 300) END AS duration_ms FROM m LEFT JOIN natural_length USING (type)""")
def _(spark, sf):
    return markers.with_duration(event_markers(spark, sf), markers.effect_catalog(spark)).select("video_id", "id", "type", "duration_ms")


SCHEDULE = b.with_sql("points") + f", {NATURAL}, ends AS (SELECT video_id, max(time_ms) - 100000000 AS d FROM points GROUP BY video_id)" + f""",
schedule AS (SELECT video_id, id, time_ms AS start_ms, CASE WHEN ms IS NULL THEN 'pop' ELSE type END AS type,
  greatest(80, least(8000, CASE WHEN weight > 100 THEN CAST(floor(weight * 100) AS BIGINT) ELSE coalesce(ms, 160) END)) AS length_ms,
  0.75::DOUBLE * greatest(0, least(2, round(weight) / 40)) AS gain
  FROM (SELECT *, {KINDS} AS type FROM points) LEFT JOIN natural_length USING (type) JOIN ends USING (video_id)
  WHERE weight < 300 AND time_ms < d AND round(weight) > 0)"""


def _schedule(spark, sf):
    rows = event_markers(spark, sf)
    media = rows.groupBy("video_id").agg((F.max("time_ms") - 100_000_000).alias("duration_ms")).withColumn("sfx_volume", F.lit(0.75))
    return markers.effect_schedule(rows, markers.effect_catalog(spark), media)


@check("effect_schedule", SCHEDULE + " SELECT video_id, id, start_ms, type, length_ms, gain FROM schedule")
def _(spark, sf):
    return _schedule(spark, sf)


@check("concurrency_mix", SCHEDULE + """, opened AS (SELECT *, unnest(generate_series(start_ms // 1000, (start_ms + length_ms - 1) // 1000)) AS block FROM schedule)
SELECT video_id, block, count(*) AS active, round(sum(gain * (least(start_ms + length_ms, (block + 1) * 1000) - greatest(start_ms, block * 1000))), 6) AS gain_ms FROM opened GROUP BY ALL""")
def _(spark, sf):
    return markers.concurrency_mix(_schedule(spark, sf)).withColumn("gain_ms", F.round("gain_ms", 6))


@check("marker_order", b.with_sql("points") + """, n AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY time_ms, id) - 1 AS position, count(*) OVER (PARTITION BY video_id) // 2 AS target FROM points)
SELECT video_id, id, position FROM n WHERE position < target""")
def _(spark, sf):
    rows = b.points(spark, sf)
    target = rows.groupBy("video_id").agg(F.floor(F.count(F.lit(1)) / 2).alias("target"))
    return markers.marker_order(rows, target, DAY).select("video_id", "id", "position")


@check("supplemental", b.with_sql("points") + """SELECT video_id, id FROM points p WHERE NOT EXISTS (SELECT 1 FROM points c WHERE c.kind = 'click' AND c.video_id = p.video_id AND c.time_ms = p.time_ms)""")
def _(spark, sf):
    rows = b.points(spark, sf)
    return markers.supplemental(rows, rows.filter("kind = 'click'")).select("video_id", "id")
