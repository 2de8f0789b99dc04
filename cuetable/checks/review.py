"""Review queue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuetable import bindings as b
from cuetable.operators import review

QUERIES, SQL = {}, {}


def check(name, sql=None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


# Orders as queue items, read off their priority, status, customer and price.
ITEMS = """WITH items AS (SELECT CAST(o_orderkey AS VARCHAR) AS item_id, 'Clip ' || o_custkey || '.MP4' AS name, 'D:/' || o_orderpriority AS folder,
  ['error', 'ready', 'queued', 'ready', 'pending'][CAST(o_orderpriority[1] AS BIGINT)] AS processing, o_orderpriority[1] IN ('2', '4') AS ready,
  CASE WHEN o_custkey < 20 THEN '' ELSE 'r' || o_custkey END AS revision, CASE o_orderstatus WHEN 'F' THEN 'r' || o_custkey WHEN 'O' THEN '' ELSE 'old' END AS reviewed_revision,
  CASE WHEN o_totalprice > 400000 THEN 'r' || o_custkey ELSE '' END AS exported_revision,
  CASE WHEN o_totalprice < 50000 THEN 'exporting' WHEN o_totalprice < 90000 THEN 'error' WHEN o_totalprice < 120000 THEN 'queued' ELSE 'idle' END AS export_status,
  CAST(o_custkey AS VARCHAR) AS scope, o_orderkey AS position FROM orders),
flags AS (SELECT *, revision <> '' AND reviewed_revision = revision AS reviewed, revision <> '' AND exported_revision = revision AS export_current,
  processing IN ('queued', 'processing') AS busy, export_status IN ('queued', 'exporting') AS exporting FROM items)"""


def items(spark, sf):
    o = b.table(spark, sf, "orders")
    revision, price, number = F.concat(F.lit("r"), F.col("o_custkey")), F.col("o_totalprice"), F.substring("o_orderpriority", 1, 1)
    return o.select(
        F.col("o_orderkey").cast("string").alias("item_id"), F.concat(F.lit("Clip "), "o_custkey", F.lit(".MP4")).alias("name"),
        F.concat(F.lit("D:/"), "o_orderpriority").alias("folder"),
        F.element_at(F.array(*map(F.lit, ("error", "ready", "queued", "ready", "pending"))), number.cast("int")).alias("processing"),
        number.isin("2", "4").alias("ready"), F.when(F.col("o_custkey") < 20, "").otherwise(revision).alias("revision"),
        F.when(F.col("o_orderstatus") == "F", revision).when(F.col("o_orderstatus") == "O", "").otherwise("old").alias("reviewed_revision"),
        F.when(price > 400000, revision).otherwise("").alias("exported_revision"),
        F.when(price < 50000, "exporting").when(price < 90000, "error").when(price < 120000, "queued").otherwise("idle").alias("export_status"),
        F.lit("").alias("error"), F.lit("").alias("export_error"), F.lit("").alias("output"),
        F.array(F.col("o_orderpriority")).alias("batches"), F.col("o_custkey").cast("string").alias("scope"), F.col("o_orderkey").alias("position"))


@check("public_flags", ITEMS + " SELECT item_id, reviewed, export_current FROM flags")
def _(spark, sf):
    return review.public_flags(items(spark, sf)).select("item_id", "reviewed", "export_current")


@check("review_label", ITEMS + """ SELECT item_id, CASE WHEN processing = 'error' THEN 'Analysis failed' WHEN processing = 'queued' THEN 'Queued for analysis' WHEN processing = 'processing' THEN 'Analyzing'
  WHEN export_status = 'error' THEN 'Export failed' WHEN export_status = 'queued' THEN 'Queued for export' WHEN export_status = 'exporting' THEN 'Exporting'
  WHEN export_current THEN 'Exported' WHEN reviewed THEN 'Reviewed' WHEN ready THEN 'Awaiting review' ELSE 'Awaiting analysis' END AS review_label FROM flags""")
def _(spark, sf):
    return review.review_label(items(spark, sf)).select("item_id", "review_label")


@check("search_items", ITEMS + """ SELECT 'pending' AS filter, item_id FROM flags WHERE NOT reviewed AND NOT export_current AND contains(lower(name || ' ' || folder), 'p 1')
UNION ALL SELECT 'error', item_id FROM flags WHERE (processing = 'error' OR export_status = 'error') AND contains(lower(name || ' ' || folder), '4-not')
UNION ALL SELECT 'approved', item_id FROM flags WHERE reviewed UNION ALL SELECT 'exported', item_id FROM flags WHERE export_current""")
def _(spark, sf):
    rows = review.public_flags(items(spark, sf))
    asked = (("P 1", "pending"), ("4-not", "error"), ("", "approved"), ("", "exported"))
    found = [review.search_items(rows, t, s).select(F.lit(s).alias("filter"), "item_id") for t, s in asked]
    return found[0].unionByName(found[1]).unionByName(found[2]).unionByName(found[3])


@check("review_counts", ITEMS + """ SELECT scope, count(*) AS total, count(*) FILTER (reviewed) AS reviewed, count(*) FILTER (export_current) AS exported,
  bool_or(NOT ready AND NOT busy AND NOT exporting) AS can_analyze, bool_and(reviewed AND NOT busy AND NOT exporting) AS can_export_all, bool_and(NOT busy AND NOT exporting) AS can_remove_all FROM flags GROUP BY scope""")
def _(spark, sf):
    return review.review_counts(items(spark, sf), ["scope"])


@check("next_to_review", ITEMS + """, active AS (SELECT scope, median(position) AS m FROM items GROUP BY scope),
a AS (SELECT scope, max(position) AS here FROM items JOIN active USING (scope) WHERE position <= m GROUP BY scope)
SELECT scope, arg_max(item_id, position) FILTER (position < here) AS previous_id, arg_min(item_id, position) FILTER (position > here) AS next_id,
  arg_min(item_id, (CASE WHEN position < here THEN 1 ELSE 0 END, position)) FILTER (ready AND NOT reviewed AND NOT busy AND position <> here) AS next_open_id FROM flags JOIN a USING (scope) GROUP BY scope""")
def _(spark, sf):
    rows = items(spark, sf)
    middle = rows.groupBy("scope").agg(F.median("position").alias("m"))
    active = rows.join(middle, "scope").filter("position <= m").groupBy("scope").agg(F.max("position").alias("position"))
    return review.next_to_review(rows, active)


@check("upsert_items", ITEMS + """ SELECT item_id, processing, export_status FROM items UNION ALL SELECT DISTINCT CAST(l_orderkey + 7000 AS VARCHAR), 'pending', 'idle' FROM lineitem
WHERE l_orderkey + 7000 NOT IN (SELECT o_orderkey FROM orders)""")
def _(spark, sf):
    new = b.table(spark, sf, "lineitem").select((F.col("l_orderkey") + 7000).cast("string").alias("item_id"))
    return review.upsert_items(items(spark, sf), new).select("item_id", "processing", "export_status")


@check("batch_members", ITEMS + " SELECT item_id FROM items WHERE folder = 'D:/1-URGENT'")
def _(spark, sf):
    return review.batch_members(items(spark, sf), "1-URGENT").select("item_id")


@check("add_to_batch", ITEMS + " SELECT item_id, folder[4:] || CASE WHEN item_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 45) THEN '|b9' ELSE '' END AS batches FROM items")
def _(spark, sf):
    ids = b.table(spark, sf, "lineitem").filter("l_quantity > 45").select(F.col("l_orderkey").cast("string").alias("item_id"))
    return review.add_to_batch(items(spark, sf), ids, "b9").select("item_id", F.array_join("batches", "|").alias("batches"))


@check("batches_newest_first", "SELECT user_id AS batch_id, max(event_id) AS added_at FROM events GROUP BY user_id ORDER BY 2 DESC")
def _(spark, sf):
    made = b.table(spark, sf, "events").groupBy(F.col("user_id").alias("batch_id")).agg(F.max("event_id").alias("added_at"))
    return review.batches_newest_first(made)


@check("known_ids_check", "SELECT DISTINCT CAST(l_orderkey + 100 AS VARCHAR) AS item_id FROM lineitem WHERE l_orderkey + 100 NOT IN (SELECT o_orderkey FROM orders)")
def _(spark, sf):
    asked = b.table(spark, sf, "lineitem").select((F.col("l_orderkey") + 100).cast("string").alias("item_id")).distinct()
    return review.known_ids_check(asked, items(spark, sf))


@check("interrupted_items", ITEMS + """ SELECT item_id, CASE WHEN busy THEN 'error' ELSE processing END AS processing, CASE WHEN busy THEN 'interrupted' ELSE '' END AS error,
  CASE WHEN exporting THEN 'error' ELSE export_status END AS export_status, CASE WHEN exporting THEN 'interrupted' ELSE '' END AS export_error FROM flags""")
def _(spark, sf):
    return review.interrupted_items(items(spark, sf)).select("item_id", "processing", "error", "export_status", "export_error")


@check("approval_check", ITEMS + """, asked AS (SELECT CAST(l_orderkey AS VARCHAR) AS item_id, 'r' || max(l_partkey) % 1500 AS rev, min(l_quantity) < 25 AS r FROM lineitem GROUP BY l_orderkey),
fixed AS (SELECT item_id, CASE WHEN r THEN revision ELSE rev END AS rev, r FROM asked JOIN items USING (item_id)),
j AS (SELECT f.*, a.rev, a.r, CASE WHEN busy OR NOT ready THEN 'not ready' WHEN rev = '' OR rev <> revision THEN 'revision changed' ELSE '' END AS reason FROM flags f JOIN fixed a USING (item_id))
SELECT item_id, reason = '' AS accepted, reason, CASE WHEN reason <> '' THEN reviewed_revision WHEN r THEN revision ELSE '' END AS reviewed_revision FROM j""")
def _(spark, sf):
    rows = items(spark, sf)
    asked = b.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("item_id")).agg(
        F.concat(F.lit("r"), F.max("l_partkey") % 1500).alias("rev"), (F.min("l_quantity") < 25).alias("reviewed"))
    asked = asked.join(rows.select("item_id", F.col("revision").alias("now")), "item_id").select(
        "item_id", F.when(F.col("reviewed"), F.col("now")).otherwise(F.col("rev")).alias("revision"), "reviewed")
    return review.approval_check(asked, rows)


@check("save_check", ITEMS + """, asked AS (SELECT DISTINCT CAST(l_orderkey + 50 AS VARCHAR) AS item_id, CASE WHEN l_orderkey < 4000 THEN NULL ELSE 'r' || l_orderkey END AS expected FROM lineitem),
j AS (SELECT item_id, CASE WHEN busy THEN 'processing' WHEN expected IS NOT NULL AND expected <> coalesce(revision, '') THEN 'changed elsewhere' ELSE '' END AS reason FROM asked LEFT JOIN flags USING (item_id))
SELECT item_id, reason = '' AS accepted, reason FROM j""")
def _(spark, sf):
    key = F.col("l_orderkey")
    asked = b.table(spark, sf, "lineitem").select((key + 50).cast("string").alias("item_id"), F.when(key >= 4000, F.concat(F.lit("r"), key)).alias("expected_revision")).distinct()
    return review.save_check(asked, items(spark, sf))


@check("claimable", ITEMS + """ SELECT 'plain' AS mode, item_id FROM flags WHERE NOT busy AND NOT exporting AND NOT ready AND item_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 30)
UNION ALL SELECT 'force', item_id FROM flags WHERE NOT busy AND NOT exporting AND item_id IN (SELECT CAST(l_orderkey AS VARCHAR) FROM lineitem WHERE l_quantity > 30)""")
def _(spark, sf):
    ids = b.table(spark, sf, "lineitem").filter("l_quantity > 30").select(F.col("l_orderkey").cast("string").alias("item_id"))
    rows = items(spark, sf)
    return review.claimable(ids, rows).select(F.lit("plain").alias("mode"), "item_id").unionByName(
        review.claimable(ids, rows, force=True).select(F.lit("force").alias("mode"), "item_id"))


@check("exportable", ITEMS + """, asked AS (SELECT DISTINCT l_suppkey * 100000 + l_partkey AS request_id, CAST(l_orderkey AS VARCHAR) AS item_id FROM lineitem WHERE l_returnflag = 'R'),
requests AS (SELECT DISTINCT l_suppkey * 100000 + l_partkey AS request_id FROM lineitem),
s AS (SELECT request_id, count(*) AS n, count(*) FILTER (NOT coalesce(reviewed, false)) AS o, count(*) FILTER (coalesce(busy OR exporting, true)) AS w FROM asked LEFT JOIN flags USING (item_id) GROUP BY request_id)
SELECT request_id, coalesce(n, 0) AS n_items, coalesce(n, 0) > 0 AND o = 0 AND w = 0 AS accepted,
  CASE WHEN coalesce(n, 0) = 0 THEN 'nothing selected' WHEN o > 0 THEN 'not all reviewed' WHEN w > 0 THEN 'work under way' ELSE '' END AS reason FROM requests LEFT JOIN s USING (request_id)""")
def _(spark, sf):
    rows = b.table(spark, sf, "lineitem").select((F.col("l_suppkey") * 100000 + F.col("l_partkey")).alias("request_id"), F.col("l_orderkey").cast("string").alias("item_id"), "l_returnflag")
    return review.exportable(rows.filter("l_returnflag = 'R'"), items(spark, sf), rows.select("request_id").distinct())


# ---- jobs: events under their user

JOBS = """WITH jobs AS (SELECT CAST(event_id AS VARCHAR) AS id, CAST(user_id AS VARCHAR) AS parent_id, CASE event_type WHEN 'purchase' THEN 'running' WHEN 'error' THEN 'error' ELSE 'done' END AS status,
  CASE WHEN value > 60 THEN 'needs_review' WHEN value > 20 THEN 'ok' END AS quality_status, props AS message FROM events)"""


def jobs(spark, sf):
    kind = F.col("event_type")
    return b.table(spark, sf, "events").select(
        F.col("event_id").cast("string").alias("id"), F.col("user_id").cast("string").alias("parent_id"), F.lit("v").alias("video"),
        F.when(kind == "purchase", "running").when(kind == "error", "error").otherwise("done").alias("status"),
        F.when(F.col("value") > 60, "needs_review").when(F.col("value") > 20, "ok").alias("quality_status"), F.col("props").alias("message"))


@check("batch_summary", JOBS + """ SELECT parent_id, count(*) AS total, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (quality_status = 'needs_review') AS needs_review,
  count(*) - count(*) FILTER (status = 'done') AS failed FROM jobs GROUP BY parent_id""")
def _(spark, sf):
    return review.batch_summary(jobs(spark, sf))


@check("batch_items", JOBS + " SELECT parent_id, id AS job_id, 'v' AS video, status, coalesce(quality_status, 'error') AS quality_status, message FROM jobs")
def _(spark, sf):
    return review.batch_items(jobs(spark, sf))


@check("export_summary", JOBS + " SELECT parent_id, count(*) FILTER (status = 'done') AS completed, count(*) FILTER (status <> 'done') AS failed FROM jobs GROUP BY parent_id")
def _(spark, sf):
    return review.export_summary(jobs(spark, sf))


@check("active_jobs", JOBS + " SELECT count(*) FILTER (status = 'running') AS active_jobs FROM jobs")
def _(spark, sf):
    return review.active_jobs(jobs(spark, sf))


@check("orphaned_jobs", JOBS + """ SELECT id, CASE WHEN lost THEN 'error' ELSE status END AS status, CASE WHEN lost THEN 'interrupted' ELSE message END AS message FROM (
  SELECT *, status = 'running' AND parent_id NOT IN (SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_nationkey < 12) AS lost FROM jobs)""")
def _(spark, sf):
    rows = jobs(spark, sf)
    alive = b.table(spark, sf, "customer").filter("c_nationkey < 12").select(F.col("c_custkey").cast("string").alias("parent_id"))
    return review.orphaned_jobs(rows, rows.join(alive, "parent_id", "left_semi")).select("id", "status", "message")


# ---- the event log: every user's events drive one item

LOG = """WITH RECURSIVE log AS (SELECT CAST(user_id AS VARCHAR) AS item_id, event_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
  'r' || CAST(floor(value / 15) AS BIGINT) AS revision, CASE WHEN value < 30 THEN NULL ELSE 'r' || CAST(floor(value / 20) AS BIGINT) END AS expected,
  CASE event_type WHEN 'view' THEN CASE WHEN value > 60 THEN 'claim' ELSE 'analysis' END WHEN 'click' THEN CASE WHEN value > 90 THEN 'remove' ELSE 'save' END
    WHEN 'purchase' THEN CASE WHEN value > 110 THEN 'unapprove' ELSE 'approve' END WHEN 'signup' THEN 'export' ELSE CASE WHEN value > 40 THEN 'export_status' ELSE 'processing' END END AS action,
  CASE WHEN value > 100 THEN 'force' WHEN value > 40 THEN 'done' WHEN value > 15 THEN 'ready' ELSE 'processing' END AS status FROM events),
fold AS (SELECT item_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS seq, '' AS action, '' AS conflict, false AS alive, 'pending' AS p, false AS ready, '' AS rev, '' AS reviewed, '' AS exported, 'idle' AS e FROM (SELECT DISTINCT item_id FROM log)
  UNION ALL
  SELECT item_id, n, seq, action, conflict, CASE WHEN NOT alive0 THEN false WHEN ok AND action = 'remove' THEN false ELSE true END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN 'pending' WHEN NOT ok THEN p WHEN action = 'claim' THEN 'queued' WHEN action = 'processing' THEN status WHEN action IN ('analysis', 'save') THEN 'ready' ELSE p END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN false WHEN ok AND action IN ('analysis', 'save') THEN true ELSE ready END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN '' WHEN ok AND action IN ('analysis', 'save') THEN revision ELSE rev END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN '' WHEN ok AND action = 'approve' THEN rev WHEN ok AND action = 'unapprove' THEN '' ELSE reviewed END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN '' WHEN action = 'export_status' AND status = 'done' THEN revision ELSE exported END,
    CASE WHEN NOT alive0 OR (ok AND action = 'remove') THEN 'idle' WHEN NOT ok THEN e WHEN action = 'export' THEN 'queued' WHEN action = 'export_status' THEN status ELSE e END
  FROM (SELECT *, conflict = '' AS ok FROM (
    SELECT f.item_id, l.n, l.seq, l.action, l.revision, l.status, f.p, f.ready, f.rev, f.reviewed, f.exported, f.e, f.alive OR l.action IN ('save', 'analysis', 'processing') AS alive0,
      CASE WHEN NOT (f.alive OR l.action IN ('save', 'analysis', 'processing')) THEN 'unknown item'
        WHEN l.action = 'claim' AND (f.p IN ('queued', 'processing') OR f.e IN ('queued', 'exporting') OR (f.ready AND l.status <> 'force')) THEN 'not claimable'
        WHEN l.action = 'save' AND f.p IN ('queued', 'processing') THEN 'processing' WHEN l.action = 'save' AND l.expected IS NOT NULL AND l.expected <> f.rev THEN 'changed elsewhere'
        WHEN l.action IN ('approve', 'unapprove') AND (f.p IN ('queued', 'processing') OR NOT f.ready) THEN 'not ready' WHEN l.action IN ('approve', 'unapprove') AND l.revision <> f.rev THEN 'revision changed'
        WHEN l.action = 'export' AND (f.rev = '' OR f.reviewed <> f.rev) THEN 'not reviewed' WHEN l.action = 'export' AND (f.p IN ('queued', 'processing') OR f.e IN ('queued', 'exporting')) THEN 'work under way'
        WHEN l.action = 'remove' AND (f.p IN ('queued', 'processing') OR f.e IN ('queued', 'exporting')) THEN 'work under way' ELSE '' END AS conflict
    FROM fold f JOIN log l ON l.item_id = f.item_id AND l.n = f.n + 1)))"""


def event_log(spark, sf, ts="ts"):
    v, kind = F.col("value"), F.col("event_type")
    action = (F.when(kind == "view", F.when(v > 60, "claim").otherwise("analysis")).when(kind == "click", F.when(v > 90, "remove").otherwise("save"))
              .when(kind == "purchase", F.when(v > 110, "unapprove").otherwise("approve")).when(kind == "signup", "export")
              .otherwise(F.when(v > 40, "export_status").otherwise("processing")))
    return b.table(spark, sf, "events").select(*log_columns(v, action))


def log_columns(v, action):
    return [F.col("user_id").cast("string").alias("item_id"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"), action.alias("action"),
            F.concat(F.lit("r"), F.floor(v / 15)).alias("revision"), F.when(v >= 30, F.concat(F.lit("r"), F.floor(v / 20))).alias("expected"),
            F.when(v > 100, "force").when(v > 40, "done").when(v > 15, "ready").otherwise("processing").alias("status"), F.lit("").alias("error"), F.lit("").alias("output")]


@check("review_outcomes", LOG + " SELECT item_id, seq, action, conflict, p AS processing, e AS export_status, rev AS revision FROM fold WHERE n > 0")
def _(spark, sf):
    return review.review_outcomes(event_log(spark, sf)).select("item_id", "seq", "action", "conflict", "processing", "export_status", "revision")


@check("review_state", LOG + """ SELECT item_id, p AS processing, ready, rev AS revision, reviewed AS reviewed_revision, exported AS exported_revision, e AS export_status
FROM fold f WHERE n = (SELECT max(n) FROM fold g WHERE g.item_id = f.item_id) AND alive""")
def _(spark, sf):
    return review.review_state(review.review_outcomes(event_log(spark, sf))).select(
        "item_id", "processing", "ready", "revision", "reviewed_revision", "exported_revision", "export_status")
