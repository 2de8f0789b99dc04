"""The review queue: items, what may happen to them, and their state after a log of events."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.operators.review_log import OUTCOME_DDL, review_outcomes

__all__ = ["OUTCOME_DDL", "review_outcomes"]


def _busy() -> Column:
    return F.col("processing").isin(*fixed.BUSY)


def _exporting() -> Column:
    return F.coalesce(F.col("export_status"), F.lit("idle")).isin(*fixed.EXPORTING)


def public_flags(items: DataFrame) -> DataFrame:
    """Items with ``reviewed`` and ``export_current``: the stored revision is the present, non-empty one."""
    held = F.coalesce(F.col("revision"), F.lit("")) != ""
    return items.select("*", (held & F.col("reviewed_revision").eqNullSafe(F.col("revision"))).alias("reviewed"),
                        (held & F.col("exported_revision").eqNullSafe(F.col("revision"))).alias("export_current"))


def review_label(items: DataFrame) -> DataFrame:
    """One label per item: troubles and running work first, then how far it has come."""
    rows = items if "reviewed" in items.columns else public_flags(items)
    p, e = F.col("processing"), F.col("export_status")
    label = (F.when(p == "error", "Analysis failed").when(p == "queued", "Queued for analysis").when(p == "processing", "Analyzing")
             .when(e == "error", "Export failed").when(e == "queued", "Queued for export").when(e == "exporting", "Exporting")
             .when(F.col("export_current"), "Exported").when(F.col("reviewed"), "Reviewed")
             .when(F.col("ready"), "Awaiting review").otherwise("Awaiting analysis"))
    return rows.withColumn("review_label", label)


def search_items(items: DataFrame, text: str = "", status: str = "all") -> DataFrame:
    """Items whose name or folder holds the text, in one of the status groups."""
    rows = items if "reviewed" in items.columns else public_flags(items)
    groups = {
        "all": F.lit(True), "pending": ~F.col("reviewed") & ~F.col("export_current"), "approved": F.col("reviewed"),
        "exported": F.col("export_current"), "error": (F.col("processing") == "error") | (F.col("export_status") == "error")}
    named = F.contains(F.lower(F.concat_ws(" ", "name", "folder")), F.lit(text.lower()))
    return rows.filter(named & groups[status])


def review_counts(items: DataFrame, by: list[str]) -> DataFrame:
    """Totals per scope, and what may be done to it as a whole."""
    rows = items if "reviewed" in items.columns else public_flags(items)
    idle = ~_busy() & ~_exporting()
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("total"), F.count_if("reviewed").alias("reviewed"), F.count_if("export_current").alias("exported"),
        F.bool_or(~F.col("ready") & idle).alias("can_analyze"), F.bool_and(F.col("reviewed") & idle).alias("can_export_all"),
        F.bool_and(idle).alias("can_remove_all"))


def next_to_review(items: DataFrame, active: DataFrame) -> DataFrame:
    """Per scope, the items beside the active one and the next that still needs review, wrapping around.

    ``items(scope, position, item_id, ready, …)``, ``active(scope, position)``. Aggregates only:
    no scope is sorted in one place.
    """
    rows = items if "reviewed" in items.columns else public_flags(items)
    rows = rows.join(active.select("scope", F.col("position").alias("_at")), "scope")
    at, here = F.col("position"), F.col("_at")
    open_ = F.col("ready") & ~F.col("reviewed") & ~_busy() & (at != here)
    key = F.struct((at < here).alias("wrapped"), at.alias("at"))
    return rows.groupBy("scope").agg(
        F.max_by(F.when(at < here, F.col("item_id")), F.when(at < here, at)).alias("previous_id"),
        F.min_by(F.when(at > here, F.col("item_id")), F.when(at > here, at)).alias("next_id"),
        F.min_by(F.when(open_, F.col("item_id")), F.when(open_, key)).alias("next_open_id"))


def upsert_items(items: DataFrame, new: DataFrame) -> DataFrame:
    """Items with those of ``new`` that are not among them yet, each once, in their first state."""
    unseen = new.join(items.select("item_id"), "item_id", "left_anti").dropDuplicates(["item_id"])
    start = {"processing": "pending", "revision": "", "reviewed_revision": "", "exported_revision": "", "export_status": "idle",
             "output": "", "error": "", "export_error": "", "ready": False}
    cols = []
    for field in items.schema.fields:
        if field.name in new.columns:
            value = F.col(field.name)
        else:
            value = F.lit(start.get(field.name))
        cols.append(value.cast(field.dataType).alias(field.name))
    return items.unionByName(unseen.select(*cols))


def batch_members(items: DataFrame, batch_id: str | None = None) -> DataFrame:
    """Items of a batch, or all when none is chosen."""
    return items.filter(F.array_contains(F.coalesce("batches", F.array().cast("array<string>")), batch_id)) if batch_id else items


def add_to_batch(items: DataFrame, ids: DataFrame, batch_id: str) -> DataFrame:
    """Items with the batch appended to those named."""
    named = ids.select("item_id").distinct().withColumn("_in", F.lit(True))
    grown = F.array_append(F.coalesce("batches", F.array().cast("array<string>")), F.lit(batch_id))
    rows = items.join(named, "item_id", "left")
    return rows.select(*[F.when(F.col("_in"), grown).otherwise(F.col("batches")).alias(c) if c == "batches" else F.col(c) for c in items.columns])


def batches_newest_first(batches: DataFrame) -> DataFrame:
    return batches.orderBy(F.desc("added_at"), F.desc("batch_id"))


def known_ids_check(ids: DataFrame, items: DataFrame) -> DataFrame:
    """Asked-for ids that no item has; any row here rejects the call."""
    return ids.join(items.select("item_id"), "item_id", "left_anti")


def orphaned_jobs(jobs: DataFrame, live: DataFrame) -> DataFrame:
    """Jobs with those stored as running but no longer alive turned into errors."""
    alive = live.select("id").distinct().withColumn("_live", F.lit(True))
    lost = (F.col("status") == "running") & F.col("_live").isNull()
    out = {"status": F.when(lost, "error").otherwise(F.col("status")), "message": F.when(lost, "interrupted").otherwise(F.col("message"))}
    return jobs.join(alive, "id", "left").select(*[out.get(c, F.col(c)).alias(c) for c in jobs.columns])


def interrupted_items(items: DataFrame) -> DataFrame:
    """Items after a restart: work that was under way has failed."""
    out = {
        "processing": F.when(_busy(), "error").otherwise(F.col("processing")), "error": F.when(_busy(), "interrupted").otherwise(F.col("error")),
        "export_status": F.when(_exporting(), "error").otherwise(F.col("export_status")),
        "export_error": F.when(_exporting(), "interrupted").otherwise(F.col("export_error"))}
    return items.select(*[out.get(c, F.col(c)).alias(c) for c in items.columns])


def approval_check(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Approvals ``(item_id, revision, reviewed)`` with outcome and the reviewed revision that results."""
    rows = requests.select("item_id", F.col("revision").alias("_asked"), "reviewed").join(
        items.select("item_id", "processing", "ready", "revision", "reviewed_revision"), "item_id")
    reason = (F.when(_busy() | ~F.coalesce(F.col("ready"), F.lit(False)), "not ready")
              .when((F.coalesce("_asked", F.lit("")) == "") | (F.col("_asked") != F.col("revision")), "revision changed"))
    kept = F.when(reason.isNotNull(), F.col("reviewed_revision")).when(F.coalesce("reviewed", F.lit(True)), F.col("revision")).otherwise("")
    return rows.select("item_id", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"), kept.alias("reviewed_revision"))


def save_check(requests: DataFrame, items: DataFrame) -> DataFrame:
    """Saves ``(item_id, expected_revision)`` with outcome; a null expectation matches anything."""
    rows = requests.join(items.select("item_id", "processing", "revision"), "item_id", "left")
    reason = (F.when(F.coalesce(_busy(), F.lit(False)), "processing")
              .when(F.col("expected_revision").isNotNull() & (F.col("expected_revision") != F.coalesce("revision", F.lit(""))), "changed elsewhere"))
    return rows.select("item_id", reason.isNull().alias("accepted"), F.coalesce(reason, F.lit("")).alias("reason"))


def claimable(ids: DataFrame, items: DataFrame, force: bool = False) -> DataFrame:
    """Asked-for items free to be analysed: not busy, not exporting, and not ready unless forced."""
    rows = items.join(ids.select("item_id"), "item_id", "left_semi").filter(~_busy() & ~_exporting())
    return rows if force else rows.filter(~F.coalesce(F.col("ready"), F.lit(False)))


def exportable(selections: DataFrame, items: DataFrame, requests: DataFrame | None = None) -> DataFrame:
    """Export requests ``(request_id, item_id)``, all or nothing.

    Accepted only when every item is reviewed at its present revision, and idle. A request
    of ``requests`` that selects nothing is refused.
    """
    rows = items if "reviewed" in items.columns else public_flags(items)
    state = rows.select("item_id", "reviewed", (_busy() | _exporting()).alias("_at_work"))
    asked = selections.select("request_id", "item_id").distinct().join(state, "item_id", "left")
    found = asked.groupBy("request_id").agg(
        F.count(F.lit(1)).alias("n_items"), F.count_if(~F.coalesce(F.col("reviewed"), F.lit(False))).alias("_open"),
        F.count_if(F.coalesce(F.col("_at_work"), F.lit(True))).alias("_busy"))
    if requests is not None:
        found = requests.select("request_id").join(found, "request_id", "left")
    reason = (F.when(F.coalesce("n_items", F.lit(0)) == 0, "nothing selected").when(F.col("_open") > 0, "not all reviewed")
              .when(F.col("_busy") > 0, "work under way"))
    return found.select("request_id", F.coalesce("n_items", F.lit(0)).alias("n_items"), reason.isNull().alias("accepted"),
                        F.coalesce(reason, F.lit("")).alias("reason"))


# ---- jobs

def batch_summary(jobs: DataFrame) -> DataFrame:
    """Children of each batch job counted; its items are the child rows themselves (``batch_items``)."""
    done = F.count_if(F.col("status") == "done")
    return jobs.filter(F.col("parent_id").isNotNull()).groupBy("parent_id").agg(
        F.count(F.lit(1)).alias("total"), done.alias("completed"), F.count_if(F.col("quality_status") == "needs_review").alias("needs_review"),
        (F.count(F.lit(1)) - done).alias("failed"))


def batch_items(jobs: DataFrame) -> DataFrame:
    """One row per child of a batch, with the statuses a missing value stands for."""
    return jobs.filter(F.col("parent_id").isNotNull()).select(
        "parent_id", F.col("id").alias("job_id"), "video", F.coalesce("status", F.lit("error")).alias("status"),
        F.coalesce("quality_status", F.lit("error")).alias("quality_status"), F.coalesce("message", F.lit("")).alias("message"))


def export_summary(jobs: DataFrame) -> DataFrame:
    done = F.count_if(F.col("status") == "done")
    return jobs.groupBy("parent_id").agg(done.alias("completed"), (F.count(F.lit(1)) - done).alias("failed"))


def active_jobs(jobs: DataFrame) -> DataFrame:
    return jobs.agg(F.count_if(F.col("status") == "running").alias("active_jobs"))


# ---- the event log

STATE = ("exists", "processing", "ready", "revision", "reviewed_revision", "exported_revision", "export_status", "error", "export_error", "output")
STATE_DDL = ("`exists` boolean, processing string, ready boolean, revision string, reviewed_revision string, exported_revision string, "
             "export_status string, error string, export_error string, output string")
NEW_ITEM = {"exists": True, "processing": "pending", "ready": False, "revision": "", "reviewed_revision": "", "exported_revision": "",
            "export_status": "idle", "error": "", "export_error": "", "output": ""}


def step(state: dict | None, event: dict) -> tuple[dict | None, str]:
    """State after one event, and why it was refused if it was.

    Events: ``add``; ``claim`` (analysis; status ``force`` repeats it); ``processing`` with its status;
    ``analysis`` and ``save`` with a new revision (``expected`` guards a save); ``approve`` and
    ``unapprove`` of a revision; ``export``; ``export_status``; ``remove``.
    """
    action = event["action"]
    if action in ("add", "save", "analysis", "processing") and state is None:
        state = dict(NEW_ITEM)
    if state is None:
        return None, "unknown item"
    busy, exporting = state["processing"] in fixed.BUSY, state["export_status"] in fixed.EXPORTING
    change: dict = {}
    conflict = ""
    if action == "claim":
        if busy or exporting or (state["ready"] and event["status"] != "force"):
            conflict = "not claimable"
        else:
            change = {"processing": "queued", "error": ""}
    elif action == "processing":
        change = {"processing": event["status"], "error": event["error"] or ""}
    elif action == "analysis":
        change = {"processing": "ready", "error": "", "revision": event["revision"], "ready": True}
    elif action == "save":
        if busy:
            conflict = "processing"
        elif event["expected"] is not None and event["expected"] != state["revision"]:
            conflict = "changed elsewhere"
        else:
            change = {"revision": event["revision"], "ready": True, "processing": "ready"}
    elif action in ("approve", "unapprove"):
        if busy or not state["ready"]:
            conflict = "not ready"
        elif not event["revision"] or event["revision"] != state["revision"]:
            conflict = "revision changed"
        else:
            change = {"reviewed_revision": state["revision"] if action == "approve" else ""}
    elif action == "export":
        if not state["revision"] or state["reviewed_revision"] != state["revision"]:
            conflict = "not reviewed"
        elif busy or exporting:
            conflict = "work under way"
        else:
            change = {"export_status": "queued", "export_error": ""}
    elif action == "export_status":
        change = {"export_status": event["status"], "export_error": event["error"] or ""}
        if event["status"] == "done":
            change |= {"exported_revision": event["revision"] or "", "output": event["output"] or ""}
    elif action == "remove":
        if busy or exporting:
            conflict = "work under way"
        else:
            return None, ""
    return {**state, **change}, conflict


def fold(item_id: str, state: dict | None, events: pd.DataFrame) -> tuple[dict | None, pd.DataFrame]:
    """Runs sorted events of one item; returns the last state and one outcome row per event."""
    rows = []
    for event in events.astype(object).where(events.notna(), None).to_dict("records"):
        state, conflict = step(state, event)
        shown = state or {**NEW_ITEM, "exists": False}
        rows.append((item_id, event["ts"], event["seq"], event["action"], conflict == "", conflict, *[shown[c] for c in STATE]))
    return state, pd.DataFrame(rows, columns=["item_id", "ts", "seq", "action", "accepted", "conflict", *STATE])


def review_state(outcomes: DataFrame, removed: bool = False) -> DataFrame:
    """Present state per item: the one after its latest event."""
    latest = outcomes.groupBy("item_id").agg(F.max_by(F.struct(*STATE), F.struct("ts", "seq")).alias("_s")).select("item_id", "_s.*")
    return latest if removed else latest.filter("`exists`").drop("exists")
