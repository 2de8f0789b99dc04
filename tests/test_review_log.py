"""The log in pieces against one event after the other."""

import datetime as dt
import random

import pandas as pd
import pytest

from cuetable.operators import review, review_log

DDL = "item_id string, ts timestamp, seq bigint, action string, revision string, expected string, status string, error string, output string"
START = dt.datetime(2024, 1, 1)


def random_log(rng, items, events, revisions=4, weights=None):
    names = [f"r{i}" for i in range(revisions)] + ["", None, "-"]
    rows = []
    for seq in range(events):
        action = rng.choices([*review_log.ACTIONS, "other"], weights)[0]
        status = rng.choice(["force", None, "queued"] if action == "claim" else ["queued", "exporting", "done", "error", "idle", None] if action == "export_status" else ["queued", "processing", "ready", "error", None])
        rows.append((rng.choice(items), START + dt.timedelta(seconds=seq // 3), seq, action, rng.choice(names), rng.choice([None, *names]), status, rng.choice([None, "bad"]), rng.choice([None, "out.mp4"])))
    return rows


def folded(rows):
    out = []
    columns = [c.split()[0] for c in DDL.split(", ")]
    frame = pd.DataFrame(rows, columns=columns).astype(object)
    for item, own in frame.groupby("item_id"):
        own = own.sort_values(["ts", "seq"])
        state = None
        for event in own.where(own.notna(), None).to_dict("records"):
            state, conflict = review.step(state, event)
            shown = state or {**review.NEW_ITEM, "exists": False}
            out.append((item, event["seq"], event["action"], conflict == "", conflict, *[shown[c] for c in review.STATE]))
    return sorted(out, key=str)


WEIGHTS = {"even": None, "saves": [1, 1, 1, 0, 9, 6, 1, 6, 2, 1, 0], "busy": [1, 6, 6, 1, 3, 3, 1, 3, 3, 3, 1], "removed": [2, 1, 1, 1, 3, 2, 1, 2, 1, 9, 0]}


@pytest.mark.parametrize("kind", WEIGHTS)
@pytest.mark.parametrize("piece", [3, 16])
def test_pieces_equal_one_fold(spark, monkeypatch, kind, piece):
    monkeypatch.setattr(review_log, "PIECE", piece)
    rows = random_log(random.Random(f"{kind}{piece}"), ["a", "a", "a", "b", "c"], 700, weights=WEIGHTS[kind])
    got = review.review_outcomes(spark.createDataFrame(rows, DDL).repartition(3)).select("item_id", "seq", "action", "accepted", "conflict", *[f"`{c}`" for c in review.STATE])
    assert sorted([tuple(r) for r in got.collect()], key=str) == folded(rows)


def test_all_ways_without_spark(monkeypatch):
    """Summaries applied to any state give what folding from it gives."""
    rng = random.Random(9)
    for _ in range(150):
        n = rng.randint(1, 12)
        rows = [r for r in random_log(rng, ["a"], n, revisions=3)]
        frame = pd.DataFrame(rows, columns=[c.split()[0] for c in DDL.split(", ")]).astype(object)
        state = {"exists": True, "processing": rng.choice(["pending", "queued", "ready"]), "ready": rng.random() < 0.6, "revision": rng.choice(["r0", "r1", "r9", "", None]), "reviewed_revision": "", "exported_revision": "r7",
                 "export_status": rng.choice(["idle", "queued", "done"]), "error": "e", "export_error": "x", "output": "o"}
        if state["ready"]:
            state["reviewed_revision"] = rng.choice([state["revision"] or "", "r0", "r1", "r8", ""])
        own = review_log.State()
        own.exists, own.ready = True, state["ready"]
        own.busy, own.exporting = state["processing"] == "queued", state["export_status"] == "queued"
        own.values = [state[f] for f in review_log.FIELDS]
        busy, done = ("queued", "processing"), frame["status"] == "done"
        text = lambda c: frame[c].where(frame[c].notna(), "")
        piece = pd.DataFrame({"item_id": "a", "_piece": 1, "_n": range(n), "expected": frame["expected"], "_act": [review_log.ACTIONS.index(a) if a in review_log.ACTIONS else -1 for a in frame["action"]],
                              "_busy": frame["status"].isin(busy), "_exporting": frame["status"].isin(("queued", "exporting")), "_forced": frame["status"] == "force", "_done": done,
                              "_processing": ["queued" if a == "claim" else s if a == "processing" else "ready" for a, s in zip(frame["action"], frame["status"], strict=True)],
                              "_error": [e or "" if a == "processing" else "" for a, e in zip(frame["action"], frame["error"], strict=True)], "_revision": frame["revision"],
                              "_reviewed_revision": [r if a == "approve" else "" for a, r in zip(frame["action"], frame["revision"], strict=True)],
                              "_export_status": ["queued" if a == "export" else s for a, s in zip(frame["action"], frame["status"], strict=True)],
                              "_export_error": [e or "" if a == "export_status" else "" for a, e in zip(frame["action"], frame["error"], strict=True)], "_exported_revision": text("revision"), "_output": text("output")})
        rest = list(review_log.walk(iter([review_log.summed_up(piece)])))
        assert rest[0].shape[0] + rest[1].shape[0] == 1
        ways = {}
        for r in review_log.summed_up(piece).astype(object).itertuples(index=False):
            held, reviewed = (None if pd.isna(x) else x for x in (r.held, r.reviewed))
            if not r.any_held and r.entry:
                ways["held", held] = ()
            if not r.any_reviewed and r.entry and not review_log.ENTRIES[r.entry][4]:
                ways["reviewed", reviewed] = ()
            ways[r.entry, review_log.ANY if r.any_held else held, review_log.ANY if r.any_reviewed else reviewed] = (r.exists, r.busy, r.exporting, r.ready, r.source, r.value)
        own.after(ways)
        for event in frame.where(frame.notna(), None).to_dict("records"):
            state, _ = review.step(state, event)
        assert own.exists == (state is not None)
        if state:
            assert {f: own.values[i] for i, f in enumerate(review_log.FIELDS)} == {f: state[f] for f in review_log.FIELDS} and own.ready == state["ready"]


def test_no_events(spark):
    assert review.review_outcomes(spark.createDataFrame([], DDL)).collect() == []
