"""The review queue as a stream: events out of order, and what removed items leave."""

import datetime as dt
import random

from cuetable.operators import review
from cuetable.streaming import streams

DDL = "item_id string, ts timestamp, seq bigint, action string, revision string, expected string, status string, error string, output string"
START = dt.datetime(2024, 1, 1)


def test_late_events_and_removal(spark, tmp_path):
    rng = random.Random(3)
    rows = []
    for i in range(12):
        log = [("analysis", "r1"), ("approve", "r1"), ("save", "r2"), ("approve", "r2"), ("export", None)] + ([("export_status", "r2"), ("remove", None)] if i % 3 else [])
        rows += [(f"v{i}", START + dt.timedelta(seconds=10 * k + i), 100 * i + k, a, r, None, "done" if a == "export_status" else None, None, None) for k, (a, r) in enumerate(log)]
    rows.sort(key=lambda r: r[1] + dt.timedelta(seconds=rng.randint(0, 25)))  # arrival up to 25 s late
    end = [("end", START + dt.timedelta(seconds=s), s, "add", None, None, None, None, None) for s in (400, 800)]
    source, out, held = tmp_path / "in", str(tmp_path / "out"), []
    for part in (rows[:30], rows[30:], end[:1], end[1:]):
        spark.createDataFrame(part, DDL).coalesce(1).write.mode("append").parquet(str(source))
        stream = streams.stream_review_state(spark.readStream.schema(DDL).parquet(str(source)), "30 seconds")
        query = stream.writeStream.option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        held.append(query.recentProgress[-1].stateOperators[0].numRowsTotal)
    got = spark.read.parquet(out).filter("item_id <> 'end'")
    want = review.review_outcomes(spark.createDataFrame(rows, DDL))
    columns = ["item_id", "ts", "seq", "action", "accepted", "conflict", *[f"`{c}`" for c in review.STATE]]
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))
    assert {r["item_id"] for r in review.review_state(got).collect()} == {"v0", "v3", "v6", "v9"}
    assert held[-1] < held[0], held
