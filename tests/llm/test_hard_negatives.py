"""Hard negatives against plain sorting."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cuetable.llm import hard_negatives as H


def expected(rows, is_anchor, positives=5, negatives=10, low=30, high=90, scale=256):
    own = [(i, label, [math.floor(scale * x) for x in v]) for i, label, v in rows
           if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for at, (a, label, v) in enumerate(own):
        if not is_anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=False)), i, other == label) for k, (i, other, w) in enumerate(own) if k != at)
        for p, pid, _ in [s for s in scored if s[2]][:positives]:
            window = [s for s in scored if not s[2] and low * -p <= 100 * -s[0] <= high * -p][:negatives]
            out += [(a, pid, r + 1, i, -p, -n) for r, (n, i, _) in enumerate(window)]
    return sorted(out)


def table(spark, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, label int, embedding array<double>").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in ("row", "v", "asks", "block", "score", "slot", "anchor", "rank", "limits")})


@pytest.mark.parametrize("seed,whole,blocks", [(1, False, (4_096, 1_024)), (2, True, (16, 4)), (3, False, (7, 3))])
def test_windows(spark, monkeypatch, seed, whole, blocks):
    monkeypatch.setattr(H, "ROW_BLOCK", blocks[0])
    monkeypatch.setattr(H, "ANCHOR_BLOCK", blocks[1])
    rng = random.Random(seed)
    value = (lambda: float(rng.randint(-1, 2))) if whole else (lambda: rng.gauss(0.3, 0.5))  # whole numbers tie
    rows = [(i, rng.choice([0, 0, 1, 2]), [value() for _ in range(4)]) for i in range(200)]
    got = sorted(tuple(r) for r in H.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert got == expected(rows, lambda i: i % 10 == 0) and got


def test_odd_rows(spark):
    rows = [(0, 1, [1.0, 0.5]), (1, 1, [1.0, 0.5]), (2, 1, [0.9, 0.5]), (3, None, [1.0, 1.0]), (4, 2, None), (5, 2, [1.0, None]), (6, 2, [float("nan"), 1.0]), (7, 2, [float("inf"), 1.0]),
            (None, 2, [0.5, 0.5]), (8, 2, [0.5, 0.5]), (9, 2, [0.6]), (10, 3, []), (20, 3, [0.0, 0.0]), (11, 2, [0.5, 0.5]), (12, 4, [-1.0, -1.0]), (30, 1, [-1.0, 0.0]), (40, 9, [1.0, 1.0])]
    got = sorted(tuple(r) for r in H.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0).collect())
    assert got == expected(rows, lambda i: i % 10 == 0) and got
    assert H.hard_negatives(table(spark, rows).limit(0), F.col("vec_id") % 10 == 0).collect() == []


def test_repeated_rows(spark):
    rows = [(0, 1, [1.0, 0.5])] * 3 + [(5, 2, [0.5, 0.4])] * 12 + [(6, 1, [0.9, 0.5])]
    got = sorted(tuple(r) for r in H.hard_negatives(table(spark, rows), F.col("vec_id") == 0).collect())
    assert got == expected(rows, lambda i: i == 0) and len(got) == 3 * 3 * 10


def test_large_components(spark):
    rows = [(i, i % 2, [3e7 + i, 2e7 - i, 1.0]) for i in range(30)] + [(100 + i, 1 - i % 2, [1e7 + i, 1e7]) for i in range(30)]
    got = sorted(tuple(r) for r in H.hard_negatives(table(spark, rows), F.col("vec_id") % 10 == 0, scale=1).collect())
    assert got == expected(rows, lambda i: i % 10 == 0, scale=1) and got
