import random

import pytest
from pyspark.sql import functions as F

from cuetable.plans.ordered import EvenTime, by_position, by_time, ordered
from cuetable.plans.ranges import overlap_join, point_join


def test_chunks_do_not_change_results(spark):
    rng = random.Random(3)
    data = [(v, rng.randrange(0, 2000), i, rng.choice([None, rng.randrange(9)])) for v in "ab" for i in range(150)]
    df = spark.createDataFrame(data, "k string, t bigint, id bigint, x bigint")
    x = F.coalesce("x", F.lit(0))
    asked = dict(number="n", lag={"l": F.col("x")}, lead={"r": F.col("x")}, before={"s": x}, last_seen={"ls": F.col("x")},
                 seen_before={"sb": F.col("x")}, next_seen={"ns": F.col("x")}, total={"tt": x}, is_last="last")
    whole = sorted(map(str, ordered(df, ["k"], ["t", "id"], None, **{k: v for k, v in asked.items()}).collect()))
    for chunk in (by_time("t", 1), by_time("t", 100), EvenTime("t", 5000, 20), EvenTime("t", 400, 30), EvenTime("t", 300, 10_000)):
        assert sorted(map(str, ordered(df, ["k"], ["t", "id"], chunk, **asked).collect())) == whole


def test_even_chunks(spark):
    """One key holds nearly all rows within a second of an hour: its chunks are about as large as each other."""
    rows = spark.range(200_000).select(F.lit("v").alias("k"), (F.pmod(F.xxhash64("id"), F.lit(1_000)) + 5_000).alias("t"), "id").unionByName(
        spark.range(2_000).select(F.lit("w").alias("k"), (F.col("id") * 7_000).alias("t"), "id"))
    placed, chunk = EvenTime("t", 3_600_000, 5_000).over(rows, ["k"])
    sizes = {(r["k"], r["c"]): r["count"] for r in placed.groupBy("k", chunk.alias("c")).count().collect()}
    assert sum(sizes.values()) == 202_000 and max(sizes.values()) < 3_000 and len([k for k, _ in sizes if k == "v"]) > 150
    assert placed.groupBy("k", chunk.alias("c")).agg(F.min("t").alias("a"), F.max("t").alias("b")).filter("k = 'w'").count() == 4


@pytest.mark.parametrize("bin_ms", [1, 10, 1000])
def test_range_joins_match_nested_loops(spark, bin_ms):
    rng = random.Random(5)
    left = [("v", i, s, s + rng.randrange(1, 40)) for i, s in enumerate(rng.randrange(0, 300) for _ in range(40))]
    right = [("v", i, s, s + rng.randrange(1, 60)) for i, s in enumerate(rng.randrange(0, 300) for _ in range(25))]
    a, b = spark.createDataFrame(left, "k string, a int, s long, e long"), spark.createDataFrame(right, "k string, b int, rs long, re long")
    got = sorted((r["a"], r["b"]) for r in overlap_join(a, b, ["k"], ("s", "e"), ("rs", "re"), bin_ms).collect())
    assert got == sorted((l[1], r[1]) for l in left for r in right if l[3] > r[2] and l[2] < r[3])
    got = sorted((r["a"], r["b"]) for r in point_join(a, b, ["k"], "s", ("rs", "re"), bin_ms).collect())
    assert got == sorted((l[1], r[1]) for l in left for r in right if r[2] <= l[2] < r[3])


def test_release(tmp_path):
    """A named folder is used as it is, and emptied of what was written there."""
    import subprocess
    import sys
    script = """
import os, sys
sys.path.insert(0, sys.argv[1])
from pyspark.sql import SparkSession
from cuetable.plans.folders import cut_lineage, release
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
assert cut_lineage(spark.range(5)).count() == 5 and os.listdir(sys.argv[2])
release(spark)
assert not [n for n in os.listdir(sys.argv[2]) if n.startswith("stage")]
"""
    from pathlib import Path
    done = subprocess.run([sys.executable, "-c", script, str(Path(__file__).resolve().parents[1]), str(tmp_path)], capture_output=True, text=True, timeout=200)
    assert done.returncode == 0, done.stderr[-2000:]


def test_small_keys_are_dealt_once(spark):
    """Positions within one chunk need no edges; chunks of few rows give the same."""
    rows = spark.createDataFrame([(f"v{i % 7}", i // 7, i) for i in range(60)], "k string, p int, x bigint")
    asked = dict(number="n", lag={"l": F.col("x")}, lead={"r": F.col("x")}, before={"s": F.col("x")}, total={"t": F.col("x")}, is_last="end")
    small, cut = (ordered(rows, ["k"], ["p"], by_position("p", size), **asked) for size in (50_000, 3))
    assert "Join" not in small._jdf.queryExecution().executedPlan().toString() and "Join" in cut._jdf.queryExecution().executedPlan().toString()
    assert small.dtypes == cut.dtypes and sorted(map(str, small.collect())) == sorted(map(str, cut.collect()))
