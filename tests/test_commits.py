"""Tables by commits: races, broken tables, and how much a changed document rewrites."""

import shutil

import pytest
from pyspark.sql import functions as F

from cuetable.plans import commits
from cuetable.sources import documents, media


def test_racing_runs_leave_each_key_once(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = spark.range(20).withColumn("lang", F.lit("en"))

    def first(fresh):
        inner = media.with_cached_stage(rows.filter("id < 12"), cache, ["id", "lang"], lambda df: df.withColumn("made", F.lit("inner")))
        assert inner.count() == 12  # commits while the other is at work
        return fresh.withColumn("made", F.lit("outer"))

    out = media.with_cached_stage(rows, cache, ["id", "lang"], first)
    assert {r["id"]: r["made"] for r in out.collect()} == {i: "inner" if i < 12 else "outer" for i in range(20)}
    assert commits.committed(spark, cache).count() == 20
    again = media.with_cached_stage(rows, cache, ["id", "lang"], lambda df: df.withColumn("made", F.lit("again")))
    assert again.filter("made = 'again'").count() == 0 and len(commits.commits(spark, cache)) == 2


def test_only_an_unwritten_table_is_empty(spark, tmp_path):
    cache = str(tmp_path / "cache")
    rows = spark.range(3)
    assert commits.committed(spark, cache) is None
    media.with_cached_stage(rows, cache, ["id"], lambda df: df)
    shutil.rmtree(f"{cache}/{commits.commits(spark, cache)[0]}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        media.with_cached_stage(spark.range(5), cache, ["id"], lambda df: df)


def test_numbers_are_taken_once(spark, tmp_path):
    table = str(tmp_path / "t")
    assert commits.commit(spark, table, 0, "a") and not commits.commit(spark, table, 0, "b") and commits.commits(spark, table) == ["a"]


def test_a_changed_document_rewrites_its_bucket(spark, tmp_path):
    folder, n = str(tmp_path / "docs"), 400
    docs = spark.range(n).select(F.concat(F.lit("v"), "id").alias("video_id"), F.col("id").alias("size"))
    documents.write_projects(docs, folder, 20)
    read = lambda: documents.read_projects(spark, folder, docs.schema)
    assert read().count() == n and read().select("video_id").distinct().count() == n
    one = documents.write_projects(docs.filter("video_id = 'v7'").withColumn("size", F.lit(-1).cast("bigint")), folder, 20)
    assert one.count() == 1 and len(read().inputFiles()) >= 16
    version = one.first()["version"]
    assert spark.read.json(f"{folder}/{version}/documents").count() <= 60  # about a bucket, not the table
    assert {r["video_id"]: r["size"] for r in read().collect()} == {f"v{i}": -1 if i == 7 else i for i in range(n)}
    more = spark.range(n, 5 * n).select(F.concat(F.lit("v"), "id").alias("video_id"), F.col("id").alias("size"))
    documents.write_projects(more, folder, 20)  # buckets split as they grow
    assert read().count() == 5 * n and read().select("video_id").distinct().count() == 5 * n
    documents.write_projects(docs.filter("size < 0"), folder, 20)
    assert read().count() == 5 * n


def test_files_follow_documents_and_not_buckets(spark, tmp_path, monkeypatch):
    """Far more buckets than files; what was written anew is read in its last version alone, though its old shelf is still read for others."""
    monkeypatch.setattr(documents, "SHELVES", 4)
    folder, n = str(tmp_path / "docs"), 600
    docs = spark.range(n).select(F.concat(F.lit("v"), "id").alias("video_id"), F.col("id").alias("size"))
    first = documents.write_projects(docs, folder, 5)
    read = lambda: documents.read_projects(spark, folder, docs.schema)
    assert first.count() > 90 and sum("_shelf=" in f for f in read().inputFiles()) == 4 and read().columns == docs.columns
    for turn in (1, 2):
        again = documents.write_projects(docs.filter("size % 50 = 0").withColumn("size", -F.col("size") - turn), folder, 5)
        assert again.count() < 20
        assert sorted((r["video_id"], r["size"]) for r in read().collect()) == sorted((f"v{i}", -i - turn if i % 50 == 0 else i) for i in range(n))
