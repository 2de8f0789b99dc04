"""Project documents and training snapshots on disk."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StringType, StructType

from cuetable import fixed
from cuetable.functions.ids import file_name
from cuetable.plans.commits import append_new, commit, commits
from cuetable.plans.folders import cut_lineage
from cuetable.plans.sizes import broadcast_if_small

#: Documents of one bucket before it is split.
BUCKET_DOCS = 2_000
#: A commit's buckets lie in files of their own, or in shelves of about so many documents where that were more files than these.
SHELF_DOCS, SHELVES = 10_000, 64


def _bucket(video_id: Column, depth: Column) -> Column:
    """The bucket of a document: the last ``depth`` bits of its hash."""
    return F.xxhash64(video_id).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), depth.cast("int")) - 1)


def _buckets(spark: SparkSession, folder: str) -> DataFrame | None:
    """``depth, bucket, version, shelf`` of the buckets that hold the documents now; none if nothing was ever written."""
    versions = commits(spark, folder)
    if not versions:
        return None
    entries = spark.read.parquet(*[f"{folder}/{v}/buckets" for v in versions])
    last = entries.groupBy("depth", "bucket").agg(F.max_by(F.struct("version", "live", "shelf"), "number").alias("e"))
    return last.filter("e.live").select("depth", "bucket", "e.version", "e.shelf")


def _documents(spark: SparkSession, folder: str, schema: StructType, buckets: DataFrame) -> DataFrame:
    """Documents of the named buckets; no file without one is opened or listed."""
    files = buckets.select("version", "shelf").distinct().collect()  # as many as there are files
    paths = [f"{folder}/{r.version}/documents/_shelf={r.shelf}" for r in files]
    full = StructType([f for f in schema.fields if f.name != "_corrupt"])
    if not paths:
        return spark.createDataFrame([], full)
    rows = spark.read.schema(StructType([*full.fields]).add("_depth", IntegerType()).add("_bucket", LongType())).json(paths)
    # What a shelf holds besides was written anew in another version.
    rows = rows.withColumn("_version", F.regexp_extract(F.col("_metadata.file_path"), r"/(version-[0-9a-f]+)/documents/_shelf=[0-9]+/[^/]*$", 1))
    named = broadcast_if_small(buckets.select(F.col("depth").alias("_depth"), F.col("bucket").alias("_bucket"), F.col("version").alias("_version")))
    return rows.join(named, ["_depth", "_bucket", "_version"], "left_semi").select(*full.names)


def read_projects(spark: SparkSession, folder: str, schema: StructType, multi_line: bool = False) -> DataFrame:
    """Project documents of a folder; the queue file and malformed documents are passed over.

    A folder written here is read by its latest commit. In any other, ``multi_line`` reads one document per file, otherwise one per line.
    """
    if not multi_line and (buckets := _buckets(spark, folder)) is not None:
        return _documents(spark, folder, schema, buckets)
    full = StructType([f for f in schema.fields if f.name != "_corrupt"]).add("_corrupt", StringType())
    rows = (spark.read.schema(full).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
            .option("multiLine", str(multi_line).lower()).json(folder))
    rows = rows.filter(file_name(F.input_file_name()) != fixed.QUEUE_FILE)
    return rows.filter(F.col("_corrupt").isNull() & F.col("video_id").isNotNull()).drop("_corrupt")


def write_projects(projects: DataFrame, folder: str, bucket_docs: int = BUCKET_DOCS) -> DataFrame:
    """Writes whole documents, replacing those of the same videos; returns ``depth, bucket, version`` of the buckets written.

    Documents lie in buckets by the last bits of their hash, as many bits as their number asks for. A commit lists the buckets it wrote and those
    that these stand for, so the buckets of a document are found by an equi-join with the list, and only they are merged and written anew, under
    another version. Many buckets share a file, their shelf, so files follow the size of a commit and not the number of buckets; a bucket is read with its shelf. Readers see all of a commit or nothing; if someone else commits first, the work starts again from theirs.
    """
    spark = projects.sparkSession
    new = cut_lineage(projects, "projects")
    while True:
        number = len(commits(spark, folder))
        known = _buckets(spark, folder)
        version = f"version-{uuid.uuid4().hex}"
        ids = new.select("video_id").distinct()
        if known is None:
            touched, rows = None, new.withColumn("_old", F.lit(0))
        else:
            depths = [r.depth for r in known.select("depth").distinct().collect()]  # at most as many as a hash has bits
            placed = ids.withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("bucket", _bucket(F.col("video_id"), F.col("depth")))
            touched = cut_lineage(known.join(placed.select("depth", "bucket").distinct(), ["depth", "bucket"], "left_semi"), "touched")
            old = _documents(spark, folder, projects.schema, touched).join(ids, "video_id", "left_anti")
            whole = cut_lineage(new.unionByName(old), "merged")
            depth_of = placed.join(touched, ["depth", "bucket"]).select("video_id", F.col("depth").alias("_old"))
            olds = old.select("video_id").distinct().withColumn("depth", F.explode(F.array(*map(F.lit, depths)))).withColumn("bucket", _bucket(F.col("video_id"), F.col("depth")))
            depth_of = depth_of.unionByName(olds.join(touched, ["depth", "bucket"]).select("video_id", F.col("depth").alias("_old")))
            rows = whole.join(cut_lineage(depth_of, "depths"), "video_id")
        rows = cut_lineage(rows.withColumn("_at", _bucket(F.col("video_id"), F.col("_old"))), "documents")
        held = rows.groupBy("_old", "_at").agg(F.count_distinct("video_id").alias("_n"))
        deeper = F.greatest(F.lit(0), F.ceil(F.log2(F.col("_n") / F.lit(bucket_docs)) - 1e-9)).cast("int")
        sized = cut_lineage(held.select("_old", "_at", (F.col("_old") + deeper).cast("int").alias("_depth"), "_n"), "sized")
        shelves = max(SHELVES, math.ceil((sized.agg(F.sum("_n")).first()[0] or 0) / SHELF_DOCS))
        placed = rows.join(sized.drop("_n"), ["_old", "_at"]).withColumn("_bucket", _bucket(F.col("video_id"), F.col("_depth")))
        placed = placed.withColumn("_shelf", F.pmod("_bucket", F.lit(shelves)).cast("int")).drop("_old", "_at")
        placed.repartition(shelves, "_shelf").write.partitionBy("_shelf").json(f"{folder}/{version}/documents")
        written = placed.select(F.col("_depth").alias("depth"), F.col("_bucket").alias("bucket"), F.col("_shelf").alias("shelf")).distinct().withColumn("live", F.lit(True))
        if touched is not None:
            gone = touched.select("depth", "bucket").join(written, ["depth", "bucket"], "left_anti").withColumns({"shelf": F.lit(None).cast("int"), "live": F.lit(False)})
            written = written.unionByName(gone)
        written.withColumn("version", F.lit(version)).withColumn("number", F.lit(number)).write.parquet(f"{folder}/{version}/buckets")
        if commit(spark, folder, number, version):
            return spark.read.parquet(f"{folder}/{version}/buckets").filter("live").select("depth", "bucket", "version")


def project_relation(projects: DataFrame, section: str) -> DataFrame:
    """A section of project documents as rows again."""
    return projects.select("video_id", F.explode(section).alias("_i")).select("video_id", "_i.*")


def append_snapshots(projects: DataFrame, folder: str, date: Column | None = None) -> DataFrame:
    """Adds model-and-human records ``(video_id, revision, …)`` whose revision is new for their video; ``committed`` reads them.

    Snapshots are never changed, and each is there once though several saves run at a time. Returns the rows added.
    """
    rows = projects.withColumn("snapshot_date", F.current_date() if date is None else date)
    return append_new(projects.sparkSession, folder, ["video_id", "revision"], lambda known: rows)
