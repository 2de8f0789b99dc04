"""Listings of media and assets, probe records, and stage results kept by fingerprint."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.ids import file_name
from cuetable.plans.commits import append_new, committed

FILE_DDL = "path string, modificationTime timestamp, length bigint, content binary"


def _listing(spark: SparkSession, root: str, recursive: bool) -> DataFrame:
    """Paths, sizes and times under a folder; file contents are never read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    return reader.load(root).select("path", "length", "modificationTime", file_name(F.col("path")).alias("name"))


def _extension(name):
    return F.lower(F.regexp_extract(name, "\\.([^.]+)$", 1))


def media_files(spark: SparkSession, root: str, recursive: bool = False, extensions: Sequence[str] = fixed.VIDEO_EXTENSIONS) -> DataFrame:
    """Videos in a folder by lower-cased name; none at all is an error."""
    files = _listing(spark, root, recursive).filter(_extension(F.col("name")).isin(*extensions))
    if files.isEmpty():
        raise ValueError(f"no videos in {root}")
    return files.orderBy(F.lower("name"), "path")


def recent_media(files: DataFrame, n: int = 30, extension: str = "mp4") -> DataFrame:
    """The newest files of one kind."""
    return files.filter(_extension(F.col("name")) == extension).orderBy(F.desc("modificationTime"), "path").limit(n)


def asset_files(spark: SparkSession, library: str, extensions: Sequence[str] = fixed.ASSET_EXTENSIONS,
                excluded: Sequence[str] = fixed.EXCLUDED_ASSET_FOLDERS) -> DataFrame:
    """Images and videos under the library with the name of their top folder."""
    inside = F.substring_index(F.col("path"), library.rstrip("/") + "/", -1)
    rows = _listing(spark, library, True).select(
        F.split(inside, "/").getItem(0).alias("folder"), F.size(F.split(inside, "/")).alias("_depth"), "name", "path", _extension(F.col("name")).alias("ext"))
    return rows.filter((F.col("_depth") > 1) & F.col("ext").isin(*extensions) & ~F.col("folder").isin(*excluded)).drop("_depth")


PROBE_DDL = ("format struct<duration:string>, streams array<struct<index:int,codec_type:string,codec_name:string,"
             "width:int,height:int,r_frame_rate:string>>")


def flatten_probe(rows: DataFrame, json_col: str = "probe") -> DataFrame:
    """Media columns from probe JSON: first video and audio stream, zero or empty where absent."""
    parsed = rows.withColumn("_p", F.from_json(json_col, PROBE_DDL))

    def stream(kind: str):
        return F.get(F.filter("_p.streams", lambda s: s["codec_type"] == kind), 0)

    parsed = parsed.withColumn("_v", stream("video")).withColumn("_a", stream("audio"))
    rate = F.coalesce(F.col("_v.r_frame_rate"), F.lit(""))
    part = lambda i: F.coalesce(F.regexp_extract(rate, "^(\\d+)/(\\d+)$", i).try_cast("int"), F.lit(0))
    seconds = F.coalesce(F.col("_p.format.duration").try_cast("double"), F.lit(0.0))
    return parsed.select(
        *[c for c in rows.columns if c != json_col], F.round(seconds * 1000, 0).cast("bigint").alias("duration_ms"),
        F.coalesce("_v.width", F.lit(0)).alias("width"), F.coalesce("_v.height", F.lit(0)).alias("height"), part(1).alias("fps_num"), part(2).alias("fps_den"),
        F.coalesce("_v.codec_name", F.lit("")).alias("video_codec"), F.coalesce("_a.codec_name", F.lit("")).alias("audio_codec"))


def fingerprint(key_cols: Sequence[str]):
    """Key of a stage's input: its identifying columns, in order."""
    return F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols]), 256)


def with_cached_stage(inputs: DataFrame, cache: str, key_cols: Sequence[str], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Results of ``stage`` for every input, computed only where the cache has none.

    ``stage`` keeps the column ``stage_key``, with one row for each. New results are committed to the table at ``cache``, each key once though several
    runs work at it; the answer reads that table. Only a table that was never written counts as empty.
    """
    spark = inputs.sparkSession
    keyed = inputs.withColumn("stage_key", fingerprint(key_cols))

    def missing(known: DataFrame | None) -> DataFrame:
        fresh = keyed.dropDuplicates(["stage_key"])
        return stage(fresh if known is None else fresh.join(known.select("stage_key"), "stage_key", "left_anti"))

    added = append_new(spark, cache, ["stage_key"], missing)
    held = committed(spark, cache)
    return (added if held is None else held).join(keyed.select("stage_key").distinct(), "stage_key", "left_semi")


def cache_hits(inputs: DataFrame, known: DataFrame, key_cols: Sequence[str]) -> DataFrame:
    """Inputs with whether the cache holds their result."""
    have = known.select("stage_key").distinct().withColumn("hit", F.lit(True))
    return inputs.withColumn("stage_key", fingerprint(key_cols)).join(have, "stage_key", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
