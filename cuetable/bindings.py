"""The given tables read as the relations of the data model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.plans.folders import new_folder
from cuetable.plans.ordered import by_position, ordered

ORIGIN_DATE = "2024-01-01"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(ts: Column) -> Column:
    """Milliseconds since the origin date, whatever the session time zone."""
    second = F.floor(F.date_part(F.lit("SECOND"), ts) * 1000)
    return (F.datediff(ts, F.lit(ORIGIN_DATE)).cast("bigint") * 86_400_000 + F.hour(ts) * 3_600_000
            + F.minute(ts) * 60_000 + second).cast("bigint")


_WRITTEN: dict[tuple[str, str, str], str] = {}


def written_once(spark: SparkSession, sf_dir: str, name: str, build) -> DataFrame:
    """A derived relation, written on first use and read by every later query of the session."""
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key not in _WRITTEN:
        path = new_folder(spark, name)
        build().write.parquet(path)
        _WRITTEN[key] = path
    return spark.read.parquet(_WRITTEN[key])


def captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as captions laid end to end, 60 ms a character."""
    return written_once(spark, sf_dir, "captions", lambda: _captions(spark, sf_dir))


def _captions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("id"), "text",
        (F.length("text") * 60).cast("bigint").alias("_len"))
    rows = ordered(rows, ["video_id"], ["id"], by_position("id"), before={"start_ms": F.col("_len")})
    return rows.select("video_id", "id", "start_ms", (F.col("start_ms") + F.col("_len")).alias("end_ms"), "text")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as long transcripts."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("video_id"), "text", F.col("lang").alias("language"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as points on the timeline of their user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").cast("string").alias("video_id"), F.col("event_id").alias("id"), millis(F.col("ts")).alias("time_ms"),
        F.col("event_type").alias("kind"), F.col("value").alias("weight"))


def intervals(spark: SparkSession, sf_dir: str, ms_per_unit: int = 500_000) -> DataFrame:
    """Events as intervals whose length follows their value, long enough to overlap."""
    cents = F.round(F.col("weight") * 100, 0).cast("bigint")
    return points(spark, sf_dir).select(
        "video_id", "id", F.col("time_ms").alias("start_ms"), (F.col("time_ms") + cents * (ms_per_unit // 100)).alias("end_ms"),
        F.col("kind").alias("text"), "kind", "weight")


def clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as clips of the order they belong to."""
    return written_once(spark, sf_dir, "clips", lambda: _clips(spark, sf_dir))


def _clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("video_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice",
        (F.col("l_quantity") * 1000).cast("bigint").alias("_len"))
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "_len"]
    rows = ordered(rows, ["video_id"], order, by_position("l_linenumber"), number="ord")
    start = F.col("l_partkey") * 1000
    return rows.select("video_id", F.col("ord").cast("int").alias("ord"), F.col("ord").cast("string").alias("clip_id"),
                       start.alias("src_start_ms"), (start + F.col("_len")).alias("src_end_ms"))


def media_of(rows: DataFrame, end: str = "end_ms", slack_ms: int = 0) -> DataFrame:
    """Media as long as the last interval of each video."""
    return rows.groupBy("video_id").agg((F.max(end) + slack_ms).alias("duration_ms"))


# The same relations as SQL, for the checks.
SQL = {
    "captions": """captions AS (
  SELECT CAST(conv_id AS VARCHAR) AS video_id, turn AS id, text,
         CAST(coalesce(sum(60 * length(text)) OVER w, 0) AS BIGINT) AS start_ms,
         CAST(coalesce(sum(60 * length(text)) OVER w, 0) + 60 * length(text) AS BIGINT) AS end_ms
  FROM conversations
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "points": """points AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS id, CAST(epoch_us(ts) // 1000 - 1704067200000 AS BIGINT) AS time_ms,
         event_type AS kind, value AS weight FROM events)""",
    "intervals": """intervals AS (
  SELECT CAST(user_id AS VARCHAR) AS video_id, event_id AS id, CAST(epoch_us(ts) // 1000 - 1704067200000 AS BIGINT) AS start_ms,
         CAST(epoch_us(ts) // 1000 - 1704067200000 + CAST(round(value * 100) AS BIGINT) * 5000 AS BIGINT) AS end_ms,
         event_type AS text, event_type AS kind, value AS weight FROM events)""",
    "clips": """clips AS (
  SELECT video_id, ord, CAST(ord AS VARCHAR) AS clip_id, s AS src_start_ms, s + len AS src_end_ms FROM (
    SELECT CAST(l_orderkey AS VARCHAR) AS video_id, CAST(l_quantity * 1000 AS BIGINT) AS len, l_partkey * 1000 AS s,
           row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice,
                              l_quantity) - 1 AS ord FROM lineitem))""",
    "laid": """laid AS (
  SELECT *, out_start_ms + src_end_ms - src_start_ms AS out_end_ms FROM (
    SELECT *, CAST(coalesce(sum(src_end_ms - src_start_ms) OVER (PARTITION BY video_id ORDER BY ord
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS out_start_ms FROM clips))""",
    "totals": "totals AS (SELECT video_id, CAST(sum(src_end_ms - src_start_ms) AS BIGINT) AS edit_ms FROM clips GROUP BY video_id)",
}


def with_sql(*names: str) -> str:
    """``WITH`` clause defining the named relations."""
    return "WITH " + ",\n".join(SQL[n] for n in names)
