"""Streaming forms: captions at pauses, review state, new media, block activity."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cuetable import fixed
from cuetable.functions.ids import file_name, video_key
from cuetable.operators.review import OUTCOME_DDL, STATE, STATE_DDL, fold, upsert_items
from cuetable.plans.commits import append_new
from cuetable.plans.ranges import covered_bins
from cuetable.plans.shipping import ship
from cuetable.sources.media import FILE_DDL


def stream_gap_captions(tokens: DataFrame, gap: str = "380 milliseconds", watermark: str = "2 seconds", with_text: bool = False) -> DataFrame:
    """Tokens ``(video_id, ts, text)`` grouped at pauses.

    A group is given out once the watermark has passed it; later tokens are dropped. Text is
    gathered only on request, for feeds whose pauses bound the groups.
    """
    aggs = [F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.count(F.lit(1)).alias("n_tokens")]
    if with_text:
        aggs.append(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("ts", "text"))), lambda t: t["text"]), " ").alias("text"))
    return tokens.withWatermark("ts", watermark).groupBy("video_id", F.session_window("ts", gap)).agg(*aggs).drop("session_window")


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
WAITING_DDL = "at bigint, seq bigint, action string, revision string, expected string, status string, error string, output string"


class ReviewQueue(StatefulProcessor):
    """One item's state and the events that wait for the watermark; a removed item leaves nothing behind."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.item = handle.getValueState("item", STATE_DDL)
        self.waiting = handle.getListState("waiting", WAITING_DDL)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, found = timerValues.getCurrentWatermarkInMs(), []
        for frame in rows:
            frame = frame[[c.split()[0] for c in WAITING_DDL.split(", ")]].astype(object).where(frame.notna(), None)
            found += [r for r in frame.itertuples(index=False, name=None) if r[0] // 1000 >= passed]
        if found:
            self.waiting.appendList(found)
            self.handle.registerTimer(min(r[0] for r in found) // 1000 + 1)
        yield pd.DataFrame()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        held = list(self.waiting.get()) if self.waiting.exists() else []
        due = sorted((r for r in held if r[0] // 1000 < passed), key=lambda r: r[:2])
        if not due:
            yield pd.DataFrame()
            return
        state = dict(zip(STATE, self.item.get(), strict=True)) if self.item.exists() else None
        state, out = fold(key[0], state, pd.DataFrame(due, columns=["ts", *[c.split()[0] for c in WAITING_DDL.split(", ")[1:]]]))
        if state is None:
            self.item.clear()
        else:
            self.item.update(tuple(state[c] for c in STATE))
        rest = [r for r in held if r[0] // 1000 >= passed]
        if rest:
            self.waiting.put(rest)
            self.handle.registerTimer(min(r[0] for r in rest) // 1000 + 1)
        else:
            self.waiting.clear()
        yield out

    def close(self) -> None:
        pass


def stream_review_state(events: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Outcome of every review event, items' states kept between batches.

    Events wait until the watermark, ``delay`` behind the latest one, has passed them and are then taken in order of time, so that those
    which come late by less have the outcome of the whole log in order; later ones are dropped. State is kept in RocksDB, for which the
    session's provider is set.
    """
    spark = events.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    out = timed.groupBy("item_id").transformWithStateInPandas(ReviewQueue(), OUTCOME_DDL.replace("ts timestamp", "ts bigint"), "Append", "EventTime")
    return out.withColumn("ts", F.timestamp_micros("ts"))


def stream_new_media(spark: SparkSession, root: str, max_files: int = 1000, extensions: Sequence[str] = fixed.VIDEO_EXTENSIONS) -> DataFrame:
    """Videos as they appear under a folder, with the key of their path."""
    files = (spark.readStream.format("binaryFile").schema(FILE_DDL).option("recursiveFileLookup", "true")
             .option("maxFilesPerTrigger", max_files).load(root))
    files = files.select("path", "length", "modificationTime", file_name(F.col("path")).alias("name"))
    kind = F.lower(F.regexp_extract("name", "\\.([^.]+)$", 1))
    return files.filter(kind.isin(*extensions)).withColumn("item_id", video_key(F.col("path")))


def keep_items(files: DataFrame, table: str, checkpoint: str, items_ddl: str = "item_id string, name string, processing string, export_status string"):
    """Starts adding new media to the item table at ``table``, read by ``committed``; items already there keep their state.

    A batch that runs again after a failure adds nothing twice.
    """
    def add(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        none = spark.createDataFrame([], items_ddl)
        append_new(spark, table, ["item_id"], lambda known: upsert_items(none, batch.select("item_id", "name")))

    return files.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def stream_block_activity(markers: DataFrame, watermark: str = "10 seconds") -> DataFrame:
    """Sounding effects per one-second block of markers ``(video_id, ts, length_ms, gain)``."""
    start = F.unix_millis("ts")
    rows = markers.select("video_id", "gain", start.alias("_s"), (start + F.col("length_ms")).alias("_e"))
    rows = rows.select("*", F.explode(covered_bins(F.col("_s"), F.col("_e"), 1000)).alias("_b"))
    inside = F.least(F.col("_e"), (F.col("_b") + 1) * 1000) - F.greatest(F.col("_s"), F.col("_b") * 1000)
    rows = rows.select("video_id", F.timestamp_millis(F.col("_b") * 1000).alias("block_ts"), (F.col("gain") * inside).alias("_g"))
    return (rows.withWatermark("block_ts", watermark).groupBy("video_id", F.window("block_ts", "1 second"))
            .agg(F.count(F.lit(1)).alias("active"), F.sum("_g").alias("gain_ms"))
            .select("video_id", F.col("window.start").alias("block_ts"), "active", "gain_ms"))
