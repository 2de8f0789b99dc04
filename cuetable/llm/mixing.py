"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuetable.llm.common import table, written
from cuetable.plans.sizes import broadcast_if_small

BINS = 1 << 16
#: Fixed values of the contract.
WEIGHTS, SHARE, MOST_COPIES = (3, 1, 2), 1.5, 2


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """``source, source_size, target`` for every source, by code point with null last.

    Sources share ``share`` times all sizes by weight; a source stops at ``most`` times its own size and the rest is shared again.
    Filled in order of size per weight, the level per unit of weight rises while sources stop and falls once none does, so the highest
    is where sharing round by round ends. One row per source is held in one task.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").cast("bigint").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    rows = by_source.withColumn("weight", weight).withColumn("most", F.col("source_size") * most)
    order = W.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum("most").over(before), F.lit(0))
    rows = rows.withColumn("level", left / F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    return rows.select("source", "source_size", F.least(F.col("most").cast("double"), F.max("level").over(whole) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, seed: str = "mix", weights=WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, weight: Column | None = None, rows_too: bool = False) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, place, source, size, source_size, target, taken``, and the ``row`` itself if ``rows_too``; reruns agree.

    ``place`` is a hash of the text. Rows themselves are read a second time, beside the small tables that say what is taken; no text is shuffled.
    Each document expects ``target / source_size`` copies of itself, times ``weight`` where given (relative to 1), at most ``most``. The
    whole part is certain. The fraction is its inclusion probability ``p``: documents are ranked by ``(u / (1 - u)) / (p / (1 - p))`` with
    ``u`` drawn from a hash of ``doc_id``, and taken in this order until the source's words are full; the last one is cut. Rows equal in
    source, doc_id and size share what falls to them evenly. Null and empty texts have size 0 and take 0; null is a source of its
    own; an empty table gives an empty mix. Other columns are not read.
    """
    part = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))), 1, 13), 16, 10)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"),
                       F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("place"),
                       ((part.cast("bigint") + 0.5) / F.lit(4503599627370496.0)).alias("u"), (F.lit(1.0) if weight is None else weight.cast("double")).alias("lift"), *([F.struct(*docs.columns).alias("row")] if rows_too else []))
    again, rows = rows, written(rows.drop("row"), "sizes")
    sources = broadcast_if_small(written(source_targets(rows, weights, share, most), "sources").withColumnRenamed("source", "_source"))

    def ranked(rows: DataFrame) -> DataFrame:
        rows = rows.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
        rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
        rows = rows.withColumn("expected", F.least(F.lit(float(most)), rate * F.col("lift"))).withColumn("whole", F.floor("expected"))
        p, u = F.col("expected") - F.col("whole"), F.col("u")
        return rows.withColumn("rank", F.when(p > 0, (u / (1 - u)) / (p / (1 - p)))).withColumn(
            "bin", F.floor(F.col("rank") / (1 + F.col("rank")) * BINS))

    rows = ranked(rows)
    # Words still wanted beyond the certain copies, and the bin in which each source fills up.
    bins = rows.groupBy("source", "bin").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("certain"), F.first("target").alias("target"))
    in_source = W.partitionBy("source")
    bins = bins.withColumn("wanted", F.floor("target") - F.sum("certain").over(in_source)).filter(F.col("bin").isNotNull()).withColumn(
        "before", F.coalesce(F.sum("words").over(in_source.orderBy("bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    edge = bins.filter((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("words") > F.col("wanted")))
    edge = written(edge.select(F.col("source").alias("_source"), F.col("bin").alias("_bin"), (F.col("wanted") - F.col("before")).alias("_room")), "edge")
    full = bins.groupBy("source").agg(F.max(F.when(F.col("before") + F.col("words") <= F.col("wanted"), F.col("bin"))).alias("_full")).withColumnRenamed("source", "_of")
    # Inside that bin, documents one after the other.
    at_edge = rows.join(broadcast_if_small(edge), F.col("source").eqNullSafe(F.col("_source")) & (F.col("bin") == F.col("_bin")))
    kinds = at_edge.groupBy("source", "doc_id", "size", "rank").agg(F.count(F.lit(1)).alias("n"), F.first("_room").alias("_room"))
    order = in_source.orderBy("rank", F.col("doc_id").asc_nulls_last(), "size").rowsBetween(W.unboundedPreceding, -1)
    given = F.least(F.greatest(F.col("_room") - F.coalesce(F.sum(F.col("n") * F.col("size")).over(order), F.lit(0)), F.lit(0)), F.col("n") * F.col("size"))
    kinds = kinds.select(F.col("source").alias("_source"), F.col("doc_id").alias("_doc"), F.col("size").alias("_size"), F.floor(given / F.col("n")).alias("_extra"))
    rows = ranked(again) if rows_too else rows
    rows = rows.join(broadcast_if_small(written(full, "full")), F.col("source").eqNullSafe(F.col("_of")), "left")
    rows = rows.join(broadcast_if_small(written(kinds, "kinds")), F.col("source").eqNullSafe(F.col("_source")) & F.col("doc_id").eqNullSafe(F.col("_doc"))
                     & (F.col("size") == F.col("_size")), "left")
    extra = F.when(F.col("bin") <= F.col("_full"), F.col("size")).otherwise(F.coalesce("_extra", F.lit(0)))
    return rows.select("doc_id", "place", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + extra).cast("bigint").alias("taken"), *(["row"] if rows_too else []))


#: Documents of so many words are looked for more often than shorter ones.
LONG_WORDS, LONG_LIFT, SHORT_LIFT = 200, 1.25, 0.75


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    lift = F.when(word_count(F.col("text")) >= LONG_WORDS, LONG_LIFT).otherwise(SHORT_LIFT)
    return mix(table(spark, sf_dir, "documents"), weight=lift).select("doc_id", "size", "source_size", "target", "taken")


SQL = r"""
WITH rows AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         (CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE AS u
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS s, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM rows GROUP BY source),
filling AS (
  SELECT *, (CAST(sum(s) OVER () AS DOUBLE) * 1.5::DOUBLE - CAST(coalesce(sum(2 * s) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
    / CAST(sum(w) OVER (ORDER BY 2 * s / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level FROM sources),
targets AS (SELECT source, s, least(CAST(2 * s AS DOUBLE), max(level) OVER () * w) AS target FROM filling),
ranked AS (
  SELECT r.*, t.s, t.target, CASE WHEN t.s > 0 THEN least(2.0::DOUBLE, t.target / t.s * CASE WHEN r.size >= 200 THEN 1.25::DOUBLE ELSE 0.75::DOUBLE END) ELSE 0.0::DOUBLE END AS e
  FROM rows r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source),
kinds AS (
  SELECT source, doc_id, size, s, target, CAST(floor(e) AS BIGINT) AS whole, count(*) AS n,
         CASE WHEN e - floor(e) > 0 THEN (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) END AS rank
  FROM ranked GROUP BY ALL),
room AS (
  SELECT *, CAST(floor(target) - sum(whole * size * n) OVER (PARTITION BY source)
    - coalesce(sum(CASE WHEN rank IS NULL THEN 0 ELSE n * size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST, doc_id NULLS LAST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS room FROM kinds),
taken AS (
  SELECT source, doc_id, size, CAST(whole * size + CASE WHEN rank IS NULL THEN 0 ELSE least(greatest(room, 0), n * size) // n END AS BIGINT) AS taken FROM room)
SELECT r.doc_id, CAST(r.size AS BIGINT) AS size, r.s AS source_size, r.target, t.taken
FROM ranked r JOIN taken t ON r.source IS NOT DISTINCT FROM t.source AND r.doc_id IS NOT DISTINCT FROM t.doc_id AND r.size = t.size"""
QUERIES = {"op10_mix_sources": op10_mix_sources}
ORACLES = {"op10_mix_sources": SQL}
