"""Line deduplication by overlapping windows of three lines, with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import table, texts, written

LINES = 3


def remove_repeated_lines(docs: DataFrame, lines: int = LINES) -> DataFrame:
    """``doc_id, text, n_lines, n_removed``: every document without the lines that repeat an earlier run of ``lines`` lines.

    Lines are what stands between line feeds, compared exactly. A run of ``lines`` consecutive lines that already began earlier (at a
    smaller doc_id, or further up in the same document) is removed; overlapping runs remove the union of their lines. Empty lines count
    as any other. A run is known by two independent 64-bit hashes of its whole lines. Null texts are empty;
    a null doc_id comes after all others. Rows alike in doc_id and text are one document and get the same result each. Other columns
    are not read.
    """
    docs = texts(docs).withColumn("_text", F.xxhash64("text"))
    hashes = docs.select("doc_id", "_text", F.transform(F.split("text", "\n"), lambda x: F.xxhash64(x)).alias("h"),
                         F.transform(F.split("text", "\n"), lambda x: F.xxhash64(F.lit("second"), x)).alias("g"))
    starts = F.when(F.size("h") >= lines, F.sequence(F.lit(0), F.size("h") - lines))
    several = [F.xxhash64(*[F.col(c)[F.col("at") + k] for k in range(lines)]) for c in ("h", "g")]
    windows = hashes.select("doc_id", "_text", "h", "g", F.explode(starts).alias("at")).select(
        "doc_id", "_text", "at", several[0].alias("w1"), several[1].alias("w2"))
    windows = written(windows, "windows")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_text", "at")
    repeated = windows.groupBy("w1", "w2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    later = windows.join(repeated, ["w1", "w2"]).filter(place > F.col("first")).select("doc_id", "_text", "at")
    # Runs start within a document's own lines, so a list of starts is no longer than the document.
    covered = later.groupBy("doc_id", "_text").agg(F.collect_set("at").alias("_starts")).select(
        F.col("doc_id").alias("_doc"), F.col("_text").alias("_of"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("_starts", lambda s: F.sequence(s, s + lines - 1))))).alias("_gone"))
    out = docs.join(covered, F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("_text") == F.col("_of")), "left")
    # Covered lines merged into stretches; what stands between two stretches is kept.
    out = out.select("doc_id", "text", F.split("text", "\n").alias("_lines"), "_gone",
                     F.filter("_gone", lambda x, i: ~F.get("_gone", i - 1).eqNullSafe(x - 1)).alias("_from"),
                     F.filter("_gone", lambda x, i: ~F.get("_gone", i + 1).eqNullSafe(x + 1)).alias("_to"))

    def between(k):
        start = F.coalesce(F.get("_to", k - 1) + 1, F.lit(0))
        return F.slice("_lines", start + 1, F.coalesce(F.get("_from", k), F.size("_lines")) - start)

    kept = F.flatten(F.transform(F.sequence(F.lit(0), F.size("_from")), between))
    return out.select("doc_id", F.when(F.col("_gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                      F.size("_lines").cast("bigint").alias("n_lines"), F.when(F.col("_gone").isNull(), 0).otherwise(F.size("_gone")).cast("bigint").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_lines(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH docs AS (SELECT DISTINCT doc_id, coalesce(text, '') AS text FROM documents),
lines AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM docs),
places AS (SELECT doc_id, text, ls, unnest(range(0, len(ls) - 2)) AS p FROM lines WHERE len(ls) >= 3),
windows AS (SELECT doc_id, text, p, ls[p + 1] || chr(10) || ls[p + 2] || chr(10) || ls[p + 3] AS w FROM places),
marked AS (SELECT doc_id, text, p, row_number() OVER (PARTITION BY w ORDER BY doc_id NULLS LAST, p) > 1 AS again
           FROM windows),
gone AS (SELECT doc_id, text, list_distinct(flatten(list([p, p + 1, p + 2]))) AS g FROM marked WHERE again GROUP BY doc_id, text)
SELECT d.doc_id, CAST(len(string_split(coalesce(d.text, ''), chr(10))) AS BIGINT) AS n_lines, CAST(coalesce(len(g.g), 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN g.g IS NULL THEN coalesce(d.text, '') ELSE coalesce(array_to_string(
         list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.g, i - 1)), chr(10)), '') END) AS kept_sha256
FROM documents d LEFT JOIN gone g ON d.doc_id IS NOT DISTINCT FROM g.doc_id AND coalesce(d.text, '') = g.text"""
QUERIES = {"op9_line_dedup": op9_line_dedup}
ORACLES = {"op9_line_dedup": SQL}
