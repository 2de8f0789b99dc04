"""From documents to packed sequences: language, exact copies, near copies, source mix, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import place_of, table, without, written
from cuetable.llm.exact_dedup import exact_groups
from cuetable.llm.language import fit, training_rows, with_known_language
from cuetable.llm.mixing import mix
from cuetable.llm.near_dedup import near_groups
from cuetable.llm.packing import pack
from cuetable.llm.token_counts import vocabulary_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language; without a letter, none can be told."""
    return with_known_language(docs, fit(training_rows(docs)))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text; of rows alike in id and text, one."""
    groups = written(exact_groups(docs), "groups")
    rest = without(docs, groups.filter("NOT kept"))
    again = groups.filter("kept AND group_size > 1").groupBy("doc_id", "place").count().filter("count > 1")
    if again.isEmpty():
        return rest
    return rest.select(F.struct("*").alias("row"), rest["doc_id"].alias("id"), place_of(rest).alias("text")).dropDuplicates(["id", "text"]).select("row.*")


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, by five words."""
    return without(docs, near_groups(docs).filter("NOT kept"))


def sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it; the one cut at its source's target comes whole."""
    copies = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = mix(docs, rows_too=True).filter("taken > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), copies)).alias("copy")).select("row.*")


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences; ``ids`` are little-endian unsigned 32-bit."""
    return pack(docs, vocabulary_path())


STAGES = [("language", language), ("exact_dedup", exact), ("near_dedup", near), ("mixing", sources), ("packing", sequences)]
#: The model that tells languages has no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for at, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if at + 1 < len(STAGES):
            docs = written(docs, name)
    return docs.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
