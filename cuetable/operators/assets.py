"""Matches product names to asset folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuetable.functions.grams import contained_terms
from cuetable.functions.text import distinct_chars, highlight_key
from cuetable.plans.folders import cut_lineage

THRESHOLD = 0.32


def folder_scores(products: DataFrame, folders: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Products ``(product)`` with the folders ``(folder)`` alike enough, and the score.

    A score comes from distinct characters in common, or from one name holding the other.
    A match by characters must share one of the query's rarest few, a folder held by the
    query must share its own rarest character; pairs sharing neither are never formed, the
    rest are scored exactly. Folders without letters or digits never match.
    """
    p = products.select("product", highlight_key(F.col("product")).alias("_pk")).filter("_pk <> ''").distinct().withColumn("_q", distinct_chars(F.col("_pk")))
    f = folders.select("folder", highlight_key(F.col("folder")).alias("_fk")).filter("_fk <> ''").distinct().withColumn("_n", distinct_chars(F.col("_fk")))
    pc, fc = p.select("*", F.explode("_q").alias("char")), f.select("*", F.explode("_n").alias("char"))
    rarity = fc.groupBy("char").agg(F.count(F.lit(1)).alias("_df"))
    place = F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("char").alias("char"))
    ranked = pc.join(rarity, "char", "left").groupBy("product", "_pk").agg(F.sort_array(F.collect_list(place)).alias("_r"))
    chars = F.transform("_r", lambda c: c["char"])
    need = F.ceil(F.size("_r") * F.lit(threshold) - 1e-9).cast("int")
    ranked = ranked.select("product", "_pk", chars.alias("_q"), F.slice(chars, 1, F.size("_r") - need + 1).alias("_t"))
    rarest = fc.join(rarity, "char").groupBy("folder", "_fk").agg(F.min(place).alias("_c"), F.collect_list("char").alias("_n")).select(
        "folder", "_fk", "_n", F.col("_c.char").alias("char"))
    # A pair is formed once: at the first telling character the two share, or, sharing none, at the folder's rarest.
    first = F.get(F.array_intersect("_t", "_n"), 0)
    telling = ranked.select("*", F.explode("_t").alias("char")).join(fc, "char").filter(first == F.col("char"))
    held = ranked.select("*", F.explode("_q").alias("char")).join(rarest, "char").filter(first.isNull())
    columns = ["product", "folder", "_pk", "_fk", "_q", "_n"]
    pairs = telling.select(*columns).unionByName(held.select(*columns))
    share = F.size(F.array_intersect("_q", "_n")) / F.size("_q")
    holds = F.contains(F.col("_fk"), F.col("_pk")) | F.contains(F.col("_pk"), F.col("_fk"))
    score = share + F.when(holds, 1.0).otherwise(0.0)
    return pairs.select("product", "folder", score.alias("score")).filter(F.col("score") >= threshold)


def holding(products: DataFrame, folders: DataFrame) -> DataFrame:
    """``_pk, _fk``: keys of which one holds the other."""
    p, f = products.select("_pk").distinct(), folders.select("_fk").distinct()
    inside = contained_terms(f, ["_fk"], "_fk", p.select(F.col("_pk").alias("term"))).select(F.col("term").alias("_pk"), "_fk")
    around = contained_terms(p, ["_pk"], "_pk", f.select(F.col("_fk").alias("term"))).select("_pk", F.col("term").alias("_fk"))
    return inside.unionByName(around).distinct()


def best_folders(products: DataFrame, folders: DataFrame, n: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """``product, folder, score, folder_rank``: the ``n`` best folders of each product, ties by name; scores as in ``folder_scores``.

    A folder whose name holds the product's, or is held by it, scores above all others, so these come first, through an equi-join. Only
    products short of ``n`` go on, as sets of characters: folders of one set score alike, and of each set the first ``2 n`` names are enough, as fewer than ``n``
    of them are taken already. Round ``d`` meets the sets that lack just ``d`` of the product's characters, at one of its ``d + 1`` rarest; what
    later rounds would find scores less.
    """
    p = cut_lineage(products.select("product", highlight_key(F.col("product")).alias("_pk")).filter("_pk <> ''").distinct(), "asset-products")
    f = cut_lineage(folders.select("folder", highlight_key(F.col("folder")).alias("_fk")).filter("_fk <> ''").distinct(), "asset-folders")
    p, f = p.withColumn("_q", distinct_chars(F.col("_pk"))), f.withColumn("_n", F.array_sort(distinct_chars(F.col("_fk"))))
    keys = p.select("_pk", "_q").distinct()
    share = F.size(F.array_intersect("_q", "_n")) / F.size("_q")

    def first(rows: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("_pk").orderBy(F.desc("score"), "folder"))
        return rows.withColumn("folder_rank", rank).filter(F.col("folder_rank") <= n)

    held = first(holding(p, f).join(f, "_fk").join(keys, "_pk").select("_pk", "folder", (share + 1.0).alias("score"))).drop("folder_rank")
    found = cut_lineage(held, "asset-held")
    taken = found.select("_pk", "folder")

    def short() -> DataFrame:
        full = found.groupBy("_pk").count().filter(F.col("count") >= n)
        return keys.join(full.select("_pk"), "_pk", "left_anti")

    waiting = cut_lineage(short(), "asset-waiting")
    if not waiting.isEmpty():
        names = F.row_number().over(Window.partitionBy("_n").orderBy("folder"))
        sets = cut_lineage(f.select("_n", "folder").withColumn("_at", names).filter(F.col("_at") <= 2 * n).groupBy("_n").agg(F.collect_list("folder").alias("_folders")), "asset-sets")
        postings = cut_lineage(sets.select("_n", F.explode("_n").alias("char")), "asset-chars")
        rarity = postings.groupBy("char").agg(F.count(F.lit(1)).alias("_df"))
        place = F.struct(F.coalesce("_df", F.lit(0)).alias("df"), F.col("char").alias("char"))
        ranked = waiting.select("_pk", F.explode("_q").alias("char")).join(rarity, "char", "left").groupBy("_pk").agg(F.sort_array(F.collect_list(place)).alias("_r"))
        ranked = cut_lineage(ranked.select("_pk", F.transform("_r", lambda c: c["char"]).alias("_q")), "asset-ranked")
        missing, most = 0, waiting.agg(F.max(F.size("_q"))).first()[0]
        while missing <= most * (1 - threshold) and not waiting.isEmpty():
            asked = ranked.join(waiting.select("_pk"), "_pk", "left_semi").filter((F.size("_q") - missing) / F.size("_q") >= threshold)
            met = asked.select("_pk", "_q", F.explode(F.slice("_q", 1, missing + 1)).alias("char")).join(postings, "char")
            met = met.filter(F.size(F.array_except("_q", "_n")) == missing).select("_pk", "_q", "_n").distinct().join(sets, "_n")
            met = met.select("_pk", share.alias("score"), F.explode("_folders").alias("folder")).join(taken, ["_pk", "folder"], "left_anti")
            found = cut_lineage(first(found.unionByName(met.select("_pk", "folder", "score"))).drop("folder_rank"), "asset-found")
            waiting = cut_lineage(short(), "asset-waiting")
            missing += 1
    return p.select("product", "_pk").join(first(found), "_pk").select("product", "folder", "score", "folder_rank")


def match_assets(products: DataFrame, folders: DataFrame, files: DataFrame, n_folders: int = 5, n_files: int = 40) -> DataFrame:
    """Files ``(folder, name, path)`` of each product's best folders: five folders, forty files.

    Ranks are top-k reports; Spark limits each rank before the shuffle. Equal scores go by name.
    """
    order = Window.partitionBy("product").orderBy("folder_rank", "path")
    rows = best_folders(products, folders, n_folders).join(files, "folder").withColumn("file_rank", F.row_number().over(order)).filter(F.col("file_rank") <= n_files)
    return rows.select("product", "folder", "score", "folder_rank", "file_rank", "name", "path")
