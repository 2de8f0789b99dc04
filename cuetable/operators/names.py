"""Corrects one-character slips in captions towards the product named by the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.grams import BLOCK
from cuetable.functions.text import text_ratio

CJK_LETTERS = "\\u4e00-\\u9fff"


def _halves(target: Column, width: Column) -> Column:
    """Both halves of a target with where they begin in it; one of them is spelled right if a single character is not."""
    left = F.floor(width / 2).cast("int")
    return F.array(F.struct(F.substr(target, F.lit(1), left).alias("half"), F.lit(0).alias("skip")), F.struct(F.substr(target, left + 1, width).alias("half"), left.alias("skip")))


def _targets(names: Column, generic: Sequence[str], brand_only: bool) -> Column:
    """Parts of three to six letters of a video's names, each once, marked where they begin a name."""
    def part(name: Column, width: Column, at: Column) -> Column:
        target = F.substr(name, at, width)
        return F.struct(width.cast("int").alias("width"), target.alias("target"), (target == F.substring(name, 1, 3)).alias("is_brand"))

    def parts(name: Column) -> Column:
        if brand_only:
            return F.array(part(name, F.lit(3), F.lit(1)))
        of = lambda width: F.transform(F.sequence(F.lit(1), F.length(name) - width + 1), lambda at: part(name, width, at))
        return F.flatten(F.transform(F.sequence(F.lit(3), F.least(F.lit(6), F.length(name))), of))

    targets = F.array_distinct(F.flatten(F.transform(names, parts)))
    return F.filter(targets, lambda t: ~t["target"].isin(*generic)) if generic else targets


def _seeds(targets: Column) -> Column:
    halves = lambda t: F.transform(_halves(t["target"], t["width"]), lambda h: F.struct(
        h["half"].alias("half"), h["skip"].alias("skip"), t["width"].alias("width"), t["target"].alias("target"), t["is_brand"].alias("is_brand")))
    return F.flatten(F.transform(targets, halves))


def name_slips(
    captions: DataFrame, products: DataFrame, letters: str = CJK_LETTERS, generic: Sequence[str] = fixed.GENERIC_ENDINGS, brand_only: bool = False,
) -> DataFrame:
    """Places where a caption differs from part of the product name in exactly one character.

    One half of such a place is spelled as in the name. Captions meet their video's names, which are the only thing that travels; these are
    opened into halves within the caption's row and sought there in blocks. Only places with such a half are compared in full, and only
    slips leave the row. With ``brand_only`` only the names' first three characters are sought.
    """
    names = products.select("video_id", F.regexp_replace("product_name", f"[^{letters}]", "").alias("_p")).filter(F.length("_p") >= 3)
    names = names.groupBy("video_id").agg(F.collect_set("_p").alias("_names"))  # a handful
    # Sizes are not known before names are gathered, so they are sorted rather than broadcast.
    said = captions.select("video_id", "id", "text").join(names.hint("merge"), "video_id")
    said = said.select("video_id", "id", "text", _seeds(_targets(F.col("_names"), generic, brand_only)).alias("_seeds"))

    at_block = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("text")), F.lit(BLOCK)), lambda at: F.struct(at.alias("at"), F.substr(F.col("text"), at, F.lit(BLOCK + 5)).alias("block")))
    said = said.select("video_id", "id", "_seeds", F.explode(at_block).alias("b"))
    said = said.select("video_id", "id", F.col("b.at").alias("_at"), F.col("b.block").alias("_block"), F.explode(F.filter("_seeds", lambda s: F.contains(F.col("b.block"), s["half"]))).alias("s"))
    said = said.select("video_id", "id", "_at", "_block", "s.*")
    begins = F.transform(F.sequence(F.lit(1), F.length("_block") - F.length("half") + 1), lambda i: F.when(F.substr(F.col("_block"), i, F.length("half")) == F.col("half"), i - F.col("skip")))
    said = said.select("*", F.explode(F.filter(begins, lambda i: i.between(1, BLOCK) & (i + F.col("width") - 1 <= F.length("_block")))).alias("_i"))
    said = said.withColumn("source", F.substr(F.col("_block"), F.col("_i"), F.col("width"))).filter(F.col("source").rlike(f"^[{letters}]+$"))
    unlike = F.filter(F.sequence(F.lit(1), F.col("width")), lambda k: F.substr(F.col("source"), k, F.lit(1)) != F.substr(F.col("target"), k, F.lit(1)))
    slips = said.withColumn("_d", unlike).filter(F.size("_d") == 1).withColumn("diff", F.get("_d", F.lit(0)).cast("int"))
    return slips.select("video_id", "width", "diff", "id", (F.col("_at") + F.col("_i") - 1).cast("int").alias("position"), "source", F.substr(F.col("source"), F.col("diff"), F.lit(1)).alias("source_char"),
                        "target", "is_brand", F.substr(F.col("target"), F.col("diff"), F.lit(1)).alias("target_char"))


def accepted_slips(slips: DataFrame, sounds: DataFrame | None = None) -> DataFrame:
    """Slips towards the name's first three characters, or between characters that sound alike.

    ``sounds(char, sound)`` spells how characters are read; without it no two sound alike.
    """
    if sounds is None:
        return slips.filter("is_brand")
    left = sounds.select(F.col("char").alias("source_char"), F.col("sound").alias("_a"))
    right = sounds.select(F.col("char").alias("target_char"), F.col("sound").alias("_b"))
    heard = slips.join(left, "source_char", "left").join(right, "target_char", "left")
    a, b = F.coalesce("_a", "source_char"), F.coalesce("_b", "target_char")
    alike = (F.substring(a, 1, 1) == F.substring(b, 1, 1)) | (text_ratio(a, b) >= 0.48)
    return heard.filter(F.col("is_brand") | alike).drop("_a", "_b")


def correct_names(
    captions: DataFrame, products: DataFrame, sounds: DataFrame | None = None, letters: str = CJK_LETTERS,
    generic: Sequence[str] = fixed.GENERIC_ENDINGS,
) -> DataFrame:
    """Captions with corrected text and ``name_changes``, an array of ``struct(from, to)``.

    Longer matches go first, then leftmost, without overlaps. Targets of equal standing are
    taken in alphabetical order.
    """
    slips = accepted_slips(name_slips(captions, products, letters, generic, brand_only=sounds is None), sounds)
    found = slips.groupBy("video_id", "id").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("width")).alias("rank"), "position", "target", "source"))).alias("_found"))

    def pick(taken: Column, item: Column) -> Column:
        width = -item["rank"]
        clash = F.exists(taken, lambda t: (t["position"] < item["position"] + width) & (item["position"] < t["position"] - t["rank"]))
        return F.when(clash, taken).otherwise(F.array_append(taken, item))

    none = F.slice(F.col("_found"), 1, 0)
    picked = found.select("video_id", "id", F.aggregate("_found", none, pick).alias("_picks"))
    rows = captions.join(picked, ["video_id", "id"], "left")
    fixed_text = F.aggregate("_picks", F.col("text"), lambda text, p: F.overlay(text, p["target"], p["position"], -p["rank"]))
    changes = F.transform(
        F.sort_array(F.transform("_picks", lambda p: F.struct(p["position"].alias("position"), p["source"].alias("source"), p["target"].alias("target"))), asc=False),
        lambda p: F.struct(p["source"].alias("from"), p["target"].alias("to")))
    out = {"text": F.coalesce(fixed_text, F.col("text"))}
    return rows.select(*[out.get(c, F.col(c)).alias(c) for c in captions.columns],
                       F.coalesce(changes, F.array().cast("array<struct<from:string,to:string>>")).alias("name_changes"))


def correction_log(captions: DataFrame) -> DataFrame:
    """One row per correction made."""
    return captions.select("video_id", "id", F.posexplode("name_changes").alias("change", "c")).select(
        "video_id", "id", "change", F.col("c.from").alias("from"), F.col("c.to").alias("to"), F.lit("video_filename").alias("source"))
