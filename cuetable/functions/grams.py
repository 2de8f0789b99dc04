"""Substrings of texts as rows, the basis of equi-joins on contained terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable.plans.folders import cut_lineage
from cuetable.plans.sizes import broadcast_if_small

BLOCK = 256


def gram_rows(rows: DataFrame, text: str, widths: Column, longest: Column) -> DataFrame:
    """``rows`` without ``text``, once per substring: ``position`` (1-based), ``width``, ``gram``.

    Long texts are opened in blocks first, overlapping by the longest width less one, so
    the work stays linear in the text.
    """
    kept = [c for c in rows.columns if c != text]
    blocks = F.transform(
        F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(BLOCK)),
        lambda at: F.struct(at.alias("at"), F.substr(F.col(text), at, longest + (BLOCK - 1)).alias("block")))
    opened = rows.select(*kept, widths.alias("_widths"), F.explode(blocks).alias("_b")).select(
        *kept, F.explode("_widths").alias("width"), F.col("_b.at").alias("_at"), F.col("_b.block").alias("_block"))
    opened = opened.filter(F.col("width") <= F.length("_block"))
    starts = F.sequence(F.lit(1), F.least(F.lit(BLOCK), F.length("_block") - F.col("width") + 1))
    opened = opened.select(*kept, F.col("width").cast("int").alias("width"), "_at", "_block", F.explode(starts).alias("_i"))
    return opened.select(*kept, (F.col("_at") + F.col("_i") - 1).cast("int").alias("position"), "width",
                         F.substr(F.col("_block"), F.col("_i"), F.col("width")).alias("gram"))


ANCHOR = 3


def _text_grams(texts: DataFrame, ids: list[str], text: str, widths: list[int]) -> DataFrame:
    """``ids, gram``: the distinct substrings of the given widths of each block of a text, as many rows a width as the text is long at most."""
    blocks = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text)), F.lit(BLOCK)), lambda at: F.substr(F.col(text), at, F.lit(BLOCK + max(widths) - 1)))
    opened = texts.select(*ids, F.explode(blocks).alias("_block"))

    def of(width: int) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("_block") - (width - 1)))
        return F.transform(starts, lambda i: F.substr(F.col("_block"), i, F.lit(width)))

    grams = F.flatten(F.array(*map(of, widths)))
    return opened.select(*ids, F.explode(F.array_distinct(grams)).alias("gram"))


def term_places(texts: DataFrame, ids: list[str], text: str, terms: DataFrame, anchor: int = ANCHOR) -> DataFrame | None:
    """``ids, term`` for every text that holds the rarest gram of a term, once; None if there is no term. Terms up to ``anchor`` long are their own gram."""
    terms = terms.select("term").filter(F.length("term") > 0).distinct()
    width = F.least(F.length("term"), F.lit(anchor))
    parts = terms.select("term", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("term") - width + 1), lambda i: F.substr(F.col("term"), i, width)))).alias("gram"))
    widths = sorted(r[0] for r in parts.select(F.length("gram")).distinct().collect())  # as many as ``anchor`` at most
    if not widths:
        return None
    asked = broadcast_if_small(parts.select("gram").distinct())
    held = _text_grams(texts.select(*ids, text), ids, text, widths).join(asked, "gram")
    rarity = held.groupBy("gram").agg(F.count(F.lit(1)).alias("_texts"))
    rarest = parts.join(rarity.hint("merge"), "gram", "left").groupBy("term").agg(F.min(F.struct(F.coalesce("_texts", F.lit(0)).alias("n"), "gram")).alias("_r"))
    anchors = broadcast_if_small(cut_lineage(rarest.filter("_r.n > 0").select("term", F.col("_r.gram").alias("gram")), "anchors"))
    return held.join(anchors, "gram").select(*ids, "term").distinct()


def contained_terms(texts: DataFrame, ids: list[str], text: str, terms: DataFrame, anchor: int = ANCHOR) -> DataFrame:
    """``ids, term`` for every text that contains a term of ``terms``, once; an empty term is none.

    A term is looked for where its rarest gram stands, and compared with the text itself there. Grams that no term has never leave the text.
    """
    found = term_places(texts, ids, text, terms, anchor)
    if found is None:
        return texts.select(*ids, F.lit("").alias("term")).limit(0)
    return found.join(texts.select(*ids, text).hint("merge"), ids).filter(F.contains(F.col(text), F.col("term"))).select(*ids, "term").distinct()
