"""The text model's place in the flow: its replies parsed and reconciled with the rules.

The model itself is the user's: a function over Arrow batches given to ``run_model``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.text import extract_json, text_ratio
from cuetable.operators.classify import classified, classify
from cuetable.operators.names import correct_names
from cuetable.plans.ordered import by_position, ordered

ITEM = "struct<id:string,text:string,label:string,score:string,highlight_words:array<string>,reason:string>"


def run_model(batches: DataFrame, reply) -> DataFrame:
    """Applies the user's model to packed batches; ``reply`` maps pandas batches to batches with ``raw`` added."""
    return batches.mapInPandas(reply, "video_id string, batch bigint, raw string")


def parse_responses(raw: DataFrame) -> DataFrame:
    """Items of raw replies ``(video_id, batch, raw)``: the longest JSON in each, a list or an object with ``items``.

    Elements are read one by one, so one that is no object or has no usable id costs itself alone; numbers may come as text. ``seq``
    orders items by batch and place.
    """
    found = raw.select("video_id", "batch", extract_json(F.col("raw")).alias("_j"))
    items = F.coalesce(
        F.when(F.startswith(F.col("_j"), F.lit("[")), F.from_json("_j", "array<string>")),
        F.from_json("_j", "struct<items:array<string>>")["items"])
    opened = found.select("video_id", "batch", F.posexplode(items).alias("at", "_e"))
    opened = opened.withColumn("_i", F.when(F.startswith(F.ltrim(F.col("_e")), F.lit("{")), F.from_json("_e", ITEM)))
    number = F.col("_i.id").try_cast("double")
    item = F.coalesce(F.col("_i.id").try_cast("bigint"), F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number)))
    return opened.select(
        "video_id", "batch", F.struct("batch", "at").alias("seq"), item.alias("id"), "_i.text", "_i.label",
        F.col("_i.score").try_cast("double").alias("score"), "_i.highlight_words", "_i.reason").filter(F.col("id").isNotNull())


def unusable_batches(raw: DataFrame) -> DataFrame:
    """``video_id, batch`` of the replies in which there is no list of items at all."""
    found = raw.select("video_id", "batch", extract_json(F.col("raw")).alias("_j"))
    listed = F.startswith(F.col("_j"), F.lit("[")) | F.from_json("_j", "struct<items:array<string>>")["items"].isNotNull()
    return found.filter(~F.coalesce(listed, F.lit(False))).select("video_id", "batch")


def own_batch(responses: DataFrame, captions: DataFrame, size: int = 18, rows: int = 50_000) -> DataFrame:
    """Responses to captions of their own batch; an id from any other batch is not an answer."""
    placed = ordered(captions.select("video_id", "id"), ["video_id"], ["id"], by_position("id", rows), number="_n")
    placed = placed.select("video_id", "id", F.floor(F.col("_n") / size).alias("batch"))
    return responses.join(placed, ["video_id", "id", "batch"], "left_semi")


def rule_path(captions: DataFrame, products: DataFrame | None = None, lexicon=None, patterns=None, sounds=None, **names) -> DataFrame:
    """Name correction and lexicon labels alone; times kept, ids renumbered."""
    rows = captions if products is None else correct_names(captions, products, sounds, **names)
    rows = classify(rows, lexicon, patterns)
    columns = rows.columns
    rows = ordered(rows, ["video_id"], ["id"], by_position("id"), number="_new")
    return rows.select(*[F.col("_new").alias("id") if c == "id" else F.col(c) for c in columns],
                       F.lit(True).alias("timestamp_locked"))


def reconcile_model(
    captions: DataFrame, responses: DataFrame, products: DataFrame | None = None, lexicon=None, patterns=None, sounds=None,
    *, ratio_guard: bool = True, batch_size: int | None = None, unusable: DataFrame | None = None, **names,
) -> DataFrame:
    """Captions with the model's text and labels where they hold up against the rules.

    ``responses(video_id, seq, id, text, label, score, highlight_words, reason)``; the last
    reply for an id wins. Rule labels other than ``other`` stand. Text that is a placeholder,
    much shorter, or a rewrite of Latin speech is refused. Times never change. A video
    without one usable reply is labelled by the rules alone, and so is one with a batch in
    ``unusable``. With ``batch_size``, responses carry ``batch`` and count in their own only.
    """
    if batch_size is not None:
        responses = own_batch(responses, captions, batch_size)
    if unusable is not None:
        responses = responses.join(unusable.select("video_id").distinct(), "video_id", "left_anti")
    payload = F.struct("text", "label", "score", "highlight_words", "reason")
    known = responses.join(captions.select("video_id", "id"), ["video_id", "id"], "left_semi")
    last = known.groupBy("video_id", "id").agg(F.max_by(payload, F.col("seq")).alias("_m"))
    answered = last.select("video_id").distinct().withColumn("_answered", F.lit(True))
    base = [c for c in captions.columns if c not in ("label", "score", "highlight_words", "reason", "selected", "timestamp_locked")]
    rows = captions.select(*base).join(last, ["video_id", "id"], "left").join(answered, "video_id", "left")

    original, offered = F.col("text"), F.btrim(F.coalesce(F.col("_m.text"), F.lit("")))
    too_short = F.length(offered) < F.greatest(F.lit(2.0), F.length(original) * 0.55)
    refused = (offered == "") | offered.isin(*fixed.PLACEHOLDERS) | too_short
    latin = original.rlike("[A-Za-z]{3}") & ~original.rlike("[\\u3400-\\u9fff]")
    rows = rows.withColumn("_said", F.when(F.col("_m").isNull() | refused, original).otherwise(offered)).withColumn("_latin", latin)
    foreign = F.col("_said").rlike("[\\u3400-\\u9fff]")
    if ratio_guard:
        checked = F.when(F.col("_latin") & (F.col("_said") != original), F.lower("_said"))
        rows = rows.withColumn("_ratio", text_ratio(F.lower("text"), F.coalesce(checked, F.lower("text"))))
        foreign = foreign | (F.col("_ratio") < 0.65)
    said = F.when(F.col("_latin") & foreign, original).otherwise(F.col("_said"))
    rows = rows.select(*[said.alias("text") if c == "text" else F.col(c) for c in base], "_m", "_answered")
    if products is not None:
        rows = correct_names(rows, products, sounds, **names)
        base = [*base, "name_changes"]
    rows = rows.withColumn("_r", classified(F.col("text"), lexicon, patterns))

    rule, text, missing = F.col("_r.label"), F.col("text"), F.col("_m").isNull()
    terms = (lexicon or {}).get("benefit") if lexicon is not None else fixed.BENEFIT_TERMS
    model_label = F.coalesce(F.col("_m.label"), F.lit("other"))
    bare = (model_label == "benefit") & ~text.rlike("[A-Za-z]")
    named = F.lit(False)
    for term in terms or ():
        named = named | F.contains(text, F.lit(term))
    model_label = F.when(bare & ~named, "other").otherwise(model_label)
    words = F.slice(F.filter(F.coalesce(F.col("_m.highlight_words"), F.array().cast("array<string>")),
                             lambda w: (w != "") & F.contains(text, w)), 1, 4)
    score = F.when(missing, 0.42).otherwise(F.coalesce(F.col("_m.score"), F.lit(0.5)))
    reason = F.when(missing, F.lit(fixed.MISSING_REASON)).otherwise(F.substring(F.coalesce(F.col("_m.reason"), F.lit("")), 1, 80))
    ruled = (rule != "other") | F.col("_answered").isNull()
    valid = model_label.isin(*fixed.LABELS)
    out = {
        "label": F.when(ruled, rule).when(valid, model_label).otherwise("other"),
        "score": F.when(F.col("_answered").isNull(), F.col("_r.score"))
        .otherwise(F.round(F.greatest(F.col("_r.score"), F.when(ruled | valid, score).otherwise(0.0)), 2)),
        "highlight_words": F.when(F.col("_answered").isNull(), F.col("_r.highlight_words"))
        .when(ruled, F.slice(F.array_distinct(F.concat(F.col("_r.highlight_words"), words)), 1, 4)).otherwise(F.array_distinct(words)),
        "reason": F.when(ruled, F.col("_r.reason")).otherwise(reason),
    }
    return rows.select(*base, *[c.alias(n) for n, c in out.items()], F.lit(True).alias("selected"), F.lit(True).alias("timestamp_locked"))
