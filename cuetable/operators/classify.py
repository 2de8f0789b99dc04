"""Labels, effects and lexicon matches of captions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuetable import fixed
from cuetable.functions.grams import contained_terms
from cuetable.functions.text import has_signal, lexicon_hits, signal_matches
from cuetable.plans.folders import cut_lineage
from cuetable.plans.ordered import by_position, ordered
from cuetable.plans.sizes import broadcast_if_small

DEFAULT_LEXICON = {"benefit": fixed.BENEFIT_TERMS, "selling_point": fixed.SELLING_TERMS, "remove": fixed.REMOVE_TERMS}
LABEL_COLUMNS = ("label", "score", "highlight_words", "reason")


def classified(
    text: Column, lexicon: Mapping[str, Sequence[str]] | None = None, patterns: Mapping[str, str] | None = None,
) -> Column:
    """``struct(label, score, highlight_words, reason)`` of a caption text.

    Removal needs a removal hit and nothing else; otherwise benefit wins over selling point.
    """
    lexicon = DEFAULT_LEXICON if lexicon is None else lexicon
    patterns = fixed.SIGNAL_PATTERNS if patterns is None else patterns

    def hits(label: str) -> Column:
        words = lexicon_hits(text, lexicon.get(label, ()))
        return F.concat(words, signal_matches(text, patterns[label])) if label in patterns else words

    def scored(label: str, base: float, step: float, top: float, n: Column, words: Column) -> Column:
        score = F.least(F.lit(top), F.lit(base) + F.lit(step) * n)
        return F.struct(F.lit(label).alias("label"), score.alias("score"), F.slice(words, 1, 4).alias("highlight_words"),
                        F.lit(fixed.LABEL_REASONS[label]).alias("reason"))

    def decide(benefit: Column, selling: Column, remove: Column) -> Column:
        nothing = F.struct(F.lit("other").alias("label"), F.lit(0.42).alias("score"),
                           F.array().cast("array<string>").alias("highlight_words"), F.lit(fixed.LABEL_REASONS["other"]).alias("reason"))
        return (F.when((F.size(remove) > 0) & (F.size(benefit) == 0) & (F.size(selling) == 0),
                       scored("remove", 0.78, 0.02, 0.96, F.size(remove), remove))
                .when(F.size(benefit) > 0, scored("benefit", 0.72, 0.04, 0.96, F.size(benefit), F.concat(benefit, selling)))
                .when(F.size(selling) > 0, scored("selling_point", 0.68, 0.04, 0.94, F.size(selling), selling))
                .otherwise(nothing))

    # One pass over a single-element array names the three hit lists once for the whole cascade.
    found = F.array(F.struct(hits("benefit").alias("b"), hits("selling_point").alias("s"), hits("remove").alias("r")))
    return F.element_at(F.transform(found, lambda f: decide(f["b"], f["s"], f["r"])), 1)


def classify(
    captions: DataFrame, lexicon: Mapping[str, Sequence[str]] | None = None, patterns: Mapping[str, str] | None = None,
) -> DataFrame:
    """Captions with label, score, highlight words and reason; other columns and times kept."""
    rest = [c for c in captions.columns if c not in LABEL_COLUMNS]
    return captions.select(*rest, classified(F.col("text"), lexicon, patterns).alias("_c")).select(*rest, "_c.*")


def assigned_effect(
    text: Column, label: Column, index: Column, patterns: Mapping[str, str] | None = None, cues: Mapping[str, str] | None = None,
) -> Column:
    """``struct(type, reason)`` of the effect for a caption at this position of its video."""
    patterns = fixed.SIGNAL_PATTERNS if patterns is None else patterns
    cues = fixed.CUE_PATTERNS if cues is None else cues
    text = F.coalesce(text, F.lit(""))
    even = index % 2 == 0

    def effect(kind: Column | str, reason: str) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("type"), F.lit(fixed.EFFECT_REASONS[reason]).alias("reason"))

    def cue(kind: str, signal: str | None = None) -> Column:
        return has_signal(text, patterns[signal or kind]) | text.rlike(cues[kind])

    def turn(first: str, second: str) -> Column:
        return F.when(even, first).otherwise(second)

    cycle = F.element_at(F.array(*[F.lit(e) for e in fixed.FALLBACK_EFFECTS]), (index % len(fixed.FALLBACK_EFFECTS) + 1).cast("int"))
    return (F.when(cue("price"), effect(F.when(text.rlike(cues["cash"]), "cash").otherwise("coin"), "price"))
            .when(cue("action"), effect("click", "action"))
            .when(cue("detail", "selling_point"), effect("chime", "detail"))
            .when(cue("benefit"), effect(turn("shine", "ding"), "effect"))
            .when(cue("complete"), effect("success", "complete"))
            .when(cue("surprise"), effect("surprise", "surprise"))
            .when(label == "selling_point", effect(turn("shine", "chime"), "point"))
            .when(label == "benefit", effect(turn("pop", "ding"), "effect"))
            .otherwise(effect(cycle, "rhythm")))


def assign_effect(captions: DataFrame, patterns=None, cues=None) -> DataFrame:
    """Captions ``(…, text, label, index)`` with the effect type and its reason."""
    made = assigned_effect(F.col("text"), F.col("label"), F.col("index"), patterns, cues)
    return captions.withColumn("_e", made).select(*captions.columns, F.col("_e.type"), F.col("_e.reason").alias("effect_reason"))


WORD_ANCHOR = 8


def lexicon_join(captions: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Terms contained in each caption, per label and in lexicon order, for a lexicon of any size.

    A term without a space is contained in a caption if it is in one of its words, the stretches between spaces. Such terms are looked for in
    every different word once, and a word's terms reach the captions that hold it as one list a label; a term with a space meets the texts
    themselves. See ``contained_terms``.
    """
    entries = cut_lineage(lexicon.select("term", "label", "ord").distinct(), "lexicon")  # read by several passes
    spaced = F.contains("term", F.lit(" "))
    said = captions.select("video_id", "id", F.explode(F.array_distinct(F.split("text", " "))).alias("word")).filter("word <> ''")
    words = cut_lineage(said.select("word").distinct().withColumn("text", F.col("word")), "caption-words")
    inside = contained_terms(words, ["word"], "text", entries.filter(~spaced), WORD_ANCHOR).join(entries.hint("merge"), "term")
    lists = inside.groupBy("word", "label").agg(F.collect_list(F.struct("ord", "term")).alias("_t"))
    found = said.join(lists.hint("merge"), "word").select("video_id", "id", "label", "_t")  # lists are longer than their estimate
    wide = entries.filter(spaced)
    if not wide.isEmpty():
        across = contained_terms(captions, ["video_id", "id"], "text", wide).join(broadcast_if_small(wide), "term")
        found = found.unionByName(across.select("video_id", "id", "label", F.array(F.struct("ord", "term")).alias("_t")))
    # Equal ones stand beside each other once sorted; array_distinct compares structs all with all.
    once = lambda all_: F.filter(all_, lambda t, i: (i == 0) | ~t.eqNullSafe(F.get(all_, i - 1)))
    found = found.groupBy("video_id", "id", "label").agg(F.sort_array(F.flatten(F.collect_list("_t"))).alias("_t"))
    return found.select("video_id", "id", "label", F.transform(F.element_at(F.transform(F.array("_t"), once), 1), lambda t: t["term"]).alias("terms"))


def pack_batches(captions: DataFrame, size: int = 18, rows: int = 50_000) -> DataFrame:
    """Consecutive groups of captions as model input: batch number, first id and a JSON payload."""
    numbered = ordered(captions.select("video_id", "id", "text"), ["video_id"], ["id"], by_position("id", rows), number="_n")
    packed = (numbered.groupBy("video_id", F.floor(F.col("_n") / size).alias("batch"))
              .agg(F.sort_array(F.collect_list(F.struct("id", "text"))).alias("items")))
    return packed.select("video_id", "batch", F.size("items").alias("n_items"), F.to_json("items").alias("payload"))


def hook_end(captions: DataFrame, videos: DataFrame | None = None) -> DataFrame:
    """End of each video's hook: its first labelled caption of 3 to 10 s, held to 3-10 s, else 8 s."""
    length = F.col("end_ms") - F.col("start_ms")
    fits = F.col("label").isin(*fixed.PRIMARY) & length.between(3000, 10000)
    ends = captions.groupBy("video_id").agg(F.min_by(F.when(fits, F.col("end_ms")), F.when(fits, F.col("id"))).alias("_end"))
    if videos is not None:
        ends = videos.select("video_id").join(ends, "video_id", "left")
    held = F.greatest(F.lit(3000), F.least(F.lit(10000), F.col("_end")))
    return ends.select("video_id", F.when(F.col("_end").isNull(), 8000).otherwise(held).cast("bigint").alias("hook_end_ms"))
