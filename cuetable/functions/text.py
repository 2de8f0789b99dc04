"""Text expressions: cleaning, limits, signals, escaping, similarity."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator, Mapping, Sequence
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from cuetable import fixed
from cuetable.plans.shipping import ship

CJK = "\\u3400-\\u9fff\\u3040-\\u30ff"
WORD_CHAR = f"[\\p{{L}}\\p{{N}}&&[^{CJK}]]"


def char_class(chars: str) -> str:
    """Regex class of exactly these characters."""
    return "[" + "".join("\\" + c if c in "\\[]^-&" else c for c in chars) + "]"


PUNCT_CLASS = char_class(fixed.PUNCTUATION)


def normalize_text(text: Column) -> Column:
    """Tags out, whitespace collapsed, no spaces between CJK characters or before a mark."""
    text = F.regexp_replace(text.cast("string"), fixed.TAG_PATTERN, "")
    text = F.btrim(F.regexp_replace(text, "(?U)\\s+", " "))
    text = F.regexp_replace(text, f"(?<=[{CJK}]) +(?=[{CJK}])", "")
    return F.regexp_replace(text, f" +({char_class(fixed.CLOSING_MARKS)})", "$1")


def clean_token(token: Column) -> Column:
    """A recogniser token with tags dropped and sub-word markers turned into spaces."""
    token = F.regexp_replace(token, fixed.TAG_PATTERN, "")
    return F.regexp_replace(F.translate(token, fixed.SUBWORD_MARKS, "  "), "(?U)\\s+", " ")


def content_chars(text: Column) -> Column:
    """The text without punctuation and spaces."""
    return F.regexp_replace(text, PUNCT_CLASS, "")


def text_limit(text: Column, cjk_limit: int = 13) -> Column:
    """Caption length limit: longer when Latin letters outnumber CJK characters."""
    latin = F.regexp_count(text, F.lit("[A-Za-z]"))
    cjk = F.regexp_count(text, F.lit(f"[{CJK}]"))
    return F.when(latin > cjk, F.lit(max(42, cjk_limit))).otherwise(F.lit(cjk_limit))


def whole_word(pattern: str) -> str:
    return f"(?iU)\\b(?:{pattern})\\b"


def signals(text: Column, patterns: Mapping[str, str] | None = None) -> Column:
    """Map from signal kind to every match, in text order and original case."""
    patterns = fixed.SIGNAL_PATTERNS if patterns is None else patterns
    pairs = []
    for kind, pattern in patterns.items():
        pairs += [F.lit(kind), signal_matches(text, pattern)]
    return F.create_map(*pairs)


def signal_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(whole_word(pattern)), F.lit(0))


def has_signal(text: Column, pattern: str) -> Column:
    return text.rlike(whole_word(pattern))


def lexicon_hits(text: Column, terms: Sequence[str]) -> Column:
    """The terms the text contains, in lexicon order. For a short list; see ``lexicon_join``."""
    if not terms:
        return F.array().cast("array<string>")
    return F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(text, t))


def ass_time(ms: Column) -> Column:
    """H:MM:SS.cc; half centiseconds round to even, negative times to zero."""
    cs = F.greatest(F.lit(0), F.bround(ms / F.lit(10), 0).cast("bigint"))
    return F.format_string("%d:%02d:%02d.%02d", F.floor(cs / 360000), F.floor(cs / 6000) % 60,
                           F.floor(cs / 100) % 60, cs % 100)


def ass_escape(text: Column) -> Column:
    for plain, escaped in (("\\", "\\\\"), ("{", "\\{"), ("}", "\\}"), ("\n", "\\N")):
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def ass_color(html: Column) -> Column:
    """``#RRGGBB`` as ``&H00BBGGRR``; missing digits count as F."""
    digits = F.substring(F.rpad(F.regexp_replace(html, "[^0-9A-Fa-f]", ""), 6, "F"), 1, 6)
    return F.upper(F.concat(F.lit("&H00"), F.substring(digits, 5, 2), F.substring(digits, 3, 2),
                            F.substring(digits, 1, 2)))


def highlight_markup(text: Column, words: Column, normal: Column, accent: Column) -> Column:
    """Escaped text with every highlight word recoloured, longest word first."""
    marks = F.array_distinct(F.transform(F.filter(words, lambda w: F.btrim(w) != ""), lambda w: ass_escape(F.btrim(w))))
    longest_first = F.array_sort(
        marks, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a))
        .when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.aggregate(
        longest_first, ass_escape(text),
        lambda acc, w: F.replace(acc, w, F.concat(F.lit("{\\c"), accent, F.lit("}"), w, F.lit("{\\c"), normal, F.lit("}"))))


def script_language(text: Column, tag: Column) -> Column:
    """The recogniser's tag, unless the text is plainly Latin."""
    plain = text.rlike("[A-Za-z]{2}") & ~text.rlike(f"[{CJK}\\uac00-\\ud7af]")
    return F.when(plain, F.lit("en")).otherwise(F.regexp_replace(F.coalesce(tag, F.lit("")), "<\\||\\|>", ""))


def fallback_language(requested: Column) -> Column:
    """Language forced on the second recogniser; null lets it detect."""
    return F.when(requested == "yue", "zh").when(requested.isin("zh", "en", "ja", "ko"), requested)


def wants_punctuation(text: Column) -> Column:
    """Whether the Chinese punctuation model applies: text with no Latin, Hangul or kana."""
    return (text != "") & ~text.rlike("[A-Za-z\\uac00-\\ud7af\\u3040-\\u30ff]")


def is_word_char(char: Column) -> Column:
    return F.coalesce(char.rlike(f"^{WORD_CHAR}"), F.lit(False))


def word_continues(left: Column, right: Column, separator: Column) -> Column:
    """Whether two characters with this between them belong to one word."""
    joined = separator.isin("", "'", "’", "-") | ((separator == ".") & left.rlike("^\\p{N}") & right.rlike("^\\p{N}"))
    return F.coalesce(is_word_char(left) & is_word_char(right) & joined, F.lit(False))


def incomplete_ending(text: Column, connectives: Sequence[str] | None = None) -> Column:
    """Whether the text, without closing marks, stops on a connective."""
    words = "|".join(re.escape(w) for w in (fixed.CONNECTIVES if connectives is None else connectives))
    return F.regexp_replace(text, "[，。！？；,.!?; ]+$", "").rlike(f"(?:{words})$")


def highlight_key(name: Column) -> Column:
    """Lower-cased letters and digits only."""
    return F.regexp_replace(F.lower(name), "[^\\p{L}\\p{N}]", "")


def distinct_chars(key: Column) -> Column:
    return F.array_distinct(F.filter(F.split(key, ""), lambda c: c != ""))


def name_score(query_key: Column, name_key: Column) -> Column:
    """Share of the query's distinct characters in the name, plus one if either holds the other."""
    q, n = distinct_chars(query_key), distinct_chars(name_key)
    share = F.size(F.array_intersect(q, n)) / F.greatest(F.size(q), F.lit(1))
    holds = F.contains(name_key, query_key) | F.contains(query_key, name_key)
    return share + F.when(holds, 1.0).otherwise(0.0)


def text_ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity of two strings, in [0, 1]."""
    ship(SparkSession.getActiveSession())
    return _text_ratio(a, b)


@F.pandas_udf(DoubleType())
def _text_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])


def _longest_json(raw: str) -> str | None:
    decoder, best, best_length, at = json.JSONDecoder(), None, 0, 0
    while (found := re.compile(r"[\[{]").search(raw, at)) is not None:
        at = found.start()
        try:
            value, stop = decoder.raw_decode(raw, at)
        except (json.JSONDecodeError, RecursionError):
            at += 1
            continue
        if stop - at > best_length:
            best, best_length = value, stop - at
        at = stop  # anything inside the decoded value is shorter
    return None if best is None else json.dumps(best, ensure_ascii=False)


def extract_json(raw: Column) -> Column:
    """The longest JSON object or array inside noisy model output, re-serialised."""
    ship(SparkSession.getActiveSession())
    return _extract_json(raw)


@F.pandas_udf(StringType())
def _extract_json(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for raw in batches:
        yield raw.map(lambda text: _longest_json(text) if isinstance(text, str) else None)
