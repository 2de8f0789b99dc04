"""Language identification of spans.

A word's script, found by ranges of code points, leaves the languages that are written in it. Each of them scores the word by the
log-probabilities of its letter triples, and a Viterbi pass over the words of a text, with a penalty for every switch, labels spans of
one language. The triples are counted on Spark over a bounded sample of labelled texts.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import slices, table, texts, tidied
from cuetable.plans.shipping import ship

#: Labelled texts the model may be fitted on; counted whole where there are fewer.
SAMPLE_ROWS = 30_000
BUCKETS, SWITCH, LEAST_SHARE, SMOOTH = 1 << 16, 12.0, 0.001, 0.5
UNKNOWN = "und"
#: First code point of each script's range; what stands before another range ends there.
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"),
           (0x0700, "other"), (0x0900, "indic"), (0x0E00, "thai"), (0x0E80, "other"), (0x1100, "hangul"), (0x1200, "other"), (0x1E00, "latin"),
           (0x1F00, "greek"), (0x2000, "other"), (0x3040, "kana"), (0x3100, "other"), (0x3400, "han"), (0xA000, "other"), (0xAC00, "hangul"),
           (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "other"), (0x20000, "han"), (0x30000, "other"))
NAMES = sorted({name for _, name in SCRIPTS})


class Letters:
    """Lower-cased letters, word bounds, scripts and triples of texts laid end to end."""

    def __init__(self, values: list[str]):
        low = np.arange(0x110000, dtype=np.uint32) if not hasattr(Letters, "_low") else None
        if low is not None:
            letter = np.zeros(0x110000, bool)
            for c in range(0x30000):
                kind = unicodedata.category(chr(c))
                letter[c] = kind[0] == "L"
                if kind in ("Lu", "Lt") and len(chr(c).lower()) == 1:
                    low[c] = ord(chr(c).lower())
            Letters._low, Letters._letter = low, letter
        raw = np.frombuffer("\n".join([*values, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.lengths = np.fromiter(map(len, values), np.int64, len(values))
        self.at = np.append(0, np.cumsum(self.lengths + 1))
        is_letter = Letters._letter[raw]
        before = np.append(False, is_letter[:-1])
        self.start = np.flatnonzero(is_letter & ~before)
        self.end = np.flatnonzero(~is_letter & before)  # every text is followed by a line feed
        self.words = np.diff(np.searchsorted(self.start, self.at))
        low = np.where(is_letter, Letters._low[raw], np.uint32(32))
        code = low * np.uint32(0x9E3779B1)
        code[1:] ^= low[:-1] * np.uint32(0x85EBCA77)
        code[2:] ^= low[:-2] * np.uint32(0xC2B2AE3D)
        code ^= code >> np.uint32(15)
        self.code = (code * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)  # 16 bits, as BUCKETS has
        starts = np.array([s for s, _ in SCRIPTS], np.uint32)
        name = np.array([NAMES.index(n) for _, n in SCRIPTS])
        self.script = name[np.searchsorted(starts, raw[self.start], side="right") - 1]

    def sums(self, scores: np.ndarray) -> np.ndarray:
        """``scores`` of every word's triples, the one ending in its closing blank with them, added up."""
        if not len(self.start):
            return np.zeros(0)
        total = np.append(0.0, np.cumsum(scores[self.code], dtype=np.float64))
        return total[self.end + 1] - total[self.start]


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> dict:
    """Model from rows with ``doc_id, text, lang``: languages, log-probabilities of triples, languages by script.

    At most about ``sample_rows`` rows, chosen by a hash of doc_id, are read. A language is one of the distinct values of ``lang``;
    the tables gathered are languages x (triples + scripts), whatever the rows.
    """
    ship(labelled.sparkSession)
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = labelled.select("lang").count()
    if rows > sample_rows:
        labelled = labelled.filter(F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * sample_rows / rows))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            for rows in slices(batch):
                by_lang: dict[str, list[str]] = {}
                for lang, text in zip(rows.column("lang").to_pylist(), rows.column("text").to_pylist(), strict=True):
                    by_lang.setdefault(lang, []).append(text)
                for lang, values in by_lang.items():
                    x = Letters(values)
                    inside = np.zeros(len(x.code) + 1, np.int8)
                    np.add.at(inside, x.start, 1)
                    np.add.at(inside, x.end + 1, -1)
                    n = held.setdefault(lang, np.zeros(BUCKETS + len(NAMES), np.int64))
                    n[:BUCKETS] += np.bincount(x.code[np.cumsum(inside)[:-1] > 0], minlength=BUCKETS)
                    n[BUCKETS:] += np.bincount(x.script, x.end - x.start, len(NAMES)).astype(np.int64)
        for lang, n in held.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(n[some])], ["lang", "cell", "n"])

    counts = labelled.select("lang", "text").mapInArrow(tidied(count), "lang string, cell bigint, n bigint").groupBy("lang", "cell").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(counts["lang"].unique().tolist())
    cells = np.zeros((len(languages), BUCKETS + len(NAMES)))
    cells[[languages.index(x) for x in counts["lang"]], counts["cell"].to_numpy(np.int64)] = counts["n"]
    triples, scripts = cells[:, :BUCKETS] + SMOOTH, cells[:, BUCKETS:]
    return {"languages": languages, "logs": np.log(triples / triples.sum(1, keepdims=True)).astype(np.float32),
            "written": scripts >= LEAST_SHARE * np.maximum(scripts.sum(1, keepdims=True), 1)}


def viterbi(scores: np.ndarray, words: np.ndarray, switch: float) -> np.ndarray:
    """Language of every word; ``scores`` of the texts' words lie end to end, ``words`` counts those of each text.

    All texts of the call go forward together, longest first, a word at a time.
    """
    first = np.cumsum(words) - words
    order = np.argsort(-words, kind="stable")
    first, left = first[order], words[order]
    steps = int(left[0]) if len(left) else 0
    active = np.searchsorted(-left, -np.arange(1, steps + 1), side="right")  # texts with a word at each step
    stays, bests = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int32)
    value = np.zeros((len(left), scores.shape[1]))
    for t in range(steps):
        a = active[t]
        here, v = first[:a] + t, value[:a]
        best = v.argmax(1)
        jump = v[np.arange(a), best][:, None] - switch
        stay = v >= jump
        value[:a] = np.where(stay, v, jump) + scores[here]
        stays[here], bests[here] = stay, best
    out = np.zeros(len(scores), np.int32)
    state = np.zeros(len(left), np.int64)
    for t in range(steps - 1, -1, -1):
        a = active[t]
        ended = active[t + 1] if t + 1 < steps else 0
        state[ended:a] = value[ended:a].argmax(1)
        here = first[:a] + t
        out[here] = state[:a]
        state[:a] = np.where(stays[here, state[:a]], state[:a], bests[here])
    return out


def labeller(model: dict, switch: float = SWITCH):
    """A function from texts to their languages, scores and spans."""
    languages, logs, in_script = model["languages"], model["logs"], model["written"]

    def label_texts(values: list[str]) -> tuple[list[str], np.ndarray, list[list[dict]]]:
        x, n = Letters(values), len(values)
        pred, score, spans = [UNKNOWN] * n, np.zeros(n), [[] for _ in range(n)]
        if languages and len(x.start):
            can = in_script[:, x.script].T
            scores = np.where(can, np.stack([x.sums(row) for row in logs], 1), -1e6)
            scores[~can.any(1)] = 0
            label = viterbi(scores, x.words, switch)
            row = np.repeat(np.arange(n), x.words)
            letters = np.bincount(row * len(languages) + label, x.end - x.start, n * len(languages)).reshape(n, -1)
            total = letters.sum(1)
            score = letters.max(1) / np.maximum(total, 1)
            pred = [languages[k] if t else UNKNOWN for k, t in zip(letters.argmax(1), total, strict=True)]
            head = np.flatnonzero(np.append(True, (row[1:] != row[:-1]) | (label[1:] != label[:-1])))
            tail = np.append(head[1:], len(row)) - 1
            own = row[head]
            for r, a, b, k in zip(own.tolist(), (x.start[head] - x.at[own]).tolist(), (x.end[tail] - x.at[own]).tolist(), label[head].tolist(), strict=True):
                spans[r].append({"start": a, "end": b, "lang": languages[k]})
        return pred, score, spans

    return label_texts


def identify(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """``doc_id, lang_pred, score, spans`` for every row of ``docs``, of ``doc_id`` and ``text`` alone.

    ``spans`` are ``(start, end, lang)`` in code points, ends exclusive, one after the other over all words. ``lang_pred`` has most
    letters, ties going to the language first in order, and ``score`` is its share of them. Texts that are null or without a letter, and all
    texts under a model without languages, are ``und`` with score 0 and no span. Words in a script that no language uses follow
    their neighbours. Repeated rows and null ids are answered one by one.
    """
    label_texts = labeller(model, switch)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in slices(batch):
                pred, score, spans = label_texts(rows.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(spans, kind)],
                                                 ["doc_id", "lang_pred", "score", "spans"])

    return texts(docs).mapInArrow(tidied(run), "doc_id bigint, lang_pred string, score double, spans array<struct<start:bigint,end:bigint,lang:string>>")


def with_known_language(docs: DataFrame, model: dict, switch: float = SWITCH) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is in a language; others have no letter to tell it by.

    A model without languages can reject nothing.
    """
    if not model["languages"]:
        return docs
    ship(docs.sparkSession)
    label_texts = labeller(model, switch)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            filled = pa.RecordBatch.from_arrays([batch.column("text").fill_null("")], ["text"])
            at = 0
            for rows in slices(filled):
                known = pa.array([p != UNKNOWN for p in label_texts(rows.column("text").to_pylist())[0]], pa.bool_())
                yield batch.slice(at, rows.num_rows).filter(known)
                at += rows.num_rows

    return docs.mapInArrow(tidied(run), docs.schema)


def held_out() -> Column:
    """Whether the checksum of the id's digits leaves two when divided by four; null ids are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame) -> DataFrame:
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "text", "lang")


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(training_rows(docs)))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


QUERIES = {"op7_language": op7_language}
ORACLES: dict[str, str] = {}
