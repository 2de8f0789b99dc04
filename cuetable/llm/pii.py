"""Personal data by fixed patterns and by contexts learned from them.

The fixed patterns give the seeds. The two words left of a seed are a lexical pattern of its kind. Strings that look like an
identifier without meeting a fixed pattern are candidates; they and the seeds are the instances of a bipartite graph with the
patterns. Spark scores it in rounds: a pattern is as good as the share of its instances believed in, an instance as good as the
patterns it stands in taken together. Patterns that end up good, with enough different believed instances, mark their candidates; what one
pattern found is an instance that supports the next.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuetable.llm.common import slices, table, texts, tidied, written
from cuetable.plans.sizes import broadcast_if_small

#: Fixed kinds, in the order of output, and fixed patterns, written so that no text takes more than linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = re.compile(r"(?<![A-Za-z0-9])[0-9](?:[ ().:-]{0,2}[0-9]){6,}+")
QUAD = re.compile(r"(?<![A-Za-z0-9])[0-9]++(?:\.[0-9]++){3}")
ADDRESS = re.compile(r"[^\s@]++")
WORD = re.compile(r"[^\W\d_]+")
CONTEXT, ROUNDS, SUPPORT, CONFIDENT, DAMPING = 200, 3, 3, 0.8, 0.5


def luhn(digits: str) -> bool:
    total = 0
    for at, c in enumerate(reversed(digits)):
        value = int(c) * (1 + at % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            yield start, m.end()
            floor = m.end()
        at = text.find("@", at + 1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` by start, then kind."""
    out = [(a, 0, b) for a, b in emails(text)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) < 256 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return sorted(out)


def candidates(text: str, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """What looks like an identifier of a kind outside the base spans."""
    found = [(m.start(), 1, m.end()) for m in QUAD.finditer(text)]
    for m in NUMBER.finditer(text):
        n = sum(c.isdigit() for c in m[0])
        kinds = [] if QUAD.fullmatch(m[0]) else [2] * (12 <= n <= 19) + [3] * (7 <= n <= 15)
        found += [(m.start(), k, m.end()) for k in kinds]
    at = text.find("@")
    while at >= 0:
        left = at
        while left and text[left - 1] != "@" and not text[left - 1].isspace():
            left -= 1
        if left < at and (right := ADDRESS.match(text, at + 1)):
            found.append((left, 0, right.end()))
        at = text.find("@", at + 1)
    free, k = [], 0
    for c in sorted(found):
        while k < len(spans) and spans[k][0] < c[2] and spans[k][2] <= c[0]:
            k += 1
        if not any(a < c[2] and b > c[0] for a, _, b in spans[max(0, k - 4):k + 8]):
            free.append(c)
    return free


def left_words(text: str, start: int) -> str:
    return " ".join(WORD.findall(text[max(0, start - CONTEXT):start].lower())[-2:])


def render(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame) -> DataFrame:
    """``row, doc_id, counts, base, base_sha256, marks``; marks are seeds and candidates with their left words."""
    mark = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("words", pa.string()), ("value", pa.string()), ("seed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            for rows in slices(batch):
                out: list[list] = [[], [], [], [], []]
                for text in rows.column("text").to_pylist():
                    spans = base_spans(text)
                    listed = [(*s, True) for s in spans] + [(*s, False) for s in candidates(text, spans)]
                    marks = [{"start": a, "kind": k, "end": b, "words": left_words(text, a), "value": text[a:b].lower(), "seed": s} for a, k, b, s in listed]
                    shown = render(spans)
                    for column, value in zip(out, (row, [sum(s[1] == k for s in spans) for k in range(4)], shown, hashlib.sha256(shown.encode()).hexdigest(), marks), strict=True):
                        column.append(value)
                    row += 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), rows.column("doc_id"), pa.array(out[1], pa.list_(pa.int64())), pa.array(out[2], pa.string()), pa.array(out[3], pa.string()),
                     pa.array(out[4], pa.list_(mark))], ["row", "doc_id", "counts", "base", "base_sha256", "marks"])

    return texts(docs).mapInArrow(tidied(run), "row bigint, doc_id bigint, counts array<bigint>, base string, base_sha256 string, "
                                       "marks array<struct<start:bigint,kind:int,end:bigint,words:string,value:string,seed:boolean>>")


def good_patterns(marks: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """``words, kind, confidence`` of the patterns to be trusted, from ``words, kind, value, seed``.

    Each round trusts the patterns that enough different believed instances support and whose instances are believed in to ``confident``; trusted
    patterns alone lend belief, so an instance that one of them found supports further patterns in the next round, and what none found stays unbelieved.
    """
    edges = written(marks.filter("words <> ''").groupBy("words", "kind", "value").agg(F.max("seed").alias("seed")), "edges")
    instances = written(edges.groupBy("words").agg(F.count(F.lit(1)).alias("instances")), "instances")
    belief = edges.filter("seed").select("kind", "value").distinct().withColumn("belief", F.lit(1.0))
    trusted = None
    for _ in range(rounds):
        believed = edges.join(belief, ["kind", "value"])
        patterns = believed.groupBy("words", "kind").agg(F.count_if(F.col("belief") >= confident).alias("support"), F.sum("belief").alias("belief"))
        patterns = patterns.filter(F.col("support") >= support).join(instances, "words").select("words", "kind", (F.col("belief") / (F.col("instances") + DAMPING)).alias("confidence"))
        trusted = written(patterns.filter(F.col("confidence") >= confident), "patterns")
        doubt = F.exp(F.sum(F.log1p(-F.least("confidence", F.lit(1 - 1e-9)))))
        belief = edges.join(trusted, ["words", "kind"]).groupBy("kind", "value").agg((1 - doubt).alias("belief"))
        seeds = edges.filter("seed").select("kind", "value").distinct().withColumn("belief", F.lit(1.0))
        belief = written(belief.unionByName(seeds).groupBy("kind", "value").agg(F.max("belief").alias("belief")), "belief")
    return trusted


def find_personal_data(docs: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, confident: float = CONFIDENT) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found`` for every row of ``docs``.

    Counts and ``base_sha256`` are of the base spans, ``spans`` has the found ones too. A pattern needs ``support`` different instances believed in, seeds or found.
    Null and empty texts have no span; repeated rows and null ids are answered one by one; other columns are not read. Contexts are
    the last two words within 200 characters before an instance; counts of patterns and instances cover all documents.
    """
    rows = written(scan(docs), "spans")
    marks = rows.select("row", F.explode("marks").alias("m")).select("row", "m.*")
    good = written(good_patterns(marks, rounds, support, confident), "good")
    found = marks.filter(~F.col("seed")).join(broadcast_if_small(good), ["words", "kind"])
    place = F.struct("start", "kind", "end")
    found = found.groupBy("row").agg(F.collect_set(place).alias("found"))  # within one text
    rows = rows.join(found, "row", "left")
    own = F.transform(F.filter("marks", lambda m: m["seed"]), lambda m: F.struct(m["start"].alias("start"), m["kind"].alias("kind"), m["end"].alias("end")))
    kinds = F.array(*map(F.lit, KINDS))
    shown = F.array_join(F.transform(F.array_sort(F.concat(own, "found")), lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")
    return rows.select("doc_id", *(F.get("counts", k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)), "base_sha256",
                       F.coalesce(F.when(F.col("found").isNotNull(), shown), "base").alias("spans"), F.when(F.col("found").isNull(), 0).otherwise(F.size("found")).cast("bigint").alias("n_found"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
ORACLES: dict[str, str] = {}
