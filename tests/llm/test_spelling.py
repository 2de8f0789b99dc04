"""Spelling variants against all pairs of small tables."""

import collections
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from cuetable.llm.spelling import last_forms, neighbours, spelling_variants, variants
from llm.oddities import no_docs, odd_docs, odd_rows


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def expected(counts, ratio=10):
    near = {w: [v for v in counts if v != w and one_edit(w, v)] for w in counts}
    best = {w: min(v, key=lambda x: (-counts[x], x)) if (v := near[w]) else None for w in counts}
    form = {w: b if b and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return {(w, form[w], root(w), counts[w], len(near[w]), counts.get(form[w])) for w in counts}


def in_texts(rows, least=7):
    counts = collections.Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            if len(run) >= least:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n > 1}


@pytest.mark.parametrize("least,alphabet,lengths", [(7, "abé", (7, 8)), (1, "ab", (1, 3)), (6, "ab", (6, 8)), (3, "a", (3, 8))])
def test_all_pairs(spark, least, alphabet, lengths):
    rng = random.Random(least)
    words = sorted({"".join(rng.choice(alphabet) for _ in range(rng.randint(*lengths))) for _ in range(120)})
    counts = {w: 2 + int(2 ** rng.uniform(0, 14)) for w in words}
    table = spark.createDataFrame(list(counts.items()), "word string, n bigint").repartition(3)
    pairs = neighbours(table, least).collect()
    assert len(pairs) == len(set(pairs)) and {tuple(r) for r in pairs} == {(a, b) for a in words for b in words if one_edit(a, b)}
    assert {tuple(r) for r in variants(table, least).collect()} == expected(counts)


def test_long_words(spark):
    long = "ab" * 4_000
    words = [long, long[:5_000] + long[5_001:], long + "c", "x" + long, long[:3_000] + "y" + long[3_001:], "unlike" * 900]
    got = {tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_hot_prefix(spark):
    rng = random.Random(5)
    words = sorted({"longbeginning" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(500)})
    got = {tuple(r) for r in neighbours(spark.createDataFrame([(w,) for w in words], "word string")).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_chain_of_forms(spark):
    forms = [(f"w{i}", f"w{i + 1}") for i in range(11)]
    assert {tuple(r) for r in last_forms(spark.createDataFrame(forms, "word string, form string")).collect()} == {(w, "w11") for w, _ in forms}


def test_odd_documents(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    more = [(k, "Straße STRASSE colour-color Accommodation accomodation accommodation ÉCOLES écoles×÷ñandú" + " accommodation" * 60) for k in range(20, 60)] + [(None, "accommodation accommodation")]
    docs = odd_docs(spark, [(d, t, "en", "a") for d, t in rows + more])
    assert {tuple(r) for r in spelling_variants(docs).collect()} == expected(in_texts(rows + more))
    assert spelling_variants(no_docs(spark)).collect() == []


def test_row_per_word(spark):
    got = variants(spark.createDataFrame([("aaaaaaa", 3)], "word string, n bigint").withColumn("h", F.lit(1))).collect()
    assert [tuple(r) for r in got] == [("aaaaaaa", None, "aaaaaaa", 3, 0, None)]
