"""Small tables with everything that real ones may hold, and plain versions of rules."""

import random

from pyspark.sql import functions as F

CLASHING = ("place", "kept", "size", "keep_id", "row", "print", "node", "doc", "at", "spans", "score", "part", "_doc", "_place", "gram", "n", "words", "u", "bin", "rank")


def odd_rows():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    long = "\n".join(prose(30) for _ in range(900))
    base = prose(120)
    rows = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "One", "en", "a"), (5, "one", "en", "b"), (6, long, "en", "a"),
            (7, base, "fr", "a"), (8, base.upper().replace("É", "é"), "fr", "b"), (9, base + " tail end", "fr", "b"), (10, "x\ny\nz\nx\ny\nz\n\n\n\n\n", "en", ""), (None, base, "fr", "a"), (None, "alone here", "en", "c"),
            (11, "a a", "en", "a"), (12, "a a a", "en", "a"), (13, "12 34 !", None, "c"), (13, "12 34 !", None, "c"), (14, "same id, first", "en", "c"), (14, "same id, second", "en", "c")]
    return rows


def odd_docs(spark, rows=None):
    rows = odd_rows() if rows is None else rows
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3)
    return df.withColumns({c: F.lit("clash") for c in CLASHING})


def no_docs(spark):
    return odd_docs(spark).limit(0)


def in_words(text):
    return (text or "").encode().lower().split()
