"""Contained terms, best folders and name slips against plain versions."""

import random

from pyspark.sql import functions as F

from cuetable.functions.grams import contained_terms, term_places
from cuetable.operators import assets, classify, names


def test_contained_terms(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("abcé珠 ") for _ in range(n))
    texts = [(i, word(rng.choice([0, 1, 2, 5, 40, 700]))) for i in range(60)]
    terms = sorted({word(rng.randint(1, 6)) for _ in range(150)} | {texts[40][1][:300], "", texts[7][1]})
    got = contained_terms(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", spark.createDataFrame([(t,) for t in terms], "term string"))
    assert sorted(map(tuple, got.collect())) == sorted((i, t) for i, text in texts for t in terms if t and t in text)
    none = contained_terms(spark.createDataFrame(texts, "id int, text string"), ["id"], "text", spark.createDataFrame([("",)], "term string"))
    assert none.count() == 0


def test_best_folders(spark):
    """The first five of all scores, for names that hold each other, that share letters only, and that share none."""
    rng = random.Random(6)
    name = lambda n: "".join(rng.choice("abcdefghij洗衣凝珠香 ") for _ in range(n))
    products = sorted({name(rng.randint(1, 9)) for _ in range(25)} | {"zzz", "!!", "ab", "abcdefghij洗衣凝珠香"})
    folders = sorted({name(rng.randint(1, 14)) for _ in range(120)} | {"ab one", "ab two", "ab three", "AB", "a-b", "b a", "?"})
    p, f = spark.createDataFrame([(x,) for x in products], "product string"), spark.createDataFrame([(x,) for x in folders], "folder string")
    scored: dict = {}
    for r in assets.folder_scores(p, f).collect():
        scored.setdefault(r["product"], []).append((-r["score"], r["folder"]))
    want = {(k, folder, i + 1) for k, rows in scored.items() for i, (_, folder) in enumerate(sorted(rows)[:5])}
    assert {(r["product"], r["folder"], r["folder_rank"]) for r in assets.best_folders(p, f).collect()} == want and want


def test_name_slips(spark):
    rng = random.Random(8)
    names_of = {f"v{k}": "".join(rng.choice("abcd") for _ in range(rng.choice([2, 3, 5, 9]))) + "-X" for k in range(12)}
    rows = [(v, i, "".join(rng.choice("abcd e") for _ in range(rng.choice([0, 3, 30, 600])))) for v in [*names_of, "none"] for i in range(3)]
    want = set()
    for v, i, text in rows:
        name = names_of.get(v, "").removesuffix("-X")
        for width in range(3, min(6, len(name)) + 1):
            for target in {name[k:k + width] for k in range(len(name) - width + 1)}:
                for at in range(len(text) - width + 1):
                    source = text[at:at + width]
                    if " " not in source and sum(a != b for a, b in zip(source, target, strict=True)) == 1:
                        want.add((v, i, at + 1, width, source, target, target == name[:3]))
    got = names.name_slips(spark.createDataFrame(rows, "video_id string, id int, text string"), spark.createDataFrame(list(names_of.items()), "video_id string, product_name string"), "a-z", ())
    found = [tuple(r) for r in got.select("video_id", "id", "position", "width", "source", "target", "is_brand").collect()]
    assert len(found) == len(set(found)) and set(found) == want
    assert got.filter(F.substring("source", F.col("diff"), F.lit(1)) != F.col("source_char")).count() == 0 and want


def test_only_names_travel_to_captions(spark):
    """Neither pieces of names nor the names themselves are gathered on the driver for a broadcast, whatever size they are thought to be."""
    rows = spark.sql("SELECT * FROM VALUES ('v', 0, 'abxde abcde'), ('u', 1, 'abxde') AS c(video_id, id, text)")
    products = spark.sql("SELECT * FROM VALUES ('v', 'abcde'), ('v', 'xabc'), ('w', 'abcde') AS p(video_id, product_name)")
    slips = names.name_slips(rows, products, "a-z", ())
    plan = slips._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    brand = [tuple(r) for r in names.name_slips(rows, products, "a-z", (), brand_only=True).select("position", "source", "target").collect()]
    assert sorted(brand) == sorted(tuple(r) for r in slips.filter("is_brand").select("position", "source", "target").collect()) and brand


def test_lexicon_of_words(spark):
    """Words of common syllables: what is compared in full is no more than a few times what is contained; terms with spaces, twice-listed ones and lists per label."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice(["th", "an", "er", "in", "on"]) for _ in range(rng.randint(2, 7)))
    texts = [("v", i, " ".join(word() for _ in range(rng.choice([0, 3, 60])))) for i in range(40)] + [("v", 90, None)]
    words = sorted({w for _, _, t in texts if t for w in t.split(" ")} - {""})
    lexicon = [(w, "said", len(w)) for w in words] + [(" ".join(texts[k][2].split(" ")[:2]), "pair", k) for k in range(40) if " " in texts[k][2]] + [(words[3], "pair", 7), (words[3], "pair", 7), (words[3], "pair", 2)]
    captions, terms = spark.createDataFrame(texts, "video_id string, id int, text string"), spark.createDataFrame(lexicon, "term string, label string, ord int")
    want = {}
    for _, i, text in texts:
        for label in ("said", "pair"):
            held = sorted({(o, t) for t, kind, o in lexicon if kind == label and text and t in text})
            if held:
                want[i, label] = [t for _, t in held]
    got = classify.lexicon_join(captions, terms).collect()
    assert len(got) == len(want) and {(r["id"], r["label"]): r["terms"] for r in got} == want
    own = spark.createDataFrame([(w, w) for w in words], "word string, text string")
    places = term_places(own, ["word"], "text", terms.filter("label = 'said'"), classify.WORD_ANCHOR).count()
    assert places <= 2 * sum(t in w for w in words for t in words)
