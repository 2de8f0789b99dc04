"""Nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import collections
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cuetable.llm import exact_dedup, language, line_dedup, mixing, near_dedup, neighbours, packing, pii, repeats, token_counts
from cuetable.llm.common import written
from cuetable.llm.components import components
from llm.oddities import in_words, no_docs, odd_docs, odd_rows

ASCII = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
PATH = token_counts.vocabulary_path()


def test_exact_groups_and_weak_fingerprints(spark):
    rows = odd_rows()
    normal = [(r[1] or "").translate(ASCII) for r in rows]
    want = []
    for r, t in zip(rows, normal):
        ids = [q[0] for q, s in zip(rows, normal) if s == t]
        keep = max((i for i in ids if i is not None), default=None)
        want.append((r[0], keep, len(ids), r[0] == keep))
    for print_of in ({}, {"print_of": lambda raw: len(raw) % 3}):
        got = exact_dedup.exact_groups(odd_docs(spark), **print_of).collect()
        assert sorted(map(str, want)) == sorted(str((r.doc_id, r.keep_id, r.group_size, r.kept)) for r in got)
    assert exact_dedup.exact_groups(no_docs(spark)).count() == 0


def test_filters_merge_without_loss():
    rng = np.random.default_rng(3)
    parts = [np.unique(rng.integers(0, 1 << 63, 400, dtype=np.uint64) & np.uint64(0xFF000000000000FF) | np.uint64(3) << np.uint64(59), return_counts=True) for _ in range(4)]
    part = 3
    held = [(p[(p >> np.uint64(59)) == part], c[(p >> np.uint64(59)) == part]) for p, c in parts]
    packed = [exact_dedup.pack(p, c, 5) for p, c in held]
    prints, counts = exact_dedup.merge([exact_dedup.unpack(x, part, 5) for x in packed])
    every = np.concatenate([np.repeat(p, c) for p, c in held])
    want, n = np.unique(every, return_counts=True)
    assert (prints == want).all() and (counts == n).all()


def test_near_groups(spark):
    rows = odd_rows()
    got = near_dedup.near_groups(odd_docs(spark), words=2).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_shingles): r for r in got}
    assert by[(11, 1)].component_id == by[(12, 1)].component_id == 11  # equal sets of unequal words
    assert by[(8, len(set(zip(in_words(rows[6][1]), in_words(rows[6][1])[1:]))))].component_id == 7 == by[(9, len(set(zip(in_words(rows[8][1]), in_words(rows[8][1])[1:]))))].component_id
    assert by[(1, 0)].component_id == 1 and by[(2, 0)].component_id == 2 and by[(3, 0)].component_id == 3 and by[(5, 1)].component_id == 4
    assert near_dedup.near_groups(no_docs(spark)).count() == 0


@pytest.mark.parametrize("leaders", [near_dedup.LEADERS, 0])
def test_long_lists_of_near_copies(spark, monkeypatch, leaders):
    """More copies than a short list takes, in two groups that share a passage, with chains of changes; without leaders, all meet by signatures."""
    monkeypatch.setattr(near_dedup, "LEADERS", leaders)
    rng = random.Random(9)
    words = [f"w{k}" for k in range(4000)]
    passage = rng.sample(words, 60)
    rows = []
    for group in range(2):
        base = passage + rng.sample(words, 60)
        for k in range(70):
            own = list(base)
            for _ in range(rng.randint(0, 9)):
                own[rng.randrange(60, 120)] = rng.choice(words)
            rows.append((group * 100 + k, " ".join(own)))
    rows += [(500 + k, " ".join(passage + rng.sample(words, 60))) for k in range(60)]
    sets = {d: set(zip(t.split(), t.split()[1:])) for d, t in rows}
    root = {d: d for d, _ in rows}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in sets:
        for b in sets:
            met = len(sets[a] & sets[b])
            if a < b and 100 * met >= 80 * (len(sets[a]) + len(sets[b]) - met):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: find(d) for d in sets}


def test_supersets_of_a_large_group(spark):
    """Variants of one text, and texts that hold it with a run of words put in, which are similar to 0.80-0.87 to some of the group."""
    rng = random.Random(12)
    base = [f"b{k}" for k in range(51)]
    rows = [(0, " ".join(base))]
    for k in range(1, 90):
        own = list(base)
        for at in rng.sample(range(51), rng.randint(1, 2)):
            own[at] = f"v{k}x{at}"
        rows.append((k, " ".join(own)))
    for k in range(40):
        at = rng.randrange(1, 50)
        rows.append((200 + k, " ".join([*base[:at], *(f"s{k}x{i}" for i in range(rng.randint(6, 10))), *base[at:]])))
    sets = {d: set(zip(t.split(), t.split()[1:])) for d, t in rows}
    near = [len(sets[0] & s) / len(sets[0] | s) for s in sets.values()]
    assert min(near) >= 0.8 and min(near[90:]) < 0.81 and max(near[90:]) < 0.87
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert len(got) == len(rows) and {r.component_id for r in got} == {0}


def test_pairs_come_out_of_one_list():
    """Of all lists that two nodes share, only the first one names the pair."""
    maps = [near_dedup.bit_map(np.arange(100, dtype=np.uint64) * np.uint64(128) + np.uint64(k << 20)) for k in (0, 0, 0)]
    own = [np.array([5, 9]), np.array([9, 5, -3]), np.array([9, 7])]
    for key, want in ((5, {(1, 2)}), (9, {(1, 3), (2, 3)}), (-3, set())):
        held = [k for k in range(3) if key in own[k]]
        rows = [{"key": key, "node": k + 1, "n": 100, "root": k + 1, "asks": asks, "map": maps[k], "keys": own[k]} for k in held for asks in (True, False)]
        got = near_dedup.alike(pd.DataFrame(rows))
        assert set(zip(got["a"], got["b"], strict=True)) == want


def test_few_values_of_crowded_nodes_are_listed(spark, monkeypatch):
    """Texts around one passage, some in chains of near copies: each lists one value more than a partner can lack and a few beside."""
    listed = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: (out := written(df, name), listed.extend(out.collect() if name == "listed" else []))[0])
    rng = random.Random(4)
    words = [f"w{k}" for k in range(9000)]
    passage = words[:150]
    rows = []
    for k in range(90):
        own = rng.sample(words[150:], 150)
        rows.append((10 * k, " ".join([*passage, *own])))
        for c in range(1, 1 + k % 4):
            own[rng.randrange(150)] = f"x{k}-{c}"
            rows.append((10 * k + c, " ".join([*own, *passage])))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert {r.doc_id: r.component_id for r in got} == {d: d // 10 * 10 for d, _ in rows}
    most = collections.Counter(r.node for r in listed)
    assert len(most) > 80 and max(most.values()) <= near_dedup.OWN_VALUES + near_dedup.SPARE


def test_copies_meet_leaders_in_few_lists(spark, monkeypatch):
    """A group of near copies shares dozens of long lists; a node asks the leaders of a few of them, in each election."""
    placed = []
    monkeypatch.setattr(near_dedup, "written", lambda df, name: (out := written(df, name), placed.append(out.collect()) if name == "placed" else None)[0])
    rng = random.Random(6)
    base = [f"b{k}" for k in range(60)]
    rows = [(0, " ".join(base))]
    for k in range(1, 120):
        own = list(base)
        for at in rng.sample(range(60), 2):
            own[at] = f"v{k}x{at}"
        rows.append((k, " ".join(own)))
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id bigint, text string"), words=2).collect()
    assert len(got) == 120 and {r.component_id for r in got} == {0}
    most = collections.Counter(r.node for r in placed[0])
    assert most and max(most.values()) <= 8 < max(collections.Counter(r.node for r in placed[-1]).values())


def test_components(spark):
    rng = random.Random(2)
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 100 + k) for k in range(1, 30)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)]
    root = {}

    def find(x):
        return x if root.setdefault(x, x) == x else find(root[x])

    for a, b in edges:
        if a != b:
            low, high = sorted((find(a), find(b)))
            root[high] = low
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in root}


def brute_repeats(texts):
    seen, out = set(), []
    for raw in texts:
        gone = bytearray(len(raw))
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = b"\1" * 100
            seen.add(raw[i:i + 100])
        out.append(bytes(x for x, g in zip(raw, gone) if not g))
    return out


def test_repeats(spark, monkeypatch):
    rng = random.Random(3)
    base = ["".join(rng.choice("ab cé\0") for _ in range(rng.randint(80, 400))) for _ in range(6)]
    rows = [(200, "a" * 700), (201, "a" * 150), (202, ""), (203, None), (204, "ab" * 300), (205, base[0]), (206, base[0])]
    for d in range(90):
        text = ""
        for _ in range(rng.randint(1, 4)):
            s = rng.choice(base)
            text += s[rng.randint(0, len(s) // 2):][:rng.randint(20, 400)] + "".join(rng.choice("xyz") for _ in range(rng.randint(0, 60)))
        rows.append((d, text))
    rows.sort()
    want = dict(zip([d for d, _ in rows], brute_repeats([(t or "").encode() for _, t in rows])))
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    for crowded in (repeats.CROWDED, 3):  # the second spells out windows
        monkeypatch.setattr(repeats, "CROWDED", crowded)
        got = repeats.remove_repeats(df).collect()
        assert {r.doc_id: bytes(r.text) for r in got} == want
        assert all(r.n_bytes - r.n_removed == len(r.text) and sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)


def test_repeats_with_odd_rows(spark):
    got = repeats.remove_repeats(odd_docs(spark)).collect()
    assert len(got) == len(odd_rows())
    left = {(r.doc_id, r.n_bytes): r.n_removed for r in got}
    base = len(odd_rows()[6][1].encode())
    assert left[(7, base)] == 0 and left[(None, base)] == base and left[(9, base + 9)] >= base - 1 and left[(2, 0)] == 0
    assert repeats.remove_repeats(no_docs(spark)).count() == 0


def test_interval_tree():
    assert sorted(repeats.intervals(np.array([2, 3, 3, 0, 1]), 1)) == [(1, 4, 5), (2, 0, 3), (3, 1, 3)]


def test_personal_data_learns_contexts(spark):
    rng = random.Random(1)
    seeds = [(k, f"filler text call us +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now") for k in range(6)]
    rows = [*seeds, (50, "please call us 212 555 0199 today"), (51, "part number 212 555 0199 listed"), (52, None), (53, ""), (54, "1" * 5000 + "@" * 50 + "a" * 5000)]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert got[50].spans == "phone:15:27" and got[50].n_phone == 0 and got[50].n_found == 1
    assert got[51].spans == "" and got[52].spans == got[53].spans == got[54].spans == ""
    assert all(got[k].n_phone == 1 for k in range(6))
    assert pii.find_personal_data(odd_docs(spark)).count() == len(odd_rows()) and pii.find_personal_data(no_docs(spark)).count() == 0


def test_personal_data_second_generation(spark):
    """Numbers found after one phrase, and standing after another too, make that one a pattern; it finds what no seed stands near."""
    rng = random.Random(2)
    seeds = [(k, f"filler text call us +1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)} now") for k in range(40)]
    found = [f"212 555 {1000 + k}" for k in range(8)]
    rows = [*seeds, *[(100 + k, f"please call us {n} today") for k, n in enumerate(found)], *[(200 + k, f"or ring desk {n} later") for k, n in enumerate(found)],
            (300, "just ring desk 313 555 4444 then"), (301, "order number 313 555 7777 came")]
    got = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert all(got[100 + k].n_found == 1 and got[200 + k].n_found == 1 for k in range(8))
    assert got[300].spans == "phone:15:27" and got[301].spans == ""
    once = {r.doc_id: r for r in pii.find_personal_data(spark.createDataFrame(rows, "doc_id bigint, text string"), rounds=1).collect()}
    assert once[100].n_found == 1 and once[300].n_found == 0  # found by the second round alone


def test_personal_data_candidates():
    """Short quads, and addresses longer than 64 characters, whole."""
    assert pii.candidates("host 256.1.1.1 up, 300.1.1.1:80", []) == [(5, 1, 14), (19, 1, 28), *[(19, k, 31) for k in [3]]]
    name, place = "n" * 90, "d" * 70
    assert pii.candidates(f"to {name}@{place} now a@b@c", []) == [(3, 0, 164), (169, 0, 172), (171, 0, 174)]
    assert pii.candidates("7 " + "1" * 200_000 + "@" * 50 + "a" * 200_000, []) == [] and len(pii.candidates("a@" * 50_000, [])) == 49_999


def test_personal_data_patterns():
    import re
    plain = {0: r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", 1: r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", 2: r"[0-9]([\x20-]?[0-9])+", 3: r"\+[0-9][\x20().0-9-]+[0-9]"}
    digits = lambda s: re.sub("[^0-9]", "", s)
    fits = {0: lambda s: True, 1: lambda s: all(int(p) < 256 for p in s.split(".")), 2: lambda s: 14 <= len(digits(s)) <= 19 and pii.luhn(digits(s)), 3: lambda s: 10 <= len(digits(s)) <= 15}
    rng = random.Random(5)
    for _ in range(8000):
        text = "".join(rng.choice("12340.@+- ()ab%_\n") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(text) == sorted((m.start(), k, m.end()) for k, p in plain.items() for m in re.finditer(p, text) if fits[k](m[0]))


def test_tokens(spark):
    rows = [(k, t, "en", "a") for k, t in enumerate(["don't it's ISN'T'S !!'s a1b22", "<|endoftext|> hi <|startoftext|>x", "日本語 テキスト", "ΣΑΣ İstanbul", "école  x\x85y ½ ² ª º µ", "\x0b\x0ca\tb", "ÀÉ×÷ñ ßẞ", "é ｆ", "word " * 9000])]
    rows += odd_rows()
    tokenizer = token_counts.load(PATH)
    n = {t: len(tokenizer.encode(t or "", add_special_tokens=False).ids) for _, t, _, _ in rows}
    got = token_counts.count_tokens(odd_docs(spark, rows), PATH).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(d), len((t or "").encode()), n[t], n[t] > 2048) for d, t, _, _ in rows)
    assert token_counts.count_tokens(no_docs(spark), PATH).count() == 0
    pieces = packing.pack(odd_docs(spark, rows), PATH, length=64).collect()
    assert sum(r.length for r in pieces) == sum(n[t] + 1 for _, t, _, _ in rows) and all(len(r.ids) == 4 * r.length for r in pieces)
    assert sorted({r.offset + r.length for r in pieces})[-1] == 64 and packing.pack(no_docs(spark), PATH).count() == 0


def test_packing_merges_words_itself():
    """The library's ids from the merges alone, while words are forgotten; it is loaded for a text beyond the plain set, and not before."""
    tokenizer, whole = token_counts.load(PATH), token_counts.whole_tokens(PATH)
    own = packing.Writer(PATH, whole, packing.Merges(packing.described(PATH)))
    own.remembered = len(whole) + 100
    rng = random.Random(8)
    ids = lambda t: np.array([*tokenizer.encode(t, add_special_tokens=False).ids], own.kind).tobytes()
    again = ["thonering", "l'élèvetion,", "inwhtion"]
    for _ in range(30):
        texts = [" ".join([*again, *("".join(rng.choice(["th", "ing", "er", "é", "ÿ", "SS", "7", "'s", ".", "--", "Q", "ou", "a"]) for _ in range(rng.randint(1, 12))) for _ in range(40))]) for _ in range(4)]
        assert own.encoded(texts) == [ids(t) for t in texts]
        assert set(again) <= own.words.keys() and len(own.words) < len(whole) + 1_000
    assert "tokenizer" not in vars(own)
    odd = ["", "日本 \u2028 語", "a<|endoftext|>b", "\x1f x"]
    assert own.encoded(odd) == [ids(t) for t in odd] and "tokenizer" in vars(own)


def test_packing_holds_few_words():
    """A task meets more words than it remembers."""
    whole = token_counts.whole_tokens(PATH)
    own = packing.Writer(PATH, whole, packing.Merges(packing.described(PATH)))
    letters = "abcdefghijklmnop"
    names = ["zq" + "".join(letters[k >> s & 15] for s in (0, 4, 8, 12, 16)) for k in range(250_000)]
    for at in range(0, len(names), 25_000):
        own.encoded([" ".join(names[at:at + 25_000])])
        assert len(own.words) <= 160_000


def test_language_spans(spark):
    rng = random.Random(6)
    words = {"xx": ["bar", "bor", "rab", "orb"], "yy": ["miu", "num", "umi", "nim"]}
    say = lambda lang, n: " ".join(rng.choice(words[lang]) for _ in range(n))
    rows = [(k, say(lang, 40), lang, "s") for k in range(60) for lang in ["xx" if k % 2 else "yy"]]
    docs = odd_docs(spark, rows)
    model = language.fit(language.training_rows(docs))
    first, second = say("xx", 30), say("yy", 30)
    got = {r.doc_id: r for r in language.identify(odd_docs(spark, [(1, f"{first} {second}", None, None), (2, "7 !", None, None), (3, None, None, None), (4, "привет", None, None)]), model).collect()}
    assert [(s.start, s.end, s.lang) for s in got[1].spans] == [(0, len(first), "xx"), (len(first) + 1, len(first) + 1 + len(second), "yy")]
    assert got[2].lang_pred == got[3].lang_pred == "und" and got[3].score == 0 and got[4].lang_pred in ("xx", "yy")
    assert language.identify(odd_docs(spark), language.fit(language.training_rows(odd_docs(spark)))).count() == len(odd_rows())
    empty = language.fit(no_docs(spark))
    assert empty["languages"] == [] and {r.lang_pred for r in language.identify(docs, empty).collect()} == {"und"}


def test_viterbi():
    rng = np.random.default_rng(0)
    words = np.array([5, 0, 3, 7])
    scores = rng.normal(size=(words.sum(), 3)) * 3
    got, at = language.viterbi(scores, words, 2.0), 0
    for n in words:
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[at + i, k] for i, k in enumerate(p)) - 2.0 * sum(a != b for a, b in zip(p, p[1:]))) if n else ()
        assert got[at:at + n].tolist() == list(best)
        at += n


def test_viterbi_of_many_languages():
    want = np.array([0, 127, 128, 299, 299, 200])
    assert language.viterbi(np.eye(300)[want] * 9, np.array([4, 2]), 2.0).tolist() == want.tolist()


def test_mixing(spark):
    rng = random.Random(7)
    rows = [(k, " ".join(["w"] * rng.randint(0, 50)), "en", rng.choice(["a", "b", "c", "d", None, "é"])) for k in range(600)] + odd_rows()
    got = mixing.mix(odd_docs(spark, rows)).toPandas()
    sizes = {}
    for _, text, _, source in rows:
        sizes[source] = sizes.get(source, 0) + len(in_words(text))
    weights = {s: (3, 1, 2)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    left, target, open_ = 1.5 * sum(sizes.values()), {}, set(sizes)
    while True:  # round by round
        level = (left - sum(target.values())) / max(1, sum(weights[s] for s in open_))
        over = [s for s in open_ if level * weights[s] > 2 * sizes[s]]
        if not over:
            break
        for s in over:
            target[s] = 2 * sizes[s]
            open_.remove(s)
    target |= {s: level * weights[s] for s in open_}
    for source, own in got.groupby("source", dropna=False):
        key = source if isinstance(source, str) else None
        assert own.source_size.iloc[0] == sizes[key] and abs(own.target.iloc[0] - target[key]) < 1e-6
        assert abs(own.taken.sum() - target[key]) <= 2 and (own.taken <= 2 * own["size"]).all() and (own.taken >= 0).all()
    again = mixing.mix(odd_docs(spark, rows).repartition(7)).toPandas()
    assert sorted(map(str, got.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    lifted = mixing.mix(odd_docs(spark, rows), weight=F.when(F.col("doc_id") % 2 == 0, 1.5).otherwise(0.5)).toPandas()
    even = lifted[lifted.doc_id % 2 == 0]
    assert even.taken.sum() > 0.6 * lifted.taken.sum()
    # One source of equal documents is filled to one and a half: second copies come as often as their unequal odds ask for.
    equal = [(k, "w " * 10, "en", "a") for k in range(6_000)]
    drawn = mixing.mix(odd_docs(spark, equal), weight=F.when(F.col("doc_id") % 2 == 0, 1.25).otherwise(0.75)).toPandas()
    second = (drawn.taken - 10) / 10
    assert abs(second[drawn.doc_id % 2 == 0].mean() - 0.875) < 0.03 and abs(second[drawn.doc_id % 2 == 1].mean() - 0.125) < 0.03
    assert mixing.mix(no_docs(spark)).count() == 0


def test_lines(spark):
    got = {(r.doc_id, r.text): r for r in line_dedup.remove_repeated_lines(odd_docs(spark)).collect()}
    assert got[(10, "x\ny\nz\n")].n_removed == 7  # a run of empty lines repeats itself
    rows = [(1, "a\nb\nc\nd", "", ""), (2, "q\nb\nc\nd\nr", "", ""), (3, "a\nb\nc\nd\ne", "", ""), (4, "c\nd", "", ""), (5, None, "", "")]
    got = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.remove_repeated_lines(odd_docs(spark, rows)).collect()}
    assert got == {1: ("a\nb\nc\nd", 0), 2: ("q\nr", 3), 3: ("e", 4), 4: ("c\nd", 0), 5: ("", 0)}
    assert line_dedup.remove_repeated_lines(no_docs(spark)).count() == 0


def test_neighbours(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 8))
    x[100:180] = x[100]  # many alike
    rows = [(int(k), [float(v) for v in row], "clash") for k, row in enumerate(x)]
    rows += [(300, None, ""), (None, [1.0] * 8, ""), (301, [0.0] * 8, ""), (302, [1.0, None], ""), (303, [float("nan")] * 8, ""), (304, [float("inf")] * 8, ""), (305, [1.0, 2.0], ""), (5, [float(v) for v in x[5]], "")]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score string")
    x = np.vstack([x, [1.0, 2.0] + [0.0] * 6])
    ids = np.array([*range(300), 305])
    for block in (neighbours.VECTOR_BLOCK, 40):
        monkeypatch.setattr(neighbours, "VECTOR_BLOCK", block)
        monkeypatch.setattr(neighbours, "QUERY_BLOCK", block // 8)
        got = neighbours.nearest(df, F.col("vec_id") % 20 == 0, k=5, tables=4, probes=32).toPandas()  # every bucket: exact
        for q, own in got.groupby("query_id"):
            score = x @ x[q]
            want = [i for i in np.lexsort((ids, -score.round(9))) if ids[i] != q][:5]
            assert own.sort_values("rank").vec_id.tolist() == ids[want].tolist()
        assert got.query_id.nunique() == 15
    assert neighbours.nearest(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert (neighbours.nearest(df.filter("vec_id IN (0, 7)"), F.col("vec_id") == 0, probes=64).count()) == 1


@pytest.mark.parametrize("shape", ["long", "skewed", "cluster"])
def test_neighbours_of_any_length(spark, shape):
    """One long vector, lengths by a lognormal law, and a narrow cluster away from the queries."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if shape == "long":
        x[17] *= 20
    elif shape == "skewed":
        x *= rng.lognormal(0, 0.5, (4000, 1))
    else:
        x[200:] = x[200] + rng.normal(size=(3800, 64)) * 0.001
        x[:200] = x[:10].repeat(20, 0) - 3 * x[200]
        x /= np.linalg.norm(x, axis=1, keepdims=True)
    asks = F.col("vec_id").isin(list(range(0, 200, 20)) if shape == "cluster" else list(range(0, 4000, 40)))
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id bigint, embedding array<double>")
    if shape == "cluster":
        df = df.filter("vec_id >= 200 OR vec_id % 20 = 0")
    got = neighbours.nearest(df, asks).toPandas()
    assert got.groupby("query_id").size().tolist() == [20] * (10 if shape == "cluster" else 100)
    hits = 0
    for q, own in got.groupby("query_id"):
        score = x @ x[q]
        score[[q, *([k for k in range(200) if k % 20] if shape == "cluster" else [])]] = -np.inf
        hits += len(set(np.argsort(-score)[:20]) & set(own.vec_id))
        assert np.allclose(own.score, score[own.vec_id])
    assert hits >= 0.9 * len(got), hits / len(got)
