"""Encoding and decoding against the library, on texts of all kinds."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuetable.llm.lexicon import LONGEST, Automaton, Codec, Lexicon, Vocabulary, compiled, decode, encode, frequent_words, lexicon_of, round_trip, stretches
from cuetable.llm.token_counts import load, vocabulary_path
from llm.oddities import no_docs, odd_docs, odd_rows

ODD = "abcdefgh ABC'sœΣσςİıǅﬁ ́éñ12٣Ⅷ½\x1c\x1d\x0b\x0c\x85\xa0　 ​日本語한글🙂👩‍👩<|!?--…’“”àÀß×÷"
PATH = vocabulary_path()


@pytest.fixture(scope="module")
def tokenizer():
    return load(PATH)


@pytest.fixture(scope="module")
def codec(tmp_path_factory):
    rng = random.Random(1)
    words = sorted({bytes(rng.choice(b"abcdefgh") for _ in range(rng.randint(1, 5))) for _ in range(3_000)})
    path = tmp_path_factory.mktemp("lexicon") / "held"
    path.write_bytes(compiled(words, Vocabulary(PATH)))
    own = Lexicon(str(path))
    assert own.places(words).tolist() == list(range(len(words))) and own.places([b"zz", b"", b"a" * (LONGEST + 1)]).tolist() == [-1] * 3
    return Codec(PATH, own)


def test_shared_endings():
    own = Automaton()
    own.add([b"tap", b"taps", b"top", b"tops"])
    assert len(own.tables()[3]) == 5


def test_any_text(tokenizer, codec):
    rng = random.Random(2)
    for _ in range(4_000):
        text = "".join(rng.choice(ODD if rng.random() < 0.7 else "ab cd") for _ in range(rng.randint(0, 14)))
        if rng.random() < 0.3:
            text = text[:5] + rng.choice(["<|endoftext|>", "<|startoftext|>"]) + text[5:]
        want = tokenizer.encode(text, add_special_tokens=False).ids
        got = np.frombuffer(codec.encoded([text])[0], codec.vocabulary.kind)
        assert got.tolist() == want, text
        assert codec.decoded(got).decode() == tokenizer.decode(want, skip_special_tokens=False), text


def test_long_word_and_text(tokenizer, codec):
    rng = random.Random(3)
    word = "".join(rng.choice("abcdefghij") for _ in range(20_000))
    words = [word, "a", "aaaaaaa", "banana" * 30, word[:99]]
    ids, first = codec.vocabulary.merged([w.encode() for w in words])
    assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)] == [tokenizer.encode(w, add_special_tokens=False).ids for w in words]
    text = " ".join("abc"[: rng.randint(1, 3)] for _ in range(9_000))
    assert "".join(stretches(text, 100)) == text and len(list(stretches(text, 100))) > 50
    assert [np.frombuffer(x, codec.vocabulary.kind).tolist() for x in codec.encoded([text, ""])] == [tokenizer.encode(text, add_special_tokens=False).ids, []]


@pytest.mark.parametrize("most", [0, 5, 1_000])
def test_any_size_of_lexicon(spark, tokenizer, most):
    docs = odd_docs(spark)
    assert len(frequent_words(docs, PATH, most)) <= most
    rows = odd_rows()
    ids = [tokenizer.encode(r[1] or "", add_special_tokens=False).ids for r in rows]
    encoded = encode(docs, PATH, lexicon_of(docs, PATH, most))
    got = [(r.doc_id, tuple(np.frombuffer(r.ids, "<u4").tolist())) for r in encoded.collect()]
    assert sorted(got, key=str) == sorted([(r[0], tuple(i)) for r, i in zip(rows, ids, strict=True)], key=str)
    texts = sorted(((r.doc_id, r.text) for r in decode(encoded, PATH).collect()), key=str)
    assert texts == sorted([(r[0], tokenizer.decode(i, skip_special_tokens=False)) for r, i in zip(rows, ids, strict=True)], key=str)
    assert sorted((r.doc_id, r.n_tokens) for r in round_trip(docs, PATH, most).filter("doc_id IS NOT NULL").collect()) == sorted((r[0], len(i)) for r, i in zip(rows, ids, strict=True) if r[0])


def test_no_rows(spark):
    assert round_trip(no_docs(spark), PATH).collect() == []
    assert decode(spark.createDataFrame([(1, None), (None, b"")], "doc_id bigint, ids binary").withColumn("text", F.lit("clash")), PATH).select("text").distinct().collect()[0].text == ""
