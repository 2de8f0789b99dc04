"""Queries with SQL against it, and the rest against plain versions, on the smallest tables."""

import collections
import re
import zlib
from pathlib import Path

import numpy as np
import pytest

from cuetable.llm.registry import collect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = collect("QUERIES"), collect("ORACLES")
pytestmark = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def test_names():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    from compare import compare, duck
    ok, note, _ = compare(spark, duck(SF), name, QUERIES[name], ORACLES[name], SF)
    assert ok, note


def test_neighbours(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x, ids = np.stack(rows.embedding).astype(float), rows.vec_id.to_numpy()
    got = {q: g.sort_values("rank") for q, g in QUERIES["op1_nearest"](spark, SF).toPandas().groupby("query_id")}
    hits = 0
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        others = [k for k in np.lexsort((ids, -score)) if k != i][:20]
        g = got[ids[i]]
        hits += len(set(ids[others]) & set(g.vec_id))
        assert g["rank"].tolist() == list(range(1, 21)) and sorted(g.score, reverse=True) == g.score.tolist()
        assert np.allclose(g.score, [score[ids.tolist().index(v)] for v in g.vec_id], atol=1e-12)
    assert hits >= 0.9 * 20 * len(got)


def test_personal_data(spark, docs):
    from cuetable.llm.pii import base_spans, render
    for r in QUERIES["op3_pii"](spark, SF).collect():
        spans = base_spans(docs[r.doc_id] or "")
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in spans) for k in range(4)]
        assert set(render(spans).split(",")) <= set(r.spans.split(","))


def test_token_counts_and_packing(spark, docs):
    from cuetable.llm.token_counts import load, vocabulary_path
    tokenizer = load(vocabulary_path())
    ids = {d: tokenizer.encode(t or "", add_special_tokens=False).ids for d, t in docs.items()}
    counts = QUERIES["op4_token_counts"](spark, SF).collect()
    assert {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in counts} == {(d, len((t or "").encode()), len(ids[d]), len(ids[d]) > 2048) for d, t in docs.items()}
    pieces = QUERIES["op8_pack_sequences"](spark, SF).collect()
    at = collections.Counter()
    for r in sorted(pieces, key=lambda r: (r.doc_id, r.start)):
        own = [*ids[r.doc_id], 2]
        assert r.start == at[r.doc_id] and r.doc_tokens == len(own) and 0 < r.length
        assert r.ids_crc32 == zlib.crc32(np.array(own[r.start:r.start + r.length], "<u4").tobytes())
        at[r.doc_id] += r.length
    assert at == {d: len(x) + 1 for d, x in ids.items()}
    rows = sorted((r.sequence_id, r.offset, r.length) for r in pieces)
    filled = collections.Counter()
    for s, offset, length in rows:
        assert offset == filled[s]
        filled[s] += length
    assert sorted(filled.values())[1:] == [4096] * (len(filled) - 1) or all(v == 4096 for s, v in filled.items() if s < max(filled))


def test_near_copies(spark, docs):
    sets = {}
    for d, t in docs.items():
        w = (t or "").encode().lower().split()
        sets[d] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} if w else set()
    root = {d: d for d in docs}

    def find(d):
        return d if root[d] == d else find(root[d])

    for a in sets:
        for b in sets:
            met = len(sets[a] & sets[b])
            if a < b and met and 100 * met >= 80 * (len(sets[a]) + len(sets[b]) - met):
                low, high = sorted((find(a), find(b)))
                root[high] = low
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in QUERIES["op5_near_dedup"](spark, SF).collect()}
    assert got == {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def test_repeats(spark, docs):
    import hashlib
    seen, want = set(), set()
    for d in sorted(docs):
        raw = (docs[d] or "").encode()
        gone = np.zeros(len(raw), bool)
        for i in range(len(raw) - 99):
            if raw[i:i + 100] in seen:
                gone[i:i + 100] = True
            seen.add(raw[i:i + 100])
        kept = bytes(np.frombuffer(raw, np.uint8)[~gone])
        spans = int((gone & ~np.append(False, gone[:-1])).sum()) if len(raw) else 0
        want.add((d, len(raw), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    assert {tuple(r) for r in QUERIES["op6_repeats"](spark, SF).collect()} == want


def test_language(spark):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = QUERIES["op7_language"](spark, SF).collect()
    held = [r for r in rows if r.held_out]
    assert {r.doc_id for r in held} == {d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2}
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) >= 0.95 * len(held) and all(0 <= r.score <= 1 for r in rows)


def test_round_trip(spark, docs):
    import hashlib
    from cuetable.llm.token_counts import load, vocabulary_path
    tokenizer, want = load(vocabulary_path()), set()
    for d, t in docs.items():
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.add((d, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()))
    assert {tuple(r) for r in QUERIES["op13_bpe_round_trip"](spark, SF).collect()} == want
