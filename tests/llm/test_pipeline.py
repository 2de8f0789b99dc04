"""The pipeline stage by stage on odd rows and on the smallest tables."""

import collections
import re
import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import corpus_pipeline as pipeline  # noqa: E402
from cuetable.llm.common import written  # noqa: E402
from cuetable.llm.mixing import mix  # noqa: E402
from cuetable.plans import sizes  # noqa: E402
from llm.oddities import in_words, no_docs, odd_docs, odd_rows  # noqa: E402


def test_stages(spark):
    docs = odd_docs(spark)
    columns = docs.columns
    after = {}
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        after[name] = docs.collect()
        assert docs.columns == columns or name == "packing"
    texts = {name: [r.text for r in rows] for name, rows in after.items() if name != "packing"}
    assert sorted(texts["language"]) == sorted(t for _, t, _, _ in odd_rows() if any(c.isalpha() for c in t or ""))
    lower = [t.lower() for t in texts["exact_dedup"]]
    assert len(lower) == len(set(lower)) and set(lower) == {t.lower() for t in texts["language"]}
    assert not {9} & {r.doc_id for r in after["near_dedup"]} or not {7, 8} & {r.doc_id for r in after["near_dedup"]}
    assert set(texts["mixing"]) <= set(texts["near_dedup"])
    assert max(texts["mixing"].count(t) for t in set(texts["mixing"])) <= 2
    size = sum(len(in_words(t)) for t in texts["near_dedup"])
    assert sum(len(in_words(t)) for t in texts["mixing"]) <= 2 * size
    assert sum(r.length for r in after["packing"]) >= len(texts["mixing"])


def test_sources_without_a_shuffle_of_texts(spark, monkeypatch):
    """However many documents are taken, only small tables are joined; rows alike in id and text have each the copies of their own source."""
    monkeypatch.setattr(sizes, "within_rows", lambda df, limit=0: df.count() <= 20)
    rows = [(k, f"one two three {k}", "en", "abc"[k % 3]) for k in range(300)] + [(900, "four five", "en", "b"), (900, "four five", "en", "d")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    taken = mix(docs, rows_too=True)
    assert not re.search("SortMergeJoin|Exchange hashpartitioning", pipeline.sources(spark, docs, "")._jdf.queryExecution().executedPlan().toString())
    want = collections.Counter({(r.row.doc_id, r.row.source): -(-r.taken // r.size) for r in taken.collect()})
    got = collections.Counter((r.doc_id, r.source) for r in pipeline.sources(spark, docs, "").collect())
    assert got == +want and got[900, "d"] == 2 > got[900, "b"]


def test_empty(spark):
    docs = no_docs(spark)
    for name, stage in pipeline.STAGES:
        docs = written(stage(spark, docs, ""), name)
        assert docs.count() == 0


def test_run(spark):
    rows = pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() > 100 and {"doc_id", "sequence_id", "ids_crc32"} <= set(rows.columns)
