"""The pipeline's stages, each against what it should keep of its own input."""

import hashlib
import os
import sys

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

sys.path.insert(0, os.path.dirname(__file__))
from test_operators import ROWS, SCHEMA, brute_components, removed_words, words  # noqa: E402

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        before = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name == corpus_pipeline.STAGES[-1][0]:
            break
        assert docs.columns == COLUMNS
        after = [(r.doc_id, r.text) for r in docs.orderBy("doc_id").collect()]
        if name == "toxicity":
            assert set(after) <= set(before) and len(after) > 0.8 * len(before)
        elif name == "jaccard":
            assert {i for i, _ in after} == {i for i, _, c in brute_components(before) if i == c}
        elif name == "substrings":
            want = removed_words(before)
            assert {i: hashlib.sha256(b" ".join(words(t))).hexdigest() for i, t in after} == {i: w[2] for i, w in want.items() if w[0] == 0 or w[1] < w[0]}
        elif name == "mixing":
            assert set(i for i, _ in after) <= {i for i, _ in before}
            total = sum(len(words(t)) for _, t in before)
            assert abs(sum(len(words(t)) for _, t in after) - total) <= 0.01 * total
    assert docs.select("doc_id").distinct().count() == len({i for i, _ in before})


def test_odd_rows(spark, sf, tmp_path):
    docs = spark.createDataFrame(ROWS, SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert docs.count() > 0


def test_empty_table(spark, sf):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf).collect() == []


def test_jaccard_keeps_unrelated_texts_of_null_and_repeated_ids(spark, sf):
    texts = [" ".join(f"{k}w{i}" for i in range(40)) for k in "abcde"]
    rows = [(None, texts[0]), (None, texts[1]), (None, texts[1]), (None, texts[2]), (5, texts[2] + " more"), (7, texts[3]), (7, texts[4]), (8, texts[4]), (9, texts[0] + " more")]
    docs = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.jaccard_stage(spark, docs, sf).collect()]
    assert sorted(got, key=str) == sorted([(None, texts[1]), (5, texts[2] + " more"), (7, texts[3]), (7, texts[4]), (9, texts[0] + " more")], key=str)


def test_stages_begin_with_a_release(spark, sf, monkeypatch):
    """A stage's driver memory must not stand on what the stages before it left."""
    calls = []
    monkeypatch.setattr(corpus_pipeline, "released", lambda s, f=corpus_pipeline.released: calls.append(s) or f(s))
    docs = spark.createDataFrame([], SCHEMA)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf)
        assert len(calls) == k + 1
