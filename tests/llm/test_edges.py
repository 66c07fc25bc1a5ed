"""Odd tables: nothing in them, one language, the least capacity, repeated and clashing rows."""

import corpus_pipeline
import pytest

from tessera.llm import chat, language, packing, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages_of_nothing(spark, sf):
    none = spark.createDataFrame([], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, sf)
        assert out.columns == none.columns and out.count() == 0
    assert corpus_pipeline.pack(spark, none, sf).count() == 0


def test_stages_of_nulls(spark, sf):
    docs = spark.createDataFrame([(None, None, None, None, None)] * 3 + [(1, None, None, None, None), (2, "", None, None, None), (3, "one two", None, None, None)], DOCS)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
    assert {r.doc_id for r in docs.collect()} == {3}


def test_one_language(spark):
    rows = [(i, f"the cat sat on mat number {i}", "en", "s", 1) for i in range(40)] + [(100, "123", "en", "s", 1), (101, None, None, "s", 1)]
    got = {r.doc_id: r for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()}
    assert all(got[i].lang_pred == "en" and 0 <= got[i].score <= 1 for i in range(40))
    assert got[100].lang_pred == got[101].lang_pred == "und"


def test_no_language(spark):
    rows = [(i, "the cat sat", None, "s", 1) for i in range(8)]
    assert {r.lang_pred for r in language.identify(spark.createDataFrame(rows, DOCS)).collect()} == {"und"}


@pytest.mark.parametrize("capacity", [1, 2])
def test_least_capacity(spark, capacity):
    docs = spark.createDataFrame([(1, "one two three", "en", "s", 1), (2, "", "en", "s", 1), (3, None, "en", "s", 1)], DOCS)
    rows = packing.pack(docs, queries.vocabulary(), capacity=capacity, end_id=1).collect()
    fill = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    total = sum(r.length for r in rows)
    assert all(n <= capacity for n in fill.values()) and len(fill) == -(-total // capacity)


def test_turns_that_repeat(spark, sf):
    raw = chat.transcripts(spark.read.parquet(f"{sf}/conversations.parquet"))
    model = chat.fit(raw)
    rows = [(1, 0, "User: hello there", 7), (1, 0, "User: hello there", 7), (1, 1, "Assistant: good day", 7), (None, 0, "User: x", 7), (None, 0, "User: x", 7)]
    got = chat.parse(spark.createDataFrame(rows, "conv_id long, seq long, raw string, chunk long"), model).collect()
    assert sorted((r.conv_id or 0, r.role, r.text) for r in got) == [(0, "user", "x")] * 2 + [(1, "assistant", "good day")] + [(1, "user", "hello there")] * 2
