"""Column functions against plain Python."""

import pytest
from pyspark.sql import functions as F

from corvane.functions import requests as rq
from corvane.functions import text as tx
from corvane.functions.vector import cosine, cosine_to
from corvane.operators.chunk import hash_id
from corvane.sources.ignore import compile_patterns, ignored, is_ignored


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("path,want", [("a/B.TS", "typescript"), ("x.yml", "yaml"), ("Makefile", "text"), (".ts", "text"), ("a.b.md", "markdown"), ("d.x/y", "text")])
def test_language(spark, path, want):
    assert one(spark, tx.detect_language(F.lit(path))) == want


def test_module_text_gate_and_ids(spark):
    assert one(spark, tx.detect_module(F.lit("a/b/c.ts"))) == "a" and one(spark, tx.detect_module(F.lit("c.ts"))) == "root"
    assert [one(spark, tx.is_text_file(F.lit(p))) for p in ("a.ts", "a.txt", "prod.env", "a.bin", "LICENSE")] == [True, True, True, False, False]
    for path, line in (("src/a.ts", 1), ("ä/\U0001f600.md", 907), ("x" * 300, 2)):
        assert one(spark, tx.hash_id(F.lit(path), F.lit(line))) == hash_id(path, line)


def test_trim_tokens_fence_numbers(spark):
    assert one(spark, tx.trim(F.lit("﻿ \n a b  \n"))) == "a b"
    assert one(spark, tx.tokens(F.lit("abcde"))) == 2 and one(spark, tx.tokens(F.lit("\U0001f600\U0001f600a"))) == 2
    assert one(spark, tx.fence_language(F.lit("C++ #-_x"))) == "c++#-x" and one(spark, tx.fence_language(F.lit(""))) == "text"
    assert [one(spark, tx.short_number(F.lit(x))) for x in (0.5, 1.0, 0.12345, 0.0)] == ["0.5", "1", "0.1235", "0"]
    assert one(spark, tx.iso_millis(F.lit("2024-01-02 03:04:05.6").cast("timestamp"))) == "2024-01-02T03:04:05.600Z"


def test_cosine_has_no_value_for_zero_vectors(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([0.0, 0.0],), ([3.0, 4.0],), (None,)], "v array<float>")
    for score in (cosine(F.col("v"), F.array(F.lit(1.0), F.lit(0.0))), cosine_to([1.0, 0.0])(F.col("v"))):
        got = [r[0] for r in df.select(score).collect()]
        assert got[0] == pytest.approx(1) and got[1] is None and got[2] == pytest.approx(0.6) and got[3] is None


@pytest.mark.parametrize("pattern,path,want", [
    ("dist", "a/dist/x", True), ("dist", "a/district", False), ("/dist", "a/dist/x", False), ("a/*.js", "a/b.js", True), ("a/*.js", "a/b/c.js", False),
    ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("x/", "x", False), ("x/", "q/x/y", True), ("*.min.js", "d/a.min.js", True), ("f?o", "foo", True), ("[!a]b", "ab", False), (r"\#x", "#x", True)])
def test_ignore_patterns(spark, pattern, path, want):
    assert is_ignored(path, [pattern]) is want
    assert one(spark, ignored(F.lit(path), [pattern])) is want


def test_ignore_negation_and_comments():
    rules = ["# c", "", "*.json", "!keep.json"]
    assert len(compile_patterns(rules)) == 2
    assert is_ignored("a.json", rules) and not is_ignored("b/keep.json", rules)


def test_requests():
    assert [rq.coerce_top_k(x) for x in (None, 0, "x", -5, 500, "7", 2.5)] == [100, 100, 100, 1, 100, 7, 2.5]
    with pytest.raises(rq.RequestError):
        rq.strict_top_k(0)
    assert rq.parse_search({"query": "a"}).min_score_diff == 0.1
    assert rq.parse_search({"query": "a", "min_score": "0.7"}).min_score_diff is None
    assert rq.parse_search({"query": "a", "module": "", "language": "ts"}).filters == {"language": "ts"}
    for bad in ({}, {"query": ""}, {"query": 5}, {"query": "a", "min_score": 2}, {"query": "a", "min_score": 0, "min_score_diff": 0}, {"query": "a", "include": ["x"]}, {"query": "a", "format": "xml"}):
        with pytest.raises(rq.RequestError):
            rq.parse_search(bad)
    assert rq.parse_ids("1, 2,,2") == [1, 2, 2] and rq.parse_ids(["1,3", "1"], distinct=True) == [1, 3]
    for bad in ("1,x", "0", "", "-1"):
        with pytest.raises(rq.RequestError):
            rq.parse_ids(bad)


def test_top_k_batch_works_through_many_queries(spark, monkeypatch):
    from corvane.operators import search

    rows = [(k, [float(k % 7 - 3), float(k % 5 - 2), 1.0]) for k in range(30)]
    collection = spark.createDataFrame(rows, "id long, embedding array<float>")
    queries = collection.select(F.col("id").alias("query_id"), "embedding")
    whole = sorted(map(tuple, search.top_k_batch(collection, queries, 4).select("query_id", "id", "rank", "score").collect()))
    monkeypatch.setattr(search, "MAX_BATCH", 7)
    assert sorted(map(tuple, search.top_k_batch(collection, queries, 4).select("query_id", "id", "rank", "score").collect())) == whole
    assert len(whole) == 120 and search.top_k_batch(collection, queries.limit(0), 4).count() == 0
