"""Ranked search over wavelet trees against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvane.llm import ranked, words

from .data import documents, empty, prose, texts

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms_of(text):
    return TERM.findall((text or "").translate(LOWER))


def brute(rows, items, k=10):
    docs = [(i, Counter(terms_of(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, total = len(docs), sum(n for _, _, n in docs)
    df = Counter(t for _, c, _ in docs for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c, n in docs:
            m = 100 - 90 + (90 * n * n_docs) // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms_of(text)) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(str(item), rank + 1, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(scored)[:k])]
    return sorted(map(str, out))


def got(df):
    return sorted(str((str(r["item_id"]), r["rank"], r["doc_id"], r["score"])) for r in df.collect())


def asked(rnd, rows):
    some = [" ".join((t or "").split()[:rnd.randrange(1, 30)]) for _, t in rnd.sample(rows, 12)]
    return [(k, t) for k, t in enumerate(some)] + [(90, None), (91, ""), (92, "--"), (93, "THE Of the"), (94, "nowhere found"), (None, "über STRASSE the"), (93, "THE Of the"), (95, prose(rnd, 200))]


def test_ranks_match_brute_force(spark):
    rnd = random.Random(4)
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    items = asked(rnd, rows)
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1)).withColumn("score", F.lit("x"))
    assert got(ranked.rank_documents(docs, bench)) == brute(rows, items)
    assert got(ranked.rank_documents(docs, bench, k=1)) == brute(rows, items, 1)
    assert ranked.rank_documents(empty(spark, docs), bench).count() == 0
    assert ranked.rank_documents(docs, empty(spark, bench)).count() == 0


@pytest.mark.parametrize(("postings", "docs_each", "query_bytes"), [(40, 7, 1 << 20), (5, 1, 200), (1 << 20, 3, 90)])
def test_ranks_in_small_shards_and_blocks_of_queries(spark, monkeypatch, postings, docs_each, query_bytes):
    for name, value in {"SHARD_POSTINGS": postings, "SHARD_DOCS": docs_each, "QUERY_BYTES": query_bytes}.items():
        monkeypatch.setattr(ranked, name, value)
    monkeypatch.setattr(words, "BLOCK", 300)
    rnd = random.Random(6)
    rows = [(k * 5 % 97, t) for k, t in enumerate(texts(6, 18))] + [(200 + k, "same words here") for k in range(30)]
    rnd.shuffle(rows)
    items = [*asked(rnd, rows), (96, "same words here")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert got(ranked.rank_documents(frame, spark.createDataFrame(items, "item_id long, text string"))) == brute(rows, items)


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 40), st.integers(1, 8), st.integers(0, 10_000), st.integers(1, 12))
def test_a_search_gives_what_a_sort_gives(docs, terms, seed, k):
    rnd = np.random.default_rng(seed)
    full = np.argwhere(rnd.random((terms, docs)) < rnd.random())
    term, doc = full[:, 0], full[:, 1]
    impacts = rnd.integers(0, 6, len(term))
    tree = ranked.build(term, doc, impacts, terms, docs)
    weights = rnd.integers(0, 4, terms)
    scores = np.zeros(docs, np.int64)
    np.add.at(scores, doc, impacts * weights[term])
    want = sorted(((-int(s), d) for d, s in enumerate(scores) if s > 0))[:k]
    assert [(-s, d) for s, d in ranked.search(tree, np.arange(terms), weights, k)] == want


def test_a_search_opens_few_nodes():
    """A document that beats all others is found without walking the tree."""
    rnd = np.random.default_rng(1)
    docs, opened = 4096, []
    term, doc = np.repeat(np.arange(3), docs), np.tile(np.arange(docs), 3)
    impacts = rnd.integers(1, 50, len(doc))
    impacts[doc == 1234] = 10_000
    tree = ranked.build(term, doc, impacts, 3, docs)

    class Counted(np.ndarray):
        def __getitem__(self, key):
            if isinstance(key, tuple) and isinstance(key[0], np.ndarray) and key[0].ndim == 3:
                opened.append(len(key[0]))
            return super().__getitem__(key)

    counted = ranked.Tree(tree.zeros, tree.impacts.view(Counted), tree.start, tree.end)
    assert ranked.search(counted, np.arange(3), np.ones(3, np.int64), 1) == [(30_000, 1234)]
    assert sum(opened) < docs // 8  # nodes; the tree has 2 * docs
