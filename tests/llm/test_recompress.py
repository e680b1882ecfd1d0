"""Removal of repeated word windows against brute force."""

import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corvane.llm import recompress, words

from .data import documents, empty, prose, texts

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = (1 << 63) - 1


def brute(rows, width=13):
    cut = [(LAST if i is None else i, WORD.findall(t or "")) for i, t in rows]
    owner = {}
    for i, w in cut:
        for k in range(len(w) - width + 1):
            key = tuple(w[k:k + width])
            owner[key] = min(owner.get(key, i), i)
    out = []
    for (i, _), (own, w) in zip(rows, cut, strict=True):
        gone = {p for k in range(len(w) - width + 1) if owner[tuple(w[k:k + width])] < own for p in range(k, k + width)}
        kept = " ".join(x for p, x in enumerate(w) if p not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def got(df):
    return sorted((str(r[0]), r[1], r[2], r[3]) for r in df.collect())


def check(spark, rows, parts=5):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts)
    assert got(recompress.remove_repeats(docs)) == brute(rows)


def test_windows_match_brute_force(spark):
    docs = documents(spark)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert got(recompress.remove_repeats(docs)) == brute(rows)
    assert recompress.remove_repeats(empty(spark, docs)).count() == 0


@pytest.mark.parametrize("many", [0, 16])
def test_windows_with_tiny_blocks(spark, monkeypatch, many):
    for name, value in {"HELD": 40, "PER_GROUP": 50, "BUCKET_BYTES": 3000, "MANY": many, "PIECE": 37}.items():
        monkeypatch.setattr(recompress, name, value)
    monkeypatch.setattr(words, "BLOCK", 200)
    rnd = random.Random(5)
    rows = [(k * 7 % 211, t) for k, t in enumerate(texts(5, 25))]
    passage = prose(rnd, 60)
    rows += [(300 + k, f"{prose(rnd, rnd.randrange(20))} {passage} {prose(rnd, rnd.randrange(20))}") for k in range(30)]
    rows += [(400 + k, "x " * rnd.randrange(5, 40) + "y z " * rnd.randrange(3, 30) + "a b c " * rnd.randrange(9)) for k in range(12)]
    rows += [(500, " ".join(prose(rnd, 200).split()) + " " + passage), (501, "w" * 1000 + " " + passage), (502, "w" * 1000 + " " + passage), (7, passage), (7, passage)]
    check(spark, rows)


def test_many_copies_and_hot_windows(spark):
    rnd = random.Random(8)
    whole, line = prose(rnd, 200), prose(rnd, 13)
    rows = [(k, whole) for k in range(300)] + [(1000 + k, f"{prose(rnd, 15)} {line} {prose(rnd, 15)}") for k in range(300)]
    rnd.shuffle(rows)
    check(spark, rows)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 3), min_size=13, max_size=60), st.lists(st.integers(0, 3), max_size=20), st.lists(st.integers(0, 3), max_size=20), st.integers(2, 200))
def test_equal_windows_have_equal_keys(inner, before, after, vocabulary):
    """A window has the same key wherever it stands, so no repeat is missed."""
    rnd = random.Random(sum(inner) + vocabulary)
    inner = [x if rnd.random() < 0.5 else rnd.randrange(vocabulary) for x in inner]
    hashes = words.mix(np.arange(1, 300, dtype=np.uint64))

    def keys(seq, bounds):
        key, _, first, last = recompress.window_runs(hashes[np.array(seq, np.int64)], np.array(bounds))
        return {w: k for k, a, b in zip(key.tolist(), first.tolist(), last.tolist()) for w in range(a, b + 1)}

    alone = keys(inner, [0, len(inner)])
    placed = keys(before + inner + after, [0, len(before) + len(inner) + len(after)])
    apart = keys(before + inner + after, [0, len(before), len(before) + len(inner), len(before) + len(inner) + len(after)])
    for w in range(len(inner) - 12):
        assert alone[w] == placed[w + len(before)] == apart[w + len(before)]


def test_symbols_of_prose_are_shared_by_windows():
    hashes = words.mix(np.random.default_rng(3).integers(0, 5000, 20_000, dtype=np.uint64))
    key, _, first, last = recompress.window_runs(hashes, np.array([0, len(hashes)]))
    assert len(key) < len(hashes) / 3  # a symbol stands for more than three windows
    name, start, end, lo, hi = recompress.symbols(hashes, np.array([0, len(hashes)]))
    assert (end - start).max() <= max(recompress.LONGEST, np.diff(np.flatnonzero(np.diff(hashes) != 0), prepend=-1).max()) and (end - start).mean() > 1.8
    assert (lo <= start).all() and (hi >= end).all()


def test_long_words_and_blocks(monkeypatch):
    import pyarrow as pa

    text = "ab " * 500 + "Q" * 900 + " " + "cd\t" * 400
    table, values = words.in_words(recompress.SEPARATORS), words.byte_values(fold=False)
    whole = next(words.words_of(pa.array([text]), table, values))
    monkeypatch.setattr(words, "BLOCK", 64)
    cut = next(words.words_of(pa.array([text]), table, values))
    assert (whole.starts == cut.starts).all() and (whole.ends == cut.ends).all()
    assert [w for w in cut.hashes[:500]] == [whole.hashes[0]] * 500 and cut.hashes[501] == whole.hashes[501]
