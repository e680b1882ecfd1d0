"""Exact ranked retrieval over dual-sorted wavelet trees, one tree in each shard of documents.

A shard concatenates the posting lists of the query terms, each by falling impact, into one
sequence of documents, and stores it as a wavelet tree.  Every level parts the sequence by one
bit of the document's number and keeps its order otherwise, so each list is there by impact and
can be walked by document as well: the part of a list inside a node (a range of documents) is a
range of positions, and its first element has the largest impact there.  The weighted sum of
these first impacts bounds the score of every document of the node, and is the score in a leaf.
A search takes the nodes best first, until no open node can beat the last of the results.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bound_batches, lean, stage
from .decontam import words_of as terms_of
from .words import byte_values, in_words, words_of

#: The ASCII characters between terms.
SEPARATORS = "".join(c for c in map(chr, range(128)) if not c.isalnum())
#: Postings and documents of one shard; text bytes of the queries that are told to all tasks at once.
SHARD_POSTINGS, SHARD_DOCS, QUERY_BYTES = 1 << 20, 1 << 15, 4 << 20
#: Nodes that a search opens at once.
WIDEST = 64

_INSIDE, _VALUES = in_words(SEPARATORS), byte_values(fold=True)


def impact(tf: np.ndarray, n: np.ndarray, documents: int, total: int) -> np.ndarray:
    """What one posting adds to a score, before the term's weight."""
    m = 100 - 90 + (90 * n.astype(np.int64) * documents) // max(total, 1)
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def weight(documents: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


@dataclass(frozen=True)
class Tree:
    """A wavelet tree: per level and position the zeros before it, and the impact that stands there; per term its range at the root."""

    zeros: np.ndarray
    impacts: np.ndarray
    start: np.ndarray
    end: np.ndarray

    @property
    def depth(self) -> int:
        return len(self.zeros)


def build(term: np.ndarray, doc: np.ndarray, impacts: np.ndarray, terms: int, docs: int) -> Tree:
    """The tree of postings (term, doc, impact); documents are numbered from 0."""
    order = np.lexsort((doc, -impacts, term))
    sorted_terms, doc, value = term[order], doc[order].astype(np.int64), impacts[order].astype(np.int32)
    depth, n = max(int(docs - 1).bit_length(), 1), len(doc)
    zeros, values = np.zeros((depth, n + 1), np.int32), np.zeros((depth + 1, n + 1), np.int32)
    for level in range(depth):
        zero = (doc >> (depth - 1 - level)) & 1 == 0
        np.cumsum(zero, out=zeros[level, 1:])
        values[level, :n] = value
        parted = np.concatenate([np.flatnonzero(zero), np.flatnonzero(~zero)])
        doc, value = doc[parted], value[parted]
    values[depth, :n] = value
    every = np.arange(terms)
    return Tree(zeros, values, np.searchsorted(sorted_terms, every), np.searchsorted(sorted_terms, every, side="right"))


def search(tree: Tree, terms: np.ndarray, weights: np.ndarray, k: int) -> list[tuple[int, int]]:
    """(score, document) of the k best documents with a score above 0, equal scores by ascending document."""
    held = (tree.end[terms] > tree.start[terms]) & (weights > 0)
    terms, weights = terms[held], weights[held].astype(np.int64)
    if not len(terms):
        return []
    starts, ends = tree.start[terms][None].astype(np.int32), tree.end[terms][None].astype(np.int32)
    pool_s, pool_e = [starts], [ends]
    first = int((weights * tree.impacts[0, starts[0]]).sum())
    open_: list[tuple[int, int, int, int, int]] = [(-first, 0, 0, 0, 0)]  # (-bound, first document, level, block, row)
    best: list[tuple[int, int]] = []  # the least on top: (score, -document)
    width = 1
    while open_:
        taken = []
        while open_ and len(taken) < width:
            if len(best) == k and (-open_[0][0], -open_[0][1]) < best[0]:
                break
            taken.append(heapq.heappop(open_))
        if not taken:
            break
        width = min(2 * width, WIDEST)
        level = np.array([t[2] for t in taken])[:, None]
        s, e = (np.stack([pool[t[3]][t[4]] for t in taken]) for pool in (pool_s, pool_e))
        low_s, low_e = tree.zeros[level, s], tree.zeros[level, e]
        split = tree.zeros[level, -1]
        child_s = np.stack([low_s, split + s - low_s], 1)
        child_e = np.stack([low_e, split + e - low_e], 1)
        found = child_e > child_s
        bounds = (np.where(found, tree.impacts[level[:, :, None] + 1, child_s], 0) * weights).sum(axis=2)
        pool_s.append(child_s.reshape(-1, len(terms)))
        pool_e.append(child_e.reshape(-1, len(terms)))
        for row, (_, low, at, _, _) in enumerate(taken):
            for side in (0, 1):
                bound = int(bounds[row, side])
                if bound <= 0:
                    continue
                doc = low + (side << (tree.depth - 1 - at))
                if len(best) == k and (bound, -doc) < best[0]:
                    continue
                if at + 1 < tree.depth:
                    heapq.heappush(open_, (-bound, doc, at + 1, len(pool_s) - 1, 2 * row + side))
                elif len(best) < k:
                    heapq.heappush(best, (bound, -doc))
                else:
                    heapq.heappushpop(best, (bound, -doc))
    return [(score, -doc) for score, doc in sorted(best, reverse=True)]


def hashed_terms(terms: list[str]) -> np.ndarray:
    """64-bit digests of single terms, as documents have them."""
    out = [words.hashes for words in words_of(pa.array(terms, pa.string()), _INSIDE, _VALUES)]
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """doc_id, n (terms of the document), terms and tfs (of the sorted digests ``vocabulary``, by place) of each document that has terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))])

    def run(batches):
        sought = shared.value
        for batch in batches:
            ids = batch.column("doc_id")
            for words in words_of(batch.column("text"), _INSIDE, _VALUES):
                n = np.diff(words.bounds)
                if not len(words.hashes):
                    continue
                at = np.minimum(np.searchsorted(sought, words.hashes), max(len(sought) - 1, 0))
                hit = np.flatnonzero(sought[at] == words.hashes) if len(sought) else np.zeros(0, np.int64)
                row = np.searchsorted(words.bounds, hit, side="right") - 1
                key, tf = np.unique(row * max(len(sought), 1) + at[hit], return_counts=True)
                row, term = np.divmod(key, max(len(sought), 1))
                ends = np.searchsorted(row, np.arange(len(n) + 1)).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(ends), pa.array(x.astype(np.int32))) for x in (term, tf)]
                out = pa.RecordBatch.from_arrays([ids.slice(words.first, len(n)).cast(pa.int64()), pa.array(n.astype(np.int64)), *lists], schema=schema)
                yield out.filter(pa.array(n > 0))

    return docs.mapInArrow(lean(run), "doc_id long, n long, terms array<int>, tfs array<int>")


def _shard_hits(index: DataFrame, asked: list[tuple[np.ndarray, np.ndarray]], terms: int, documents: int, total: int, k: int) -> DataFrame:
    """item, doc_id, score: the k best of each shard for each item; ``asked`` has the terms and weights of each."""
    shared = index.sparkSession.sparkContext.broadcast(asked)

    def answer(held: list[pa.RecordBatch]):
        table = pa.Table.from_batches(held).sort_by("doc_id").combine_chunks()  # a null id is last
        lists = [table.column(c).combine_chunks() for c in ("terms", "tfs")]
        lists = [x if isinstance(x, pa.ListArray) else pa.concat_arrays(x.chunks) for x in lists]
        n = table.column("n").to_numpy()
        sizes = np.diff(lists[0].offsets.to_numpy())
        doc = np.repeat(np.arange(len(n)), sizes)
        term, tf = (x.flatten().to_numpy() for x in lists)
        tree = build(term, doc, impact(tf, n[doc], documents, total), terms, len(n))
        found = [(item, d, s) for item, (t, w) in enumerate(shared.value) for s, d in search(tree, t, w, k)]
        ids = table.column("doc_id").take(pa.array([d for _, d, _ in found], pa.int64())).combine_chunks()
        ids = ids if isinstance(ids, pa.Array) else pa.concat_arrays(ids.chunks)
        return pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), ids, pa.array([f[2] for f in found], pa.int64())], names=["item", "doc_id", "score"])

    def run(batches):
        held, n, docs = [], 0, 0
        for batch in batches:
            size = np.diff(batch.column("terms").offsets.to_numpy())
            at = 0
            while at < len(size):
                room = np.searchsorted(n + np.cumsum(size[at:]), SHARD_POSTINGS, side="right")
                take = int(min(max(room, not docs), SHARD_DOCS - docs, len(size) - at))
                if take:
                    held.append(batch.slice(at, take))
                    n, docs, at = n + int(size[at:at + take].sum()), docs + take, at + take
                if at < len(size) or docs >= SHARD_DOCS:
                    yield answer(held)
                    held, n, docs = [], 0, 0
        if held:
            yield answer(held)

    return index.mapInArrow(lean(run), "item long, doc_id long, score long")


def _answered(docs: DataFrame, rows: list, k: int) -> DataFrame:
    """item, rank, doc_id and score of the best documents for each of ``rows`` (terms)."""
    terms = sorted({t for r in rows for t in r["terms"]})
    digests = hashed_terms(terms)
    order = np.argsort(digests)
    place = dict(zip((terms[i] for i in order), range(len(terms)), strict=True))
    index = stage(postings(docs, digests[order]), "postings")
    sums = index.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = dict(index.select(F.explode("terms").alias("t")).groupBy("t").count().collect())  # as many as the queries have terms
    weights = np.array([weight(sums[0], df[i]) if i in df else 0 for i in range(len(terms))], np.int64)
    asked = [(at := np.array(sorted(place[t] for t in set(r["terms"])), np.int64), weights[at]) for r in rows]
    hits = _shard_hits(index, asked, len(terms), sums[0], sums[1], k)
    best = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return hits.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def rank_documents(docs: DataFrame, items: DataFrame, *, k: int = 10) -> DataFrame:
    """item_id, rank, doc_id and score of each item's ``k`` best documents with a score above 0.

    Equal scores go by ascending doc_id, a null id last; an item without terms, or none of whose
    terms is in a document, has no rows; every row of ``items`` is an item and every row of
    ``docs`` a document, repeated ones as well; null and empty texts have no terms and count
    nowhere; an empty table on either side gives an empty result; other columns are ignored,
    whatever their names.  Terms are told apart by 64-bit digests.  The queries are told to all
    tasks, as many at once as QUERY_BYTES of text hold on average; more take more passes.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    blocks = max(-(-size // QUERY_BYTES), 1)
    some = items.select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"), F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)).alias("block"))
    asked, found = stage(some.filter(F.size("terms") > 0), "queries"), []
    named = T.StructType([T.StructField("item", T.LongType()), items.schema["item_id"]])
    for block in range(blocks):
        rows = asked.filter(F.col("block") == block).collect()
        names = spark.createDataFrame([(i, r["item_id"]) for i, r in enumerate(rows)], T.StructType([named["item"], T.StructField("item_id", named["item_id"].dataType)]))
        hits = _answered(docs, rows, k).join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
        found.append(hits if blocks == 1 else stage(hits, "ranked"))
    return reduce(DataFrame.unionByName, found)
