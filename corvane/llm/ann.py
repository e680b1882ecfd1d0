"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised separately; a pair of centroids names a cell.  A
query visits cells by falling sum of its inner products with the two centroids, taken from
a heap, until the cells hold its budget of entries, and the entries are reranked exactly.
Near cells lie in one block of entries, a large cell in several; a query goes to the blocks
of the cells that it visits and to no other.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bound_batches, stage, unstage
from .shingles import mix

#: Least and most rows of a block of entries, about, and most queries that meet a block in one task.
LEAST_ENTRIES, MOST_ENTRIES, QUERY_BLOCK = 4_096, 100_000, 20_000
#: Queries scored at once within a task.
SCORED = 256
#: Scores nearer than this are compared again from row-wise sums.
SLACK = 1e-9


def usable(vector: Column) -> Column:
    """True for a vector that is not null, empty or zero and has finite components only."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(finite & F.exists(x, lambda v: v != 0), F.lit(False))


def _kmeans(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Lloyd's algorithm from evenly spaced distinct rows; deterministic for given rows."""
    first = np.unique(x, axis=0)
    centres = first[np.linspace(0, len(first) - 1, min(k, len(first))).astype(int)].copy()
    for _ in range(rounds):
        near = nearest(x, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centres))
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.argmin((centres ** 2).sum(axis=1) - 2 * x @ centres.T, axis=1)


@dataclass(frozen=True)
class MultiIndex:
    """Codebooks, entries per cell and the share of all entries that a query visits."""

    left: np.ndarray
    right: np.ndarray
    counts: np.ndarray  # left x right
    share: float = 1.0
    first: np.ndarray | None = None  # per cell its first block, and in how many its entries lie
    parts: np.ndarray | None = None

    def placed(self, size: int) -> MultiIndex:
        """With blocks of about ``size`` entries: cells in the order of their centroids, so that near cells share blocks."""
        def along(centres: np.ndarray) -> np.ndarray:
            shifted = centres - centres.mean(axis=0)
            return np.argsort(shifted @ np.linalg.svd(shifted, full_matrices=False)[2][0], kind="stable") if len(centres) > 1 and centres.shape[1] else np.arange(len(centres))

        order = (along(self.left)[:, None] * len(self.right) + along(self.right)[None, :]).ravel()
        n = self.counts.ravel()[order]
        large = n > size
        parts = np.where(large, -(-n // size), 1)
        before = np.cumsum(np.where(large, 0, n)) - np.where(large, 0, n)
        shared = int(before[-1] // size) + 1
        own = shared + np.cumsum(np.where(large, parts, 0)) - np.where(large, parts, 0)
        first, count = np.empty(len(n), np.int64), np.empty(len(n), np.int64)
        first[order], count[order] = np.where(large, own, before // size), parts
        return replace(self, first=first, parts=count)

    def cells(self, x: np.ndarray) -> np.ndarray:
        h = self.left.shape[1]
        return nearest(x[:, :h], self.left) * len(self.right) + nearest(x[:, h:], self.right)

    def visit(self, query: np.ndarray, budget: float) -> tuple[list[int], list[int], float]:
        """Cells in falling order of summed centroid products until ``budget`` entries, entries so far at each, and the last sum."""
        h = self.left.shape[1]
        a, b = self.left @ query[:h], self.right @ query[h:]
        oa, ob = np.argsort(-a, kind="stable"), np.argsort(-b, kind="stable")
        a, b = a[oa].tolist(), b[ob].tolist()
        heap, pushed, cells, seen, total, last = [(-a[0] - b[0], 0, 0)], {(0, 0)}, [], [], 0, np.inf
        while heap and total < budget:
            last, i, j = heapq.heappop(heap)
            if n := int(self.counts[oa[i], ob[j]]):
                total += n
                cells.append(int(oa[i]) * len(b) + int(ob[j]))
                seen.append(total)
            for x, y in ((i + 1, j), (i, j + 1)):
                if x < len(a) and y < len(b) and (x, y) not in pushed:
                    pushed.add((x, y))
                    heapq.heappush(heap, (-a[x] - b[y], x, y))
        return cells, seen, -last

    def sums(self, queries: np.ndarray, cells: np.ndarray) -> np.ndarray:
        """Per query and cell the summed products with the cell's two centroids."""
        h, n = self.left.shape[1], len(self.right)
        return (queries[:, :h] @ self.left.T)[:, cells // n] + (queries[:, h:] @ self.right.T)[:, cells % n]


def _unpack(blobs: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1) if blobs else np.zeros((0, 0))


def _packed(embeddings: DataFrame) -> DataFrame:
    """vec_id and vec (float64 bytes) of the rows that take part."""
    clean = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("e")).filter(F.col("vec_id").isNotNull() & usable(F.col("e")))

    def run(batches):
        for batch in batches:
            column = batch.column("e")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False), np.asarray(column.offsets) - column.offsets[0].as_py()
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array([flat[s:e].tobytes() for s, e in zip(ends, ends[1:])], pa.binary())], names=["vec_id", "vec"])

    return clean.mapInArrow(run, "vec_id long, vec binary")


def build(embeddings: DataFrame, *, sample: int = 20_000, per_cell: int = 64) -> tuple[MultiIndex, DataFrame]:
    """Codebooks from the ``sample`` rows of smallest hashed id, and the index of every row: vec_id, vec, cell.

    Rows of another dimension than the commonest take no part.
    """
    spark = embeddings.sparkSession
    bound_batches(spark)
    packed = stage(_packed(embeddings), "vectors")
    widths = packed.groupBy(F.length("vec").alias("w")).count().orderBy(F.desc("count"), "w").first()
    width, n = (widths["w"], widths["count"]) if widths else (16, 0)
    packed_one = packed.filter(F.length("vec") == width)
    rows = packed_one.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").collect()
    x = _unpack([bytes(r["vec"]) for r in rows]).reshape(len(rows), width // 8)
    h, k = x.shape[1] // 2, int(np.clip(np.ceil(np.sqrt(n / per_cell)), 1, 1024))
    if not len(x):
        return MultiIndex(np.zeros((1, h)), np.zeros((1, width // 8 - h)), np.zeros((1, 1), np.int64)), packed_one.withColumn("cell", F.lit(0))
    model = MultiIndex(_kmeans(x[:, :h], k), _kmeans(x[:, h:], k), np.zeros((1, 1), np.int64))
    shared = spark.sparkContext.broadcast(model)

    def assign(batches):
        for batch in batches:
            cells = shared.value.cells(_unpack(batch.column("vec").to_pylist())) if batch.num_rows else []
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.int32())], names=["vec_id", "vec", "cell"])

    index = stage(packed_one.mapInArrow(assign, "vec_id long, vec binary, cell int"), "multi-index")
    unstage(packed)
    counts = np.zeros((len(model.left), len(model.right)), np.int64)
    for r in index.groupBy("cell").count().collect():  # at most 1024 x 1024 cells
        counts[r["cell"] // len(model.right), r["cell"] % len(model.right)] = r["count"]
    return MultiIndex(model.left, model.right, counts), index


def _top(ids: list[np.ndarray], scores: np.ndarray, vectors: np.ndarray, query: np.ndarray, own: int, k: int) -> list[tuple[float, int]]:
    """The k best (score, id) but ``own``: distinct vectors by score, their ids ascending; ties by exact row-wise sums."""
    live = np.flatnonzero(scores > -np.inf)
    if len(live) > k + 1:
        cut = np.partition(scores[live], len(live) - k - 1)[len(live) - k - 1]
        live = live[scores[live] >= cut - SLACK]
    exact = (vectors[live] * query).sum(axis=1)
    found = [(float(s), i) for d, s in zip(live.tolist(), exact, strict=True) for i in ids[d].tolist() if i != own]
    return sorted(found, key=lambda f: (-f[0], f[1]))[:k]


def _with_blocks(asked: DataFrame, model: MultiIndex) -> DataFrame:
    """block, query_id, qvec, reach: each query at the blocks that hold a cell it visits, and the centroid sum down to which its heap went for its budget."""
    shared = asked.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            model, rows = shared.value, []
            budget = model.share * model.counts.sum()
            for name, raw in zip(batch.column("query_id").to_pylist(), batch.column("qvec").to_pylist(), strict=True):
                cells, _, reach = model.visit(np.frombuffer(raw, np.float64), budget)
                first, parts = model.first[cells], model.parts[cells]
                at = np.unique(np.repeat(first, parts) + np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
                rows += [(b, name, raw, reach) for b in at.tolist()]
                if len(rows) > 10_000:
                    yield told(rows)
                    rows = []
            yield told(rows)

    def told(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.float64())
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["block", "query_id", "qvec", "reach"])

    return asked.select("query_id", "qvec").mapInArrow(run, "block long, query_id long, qvec binary, reach double")


def _in_blocks(index: DataFrame, model: MultiIndex) -> DataFrame:
    """The index with the block of each entry."""
    shared = index.sparkSession.sparkContext.broadcast((model.first, model.parts))

    def run(batches):
        for batch in batches:
            first, parts = shared.value
            cell, ids = batch.column("cell").to_numpy(), batch.column("vec_id").to_numpy().astype(np.int64)
            block = first[cell] + (mix(ids.view(np.uint64)) % parts[cell].astype(np.uint64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(block, pa.int64())], names=["vec_id", "vec", "cell", "block"])

    return index.select("vec_id", "vec", "cell").mapInArrow(run, "vec_id long, vec binary, cell int, block long")


def _found(index: DataFrame, asked: DataFrame, model: MultiIndex, k: int) -> DataFrame:
    """query_id, vec_id, score: of each block each query's k best of the cells within its reach.

    Where more than QUERY_BLOCK queries come to a block, its entries are dealt to several tasks.
    """
    shared = index.sparkSession.sparkContext.broadcast(model)

    def pair(key, queries, entries):
        import pandas as pd

        model, out = shared.value, []
        if len(queries) and len(entries):
            entries = entries.sort_values(["cell", "vec", "vec_id"])
            raw = entries["vec"].tolist()
            first = [0] + [i for i in range(1, len(raw)) if raw[i] != raw[i - 1]]
            all_ids, ends = entries["vec_id"].to_numpy(), first[1:] + [len(raw)]
            # equal vectors tie, and of equals only the smallest ids can be among the k best
            ids = [np.sort(all_ids[s:e])[:k + 1] for s, e in zip(first, ends, strict=True)]
            vectors, cells = _unpack([raw[i] for i in first]), entries["cell"].to_numpy()[first]
            held, starts = np.unique(cells, return_index=True)
            bounds = [*starts.tolist(), len(cells)]
            names, asked, reach = queries["query_id"].tolist(), _unpack(queries["qvec"].tolist()), queries["reach"].to_numpy()
            for at in range(0, len(names), SCORED):
                part = asked[at:at + SCORED]
                scores = np.full((len(part), len(vectors)), -np.inf)
                within = model.sums(part, held) >= reach[at:at + SCORED, None] - SLACK
                if within.all():
                    scores = part @ vectors.T
                else:
                    for c, (s, e) in enumerate(zip(bounds, bounds[1:])):
                        qs = np.flatnonzero(within[:, c])
                        if len(qs):
                            scores[qs, s:e] = part[qs] @ vectors[s:e].T
                for q, vector in enumerate(part):
                    name = names[at + q]
                    out += [(name, i, s) for s, i in _top(ids, scores[q], vectors, vector, name, k)]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    visits = stage(_with_blocks(asked, model), "visits")
    demand = stage(visits.groupBy("block").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).cast("int").alias("deals")), "demand")
    left = visits.join(demand, "block").withColumn("deal", F.pmod(F.xxhash64("query_id"), F.col("deals")).cast("int")).groupBy("block", "deal")
    right = _in_blocks(index, model).join(demand, "block").withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).drop("deals").groupBy("block", "deal")
    return left.cogroup(right).applyInPandas(pair, "query_id long, vec_id long, score double")


def _best(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def tuned(index: DataFrame, asked: DataFrame, model: MultiIndex, *, k: int, target: float, tuning: int) -> MultiIndex:
    """The model with the smallest share at which ``tuning`` queries, searched exactly against every entry, find ``target`` of their true neighbours."""
    spark = index.sparkSession
    rows = asked.orderBy(F.xxhash64("query_id"), "query_id").limit(tuning).collect()  # at most ``tuning`` vectors
    if not rows:
        return model
    names, vectors = [r["query_id"] for r in rows], _unpack([bytes(r["qvec"]) for r in rows])
    shared = spark.sparkContext.broadcast((names, vectors, model))

    def exact(batches):
        names, vectors, _ = shared.value
        best = [[] for _ in names]
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, cells = batch.column("vec_id").to_numpy(), batch.column("cell").to_numpy()
            scores = vectors @ _unpack(batch.column("vec").to_pylist()).T
            for q, own in enumerate(names):
                at = np.argpartition(scores[q], max(0, len(ids) - k - 1))[-k - 1:]
                best[q] = sorted(best[q] + [(-scores[q, i], int(ids[i]), int(cells[i])) for i in at.tolist() if ids[i] != own])[:k]
        out = [(own, i, -s, c) for own, found in zip(names, best, strict=True) for s, i, c in found]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate(kinds)], names=["query_id", "vec_id", "score", "cell"])

    def needs(batches):
        names, vectors, model = shared.value
        at, total = {n: i for i, n in enumerate(names)}, model.counts.sum()
        for batch in batches:
            out = []
            for name, cells in zip(batch.column("query_id").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                seen = dict(zip(*model.visit(vectors[at[name]], np.inf)[:2], strict=True))
                out += [seen[c] / total for c in cells]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], names=["need"])

    true = _best(index.mapInArrow(exact, "query_id long, vec_id long, score double, cell int"), k)
    needed = true.groupBy("query_id").agg(F.collect_list("cell").alias("cells")).mapInArrow(needs, "need double")
    found = [r["need"] for r in needed.collect()]  # at most ``tuning`` times k numbers
    return replace(model, share=float(np.quantile(found, target)) if found else 1.0)


def search(embeddings: DataFrame, queries: Column, *, k: int = 20, target: float = 0.96, tuning: int = 200, **params) -> DataFrame:
    """query_id, rank, vec_id, score: the k entries found nearest to each row where ``queries`` holds.

    Nearness is the largest inner product, in double precision; ties go to the smaller id; a
    query's own id is no candidate.  Rows that share a query's id are one query (the vector
    whose bytes are smallest) and each stay entries.  The visited share is the smallest at
    which ``tuning`` queries, searched exactly against every entry, would find the share
    ``target`` of their true neighbours.  Vectors that are null, empty or zero, that hold a
    null or a non-finite component, or that have another length than the commonest take no
    part, and neither does a row without an id; an empty table gives an empty result; other
    columns are ignored, whatever their names.
    """
    embeddings = embeddings.select("vec_id", "embedding")
    model, index = build(embeddings, **params)
    total = int(model.counts.sum())
    asked = stage(index.filter(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vec").alias("qvec")), "queries")
    model = tuned(index, asked, model, k=k, target=target, tuning=tuning)
    model = model.placed(int(np.clip(total // 64, LEAST_ENTRIES, MOST_ENTRIES)))
    return _best(_found(index, asked, model, k), k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
