"""Approximate search over cells of a collection: a flat index in each cell of a quantiser.

Large cells are split once more, so that a cell holds CELL_ROWS rows or so.  How many cells a
query visits is measured, not assumed: held queries are searched exactly, and the least number
of nearest cells is taken that holds TARGET of their true neighbours.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vector import matrix
from .search import meet, top_k, top_k_batch

#: Cells of the first level, and the fewest that a query visits.
CELLS, PROBES = 128, 16
#: Rows of a cell from which it is split, rows that the cells are fitted on, and fewest of these in a cell that is split off.
CELL_ROWS, SAMPLE, LEAST = 20_000, 20_000, 8
#: Queries that tune the index, neighbours of each, and the share of these that the visited cells must hold.
HELD, NEIGHBOURS, TARGET = 200, 20, 0.95


@dataclass(frozen=True)
class CellIndex:
    """Unit-length centroids, the cells a query visits, and what was measured on held queries: recall, and the share of rows visited."""

    centroids: np.ndarray
    probes: int = PROBES
    recall: float | None = None
    share: float | None = None

    def ranked(self, queries: np.ndarray) -> np.ndarray:
        """Cells by nearness to each query."""
        return np.argsort(-(queries @ self.centroids.T), axis=1, kind="stable")

    def visits(self, query: list[float], probes: int | None = None) -> list[int]:
        return self.ranked(np.asarray(query, float)[None])[0, :self.probes if probes is None else probes].tolist()

    def save(self, spark: SparkSession, path: str) -> None:
        rows = [(self.centroids.tolist(), self.probes, self.recall, self.share)]
        spark.createDataFrame(rows, "centroids array<array<double>>, probes int, recall double, share double").coalesce(1).write.parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> CellIndex:
        row = spark.read.parquet(path).first()
        return cls(np.array(row["centroids"], float), row["probes"], row["recall"], row["share"])


def _means(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    """Spherical k-means of unit vectors, from distinct ones spread over their order."""
    distinct = np.unique(x, axis=0)
    c = distinct[np.linspace(0, len(distinct) - 1, min(cells, len(distinct))).astype(int)] if len(distinct) else x
    for _ in range(rounds if len(c) else 0):
        near = np.argmax(x @ c.T, axis=1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        length = np.linalg.norm(sums, axis=1)
        c = np.where(length[:, None] > 0, sums / np.where(length > 0, length, 1)[:, None], c)
    return c


def _unit(rows: list) -> np.ndarray:
    x = np.array([r[0] for r in rows], float)
    size = np.linalg.norm(x, axis=1) if len(x) else np.zeros(0)
    return x[size > 0] / size[size > 0, None] if len(x) else np.zeros((0, 1))


def fit_cells(collection: DataFrame, cells: int = CELLS, *, sample: int = SAMPLE, rows: int | None = None, key: str = "id") -> CellIndex:
    """Cells of the ``sample`` rows of smallest hashed key; with ``rows``, the size of the collection, those of more than CELL_ROWS are split."""
    x = _unit(collection.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(key), key).limit(sample).select("embedding").collect())
    first = _means(x, cells)
    if not rows or not len(first):
        return CellIndex(first)
    near, out = np.argmax(x @ first.T, axis=1), []
    for cell in range(len(first)):
        own = x[near == cell]
        parts = min(-(-len(own) * rows // (len(x) * CELL_ROWS)), len(own) // LEAST)
        out.append(_means(own, parts) if parts > 1 else first[cell:cell + 1])
    return CellIndex(np.concatenate(out))


def fit_index(collection: DataFrame, cells: int = CELLS, *, target: float = TARGET, key: str = "id") -> CellIndex:
    """Fitted cells, and as many visits as find ``target`` of the NEIGHBOURS nearest of HELD stored vectors (the largest hashed keys, which the cells weren't fitted on where there are more)."""
    index = fit_cells(collection, cells, rows=collection.count(), key=key)
    return tuned(collection, index, target=target, key=key) if len(index.centroids) else index


def tuned(collection: DataFrame, index: CellIndex, *, target: float = TARGET, key: str = "id") -> CellIndex:
    held = collection.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(key).desc(), key).limit(HELD).select(F.col(key).alias("query_id"), "embedding").dropDuplicates(["query_id"])
    held = held.sparkSession.createDataFrame(held.collect(), held.schema)  # HELD vectors
    placed = with_cells(collection.select(key, "embedding"), index)
    sizes = np.zeros(len(index.centroids))
    for cell, n in placed.groupBy("cell").count().collect():  # as many as there are cells
        sizes[cell] = n
    true = top_k_batch(placed, held, NEIGHBOURS, key=key).select("query_id", "cell").collect()  # HELD * NEIGHBOURS rows
    queries = {r["query_id"]: np.asarray(r["embedding"], float) for r in held.collect()}
    names = [q for q, v in queries.items() if np.any(v)]
    if not true or not names:
        return index
    order = index.ranked(np.array([queries[q] for q in names]))
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(order.shape[1])[None], axis=1)
    row = {q: i for i, q in enumerate(names)}
    needed = np.array([place[row[r["query_id"]], r["cell"]] for r in true if r["query_id"] in row])
    found = np.cumsum(np.bincount(needed, minlength=order.shape[1])) / len(needed)
    probes = min(max(int(np.searchsorted(found, target)) + 1, PROBES), order.shape[1])
    share = sizes[order[:, :probes]].sum(axis=1).mean() / max(sizes.sum(), 1)
    return replace(index, probes=probes, recall=float(found[probes - 1]), share=float(share))


def with_cells(collection: DataFrame, index: CellIndex) -> DataFrame:
    """Add each row's cell; a zero or misfit vector lies in cell 0 and is never found anyway."""
    centroids = index.centroids

    @F.arrow_udf("int")
    def cell(vectors: pa.Array) -> pa.Array:
        out = np.zeros(len(vectors), np.int32)
        if len(vectors) and len(centroids):
            ok, m = matrix(vectors, centroids.shape[1])
            out[ok] = np.argmax(np.nan_to_num(m) @ centroids.T, axis=1)
        return pa.array(out)

    return collection.withColumn("cell", cell("embedding"))


def clustered(rows: DataFrame) -> DataFrame:
    """Rows of a cell together, a large cell over several tasks."""
    return rows.hint("rebalance", "cell")


def write_cells(collection: DataFrame, index: CellIndex, path: str) -> None:
    """Store the collection partitioned by cell."""
    clustered(with_cells(collection, index)).write.partitionBy("cell").parquet(path)


def search_cells(table: DataFrame, index: CellIndex, query: list[float], k: int, *, probes: int | None = None, key: str = "id") -> DataFrame:
    """The k best rows of the cells that the query visits: the filter on cell prunes partitions before anything is read."""
    kept = table.filter(F.col("cell").isin(index.visits(query, probes)))
    return top_k(kept.drop("cell"), query, k, key=key, fast=True)


def _visits(queries: DataFrame, index: CellIndex, probes: int) -> DataFrame:
    """query_id, _query and cell of each cell that a query visits, and -1 for the rows without a cell; zero and misfit vectors visit none."""
    centroids = index.centroids
    shown = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_query"))

    @F.arrow_udf("array<int>")
    def cells(vectors: pa.Array) -> pa.Array:
        ok, m = matrix(vectors, centroids.shape[1])
        live = np.isfinite(m).all(axis=1) & m.any(axis=1)
        near = CellIndex(centroids).ranked(np.nan_to_num(m))[:, :probes].astype(np.int32)
        out: list[list[int] | None] = [None] * len(vectors)
        for at, row, good in zip(np.flatnonzero(ok).tolist(), near, live, strict=True):
            out[at] = [-1, *row.tolist()] if good else None
        return pa.array(out, pa.list_(pa.int32()))

    return shown.select("query_id", "_query", F.explode(cells("_query")).alias("cell"))


def search_cells_batch(table: DataFrame, index: CellIndex, queries: DataFrame, k: int, *, probes: int | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """query_id, rank, score and the table's columns but vector and cell, of the k best rows for each query (query_id, embedding); ``keys`` name a row and break ties.

    Queries go to the cells they visit, and meet the rows there.  A large cell is dealt to
    several groups, and so are many queries of one cell, so no group grows with the data; a
    group scores by matrix products and tells each query's k best.  The table's other columns
    are fetched for the hits alone.
    """
    visits = _visits(queries, index, index.probes if probes is None else probes)
    hits = meet(table, visits, k, keys)
    rest = [c for c in table.columns if c not in ("embedding", "cell", *keys)]
    return table.select(*keys, *rest).join(hits, list(keys)) if rest else hits
