"""Vector search: scalar filter, cosine, top-k, then the score cut."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vector import cosine, cosine_to, matrix
from ..schema import HIT_COLUMNS

#: Names of the optional fields of a lean result.
INCLUDE_COLUMNS = {"chunkType": "chunk_type", "module": "module", "language": "language"}
#: Queries that are broadcast at most; rows, and queries, of one group where more are asked.
MAX_BATCH = 10_000
GROUP_ROWS, GROUP_QUERIES = 50_000, 4_096
#: Queries, and scores of all rows with them, that a task makes at once; scores nearer than SLACK to a task's last may tie with it.
SCORED, CELLS, SLACK = 512, 1 << 20, 1e-9


def pre_filter(collection: DataFrame, filters: dict[str, str]) -> DataFrame:
    """Equality on the named columns, before the search; an empty value is no filter."""
    for name, value in filters.items():
        if value not in (None, ""):
            collection = collection.filter(F.col(name) == F.lit(value))
    return collection


def scored(collection: DataFrame, query: list[float], *, fast: bool = False) -> DataFrame:
    """Rows with a score; zero vectors have none and are left out."""
    score = cosine_to(query)(F.col("embedding")) if fast else cosine(F.col("embedding"), F.array(*[F.lit(float(x)) for x in query]))
    return collection.withColumn("score", score).drop("embedding").filter(F.col("score").isNotNull())


def top_k(collection: DataFrame, query: list[float], k: int, *, key: str = "id", fast: bool = False) -> DataFrame:
    """The k best by score, ties by ``key``: a partial top-k in every task, merged once."""
    return scored(collection, query, fast=fast).orderBy(F.desc("score"), key).limit(int(k))


def top_k_batch(collection: DataFrame, queries: DataFrame, k: int, *, key: str = "id", places: int | None = None) -> DataFrame:
    """query_id, rank, score and the collection's columns but the vector, of the k best rows for each query (query_id, embedding).

    Up to MAX_BATCH queries are broadcast.  A task scores a batch of rows by one matrix product
    and keeps each query's k best of it, and those that tie with them; ranks are cut within
    each task before rows are exchanged.  More queries stay where they are: blocks of them meet
    blocks of rows (``meet``), and an id names one query.  Scores are compared as rounded to
    ``places``, if given.
    """
    asked = queries.select("query_id", F.col("embedding").cast("array<double>").alias("_query"))
    if asked.count() <= MAX_BATCH:
        return _ranked(collection, asked, k, key, places)
    live = F.exists("_query", lambda x: x != 0) & F.forall("_query", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = [c for c in collection.columns if c not in ("embedding", key)]
    rows = collection.withColumn("cell", F.size("embedding"))  # those of one length meet
    hits = meet(rows, asked.filter(live).withColumn("cell", F.size("_query")), k, (key,), places=places)
    return collection.select(key, *kept).join(hits, key) if kept else hits


def _at_once(rows: int) -> int:
    """Queries that are scored at once against so many rows."""
    return max(1, min(SCORED, CELLS // max(rows, 1)))


def meet(table: DataFrame, visits: DataFrame, k: int, keys: tuple[str, ...], *, places: int | None = None) -> DataFrame:
    """query_id, the columns ``keys``, score and rank of the k best rows of ``table`` (keys, embedding, cell) for each query of ``visits`` (query_id, _query, cell), of those in its cells.

    ``keys`` name a row and break ties.  A large cell is dealt to several groups, and so are
    many queries of one cell, so no group grows with the data; a group scores by matrix
    products and tells each query's k best.
    """
    asked = visits.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_QUERIES).cast("int").alias("_queries"))
    held = table.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / GROUP_ROWS).cast("int").alias("_rows"))
    groups = F.broadcast(held.join(asked, "cell"))  # a row a cell
    left = table.select(*keys, "embedding", "cell").join(groups, "cell").select(
        *keys, "embedding", "cell", F.pmod(F.xxhash64(*keys), F.col("_rows")).cast("int").alias("_r"), F.explode(F.sequence(F.lit(0), F.col("_queries") - 1)).alias("_q"))
    right = visits.join(groups, "cell").select(
        "query_id", "_query", "cell", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_r"), F.pmod(F.xxhash64("query_id"), F.col("_queries")).cast("int").alias("_q"))
    schema = T.StructType([visits.schema["query_id"], *[table.schema[c] for c in keys], T.StructField("score", T.DoubleType())])
    slack = SLACK if places is None else SLACK + 10.0 ** -places

    def best(rows: pa.Table, asked: pa.Table) -> pa.Table:
        dim = len(asked.column("_query")[0]) if asked.num_rows else 0
        ok, m = matrix(rows.column("embedding"), dim)
        _, q = matrix(asked.column("_query"), dim)
        length = np.linalg.norm(m, axis=1)
        live = np.flatnonzero(ok)[length > 0]
        unit = m[length > 0] / length[length > 0, None]
        q = q / np.linalg.norm(q, axis=1, keepdims=True)
        where, which, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        step = _at_once(len(live))
        for s in range(0, len(q) if len(live) else 0, step):
            part = q[s:s + step] @ unit.T
            least = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - slack if part.shape[1] > k else np.full(len(part), -np.inf)
            a, b = np.nonzero(part >= least[:, None])
            where.append(live[b])
            which.append(a + s)
            scores.append(part[a, b])
        at = rows.select(list(keys)).take(pa.array(np.concatenate(where)))
        ids = asked.select(["query_id"]).take(pa.array(np.concatenate(which)))
        return pa.Table.from_arrays([*ids.columns, *at.columns, pa.chunked_array([pa.array(np.concatenate(scores))])], names=["query_id", *keys, "score"])

    by = ("cell", "_r", "_q")
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(best, schema)
    if places is not None:
        found = found.withColumn("score", F.round("score", places))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), *keys)
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _ranked(collection: DataFrame, asked: DataFrame, k: int, key: str, places: int | None) -> DataFrame:
    rows = [(r["query_id"], r["_query"]) for r in asked.collect() if r["_query"] is not None]  # MAX_BATCH vectors, about
    by_size: dict[int, tuple[list[int], np.ndarray]] = {}
    for dim in {len(v) for _, v in rows}:
        at = [i for i, (_, v) in enumerate(rows) if len(v) == dim]
        m = np.array([rows[i][1] for i in at], float).reshape(len(at), dim)
        length = np.linalg.norm(m, axis=1)
        live = np.flatnonzero(length > 0)
        by_size[dim] = [at[i] for i in live], m[live] / length[live, None]
    shared = collection.sparkSession.sparkContext.broadcast(by_size)
    kept, slack = [c for c in collection.columns if c != "embedding"], SLACK if places is None else SLACK + 10.0 ** -places

    def score(batches):
        for batch in batches:
            for dim, (names, asked_for) in shared.value.items():
                ok, m = matrix(batch.column("embedding"), dim)
                length = np.linalg.norm(m, axis=1)
                live = np.flatnonzero(ok)[length > 0]
                if not len(live) or not names:
                    continue
                unit = m[length > 0] / length[length > 0, None]
                step = _at_once(len(live))
                for s in range(0, len(names), step):
                    part = asked_for[s:s + step] @ unit.T
                    least = np.partition(part, part.shape[1] - k, axis=1)[:, part.shape[1] - k] - slack if part.shape[1] > k else np.full(len(part), -np.inf)
                    q, at = np.nonzero(part >= least[:, None])
                    some = batch.select(kept).take(pa.array(live[at]))
                    yield pa.RecordBatch.from_arrays([*some.columns, pa.array(np.array(names[s:s + step])[q], pa.int64()), pa.array(part[q, at], pa.float64())], names=[*kept, "_q", "score"])

    schema = T.StructType([*[collection.schema[c] for c in kept], T.StructField("_q", T.LongType()), T.StructField("score", T.DoubleType())])
    names = collection.sparkSession.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], T.StructType([T.StructField("_q", T.LongType()), asked.schema["query_id"]]))
    order = Window.partitionBy("_q").orderBy(F.desc("score"), key)
    found = collection.mapInArrow(score, schema)
    if places is not None:
        found = found.withColumn("score", F.round("score", places))
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.join(F.broadcast(names), "_q").drop("_q")


def cut_min_score(hits: DataFrame, least: float) -> DataFrame:
    return hits.filter(F.col("score") >= least)


def best_score(by: Window) -> Column:
    return F.greatest(F.max("score").over(by), F.lit(0.0))


def cut_min_score_diff(hits: DataFrame, diff: float, *, by: str | None = None) -> DataFrame:
    """Keep scores within ``diff`` of the best, the best and the threshold being 0 at least.

    Runs on the k rows of each query, so a window without a partition stays small.
    """
    over = Window.partitionBy(by) if by else Window.partitionBy(F.lit(0))
    threshold = F.greatest(best_score(over) - F.lit(diff), F.lit(0.0))
    return hits.withColumn("applied_threshold", threshold).filter(F.col("score") >= F.col("applied_threshold"))


def project_hits(hits: DataFrame) -> DataFrame:
    return hits.select(*HIT_COLUMNS, "score")


def lean(hits: DataFrame, include: tuple[str, ...] = ()) -> DataFrame:
    """The lean result: id, filePath, symbolName (null for none), score, lines, content and the fields asked for."""
    return hits.select(
        "id", F.col("file_path").alias("filePath"), F.nullif(F.col("symbol_name"), F.lit("")).alias("symbolName"), F.round("score", 4).alias("score"),
        F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), "content", *[F.col(INCLUDE_COLUMNS[f]).alias(f) for f in include])
