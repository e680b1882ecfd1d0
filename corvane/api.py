"""The engine: index, search, read and clip over one workspace."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .config import Config
from .functions.requests import RequestError, SearchRequest, parse_id, parse_ids, parse_search
from .operators import search as ops
from .operators.clips import ClipRegistry
from .operators.render import markdown
from .operators.slices import read_clips, read_slices, tally
from .plans.index import IndexReport, run_index
from .schema import CLIPS
from .sources.embedders import QUERY, Embedder, HashingEmbedder, HttpEmbedder, embed_column, embed_query
from .sources.files import inside_root, read_named
from .sources.store import Collection


#: Names of a result's fields, and the columns they come from.
FIELDS = (("id", "id"), ("filePath", "file_path"), ("symbolName", "symbol_name"), ("startLine", "start_line"), ("endLine", "end_line"), ("content", "content"))


class Engine:
    """State of a session: the clip registry.  Everything else is in the collection."""

    def __init__(self, spark: SparkSession, config: Config, make_embedder: Callable[[], Embedder] | None = None):
        self.spark, self.config, self.clips = spark, config, ClipRegistry()
        url, model, dim = config.embedder_url, config.embedding_model, config.embedding_dimensions
        self.make_embedder = make_embedder or ((lambda: HttpEmbedder(url, model, dim)) if url else (lambda: HashingEmbedder(dim)))
        self.collection = Collection(spark, config.collection_path, dim, indexed_rows=config.indexed_rows)

    # -- index ------------------------------------------------------------------------

    def index(self, **options: Any) -> IndexReport:
        return run_index(self.spark, self.config, self.make_embedder, **options)

    # -- search -----------------------------------------------------------------------

    def search(self, query: str, *, strict: bool = False, **options: Any) -> dict[str, Any]:
        """The answer to a search: hits with clip ids, and the fields that tell how they were cut.

        At most 100 rows come to the driver; ids are given there once, so that running a plan
        again can't change them.
        """
        request = parse_search({"query": query, **options}, strict=strict)
        asked = embed_query(self.make_embedder(), request.query)
        ranked = ops.top_k(ops.pre_filter(self.collection.candidates(asked), request.filters), asked, int(request.top_k), fast=True)
        rows = [r.asDict() for r in ranked.collect()]
        candidates, top, threshold = len(rows), None, request.min_score
        if request.min_score_diff is not None and rows:
            top = max([0.0, *(r["score"] for r in rows)])
            threshold = max(0.0, top - request.min_score_diff)
        rows = [r for r in rows if threshold is None or r["score"] >= threshold]
        for rank, r in enumerate(rows):
            r["rank"], r["id"] = rank, self.clips.put(r["file_path"], r["start_line"], r["end_line"])
        results = [{n: r[c] for n, c in FIELDS} | {"symbolName": r["symbol_name"] or None, "score": round(r["score"], 4)}
                   | {f: r[ops.INCLUDE_COLUMNS[f]] for f in request.include} for r in rows]
        out: dict[str, Any] = {"query": query, "results": results, "count": len(rows), "topK": request.top_k, "clipStoreSize": len(self.clips), "filters": request.filters, "candidatesBeforeFilter": candidates}
        if request.min_score is not None:
            out["minScore"] = request.min_score
        if request.min_score_diff is not None:
            out |= {"minScoreDiff": request.min_score_diff, "appliedThreshold": threshold, "maxScore": top}
        if request.include:
            out["includedFields"] = list(request.include)
        if request.format == "markdown":
            columns = "id long, file_path string, symbol_name string, score double, start_line int, end_line int, content string, language string, chunk_type string, module string, rank int"
            names = [c.split(" ")[0] for c in columns.split(", ")]
            frame = self.spark.createDataFrame([tuple(r[n] for n in names) for r in rows], columns)
            shown = markdown(frame, query, request.top_k, len(self.clips), include=request.include, min_score=request.min_score, min_score_diff=request.min_score_diff)
            out["markdown"] = shown.first()["markdown"]
        return out

    def search_all(self, queries: DataFrame, k: int = 100, *, exact: bool = False) -> DataFrame:
        """query_id, rank, score and the hit's columns for each query text (query_id, text), in one plan; nothing comes to the driver."""
        asked = embed_column(queries.select("query_id", F.concat(F.lit(QUERY), "text").alias("text")), F.col("text"), self.make_embedder)
        return self.collection.search_batch(asked.select("query_id", "embedding"), k, exact=exact)

    # -- reads ------------------------------------------------------------------------

    def _files(self, paths: list[str]) -> DataFrame:
        """Current contents of the named files, read when asked for."""
        inside = [p for p in paths if p and inside_root(p, self.config.workspace_root) is not None]
        return read_named(self.spark, inside, self.config)

    def read_slice(self, file_path: str, start_line: float, end_line: float) -> dict[str, Any]:
        """Lines of a file, named relative to the workspace root or absolutely under it."""
        plain = inside_root(file_path, self.config.workspace_root) if file_path else None
        asked = self.spark.createDataFrame([(0, file_path if plain is None else plain, float(start_line), float(end_line))], "pos int, file_path string, start_line double, end_line double")
        row = read_slices(asked, self._files([] if plain is None else [plain])).first().asDict()
        if not row["success"]:
            raise RequestError(row["error"], row["status"])
        return row | {"range_requested": {"start_line": start_line, "end_line": end_line}}

    def clip_batch(self, ids: Any, *, distinct: bool = False) -> dict[str, Any]:
        """Slices of clips by id, in the order asked for, with an error for each id that isn't held."""
        wanted = parse_ids(ids, distinct=distinct)
        held = [(i, *key) for i in dict.fromkeys(wanted) if (key := self.clips.get(i))]
        asked = self.spark.createDataFrame(list(enumerate(wanted)), "pos int, id long")
        rows = read_clips(asked, self.spark.createDataFrame(held, CLIPS), self._files([h[1] for h in held])).orderBy("pos")
        got = [r.asDict() for r in rows.collect()]
        counts = tally(self.spark.createDataFrame([(r["success"],) for r in got], "success boolean")).first().asDict()
        return {"results": got, **counts, "clipStoreSize": len(self.clips)}

    def clip(self, clip_id: Any) -> dict[str, Any]:
        row = self.clip_batch([parse_id(clip_id)])["results"][0]
        if not row["success"]:
            raise RequestError(row["error"], 404)
        return row

    # -- status -----------------------------------------------------------------------

    def stats(self) -> dict[str, Any]:
        return {"collection": self.config.collection_name, "chunkCount": self.collection.stats()["count"],
                "embeddingModel": self.config.embedding_model, "embeddingDimensions": self.config.embedding_dimensions}

    def health(self) -> dict[str, str]:
        return {"status": "ok"}

    def doctor(self) -> list[tuple[str, bool, str]]:
        """(check, passed, detail) of workspace, embedder and collection."""
        import os

        out = [("workspace", os.path.isdir(self.config.workspace_root), self.config.workspace_root)]
        vector = self.make_embedder().embed(["probe"])
        out.append(("embedder", vector.shape[1] == self.config.embedding_dimensions and bool(vector.any()), self.config.embedding_model))
        note = self.collection.note()
        out.append(("collection", note is not None, self.config.collection_path))
        if (index := self.collection.index_of(note)) is not None:
            recall = self.collection.recall()
            out.append(("index", recall >= 0.9, f"recall@10 {recall:.3f}, {index.probes} of {len(index.centroids)} cells visited"))
        return out
