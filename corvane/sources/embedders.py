"""Embedders: text column in, array<float> column out, a piece of an Arrow batch at a time."""

from __future__ import annotations

import hashlib
import json
import math
import random
import re
import time
import urllib.request
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor
from itertools import chain
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.batches import pieces
from ..functions.vector import zero_vector
from ..schema import EMBEDDED_CHARS

#: What an embedder sees before a passage and before a query.
PASSAGE, QUERY = "search_document: ", "search_query: "
_TOKEN = re.compile(r"[a-z0-9_]+")


class EmbedError(RuntimeError):
    """A query could not be embedded."""


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray:
        """One row for each text; zeros where a text has nothing to embed, NaN where it could not be embedded."""


class HashingEmbedder:
    """Feature hashing of lower-case ASCII words: md5 gives bucket and sign, the sum is normalised.

    It is lexical: texts are near when they share words.
    """

    #: Words whose places one embedder remembers; beyond it it begins anew.
    WORDS = 1 << 17

    def __init__(self, dim: int = 768):
        self.dim = dim
        self._places: dict[str, int] = {}

    def _place(self, token: str) -> int:
        """Twice the bucket, and 1 more for a negative sign."""
        digest = hashlib.md5(token.encode()).hexdigest()
        return int(digest[:7], 16) % self.dim * 2 + int(digest[7], 16) % 2

    def embed(self, texts: list[str]) -> np.ndarray:
        places, found = self._places, [_TOKEN.findall(t.lower()) for t in texts]
        if len(places) > self.WORDS:
            places.clear()
        for token in set().union(*found) - places.keys():
            places[token] = self._place(token)
        sizes = np.array([len(f) for f in found], np.int64)
        code = np.fromiter(map(places.__getitem__, chain.from_iterable(found)), np.int64, int(sizes.sum()))
        at = np.repeat(np.arange(len(texts)), sizes) * self.dim + (code >> 1)
        out = np.bincount(at, 1.0 - 2.0 * (code & 1), len(texts) * self.dim).astype(float).reshape(len(texts), self.dim)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)


class HttpEmbedder:
    """An embedding server that answers {model, prompt} with {embedding}; a text is tried ``tries`` times, with growing pauses."""

    def __init__(self, url: str, model: str, dim: int, *, workers: int = 20, timeout: float = 30.0, tries: int = 3, pause: float = 0.5):
        self.url, self.model, self.dim, self.workers, self.timeout, self.tries, self.pause = url, model, dim, workers, timeout, tries, pause

    def embed_query(self, text: str) -> list[float]:
        """The embedding of one text; an EmbedError where the server fails or answers with something else, time after time."""
        for k in range(self.tries):
            try:
                return self._ask(text)
            except EmbedError:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.pause * 2 ** k * (0.5 + random.random()))
        raise EmbedError("embedding failed: no tries")

    def _ask(self, text: str) -> list[float]:
        body = json.dumps({"model": self.model, "prompt": text}).encode()
        request = urllib.request.Request(f"{self.url.rstrip('/')}/api/embeddings", body, {"Content-Type": "application/json"})
        try:
            with urllib.request.urlopen(request, timeout=self.timeout) as answer:
                got = [float(x) for x in json.load(answer)["embedding"]]
        except (OSError, ValueError, KeyError, TypeError) as e:
            raise EmbedError(f"embedding failed: {type(e).__name__}: {e}") from e
        if len(got) != self.dim:
            raise EmbedError(f"embedding failed: {len(got)} numbers instead of {self.dim}")
        return got

    def _one(self, text: str) -> list[float]:
        try:
            return self.embed_query(text)
        except EmbedError:
            return [math.nan] * self.dim

    def embed(self, texts: list[str]) -> np.ndarray:
        with ThreadPoolExecutor(self.workers) as pool:
            return np.array(list(pool.map(self._one, texts)), float).reshape(len(texts), self.dim)


class TableEmbedder:
    """Looks texts up in a fixed table; unknown texts are zero vectors."""

    def __init__(self, table: dict[str, list[float]], dim: int):
        self.table, self.dim = table, dim

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.array([self.table.get(t, [0.0] * self.dim) for t in texts], float).reshape(len(texts), self.dim)


def passage(content: Column) -> Column:
    return F.concat(F.lit(PASSAGE), F.substring(content, 1, EMBEDDED_CHARS))


def embed_column(df: DataFrame, text: Column, make: Callable[[], Embedder], name: str = "embedding", *, double: bool = False, failed: str | None = None,
                 keep: Iterable[str] | None = None) -> DataFrame:
    """Add the embedding of ``text``, in single precision unless ``double``; the embedder is made once in each task.

    A text that could not be embedded gets a zero vector; the boolean column ``failed``, if
    named, tells which.  ``keep`` names the other columns of the result (all by default).
    """
    element, number = (T.DoubleType(), np.float64) if double else (T.FloatType(), np.float32)
    kept = [c for c in (df.columns if keep is None else keep) if c not in (name, failed)]
    staged = df.withColumn("_text", text).select(*kept, "_text")
    schema = T.StructType([df.schema[c] for c in kept] + [T.StructField(name, T.ArrayType(element))] + ([T.StructField(failed, T.BooleanType())] if failed else []))

    def run(batches):
        embedder = make()
        for batch in pieces(batches, "_text"):
            got = embedder.embed([t or "" for t in batch.column("_text").to_pylist()]).astype(number)
            lost = ~np.isfinite(got).all(axis=1)
            got[lost] = 0
            flat = pa.array(got.ravel())
            ends = pa.array(np.arange(len(got) + 1, dtype=np.int32) * embedder.dim)
            arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            told = [pa.array(lost)] if failed else []
            yield pa.RecordBatch.from_arrays([*arrays, pa.ListArray.from_arrays(ends, flat), *told], names=schema.names)

    return staged.mapInArrow(run, schema)


class EmbeddingCache:
    """Embeddings by the digest of the text they are of, a Parquet table partitioned by the digest's first byte; a text is embedded once.

    Rows are only ever added, each run's when its texts are embedded.  A run that crashes leaves
    what it had written, which the next one uses; two runs at once may both add a text.
    """

    SCHEMA = "digest string, embedding array<float>, shard string"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def embedded(self, df: DataFrame, text: Column, make: Callable[[], Embedder], *, failed: str = "failed") -> DataFrame:
        """``df`` with the embedding of ``text``, and ``failed`` where there is none; texts that aren't known yet are embedded and added now."""
        digest = F.sha2(text, 256)
        keyed = df.withColumns({"digest": digest, "shard": F.substring(digest, 1, 2)})
        asked = keyed.withColumn("text", text).select("digest", "shard", "text").dropDuplicates(["digest"])
        new = embed_column(asked.join(self.read().select("digest", "shard"), ["shard", "digest"], "left_anti"), F.col("text"), make, failed="lost", keep=("digest", "shard"))
        new.filter(~F.col("lost")).select("digest", "embedding", "shard").hint("rebalance", "shard").write.mode("append").partitionBy("shard").parquet(self.path)
        known = self.read().join(asked.select("digest", "shard"), ["shard", "digest"], "left_semi").dropDuplicates(["digest"])
        return keyed.join(known, ["shard", "digest"], "left").drop("shard", "digest").withColumn(failed, F.col("embedding").isNull()).withColumn(
            "embedding", F.coalesce("embedding", zero_vector(make().dim)))


def embed_query(embedder: Embedder, query: str) -> list[float]:
    """The embedding of a query; unlike a passage's, its failure is an error (EmbedError)."""
    if hasattr(embedder, "embed_query"):
        return embedder.embed_query(QUERY + query)
    return embedder.embed([QUERY + query])[0].tolist()
