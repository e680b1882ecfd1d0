"""Workers make Python objects of bounded pieces, whatever comes in a batch."""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from corvane.functions import batches
from corvane.operators import chunk, search
from corvane.sources import embedders


def test_pieces_are_bounded_and_hold_every_row():
    texts = ["x" * n for n in (10, 0, 3 << 20, 5)] + ["y" * 1000] * 5000 + [None]
    made = [pa.RecordBatch.from_pydict({"n": list(range(len(texts))), "t": texts}), pa.RecordBatch.from_pydict({"n": pa.array([], pa.int64()), "t": pa.array([], pa.string())})]
    got = list(batches.pieces(made, "t"))
    assert [n for b in got for n in b.column("n").to_pylist()] == list(range(len(texts)))
    for b in got:
        assert b.num_rows <= batches.PIECE_ROWS and (b.num_rows == 1 or sum(len(t or "") for t in b.column("t").to_pylist()) <= batches.PIECE_BYTES)
    assert len(got) > 6


def test_an_embedder_and_the_chunkers_never_see_a_whole_batch(spark):
    class Told(embedders.HashingEmbedder):
        def embed(self, texts):
            out = super().embed(texts)
            out[:, 0] = len(texts)
            return out

    rows = spark.range(3000).select("id", F.concat(F.lit("word "), "id").alias("text")).coalesce(1)
    seen = embedders.embed_column(rows, F.col("text"), lambda: Told(8)).select("id", F.col("embedding")[0].alias("n")).collect()
    assert len(seen) == 3000 and max(r["n"] for r in seen) <= batches.PIECE_ROWS
    files = rows.select(F.col("text").alias("file_path"), F.lit("text").alias("language"), F.lit("m").alias("module"), F.lit("t").alias("last_modified"), F.col("text").alias("content"))
    assert chunk.chunk_files(files).select("content").distinct().count() == 3000


def test_scores_made_at_once_are_bounded():
    for rows in (0, 1, 10_000, 50_000, 10_000_000):
        n = search._at_once(rows)
        assert 1 <= n <= search.SCORED and (n == 1 or n * rows <= search.CELLS)
    assert np.ceil(4096 / search._at_once(50_000)) < 300
