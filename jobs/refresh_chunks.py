"""Keep a table of embedded chunks current while documents arrive as Parquet files in a folder.

A file stream takes what is new since the last run (``availableNow``, a checkpoint).  Each batch
leaves out documents whose content is known, chunks and embeds the rest, and lands as a partition
of its own, so that a batch that is repeated after a crash replaces itself and nothing else:

    OUT/chunks/batch=N/module=M   chunks with embeddings
    OUT/files/batch=N             the documents of the batch: path, digest

The chunks of a document are those of its last batch (``current``).  A folder of files belongs to
one checkpoint: with another one the job stops before it writes.

    python -m jobs.refresh_chunks --documents IN --out OUT --checkpoint CHECKPOINT
"""

from __future__ import annotations

import logging
from typing import Any

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.batches import small_batches
from corvane.operators.chunk import chunk_files
from corvane.sources.embedders import HashingEmbedder, embed_column, passage

from .common import as_files, main

log = logging.getLogger("refresh_chunks")

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"
FILES = "file_path string, digest string, batch long"
CHUNKS = ("id string, content string, file_path string, language string, chunk_type string, symbol_name string, start_line int, end_line int, digest string, "
          "embedding array<double>, batch long, module string")


def _table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the job; empty before its first batch."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _last(files: DataFrame) -> DataFrame:
    """Of each path the row of its last batch."""
    newest = Window.partitionBy("file_path").orderBy(F.desc("batch"))
    return files.withColumn("_age", F.row_number().over(newest)).filter(F.col("_age") == 1).drop("_age")


def current(spark: SparkSession, out: str) -> DataFrame:
    """The chunks of every document as of its last batch."""
    files = _table(spark, f"{out}/files", FILES)
    return _table(spark, f"{out}/chunks", CHUNKS).join(_last(files).select("file_path", "batch"), ["file_path", "batch"], "left_semi")


def refresh_chunks(spark: SparkSession, documents: str, out: str, checkpoint: str, *, extension: str = ".md", dimensions: int = 64,
                   max_tokens: int = 800, overlap: int = 5, files_per_batch: int = 1000, writers: int = 16) -> dict[str, Any]:
    """Take the documents that came since the last run into ``documents`` (a folder, or a pattern of files or folders); the numbers of batches, documents read, and files and chunks written.

    A document that comes again with other content replaces the one before; of two in one batch
    the one with the larger digest counts, as nothing tells which is newer.  Documents without
    an id or a text are left out.  A module, however large, is written by ``writers`` tasks a
    batch (streams run without adaptive plans, which would split it).
    """
    told = {"batches": 0, "documents": 0, "files": 0, "chunks": 0}

    def land(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        files = _table(spark, f"{out}/files", FILES)
        if number == 0 and not files.filter(F.col("batch") > 0).isEmpty():
            raise ValueError(f"{out} belongs to another checkpoint than {checkpoint}")
        known = _last(files.filter(F.col("batch") < number)).select("file_path", "digest")
        newest = Window.partitionBy("file_path").orderBy(F.desc("digest"))
        one = as_files(batch, extension).withColumn("_n", F.row_number().over(newest)).filter(F.col("_n") == 1).drop("_n")
        new = one.join(known, ["file_path", "digest"], "left_anti")
        chunks = chunk_files(new.withColumns({"language": F.lit("markdown" if extension == ".md" else "text"), "last_modified": F.col("digest")}), max_tokens, overlap)
        embedded = embed_column(chunks, passage(F.col("content")), lambda: HashingEmbedder(dimensions), double=True).withColumnRenamed("last_modified", "digest")
        rows = {}
        for name, frame, by in (("chunks", embedded, ["batch", "module"]), ("files", new.select("file_path", "digest"), ["batch"])):  # the files last: they make the chunks current
            path = f"{out}/{name}"
            dealt = frame.repartition(*[F.col(c) for c in by[1:]], F.pmod(F.xxhash64("file_path"), F.lit(writers)))
            with small_batches(spark):
                dealt.withColumn("batch", F.lit(number).cast("long")).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)
            rows[name] = _table(spark, path, CHUNKS if name == "chunks" else FILES).filter(F.col("batch") == number).count()
        read = batch.count()
        log.info("batch %d: read %d documents, wrote %d files and %d chunks", number, read, rows["files"], rows["chunks"])
        for k, n in (("batches", 1), ("documents", read), ("files", rows["files"]), ("chunks", rows["chunks"])):
            told[k] += n

    stream = spark.readStream.schema(DOCUMENTS).option("maxFilesPerTrigger", files_per_batch).parquet(documents)
    run = stream.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    run.awaitTermination()
    log.info("read %s: %s; wrote %s", documents, told, out)
    return told


if __name__ == "__main__":
    main(None, "refresh_chunks.json", __doc__, refresh_chunks)
