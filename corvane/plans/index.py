"""Index runs: walk, diff, chunk, embed, write, and note what was indexed."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators.chunk import chunk_files
from ..operators.diff import changes, to_delete, to_index
from ..sources.embedders import Embedder, EmbeddingCache, embed_column, passage
from ..sources.files import walk_files, with_content
from ..sources.store import TRIES, Collection, Conflict, Ledger

#: Paths shown by a dry run.
SHOWN_CHANGED, SHOWN_DELETED = 20, 10


@dataclass(frozen=True)
class IndexReport:
    changed: int
    deleted: int
    chunks: int
    failed: int = 0
    shown_changed: tuple[str, ...] = ()
    shown_deleted: tuple[str, ...] = ()
    seconds: float = 0.0


def embedded_chunks(files: DataFrame, config: Config, make: Callable[[], Embedder]) -> DataFrame:
    """Chunks of ``files`` (with content) with their embeddings, and failed where there is none: two Python stages, no exchange.

    With an embedding server, or where the settings say so, texts that were embedded before are
    looked up, and the chunks are made a second time for it.
    """
    chunks = chunk_files(files, config.max_chunk_tokens, config.chunk_overlap_lines)
    if config.cache_embeddings or config.embedder_url:
        name = re.sub(r"[^A-Za-z0-9._-]", "_", config.embedding_model)
        return EmbeddingCache(files.sparkSession, f"{config.collection_path}-embeddings/{name}-{config.embedding_dimensions}").embedded(chunks, passage(F.col("content")), make)
    return embed_column(chunks, passage(F.col("content")), make, failed="failed")


def _told(seen, total: int, progress: Callable[[int, int], None], done: threading.Event) -> None:
    """Tell how many of ``total`` files were read, until ``done``."""
    last = -1
    while not done.wait(0.5):
        if (now := min(seen.value, total)) != last:
            progress(now, total)
            last = now
    progress(total, total)


def run_index(spark: SparkSession, config: Config, make: Callable[[], Embedder], *, full: bool = False, dry_run: bool = False, stale: str = "drop",
              progress: Callable[[int, int], None] | None = None) -> IndexReport:
    """Bring the collection up to date; rows and ledger become current by one note, written last, so a failed run changes nothing and is repeated.

    A full run builds everything aside and then puts it in place of what was.  A run that only
    deletes also notes it.  Files that could not be read, or a passage of which could not be
    embedded, keep their old note, if any, and come again; the unread keep their old chunks too.
    What was read is kept on the executors' disks, so that chunks and notes come from the same
    reading.  A run that another one has overtaken is done again.  ``progress`` is told files
    read and files to read.
    """
    for left in reversed(range(TRIES)):
        try:
            return _run(spark, config, make, full, dry_run, stale, progress)
        except Conflict:
            if not left:
                raise
    raise AssertionError


def _run(spark: SparkSession, config: Config, make: Callable[[], Embedder], full: bool, dry_run: bool, stale: str, progress: Callable[[int, int], None] | None) -> IndexReport:
    began = time.monotonic()
    collection = Collection(spark, config.collection_path, config.embedding_dimensions, indexed_rows=config.indexed_rows)
    ledger = Ledger(spark, config.ledger_path)
    base = collection.note()
    files = walk_files(spark, config).dropDuplicates(["file_path"])
    noted = ledger.load(base["ledger"]) if base and not full else None
    changed = changes(files, noted).persist()
    try:
        wanted, gone = to_index(changed), to_delete(changed)
        n_changed, n_gone = wanted.count(), gone.count()
        if dry_run:
            shown = [tuple(r[0] for r in x.orderBy("file_path").limit(n).collect()) for x, n in ((wanted, SHOWN_CHANGED), (gone, SHOWN_DELETED))]
            return IndexReport(n_changed, n_gone, 0, 0, *shown, seconds=time.monotonic() - began)
        if base is None:
            collection.ensure()
            base = collection.note()
        elif not full:
            collection.ensure()
        if not full and not n_changed and not n_gone:
            return IndexReport(0, 0, 0, seconds=time.monotonic() - began)
        seen, done = spark.sparkContext.accumulator(0), threading.Event()
        read = with_content(files.join(wanted, "file_path", "left_semi"), config, seen).persist(StorageLevel.DISK_ONLY)
        chunks = embedded_chunks(read, config, make).persist()
        if progress:
            threading.Thread(target=_told, args=(seen, n_changed, progress, done), daemon=True).start()
        try:
            n_chunks, n_failed = chunks.agg(F.count(F.lit(1)), F.count_if("failed")).first()
            got = read.select("file_path")
            again = wanted.join(got, "file_path", "left_anti")  # what couldn't be read
            if n_failed:
                again = again.unionByName(chunks.filter("failed").select("file_path").distinct())
            now = files.join(again, "file_path", "left_anti").select("file_path", "last_modified")
            if noted is not None:
                now = now.unionByName(noted.join(again, "file_path", "left_semi").select("file_path", "last_modified"))
            name = ledger.put(now)
            if full:
                collection.replace_all(chunks, base=base, ledger=name)
            else:
                collection.replace_files(chunks, gone.unionByName(got) if stale == "drop" else gone, stale=stale, base=base, ledger=name)
            ledger.forget(base["ledger_before"])
        finally:
            done.set()
            chunks.unpersist()
            read.unpersist()
        return IndexReport(n_changed, n_gone, n_chunks, n_failed, seconds=time.monotonic() - began)
    finally:
        changed.unpersist()
