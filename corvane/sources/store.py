"""Versioned tables on a file system: nothing that a reader may have open is changed, and the newest complete version counts."""

from __future__ import annotations

import contextlib
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ivf import CellIndex, clustered, fit_index, search_cells_batch, with_cells
from ..operators.search import top_k_batch
from ..schema import COLLECTION, LEDGER, STORED_CHARS

#: Segments of a collection from which they are merged, and the share of rows written since the last merge from which they are.
MOST_SEGMENTS, LOOSE_SHARE = 8, 0.25
#: Rows from which a merged collection gets a cell index; smaller ones are searched exactly.
INDEXED_ROWS = 50_000
#: Times that a write tries to become the newest version; age from which data that no note names is taken for a crashed write's.
TRIES, ORPHAN_MS = 10, 24 * 3600 * 1000


class Conflict(RuntimeError):
    """Somebody else has written the version that this write was to become."""


class Folder:
    """A folder of a Hadoop file system, with numbered JSON notes that are each written once.

    A note is written under another name and then renamed to its number, which fails if the
    number is taken: of two writers that start from one note the second gets a Conflict and
    nothing of the first is lost.  Whatever a note names has a name of its own that nobody else
    uses, so what a crash leaves behind stands in nobody's way; it is swept when it is old.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark._jvm
        self._fs_path, self._options = jvm.org.apache.hadoop.fs.Path, jvm.org.apache.hadoop.fs.Options.Rename
        conf = spark._jsc.hadoopConfiguration()
        self._fs = self._fs_path(self.path).getFileSystem(conf)
        self._context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), conf)

    def _at(self, name: str):
        return self._fs.makeQualified(self._fs_path(f"{self.path}/{name}"))

    def _names(self, name: str = "") -> list[str]:
        at = self._at(name) if name else self._fs_path(self.path)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def _notes(self) -> list[str]:
        return [n for n in self._names() if n.startswith("note-")]

    def version(self) -> str | None:
        notes = self._notes()
        return notes[-1] if notes else None

    def _load(self, name: str) -> dict:
        stream = self._fs.open(self._at(name))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def note(self) -> dict | None:
        """What the newest version says of itself, with its name as ``version``; None before the first write."""
        for _ in range(5):
            name = self.version()
            if name is None:
                return None
            try:
                return self._load(name) | {"version": name}
            except Py4JJavaError as e:  # forgotten since it was listed: two writes came meanwhile
                if "FileNotFoundException" not in str(e.java_exception):
                    raise
        raise OSError(f"the newest note in {self.path} can't be read")

    def _write_note(self, told: dict, after: dict | None) -> dict:
        """Write the note that follows ``after``; a Conflict if there is one already."""
        number = int(after["version"].split("-")[1]) + 1 if after else 1
        name, staged = f"note-{number:012d}", self._at(f".note-{uuid.uuid4().hex}")
        stream = self._fs.create(staged, True)
        stream.write(json.dumps(told).encode())
        stream.close()
        try:
            if self.version() not in (None, after and after["version"]):
                raise Conflict(f"{self.path} has a newer version than {after and after['version']}")
            self._context.rename(staged, self._at(name), self.spark.sparkContext._gateway.new_array(self._options, 0))
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" not in str(e.java_exception):
                raise
            raise Conflict(f"{self.path}/{name} is taken") from e
        finally:
            if self._fs.exists(staged):
                self._fs.delete(staged, False)
        return told | {"version": name}

    def _stale(self, name: str) -> list[str]:
        """What lies in ``name`` since more than ORPHAN_MS."""
        at = self._at(name)
        limit = time.time() * 1000 - ORPHAN_MS
        return [s.getPath().getName() for s in self._fs.listStatus(at) if s.getModificationTime() < limit] if self._fs.exists(at) else []

    def drop(self) -> None:
        self._fs.delete(self._fs_path(self.path), True)


def latest_rows(df: DataFrame, keys: list[str], order: str | None = None) -> DataFrame:
    """One row for each key: the last by ``order``, else any one."""
    if order is None:
        return df.dropDuplicates(keys)
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order))))
    return ranked.filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` without the keys of ``new``, and ``new``."""
    return old.join(new.select(*keys), keys, "left_anti").unionByName(new)


def delete_paths(collection: DataFrame, paths: DataFrame) -> DataFrame:
    return collection.join(paths.select("file_path"), "file_path", "left_anti")


class Ledger(Folder):
    """What was indexed: file_path and its mtime text, a table for each version; the collection's note names the one that belongs to it."""

    def put(self, rows: DataFrame) -> str:
        """Write a version aside; its name."""
        name = f"v-{uuid.uuid4().hex}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in LEDGER]).write.parquet(f"{self.path}/{name}")
        return name

    def load(self, name: str | None) -> DataFrame | None:
        """The version ``name``, or None where there is none (then everything is indexed)."""
        return self.spark.read.schema(LEDGER).parquet(f"{self.path}/{name}") if name and self._fs.exists(self._at(name)) else None

    def forget(self, name: str | None) -> None:
        """Delete a version that no note names any more, and what a crash left behind long ago; the newest two stay."""
        newest = sorted(self._names(), key=lambda n: self._fs.getFileStatus(self._at(n)).getModificationTime())[-2:]
        for old in {name, *self._stale(".")} - {None, *newest}:
            self._fs.delete(self._at(old), True)


class Collection(Folder):
    """Embedded chunks keyed by file_path and start_line, as segments.

    A write adds a segment of new rows and a list of what it replaces: whole files, or single
    keys.  A row counts if no later segment of the note's list replaces it.  From time to time
    the segments are merged into one; a large one is then partitioned by the cells of an index,
    so that a search reads the cells nearest to the query and whatever was written since.

    A write is data under new names first and one note last: until the note is there the old
    version counts, with it the new one does.  A write that comes second tries again from the
    new note; a merge that comes second gives up.
    """

    KEYS = ["file_path", "start_line"]

    def __init__(self, spark: SparkSession, path: str, dim: int, *, indexed_rows: int = INDEXED_ROWS):
        super().__init__(spark, path)
        self.dim, self.indexed_rows = dim, indexed_rows

    # -- reading ----------------------------------------------------------------------

    def _rows(self, told: dict) -> DataFrame:
        """All live rows with their cell (-1 where there is none)."""
        schema = T.StructType([*COLLECTION.fields, T.StructField("seg", T.StringType()), T.StructField("cell", T.IntegerType())])
        segments, base = told["segments"], f"{self.path}/data"
        if not segments:
            return self.spark.createDataFrame([], schema).drop("seg")
        rows = self.spark.read.schema(schema).option("basePath", base).parquet(*[f"{base}/seg={s}" for s in segments])
        if len(segments) > 1:
            place = F.create_map(*[F.lit(x) for i, s in enumerate(segments) for x in (s, i)])
            gone = self.spark.read.option("basePath", f"{self.path}/gone").schema("file_path string, start_line int, seg string").parquet(*[f"{self.path}/gone/seg={s}" for s in segments[1:]])
            gone = gone.withColumn("_at", F.element_at(place, F.col("seg")))
            rows = rows.withColumn("_at", F.element_at(place, F.col("seg")))
            files = gone.filter(F.col("start_line").isNull()).groupBy(F.col("file_path").alias("_path")).agg(F.max("_at").alias("_gone"))
            keys = gone.filter(F.col("start_line").isNotNull()).groupBy(F.col("file_path").alias("_path"), F.col("start_line").alias("_line")).agg(F.max("_at").alias("_gone"))
            rows = rows.join(files, (F.col("file_path") == F.col("_path")) & (F.col("_at") < F.col("_gone")), "left_anti")
            if told.get("by_key"):
                rows = rows.join(keys, (F.col("file_path") == F.col("_path")) & (F.col("start_line") == F.col("_line")) & (F.col("_at") < F.col("_gone")), "left_anti")
            rows = rows.drop("_at")
        return rows.drop("seg")

    def read(self) -> DataFrame:
        """The current rows; an empty frame before the first write."""
        told = self.note()
        return self._rows(told).drop("cell") if told else self.spark.createDataFrame([], COLLECTION)

    def index_of(self, told: dict | None) -> CellIndex | None:
        """The cell index of a version, if it has one."""
        if not told or not told.get("index"):
            return None
        return CellIndex.load(self.spark, f"{self.path}/index/{told['index']}")

    def candidates(self, query: list[float]) -> DataFrame:
        """The rows of the cells that ``query`` visits, and those without a cell; all rows where there is no index."""
        told = self.note()
        index = self.index_of(told)
        if index is None:
            return self.read()
        return self._rows(told).filter(F.col("cell").isin([-1, *index.visits(query)])).drop("cell")

    def search_batch(self, queries: DataFrame, k: int, *, exact: bool = False) -> DataFrame:
        """query_id, rank, score and the columns of the ``k`` best rows for each query (query_id, embedding), by the index where there is one."""
        told = self.note()
        index = None if exact else self.index_of(told)
        if index is None:
            return top_k_batch(self.read().withColumn("_key", F.struct(*self.KEYS)), queries, k, key="_key").drop("_key")
        return search_cells_batch(self._rows(told), index, queries, k, keys=tuple(self.KEYS))

    def recall(self, k: int = 10, *, queries: int = 50) -> float:
        """The share of the ``k`` truly nearest rows that the index finds, over stored vectors with the smallest hashed ids as queries."""
        asked = self.read().orderBy(F.xxhash64("id"), "id").limit(queries).select(F.monotonically_increasing_id().alias("query_id"), "embedding")
        asked = self.spark.createDataFrame(asked.collect(), asked.schema)
        true, found = (self.search_batch(asked, k, exact=e).select("query_id", "id", F.lit(1).alias("one")) for e in (True, False))
        joined = true.join(found.withColumnRenamed("one", "hit"), ["query_id", "id"], "left")
        total, hits = joined.agg(F.count("one"), F.count("hit")).first()
        return hits / total if total else 1.0

    # -- writing ----------------------------------------------------------------------

    _EMPTY = {"segments": [], "rows": [], "by_key": False, "index": None, "ledger": None, "ledger_before": None}

    @staticmethod
    def _noted(told: dict, ledger: str | None) -> dict:
        """The ledger of a write, and the one before it; a write without one keeps both."""
        return {"ledger": ledger, "ledger_before": told["ledger"]} if ledger else {k: told[k] for k in ("ledger", "ledger_before")}

    def ensure(self) -> None:
        """Create the collection empty if it is absent; an existing one must have vectors of this length."""
        if self.version() is None:
            with contextlib.suppress(Conflict):  # somebody else has created it
                self._write_note(self._EMPTY, None)
            return
        row = self.read().select(F.size("embedding").alias("n")).first()
        if row and row["n"] != self.dim:
            raise ValueError(f"the collection holds vectors of {row['n']} dimensions, not {self.dim}: index it anew")

    def _put(self, rows: DataFrame) -> tuple[str, int]:
        """Write a segment of rows that have a cell; its name and the number of rows."""
        seg = uuid.uuid4().hex
        path = f"{self.path}/data/seg={seg}"
        rows.select(*[F.col(f.name).cast(f.dataType) for f in COLLECTION], F.col("cell").cast("int").alias("cell")).write.partitionBy("cell").parquet(path)
        return seg, self.spark.read.schema(COLLECTION).parquet(path).count()

    def _checked(self, chunks: DataFrame) -> DataFrame:
        if chunks.filter(F.size("embedding") != self.dim).limit(1).count():
            raise ValueError(f"embeddings must have {self.dim} dimensions")
        return latest_rows(chunks.withColumn("content", F.substring("content", 1, STORED_CHARS)), self.KEYS)

    def replace_files(self, chunks: DataFrame, gone: DataFrame, *, stale: str = "drop", base: dict | None = None, ledger: str | None = None) -> None:
        """Add new chunks and forget the files in ``gone``; old chunks of changed files go unless ``stale`` is keep.

        With ``base``, a note, the write counts only if that is still the newest (else a
        Conflict), and ``ledger`` becomes the ledger; without, it follows whatever is newest.
        """
        new = self._checked(chunks)
        seg, count = self._put(new.withColumn("cell", F.lit(-1)))
        whole = gone.select("file_path") if stale == "keep" else gone.select("file_path").unionByName(new.select("file_path"))
        out = whole.distinct().select("file_path", F.lit(None).cast("int").alias("start_line"))
        if stale == "keep":
            out = out.unionByName(new.select("file_path", F.col("start_line").cast("int")))
        out.write.parquet(f"{self.path}/gone/seg={seg}")

        def after(told: dict) -> dict:
            return told | {"segments": [*told["segments"], seg], "rows": [*told["rows"], count], "by_key": told["by_key"] or stale == "keep"} | self._noted(told, ledger)

        told = self._commit(after, base)
        loose = sum(told["rows"][1:])
        if len(told["segments"]) > MOST_SEGMENTS or len(told["rows"]) > 1 and loose > LOOSE_SHARE * told["rows"][0] or len(told["rows"]) == 1 and count >= self.indexed_rows:
            self.merge()

    def replace_all(self, chunks: DataFrame, *, base: dict | None = None, ledger: str | None = None) -> None:
        """Put ``chunks`` in place of everything; the old rows count until all new ones are written."""
        seg, count = self._put(self._checked(chunks).withColumn("cell", F.lit(-1)))
        self._commit(lambda told: self._EMPTY | {"segments": [seg], "rows": [count]} | self._noted(told, ledger), base)
        if count >= self.indexed_rows:
            self.merge()

    def _commit(self, after: Callable[[dict], dict], base: dict | None) -> dict:
        for left in reversed(range(TRIES)):
            told = base if base is not None else self.note()
            try:
                new = self._write_note({k: v for k, v in after(told or self._EMPTY).items() if k != "version"}, told)
            except Conflict:
                if base is not None or not left:
                    raise
                continue
            self._clean()
            return new
        raise AssertionError

    def merge(self) -> bool:
        """Put all live rows into one segment, from ``indexed_rows`` on into cells of an index that is fitted anew; False if another merge came first."""
        told = self.note()
        rows, name = self._rows(told).drop("cell"), None
        if sum(told["rows"]) >= self.indexed_rows:
            index = fit_index(rows)
            if len(index.centroids):
                name = uuid.uuid4().hex
                index.save(self.spark, f"{self.path}/index/{name}")
                rows = clustered(with_cells(rows, index))
        seg, count = self._put(rows if name else rows.withColumn("cell", F.lit(-1)))
        merged = told["segments"]

        def after(now: dict) -> dict:
            if now["segments"][:len(merged)] != merged:
                raise _Overtaken
            rest = len(merged)
            return now | {"segments": [seg, *now["segments"][rest:]], "rows": [count, *now["rows"][rest:]], "index": name, "by_key": now["by_key"] and len(now["segments"]) > rest}

        try:
            self._commit(after, None)
        except _Overtaken:
            return False
        return True

    def _clean(self) -> None:
        """Forget the notes before the last two and what only they read, and what a crash left behind long ago."""
        notes = self._notes()
        told = [self._load(n) for n in notes]
        named = [{*(f"data/seg={s}" for s in t["segments"]), *(f"gone/seg={s}" for s in t["segments"][1:]), f"index/{t['index']}"} for t in told]
        keep = set().union(*named[-2:])
        for name in set().union(*named) - keep:
            self._fs.delete(self._at(name), True)
        for name in notes[:-2]:
            self._fs.delete(self._at(name), False)
        every = {f"{kind}/seg={s}" for t in told[-2:] for s in t["segments"] for kind in ("data", "gone")} | keep
        for kind in ("data", "gone", "index"):
            for name in self._stale(kind):
                if f"{kind}/{name}" not in every:
                    self._fs.delete(self._at(f"{kind}/{name}"), True)

    def stats(self) -> dict[str, int]:
        return {"count": self.read().count()}


class _Overtaken(Exception):
    """The segments of a merge are no longer the first ones."""
