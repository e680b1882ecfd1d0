"""Helpers shared by the training-data operators: staging, splits, Arrow columns."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Most bytes in one Arrow batch handed to Python; bounds worker memory for long rows.
ARROW_BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` under ``sf_dir``, by Spark's own reader."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Limit Arrow batches by bytes, so that a run of long documents can't fill a worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, or one in the warehouse where the session names none.

    Only a local session, whose executors are one machine, may fall back on a temporary folder.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if not named:
        local = spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master
        named = tempfile.mkdtemp(prefix="corvane-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_corvane_staged"
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Paths of staged tables that were not deleted yet, in order.
_staged: list[str] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: a lost executor costs a reread of these files, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corvane-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _staged.append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._corvane_path = path
    return out


def unstage(*frames: DataFrame) -> None:
    """Delete staged tables that no pending result reads any more."""
    for df in frames:
        path = getattr(df, "_corvane_path", None)
        if path:
            _delete(df.sparkSession, path)


def _delete(spark: SparkSession, path: str) -> None:
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)
    if path in _staged:
        _staged.remove(path)


def settle(make: Callable[[], DataFrame], name: str) -> DataFrame:
    """``make()`` as a staged table; tables that were staged on the way to it are deleted."""
    before = set(_staged)
    out = stage(make(), name)
    for path in [p for p in _staged if p not in before and p != out._corvane_path]:
        _delete(out.sparkSession, path)
    return out


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of finished phases whose frames are gone.

    The driver's collector has to run twice: for the frames, then for what they held; once more
    for what Spark's own listeners still held of a phase that had only just ended.
    """
    for _ in range(3):
        gc.collect()
        spark._jvm.System.gc()
        time.sleep(1)


def trim() -> None:
    """Give freed memory of this worker back to the system: an idle worker stays, and shares its executor's limit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def hold_pages() -> None:
    """Let this worker use the memory of freed arrays again, up to 32 MB each, until ``trim`` gives it back: returned one by one, they cost a page fault for every 4 KB of the next."""
    with contextlib.suppress(OSError, AttributeError):
        libc = ctypes.CDLL("libc.so.6")
        for setting in (-3, -1):  # from which size arrays are mapped apart, and how much free memory stays
            libc.mallopt(setting, 32 << 20)


def lean(run: Callable) -> Callable:
    """``run`` over Arrow batches, trimmed at its end."""
    def inner(batches):
        try:
            yield from run(batches)
        finally:
            trim()

    return inner


def lean_group(work: Callable) -> Callable:
    """``work`` on one group, trimmed at its end."""
    def one(pdf):
        out = work(pdf)
        trim()
        return out

    def two(left, right):
        out = work(left, right)
        trim()
        return out

    return one if work.__code__.co_argcount == 1 else two


def shuffle_width(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for ``rows`` records at ``per_task`` each, at least the session's setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def held_out(doc_id: Column) -> Column:
    """True where crc32(doc_id as text) mod 5 is 0; a null id counts as held out."""
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    return F.coalesce(crc % F.lit(5) == 0, F.lit(True))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """``names``, each made longer until no column is called so (Spark doesn't tell case)."""
    taken, out = {c.lower() for c in columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: Iterable[str]) -> list[Column]:
    """The columns of these names, whatever is in them."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def map_texts(df: DataFrame, fn: Callable[[pa.RecordBatch], list[pa.Array]], fields: list[T.StructField],
              keep: Iterable[str] | None = None, after: Callable[[], None] | None = None) -> DataFrame:
    """Append the columns ``fields`` that ``fn`` makes of each Arrow batch; ``after`` ends each task.

    ``keep`` names the input columns of the result (all by default); an input column that
    clashes with a new one gives way to it.
    """
    bound_batches(df.sparkSession)
    new, columns = [f.name for f in fields], df.columns
    plain = [c if c.isidentifier() else p for c, p in zip(columns, unused(columns, *[f"_plain{i}" for i in range(len(columns))]), strict=True)]  # mapInArrow can't read names with dots
    names = dict(zip(plain, columns, strict=True))
    df = df.toDF(*plain)
    kept = [p for p, c in names.items() if c not in new and (keep is None or c in keep)]
    schema = T.StructType([df.schema[c] for c in kept] + list(fields))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for batch in batches:
                arrays = [batch.column(batch.schema.get_field_index(c)) for c in kept]
                yield pa.RecordBatch.from_arrays(arrays + fn(batch), names=kept + new)
        finally:
            if after:
                after()

    return df.mapInArrow(lean(run), schema).toDF(*[names[c] for c in kept], *new)
