"""Clips: short ids for (file_path, start_line, end_line), assigned once and evicted first in, first out."""

from __future__ import annotations

from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CAPACITY = 10_000
#: Puts that one task replays, and fewest ranges that more of them are looked at in.
PIECE, RANGES = 1 << 21, 200
KEY = ["file_path", "start_line", "end_line"]


class ClipRegistry:
    """The ids of one session.  A key keeps its id while it is held; ids are never used again."""

    def __init__(self, capacity: int = CAPACITY):
        self.capacity, self.last = capacity, 0
        self._by_id: OrderedDict[int, tuple[str, int, int]] = OrderedDict()
        self._by_key: dict[tuple[str, int, int], int] = {}

    def put(self, file_path: str, start_line: int, end_line: int) -> int:
        key = (file_path, start_line, end_line)
        if key not in self._by_key:
            while len(self._by_id) >= self.capacity:
                self._by_key.pop(self._by_id.popitem(last=False)[1])
            self.last += 1
            self._by_id[self.last], self._by_key[key] = key, self.last
        return self._by_key[key]

    def get(self, clip_id: int) -> tuple[str, int, int] | None:
        return self._by_id.get(clip_id)

    def clear(self) -> None:
        self._by_id.clear()
        self._by_key.clear()
        self.last = 0

    def __len__(self) -> int:
        return len(self._by_id)

    def restore(self, rows: list[tuple]) -> None:
        """Hold ``rows`` (id and key, oldest first)."""
        self.clear()
        for i, *key in rows:
            self._by_id[i], self._by_key[tuple(key)] = tuple(key), i
            self.last = i

    def rows(self) -> list[tuple[int, str, int, int]]:
        return [(i, *key) for i, key in self._by_id.items()]


def first_seen(puts: DataFrame, order: list[str]) -> DataFrame:
    """One row for each key at its first place in ``order``, and the number of its puts; combined within tasks before rows are exchanged."""
    at = F.min(F.struct(*order)).alias("_at")
    return puts.groupBy(*KEY).agg(at, F.count(F.lit(1)).alias("_puts")).select(*KEY, *[F.col(f"_at.{c}").alias(f"_{c}") for c in order], "_puts")


def number(rows: DataFrame, order: list[str], after: int = 0, parts: int = 64) -> DataFrame:
    """Add id: after + 1, after + 2, ... by the columns ``order``, which tell rows apart and begin with a number.

    Ranges of the first column are numbered side by side; only their sizes, one number for
    each of ``parts`` ranges, are summed in one place.
    """
    lead = F.col(order[0])
    low, high = rows.agg(F.min(lead), F.max(lead)).first()
    if low is None:
        return rows.withColumn("id", F.lit(0).cast("long"))
    width = max(1, -(-(high - low + 1) // parts))
    placed = rows.withColumn("_part", F.floor((lead - low) / width).cast("int"))
    sizes = placed.groupBy("_part").count()
    total = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("count").over(total), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return placed.withColumn("_n", within).join(F.broadcast(offsets), "_part").withColumn("id", F.col("_n") + F.col("_before") + after).drop("_part", "_n", "_before")


def assign(puts: DataFrame, order: list[str], *, held: DataFrame | None = None, after: int = 0) -> DataFrame:
    """New clips (id and key) for the keys of ``puts`` that ``held`` lacks, numbered by first appearance."""
    fresh = first_seen(puts, order)
    if held is not None:
        fresh = fresh.join(held.select(*KEY), KEY, "left_anti")
    return number(fresh, [f"_{c}" for c in order], after).select("id", *KEY)


def _replayed(puts: DataFrame, order: list[str], capacity: int, held: list[tuple] = ()) -> DataFrame:
    """The registry's state after all puts, by one task that holds ``capacity`` clips and begins with those ``held``: what is held decides what is new, so order matters."""
    def run(batches):
        state = ClipRegistry(capacity)
        state.restore(held)
        for batch in batches:
            for key in zip(*(batch.column(c).to_pylist() for c in KEY), strict=True):
                state.put(*key)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in state.rows()], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int32(), pa.int32()))], names=["id", *KEY])

    typed = _typed(puts).select(*dict.fromkeys([*order, *KEY]))
    return typed.repartition(1).sortWithinPartitions(*order).select(*KEY).mapInArrow(run, "id long, file_path string, start_line int, end_line int")


def _typed(puts: DataFrame) -> DataFrame:
    return puts.withColumns({c: F.col(c).cast("int") for c in KEY[1:]})


def _youngest(puts: DataFrame, order: list[str], capacity: int, last: int) -> DataFrame:
    """The ``capacity`` last of puts that are all new, the very last of which gets the id ``last``."""
    young = _typed(puts).orderBy(*[F.desc(c) for c in order]).limit(capacity)
    back = F.row_number().over(Window.orderBy(*[F.desc(c) for c in order]))
    return young.withColumn("id", (F.lit(last + 1) - back).cast("long")).select("id", *KEY)


def _between(puts: DataFrame, order: list[str], low, high) -> DataFrame:
    """Puts from the place ``low`` to before the place ``high``, rows of the columns ``order``; None is no bound."""
    def place(row):
        return F.struct(*[F.lit(row[c]).cast(puts.schema[c].dataType).alias(c) for c in order])

    at, lead = F.struct(*order), F.col(order[0])
    if low is not None:
        puts = puts.filter(at >= place(low)) if low[order[0]] is None else puts.filter((lead >= low[order[0]]) & (at >= place(low)))
    return puts if high is None else puts.filter(at < place(high))


def _ranges(puts: DataFrame, order: list[str], capacity: int, parts: int) -> list[tuple]:
    """(first place, puts, whether each of them surely is new, whatever was held before) of consecutive ranges of the order.

    A key that was never put is new, and one that comes again is new if at least ``capacity``
    puts between are: that many evict whatever was held.  What is surely new is counted by
    pairs of ranges (of a key's last put and of this one), until no pair is added.  Keys meet
    by a hash; two keys of one hash at most look like one that comes again sooner.
    """
    placed = _typed(puts).select(F.struct(*order).alias("_at"), F.xxhash64(*KEY).alias("_key")).repartitionByRange(parts, "_at").withColumn("_part", F.spark_partition_id())
    each = placed.groupBy("_part", "_key").agg(F.min("_at").alias("_at"), F.count(F.lit(1)).alias("n")).repartition(parts, "_key")
    before = F.lag("_part").over(Window.partitionBy("_key").orderBy("_part"))
    met = each.withColumn("_before", F.coalesce(before, F.lit(-1))).groupBy("_before", "_part").agg(F.count(F.lit(1)).alias("keys"), F.sum("n").alias("n"), F.min("_at").alias("low")).collect()  # parts ** 2 / 2 rows at most
    old, at, keys, every = (np.array([r[c] for r in met], np.int64) for c in ("_before", "_part", "keys", "n"))
    sure = old < 0
    while True:
        upto = np.concatenate([[0], np.cumsum(np.bincount(at, keys * sure, parts))])  # in the ranges before
        now = sure | (upto[at] - upto[old + 1] >= capacity)
        if (now == sure).all():
            break
        sure = now
    out = []
    for part in sorted(set(at.tolist())):
        rows = np.flatnonzero(at == part)
        out.append((min((met[i]["low"] for i in rows), key=lambda r: [(x is not None, x) for x in r]), int(every[rows].sum()), bool(sure[rows].all() and (keys[rows] == every[rows]).all())))
    return out


def _again(puts: DataFrame, order: list[str], capacity: int, every: int) -> DataFrame:
    """The clips held after puts that come again after their eviction.

    Stretches in which each put surely is new are only counted, side by side; of the last
    ``capacity`` puts of such a stretch the state is known.  What lies between is replayed, in
    pieces of PIECE puts or so, each by one task that begins with the clips that the one before held.
    """
    ranges = _ranges(puts, order, capacity, max(RANGES, -(-4 * every // PIECE)))
    runs: list[list] = []  # [low, puts, surely new]
    for low, n, new in ranges:
        if runs and runs[-1][2] == new and (new or runs[-1][1] + n <= PIECE):
            runs[-1][1] += n
        else:
            runs.append([low, n, new])
    held: list[tuple] = []
    last, out = 0, None
    for k, (low, n, new) in enumerate(runs):
        high = runs[k + 1][0] if k + 1 < len(runs) else None
        part = _between(puts, order, low if k else None, high)
        if new and n >= capacity:
            last += n
            out = _youngest(part, order, capacity, last)
            if high is None or runs[k + 1][2]:
                continue
        else:
            out = _replayed(part, order, capacity, held)
        if high is not None:
            held = sorted(map(tuple, out.collect()))  # capacity rows
            last = held[-1][0]
    return out


def fifo(puts: DataFrame, order: list[str], capacity: int = CAPACITY) -> DataFrame:
    """The clips that are held after all ``puts`` in the order of the columns ``order``, first in, first out.

    Without repeats, and while nothing is evicted, ids are places among the keys' first
    appearances, and only the youngest ``capacity`` are numbered.  A key that comes again after
    its eviction gets a new id; then puts that may or may not be new are replayed one after the other.
    """
    fresh = first_seen(puts, order)
    counted, every = fresh.agg(F.count(F.lit(1)), F.coalesce(F.sum("_puts"), F.lit(0))).first()
    if counted > capacity and every > counted:
        return _replayed(puts, order, capacity) if every <= PIECE else _again(puts, order, capacity, every)
    last = [f"_{c}" for c in order]
    young = fresh.orderBy(*[F.desc(c) for c in last]).limit(capacity)
    back = F.row_number().over(Window.orderBy(*[F.desc(c) for c in last]))
    return young.withColumn("id", (F.lit(counted + 1) - back).cast("long")).select("id", *KEY)


def resolve(ids: DataFrame, clips: DataFrame) -> DataFrame:
    """pos, id and the clip of each requested id, null for an id that isn't held; order and repeats stay."""
    return ids.join(clips, "id", "left").select("pos", "id", *KEY)


def distinct_ids(ids) -> object:
    """The ids of an array column at their first places."""
    return F.array_distinct(ids)
