"""The n-gram Jaccard join, with signature trees.

Texts are sets of shingle hashes.  Two sets of the wanted similarity share several of the
rarest quarter of their shingles.  A text that shares too few of them with all others has
no links; the rest are gathered in candidate groups by shared shingles and near sizes, and
texts of different groups can't link.
Within a group a signature tree holds OR-combined bitmaps and size ranges, and a dual
traversal compares only leaves whose bounds allow a link between texts not yet connected.
Links are verified on the whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, lean_group, release, shuffle_width, stage, unstage, unused
from .graph import Forest, components
from .shingles import mix, shingle_sets

#: Shingles told apart by frequency when they are ordered; others count as rare.
HEAVY = 1 << 18
#: A chunk of shingles counted at once, and the documents of a chunk that make one heavy.
COUNTED, HEAVY_DOCS = 2_000_000, 8
#: Prefix entries held by a map task (and documents) and dealt to one reduce group.
ENTRIES, HELD_DOCS, PER_GROUP = 600_000, 60_000, 600_000
#: Shingles that one task verifies: a few tasks' worth of the whole, between these bounds; a group of few sets may hold PER_FEW.
LEAST_TASK, PER_TASK, PER_FEW = 16_000, 8_000_000, 8_000_000
#: Of n shingles so many beyond the least prefix are looked at: n // EXTRA, 1 at least.
EXTRA = 16
#: Groups of more than FEW sets are parted by pairs first: at most PER_PART of their shingles at once; a shingle of more than
#: LIGHT sets of near size is counted for each set, not for each pair of them.
FEW, PER_PART, LIGHT = 64, 1_000_000, 32
#: Pairs counted at once before equal ones are added up.
HELD_PAIRS = 4_000_000
#: Estimated bytes of a side that may be broadcast.
SMALL_BYTES = 32 << 20
#: Bits for each id that is looked for in a table whose other rows are left out before a shuffle.
ID_BITS = 16
LEAF, FANOUT = 64, 8
#: Sets of a split group that stand in each of its blocks, about.
PIVOTS = 64
#: Columns of a prefix entry as dealt: 48 bits of the shingle, codes of the least and largest size of a chain (and a flag for
#: more than one class), 48 bits of its first class; and of a shared one: shingle, size code, class.
_DEALT = ("<u2", "<u4", "<u2", "<u2", "<u2", "<u4")
_SHARED = ("<u2", "<u4", "<u2", "<u2", "<u4")
_CHAIN = np.uint16(1 << 15)
_ENTRY = np.dtype([("token", "<u8"), ("low", "<u4"), ("high", "<u4"), ("cls", "<i8")])
#: Sizes are coded in 15 bits: as they are below EXACT, then in STEPS steps an octave.
EXACT, STEPS = 2048, 1462


def size_code(n: np.ndarray) -> np.ndarray:
    return np.where(n < EXACT, n, EXACT + np.floor(np.log2(np.maximum(n, EXACT) / EXACT) * STEPS)).astype(np.uint16)


def least_size(code: np.ndarray) -> np.ndarray:
    """No more than any size of this code."""
    c = code.astype(np.int64)
    return np.where(c < EXACT, c, np.floor(EXACT * 2.0 ** ((c - EXACT) / STEPS) - 1e-6 * 2.0 ** ((c - EXACT) / STEPS)).astype(np.int64))


def most_size(code: np.ndarray) -> np.ndarray:
    """No less than any size of this code."""
    c = code.astype(np.int64)
    return np.where(c < EXACT, c, np.ceil(EXACT * 2.0 ** ((c + 1 - EXACT) / STEPS) + 1).astype(np.int64))


def digest(tokens: np.ndarray) -> tuple[int, int]:
    """Two independent 64-bit digests of a set."""
    d = np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64)], np.uint64).view(np.int64)
    return int(d[0]), int(d[1])


def linked(common: int, a: int, b: int) -> bool:
    """100 * intersection >= 80 * union."""
    return 9 * common >= 4 * (a + b)


def _sketch(docs: DataFrame) -> DataFrame:
    """Rows of two kinds, in one pass: doc_id, n, d1, d2 of each text; token, n of shingles that many texts hold."""
    def run(batches):
        held, size = [], 0

        def heavy() -> pa.RecordBatch:
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            tokens, n = tokens[n >= HEAVY_DOCS].view(np.int64), n[n >= HEAVY_DOCS]
            none = pa.nulls(len(tokens), pa.int64())
            return pa.RecordBatch.from_arrays([none, pa.array(n.astype(np.int64)), none, none, pa.array(tokens)], names=["doc_id", "n", "d1", "d2", "token"])

        for batch in batches:
            rows = []
            for tokens in shingle_sets(batch.column("text")):
                rows.append((len(tokens), *digest(tokens)))
                held.append(tokens)
                size += len(tokens)
                if size > COUNTED:
                    yield heavy()
                    held, size = [], 0
            n, d1, d2 = (pa.array([r[i] for r in rows], pa.int64()) for i in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, d1, d2, pa.nulls(len(rows), pa.int64())], names=["doc_id", "n", "d1", "d2", "token"])
        if held:
            yield heavy()

    return docs.select("doc_id", "text").mapInArrow(lean(run), "doc_id long, n long, d1 long, d2 long, token long")


def _edges_of(entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sort entries by token and size and join neighbours of near size: (edge ends, edge ends, merged entries).

    An entry spans the sizes of classes that are connected already.  A neighbour is near if
    the smaller size is at least 4/5 of the larger; so a chain is connected step by step.
    """
    entries = entries[np.lexsort((entries["cls"], entries["low"], entries["token"]))]
    same = np.zeros(len(entries), bool)
    same[1:] = entries["token"][1:] == entries["token"][:-1]
    segment = np.cumsum(~same).astype(np.uint64) << np.uint64(32)
    reach = (np.maximum.accumulate(segment + entries["high"]) - segment).astype(np.int64)
    same[1:] &= 4 * entries["low"][1:].astype(np.int64) <= 5 * reach[:-1]
    at = np.flatnonzero(same)
    first = np.flatnonzero(~same)
    merged = entries[first].copy()
    if len(first):
        merged["high"] = np.maximum.reduceat(entries["high"], first)
    return entries["cls"][at - 1], entries["cls"][at], merged


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    forest = Forest()
    pairs = np.unique(np.stack([a, b]), axis=1) if len(a) else np.zeros((2, 0), np.int64)
    for x, y in zip(pairs[0].tolist(), pairs[1].tolist(), strict=True):
        forest.join(x, y)
    return forest.stars()


def needed(n: np.ndarray) -> np.ndarray:
    """Shared prefix entries that a set of n shingles has at least if it is linked.

    Sets that share o shingles share, among the first n - o + k of each in one order, at
    least k; a partner has 4/5 of the size at least, and so has k for the smaller size.  One
    less is asked of large sets, as two of their shingles may agree in the 48 bits dealt.
    """
    k = (4 * n + 4) // 5 // EXTRA
    return np.maximum(1, k - (k > 8))


def _cut(part: np.ndarray, columns: list[np.ndarray]):
    """(part, its rows column by column) for each part, in order; columns apart compress well."""
    order = np.argsort(part, kind="stable")
    part, columns = part[order], [c[order] for c in columns]
    first = np.flatnonzero(np.diff(part, prepend=-1))
    for s, e in zip(first, [*first[1:], len(part)]):
        yield int(part[s]), b"".join([c[s:e].tobytes() for c in columns])


def _columns(blobs: list[bytes], kinds: tuple[str, ...]) -> list[np.ndarray]:
    """The columns of all blobs, joined."""
    widths, parts = [np.dtype(k).itemsize for k in kinds], []
    for blob in blobs:
        n, at, row = len(blob) // sum(widths), 0, []
        for k, w in zip(kinds, widths, strict=True):
            row.append(np.frombuffer(blob, k, n, at))
            at += n * w
        parts.append(row)
    return [np.concatenate(c) for c in zip(*parts, strict=True)]


def _wide(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


def _narrow(x: np.ndarray) -> list[np.ndarray]:
    return [(x >> np.uint64(32)).astype("<u2"), x.astype("<u4")]


def _starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _shared_entries(docs: DataFrame, heavy: tuple[np.ndarray, np.ndarray], groups: int, buckets: int) -> DataFrame:
    """b, data: prefix entries that a class of near size holds as well, by bucket of the class."""
    told_heavy = docs.sparkSession.sparkContext.broadcast(heavy)

    def prefix(tokens: np.ndarray) -> np.ndarray:
        names, counts = told_heavy.value
        n = len(tokens)
        k = n - (4 * n + 4) // 5 + max(1, n // EXTRA)
        if len(names):
            at = np.minimum(np.searchsorted(names, tokens), len(names) - 1)
            weight = np.where(names[at] == tokens, counts[at], 0)
            return tokens[np.lexsort((tokens, weight))[:k]]
        return tokens[:k]

    def bucket(cls: np.ndarray) -> np.ndarray:
        return (mix(cls) % np.uint64(buckets)).astype(np.int32)

    def deal(batches):
        seen: set[int] = set()
        held, owners, table, sizes = [], [], [], []

        def flush():
            names, every = np.array(table, np.int64).view(np.uint64) >> np.uint64(16), np.array(sizes, np.int64)
            token = np.concatenate(held) >> np.uint64(16)
            doc = np.repeat(np.arange(len(owners)), owners)
            order = np.lexsort((every[doc], token))
            token, cls, n = token[order], names[doc[order]], every[doc[order]]
            near = np.zeros(len(token) + 1, bool)  # to the entry before, of no larger size
            near[1:-1] = (token[1:] == token[:-1]) & (4 * n[1:] <= 5 * n[:-1])
            local = near[:-1] | near[1:]
            first = np.flatnonzero(~near[:-1])
            last = np.append(first[1:], len(token)) - 1
            # entries with a partner here are settled; their chain goes on as one entry
            high = size_code(n[last]) | np.where(first < last, _CHAIN, np.uint16(0))
            for p, blob in _cut((token[first] % np.uint64(groups)).astype(np.int32), [*_narrow(token[first]), size_code(n[first]), high, *_narrow(cls[first])]):
                yield p, False, blob
            if local.any():
                yield int(token[local][0] % np.uint64(groups)), True, b"".join(c.tobytes() for c in (*_narrow(token[local]), size_code(n[local]), *_narrow(cls[local])))

        def told():
            rows = list(flush()) if held else []
            for x in (held, owners, table, sizes):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["p", "settled", "data"])

        size = 0
        for batch in batches:
            for tokens in shingle_sets(batch.column("text")):
                if not len(tokens):
                    continue
                cls = digest(tokens)[0]
                if cls in seen:
                    continue
                if len(seen) >= 1_000_000:
                    seen.clear()
                seen.add(cls)
                chosen = prefix(tokens)
                held.append(chosen)
                owners.append(len(chosen))
                table.append(cls)
                sizes.append(len(tokens))
                size += len(chosen)
                if size > ENTRIES or len(table) >= HELD_DOCS:
                    yield told()
                    size = 0
        yield told()

    def meet(pdf):
        import pandas as pd

        out, parts = [], []
        for settled, blob in zip(pdf["settled"], pdf["data"], strict=True):
            if settled:
                done = _columns([blob], _SHARED)
                out += _cut(bucket(_wide(*done[3:])), done)
            else:
                parts.append(blob)
        if parts:
            columns = _columns(parts, _DEALT)
            token, low, cls = _wide(*columns[:2]), columns[2], _wide(*columns[4:])
            known, high = (columns[3] & _CHAIN) > 0, most_size(columns[3] & ~_CHAIN)
            n = least_size(low)
            order = np.lexsort((known, cls, n, token))
            token, low, cls, n, high, known = (x[order] for x in (token, low, cls, n, high, known))
            fresh = np.ones(len(token), bool)  # a class told by several tasks is no partner of itself
            fresh[1:] = (token[1:] != token[:-1]) | (cls[1:] != cls[:-1]) | known[1:] | known[:-1]
            token, low, cls, n, high, known = (x[fresh] for x in (token, low, cls, n, high, known))
            segment = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) << 33
            reach = np.maximum.accumulate(segment + high) - segment
            same = token[1:] == token[:-1]
            near = np.zeros(len(token), bool)
            near[1:] = same & (4 * n[1:] <= 5 * reach[:-1])
            near[:-1] |= same & (4 * n[1:] <= 5 * high[:-1])
            keep = near & ~known
            out += _cut(bucket(cls[keep]), [*_narrow(token[keep]), low[keep], *_narrow(cls[keep])])
        return pd.DataFrame(out, columns=["b", "data"])

    dealt = docs.select("text").filter(F.col("text").isNotNull()).mapInArrow(lean(deal), "p int, settled boolean, data binary")
    return dealt.repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), "b int, data binary")


def _candidate_edges(shared: DataFrame, groups: int) -> DataFrame:
    """Edges a, b between classes (48 bits of each) whose groups could hold a link.

    Classes that share fewer prefix entries than a linked one must are left out first.
    """
    def sift(pdf):
        import pandas as pd

        columns = _columns(list(pdf["data"]), _SHARED)
        chain = np.empty(len(columns[0]), _ENTRY)
        chain["token"], chain["cls"] = _wide(*columns[:2]), _wide(*columns[3:])
        chain["low"], chain["high"] = least_size(columns[2]), most_size(columns[2])
        entry = chain[np.lexsort((chain["token"], chain["cls"]))]
        fresh = np.ones(len(entry), bool)  # copies of a class in other tasks tell the same entries
        fresh[1:] = (entry["token"][1:] != entry["token"][:-1]) | (entry["cls"][1:] != entry["cls"][:-1])
        entry = entry[fresh]
        first = _starts(entry["cls"])
        n = np.diff(np.append(first, len(entry)))
        entry = entry[np.repeat(n >= needed(entry["low"][first].astype(np.int64)), n)]
        if not len(entry):
            return pd.DataFrame([], columns=["p", "edges", "data"])
        a, b, merged = _edges_of(entry)
        node, root = _forest(a, b)
        out = [(int(node[0]) % groups, True, np.stack([node, root]).tobytes())] if len(node) else []
        out += [(p, False, blob) for p, blob in _cut((merged["token"] % np.uint64(groups)).astype(np.int32), [merged])]
        return pd.DataFrame(out, columns=["p", "edges", "data"])

    def meet(pdf):
        import pandas as pd

        blobs = [np.frombuffer(d, _ENTRY) for d, e in zip(pdf["data"], pdf["edges"], strict=True) if not e]
        old = [np.frombuffer(d, np.int64).reshape(2, -1) for d, e in zip(pdf["data"], pdf["edges"], strict=True) if e]
        a, b, _ = _edges_of(np.concatenate(blobs)) if blobs else (np.zeros(0, np.int64),) * 3
        keep = a != b
        node, root = _forest(np.concatenate([a[keep], *[o[0] for o in old]]), np.concatenate([b[keep], *[o[1] for o in old]]))
        return pd.DataFrame({"a": node, "b": root})

    sifted = shared.groupBy("b").applyInPandas(lean_group(sift), "p int, edges boolean, data binary")
    return sifted.repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), "a long, b long")


class SignatureTree:
    """Sets under nodes that hold the OR of their bitmaps, their size range and the most tokens a bitmap hides."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.sizes = sizes = np.array([len(s) for s in sets], np.int64)
        bits = 1 << int(np.clip(np.ceil(np.log2(4 * np.median(sizes))), 8, 16))
        self.maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, s in zip(self.maps, sets, strict=True):
            hashed = np.zeros(bits, np.uint8)
            hashed[(s % np.uint64(bits)).astype(np.int64)] = 1
            row[:] = np.packbits(hashed).view(np.uint64)
        self.hidden = sizes - np.bitwise_count(self.maps).sum(axis=1).astype(np.int64)
        # like sets side by side: of near size, then by their least token
        band = np.floor(np.log(sizes) / np.log(1.25))
        self.order = np.lexsort((sizes, np.array([s[0] for s in sets], np.uint64), band))
        level = [self._node(self.order[at:at + LEAF], at, None) for at in range(0, len(sets), LEAF)]
        while len(level) > 1:
            groups = [level[at:at + FANOUT] for at in range(0, len(level), FANOUT)]
            level = [self._node(self.order[g[0][4]:g[-1][5]], g[0][4], g) for g in groups]
        self.root = level[0]

    def _node(self, members: np.ndarray, at: int, kids: list | None) -> tuple:
        """(bitmap, least size, most size, most hidden, first place, end place, children)."""
        bitmap = np.bitwise_or.reduce([k[0] for k in kids] if kids else self.maps[members])
        sizes = self.sizes[members]
        return bitmap, int(sizes.min()), int(sizes.max()), int(self.hidden[members].max()), at, at + len(members), kids

    def connect(self, labels: list[int] | None = None) -> Forest:
        """Union-find over the sets' numbers after joining every linked pair, directly or through others.

        Sets of one label are known to be connected.
        """
        forest, first = Forest(), {}
        for i, label in enumerate(labels or ()):
            forest.join(i, first.setdefault(label, i))
        stack = [(self.root, self.root)]
        while stack:
            x, y = stack.pop()
            if x is not y:
                least = max(x[1], y[1])
                if 4 * least > 5 * min(x[2], y[2]):
                    continue
                most = int(np.bitwise_count(x[0] & y[0]).sum()) + min(x[3], y[3])
                if 5 * most < 4 * least:
                    continue
                root = forest.find(int(self.order[x[4]]))
                if all(forest.find(int(i)) == root for n in (x, y) for i in self.order[n[4]:n[5]]):
                    continue
            if x[6] is None and y[6] is None:
                self._compare(forest, x, y)
            elif x is y:
                kids = x[6]
                stack += [(a, b) for k, a in enumerate(kids) for b in kids[k + 1:]]
                stack += [(a, a) for a in kids]  # on top: a node's own links come first
            else:
                stack += [(a, b) for a in (x[6] or [x]) for b in (y[6] or [y])]
        return forest

    def _compare(self, forest: Forest, x: tuple, y: tuple) -> None:
        """Two leaves: bounds of all pairs at once, then the sets of those that may link and aren't connected yet."""
        right = self.order[y[4]:y[5]]
        b, hidden = self.sizes[right], self.hidden[right]
        for place in range(x[4], x[5]):
            i = int(self.order[place])
            a = int(self.sizes[i])
            most = np.bitwise_count(self.maps[right] & self.maps[i]).sum(axis=1, dtype=np.int64) + np.minimum(hidden, self.hidden[i])
            may = (9 * np.minimum(most, np.minimum(a, b)) >= 4 * (a + b))
            if x is y:
                may &= np.arange(y[4], y[5]) > place
            for j in right[may].tolist():
                if forest.find(i) != forest.find(j) and linked(len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)), a, int(self.sizes[j])):
                    forest.join(i, j)


def _verified(candidates: DataFrame) -> DataFrame:
    """Edges a, b of verified links, as stars for each group; rows (grp, cls, label, tokens) come sorted by group."""
    def run(batches: Iterator[pa.RecordBatch]):
        group, names, labels, sets = None, [], [], []

        def close():
            if len(names) < 2:
                return [], []
            forest = SignatureTree(sets).connect(labels)
            nodes = list(forest.parent)
            return [names[i] for i in nodes], [names[forest.find(i)] for i in nodes]

        for batch in batches:
            a, b = [], []
            for g, cls, label, blob in zip(*(batch.column(c).to_pylist() for c in ("grp", "cls", "label", "tokens")), strict=True):
                if g != group:
                    found = close()
                    a += found[0]
                    b += found[1]
                    group, names, labels, sets = g, [], [], []
                names.append(cls)
                labels.append(label)
                sets.append(np.frombuffer(blob, np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])
        found = close()
        yield pa.RecordBatch.from_arrays([pa.array(found[0], pa.int64()), pa.array(found[1], pa.int64())], names=["a", "b"])

    return candidates.mapInArrow(lean(run), "a long, b long")


def _asked(docs: DataFrame, ids: DataFrame, n: int) -> DataFrame:
    """The rows of ``docs`` whose doc_id is one of the ``n`` of ``ids`` (first), and few others: by a bitmap of hashed ids, which is broadcast."""
    columns, (word, bits) = docs.columns, unused(docs.columns, "_word", "_bits")
    place = lambda c: f"pmod(xxhash64(cast({c} AS long)), {ID_BITS * n}L)"
    at = lambda c: F.expr(f"{place(c)} div 64")
    bit = lambda c: F.expr(f"shiftleft(1L, cast({place(c)} % 64 AS int))")
    maps = ids.groupBy(at("first").alias(word)).agg(F.bit_or(bit("first")).alias(bits))
    return docs.join(F.broadcast(maps), at("doc_id") == F.col(word)).filter(F.col(bits).bitwiseAND(bit("doc_id")) != 0).select(*columns)


def _fetched(docs: DataFrame, placed: DataFrame, size: int, *columns: str) -> DataFrame:
    """text, _d1, _d2 and ``columns`` of the staged ``placed``, one text of each class and perhaps others of its id; ``size``: its bytes, about."""
    right = placed.select(F.col("first").alias("_first"), F.col("d1").alias("_d1"), F.col("d2").alias("_d2"), *columns)
    if size > SMALL_BYTES:  # the rows that match move, not all texts
        docs = _asked(docs, placed.select("first"), placed.count())
    return docs.join(F.broadcast(right) if size <= SMALL_BYTES else right, F.col("doc_id").eqNullSafe(F.col("_first"))).select("text", "_d1", "_d2", *columns)


def _wanted(batch: pa.RecordBatch) -> tuple[list[int], list[np.ndarray]]:
    """Rows of ``_fetched`` that hold the class they were fetched for, and their sets: rows of one id may hold different texts."""
    wanted = list(zip(batch.column("_d1").to_pylist(), batch.column("_d2").to_pylist(), strict=True))
    found = [(k, tokens) for k, tokens in enumerate(shingle_sets(batch.column("text"))) if digest(tokens) == wanted[k]]
    return [k for k, _ in found], [tokens for _, tokens in found]


def _linked_in_groups(docs: DataFrame, placed: DataFrame) -> DataFrame:
    """Edges of the links within each group of ``placed`` (d1, d2, first, n, label, keys): one text of each class is read again."""
    spark = docs.sparkSession
    placed = stage(placed.select("d1", "d2", "first", "n", "label", "keys"), "placed")
    total, size = placed.agg(F.coalesce(F.sum(F.col("n") * F.size("keys")), F.lit(0)), F.coalesce(F.sum(80 + 48 * F.size("keys")), F.lit(0))).first()

    def sets(batches):
        for batch in batches:
            keep, found = _wanted(batch)
            part = batch.take(pa.array(keep, pa.int64()))
            blobs = pa.array([tokens.tobytes() for tokens in found], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("keys"), part.column("_d1"), part.column("label"), blobs], names=["keys", "cls", "label", "tokens"])

    loaded = _fetched(docs, placed, size, "label", "keys").mapInArrow(lean(sets), "keys array<string>, cls long, label long, tokens binary")
    dealt = loaded.select(F.explode("keys").alias("grp"), "cls", "label", "tokens")
    found = stage(_verified(dealt.repartition(shuffle_width(spark, int(total), PER_TASK), "grp").sortWithinPartitions("grp", "cls")), "links")
    unstage(placed)
    return found


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Each code once, with the sum of its counts."""
    if not codes:
        return [], []
    code, which = np.unique(np.concatenate(codes), return_inverse=True)
    return [code], [np.bincount(which, np.concatenate(counts), len(code)).astype(np.int64)]


def pairs_of(n: np.ndarray, owner: np.ndarray, token: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sets whose sizes ``n`` ascend and these of their tokens: pairs, the light tokens they share, and each set's heavy tokens.

    A token is heavy where more than LIGHT sets hold it in a chain of near sizes, and light in
    a chain of fewer; two sets of near size are of one chain.  So a pair shares what is counted
    here and no more heavy tokens than either has.
    """
    order = np.lexsort((owner, token))
    token, owner = token[order], owner[order]
    near = np.zeros(len(token), bool)
    near[1:] = (token[1:] == token[:-1]) & (4 * n[owner[1:]] <= 5 * n[owner[:-1]])
    first = np.flatnonzero(~near)
    length = np.diff(np.append(first, len(token)))
    many = np.repeat(length > LIGHT, length)
    heavy = np.bincount(owner[many], minlength=len(n))
    run, owner = np.repeat(np.arange(len(first)), length)[~many], owner[~many]
    codes, counts, at = [], [], np.arange(len(owner))
    for lag in range(1, LIGHT):
        at = at[at + lag < len(owner)]
        at = at[run[at] == run[at + lag]]
        if not len(at):
            break
        x, y = owner[at], owner[at + lag]
        codes.append((x * len(n) + y)[4 * n[y] <= 5 * n[x]])
        counts.append(np.ones(len(codes[-1]), np.int64))
        if sum(map(len, codes)) > HELD_PAIRS:
            codes, counts = _summed(codes, counts)
    codes, counts = _summed(codes, counts)
    code, common = (codes[0], counts[0]) if codes else (np.zeros(0, np.int64),) * 2
    return code // len(n), code % len(n), common, heavy


def _may_link(common, heavy, both):
    """For a pair of ``both`` shingles in all that shares ``common`` light ones, with the fewer heavy ones of the two."""
    return 9 * (common + heavy) >= 4 * both


def _counted(docs: DataFrame, placed: DataFrame, size: int, width: int) -> DataFrame:
    """comp, a, b, common, both: light tokens of pairs in each part of a group; with b null, common is the heavy ones of a, both its size.

    ``placed`` (staged) has d1, d2, first, n, comp and the parts of comp; tokens are dealt by part, the classes of a batch together.
    """
    def deal(batches):
        for batch in batches:
            keep, sets = _wanted(batch)
            rows = []
            if keep:
                cls, n, comp, parts = (batch.column(c).to_numpy()[keep] for c in ("_d1", "n", "comp", "parts"))
                owner, token = np.repeat(np.arange(len(keep)), [len(s) for s in sets]), np.concatenate(sets)
                part = (mix(token) % parts.astype(np.uint64)[owner]).astype(np.int64)
                order = np.lexsort((owner, part, comp[owner]))
                owner, token, part = owner[order], token[order], part[order]
                group = np.flatnonzero(np.diff(part, prepend=-1) | (comp[owner] != np.roll(comp[owner], 1)))
                for s, e in zip(group, [*group[1:], len(owner)]):
                    here, held = np.unique(owner[s:e], return_counts=True)
                    data = np.concatenate([[len(here)], cls[here], n[here], held, token[s:e].view(np.int64)])
                    rows.append((int(comp[here[0]]), int(parts[here[0]]), int(part[s]), data.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))],
                                             names=["comp", "parts", "part", "data"])

    def run(batches: Iterator[pa.RecordBatch]):
        group, held, out = None, [], []

        def close():
            cls, n, count, token = (np.concatenate(c) for c in zip(*held, strict=True))
            order = np.argsort(n, kind="stable")
            rank = np.empty(len(n), np.int64)
            rank[order] = np.arange(len(n))
            cls, n, owner = cls[order], n[order], np.repeat(rank, count)
            a, b, common, heavy = pairs_of(n, owner, token.view(np.uint64))
            if group[1] == 1:  # all is told here already
                keep = _may_link(common, np.minimum(heavy[a], heavy[b]), n[a] + n[b])
                a, b, common = a[keep], b[keep], common[keep]
            own = np.flatnonzero(heavy)
            other = pa.concat_arrays([pa.array(cls[b]), pa.nulls(len(own), pa.int64())])
            out.append([pa.array(np.full(len(other), group[0])), pa.array(np.concatenate([cls[a], cls[own]])), other,
                        pa.array(np.concatenate([common, heavy[own]])), pa.array(np.concatenate([n[a] + n[b], n[own]]))])
            held.clear()

        def told():
            for columns in out:
                yield pa.RecordBatch.from_arrays(columns, names=["comp", "a", "b", "common", "both"])
            out.clear()

        for batch in batches:
            for *key, blob in zip(*(batch.column(c).to_pylist() for c in ("comp", "parts", "part", "data")), strict=True):
                if key != group and held:
                    close()
                    yield from told()
                group, data = key, np.frombuffer(blob, np.int64)
                m = int(data[0])
                held.append((data[1:1 + m], data[1 + m:1 + 2 * m], data[1 + 2 * m:1 + 3 * m], data[1 + 3 * m:]))
        if held:
            close()
        yield from told()

    dealt = _fetched(docs, placed, size, "n", "comp", "parts").mapInArrow(lean(deal), "comp long, parts long, part long, data binary")
    return dealt.repartition(width, "comp", "part").sortWithinPartitions("comp", "part").mapInArrow(lean(run), "comp long, a long, b long, common long, both long")


def _parted(docs: DataFrame, members: DataFrame, per: int) -> DataFrame:
    """``members`` (staged) where groups of more than FEW sets give way to smaller ones, which still hold every link.

    A chain of shared shingles joins texts that are near to nothing: one that quotes many others,
    families that hold one passage.  Such groups grow faster than the corpus.  Here pairs are
    counted, on whole sets: what a pair shares of light shingles, and at most of heavy ones, must
    be enough for a link.  Pairs that share no light one hold 4/5 heavy shingles each; all such
    sets of a group stay together.  A group is counted in parts by token, of ``per`` shingles each.
    """
    large = members.groupBy("comp").agg(F.ceil(F.sum("n") / per).cast("long").alias("parts"), F.count(F.lit(1)).alias("sets")).filter(F.col("sets") > FEW)
    large = stage(large.select("comp", "parts"), "large")
    if large.isEmpty():
        unstage(large)
        return members
    within = members.join(large, "comp")
    placed = stage(within.select("d1", "d2", "first", "n", "comp", "parts"), "counting")
    total, classes = placed.agg(F.sum("n"), F.count(F.lit(1))).first()
    told = stage(_counted(docs, placed, 80 * classes, shuffle_width(docs.sparkSession, int(total), PER_TASK)), "counted")
    heavy = told.filter(F.col("b").isNull()).groupBy("comp", "a").agg(F.sum("common").alias("h"), F.max("both").alias("n"))
    pairs = told.filter(F.col("b").isNotNull()).groupBy("comp", "a", "b").agg(F.sum("common").alias("common"), F.max("both").alias("both"))
    for c in "ab":
        pairs = pairs.join(heavy.select("comp", F.col("a").alias(c), F.col("h").alias(f"h{c}")), ["comp", c], "left")
    pairs = pairs.filter(_may_link(F.col("common"), F.least(F.coalesce("ha", F.lit(0)), F.coalesce("hb", F.lit(0))), F.col("both")))
    mass = heavy.filter(F.col("h") * 5 >= F.col("n") * 4)
    together = mass.join(mass.groupBy("comp").agg(F.min("a").alias("b")), "comp")
    near = components(pairs.select("a", "b").unionByName(together.select("a", "b")))
    labels = near.select(F.col("node").alias("d1"), F.col("root").alias("new"))
    labels = labels.unionByName(labels.select(F.col("new").alias("d1"), "new").distinct())
    columns = members.columns
    closer = within.join(labels, "d1").withColumn("comp", F.col("new")).select(*columns)
    out = stage(members.join(large, "comp", "left_anti").select(*columns).unionByName(closer), "parted")
    unstage(large, placed, told, near)
    return out


def _placed(rows: DataFrame) -> DataFrame:
    """One row for each class with the keys of all its groups."""
    return rows.groupBy("d1", "d2", "first", "n", "label").agg(F.flatten(F.collect_list("keys")).alias("keys"))


def _key(kind: str, *parts) -> object:
    return F.concat_ws("/", F.lit(kind), "comp", "band", *[F.col(p) if isinstance(p, str) else p for p in parts])


def _range(n: str) -> object:
    return F.sequence(F.lit(0), F.col(n) - 1)


def _cross_entries(shared: DataFrame, labels: DataFrame, groups: int, buckets: int) -> DataFrame:
    """b, data: those of the shared entries of the classes in ``labels`` (d1, label) whose chain holds another label as well."""
    def placed(batches):
        for batch in batches:
            cls = batch.column("d1").to_numpy().view(np.uint64) >> np.uint64(16)
            b = (mix(cls) % np.uint64(buckets)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(cls.astype(np.int64)), batch.column("label")], names=["b", "cls", "label"])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            cls, label = right.column("cls").to_numpy().astype(np.uint64), right.column("label").to_numpy()
            order = np.lexsort((label, cls))
            cls, label = cls[order], label[order]
            columns = _columns([x.as_buffer() for x in left.column("data")], _SHARED)
            own = _wide(*columns[3:])
            first = np.searchsorted(cls, own)
            n = np.searchsorted(cls, own, side="right") - first  # labels of this class: one, or seldom more
            at = np.repeat(np.arange(len(own)), n)
            which = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            token = _wide(*columns[:2])[at]
            out = list(_cut((token % np.uint64(groups)).astype(np.int32), [c[at] for c in columns] + [label[which].astype("<i8")]))
        return pa.Table.from_arrays([pa.array([x[0] for x in out], pa.int32()), pa.array([x[1] for x in out], pa.binary())], names=["p", "data"])

    def meet(pdf):
        import pandas as pd

        columns = _columns(list(pdf["data"]), (*_SHARED, "<i8"))
        token, low = _wide(*columns[:2]), least_size(columns[2])
        order = np.lexsort((low, token))
        columns, token, low = [c[order] for c in columns], token[order], low[order]
        high = most_size(columns[2])
        segment = np.cumsum(np.concatenate(([True], token[1:] != token[:-1]))) << 33
        reach = np.maximum.accumulate(segment + high) - segment
        first = np.flatnonzero(np.concatenate(([True], (token[1:] != token[:-1]) | (4 * low[1:] > 5 * reach[:-1]))))
        mixed = np.minimum.reduceat(columns[5], first) != np.maximum.reduceat(columns[5], first)
        keep = np.repeat(mixed, np.diff(np.append(first, len(token))))
        out = [c[keep] for c in columns[:5]]
        return pd.DataFrame(list(_cut((mix(_wide(*out[3:])) % np.uint64(buckets)).astype(np.int32), out)), columns=["b", "data"])

    asked = labels.select("d1", "label").distinct().mapInArrow(placed, "b int, cls long, label long").repartition(buckets, "b")
    dealt = shared.repartition(buckets, "b").groupBy("b").cogroup(asked.groupBy("b")).applyInArrow(lean_group(deal), "p int, data binary")
    return dealt.repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), "b int, data binary")


def _grouped(classes: DataFrame, near: DataFrame) -> DataFrame:
    """Those of ``classes`` that lie in a candidate group, with comp; ``near`` has node and root by 48 bits of a class."""
    labels = near.select(F.col("node").alias("short"), F.col("root").alias("comp"))
    labels = labels.unionByName(labels.select(F.col("comp").alias("short"), "comp").distinct())
    return classes.withColumn("short", F.shiftrightunsigned("d1", 16)).join(labels, "short").drop("short")


def _links(docs: DataFrame, members: DataFrame, shared: DataFrame, groups: int) -> DataFrame:
    """node, root over the classes of candidate groups (members: d1, d2, n, first, comp) after all links are found.

    A group of a few tasks' worth of shingles at most is one task (``per``, between LEAST_TASK
    and PER_TASK; a group of few sets, PER_FEW).  A larger one is split by the octave of the
    smaller set of a pair, and by hash into blocks.  First each block meets itself and a few
    pivots that stand in every block, which connects a mass of near copies for good.  Then
    the shared prefix entries are looked at again: those that only connected classes share
    say nothing any more, so most classes are left out and the rest fall into smaller groups.
    Where such a group is still large, what isn't in its largest component meets all blocks.
    """
    spark = docs.sparkSession

    def share(rows: DataFrame, parts: int) -> int:
        """Shingles in one of so many parts of ``rows``, within the bounds of a task."""
        every = int(rows.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
        return int(np.clip(every // max(1, parts), min(LEAST_TASK, PER_TASK), PER_TASK))

    def wide(weight, count, per: int):
        """Blocks of so many shingles in so many sets: sets that are few stay together while PER_FEW holds them."""
        few = F.ceil(count / PIVOTS)
        return F.greatest(F.ceil(weight / max(PER_FEW, per)), F.least(F.ceil(weight / per), few), F.lit(1)).cast("int")

    def banded(rows: DataFrame, per: int) -> DataFrame:
        """With the bands and blocks of each row's group.

        Large groups hold more than ``per`` shingles each, so their few rows (every / per, times
        the bands) are broadcast, and no group's members are gathered in one task.  A band in
        which no set of the group is the smaller one of a pair is left out.
        """
        large = rows.groupBy("comp").agg(wide(F.sum("n"), F.count(F.lit(1)), per).alias("parts")).filter(F.col("parts") > 1).select("comp", F.lit(True).alias("large"))
        octave = lambda x: F.floor(F.log2(x)).cast("int")
        bands = F.when(F.col("large"), F.sequence(octave(F.greatest(F.col("n") * 0.8 - 0.5, F.lit(0.5))), octave(F.col("n")))).otherwise(F.array(F.lit(-9)))
        out = rows.join(F.broadcast(large), "comp", "left").withColumn("band", F.explode(bands))
        sizes = out.filter("large").groupBy("comp", "band").agg(wide(F.sum("n"), F.count(F.lit(1)), per).alias("blocks"), F.count(F.lit(1)).alias("count"),
                                                                 F.max(octave(F.col("n")) == F.col("band")).alias("smaller"))
        out = out.join(F.broadcast(sizes), ["comp", "band"], "left").filter(F.coalesce("smaller", F.lit(True)))
        return out.withColumn("blocks", F.coalesce("blocks", F.lit(1))).drop("large", "smaller")

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions")) // 2
    parted = members = _parted(docs, members, min(share(members, tasks), PER_PART))
    per = share(members, tasks)
    first = stage(banded(members.withColumn("label", F.col("d1")), per).withColumns({
        "own": F.pmod(F.xxhash64("d1"), F.col("blocks")).cast("int"),
        "pivot": F.coalesce(F.pmod(F.xxhash64("d1", F.lit(7)), F.lit(1 << 20)) * F.col("count") < F.lit(PIVOTS << 20), F.lit(False))}), "banded")
    everywhere = F.transform(_range("blocks"), lambda h: _key("own", h.cast("string")))
    keys = F.when(F.col("pivot"), everywhere).otherwise(F.array(_key("own", F.col("own").cast("string"))))
    near = _linked_in_groups(docs, _placed(first.withColumn("keys", keys)))
    split = first.filter("blocks > 1").select("d1", "d2", "first", "n").distinct()
    found = components(near)
    if split.isEmpty():
        unstage(near, first, parted)
        return found

    roots = found.select(F.col("node").alias("d1"), "root")
    named = stage(split.join(roots, "d1", "left").withColumn("label", F.coalesce("root", "d1")).drop("root"), "labelled")
    cross = stage(_cross_entries(shared, named, groups, groups), "cross")
    closer = components(_candidate_edges(cross.repartition(groups, "b"), groups))
    left = stage(_grouped(named, closer), "left")
    # where blocks meet in pairs, so many blocks of what is left give each core a pair; more would only move more
    per_pair = share(left, int((2 * spark.sparkContext.defaultParallelism) ** 0.5))
    again = stage(banded(left, per_pair), "banded")
    unstage(found, closer, cross, left)
    weights = again.filter("blocks > 1").groupBy("comp", "band", "label").agg(F.sum("n").alias("w"), F.count(F.lit(1)).alias("c"))
    main = weights.groupBy("comp", "band").agg(F.max(F.struct("w", "c", "label")).alias("top"), F.sum("w").alias("all"), F.sum("c").alias("count"))
    main = main.select("comp", "band", F.col("top.label").alias("major"), wide(F.col("top.w"), F.col("top.c"), per_pair).alias("h"),
                       wide(F.col("all") - F.col("top.w"), F.col("count") - F.col("top.c"), per_pair).alias("k"), (F.col("count") > F.col("top.c")).alias("more"))
    main = main.filter("more").drop("more")  # where all are connected already, nothing is left to meet
    met = again.filter("blocks > 1").join(F.broadcast(main), ["comp", "band"])  # as few as large groups and bands
    whole = again.filter("blocks = 1").withColumns({"major": F.col("label"), "h": F.lit(1), "k": F.lit(1)})
    rest = whole.unionByName(met).withColumns({
        "in_major": F.col("label") == F.col("major"), "at_h": F.pmod(F.xxhash64("d1"), F.col("h")).cast("string"), "at_k": F.pmod(F.xxhash64("d1"), F.col("k")).cast("int")})
    with_rest = F.transform(_range("k"), lambda k: _key("main", F.col("at_h"), k.cast("string")))
    with_main = F.transform(_range("h"), lambda h: _key("main", h.cast("string"), F.col("at_k").cast("string")))
    among = F.transform(_range("k"), lambda k: _key("rest", F.least(F.col("at_k"), k).cast("string"), F.greatest(F.col("at_k"), k).cast("string")))
    keyed = rest.withColumn("keys", F.when(F.col("blocks") == 1, F.array(_key("all"))).when(F.col("in_major"), with_rest).otherwise(F.concat(with_main, among)))
    # the labels of a class are equal in all its bands
    far = _linked_in_groups(docs, _placed(keyed))
    found = components(near.unionByName(far))
    unstage(near, far, first, named, again, parted)
    return found


def link(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row.

    Rows with equal sets are one class, and links join classes.  A text without words (or a
    null) has n_shingles 0 and is its own component; component_id is the smallest doc_id of
    the component, a null id being larger than any other.  Repeated rows stay; no pair is
    listed and no group is cut.  A text of any length is one set, held whole by one task at a
    time; an empty table gives an empty one; other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select("doc_id", "text")
    both = stage(_sketch(docs), "sketch")
    sketch = both.filter(F.col("token").isNull()).select("doc_id", "n", "d1", "d2")
    top = (both.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("n").alias("n"))
           .orderBy(F.desc("n"), "token").limit(HEAVY).select("token", "n").toPandas())
    names = top["token"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(names)
    heavy = names[order], top["n"].to_numpy(np.int64)[order]
    entries = sketch.agg(F.coalesce(F.sum(F.floor(F.col("n") / 5) + F.floor(F.col("n") / EXTRA) + 2), F.lit(0))).first()[0]
    groups = shuffle_width(spark, int(entries), PER_GROUP)
    shared = stage(_shared_entries(docs, heavy, groups, groups), "shared")
    release(spark)
    near = components(_candidate_edges(shared.repartition(groups, "b"), groups))
    release(spark)

    classes = sketch.filter(F.col("n") > 0).groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("first"))
    members = stage(_grouped(classes, near), "members")
    unstage(near)
    links = _links(docs, members, shared, groups)
    unstage(members, shared)

    roots = links.select(F.col("node").alias("d1"), "root")
    rooted = classes.join(roots, "d1", "left").withColumn("root", F.coalesce("root", "d1"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component"))
    named = rooted.join(least, "root").select("d1", "d2", "n", "component")
    out = sketch.join(named, ["d1", "d2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")).alias("component_id"))


def keep_first(docs: DataFrame) -> DataFrame:
    """One document of each component, the one with the smallest doc_id; rows with its id, or without any, stay."""
    found, (name,) = link(docs), unused(docs.columns, "_kept")
    kept = found.filter(F.col("doc_id").isNull() | (F.col("doc_id") == F.col("component_id"))).select(F.col("doc_id").alias(name)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(name)), "left_semi")
