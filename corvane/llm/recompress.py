"""Removal of repeated word windows by recompression.

Rounds of recompression name runs of a token, then pairs of symbols, by digests of what they
name, so that every task gives equal runs and pairs the same name.  A pair is joined where one
coin of its left name and one of its right name say so, and where it isn't too long; so whether
two symbols are joined depends on these two alone, and equal windows get equal symbols inside.
Every symbol carries the words that decided it (its support); a symbol whose support lies within
a window is the same in every other place of that window.

Of the symbols within a window the one with the least digest stands for it.  Two Spark rounds
decide.  The first brings equal symbols together: where all windows that a symbol stands for
read alike, the document with the smallest id keeps them and the others lose them at once; a
symbol that stands in different surroundings in different documents reveals windows that may
repeat.  The second round brings those windows together, one from each surroundings.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, lean_group, release, shuffle_width, stage, unstage
from .shingles import mix
from .suffixes import _bucketed, _columns, _deal, _groups, _ids, _union, bucket_of, owner_of
from .words import byte_values, fold, folds, in_words, words_of

#: Words of a window; rounds that name pairs, and the most words of a pair.
WINDOW, ROUNDS, LONGEST = 13, 3, 4
#: The ASCII characters between words.
SEPARATORS = " \t\n\x0b\x0c\r"
#: Anchors that a map task holds before it deals them; of one reduce group; words of a piece of a long text.
HELD, PER_GROUP, PIECE = 800_000, 800_000, 200_000
#: Text bytes of one bucket of documents.
BUCKET_BYTES = 8 << 20
#: Surroundings of one symbol in a task from which they go on to the second round unseen by the first.
MANY = 16

_INSIDE, _VALUES = in_words(SEPARATORS), byte_values(fold=False)
_FAR = np.int64(1 << 40)
_SALTS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63)]
#: Columns of an entry: 48 bits of the symbol's key, digest of its surroundings, document id and crc, first window, windows (and a flag).
_ENTRY = ("<u2", "<u4", "<u8", "<i8", "<u4", "<u4", "u1")
_HOT = np.uint8(128)
#: Columns of a run of words or windows: document id and crc, start, end.
_RUN = ("<i8", "<u4", "<u4", "<u4")
#: Columns of a window: two digests, document id and crc, place.
_WINDOW = ("<u8", "<u8", "<i8", "<u4", "<u4")


def symbols(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(name, start, end, lo, hi) of the last round's symbols of texts that lie end to end; lo and hi bound the support."""
    n = len(words)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    head = np.ones(n, bool)
    head[1:] = (words[1:] != words[:-1]) | (text[1:] != text[:-1])
    start = np.flatnonzero(head)
    end = np.append(start[1:], n)
    name, of = words[start], text[start]
    name = np.where(end - start > 1, mix(name * _SALTS[0] + (end - start).astype(np.uint64)), name)
    near = np.zeros(len(start) + 1, bool)
    near[1:-1] = of[1:] == of[:-1]
    lo, hi = np.where(near[:-1], start - 1, -_FAR), np.where(near[1:], end + 1, _FAR)
    for salt in _SALTS[1:ROUNDS + 1]:
        left = (mix(name ^ salt) & np.uint64(1)).astype(bool)
        size = end - start
        near = np.zeros(len(start) + 1, bool)
        near[1:-1] = of[1:] == of[:-1]
        join = np.zeros(len(start) + 1, bool)  # of each gap, that before the first and that behind the last included
        join[1:-1] = near[1:-1] & left[:-1] & ~left[1:] & (size[:-1] + size[1:] <= LONGEST)
        lead, tail = join[1:], join[:-1]
        next_lo, next_hi = np.append(lo[1:], -_FAR), np.append(hi[1:], _FAR)
        last_lo, last_hi = np.append(-_FAR, lo[:-1]), np.append(_FAR, hi[:-1])
        ahead = lead | (left & (size < LONGEST))  # what follows decided it
        back = ~lead & ~left & (size < LONGEST)  # what stands before decided it
        lo, hi = (np.where(ahead, np.where(near[1:], np.minimum(lo, next_lo), lo), np.where(back, np.where(near[:-1], np.minimum(lo, last_lo), -_FAR), lo)),
                  np.where(ahead, np.where(near[1:], np.maximum(hi, next_hi), _FAR), np.where(back, np.where(near[:-1], np.maximum(hi, last_hi), hi), hi)))
        joined = mix(mix(name * salt) + np.append(name[1:], np.uint64(0)))
        name, end = np.where(lead, joined, name), np.where(lead, np.append(end[1:], n), end)
        keep = ~tail
        name, start, end, lo, hi, of = name[keep], start[keep], end[keep], lo[keep], hi[keep], of[keep]
    return name, start, end, lo, hi


def window_runs(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, ...]:
    """(key, surroundings, first, last): runs of windows for which one symbol stands.

    The key is a digest of the symbol's support, and for a window without a symbol of its own
    a digest of the window; the surroundings are a digest of all words of the run's windows.
    """
    n = len(words)
    w = n - WINDOW + 1
    if w <= 0:
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    name, start, end, lo, hi = symbols(words, bounds)
    fits = hi - lo <= WINDOW
    name, start, end, lo, hi = name[fits], start[fits], end[fits], lo[fits], hi[fits]
    order = np.full(n + WINDOW, np.iinfo(np.uint64).max, np.uint64)
    order[start] = (mix(name ^ _SALTS[4]) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(start), dtype=np.uint64)
    least_gap, most_gap = np.full(n + WINDOW, 100, np.int8), np.full(n + WINDOW, -1, np.int8)
    least_gap[start], most_gap[start] = start - lo, start - hi + WINDOW
    none = order[-1]
    best = np.full(w, none, np.uint64)
    for d in range(WINDOW):
        cut = slice(d, d + w)
        np.minimum(best, np.where((least_gap[cut] <= d) & (most_gap[cut] >= d), order[cut], none), out=best)
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    whole = text[:w] == text[WINDOW - 1:]
    at = np.arange(w)
    chosen = np.where(best != none, (best & np.uint64(0xFFFFFFFF)).astype(np.int64), at + n)
    at, chosen = at[whole], chosen[whole]
    if not len(at):
        return (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, np.int64),) * 2
    new = np.ones(len(at), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)
    lead = np.flatnonzero(new)
    first, last, symbol = at[lead], at[np.append(lead[1:], len(at)) - 1], chosen[lead]
    total = folds(words)
    own = symbol >= n
    s = np.where(own, 0, symbol) if len(start) else np.zeros(len(symbol), np.int64)
    a, b, off, size = (x[s] if len(start) else np.zeros(len(s), np.int64) for x in (lo, hi, start - lo, end - start))
    a, b = np.where(own, first, a), np.where(own, first + WINDOW, b)
    kind = np.where(own, 0, (off << 8) + size + 1).astype(np.uint64)
    return mix(fold(total, a, b) + kind * _SALTS[3]), fold(total, first, last + WINDOW), first, last


def _pieces(words):
    """(hashes, bounds, rows, places): texts of a chunk at once, a long text in pieces that share WINDOW - 1 words."""
    n = len(words.hashes)
    if words.last - words.first > 1 or n <= PIECE:
        yield words.hashes, words.bounds, 0
        return
    for at in range(0, max(n - WINDOW + 1, 1), PIECE):
        part = words.hashes[at:at + PIECE + WINDOW - 1]
        yield part, np.array([0, len(part)]), at


def _crcs(column: pa.Array, first: int, last: int) -> np.ndarray:
    return np.array([zlib.crc32(column[i].as_buffer()) if column[i].is_valid else 0 for i in range(first, last)], np.uint32)


def _runs_out(kind: int, parts_of: np.ndarray, ids: np.ndarray, crcs: np.ndarray, s: np.ndarray, e: np.ndarray):
    """Rows (part, kind, n, data) of runs; n sums their lengths."""
    order = np.argsort(parts_of, kind="stable")
    parts_of, ids, crcs, s, e = parts_of[order], ids[order], crcs[order], s[order], e[order]
    first = _groups(parts_of)
    for a, b in zip(first, [*first[1:], len(parts_of)]):
        columns = [x[a:b].astype(t).tobytes() for x, t in zip((ids, crcs, s, e), _RUN, strict=True)]
        yield int(parts_of[a]), kind, int((e[a:b] - s[a:b]).sum()), b"".join(columns)


_LOST, _OPEN, _MEET = 0, 1, 2
_OUT = "p int, kind int, n long, data binary"


def _told(out: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate((pa.int32(), pa.int32(), pa.int64(), pa.binary()))], names=["p", "kind", "n", "data"])


def _least(first: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id of each group, at each of its members; ``ids`` ascend within groups."""
    return np.repeat(ids[first], np.diff(np.append(first, len(ids))))


def _first_round(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """p, kind, n, data: runs of lost words and runs of open windows, by bucket of their document."""
    def deal(batches):
        held: list[list[np.ndarray]] = []

        def flush():
            key, around, ids, crcs, first, last = (np.concatenate([h[i] for h in held]) for i in range(6))
            key >>= np.uint64(16)
            order = np.lexsort((ids, around, key))
            key, around, ids, crcs, first, last = (x[order] for x in (key, around, ids, crcs, first, last))
            same_key = np.zeros(len(key), bool)
            same_key[1:] = key[1:] == key[:-1]
            alike = same_key.copy()
            alike[1:] &= around[1:] == around[:-1]
            lost = ids > _least(np.flatnonzero(~alike), ids)
            lead = np.flatnonzero(~same_key)
            sizes = np.diff(np.append(lead, len(key)))
            kinds = np.add.reduceat(~alike, lead)
            several = np.maximum.reduceat(ids, lead) > np.minimum.reduceat(ids, lead)
            hot = np.repeat(several & (kinds > MANY), sizes) & ~lost
            sent = ~lost & ~hot
            flag = np.zeros(len(key), np.uint8)
            if hot.any():  # one entry tells the other tasks
                one = np.flatnonzero(hot)[_groups(key[hot])]
                sent[one], flag[one] = True, _HOT
            k, count = key[sent], (last - first + 1)[sent].astype(np.uint8)
            columns = [(k >> np.uint64(32)).astype("<u2"), k.astype("<u4"), around[sent], ids[sent], crcs[sent].astype("<u4"), first[sent].astype("<u4"), count | flag[sent]]
            out = [(p, _MEET, 0, blob) for p, blob in _deal((k % np.uint64(groups)).astype(np.int32), columns)]
            for kind, some, more in ((_LOST, lost, WINDOW), (_OPEN, hot, 1)):
                if some.any():  # settled here; spread over the groups, which only pass it on
                    out += list(_runs_out(kind, (crcs[some] % groups).astype(np.int32), ids[some], crcs[some], first[some], last[some] + more))
            held.clear()
            return _told(out)

        for batch in batches:
            ids, texts = _ids(batch.column("doc_id")), batch.column("text")
            for words in words_of(texts, _INSIDE, _VALUES):
                if not len(words.hashes):
                    continue
                crcs = _crcs(texts, words.first, words.last)
                for hashes, bounds, before in _pieces(words):
                    key, around, first, last = window_runs(hashes, bounds)
                    row = np.searchsorted(bounds, first, side="right") - 1
                    held.append([key, around, ids[words.first + row], crcs[row], first - bounds[row] + before, last - bounds[row] + before])
                    if sum(len(h[0]) for h in held) > HELD:
                        yield flush()
        if held:
            yield flush()

    def meet(pdf):
        import pandas as pd

        out, parts = [], []
        for kind, blob in zip(pdf["kind"], pdf["data"], strict=True):
            if kind == _MEET:
                c = _columns(blob, _ENTRY)
                parts.append([(c[0].astype(np.uint64) << np.uint64(32)) | c[1], *c[2:]])
            else:
                out += _by_bucket(kind, *_columns(blob, _RUN), buckets)
        if parts:
            key, around, ids, crcs, first, count = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, around, key))
            key, around, ids, crcs, first, count = (x[order] for x in (key, around, ids, crcs, first.astype(np.int64), count))
            hot, last = (count & _HOT) > 0, first + (count & ~_HOT) - 1
            same_key = np.zeros(len(key), bool)
            same_key[1:] = key[1:] == key[:-1]
            alike = same_key.copy()
            alike[1:] &= around[1:] == around[:-1]
            lost = (ids > _least(np.flatnonzero(~alike), ids)) & ~hot
            lead = np.flatnonzero(~same_key)
            several = np.maximum.reduceat(ids, lead) > np.minimum.reduceat(ids, lead)
            differ = np.add.reduceat(~alike, lead) > 1
            told = np.logical_or.reduceat(hot, lead)
            open_ = np.repeat(told | (several & differ), np.diff(np.append(lead, len(key)))) & ~lost & ~hot  # a flagged entry is open already
            out += _by_bucket(_LOST, ids[lost], crcs[lost], first[lost], last[lost] + WINDOW, buckets)
            out += _by_bucket(_OPEN, ids[open_], crcs[open_], first[open_], last[open_] + 1, buckets)
        return pd.DataFrame(out, columns=["p", "kind", "n", "data"])

    return docs.mapInArrow(lean(deal), _OUT).repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), _OUT)


def _by_bucket(kind: int, ids: np.ndarray, crcs: np.ndarray, s: np.ndarray, e: np.ndarray, buckets: int) -> list[tuple]:
    """Runs by the bucket of their document; those that touch are joined."""
    if not len(ids):
        return []
    names, row = np.unique(np.rec.fromarrays([ids, crcs], dtype=_NAME), return_inverse=True)
    row, s, e = _union(row, s, e)
    ids, crcs = names["id"][row], names["crc"][row]
    return list(_runs_out(kind, bucket_of(owner_of(ids.copy(), crcs.copy()), buckets), ids, crcs, s, e))


_NAME = np.dtype([("id", "<i8"), ("crc", "<u4")])


def _found(blobs: list[bytes]) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Per document (id, crc) its runs, in order and joined."""
    if not blobs:
        return {}
    ids, crcs, s, e = (np.concatenate(x) for x in zip(*[_columns(b, _RUN) for b in blobs], strict=True))
    names, row = np.unique(np.rec.fromarrays([ids, crcs], dtype=_NAME), return_inverse=True)
    row, s, e = _union(row, s, e)
    first = _groups(row)
    return {names[row[a]].item(): (s[a:b], e[a:b]) for a, b in zip(first, [*first[1:], len(row)])}


def _documents(left: pa.Table):
    """(id, crc, words) of each row of a bucket; Words hold one row each."""
    for batch in left.select(["doc_id", "crc", "text"]).to_batches():
        ids, crcs, texts = _ids(batch.column("doc_id")), batch.column("crc").to_pylist(), batch.column("text")
        for words in words_of(texts, _INSIDE, _VALUES):
            for i in range(words.first, words.last):
                yield i, batch, int(ids[i]), crcs[i], words, slice(*words.bounds[i - words.first:i - words.first + 2])


def _second_round(docs: DataFrame, runs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """p, kind, n, data: runs of lost words by bucket, from both rounds."""
    schema = pa.schema([("p", pa.int32()), ("kind", pa.int32()), ("n", pa.int64()), ("data", pa.binary())])

    def deal(left: pa.Table, right: pa.Table) -> pa.Table:
        kinds, blobs = right.column("kind").to_pylist(), right.column("data").to_pylist()
        out = [(int(zlib.crc32(b)) % groups, _LOST, n, b) for k, n, b in zip(kinds, right.column("n").to_pylist(), blobs, strict=True) if k == _LOST]
        found = _found([b for k, b in zip(kinds, blobs, strict=True) if k == _OPEN])
        held = []
        for _, _, id_, crc, words, cut in _documents(left) if found else ():
            spans = found.pop((id_, crc), None)  # once for repeated rows
            if spans is None:
                continue
            total, again = folds(words.hashes[cut]), folds(mix(words.hashes[cut] ^ _SALTS[0]))
            place = np.concatenate([np.arange(a, b) for a, b in zip(*spans)])
            held.append([fold(total, place, place + WINDOW), fold(again, place, place + WINDOW), np.full(len(place), id_), np.full(len(place), crc, np.uint32), place])
        if held:
            one, two, ids, crcs, place = (np.concatenate(x) for x in zip(*held, strict=True))
            one, two, ids, crcs, place, lost = _settled(one, two, ids, crcs, place)
            out += _passed(ids[lost], crcs[lost], place[lost], groups)
            sent = ~lost
            columns = [x[sent].astype(t) for x, t in zip((one, two, ids, crcs, place), _WINDOW, strict=True)]
            out += [(p, _MEET, 0, b) for p, b in _deal((one[sent] % np.uint64(groups)).astype(np.int32), columns)]
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(schema)], schema=schema)

    def meet(pdf):
        import pandas as pd

        out, parts = [], []
        for kind, blob in zip(pdf["kind"], pdf["data"], strict=True):
            if kind == _MEET:
                parts.append(_columns(blob, _WINDOW))
            else:
                out += _by_bucket(_LOST, *_columns(blob, _RUN), buckets)
        if parts:
            _, _, ids, crcs, place, lost = _settled(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            out += _by_bucket(_LOST, ids[lost], crcs[lost], place[lost], place[lost] + WINDOW, buckets)
        return pd.DataFrame(out, columns=["p", "kind", "n", "data"])

    dealt = docs.groupBy("b").cogroup(runs.groupBy("p")).applyInArrow(lean_group(deal), _OUT)
    return dealt.repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), _OUT)


def _settled(one, two, ids, crcs, place):
    """Windows sorted by digest and id, and which of them a smaller id has, too."""
    order = np.lexsort((ids, two, one))
    one, two, ids, crcs, place = (x[order] for x in (one, two, ids, crcs, place))
    new = np.ones(len(one), bool)
    new[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    return one, two, ids, crcs, place.astype(np.int64), ids > _least(np.flatnonzero(new), ids)


def _passed(ids: np.ndarray, crcs: np.ndarray, place: np.ndarray, groups: int) -> list[tuple]:
    return list(_runs_out(_LOST, (crcs % groups).astype(np.int32), ids, crcs, place, place + WINDOW)) if len(ids) else []


def _kept(docs: DataFrame, runs: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        found = _found([x.as_buffer() for x in right.column("data")])
        rows = []
        for i, batch, id_, crc, words, cut in _documents(left):
            starts, ends = words.starts[cut], words.ends[cut]
            spans, n, at, kept = found.get((id_, crc)), len(starts), 0, []
            for a, b in zip(*spans) if spans else ():
                kept.append((at, a))
                at = b
            kept.append((at, n))
            sha, removed, space = hashlib.sha256(), n, b""
            for a, b in kept:
                if a >= b:
                    continue
                removed -= b - a
                sha.update(space + _spaced(words.data[starts[a]:ends[b - 1]]))
                space = b" "
            rows.append((batch.column("doc_id")[i].as_py(), n, int(removed), sha.hexdigest()))
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.groupBy("b").cogroup(runs.groupBy("p")).applyInArrow(lean_group(work), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def _spaced(data: np.ndarray) -> bytes:
    """Text that begins and ends with a word, with one space for each run of separators."""
    inside = _INSIDE[data]
    keep = inside.copy()
    keep[1:] |= inside[:-1]  # the first separator of a run
    return np.where(inside, data, np.uint8(32))[keep].tobytes()


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every document.

    A word goes if a window of WINDOW words around it also starts in a document with a smaller
    doc_id.  A null id is larger than any other; rows that share an id never shorten each
    other; null and empty texts and texts of separators have no words; long texts are looked at
    in overlapping pieces and decided whole; an empty table gives an empty one; other columns
    are ignored, whatever their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    groups, buckets = shuffle_width(spark, size // 30, PER_GROUP), shuffle_width(spark, size, BUCKET_BYTES)
    first = stage(_first_round(docs, groups, buckets), "symbols")
    release(spark)
    open_windows = int(first.filter(F.col("kind") == _OPEN).agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0])
    second = stage(_second_round(_bucketed(docs, buckets), first.repartition(buckets, "p"), shuffle_width(spark, open_windows, PER_GROUP), buckets), "windows")
    unstage(first)
    release(spark)
    return _kept(_bucketed(docs, buckets), second.repartition(buckets, "p"))


