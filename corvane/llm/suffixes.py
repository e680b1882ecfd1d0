"""Exact removal of repeated substrings by a common-prefix-aware distributed merge sort.

Every string of ``NEED`` bytes picks one anchor inside itself from its content alone, so
equal strings pick anchors at the same place.  Anchors whose next ``KMER`` bytes occur in
one document only can't matter.  For the rest the suffixes are sorted within a task, sent
as front-coded runs, and merged by a loser tree that knows how long a prefix each
contender shares with the last output.  Neighbours that share ``KMER`` bytes or more are
compared window by window, and all but the smallest doc_id give up what they share.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, hold_pages, lean, lean_group, release, shuffle_width, stage, unstage
from .shingles import chunks, mix, mix_into, powers, text_buffer

#: Bytes of a repeat; of an anchor's key; bytes that may stand before an anchor in a repeat.
NEED, KMER = 50, 28
LEFT = NEED - KMER
#: Bytes of the small strings among which the least hash places the anchor.
TMER = 5
#: Anchors that a map task holds before it deals them out, and the most documents (16 bits number them within the task).
HELD, HELD_DOCS = 800_000, 60_000
#: Anchors of one reduce group; text bytes of one bucket of documents or runs.
PER_GROUP, BUCKET_BYTES = 800_000, 8 << 20
#: Places from which a key is hot, and the most hot keys that are told to every task (8 bytes each); they change who decides, not what.
HOT, HOT_KEYS = 20_000, 1 << 16
#: Hot places whose windows are listed at once.
LISTED = 10_000
#: Bytes of a text looked at once.
PIECE = 1 << 20
_LAST_ID = np.iinfo(np.int64).max

#: Columns of an anchor as dealt: 48 bits of its key, 40 bits that name its document, place in the text (and a flag).
_ENTRY = ("<u2", "<u4", "u1", "<u4", "<u2", "<u2")
#: Columns of a place: the document's 40 bits, place in the text.
_OWNED = ("u1", "<u4", "<u2", "<u2")
_PLACE = np.dtype([("id", "<i8"), ("crc", "<u4"), ("off", "<u4")])
_SPAN = np.dtype([("id", "<i8"), ("crc", "<u4"), ("s", "<u4"), ("e", "<u4")])
_KNOWN = np.uint32(1 << 31)
_RAW = np.random.default_rng(19_930_607).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def anchors(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Anchor positions of texts that lie end to end in ``data``; ``bounds`` are their edges."""
    n = len(data)
    if n < NEED:
        return np.zeros(0, np.int64)
    x = data.astype(np.uint64)
    least, other = x[:n - TMER + 1].copy(), x[:n - TMER + 1]  # two buffers take turns: fresh pages cost more than the sums
    for k in range(1, TMER):
        least <<= np.uint64(8)
        least |= x[k:n - TMER + 1 + k]
    mix_into(least, other)
    least &= np.uint64(0xFFFFFFFF00000000)
    least |= np.arange(len(least), dtype=np.uint64)
    width, spans = NEED - TMER + 1, []
    while (1 << len(spans) + 1) <= width:
        spans.append(1 << len(spans))
    for span in (*spans, width - (1 << len(spans))):
        if span:
            least, other = np.minimum(least[:-span], least[span:], out=other[:len(least) - span]), least
    start = np.arange(n - NEED + 1, dtype=np.uint32)
    place = least.astype(np.uint32)  # its low half: where the least one begins
    place -= start
    place -= (place > LEFT) * np.uint32(LEFT + 1)  # modulo LEFT + 1, of less than twice that
    place += start
    del x, least, other, start
    crossing = np.zeros(n + 1, np.int32)
    np.add.at(crossing, np.maximum(bounds[:-1], bounds[1:] - NEED + 1), 1)
    np.add.at(crossing, bounds[1:], -1)
    inside = np.cumsum(crossing, dtype=np.int32)[:n - NEED + 1] == 0
    mark = np.zeros(n, bool)
    mark[place[inside]] = True
    return np.flatnonzero(mark)


def prefix_sums(data: np.ndarray) -> np.ndarray:
    up, _ = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_RAW[data] * up[:len(data)], out=total[1:])
    return total


def owner_of(ids: np.ndarray, crcs: np.ndarray) -> np.ndarray:
    """40 bits that name a document; where two share a name, the places of both are looked at in both."""
    return mix(mix(ids.view(np.uint64)) ^ (crcs.astype(np.uint64) << np.uint64(20))) >> np.uint64(24)


def bucket_of(owners: np.ndarray, n: int) -> np.ndarray:
    return (owners % np.uint64(n)).astype(np.int32)


def _ids(column: pa.Array) -> np.ndarray:
    """Document ids; a null id is larger than any other."""
    return column.cast(pa.int64()).fill_null(_LAST_ID).to_numpy().astype(np.int64)


def _groups(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def _cut(part: np.ndarray, rows: np.ndarray):
    """(part, its rows' bytes) for each part, in order."""
    order = np.argsort(part, kind="stable")
    part, rows = part[order], rows[order]
    first = _groups(part)
    for s, e in zip(first, [*first[1:], len(part)]):
        yield int(part[s]), rows[s:e].tobytes()


def _deal(part: np.ndarray, columns: list[np.ndarray]):
    """(part, its rows column by column) for each part, in order; columns apart compress well."""
    order = np.argsort(part.astype(np.uint16) if len(part) and part.max() < 1 << 16 else part, kind="stable")  # 16 bits are sorted by radix
    part, columns = part[order], [c[order] for c in columns]
    first = _groups(part)
    for s, e in zip(first, [*first[1:], len(part)]):
        yield int(part[s]), b"".join([c[s:e].tobytes() for c in columns])


def _columns(blob: bytes, kinds: tuple[str, ...]) -> list[np.ndarray]:
    widths = [np.dtype(k).itemsize for k in kinds]
    n, at, out = len(blob) // sum(widths), 0, []
    for k, w in zip(kinds, widths, strict=True):
        out.append(np.frombuffer(blob, k, n, at))
        at += n * w
    return out


def _owned(owners: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    return [(owners >> np.uint64(32)).astype("u1"), owners.astype("<u4"), off.astype("<u2"), (off >> np.uint32(16)).astype("<u2")]


def _of_owned(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(owners, offsets) of the columns that ``_owned`` makes."""
    high, low, near, far = columns
    return (high.astype(np.uint64) << np.uint64(32)) | low, near | (far.astype(np.uint32) << np.uint32(16))


def _text_pieces(batch: pa.RecordBatch):
    """(first row, row behind the last, place in its text, bytes, edges) of chunks of HELD_DOCS whole texts at most, or of overlapping pieces of a long one."""
    data, offsets = text_buffer(batch.column("text"))
    for a, b in ((s, min(b, s + HELD_DOCS)) for a, b in chunks(offsets) for s in range(a, b, HELD_DOCS)):
        lo, hi = int(offsets[a]), int(offsets[b])
        if b - a > 1 or hi - lo <= PIECE:
            yield a, b, 0, data[lo:hi], offsets[a:b + 1] - lo
        else:
            for at in range(lo, hi, PIECE):
                piece = data[at:min(hi, at + PIECE + NEED - 1)]
                yield a, b, at - lo, piece, np.array([0, len(piece)])


def _shared_places(docs: DataFrame, groups: int, buckets: int) -> DataFrame:
    """b, n, data: the anchors (document and offset) whose key occurs in two documents or more, by bucket of the document; b -1: a hot key and its places."""
    def deal(batches):
        hold_pages()
        keys, rows, offs, owners = [], [], [], []

        def flush():
            named = np.array(owners, np.uint64)
            packed, off = np.concatenate(keys), np.concatenate(offs)
            packed = (packed << np.uint64(16)) | np.concatenate(rows).astype(np.uint64)
            order = np.argsort(packed)  # the order of a document's own places is of no account
            packed, off = packed[order], off[order]
            key, own = packed >> np.uint64(16), named[(packed & np.uint64(0xFFFF)).astype(np.int64)]
            first = _groups(key)
            new_doc = np.concatenate(([True], packed[1:] != packed[:-1]))
            sizes = np.diff(np.append(first, len(key)))
            local = np.repeat(np.add.reduceat(new_doc, first) > 1, sizes)
            lead = np.zeros(len(key), bool)
            lead[first] = True
            # a key that two documents here share is settled here; one entry of it goes on, with their number
            told = np.where(local, np.repeat(sizes, sizes).astype(np.uint32) | _KNOWN, off)
            sent = lead | ~local
            sent_key = key[sent]
            for p, blob in _deal((sent_key % np.uint64(groups)).astype(np.int32),
                                 [(sent_key >> np.uint64(32)).astype("<u2"), sent_key.astype("<u4"), *_owned(own[sent], told[sent])]):
                yield p, False, blob
            if local.any():
                yield int(own[local][0] % np.uint64(groups)), True, b"".join([c.tobytes() for c in _owned(own[local], off[local])])

        def told():
            out = list(flush()) if keys else []
            for held in (keys, rows, offs, owners):
                held.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kind) for i, kind in enumerate((pa.int32(), pa.bool_(), pa.binary()))], names=["p", "settled", "data"])

        for batch in batches:
            names, base = _ids(batch.column("doc_id")), -1
            last_row = -1
            for a, b, before, data, bounds in _text_pieces(batch):
                if a != last_row:
                    if sum(map(len, keys)) > HELD or len(owners) + b - a > HELD_DOCS:
                        yield told()
                    base, last_row = len(owners), a
                    if b - a > 1 or before == 0 and bounds[-1] <= PIECE:
                        crcs = [zlib.crc32(data[s:e]) for s, e in zip(bounds, bounds[1:])]
                    else:
                        crcs = [zlib.crc32(batch.column("text")[a].as_buffer())]
                    owners += owner_of(names[a:b].copy(), np.array(crcs, np.uint32)).tolist()
                at = anchors(data, bounds)
                total, (_, down) = prefix_sums(data), powers(len(data) + 1)
                keys.append(mix((total[at + KMER] - total[at]) * down[at]) >> np.uint64(16))
                row = np.searchsorted(bounds, at, side="right") - 1
                rows.append((base + row).astype(np.uint16))
                offs.append((at - bounds[row] + before).astype(np.uint32))
        yield told()

    def meet(pdf):
        import pandas as pd

        hold_pages()
        out, parts = [], []
        for settled, blob in zip(pdf["settled"], pdf["data"], strict=True):
            if settled:
                columns = _columns(blob, _OWNED)
                out += [(b, 0, x) for b, x in _deal(bucket_of(_of_owned(columns)[0], buckets), columns)]
            else:
                columns = _columns(blob, _ENTRY)
                parts.append(((columns[0].astype(np.uint64) << np.uint64(32)) | columns[1], *_of_owned(columns[2:])))
        if parts:
            key, own, off = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.argsort(key)
            key, own, off = key[order], own[order], off[order]
            first = _groups(key)
            sizes = np.diff(np.append(first, len(key)))
            known = (off & _KNOWN) > 0
            shared = (np.minimum.reduceat(own, first) < np.maximum.reduceat(own, first)) | np.logical_or.reduceat(known, first)
            keep = np.repeat(shared, sizes) & ~known
            out += [(b, 0, x) for b, x in _deal(bucket_of(own[keep], buckets), _owned(own[keep], off[keep]))]
            places = np.add.reduceat(np.where(known, off & ~_KNOWN, 1).astype(np.int64), first)
            out += [(-1, n, int(k).to_bytes(8, "little")) for k, n in zip(key[first[places >= HOT]].tolist(), places[places >= HOT].tolist(), strict=True)]
        return pd.DataFrame(out, columns=["b", "n", "data"])

    dealt = docs.mapInArrow(lean(deal), "p int, settled boolean, data binary")
    return dealt.repartition(groups, "p").groupBy("p").applyInPandas(lean_group(meet), "b int, n long, data binary")


def _bucketed(docs: DataFrame, buckets: int) -> DataFrame:
    """Documents with their bucket b and crc."""
    def run(batches):
        for batch in batches:
            data, offsets = text_buffer(batch.column("text"))
            crcs = np.array([zlib.crc32(data[s:e]) for s, e in zip(offsets, offsets[1:])], np.uint32)
            b = bucket_of(owner_of(_ids(batch.column("doc_id")), crcs), buckets)
            yield pa.RecordBatch.from_arrays([pa.array(b), pa.array(crcs.astype(np.int64)), batch.column("doc_id"), batch.column("text")], names=["b", "crc", "doc_id", "text"])

    return docs.mapInArrow(lean(run), "b int, crc long, doc_id long, text string").repartition(buckets, "b")


def _union(row: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans by row, merged where they touch."""
    order = np.lexsort((s, row))
    row, s, e = row[order].astype(np.int64), s[order].astype(np.int64), e[order].astype(np.int64)
    if not len(row):
        return row, s, e
    reach = np.maximum.accumulate((row << 32) + e) - (row << 32)
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (s[1:] > reach[:-1])
    first = np.flatnonzero(new)
    return row[first], s[first], np.maximum.reduceat(e, first)


def _words(columns: np.ndarray) -> list[np.ndarray]:
    """Byte columns as big-endian words, the most significant first."""
    padded = np.zeros((len(columns), -(-columns.shape[1] // 8) * 8), np.uint8)
    padded[:, :columns.shape[1]] = columns
    return list(padded.view(">u8").astype(np.uint64).T)


def _sorted(keys: list[np.ndarray]) -> np.ndarray:
    """The order by all keys, the most significant first: by one key at a time, and then only what ties in it."""
    order = np.argsort(keys[0])
    tie = np.arange(len(order))  # places of the order that still tie, and the first place of each one's group
    group = np.zeros(len(order), np.int64)
    for last, key in zip(keys, keys[1:]):
        now = last[order[tie]]
        fresh = np.ones(len(tie), bool)
        fresh[1:] = (now[1:] != now[:-1]) | (group[1:] != group[:-1])
        first = np.flatnonzero(fresh)
        size = np.diff(np.append(first, len(tie)))
        group = np.repeat(tie[first], size)
        many = np.repeat(size > 1, size)
        tie, group = tie[many], group[many]
        if not len(tie):
            break
        rows = order[tie]
        order[tie] = rows[np.lexsort((key[rows], group))]
    return order


def _pack_run(right: np.ndarray, left: np.ndarray, la: np.ndarray, ra: np.ndarray, place: np.ndarray) -> bytes:
    """A sorted run, its suffixes front-coded: shared length, then only the bytes that differ."""
    n = len(right)
    shared = np.zeros(n, np.uint8)
    differs = right[1:] != right[:-1]
    shared[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), NEED)
    tails = right[np.arange(NEED) >= shared[:, None]]
    return np.uint32(n).tobytes() + b"".join(x.tobytes() for x in (shared, la, ra, left, place, tails))


def _unpack_run(blob: bytes):
    n, at = int(np.frombuffer(blob, np.uint32, 1)[0]), 4
    shared, la, ra = (np.frombuffer(blob, np.uint8, n, at + i * n) for i in range(3))
    at += 3 * n
    left = np.frombuffer(blob, np.uint8, n * LEFT, at).reshape(n, LEFT)
    at += n * LEFT
    place = np.frombuffer(blob, _PLACE, n, at)
    at += n * _PLACE.itemsize
    # a byte is that of the last suffix so far which shares less than what stands before it
    begin = at + np.cumsum(NEED - shared.astype(np.int64)) - NEED
    row, data, suffixes = np.arange(n), np.frombuffer(blob, np.uint8), np.empty((n, NEED), np.uint8)
    for k in range(NEED):
        suffixes[:, k] = data[begin[np.maximum.accumulate(np.where(shared <= k, row, 0))] + k]
    whole, number = suffixes.tobytes(), int.from_bytes
    return [number(whole[s:s + NEED]) for s in range(0, n * NEED, NEED)], shared.tolist(), left, la, ra, place


def merge_runs(runs: list[tuple[list[int], list[int]]]) -> tuple[list[int], list[int]]:
    """Merge sorted runs with a loser tree: places in the joined runs, and bytes shared with the one before.

    A run is (suffixes as integers of NEED bytes, bytes that each shares with the one before).
    Contenders carry the length they share with the last output: the longer wins unseen, and
    only what lies behind equal lengths is compared.
    """
    k = len(runs)
    size = 1 << max(k - 1, 0).bit_length()
    base, total = [], 0
    for values, _ in runs:
        base.append(total)
        total += len(values)
    at, value, share = [0] * size, [0] * size, [-1] * size
    for i, (values, _) in enumerate(runs):
        if values:
            value[i], share[i] = values[0], 0
    losers = [-1] * size

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's share becomes what it shares with the winner."""
        if share[a] != share[b]:
            return (a, b) if share[a] > share[b] else (b, a)
        if share[a] < 0:
            return a, b
        differ = value[a] ^ value[b]
        if value[b] < value[a]:
            a, b = b, a
        share[b] = NEED - ((differ.bit_length() + 7) >> 3)
        return a, b

    winners = [-1] * size + list(range(size))  # the leaves stand behind the inner nodes
    for node in range(size - 1, 0, -1):
        winners[node], losers[node] = play(winners[2 * node], winners[2 * node + 1])
    w = winners[1]
    order, common = [], []
    while total:
        values, lengths = runs[w]
        order.append(base[w] + at[w])
        common.append(share[w])
        total -= 1
        at[w] += 1
        if at[w] < len(values):
            value[w], share[w] = values[at[w]], lengths[at[w]]
        else:
            share[w] = -1
        node = (w + size) >> 1
        while node:
            other = losers[node]
            a, b = share[other], share[w]
            if a > b:
                losers[node], w = w, other
            elif a == b and a >= 0:
                w, losers[node] = play(w, other)
            node >>= 1
    return order, common


def _shared_heads(rows: np.ndarray) -> np.ndarray:
    """For sorted byte rows: how many bytes each shares with the one before."""
    out = np.zeros(len(rows), np.int64)
    differs = rows[1:] != rows[:-1]
    out[1:] = np.where(differs.any(axis=1), differs.argmax(axis=1), rows.shape[1])
    return out


def _runs(docs: DataFrame, places: DataFrame, parts: int, hot_keys: np.ndarray) -> DataFrame:
    """r, run, data: sorted front-coded runs by part of the suffixes, and spans that are settled within a bucket.

    Suffixes with a hot key would all meet in one part.  So their windows are compared within
    the bucket first, and every window that no smaller document here has goes on as a suffix of
    its own, dealt by all its bytes.
    """
    names = pa.schema([("r", pa.int32()), ("run", pa.bool_()), ("data", pa.binary())])
    shared = docs.sparkSession.sparkContext.broadcast(hot_keys)

    def hashed(rows: np.ndarray) -> np.ndarray:
        up, _ = powers(NEED)
        return mix((_RAW[rows] * up[:rows.shape[1]]).sum(axis=1, dtype=np.uint64))

    def told(part: np.ndarray, right: np.ndarray, left: np.ndarray, la: np.ndarray, ra: np.ndarray, place: np.ndarray):
        """Runs by part; the rows come sorted."""
        order = np.argsort(part, kind="stable")
        cuts = _groups(part[order])
        for s, e in zip(cuts, [*cuts[1:], len(part)]):
            k = order[s:e]
            yield int(part[k[0]]), True, _pack_run(right[k], left[k], la[k], ra[k], place[k])

    def windows(context: np.ndarray, la: np.ndarray, ra: np.ndarray, place: np.ndarray):
        """Runs of the windows around hot places (sorted) that no smaller document of the bucket has, and the spans that one has."""
        common = _shared_heads(context[:, LEFT:])
        open_ = np.zeros((len(place), LEFT + 1), bool)
        low, high = beaten(common, context[:, :LEFT], la, ra, place["id"], open_)
        hit = np.flatnonzero(high >= 0)
        if len(hit):
            spans = np.empty(len(hit), _SPAN)
            spans["id"], spans["crc"] = place["id"][hit], place["crc"][hit]
            spans["s"], spans["e"] = place["off"][hit] - high[hit], place["off"][hit] - low[hit] + NEED
            yield int(place["crc"][0]) % parts, False, spans.tobytes()
        for s in range(0, len(place), LISTED):
            row, o = np.nonzero(open_[s:s + LISTED])
            row += s
            text = context[row[:, None], (LEFT - o)[:, None] + np.arange(NEED)]
            at = place[row]
            at["off"] -= o.astype(np.uint32)
            order = _sorted([*_words(text), at["id"]])
            text, at = text[order], at[order]
            none = np.zeros(len(at), np.uint8)
            yield from told((hashed(text) % np.uint64(parts)).astype(np.int32), text, np.zeros((len(at), LEFT), np.uint8), none, none + np.uint8(NEED), at)

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        hold_pages()
        out: list[tuple[int, bool, bytes]] = []
        blobs = [x.as_buffer() for x in right.column("data")]
        if left.num_rows and blobs:
            table = left.combine_chunks()
            texts = table.column("text").combine_chunks()
            data, offsets = text_buffer(texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks))
            ids, crcs = _ids(pa.concat_arrays(table.column("doc_id").chunks)), table.column("crc").to_numpy().astype(np.uint32)
            texts_of = np.unique(np.rec.fromarrays([owner_of(ids, crcs), ids, crcs], names="own,id,crc"), return_index=True)[1]
            names_of = owner_of(ids, crcs)[texts_of]
            own, off = (np.concatenate(x) for x in zip(*[_of_owned(_columns(b, _OWNED)) for b in blobs], strict=True))
            first, last = np.searchsorted(names_of, own), np.searchsorted(names_of, own, side="right")
            n = last - first  # texts of this name: one, or seldom more
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            row, off = texts_of[np.repeat(first, n) + at], np.repeat(off, n).astype(np.int64)
            fits = np.minimum(off, LEFT) + np.minimum(offsets[row + 1] - offsets[row] - off, NEED) >= NEED
            row, off = row[fits], off[fits]
            place = np.empty(len(row), _PLACE)
            place["id"], place["crc"], place["off"] = ids[row], crcs[row], off
            start = offsets[row]
            la, ra = np.minimum(off, LEFT), np.minimum(offsets[row + 1] - start - off, NEED)
            span = np.arange(-LEFT, NEED)
            context = np.zeros((len(place), LEFT + NEED), np.uint8)
            for s in range(0, len(place), 50_000):
                cut = slice(s, s + 50_000)
                at = (start + off)[cut, None] + span
                ok = (span >= -la[cut, None]) & (span < ra[cut, None])
                context[cut] = np.where(ok, data[np.clip(at, 0, len(data) - 1)], 0)
            order = _sorted([*_words(context[:, LEFT:]), *_words(context[:, :LEFT]), la, ra, place["id"], off])
            context, place, row, off, la, ra = context[order], place[order], row[order], off[order], la[order], ra[order]
            same = np.zeros(len(place), bool)
            same[1:] = (context[1:] == context[:-1]).all(axis=1) & (la[1:] == la[:-1]) & (ra[1:] == ra[:-1])
            first = np.flatnonzero(~same)
            least = np.repeat(place["id"][first], np.diff(np.append(first, len(place))))
            lost = place["id"] > least  # the same neighbourhood in a document with a smaller id, here
            if lost.any():
                r, s, e = _union(row[lost], off[lost] - la[lost], off[lost] + ra[lost])
                spans = np.empty(len(r), _SPAN)
                spans["id"], spans["crc"], spans["s"], spans["e"] = ids[r], crcs[r], s, e
                out.append((int(crcs[0]) % parts, False, spans.tobytes()))
            keep = ~lost
            context, place, la, ra = context[keep], place[keep], la[keep].astype(np.uint8), ra[keep].astype(np.uint8)
            key = hashed(context[:, LEFT:LEFT + KMER])
            hot = shared.value
            if len(hot):
                short = key >> np.uint64(16)
                is_hot = hot[np.minimum(np.searchsorted(hot, short), len(hot) - 1)] == short
                if is_hot.any():
                    out += windows(context[is_hot], la[is_hot], ra[is_hot], place[is_hot])
                    key, context, place, la, ra = (x[~is_hot] for x in (key, context, place, la, ra))
            out += told((key % np.uint64(parts)).astype(np.int32), context[:, LEFT:], context[:, :LEFT], la, ra, place)
        return pa.Table.from_arrays([pa.array([x[i] for x in out], f.type) for i, f in enumerate(names)], schema=names)

    return docs.groupBy("b").cogroup(places.groupBy("b")).applyInArrow(lean_group(work), "r int, run boolean, data binary")


def beaten(common: np.ndarray, left: np.ndarray, la: np.ndarray, ra: np.ndarray, ids: np.ndarray, open_: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Per suffix, in merged order, the least and largest number of bytes before it at which a window also starts in a smaller id; (1, 0)-like for none.

    ``common`` has the bytes that each shares with the one before.  Suffixes share the first k
    bytes where no smaller number stands between them, so the merged order falls into runs for
    every k; the bytes before the suffixes, read backwards and sorted, fall into runs likewise.
    A window that begins o bytes before is a run of NEED - o there and a run of o here.
    ``open_`` takes the windows that no smaller id has, one of each kind and id.
    """
    n = len(ids)
    low, high = np.full(n, NEED, np.int64), np.full(n, -1, np.int64)
    if not n:
        return low, high
    back = np.ascontiguousarray(left[:, ::-1])
    order = np.lexsort([*reversed(_words(back))])
    shared = _shared_heads(back[order])
    behind = np.append(common[1:], 0)
    before = np.empty(n, np.uint64)
    for o in range(LEFT + 1):
        need = NEED - o
        whole = (la >= o) & (ra >= need)
        k = np.flatnonzero(whole if open_ is not None else whole & ((common >= need) | (behind >= need)))
        if not len(k):
            continue
        before[order] = np.cumsum(shared < o).astype(np.uint64)
        kind = (np.cumsum(common < need)[k].astype(np.uint64) << np.uint64(32)) | before[k]
        at = np.argsort(kind, kind="stable")
        kind, k = kind[at], k[at]
        first = _groups(kind)
        least = np.repeat(np.minimum.reduceat(ids[k], first), np.diff(np.append(first, len(kind))))
        lost = ids[k] > least
        hit = k[lost]
        low[hit], high[hit] = np.minimum(low[hit], o), np.maximum(high[hit], o)
        if open_ is not None:
            open_[k[~lost], o] = True
    return low, high


def _spans(runs: DataFrame, buckets: int) -> DataFrame:
    """b, data: removed spans by bucket of their document."""
    def work(pdf):
        import pandas as pd

        hold_pages()
        out = []
        for run, blob in zip(pdf["run"], pdf["data"], strict=True):
            if not run:
                spans = np.frombuffer(blob, _SPAN)
                out += _cut(bucket_of(owner_of(spans["id"].copy(), spans["crc"]), buckets), spans)
        got = [_unpack_run(b) for r, b in zip(pdf["run"], pdf["data"], strict=True) if r]
        if got:
            order, common = merge_runs([(g[0], g[1]) for g in got])
            order, common = np.array(order, np.int64), np.array(common, np.int64)
            left, la, ra, place = (np.concatenate([g[i] for g in got])[order] for i in range(2, 6))
            del got
            first = np.flatnonzero(common < KMER)
            sizes = np.diff(np.append(first, len(common)))
            most, least = np.maximum.reduceat(place["id"], first), np.minimum.reduceat(place["id"], first)
            keep = np.repeat(most > least, sizes)  # whole runs of KMER common bytes, in more than one document
            place = place[keep]
            low, high = beaten(common[keep], left[keep], la[keep], ra[keep], place["id"])
            hit = np.flatnonzero(high >= 0)
            spans = np.empty(len(hit), _SPAN)
            spans["id"], spans["crc"] = place["id"][hit], place["crc"][hit]
            spans["s"], spans["e"] = place["off"][hit] - high[hit], place["off"][hit] - low[hit] + NEED
            out += _cut(bucket_of(owner_of(spans["id"].copy(), spans["crc"]), buckets), spans)
        return pd.DataFrame(out, columns=["b", "data"])

    return runs.groupBy("r").applyInPandas(lean_group(work), "b int, data binary")


def _kept(docs: DataFrame, spans: DataFrame) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])

    def work(left: pa.Table, right: pa.Table) -> pa.Table:
        blobs = [np.frombuffer(x.as_buffer(), _SPAN) for x in right.column("data")]
        removed: dict[tuple[int, int], list[tuple[int, int]]] = {}
        if blobs:
            every = np.concatenate(blobs)
            every = every[np.lexsort((every["crc"], every["id"]))]
            new = np.ones(len(every), bool)
            new[1:] = (every["id"][1:] != every["id"][:-1]) | (every["crc"][1:] != every["crc"][:-1])
            r, s, e = _union(np.cumsum(new) - 1, every["s"], every["e"])
            keys = every[new][["id", "crc"]].tolist()
            for k, a, b in zip(r.tolist(), s.tolist(), e.tolist(), strict=True):
                removed.setdefault(tuple(keys[k]), []).append((a, b))
        rows = []
        for doc_id, crc, text in zip(left.column("doc_id"), left.column("crc").to_pylist(), left.column("text"), strict=True):
            raw = memoryview(text.as_buffer()) if text.is_valid else memoryview(b"")
            key = doc_id.as_py() if doc_id.is_valid else int(_LAST_ID)
            found, at, sha, n = removed.get((key, crc), []), 0, hashlib.sha256(), 0
            for a, b in found:
                sha.update(raw[at:a])
                n += b - a
                at = b
            sha.update(raw[at:])
            rows.append((doc_id.as_py(), len(raw), n, len(found), sha.hexdigest()))
        return pa.Table.from_arrays([pa.array([x[i] for x in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.groupBy("b").cogroup(spans.groupBy("b")).applyInArrow(lean_group(work), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document.

    A byte goes if a string of NEED bytes around it also starts in a document with a smaller
    doc_id.  A null id is larger than any other; rows that share an id never shorten each
    other; null and empty texts have no bytes; long texts are looked at in overlapping pieces
    and decided whole; an empty table gives an empty one; other columns are ignored, whatever
    their names.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    size = int(docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    groups, buckets = shuffle_width(spark, size // 15, PER_GROUP), shuffle_width(spark, size, BUCKET_BYTES)
    places = stage(_shared_places(docs, groups, buckets), "places")
    release(spark)
    hot = places.filter(F.col("b") < 0).orderBy(F.desc("n"), "data").limit(HOT_KEYS).select("data").collect()
    hot_keys = np.sort(np.array([int.from_bytes(r["data"], "little") for r in hot], np.uint64))
    runs = _runs(_bucketed(docs, buckets), places.filter(F.col("b") >= 0).select("b", "data").repartition(buckets, "b"), buckets, hot_keys)
    spans = stage(_spans(runs.repartition(buckets, "r"), buckets), "spans")
    del runs
    unstage(places)
    release(spark)
    return _kept(_bucketed(docs, buckets), spans.repartition(buckets, "b"))
