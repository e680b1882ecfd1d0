"""Jaccard join, repeats, decontamination, components, urls, neighbours, pages and the pipeline against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from corvane.llm import ann, decontam, graph, html_text, jaccard, shingles, suffixes, urls

from .data import documents, empty, prose, texts


def find(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "LAST_EDGES", 40)  # several rounds
    rnd = random.Random(4)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(7, 7)]
    parent = {x: x for e in edges for x in e}
    for a, b in edges:
        a, b = find(parent, a), find(parent, b)
        parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    groups = defaultdict(set)
    for x in parent:
        groups[got.get(x, x)].add(x)
    truth = defaultdict(set)
    for x in parent:
        truth[find(parent, x)].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, truth.values()))
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def word_sets(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    return {tuple(words[k:k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()


def brute_link(rows):
    sets = [word_sets(t) for _, t in rows]
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            r = find(parent, k)
            least[r] = min(least.get(r, i), i)
    return sorted((str(i), len(s), str(least.get(find(parent, k)) if s else i)) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True)))


def linked_rows(df):
    return sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in df.collect())


def test_jaccard_matches_brute_force(spark):
    docs = documents(spark)
    assert linked_rows(jaccard.link(docs)) == brute_link([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert jaccard.link(empty(spark, docs)).count() == 0


def test_jaccard_with_tiny_blocks(spark, monkeypatch):
    """Many flushes, split groups and a near-copy chain give the same components."""
    for name, value in (("ENTRIES", 200), ("COUNTED", 500), ("PER_TASK", 300), ("PER_FEW", 300), ("SMALL_BYTES", 5), ("HEAVY_DOCS", 3)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(8)
    words = prose(rnd, 80).split()
    rows = []
    for k in range(60):  # each step changes one word more
        words[rnd.randrange(80)] = f"w{k}"
        rows.append((1000 + k, " ".join(words)))
    rows += list(enumerate(texts(5, 30)))
    assert linked_rows(jaccard.link(documents(spark, rows))) == brute_link(rows)


def test_jaccard_splits_a_group_of_near_copies(spark, monkeypatch):
    for name, value in (("PER_TASK", 2000), ("LEAST_TASK", 500), ("PIVOTS", 6)):
        monkeypatch.setattr(jaccard, name, value)
    rnd = random.Random(18)
    base, rows = prose(rnd, 60).split(), []
    for k in range(250):
        words = list(base)
        for _ in range(rnd.randrange(4)):
            words[rnd.randrange(60)] = f"v{rnd.randrange(9)}"
        rows.append((k, " ".join(words)))
    assert linked_rows(jaccard.link(documents(spark, rows))) == brute_link(rows)


def quoting(rnd, families, size=60):
    """Families of near copies whose every text quotes a passage of the family before, so that one chain of shared shingles holds all."""
    rows, last = [], prose(rnd, 20)
    for f in range(families):
        base = [f"f{f}{w}" for w in prose(rnd, size).split()]
        for k in range(3):
            words = list(base)
            for _ in range(rnd.randrange(4)):
                words[rnd.randrange(size)] = f"v{f}{rnd.randrange(99)}"
            rows.append((1000 * f + k, " ".join(words) + " " + last))
        last = " ".join(base[:20])
    return rows


@pytest.mark.parametrize("settings", [{}, {"FEW": 2, "PER_PART": 400, "LIGHT": 4, "HELD_PAIRS": 50, "SMALL_BYTES": 5}, {"FEW": 0, "LIGHT": 2}])
def test_jaccard_parts_a_chain_of_quoting_texts(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = quoting(random.Random(23), 50)
    rows += rows[:2] + [(None, rows[5][1]), (7, rows[9][1]), (7, "another text of an id")]
    met, verified = [], jaccard._linked_in_groups
    monkeypatch.setattr(jaccard, "_linked_in_groups", lambda docs, placed: met.append(placed.select("d1", F.explode("keys").alias("k")).groupBy("k").count().agg(F.max("count")).first()[0]) or verified(docs, placed))
    assert linked_rows(jaccard.link(documents(spark, rows))) == brute_link(rows)
    if not settings:
        assert met[0] <= 9  # no group of the trees holds much more than a family; the chain holds all 50


def test_jaccard_fetches_few_texts_beside_those_asked_for(spark):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text")).unionByName(spark.createDataFrame([(None, "null")], "doc_id long, text string"))
    ids = spark.createDataFrame([(k * 7,) for k in range(500)] + [(None,)], "first long")
    got = [r["doc_id"] for r in jaccard._asked(docs, ids, 501).collect()]
    assert {None, *range(0, 3500, 7)} <= set(got) and len(got) == len(set(got)) < 3000


def test_pairs_bound_what_sets_share(monkeypatch):
    """Light tokens of a pair and the heavy ones of either bound what it shares, and what may link is linked where all is light."""
    rnd = np.random.default_rng(5)
    for light, held in ((3, 20), (64, 4_000_000)):
        monkeypatch.setattr(jaccard, "LIGHT", light)
        monkeypatch.setattr(jaccard, "HELD_PAIRS", held)
        base = [rnd.integers(0, 1 << 63, 30, dtype=np.uint64) for _ in range(4)]
        sets = sorted((np.unique(np.concatenate([b[rnd.integers(0, 6):], rnd.integers(0, 1 << 63, rnd.integers(0, 9), dtype=np.uint64), base[0][:5]])) for b in base for _ in range(9)), key=len)
        n = np.array([len(s) for s in sets])
        a, b, common, heavy = jaccard.pairs_of(n, np.repeat(np.arange(len(sets)), n), np.concatenate(sets))
        told = {(x, y): c for x, y, c in zip(a.tolist(), b.tolist(), common.tolist(), strict=True)}
        assert len(told) == len(a)
        for y in range(len(sets)):
            for x in range(y):
                both = len(np.intersect1d(sets[x], sets[y]))
                if jaccard.linked(both, n[x], n[y]):
                    assert both <= told.get((x, y), 0) + min(heavy[x], heavy[y])
                    assert jaccard._may_link(told.get((x, y), 0), min(heavy[x], heavy[y]), n[x] + n[y])
                if light == 64 and (x, y) in told:
                    assert told[x, y] == both and not heavy[x]


def test_size_codes_bound_sizes():
    n = np.unique(np.concatenate([np.arange(1, 5000), (1.013 ** np.arange(1, 1600)).astype(np.int64)]))
    n = n[n < 1 << 30]
    code = jaccard.size_code(n)
    assert code.max() < 1 << 15 and (np.diff(code.astype(int)) >= 0).all()
    assert (jaccard.least_size(code) <= n).all() and (jaccard.most_size(code) >= n).all() and (jaccard.least_size(code) >= 0.999 * n - 1).all()


def test_keep_first(spark):
    t = prose(random.Random(1), 60)
    docs = documents(spark, [(5, t), (2, t + " more"), (9, "other words entirely here now"), (3, None), (4, "")], extra=False)
    kept = jaccard.keep_first(docs)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3, 4, 9]


def test_signature_tree_matches_all_pairs():
    rnd = np.random.default_rng(3)
    base = [np.unique(rnd.integers(0, 1 << 63, 40, dtype=np.uint64)) for _ in range(12)]
    sets = base + [np.unique(np.concatenate([b[k:], rnd.integers(0, 1 << 63, k, dtype=np.uint64)])) for b in base for k in range(1, 9)]
    forest = jaccard.SignatureTree(sets).connect()
    parent = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if jaccard.linked(len(np.intersect1d(sets[i], sets[j])), len(sets[i]), len(sets[j])):
                a, b = find(parent, i), find(parent, j)
                parent[max(a, b)] = min(a, b)
    assert all((find(parent, i) == find(parent, j)) == (forest.find(i) == forest.find(j)) for i in range(len(sets)) for j in range(i))


def test_shingles_do_not_depend_on_chunks(monkeypatch):
    import pyarrow as pa

    column = pa.array(texts(6))
    whole = [s.tolist() for s in shingles.shingle_sets(column)]
    monkeypatch.setattr(shingles, "CHUNK", 50)
    assert whole == [s.tolist() for s in shingles.shingle_sets(column)]
    assert whole[3:9] == [s.tolist() for s in shingles.shingle_sets(column.slice(3, 6))]
    assert [len(s) for s in whole] == [len(word_sets(t)) for t in column.to_pylist()]


def brute_repeats(rows):
    big = 1 << 70
    raw = [(big if i is None else i, (t or "").encode()) for i, t in rows]
    first = {}
    for i, b in raw:
        for k in range(len(b) - 49):
            first[b[k:k + 50]] = min(i, first.get(b[k:k + 50], big))
    out = []
    for (i, _), (rank, b) in zip(rows, raw, strict=True):
        gone = np.zeros(len(b) + 1, bool)
        for k in range(len(b) - 49):
            if first[b[k:k + 50]] < rank:
                gone[k:k + 50] = True
        kept = bytes(c for c, g in zip(b, gone) if not g)
        out.append((str(i), len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def repeat_rows(df):
    return sorted((str(r[0]), *r[1:]) for r in df.collect())


def test_repeats_match_brute_force(spark):
    docs = documents(spark)
    assert repeat_rows(suffixes.remove_repeats(docs)) == brute_repeats([(r["doc_id"], r["text"]) for r in docs.collect()])
    assert suffixes.remove_repeats(empty(spark, docs)).count() == 0


def test_repeats_with_tiny_blocks(spark, monkeypatch):
    for name, value in (("HELD", 100), ("HELD_DOCS", 5), ("PER_GROUP", 200), ("BUCKET_BYTES", 4000), ("PIECE", 500)):
        monkeypatch.setattr(suffixes, name, value)
    monkeypatch.setattr(shingles, "CHUNK", 900)
    rows = list(enumerate(texts(7, 25)))
    assert repeat_rows(suffixes.remove_repeats(documents(spark, rows))) == brute_repeats(rows)


def test_repeats_of_many_short_texts_in_one_task(spark):
    rnd = random.Random(17)
    rows = [(k, f"{rnd.getrandbits(240):060x}") for k in range(67_000)]
    rows += [(k, rows[k - 30_000][1][4:] + f"{k:06d}") for k in range(67_000, 70_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert repeat_rows(suffixes.remove_repeats(docs)) == brute_repeats(rows)


def test_repeats_after_a_run_of_empty_texts(spark):
    batch = "spark.sql.execution.arrow.maxRecordsPerBatch"
    rows = [(k, None if k % 2 else "") for k in range(70_000)] + list(enumerate(texts(8, 25), 70_000))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    before = spark.conf.get(batch)
    spark.conf.set(batch, "0")
    try:
        assert repeat_rows(suffixes.remove_repeats(docs)) == brute_repeats(rows)
    finally:
        spark.conf.set(batch, before)


def hot_texts(n, seed=23):
    """Texts around a string of 30 bytes, one of 60 and one of 48, with other bytes on both sides in each."""
    rnd = random.Random(seed)
    lines = [f"{rnd.getrandbits(4 * k):0{k}x}" for k in (30, 60, 48)]
    out = []
    for k in range(n):
        text = f"{rnd.getrandbits(160):040x}{lines[k % 3]}{rnd.getrandbits(160):040x}"
        out.append(text if k % 7 else text + lines[1] + text[:70])
    return out


def test_repeats_with_hot_keys(spark, monkeypatch):
    for name, value in (("HOT", 20), ("BUCKET_BYTES", 6000), ("LISTED", 7), ("HELD", 2000)):
        monkeypatch.setattr(suffixes, name, value)
    rows = list(enumerate(hot_texts(400))) + [(k, t) for k, t in enumerate(texts(9, 20), 300)]
    assert repeat_rows(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == brute_repeats(rows)


def test_repeats_of_one_short_string_in_many_documents(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 2000)
    rows = list(enumerate(hot_texts(20_000)))
    assert repeat_rows(suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"))) == brute_repeats(rows)


def test_anchors_take_few_passes_and_little_memory():
    import tracemalloc

    data = np.random.default_rng(3).integers(97, 101, 1 << 18).astype(np.uint8)
    bounds = np.array([0, 30, 90, 5000, len(data)])
    small = sum((data[k:len(data) - 4 + k].astype(np.uint64) << np.uint64(8 * (4 - k)) for k in range(5)), np.zeros(len(data) - 4, np.uint64))
    least = (shingles.mix(small) >> np.uint64(32)).tolist()
    want = set()
    for lo, hi in zip(bounds.tolist(), bounds[1:].tolist()):
        for s in range(lo, min(hi, 6000) - suffixes.NEED + 1):
            want.add(s + (min(range(46), key=lambda k: (least[s + k], k))) % 23)
    suffixes.anchors(data, bounds)
    tracemalloc.start()
    got = suffixes.anchors(data, bounds)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    inside = [a for a in got.tolist() if a < 5900]
    assert inside == sorted(a for a in want if a < 5900)
    assert most < 36 * len(data), most / len(data)


def test_order_by_many_keys_and_front_coded_runs():
    rng = np.random.default_rng(4)
    keys = [rng.integers(0, n, 3000).astype(np.uint64) for n in (3, 2, 9, 4, 50)]
    keys[-1] = np.arange(3000, dtype=np.uint64)[::-1]
    assert suffixes._sorted(keys).tolist() == np.lexsort(keys[::-1]).tolist()
    assert suffixes._sorted([np.zeros(0, np.uint64)] * 2).tolist() == []
    right = rng.integers(97, 99, (500, suffixes.NEED)).astype(np.uint8)
    right[100:140] = right[100]
    right = right[np.lexsort(right.T[::-1])]
    other = np.zeros(500, np.uint8)
    values, shared, *_ = suffixes._unpack_run(suffixes._pack_run(right, np.zeros((500, suffixes.LEFT), np.uint8), other, other, np.zeros(500, suffixes._PLACE)))
    assert values == [int.from_bytes(r.tobytes(), "big") for r in right] and shared.count(suffixes.NEED) >= 39


def test_merged_order_decides_repeats(spark, monkeypatch):
    rows = list(enumerate(texts(7, 25)))
    docs = documents(spark, rows)
    monkeypatch.setattr(suffixes, "merge_runs", lambda runs: (list(range(sum(len(r[0]) for r in runs))), [0] * sum(len(r[0]) for r in runs)))
    work = suffixes._spans(spark.createDataFrame([], "r int, run boolean, data binary"), 4)  # the plan takes the function by value
    assert work.count() == 0 and suffixes.beaten(np.zeros(3, np.int64), np.zeros((3, suffixes.LEFT), np.uint8), *[np.full(3, 50)] * 2, np.arange(3))[1].max() == -1
    assert repeat_rows(suffixes.remove_repeats(docs)) != brute_repeats(rows)


def test_dealt_bytes_do_not_grow_with_groups(spark):
    """What the map tasks send is the same for few groups and many."""
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(4000), pa.int64()), "text": [prose(random.Random(k), 60) for k in range(4000)]})
    sent = {}
    for groups in (40, 2500):
        for name, make in (("repeats", lambda g: suffixes._shared_places(Given(), g, 4)), ("jaccard", lambda g: jaccard._shared_entries(Given(), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), g, 4))):
            Given.taken = None
            make(groups)
            sent[name, groups] = sum(len(x) for part in Given.taken([batch]) for c in part.columns if pa.types.is_binary(c.type) for x in c.to_pylist())
    for name in ("repeats", "jaccard"):
        assert sent[name, 2500] <= 1.2 * sent[name, 40]


class Given:
    """Stands in for a frame, to take hold of the function that maps its batches."""

    taken = None

    def __getattr__(self, name):
        return self

    def __call__(self, *args, **kwargs):
        return self

    def broadcast(self, value):
        return SimpleNamespace(value=value)

    def mapInArrow(self, run, schema):
        Given.taken = staticmethod(run)
        return self


def test_every_repeat_has_an_anchor():
    """Wherever a string of 50 bytes stands, one and the same place inside it is an anchor."""
    rnd = random.Random(2)
    for _ in range(200):
        s, common = bytes(rnd.choice(b"abc ") for _ in range(50)), None
        for _ in range(3):
            lead = bytes(rnd.choice(b"abc ") for _ in range(rnd.randrange(90)))
            data = np.frombuffer(lead + s + bytes(rnd.choice(b"abc ") for _ in range(60)), np.uint8)
            inside = {int(a) - len(lead) for a in suffixes.anchors(data, np.array([0, len(data)])) if 0 <= a - len(lead) <= 50 - suffixes.KMER}
            common = inside if common is None else common & inside
        assert common


def test_loser_tree_merges_and_knows_prefixes():
    rnd = random.Random(1)
    for k in (1, 2, 3, 7):
        runs = []
        for _ in range(k):
            values = sorted(bytes(rnd.choice(b"ab") for _ in range(suffixes.NEED)) if rnd.random() < 0.5 else b"a" * suffixes.NEED for _ in range(rnd.randrange(0, 30)))
            shared = [0] + [next((i for i in range(suffixes.NEED) if a[i] != b[i]), suffixes.NEED) for a, b in zip(values, values[1:])]
            runs.append(([int.from_bytes(v, "big") for v in values], shared[:len(values)]))
        order, common = suffixes.merge_runs(runs)
        flat = [v for values, _ in runs for v in values]
        got = [flat[i] for i in order]
        assert got == sorted(flat) and sorted(order) == list(range(len(flat)))
        raw = [v.to_bytes(suffixes.NEED, "big") for v in got]
        assert common[1:] == [next((i for i in range(suffixes.NEED) if a[i] != b[i]), suffixes.NEED) for a, b in zip(raw, raw[1:])]


def words7(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_hits(rows, items):
    out = []
    for i, text in rows:
        w, hit, named = words7(text), set(), set()
        for item, t in items:
            v = words7(t)
            for n in [min(10, len(v))] if v else []:
                grams = {tuple(v[k:k + n]) for k in range(len(v) - n + 1)}
                for k in range(len(w) - n + 1):
                    if tuple(w[k:k + n]) in grams:
                        hit.update(range(k, k + n))
                        named |= {str(item)} - {"None"}
        out.append((str(i), len(w), len(hit), len(named), hashlib.sha256(",".join(sorted(named)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


def brute_near(rows, items, docs, slop):
    """By the rarest term of each window (ties: the first), as the operator has it."""
    total = Counter(w for _, t in rows for w in words7(t))
    out = []
    for i, text in rows:
        w, near = words7(text), set()
        for k, v in enumerate(words7(t) for _, t in items):
            n = min(10, len(v))
            for q in range(len(v) - n + 1) if v else []:
                win = v[q:q + n]
                rare = min(win, key=lambda x: total[x])
                for p, word in enumerate(w):
                    if word == rare and total[rare] and set(win) <= set(w[max(0, p - 9 - slop):p + 10 + slop]):
                        near.add(k)
        out.append((str(i), len(near)))
    return sorted(out)


def test_decontamination_matches_brute_force(spark):
    rnd = random.Random(11)
    items = [(k, prose(rnd, rnd.randrange(1, 40))) for k in range(1, 15)] + [(15, None), (16, ""), (17, "--"), (18, "zebra"), (19, "Zebra é"), (None, "null item here")]
    rows = [(k, t) for k, t in enumerate(texts(9, 20))]
    for k, (_, t) in enumerate(items):
        if t:
            w = t.split()
            rows += [(500 + k, f"{prose(rnd, 20)} {t.upper()} {prose(rnd, 9)}"), (600 + k, " ".join(w[3:-3])), (700 + k, prose(rnd, 3) + "; ".join(w))]
    rows += rows[:2]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    docs = documents(spark, rows)
    truth = brute_hits(rows, items)
    assert sorted((str(r[0]), *r[1:6]) for r in decontam.decontaminate(docs, bench).collect()) == truth
    assert sorted((str(r["doc_id"]), r["n_near"]) for r in decontam.decontaminate(docs, bench, slop=2).collect()) == brute_near(rows, items, docs, 2)
    kept = decontam.keep_clean(docs, bench)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(t[0] for t in truth if not t[5])
    assert decontam.decontaminate(empty(spark, docs), bench).count() == 0
    assert decontam.decontaminate(docs, empty(spark, bench)).filter("contaminated").count() == 0


def test_decontamination_where_joins_shuffle(spark, monkeypatch):
    monkeypatch.setattr(decontam, "BROADCAST_BYTES", 0)
    rnd = random.Random(12)
    items = [(k, prose(rnd, 25)) for k in range(5)] + [(9, "zebra")]
    rows = [(k, prose(rnd, 12) + " " + items[k % 5][1] + " zebra" * (k % 3)) for k in range(12)] + [(50, None)]
    got = decontam.decontaminate(documents(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted((str(r[0]), *r[1:6]) for r in got.collect()) == brute_hits(rows, items)


@pytest.mark.parametrize("bytes_", [32 << 20, 0])
def test_repetitive_items(spark, monkeypatch, bytes_):
    """An item of one word over and over is one window, so it costs what that window costs."""
    import time

    monkeypatch.setattr(decontam, "BROADCAST_BYTES", bytes_)
    rows = [(k, "la " * (300 if k % 2 else 1000) + f"w{k}") for k in range(50)] + [(60, "la lo " * 200)]
    items = [(1, "la " * 400), (2, "la lo " * 150), (3, "la " * 12 + "lo la")]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert decontam.windows_of(bench, 10).count() == 1 + 2 + 3
    began = time.perf_counter()
    got = sorted((str(r[0]), *r[1:6]) for r in decontam.decontaminate(docs, bench).collect())
    assert got == brute_hits(rows, items) and time.perf_counter() - began < 60


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x gamma y alpha z beta w"), (2, "alpha beta"), (3, "alpha one two three four five six gamma beta")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    phrases, near = decontam.find_matches(docs, bench, width=3, slop=2)
    assert phrases.count() == 0 and {r["doc_id"] for r in near.collect()} == {1}


RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("a.com", "/fr/x", "block"), ("x.a.com", "/", "block"), ("a.com", "/fr", "block"), ("", "/q", "block")]


def test_urls_match_brute_force(spark):
    rnd = random.Random(3)
    made = [rnd.choice(["http://", "HTTPS://", "x", "://"]) + rnd.choice(["", "www.", "X.A."]) + rnd.choice(["example.org", "a.com", "b.com", "org", "Example.ORG", "a..com", ""]) + rnd.choice(["", "/", "/es/", "/en/1", "/en/12", "/fr/xyz", "/fr", "?a=/es/", "#/", "/fr/?q", "/q"]) for _ in range(400)]
    rows = list(enumerate(made + [None, "", "://", "a://b://c/d"] + made[:5]))
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).repartition(3)
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

    def judge(url):
        if url is None or "://" not in url:
            host = path = ""
        else:
            rest = url.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0]
            path = re.match(r"[^?#]*", rest[len(host):])[0]
            host = host.translate(lower)
        fit = [(len(h + p), len(h), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fit, default=None)
        return host, path, best[2] if best else None, best[3] if best else "allow"

    # the empty host of a rule is a host of its own, not a suffix of all
    truth = sorted(map(repr, ((i, *judge(u)) for i, u in rows)))
    got = urls.judge(pages, rules, salts=3)
    assert sorted(map(repr, map(tuple, got.collect()))) == truth
    assert urls.judge(empty(spark, pages), rules).count() == 0 and urls.judge(pages, empty(spark, rules)).filter("rule IS NOT NULL").count() == 0


def test_neighbours_against_brute_force(spark):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(900, 16)) * rnd.random((900, 1)) * 3
    x[100:160] = x[100]  # many ties
    rows = [(k, v.tolist(), 0.0) for k, v in enumerate(x)] + [(2000, None, 0.0), (2020, [0.0] * 16, 0.0), (2040, [float("nan")] * 16, 0.0), (2060, [None] * 16, 0.0), (2080, [1.0] * 4, 0.0), (2100, [float("inf")] * 16, 0.0), (None, [1.0] * 16, 0.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score double").repartition(3)
    got = defaultdict(list)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, per_cell=20).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got[r["query_id"]]) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert sorted(got) == list(range(0, 900, 20)) and all(len(v) == 20 for v in got.values())
    hit = 0
    for q, found in got.items():
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        truth = np.lexsort((np.arange(900), -s))[:20]
        hit += len({v for v, _ in found} & set(truth.tolist()))
        assert all(abs(score - s[v]) < 1e-9 for v, score in found)
        assert found == sorted(found, key=lambda f: (-f[1], f[0]))
    assert hit / (45 * 20) >= 0.9
    few = ann.search(df.filter("vec_id < 5"), F.col("vec_id") % 20 == 0)
    assert few.count() == 4
    assert ann.search(empty(spark, df), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_in_small_blocks(spark, monkeypatch):
    """Clustered vectors with a cell of a third of all: queries go to few blocks, and recall holds."""
    for name, value in (("LEAST_ENTRIES", 60), ("QUERY_BLOCK", 7)):
        monkeypatch.setattr(ann, name, value)
    rnd = np.random.default_rng(8)
    centres = rnd.normal(size=(30, 16)) * 4
    x = centres[np.where(np.arange(1800) < 600, 0, np.arange(1800) % 30)] + rnd.normal(size=(1800, 16)) * 0.3
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(set)
    for r in ann.search(df, F.col("vec_id") % 20 == 0, per_cell=20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hit = 0
    for q in range(0, 1800, 20):
        s = x @ x[q]
        s[q] = -np.inf
        hit += len(got[q] & set(np.lexsort((np.arange(1800), -s))[:20].tolist()))
    assert hit / (90 * 20) >= 0.9
    model, index = ann.build(df, per_cell=20)
    asked = index.filter("vec_id % 20 = 0").selectExpr("vec_id AS query_id", "vec AS qvec")
    model = ann.tuned(index, asked, model, k=20, target=0.96, tuning=50).placed(60)
    entries = ann._in_blocks(index, model).groupBy("block").count().collect()
    assert model.share < 0.5 and max(r["count"] for r in entries) <= 200 and sum(r["count"] for r in entries) == 1800
    visits = ann._with_blocks(asked, model)
    assert visits.count() < 0.6 * 90 * (model.first + model.parts).max()


def test_heap_visits_every_cell_once_in_order():
    rnd = np.random.default_rng(2)
    model = ann.MultiIndex(rnd.normal(size=(7, 3)), rnd.normal(size=(5, 3)), rnd.integers(0, 4, (7, 5)))
    q = rnd.normal(size=6)
    cells, seen, _ = model.visit(q, np.inf)
    sums = model.sums(q[None], np.array(cells))[0]
    assert len(cells) == len(set(cells)) == int((model.counts > 0).sum()) and (np.diff(sums) <= 1e-12).all() and seen[-1] == model.counts.sum()
    some, _, reach = model.visit(q, seen[-1] / 2)
    assert some == cells[:len(some)] and (model.sums(q[None], np.array(some))[0] >= reach - 1e-12).all()


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p><p>no";</script></head><body class="has-sidebar">
<header><p>Site</p></header><nav><ul><li><a href="/">Home</a></ul></nav><!-- <article>no</article> --><div class="ad">Buy</div><aside>Side</aside>
<article><h1>Head &amp; more</h1><p><b>Bold <i>text</i><br>next<p>Two&nbsp;words
 end &lt;b&gt;</p><div class="cookie-notice">Accept</div><p>Same line of this host</p><form><p>Mail</p></form><ul><li>one<li>two</ul>tail %s</article>
<section class="comments"><article><p>First!</p></article></section><footer>&copy; x</footer></body></html>"""


def test_pages(spark):
    assert html_text.extract(PAGE % "t") == "Head & more\nBold text next\nTwo words end <b>\nSame line of this host\none\ntwo\ntail t"
    assert html_text.extract(None) == html_text.extract("") == "" and html_text.extract("just text") == "just text"
    assert html_text.extract("<p>cut <a href=\"x") == "cut" and html_text.extract("a < b & c &amp; d") == "a < b & c & d"
    assert html_text.extract("<body><p>One</p><script>x<p>Two") == "One"
    deep = html_text.extract("<div>" * 3000 + "deep" + "</div>" * 3000)
    assert deep == "deep"
    rows = [(k, f"http://h.org/{k}", (PAGE % k).replace("Two&nbsp;words", f"Para {k}").replace("Head", f"Head {k}").replace("Bold", f"Bold {k}").replace("one", f"li {k}").replace("<li>two", "")) for k in range(12)]
    rows += [(50 + k, f"http://few.org/{k}", PAGE % k) for k in range(3)] + [(60 + k, "http://copies.org/", PAGE % "c") for k in range(20)] + [(90, None, PAGE % 1), (91, "http://h.org/n", None), (92, "http://h.org/e", ""), (90, None, PAGE % 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).repartition(3)
    got = defaultdict(list)
    for r in html_text.extract_pages(pages).collect():
        assert r["n_chars"] == len(r["text"])
        got[r["page_id"]].append(r["text"])
    assert got[3] == ["Head 3 & more\nBold 3 text next\nPara 3 end <b>\nli 3\ntail 3"]  # the constant line is template
    assert "Same line of this host" in got[51][0] and "Same line of this host" in got[65][0]  # too few pages; copies count once
    assert len(got[90]) == 2 and got[91] == got[92] == [""]
    assert html_text.extract_pages(empty(spark, pages)).count() == 0


def test_long_constant_lists_and_last_lines_are_template(spark):
    menu = "".join(f"<li>Category {i}</li>" for i in range(40))
    rows = [(k, f"http://long.org/{k}", f"<body><div><ul>{menu}</ul></div><div>" + "".join(f"<p>Page {k} line {i}</p>" for i in range(3 + 5 * k)) + "<p>All rights reserved</p></div>") for k in range(12)]
    rows += [(100 + k, f"http://wide.org/{k}", "<body><div>" + "".join(f"<p>Page {k} line {i}</p>" for i in range(90 + k)) + "<p>Middle</p>" + "".join(f"<p>Page {k} end {i}</p>" for i in range(100 - k)) + "</div>") for k in range(10)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"].split("\n") for r in html_text.extract_pages(pages).collect()}
    for k in range(12):
        assert got[k] == [f"Page {k} line {i}" for i in range(3 + 5 * k)]
    for k in range(10):
        assert got[100 + k] == [f"Page {k} line {i}" for i in range(90 + k)] + [f"Page {k} end {i}" for i in range(100 - k)]


def naive_match(a, b):
    """The weight of simple tree matching by its definition, with a full table for every pair of nodes."""
    if a[0] != b[0]:
        return 0
    table = np.zeros((len(a[2]) + 1, len(b[2]) + 1), int)
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            table[i, j] = max(table[i - 1, j], table[i, j - 1], table[i - 1, j - 1] + naive_match(x, y))
    return table[-1, -1] + 1 + (a[1] == b[1])


def random_tree(rnd, depth=0):
    kids = [random_tree(rnd, depth + 1) for _ in range(rnd.randrange(5 if depth < 3 else 1))]
    return [rnd.choice(["div", "p", "ul"]), rnd.choice(["", "", "a", "b", "c"]), kids]


def test_tree_matching_against_a_naive_matcher(monkeypatch):
    """Within PAIRS the match is the best there is; beyond it, equal trees come first, and it is no better than that."""
    rnd = random.Random(31)

    def filled(tree):  # no empty texts, so that the weights are the same thing
        return [tree[0], tree[1] or "e", [filled(k) for k in tree[2]]]

    for _ in range(200):
        a = filled(["body", "", [random_tree(rnd) for _ in range(rnd.randrange(4))]])
        b = filled(["body", "", [random_tree(rnd) for _ in range(rnd.randrange(4))]] if rnd.random() < 0.5 else [a[0], a[1], a[2][1:] + a[2][:1]])
        best, sides = naive_match(a, b), (html_text.sealed(a), html_text.sealed(b))
        assert 0.5 * best <= html_text.match_trees(*sides)[0] <= best
        with monkeypatch.context() as m:
            m.setattr(html_text, "PAIRS", 1 << 40)
            assert html_text.match_trees(*sides)[0] == best


def test_long_runs_are_matched_as_well_as_short_ones(monkeypatch):
    """Weight and equal texts of runs of any length are those of the best match, however many rows of the table are kept."""
    rnd = random.Random(5)
    for _ in range(12):
        sides = [html_text.sealed(["body", "", [[rnd.choice(["p", "div"]), rnd.choice("abcdef"), [["b", rnd.choice("xyz"), []] for _ in range(rnd.randrange(3))]] for _ in range(rnd.randrange(40, 120))]]) for _ in range(2)]
        for told in ((), (html_text.TOLD,)):
            said = []
            for pairs, cells in ((1 << 40, 1), (html_text.PAIRS, html_text.ROWS_CELLS), (0, 1)):
                with monkeypatch.context() as m:
                    m.setattr(html_text, "PAIRS", pairs)
                    m.setattr(html_text, "ROWS_CELLS", cells)
                    weight, found = html_text.match_trees(*sides, *told)
                said.append((weight, html_text.equal_texts(found)))
            assert said[0] == said[1] == said[2]


def test_few_pages_give_up_only_what_surrounds_the_text(spark):
    def page(k):
        return f"<body><div class='top'>My site about things</div><div class='body'>{''.join(f'<p>Page {k} says line {i} of it</p>' for i in range(5))}</div><div>All rights</div>"

    rows = [(k, f"http://few.net/{k}", page(k)) for k in range(3)] + [(10 + k, f"http://two.net/{k}", page(k)) for k in range(2)]
    rows += [(20 + k, f"http://same.net/{k}", f"<body><nav>{k}</nav><p>One text on all pages of the host</p><p>{k}</p>") for k in range(4)]
    rows += [(30 + k, f"http://art.net/{k}", f"<body><article><p>Shared line</p><p>Page {k} and more of it</p></article>") for k in range(4)]
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1] == "\n".join(f"Page 1 says line {i} of it" for i in range(5)) and got[11].startswith("My site")
    assert got[21] == "One text on all pages of the host\n1" and got[31] == "Shared line\nPage 1 and more of it"


def test_content_in_elements_whose_class_speaks_of_other_things(spark):
    def body(k):
        return "".join(f"<p>Line {i} of page {k} in words</p>" for i in range(6)) + f'<div class="ad">Buy {k} now</div>'

    shapes = {
        "div.org": lambda k: f"<body><div class='content has-sidebar'>{body(k)}<div class='sidebar'>Side {k}</div></div>",
        "post.org": lambda k: f"<body><article class='post comments-open category-social'>{body(k)}</article><div class='comments'><article><p>First {k}!</p></article></div>",
        "two.org": lambda k: f"<body><article class='post'><h1>T {k}</h1></article><div class='text'>{body(k)}</div>",
    }
    rows = [(100 * j + k, f"http://{host}/{k}", shape(k)) for j, (host, shape) in enumerate(shapes.items()) for k in range(10)]
    rows += [(900, "http://post.org/short", "<body><article class='post comments-open'><p>Hi</p></article><div class='comments'><p>A far longer comment than the text</p></div>")]
    rows += [(901, None, shapes["div.org"](3)), (902, None, shapes["post.org"](3))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(pages).collect()}

    def lines(k):
        return "\n".join(f"Line {i} of page {k} in words" for i in range(6))

    for k in range(10):
        assert got[k] == lines(k) and got[100 + k] == lines(k) and got[200 + k] == f"T {k}\n{lines(k)}"
    assert got[900] == "Hi" and got[901] == got[902] == lines(3)


def test_pipeline(spark, tmp_path):
    import corpus_pipeline as pipeline
    from corvane.llm.common import stage

    rnd = random.Random(21)
    bench = [(1, prose(rnd, 25))]
    rows = [(k, prose(rnd, rnd.randrange(20, 90))) for k in range(40)]
    rows += [(100, rows[3][1]), (101, rows[4][1] + " tail"), (102, "12 -- 34"), (103, None), (104, f"{prose(rnd, 30)} {bench[0][1]} {prose(rnd, 5)}"), (105, prose(rnd, 30) + " token = abcdef123456")]
    sf = str(tmp_path)
    documents(spark, rows, extra=False).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    assert 4 <= len(pipeline.STAGES) <= 5
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    sizes = []
    for name, step in pipeline.STAGES[:-1]:
        before = docs
        docs = stage(step(spark, docs, sf), name)
        assert docs.columns == columns
        sizes.append(docs.count())
        if name == "near_duplicates":
            truth = {int(c) for _, _, c in brute_link([(r["doc_id"], r["text"]) for r in before.collect()])}
            assert {r["doc_id"] for r in docs.collect()} == truth
    kept = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert set(kept) == set(range(40)) | {105} and kept[105].endswith("token = [REDACTED]")
    out = {r["doc_id"]: r for r in pipeline.run(spark, sf).collect()}
    assert set(out) == set(kept) and all(len(r["ids"]) == r["n_tokens"] > 0 for r in out.values())


def test_pipeline_on_odd_tables(spark, tmp_path):
    """Empty documents, an empty benchmark, repeated rows, null ids, and columns named like those that stages add."""
    import corpus_pipeline as pipeline

    rnd = random.Random(22)
    rows = [(k, prose(rnd, 30)) for k in range(20)]
    rows += [rows[3], rows[4], (None, "null id the of and"), (None, None), (30, "")]
    for name, given, bench in (("none", [], [(1, "a b c")]), ("odd", rows, [])):
        sf = f"{tmp_path}/{name}"
        docs = documents(spark, given or rows).withColumns({"_k": F.lit("x"), "tokens": F.lit(1), "ids": F.lit("y"), "_kept": F.lit(5), "_Kept_": F.lit(6), "_found_lang": F.lit(7).cast("long"), "_found_score": F.lit("q"), "a.b": F.lit(8)})
        (docs if given else docs.limit(0)).write.parquet(f"{sf}/documents.parquet")
        spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
        read = spark.read.parquet(f"{sf}/documents.parquet")
        for _, step in pipeline.STAGES[:-1]:
            after = step(spark, read, sf)
            assert after.columns == read.columns
            assert all((r["_k"], r["tokens"], r["_kept"], r["_found_lang"], r["_found_score"], r["a.b"]) == ("x", 1, 5, 7, "q", 8) for r in after.collect())
        out = pipeline.run(spark, sf).collect()
        assert sorted(str(r["doc_id"]) for r in out) == sorted([str(r[0]) for r in rows[:22]] + ["None"] if given else [])


def plain_pages(rnd, n=30):
    """Pages whose classes say nothing: a menu, a notice that takes turns, what varies, reader comments, a last line; (page, main text, text without words)."""
    menu = "".join(f"<li>{w}</li>" for w in ("Start", "Maps", "Help"))
    turns = [f"Buy {w} now" for w in ("tea", "rice", "oats", "figs")]
    out = []
    for k in range(n):
        body = [prose(rnd, 25) for _ in range(3)]
        said = [prose(rnd, 6) for _ in range(2)]
        out.append((f"<body><div class=a1><ul>{menu}</ul></div><div class=a2>{rnd.choice(turns)}</div><div class=a3><h1>T{k}</h1>{''.join(f'<p>{p}</p>' for p in body)}</div>"
                    f"<div class=comments>{''.join(f'<p>{s}</p>' for s in said)}</div><div class=a4>All rights kept</div></body>", "\n".join([f"T{k}", *body]), said))
    return out


def test_the_wrapper_decides_where_words_say_nothing(spark, monkeypatch):
    pages = plain_pages(random.Random(31))
    rows = [(k, f"http://h.org/{k}", page) for k, (page, _, _) in enumerate(pages)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in html_text.extract_pages(frame).collect()}
    assert got == {k: text for k, (_, text, _) in enumerate(pages)}
    alone = {k: html_text.extract(page) for k, _, page in rows}
    assert all("Maps" in alone[k] and "Buy" in alone[k] and alone[k] != got[k] for k in alone)  # without a wrapper all of them change
    # without the list of words all but the comments, which vary like content, is as before
    wrapper = frozenset(html_text.induce_wrappers(frame).first()["template"])
    monkeypatch.setattr(html_text, "USE_WORDS", False)
    html_text._look.cache_clear()
    assert [html_text.extract(page, wrapper) for _, _, page in rows] == ["\n".join([text, *said]) for _, text, said in pages]
    html_text._look.cache_clear()


def test_slots_beside_an_article_take_turns(spark, monkeypatch):
    """Menus and advertisements from a pool go by their turns alone, without tags or words."""
    rnd = random.Random(32)
    pool = [prose(rnd, 5) for _ in range(9)]
    texts = [prose(rnd, 30) for _ in range(40)]
    rows = [(k, f"http://h.org/{k}", f"<nav><ul><li>{rnd.choice(pool)}</li><li>{rnd.choice(pool)}</li></ul></nav><div class=ad>{rnd.choice(pool)}</div><article><p>{t}</p></article><footer>{rnd.choice(pool)}</footer>")
            for k, t in enumerate(texts)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string")
    wrapper = frozenset(html_text.induce_wrappers(frame).first()["template"])
    monkeypatch.setattr(html_text, "USE_WORDS", False)
    monkeypatch.setattr(html_text, "_TAGS", frozenset())
    html_text._look.cache_clear()
    assert [html_text.extract(page, wrapper) for _, _, page in rows] == texts
    html_text._look.cache_clear()


@pytest.mark.parametrize("page", ["<font><p>x</p>" * 10_000, "<b></i>" * 20_000, "<b>" * 30_000 + "<p>x" * 3000, "<ul><li>" * 5000, "<table><tr><td>" * 3000, "<p><span>" * 10_000])
def test_unclosed_tags_take_time_in_proportion(page):
    import time

    began = time.perf_counter()
    html_text.Page(page)
    assert time.perf_counter() - began < 4


def test_comments_beside_a_short_article():
    comments = '<div class="comments">' + "<p>a much longer text of a reader</p>" * 3 + "</div>"
    assert html_text.extract(f"<article><p>short</p>{comments}</article>") == "short"
    assert html_text.extract('<article class="post comments-open"><div class="comments-open"><p>all of it</p></div></article>') == "all of it"
