"""Writes that crash, fail or come second, embeddings that fail, and searches of many queries by the index."""

import os
import time

import numpy as np
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from corvane.api import Engine
from corvane.config import Config
from corvane.operators import ivf, search
from corvane.schema import COLLECTION
from corvane.sources import store
from corvane.sources.embedders import HashingEmbedder
from corvane.sources.store import Collection, Conflict, Folder

from .test_engine import chunk_rows


def rows_of(table):
    return {(r["file_path"], r["start_line"]): int(r["embedding"][0]) for r in table.read().collect()}


def paths(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "file_path string")


class Crash(BaseException):
    """The process ends here: nothing may catch it."""


#: Methods of a write, in order, that a crash may come before or after.
STEPS = [("_put", True), ("_put", False), ("_write_note", True), ("_write_note", False), ("_clean", True), ("_clean", False)]


@pytest.mark.parametrize("full", [False, True])
@pytest.mark.parametrize(("step", "before"), STEPS)
def test_a_crash_after_any_step_loses_and_blocks_nothing(spark, tmp_path, monkeypatch, step, before, full):
    table = Collection(spark, str(tmp_path / "c"), 4)
    table.ensure()
    table.replace_files(chunk_rows(spark, [("a", 1, 1), ("b", 1, 2)]), paths(spark))
    old = rows_of(table)
    new = {("b", 1): 3} | ({} if full else {("a", 1): 1})
    real = getattr(Collection, step)

    def crash(self, *args, **more):
        if not before:
            real(self, *args, **more)
        raise Crash

    monkeypatch.setattr(Collection, step, crash)
    with pytest.raises(Crash):
        table.replace_all(chunk_rows(spark, [("b", 1, 3)])) if full else table.replace_files(chunk_rows(spark, [("b", 1, 3)]), paths(spark))
    monkeypatch.undo()
    fresh = Collection(spark, str(tmp_path / "c"), 4)
    done = step == "_clean" or (step, before) == ("_write_note", False)
    assert rows_of(fresh) == (new if done else old)
    fresh.replace_files(chunk_rows(spark, [("b", 1, 4), ("c", 1, 5)]), paths(spark, "a"))
    assert rows_of(fresh) == {("b", 1): 4, ("c", 1): 5}


def test_a_crash_in_the_rename_leaves_the_old_version(spark, tmp_path):
    table = Collection(spark, str(tmp_path / "c"), 4)
    table.ensure()
    (tmp_path / "c/.note-crashed").write_text("{")
    (tmp_path / "c/data/seg=lost/cell=-1").mkdir(parents=True)
    table.replace_files(chunk_rows(spark, [("a", 1, 1)]), paths(spark))
    assert rows_of(table) == {("a", 1): 1}


def test_of_two_writers_none_is_lost(spark, tmp_path, monkeypatch):
    one, two = (Collection(spark, str(tmp_path / "c"), 4) for _ in range(2))
    one.ensure()
    base = one.note()
    two.replace_files(chunk_rows(spark, [("b", 1, 2)]), paths(spark))
    with pytest.raises(Conflict):  # it insists on the version it has seen
        one.replace_files(chunk_rows(spark, [("a", 1, 1)]), paths(spark), base=base)
    assert rows_of(one) == {("b", 1): 2}
    real, late = Folder._write_note, []

    def overtaken(self, told, after):
        if not late:  # the other one comes between reading the note and writing the next
            late.append(1)
            two.replace_files(chunk_rows(spark, [("c", 1, 3), ("b", 1, 7)]), paths(spark))
        return real(self, told, after)

    monkeypatch.setattr(Folder, "_write_note", overtaken)
    one.replace_files(chunk_rows(spark, [("a", 1, 1)]), paths(spark, "b"))
    assert rows_of(one) == rows_of(two) == {("a", 1): 1, ("c", 1): 3}


def test_a_merge_that_comes_second(spark, tmp_path, monkeypatch):
    one, two = (Collection(spark, str(tmp_path / "c"), 4) for _ in range(2))
    one.ensure()
    monkeypatch.setattr(store, "LOOSE_SHARE", 100)
    for k in range(3):
        one.replace_files(chunk_rows(spark, [(f"f{k}", 1, k), ("same", 1, k)]), paths(spark))
    real, late = Folder._write_note, []

    def then(act):
        def overtaken(self, told, after):
            if not late:
                late.append(1)
                act()
            return real(self, told, after)
        return overtaken

    monkeypatch.setattr(Folder, "_write_note", then(lambda: two.replace_files(chunk_rows(spark, [("new", 1, 9)]), paths(spark, "f0"))))
    assert one.merge() and len(one.note()["segments"]) == 2
    assert rows_of(one) == {("f1", 1): 1, ("f2", 1): 2, ("same", 1): 2, ("new", 1): 9}
    late.clear()
    monkeypatch.setattr(Folder, "_write_note", then(lambda: two.merge()))
    assert not one.merge() and len(one.note()["segments"]) == 1
    assert rows_of(one) == {("f1", 1): 1, ("f2", 1): 2, ("same", 1): 2, ("new", 1): 9}


def test_the_same_number_is_written_once(spark, tmp_path):
    folder = Folder(spark, str(tmp_path / "c"))
    first = folder._write_note({"x": 1}, None)
    assert folder._write_note({"x": 2}, first)["version"] > first["version"]
    with pytest.raises(Conflict):
        folder._write_note({"x": 3}, first)
    real, folder.version = folder.version, lambda: first["version"]  # it doesn't see the other's note yet
    with pytest.raises(Conflict):
        folder._write_note({"x": 3}, first)
    folder.version = real
    assert folder.note()["x"] == 2 and not [n for n in os.listdir(tmp_path / "c") if n.startswith(".note") and not n.endswith(".crc")]


def test_old_data_goes_and_young_orphans_stay(spark, tmp_path, monkeypatch):
    table = Collection(spark, str(tmp_path / "c"), 4)
    table.ensure()
    orphan = tmp_path / "c/data/seg=running"
    orphan.mkdir(parents=True)
    for k in range(6):
        table.replace_all(chunk_rows(spark, [("a", 1, k)]))
    assert len([n for n in os.listdir(tmp_path / "c/data") if n.startswith("seg")]) == 3 and orphan.exists()  # two versions, and what another writer may be at
    os.utime(orphan, (1, 1))
    table.replace_all(chunk_rows(spark, [("a", 1, 7)]))
    assert not orphan.exists() and rows_of(table) == {("a", 1): 7} and len([n for n in os.listdir(tmp_path / "c") if n.startswith("note")]) == 2


# -- index runs ---------------------------------------------------------------------------------


@pytest.fixture
def config(tmp_path):
    (tmp_path / "src").mkdir()
    for name, text in (("a", "apple pear"), ("b", "banana plum"), ("c", "cherry fig")):
        (tmp_path / f"src/{name}.txt").write_text(text)
    return Config(workspace_root=str(tmp_path), collection_path=str(tmp_path / ".c/collection"), ledger_path=str(tmp_path / ".c/ledger"), embedding_dimensions=16)


class Broken(HashingEmbedder):
    def embed(self, texts):
        raise RuntimeError("no embedder")


class Partly(HashingEmbedder):
    """Can't embed what is said in ``path``, a file of words; counts texts in another."""

    def __init__(self, dim, path):
        super().__init__(dim)
        self.path = path

    def embed(self, texts):
        out = super().embed(texts)
        with open(self.path) as f:
            bad = f.read().split()
        out[[any(w in t for w in bad) for t in texts]] = np.nan
        return out


def test_a_failed_full_run_leaves_everything(spark, config, tmp_path):
    engine = Engine(spark, config)
    engine.index()
    before = {r["file_path"]: r["content"] for r in engine.collection.read().collect()}
    (tmp_path / "src/b.txt").write_text("changed words")
    os.utime(tmp_path / "src/b.txt", (5, 5))
    broken = Engine(spark, config, lambda: Broken(16))
    for options in ({"full": True}, {}):
        with pytest.raises((PythonException, Py4JJavaError)):
            broken.index(**options)
        assert {r["file_path"]: r["content"] for r in engine.collection.read().collect()} == before
    report = engine.index()
    assert (report.changed, report.deleted, report.chunks) == (1, 0, 1)
    assert engine.index(full=True).chunks == 3 and engine.index().changed == 0


def test_a_run_that_is_overtaken_is_done_again(spark, config, tmp_path, monkeypatch):
    from corvane.plans import index as plan

    engine, other = Engine(spark, config), Engine(spark, config)
    engine.index()
    (tmp_path / "src/d.txt").write_text("date")
    real, late = plan.embedded_chunks, []

    def slow(*args):
        if not late:
            late.append(1)
            (tmp_path / "src/e.txt").write_text("elder")
            other.index()
        return real(*args)

    monkeypatch.setattr(plan, "embedded_chunks", slow)
    engine.index()
    assert {r["file_path"] for r in engine.collection.read().collect()} == {f"src/{c}.txt" for c in "abcde"} and engine.index().changed == 0


def test_passages_that_failed_come_again(spark, config, tmp_path):
    bad = tmp_path / "bad"
    bad.write_text("banana cherry")
    engine = Engine(spark, config, lambda: Partly(16, str(bad)))
    report = engine.index()
    assert (report.changed, report.failed) == (3, 2)
    assert [r["filePath"] for r in engine.search("banana plum", format="json", min_score=0.1)["results"]] == []
    bad.write_text("cherry")
    report = engine.index()
    assert (report.changed, report.failed) == (2, 1)
    assert engine.search("banana plum", format="json", min_score=0.1)["results"][0]["filePath"] == "src/b.txt"
    bad.write_text("")
    assert engine.index().changed == 1 and engine.index().changed == 0


class Noting(Partly):
    """Notes each text that it is asked for."""

    def embed(self, texts):
        with open(self.path + "-asked", "a") as f:
            f.writelines(t.replace("\n", " ") + "\n" for t in texts)
        return super().embed(texts)


def test_a_text_is_embedded_once(spark, config, tmp_path):
    bad, cached = tmp_path / "bad", Config(**{**config.__dict__, "cache_embeddings": True})
    bad.write_text("cherry")
    (tmp_path / "src/same.txt").write_text("apple pear")
    engine, plain = Engine(spark, cached, lambda: Noting(16, str(bad))), Engine(spark, Config(**{**config.__dict__, "collection_path": f"{config.collection_path}2", "ledger_path": f"{config.ledger_path}2"}))

    def asked():
        with open(f"{bad}-asked") as f:
            return sorted(line.strip().removeprefix("search_document: ") for line in f)

    report = engine.index()
    assert (report.changed, report.failed) == (4, 1) and asked() == ["apple pear", "banana plum", "cherry fig"]
    bad.write_text("")
    assert engine.index().failed == 0 and asked().count("cherry fig") == 2  # the one that failed comes again
    before = asked()
    (tmp_path / "src/a.txt").rename(tmp_path / "src/moved.txt")
    os.utime(tmp_path / "src/b.txt", (5, 5))
    report = engine.index()
    assert (report.changed, report.deleted) == (2, 1) and engine.index(full=True).chunks == 4 and asked() == before
    plain.index()
    rows = [sorted((r["file_path"], r["content"], tuple(r["embedding"])) for r in e.collection.read().collect()) for e in (engine, plain)]
    assert rows[0] == rows[1]


def test_a_server_that_fails_at_first_is_asked_again():
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from corvane.sources.embedders import EmbedError, HttpEmbedder

    calls = []

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            calls.append(time.time())
            body = json.dumps({"embedding": [1.0, 2.0]}).encode() if len(calls) % 3 == 0 else b"{}"
            self.send_response(200 if len(calls) % 3 != 1 else 500)
            self.end_headers()
            self.wfile.write(body)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert HttpEmbedder(url, "m", 2, pause=0.01).embed_query("x") == [1.0, 2.0] and len(calls) == 3
    with pytest.raises(EmbedError):
        HttpEmbedder(url, "m", 2, tries=2, pause=0.01).embed_query("x")
    calls.clear()
    assert HttpEmbedder(url, "m", 2, tries=2, workers=1, pause=0.01).embed(["a", "b"]).tolist()[1] == [1.0, 2.0]
    server.shutdown()


# -- the cell index -----------------------------------------------------------------------------


def vectors(spark, x):
    return spark.createDataFrame([(f"i{k}", f"t{k}", f"f{k}", "text", "m", "block", "", 1, 2, "t", v.tolist()) for k, v in enumerate(x)], COLLECTION)


def test_batched_cells_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(search, "GROUP_ROWS", 40)
    monkeypatch.setattr(search, "GROUP_QUERIES", 7)
    rnd = np.random.default_rng(2)
    x = np.concatenate([rnd.normal(size=(200, 6)), np.repeat(rnd.normal(size=(1, 6)), 60, axis=0), np.zeros((2, 6))])  # a cell of equal vectors
    rows = vectors(spark, x)
    index = ivf.fit_cells(rows, 12)
    placed = ivf.with_cells(rows, index).withColumn("cell", F.when(F.substring("id", -1, 1) == "3", -1).otherwise(F.col("cell")))
    asked = rows.filter(F.substring("id", -1, 1).isin("0", "5")).select(F.col("id").alias("query_id"), "embedding").unionByName(
        spark.createDataFrame([("null", None), ("zero", [0.0] * 6), ("short", [1.0])], "query_id string, embedding array<float>"))
    got = {(r["query_id"], r["rank"]): (r["id"], round(r["score"], 6), r["content"]) for r in ivf.search_cells_batch(placed, index, asked, 5, probes=12).collect()}
    want, live = {}, [k for k in range(len(x)) if x[k].any()]
    x32 = x.astype(np.float32).astype(float)
    unit = {k: x32[k] / np.linalg.norm(x32[k]) for k in live}
    for q in (k for k in live if k % 5 == 0):
        best = sorted(((-round(float(unit[q] @ unit[k]), 9), f"i{k}") for k in live))[:5]
        want |= {(f"i{q}", r + 1): (i, round(-s, 6), f"t{i[1:]}") for r, (s, i) in enumerate(best)}
    assert {k: v[1] for k, v in got.items()} == {k: v[1] for k, v in want.items()} and len(got) == len(want)
    assert sum(got[k] == want[k] for k in want) > 0.9 * len(want)  # equal vectors may differ in the last digit
    assert "CartesianProduct" not in (plan := ivf.search_cells_batch(placed, index, asked, 5)._jdf.queryExecution().toString()) and "NestedLoop" not in plan


@pytest.mark.parametrize("places", [None, 2])
def test_more_queries_than_a_broadcast_takes(spark, monkeypatch, places):
    monkeypatch.setattr(search, "GROUP_ROWS", 30)
    monkeypatch.setattr(search, "GROUP_QUERIES", 9)
    rnd = np.random.default_rng(12)
    rows = vectors(spark, np.concatenate([rnd.normal(size=(120, 5)), np.zeros((2, 5))])).unionByName(vectors(spark, rnd.normal(size=(3, 2))).withColumn("id", F.concat(F.lit("s"), "id")))
    asked = rows.select(F.col("id").alias("query_id"), "embedding").unionByName(
        spark.createDataFrame([("null", None), ("nan", [float("nan")] * 5), ("lone", [1.0])], "query_id string, embedding array<float>"))

    def got():
        return sorted((r["query_id"], r["rank"], r["id"], round(r["score"], 7), r["content"]) for r in search.top_k_batch(rows, asked, 4, places=places).collect() if r["query_id"] != "nan")

    broadcast = got()
    monkeypatch.setattr(search, "MAX_BATCH", 10)
    assert got() == broadcast and len(broadcast) == 120 * 4 + 3 * 3


def test_the_index_visits_what_its_recall_needs(spark):
    rnd = np.random.default_rng(7)
    rows = vectors(spark, rnd.normal(size=(1500, 12)))  # no structure: many cells are needed
    index = ivf.fit_index(rows)
    assert index.recall >= ivf.TARGET > 0.9 and index.probes > ivf.PROBES and 0 < index.share < 1
    asked = rows.limit(60).select(F.col("id").alias("query_id"), "embedding")
    found = ivf.search_cells_batch(ivf.with_cells(rows, index), index, asked, 20).select("query_id", "id")
    true = ivf.top_k_batch(rows, asked, 20).select("query_id", "id")
    assert true.join(found, ["query_id", "id"]).count() >= 0.9 * true.count()


def test_large_cells_are_split(spark, monkeypatch):
    monkeypatch.setattr(ivf, "CELL_ROWS", 100)
    rnd = np.random.default_rng(8)
    x = np.concatenate([rnd.normal(size=(1000, 4)) * 0.05 + [5, 0, 0, 0], rnd.normal(size=(60, 4))])
    rows = vectors(spark, x)
    index = ivf.fit_cells(rows, 4, rows=len(x))
    sizes = [r["count"] for r in ivf.with_cells(rows, index).groupBy("cell").count().collect()]
    assert len(index.centroids) > 8 and max(sizes) < 400
    assert len(ivf.fit_cells(rows, 4).centroids) == 4


def test_a_collection_is_searched_by_many_queries(spark, tmp_path):
    rnd = np.random.default_rng(5)
    x = rnd.normal(size=(30, 8))[rnd.integers(0, 30, 700)] * 4 + rnd.normal(size=(700, 8))
    table = Collection(spark, str(tmp_path / "c"), 8, indexed_rows=500)
    table.replace_files(vectors(spark, x), paths(spark))
    index = table.index_of(table.note())
    assert index.probes < len(index.centroids) and table.recall(10, queries=40) >= 0.9
    late = vectors(spark, x[:3] * 2).selectExpr("concat('n', id) AS id", "content", "concat('n', file_path) AS file_path", *[c for c in COLLECTION.names if c not in ("id", "content", "file_path")])
    table.replace_files(late, paths(spark, "f9"))
    asked = vectors(spark, x[:10]).select(F.col("id").alias("query_id"), "embedding")
    hits = table.search_batch(asked, 3).collect()
    assert len(hits) == 30 and {r["id"] for r in hits if r["query_id"] == "i1"} >= {"i1", "ni1"} and "i9" not in {r["id"] for r in hits}
    assert all(r["content"] == "t" + r["id"].lstrip("ni") for r in hits)


def test_many_texts_are_searched_in_one_plan(spark, config):
    engine = Engine(spark, config)
    engine.index()
    hits = engine.search_all(spark.createDataFrame([(1, "apple"), (2, "fig cherry")], "query_id int, text string"), 1).collect()
    assert {(r["query_id"], r["file_path"]) for r in hits} == {(1, "src/a.txt"), (2, "src/c.txt")}
