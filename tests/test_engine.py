"""A whole workspace: index, search, read, clip, change and watch."""

import os
import random
import time

import pytest

from corvane.api import Engine
from corvane.config import Config, load, write_default
from corvane.functions.requests import RequestError
from corvane.operators.clips import ClipRegistry
from corvane.sources.embedders import TableEmbedder
from corvane.streaming.watch import watch


@pytest.fixture
def workspace(tmp_path):
    (tmp_path / "src/.hidden").mkdir(parents=True)
    (tmp_path / "src/node_modules").mkdir()
    (tmp_path / "src/_a.ts").write_text("export function alpha() {\n  return 'apple pear';\n}\n")
    (tmp_path / "src/b.md").write_text("# Fruit\n" + "banana cherry apple " * 20 + "\n# Cars\n" + "engine wheel motor " * 20)
    (tmp_path / "src/c.txt").write_text("plain words\n")
    (tmp_path / "src/d.bin").write_text("no")
    (tmp_path / "src/.env").write_text("x=1")
    (tmp_path / "src/.hidden/e.ts").write_text("x")
    (tmp_path / "src/node_modules/f.ts").write_text("x")
    (tmp_path / ".gitignore").write_text("gone.ts\n")
    (tmp_path / "src/gone.ts").write_text("x")
    return Config(workspace_root=str(tmp_path), collection_path=str(tmp_path / ".c/collection"), ledger_path=str(tmp_path / ".c/ledger"), embedding_dimensions=64)


def contents(engine):
    rows = engine.collection.read().collect()
    return sorted((r["file_path"], r["start_line"], r["end_line"], r["content"], tuple(r["embedding"])) for r in rows)


def test_index_search_read_clip(spark, workspace, tmp_path):
    engine = Engine(spark, workspace)
    assert engine.index(dry_run=True).shown_changed == ("src/_a.ts", "src/b.md", "src/c.txt")
    report = engine.index()
    assert (report.changed, report.deleted, report.chunks) == (3, 0, 4)
    assert engine.index().changed == 0
    assert engine.stats()["chunkCount"] == 4 and all(ok for _, ok, _ in engine.doctor())

    found = engine.search("banana cherry", format="json", min_score=0.0, include=["chunkType"])
    assert found["results"][0]["symbolName"] == "Fruit" and found["results"][0]["chunkType"] == "section" and found["results"][0]["id"] == 1
    assert engine.search("banana cherry", format="json", language="typescript", min_score=0.0)["results"][0]["filePath"] == "src/_a.ts"
    text = engine.search("engine wheel", top_k=5)["markdown"]
    assert text.startswith('# Search: "engine wheel"\n\n') and "src/b.md:3-4 • Cars • score: " in text and not text.endswith("\n")
    assert engine.search("zzz", min_score=1.0)["count"] == 0

    assert engine.read_slice("src/_a.ts", 2, 99)["content"] == "  return 'apple pear';\n}\n"
    for path, a, b, status in (("../x", 1, 2, 403), ("src/none.ts", 1, 2, 404), ("src/_a.ts", 0, 2, 400), ("src/_a.ts", 50, 60, 400)):
        with pytest.raises(RequestError) as e:
            engine.read_slice(path, a, b)
        assert e.value.status == status
    batch = engine.clip_batch("1,99,1")
    assert [r["success"] for r in batch["results"]] == [True, False, True] and (batch["requested"], batch["succeeded"], batch["failed"]) == (3, 2, 1)
    with pytest.raises(RequestError):
        engine.clip(99)

    (tmp_path / "src/b.md").write_text("# Trees\n" + "oak ash elm " * 20)
    os.utime(tmp_path / "src/b.md", (1, 1))  # older counts as changed too
    (tmp_path / "src/c.txt").unlink()
    report = engine.index()
    assert (report.changed, report.deleted) == (1, 1)
    assert {p for p, *_ in contents(engine)} == {"src/_a.ts", "src/b.md"}
    step_by_step = contents(engine)
    engine.index(full=True)
    assert contents(engine) == step_by_step
    (tmp_path / "src/_a.ts").unlink()
    assert engine.index().deleted == 1 and engine.index().deleted == 0


def test_a_workspace_in_a_store(spark, workspace, tmp_path):
    """By a path with a scheme everything is listed and read by Spark; the chunks are the same."""
    local = Engine(spark, workspace)
    local.index()
    far = Engine(spark, Config(**{**workspace.__dict__, "workspace_root": f"file://{tmp_path}", "exclude_patterns": (*workspace.exclude_patterns, "gone.ts"),
                                  "collection_path": str(tmp_path / ".d/c"), "ledger_path": str(tmp_path / ".d/l")}))
    assert far.index().changed == 3 and contents(far) == contents(local) and far.index().changed == 0
    assert far.read_slice("src/_a.ts", 1, 1)["content"] == "export function alpha() {"
    for path, status in (("../x", 403), ("src/none.ts", 404)):
        with pytest.raises(RequestError) as e:
            far.read_slice(path, 1, 2)
        assert e.value.status == status
    (tmp_path / "src/c.txt").write_text("other words\n")
    os.utime(tmp_path / "src/c.txt", (1, 1))
    (tmp_path / "src/b.md").unlink()
    report = far.index()
    assert (report.changed, report.deleted) == (1, 1) and {p for p, *_ in contents(far)} == {"src/_a.ts", "src/c.txt"}


def test_zero_vectors_are_stored_but_never_found(spark, workspace):
    engine = Engine(spark, workspace, lambda: TableEmbedder({}, 64))
    engine.index()
    assert engine.stats()["chunkCount"] == 4 and engine.search("x", min_score=0.0)["count"] == 0


def test_wrong_dimensions_fail(spark, workspace):
    Engine(spark, workspace).index()
    other = Engine(spark, Config(**{**workspace.__dict__, "embedding_dimensions": 32}))
    with pytest.raises(ValueError, match="dimensions"):
        other.index()


def test_registry_evicts_in_order():
    r = ClipRegistry(3)
    assert [r.put("a", k, k) for k in (1, 2, 3, 1)] == [1, 2, 3, 1]
    assert r.put("a", 4, 4) == 4 and r.get(1) is None and r.put("a", 1, 1) == 5 and len(r) == 3
    r.clear()
    assert r.put("a", 9, 9) == 1


def test_batch_assignment_matches_registry(spark):
    from corvane.operators import clips

    rnd = random.Random(5)
    puts = [(k, f"f{rnd.randrange(40)}", 1, rnd.randrange(3)) for k in range(300)]
    r = ClipRegistry(1000)
    for _, *key in puts:
        r.put(*key)
    got = clips.assign(spark.createDataFrame(puts, "at int, file_path string, start_line int, end_line int"), ["at"]).collect()
    assert sorted(tuple(x) for x in got) == sorted(r.rows())
    for capacity in (7, 40, 1000):
        for given in (puts, list({p[1:]: p for p in reversed(puts)}.values())[::-1]):
            r = ClipRegistry(capacity)
            for _, *key in sorted(given):
                r.put(*key)
            got = clips.fifo(spark.createDataFrame(given, "at int, file_path string, start_line int, end_line int"), ["at"], capacity)
            assert sorted(map(tuple, got.collect())) == sorted(r.rows())  # also where keys come again after their eviction


def test_config(tmp_path):
    write_default(str(tmp_path))
    (tmp_path / "a/b").mkdir(parents=True)
    assert load(str(tmp_path / "a/b"), {"CORVANE_EMBEDDING_MODEL": "m"}).embedding_model == "m"
    assert load(str(tmp_path / "a/b"), {}).workspace_root == str(tmp_path)
    (tmp_path / ".corvanerc.json").write_text("{")
    with pytest.raises(ValueError):
        load(str(tmp_path), {})


def test_watch_runs_after_a_change(spark, tmp_path):
    root, runs, errors = tmp_path / "w", [], []
    root.mkdir()
    (root / "old").write_text("x")

    def run():
        runs.append(1)
        if len(runs) == 1:
            raise RuntimeError("first")

    query = watch(spark, str(root), run, str(tmp_path / "check"), dirs=["src", "docs"], patterns=["*.map", "build/"], gap_ms=700, on_error=errors.append)
    try:
        time.sleep(4)
        (root / "src/build").mkdir(parents=True)
        for name in ("outside.txt", "src/a.map", "src/build/b.txt", "src/.hidden"):
            (root / name).write_text("no event")
        time.sleep(4)
        assert runs == []
        deadline = time.time() + 60
        for k in range(5):  # one burst
            (root / f"src/new{k}").write_text("y")
            time.sleep(0.3)
        while time.time() < deadline and not runs:
            time.sleep(0.2)
        time.sleep(4)
        assert len(runs) <= 2 and len(errors) == 1  # one run, and one more where a poll took longer than the gap
        before = len(runs)
        (root / "src/later").write_text("z")
        while time.time() < deadline and len(runs) == before:
            time.sleep(0.2)
        assert len(runs) > before and query.exception() is None
    finally:
        query.stop()


def test_files_that_cannot_be_read_come_again(spark, workspace, tmp_path, monkeypatch):
    from corvane.plans import index
    from corvane.sources.files import derive

    walk = index.walk_files
    engine = Engine(spark, workspace)
    extra = derive(spark.createDataFrame([("src/lost.ts", "2024-01-01T00:00:00.000Z")], "file_path string, last_modified string"))
    monkeypatch.setattr(index, "walk_files", lambda *a: walk(*a).unionByName(extra))
    told = []
    assert engine.index(progress=lambda *x: told.append(x)).changed == 4 and engine.index().changed == 1
    time.sleep(0.1)
    assert told[-1] == (4, 4)
    (tmp_path / "src/lost.ts").write_text("export const found = 'again and again';\n")
    report = engine.index()
    assert (report.changed, report.deleted) == (1, 0) and report.seconds > 0 and engine.index().changed == 0
    assert "src/lost.ts" in {p for p, *_ in contents(engine)}
    # unreadable once more: its chunks and its note stay
    (tmp_path / "src/lost.ts").unlink()
    extra2 = derive(spark.createDataFrame([("src/lost.ts", "2025-01-01T00:00:00.000Z")], "file_path string, last_modified string"))
    monkeypatch.setattr(index, "walk_files", lambda *a: walk(*a).unionByName(extra2))
    assert engine.index().changed == 1 and "src/lost.ts" in {p for p, *_ in contents(engine)}
    monkeypatch.setattr(index, "walk_files", walk)
    assert engine.index().deleted == 1 and "src/lost.ts" not in {p for p, *_ in contents(engine)}


def test_reads_stay_in_the_root_and_look_before_they_read(spark, workspace, tmp_path):
    engine = Engine(spark, workspace)
    outside = tmp_path.parent / f"{tmp_path.name}-secret.txt"
    outside.write_text("not yours\n")
    (tmp_path / "src/link.txt").symlink_to(outside)
    (tmp_path / "src/inner.txt").symlink_to(tmp_path / "src/c.txt")
    with open(tmp_path / "src/huge.txt", "wb") as f:
        f.truncate(26 << 20)
    for path, status in (("src/link.txt", 403), (str(outside), 403), ("src/../../x", 403), ("src", 400), ("src/huge.txt", 413), ("src/none", 404), ("", 400)):
        with pytest.raises(RequestError) as e:
            engine.read_slice(path, 1, 2)
        assert (path, e.value.status) == (path, status)
    for path in ("src/c.txt", "src/../src/c.txt", str(tmp_path / "src/c.txt"), "./src//c.txt", "src/inner.txt"):
        assert engine.read_slice(path, 1, 1)["content"] == "plain words"


def test_a_query_that_cannot_be_embedded_is_an_error(spark, workspace):
    from corvane.serve import respond
    from corvane.sources.embedders import EmbedError, HttpEmbedder

    engine = Engine(spark, workspace, lambda: HttpEmbedder("http://127.0.0.1:9", "m", 64, timeout=1, pause=0.01))
    assert engine.index().failed == 4  # passages become zero vectors, and their files come again
    with pytest.raises(EmbedError):
        engine.search("x")
    assert respond(engine, "POST", "/search", {"query": "x"})[0] == 502


def chunk_rows(spark, rows):
    from corvane.schema import COLLECTION

    full = [(f"{p}:{n}", f"text {v}", p, "text", "m", "block", "", n, n + 1, "t", [float(v), 1.0, 0.5, 0.0]) for p, n, v in rows]
    return spark.createDataFrame(full, COLLECTION)


def test_collection_segments_match_a_plain_table(spark, tmp_path):
    from corvane.sources.store import MOST_SEGMENTS, Collection

    rnd, want = random.Random(4), {}
    table = Collection(spark, str(tmp_path / "c"), 4)
    table.ensure()
    for step in range(12):
        stale = "keep" if step % 4 == 3 else "drop"
        gone = {f"f{rnd.randrange(9)}" for _ in range(rnd.randrange(2))}
        changed = {f"f{rnd.randrange(9)}" for _ in range(rnd.randrange(3) if step else 9)}
        new = {(p, n): step * 100 + n for p in changed for n in range(rnd.randrange(1, 5))}
        want = {k: v for k, v in want.items() if k[0] not in gone and (stale == "keep" or k[0] not in changed)} | new
        before = table.read()
        table.replace_files(chunk_rows(spark, [(*k, v) for k, v in new.items()]), spark.createDataFrame([(g,) for g in gone], "file_path string"), stale=stale)
        assert {(r["file_path"], r["start_line"]): int(r["embedding"][0]) for r in table.read().collect()} == want
        before.count()  # a reader of the version before isn't disturbed
        assert len(table.note()["segments"]) <= MOST_SEGMENTS
    assert table.stats()["count"] == len(want)
    (tmp_path / "c/.note-crashed").write_text("{")  # a write that never came to its end
    (tmp_path / "c/data/seg=9999").mkdir()
    assert table.stats()["count"] == len(want)


def test_large_collections_are_searched_by_cells(spark, tmp_path, capsys):
    import numpy as np

    from corvane.schema import COLLECTION
    from corvane.sources.store import Collection

    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(40, 8)) * 3
    x = centres[rnd.integers(0, 40, 900)] + 0.2 * rnd.normal(size=(900, 8))
    rows = spark.createDataFrame([(f"i{k}", f"t{k}", f"f{k}", "text", "m", "block", "", 1, 2, "t", v.tolist()) for k, v in enumerate(x)], COLLECTION)
    table = Collection(spark, str(tmp_path / "c"), 8, indexed_rows=500)
    nothing = spark.createDataFrame([], "file_path string")
    table.replace_files(rows, nothing)
    index = table.index_of(table.note())
    assert len(index.centroids) == 128 and table.recall(10, queries=15) >= 0.9 and index.recall >= 0.9 and index.share < 0.5
    near = table.candidates(x[0].tolist())
    assert 0 < near.count() < 450
    near.explain("formatted")
    assert "PartitionFilters" in capsys.readouterr().out
    table.replace_files(rows.limit(3).withColumn("embedding", rows["embedding"]).selectExpr("concat(id, 'n') AS id", "content", "concat(file_path, 'n') AS file_path", *rows.columns[3:]), rows.filter("id = 'i0'").select("file_path"))
    got = {r["id"] for r in table.candidates(x[0].tolist()).collect()}
    assert "i0" not in got and len({i for i in got if i.endswith("n")}) == 3  # what was written since has no cell and is always read


@pytest.mark.parametrize("bucket", [1, 60, 3600, 10**6])
def test_bursts_match_session_windows(spark, bucket):
    from corvane.operators.bursts import bursts
    from corvane.streaming.watch import sessions

    rnd, t, rows = random.Random(6), 1_700_000_000.0, []
    for _ in range(300):
        t += rnd.choice([0.0, 1.0, 9.9, 10.0, 10.1, 500.0])
        rows.append((t,))
    events = spark.createDataFrame(rows, "s double").selectExpr("timestamp_micros(cast(s * 1000000 as bigint)) AS ts")
    want = sorted(map(tuple, sessions(events, "10 seconds").collect()))
    assert sorted(map(tuple, bursts(events, 10, bucket_seconds=bucket).collect())) == want
