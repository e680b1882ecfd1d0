"""The jobs over growing, repeated, odd and empty input, and their command lines."""

import json
import os
import subprocess
import sys

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from corvane.operators import chunk
from corvane.sources.embedders import HashingEmbedder
from jobs import answer_questions as answers
from jobs import queries
from jobs import refresh_chunks as refresh

from ..conftest import ROOT

SF = "/root/testdata/sf0.001"


def put(spark, path, rows):
    spark.createDataFrame(rows, refresh.DOCUMENTS).coalesce(1).write.mode("append").parquet(path)


def doc(i, text, source="s1"):
    return (i, text, "en", source, len(text or ""))


def want(rows, extension=".md"):
    """Chunks of the given documents: path, lines, text."""
    out = []
    for i, text, _, source, _ in rows:
        path = f"{source}/{i}{extension}" if source else f"{i}{extension}"
        out += [(path, p.start, p.end, p.text) for p in chunk.chunk_text(text, "markdown" if extension == ".md" else "text")]
    return sorted(out)


def stands(spark, out):
    return sorted((r["file_path"], r["start_line"], r["end_line"], r["content"]) for r in refresh.current(spark, out).collect())


@pytest.fixture
def places(tmp_path):
    return f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/checkpoint"


def test_refresh_hands_workers_small_batches(spark, places, monkeypatch):
    put(spark, places[0], [doc(k, f"{k} " + "word " * 2400) for k in range(4000)])
    plain, before = refresh.chunk_files, spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch")

    def probed(files, *args):
        def first_rows(batches):
            for batch in batches:
                if batch.nbytes > 6 << 20:
                    raise ValueError(f"a batch of {batch.nbytes} bytes")
                yield batch.slice(0, 1)

        return plain(files.coalesce(1).mapInArrow(first_rows, files.schema), *args)

    monkeypatch.setattr(refresh, "chunk_files", probed)
    assert refresh.refresh_chunks(spark, *places)["documents"] == 4000
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == before


def test_refresh_takes_only_what_is_new(spark, places):
    first = [doc(1, "# A\n" + "apple pear " * 30), doc(2, "plain words"), doc(3, "x" * 5000 + "\ny", None), doc(4, "", ""), doc(None, "no id"), doc(5, None)]
    put(spark, places[0], first)
    told = refresh.refresh_chunks(spark, *places)
    good = [first[0], first[1], first[2], first[3]]
    assert (told["batches"], told["documents"], told["files"]) == (1, 6, 4) and stands(spark, places[1]) == want(good)
    assert refresh.refresh_chunks(spark, *places) == {"batches": 0, "documents": 0, "files": 0, "chunks": 0}
    # one comes again as it was, one with other text, one without any words, one is new
    second = [doc(1, first[0][1]), doc(2, "other words\n" * 900), doc(3, " \n ", None), doc(6, "six", "s2")]
    put(spark, places[0], second)
    told = refresh.refresh_chunks(spark, *places)
    assert (told["batches"], told["documents"], told["files"]) == (1, 4, 3)
    assert stands(spark, places[1]) == want([first[0], second[1], second[3]])
    put(spark, places[0], [doc(2, "plain words"), doc(2, "plain words")])  # back to what it was, twice
    assert refresh.refresh_chunks(spark, *places)["files"] == 1
    assert stands(spark, places[1]) == want([first[0], first[1], second[3]])
    rows = refresh.current(spark, places[1]).collect()
    assert all(r["embedding"] == HashingEmbedder(64).embed(["search_document: " + r["content"]])[0].tolist() for r in rows)


def test_refresh_in_many_batches_equals_one(spark, tmp_path):
    rows = [doc(k % 9, f"text {k} " * (k + 1), f"s{k % 9 % 2}") for k in range(30)]
    for k in range(0, 30, 6):
        put(spark, f"{tmp_path}/in", rows[k:k + 6])
    told = refresh.refresh_chunks(spark, f"{tmp_path}/in", f"{tmp_path}/out", f"{tmp_path}/c", files_per_batch=1)
    assert told["batches"] == 5
    assert len({r["file_path"] for r in refresh.current(spark, f"{tmp_path}/out").collect()}) == 9
    assert {n for n in os.listdir(f"{tmp_path}/out/files") if n.startswith("batch")} == {f"batch={k}" for k in range(5)}


@pytest.mark.parametrize(("step", "text"), [(2, "one"), (3, "uno")])
def test_a_batch_that_fails_is_repeated_whole(spark, places, monkeypatch, step, text):
    """After the chunks are written (2) the old ones still count, after the files (3) the new ones do."""
    put(spark, places[0], [doc(1, "one"), doc(2, "two")])
    refresh.refresh_chunks(spark, *places)
    put(spark, places[0], [doc(1, "uno"), doc(3, "three")])
    real, reads = refresh._table, []

    def broken(session, path, schema):
        reads.append(path)
        if len(reads) == step:
            raise RuntimeError("lost")
        return real(session, path, schema)

    monkeypatch.setattr(refresh, "_table", broken)
    with pytest.raises(StreamingQueryException):
        refresh.refresh_chunks(spark, *places)
    monkeypatch.undo()
    assert stands(spark, places[1]) == want([doc(1, text), doc(2, "two"), *([doc(3, "three")] if step == 3 else [])])
    refresh.refresh_chunks(spark, *places)
    assert stands(spark, places[1]) == want([doc(1, "uno"), doc(2, "two"), doc(3, "three")])


def test_another_checkpoint_is_refused(spark, places):
    for k in range(2):
        put(spark, places[0], [doc(k, f"text {k}")])
        refresh.refresh_chunks(spark, *places)
    before = stands(spark, places[1])
    with pytest.raises(StreamingQueryException, match="another checkpoint"):
        refresh.refresh_chunks(spark, places[0], places[1], places[2] + "-new")
    assert stands(spark, places[1]) == before


def test_refresh_of_nothing(spark, places):
    put(spark, places[0], [])
    refresh.refresh_chunks(spark, *places)
    assert stands(spark, places[1]) == []


def brute_hits(docs, items, top_k=10, diff=0.1):
    embed = HashingEmbedder(64).embed
    chunks = [(path, a, b, text, embed(["search_document: " + text[:3500]])[0]) for path, a, b, text in want(docs, ".txt")]
    out = []
    for item, text in items:
        q = embed(["search_query: " + text])[0]
        scored = sorted(((-round(float(q @ v), 6) + 0.0, f"{p}:{a:09d}", p, a, b) for p, a, b, _, v in chunks if v.any()))[:top_k] if q.any() else []
        best = max([0.0, *(-s for s, *_ in scored)])
        out += [(item, rank + 1, p, a, b) for rank, (s, _, p, a, b) in enumerate(scored) if -s >= max(best - diff, 0)]
    return sorted(out)


def test_answers_match_brute_force_and_a_rerun_replaces_them(spark, tmp_path):
    docs = [doc(k, f"apple {'pear ' * (k % 7)}{'plum ' * (k % 3)} w{k}\n" * 5, None if k == 3 else f"s{k % 2}") for k in range(40)] + [doc(50, ""), doc(51, None), doc(None, "pear"), doc(52, "a\n" * 9000)]
    items = [(1, "apple pear"), (2, "plum w7"), (3, "nothing of it"), (4, None), (5, "")]
    put(spark, f"{tmp_path}/docs", docs)
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/items")
    good = [d for d in docs if d[0] is not None and d[1] is not None]

    def run():
        told = answers.answer_questions(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", report="r1", top_k=7)
        rows = answers.hits(spark, f"{tmp_path}/out", "r1").collect()
        assert told == {"questions": 5, "hits": len(rows)}
        return sorted((r["item_id"], r["rank"], r["file_path"], r["start_line"], r["end_line"]) for r in rows)

    first = run()
    assert first == brute_hits(good, [(i, t) for i, t in items if t is not None], 7) and run() == first
    summary = {r["item_id"]: r for r in spark.read.json(f"{tmp_path}/out/report=r1/questions").collect()}
    assert summary[4]["hits"] == 0 and summary[1]["hits"] == sum(x[0] == 1 for x in first)
    put(spark, f"{tmp_path}/docs", [])  # fewer modules than before: nothing of the old report stays
    answers.answer_questions(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out", report="r1", top_k=1)
    assert answers.hits(spark, f"{tmp_path}/out", "r1").count() <= 5


def test_answers_of_nothing(spark, tmp_path):
    put(spark, f"{tmp_path}/docs", [])
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    assert answers.answer_questions(spark, f"{tmp_path}/docs", f"{tmp_path}/items", f"{tmp_path}/out") == {"questions": 0, "hits": 0}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_registered_jobs_match_their_sql(spark, name):
    import duckdb

    db = duckdb.connect()
    for table in ("documents", "benchmark"):
        db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    expected = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(expected.columns)
    assert sorted(map(str, map(tuple, got.select(*expected.columns).collect()))) == sorted(map(str, expected.fetchall()))


def test_command_line(spark, tmp_path):
    put(spark, f"{tmp_path}/docs", [doc(1, "apple pear"), doc(2, "plum")])
    spark.createDataFrame([(1, "pear")], "item_id long, text string").write.parquet(f"{tmp_path}/items")
    config = tmp_path / "c.json"
    config.write_text(json.dumps({"documents": f"{tmp_path}/docs", "questions": f"{tmp_path}/items", "out": "nowhere", "top_k": 1}))
    env = os.environ | {"PYSPARK_SUBMIT_ARGS": "--master local[2] --conf spark.ui.enabled=false pyspark-shell"}
    done = subprocess.run([sys.executable, "-m", "jobs.answer_questions", "--config", str(config), "--out", f"{tmp_path}/out", "--top-k", "2"], cwd=ROOT, env=env, capture_output=True, text=True, timeout=180, check=True)
    assert json.loads(done.stdout.strip().split("\n")[-1]) == {"questions": 1, "hits": answers.hits(spark, f"{tmp_path}/out", "latest").filter(F.col("item_id") == 1).count()}
    assert "wrote" in done.stderr
