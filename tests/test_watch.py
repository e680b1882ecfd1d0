"""The journal of file events and the runs that follow bursts, by a clock of the test's own."""

import os

import pytest

from corvane.streaming.watch import Debounce, Journal, events

T0 = 1_700_000_000.0


def put(root, name, at, text="x"):
    (root / name).parent.mkdir(parents=True, exist_ok=True)
    (root / name).write_text(text)
    os.utime(root / name, (at, at))


def told(spark, path):
    rows = spark.read.parquet(f"{path}/events").orderBy("poll", "path").collect()
    return [(r["poll"], r["path"], r["op"]) for r in rows]


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_a_journal_tells_what_changed(spark, tmp_path, scheme):
    root, path = tmp_path / "w", str(tmp_path / "j")
    put(root, "src/a", T0)
    put(root, "src/b", T0)
    journal = Journal(spark, f"{scheme}{root}", path, dirs=["src", "docs"], patterns=["*.map"])
    assert journal.poll(T0 + 10) == 0 and journal.open() is None  # what is there is known
    put(root, "src/a", T0 + 11)
    put(root, "docs/c", T0 + 11)
    for name in ("src/x.map", "other/d", "src/.hidden"):
        put(root, name, T0 + 11)
    (root / "src/b").unlink()
    assert journal.poll(T0 + 11.2) == 1  # the two that were written have not settled; they are neither new nor gone
    assert journal.poll(T0 + 12) == 2 and journal.poll(T0 + 13) == 0
    assert told(spark, path) == [(1, "src/b", "unlink"), (2, "docs/c", "add"), (2, "src/a", "change")]
    assert len([n for n in os.listdir(f"{path}/files") if n.startswith("v=")]) <= 3
    again = Journal(spark, f"{scheme}{root}", path, dirs=["src", "docs"], patterns=["*.map"])  # a restart
    assert again.poll(T0 + 20) == 0 and again.open()[0] == 2
    again.close(2)
    assert again.open() is None and Journal(spark, str(root), path).open() is None


def test_a_poll_that_crashed_is_made_again(spark, tmp_path):
    root, path = tmp_path / "w", str(tmp_path / "j")
    put(root, "a", T0)
    journal = Journal(spark, str(root), path)
    journal.poll(T0 + 5)
    put(root, "b", T0 + 5)
    journal.poll(T0 + 9)
    os.remove(f"{path}/events/poll=1/_SUCCESS")  # as if it had ended before
    os.remove(f"{path}/events/poll=1/._SUCCESS.crc")
    put(root, "c", T0 + 9)
    assert journal.poll(T0 + 12) == 2 and told(spark, path) == [(1, "b", "add"), (1, "c", "add")]


def test_bursts_make_one_run_each(spark, tmp_path):
    root, path, runs = tmp_path / "w", str(tmp_path / "j"), []
    put(root, "a", T0)

    def started():
        return Debounce(Journal(spark, str(root), path, settle_ms=0), lambda: runs.append(1), gap_ms=1500, limit_ms=6000)

    steps = started()
    assert not steps.step(T0) and not steps.step(T0 + 5)
    put(root, "b", T0 + 6)
    assert not steps.step(T0 + 6)
    put(root, "b", T0 + 7)
    assert not steps.step(T0 + 7)
    steps = started()  # a restart inside the burst
    assert not steps.step(T0 + 8) and runs == []
    assert steps.step(T0 + 8.6) and runs == [1]
    assert not steps.step(T0 + 20) and not started().step(T0 + 30) and runs == [1]
    for k in range(8):  # it never rests: a run comes at the limit
        put(root, "c", T0 + 40 + k)
        if steps.step(T0 + 40 + k):
            break
    assert k == 6 and runs == [1, 1]


def test_a_failed_run_is_told_and_the_watch_goes_on(spark, tmp_path):
    root, errors, calls = tmp_path / "w", [], []
    put(root, "a", T0)

    def run():
        calls.append(1)
        if len(calls) == 1:
            raise RuntimeError("first")

    steps = Debounce(Journal(spark, str(root), str(tmp_path / "j"), settle_ms=0), run, gap_ms=100, on_error=errors.append)
    steps.step(T0)
    put(root, "b", T0 + 1)
    steps.step(T0 + 1)
    assert steps.step(T0 + 2) and len(errors) == 1
    put(root, "b", T0 + 3)
    steps.step(T0 + 3)
    assert steps.step(T0 + 4) and len(calls) == 2
    with pytest.raises(RuntimeError):
        calls.clear()
        put(root, "d", T0 + 5)
        strict = Debounce(steps.journal, run, gap_ms=0)
        strict.step(T0 + 5)
        strict.step(T0 + 6)


def test_events_are_a_stream(spark, tmp_path):
    root, path = tmp_path / "w", str(tmp_path / "j")
    put(root, "a", T0)
    journal = Journal(spark, str(root), path, settle_ms=0)
    journal.poll(T0)

    def taken():
        query = events(spark, path).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted((r["path"], r["op"]) for r in spark.read.schema("path string, op string, ts timestamp").parquet(str(tmp_path / "out")).collect())

    assert taken() == []
    put(root, "b", T0 + 1)
    journal.poll(T0 + 2)
    assert taken() == [("b", "add")]
    put(root, "c", T0 + 3)
    (root / "a").unlink()
    journal.poll(T0 + 4)
    assert taken() == [("a", "unlink"), ("b", "add"), ("c", "add")]
    offsets = [f.read_text() for f in (tmp_path / "c/offsets").iterdir() if not f.name.startswith(".")]
    assert max(map(len, offsets)) < 1500 and not any("src" in o or '"b"' in o for o in offsets)  # offsets name no files of the workspace
