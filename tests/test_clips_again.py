"""Clips that come again after eviction, in ranges, against the registry itself."""

import random

import pytest

from corvane.operators import clips


@pytest.mark.parametrize("kind", ["rounds", "near", "mixed", "nulls"])
def test_ranges_of_puts_hold_what_a_replay_holds(spark, monkeypatch, kind):
    rnd = random.Random(len(kind))
    near = [rnd.randrange(30) for _ in range(600)]
    keys = {"rounds": [*range(400)] * 2, "near": near, "mixed": [*range(300), *near, *range(1000, 1300), *near, *range(300)], "nulls": [*range(300)] * 2 + near}[kind]
    rows = [(None if kind == "nulls" and i < 3 else i // 7, i, f"f{k}", k % 5, k % 5 + 1) for i, k in enumerate(keys)]
    puts = spark.createDataFrame(rows, "a long, b long, file_path string, start_line int, end_line int").repartition(3)
    registry = clips.ClipRegistry(20)
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1])):
        registry.put(*r[2:])
    pieces, run = [], clips._replayed
    monkeypatch.setattr(clips, "PIECE", 200)
    monkeypatch.setattr(clips, "RANGES", 12)
    monkeypatch.setattr(clips, "_replayed", lambda part, *more: (pieces.append(part.count()), run(part, *more))[1])
    got = clips.fifo(puts, ["a", "b"], 20)
    assert sorted(map(tuple, got.collect())) == registry.rows()
    assert max(pieces, default=0) <= 400 and (kind != "rounds" or not pieces)  # no task is given all puts
