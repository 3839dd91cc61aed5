"""State that outlives a batch or a job: deadlines, versions, cursors."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest

from heddle.sources import versions
from heddle.sources.shared import new_folder
from heddle.streaming import deadlines, tables


def test_deadlines_in_any_order_within_the_lateness(spark):
    """Rows come up to two minutes late, over many micro-batches; a late row joins two stretches that looked apart."""
    rng = random.Random(4)
    start = datetime(2024, 1, 1)
    rows = [(rng.choice("abc"), start + timedelta(seconds=rng.randint(0, 3600))) for _ in range(150)] + [(None, start), ("a", None), ("z", start + timedelta(hours=2))]
    known = sorted([r for r in rows if r[1] is not None], key=lambda r: r[1] + timedelta(seconds=rng.randint(0, 110)))
    path = new_folder(spark, "late")
    for at in range(0, len(known), 40):
        spark.createDataFrame(known[at : at + 40] + [("a", None)], "who string, at timestamp").coalesce(1).write.mode("append").parquet(path)
    stream = tables.read_stream(spark, path, "who string, at timestamp")
    found = tables.with_state_store(spark, lambda: tables.run_to_table(deadlines.deadlines(stream, "who", "at", "90 seconds", "2 minutes"), "late"))
    want, mark = [], max(t for _, t in known) - timedelta(minutes=2)
    for who in "abcz":
        times = sorted(t for w, t in known if w == who)
        n = 0
        for i, t in enumerate(times):
            n += 1
            end = t + timedelta(seconds=90)
            if (i + 1 == len(times) or times[i + 1] > end) and end <= mark:
                want.append((who, t, end, n))
                n = 0
            elif i + 1 < len(times) and times[i + 1] > end:
                n = 0
    assert sorted(tuple(r) for r in found.select("case", "silent_since", "deadline", "events").collect()) == sorted(want) and len(want) > 30


def test_deadlines_to_the_millisecond_without_python_state(spark):
    """An event at the deadline puts it off, one a millisecond later doesn't; a deadline that the watermark just reaches has a row."""
    start = datetime(2024, 1, 1)
    at = lambda ms: start + timedelta(milliseconds=ms)
    rows = [("a", at(0)), ("a", at(1000)), ("b", at(0)), ("b", at(1001)), ("c", at(9000)), ("d", at(9001)), ("z", at(20_000))]
    path = new_folder(spark, "exact")
    spark.createDataFrame(rows, "who string, at timestamp").coalesce(1).write.parquet(path)
    silent = deadlines.deadlines(tables.read_stream(spark, path, "who string, at timestamp"), "who", "at", "1 second", "10 seconds")
    assert "Pandas" not in silent._jdf.queryExecution().toString()  # a timer for each event, fired in Python, was too slow at 1 GB
    found = tables.with_state_store(spark, lambda: tables.run_to_table(silent, "exact"))
    want = [("a", at(1000), at(2000), 2), ("b", at(0), at(1000), 1), ("b", at(1001), at(2001), 1), ("c", at(9000), at(10_000), 1)]
    assert sorted(tuple(r) for r in found.select("case", "silent_since", "deadline", "events").collect()) == want


def test_versions(spark):
    root = new_folder(spark, "versions")
    table = lambda n, v: spark.createDataFrame([(i, v) for i in range(n)], "k long, v string")
    with pytest.raises(ValueError, match="nothing is committed"):
        versions.read(spark, root)
    assert versions.commit(table(5, "a"), root, ["k"])["version"] == 1
    with pytest.raises(ValueError, match="duplicate or missing key"):
        versions.commit(table(3, "b").unionByName(table(1, "c")), root, ["k"])
    with pytest.raises(ValueError, match="duplicate or missing key"):
        versions.commit(spark.createDataFrame([(None, "x")], "k long, v string"), root, ["k"])
    staged = versions.stage(table(7, "d"), root, ["k"])  # a job that dies here
    assert [r["v"] for r in versions.read(spark, root).collect()] == ["a"] * 5
    schema = "k long, v string"
    versions.publish(spark, root, staged, ["k"], schema, 2)
    with pytest.raises(versions.Conflict):  # another writer had the same number in mind
        versions.publish(spark, root, staged, ["k"], schema, 2)
    assert versions.read(spark, root).count() == 7 and versions.read(spark, root, 1).count() == 5
    assert versions.commit(table(0, ""), root, ["k"])["version"] == 3 and versions.read(spark, root).count() == 0


@pytest.mark.parametrize("steps", [[1] * 30, [7, 7, 7, 7, 2], [23, 7], [30], [0, 30, 0]])
def test_reads_go_on(spark, steps):
    """Whatever the steps, they make the same rows in the same order, each epoch all of them, though the table is replaced meanwhile."""
    root = new_folder(spark, "cursor")
    versions.commit(spark.createDataFrame([(i,) for i in range(10)], "k long").repartitionByRange(3, "k"), root, ["k"])
    got = []
    for i, n in enumerate(steps):
        cursor = versions.resume(spark, root)
        again, _ = versions.take(spark, root, cursor, n)
        rows, after = versions.take(spark, root, cursor, n)
        assert sorted(again.collect()) == sorted(rows.collect())
        got += sorted((r["epoch"], r["place"], r["k"]) for r in rows.collect())
        versions.save(spark, root, after, i)
        with pytest.raises(versions.Conflict):
            versions.save(spark, root, after, i)
        if i == 0:
            versions.commit(spark.createDataFrame([(99,)], "k long"), root, ["k"])
    assert [g[:2] for g in got] == [(e, p) for e in range(3) for p in range(10)]
    assert all(sorted(k for e, _, k in got if e == epoch) == list(range(10)) for epoch in range(3))
    empty = new_folder(spark, "cursor")
    versions.commit(spark.createDataFrame([], "k long"), empty, ["k"])
    assert versions.take(spark, empty, versions.resume(spark, empty), 5)[0].count() == 0
