"""Queries whose cost or memory grew too fast: the same rows, and the form that bounds them."""

from __future__ import annotations

from pyspark.sql import functions as F

from heddle.operators import graph, slots
from heddle.plans import answer_queries, build_queries, more_queries, registry  # noqa: F401  the modules register their queries
from heddle.sources import sinks


def test_phase_cells_count_before_they_sort(spark, tmp_path):
    lines = [(1, 1), (1, 1), (1, 3), (2, 2), (1, 2), (3, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    out = registry.QUERIES["p34_phase_cells"](spark, str(tmp_path))
    got = {(r["l_orderkey"], r["phase"]): r["cells"] for r in out.filter("phase is not null").collect()}
    assert got == {(1, 1): 4, (1, 2): 3, (1, 3): 4, (2, 2): 1}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window ") < plan.index("Aggregate ")


def test_unsorted_rows_are_counted_as_files_are_read(spark, tmp_path):
    rows = spark.range(0, 25_000, 1, 3).select(F.when(F.col("id") % 5_000 == 4_321, 0).otherwise(F.col("id")).alias("k"))
    rows.write.parquet(f"{tmp_path}/x")
    assert tuple(sinks.unsorted(spark, f"{tmp_path}/x", "k").first()) == (25_000, 5)
    spark.createDataFrame([(3,), (None,), (2,), (1,)], "k long").coalesce(1).write.parquet(f"{tmp_path}/y")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        assert tuple(sinks.unsorted(spark, f"{tmp_path}/y", "k").first()) == (4, 1)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_slots_are_walked_across_batches(spark):
    """A key's cells in several batches, frames that end with a batch, keys in between; no group is held as a whole."""
    cells = [(u, f, c, c == "e") for u in range(7) for f in range(40) for c in ("a", "e", f"x{f // 10}")]
    df = spark.createDataFrame(cells, "user_id long, frame_pos int, cell_id string, retired boolean")
    whole = {tuple(r) for r in slots.allocate_slots(df, "user_id", 8).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "4")
    try:
        out = slots.allocate_slots(df, "user_id", 8)
        got = {tuple(r) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == whole and len(got) == len(cells) and len({(u, f, s) for u, f, _, s in got}) == len(cells)
    assert all(len({s for u, _, c, s in got if (u, c) == (k, "a")}) == 1 for k in range(7))
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_chain_and_reach_read_what_they_wrote(spark):
    """A hop is one join over written rows, and blocked nodes are taken from what is reached."""
    df = spark.createDataFrame([(1, None), (2, 1), (3, 2), (4, 3), (5, 5), (6, 7), (7, 6)], "k long, p long")
    out = graph.chain(df, "k", "p", 4)
    assert {tuple(r) for r in out.collect()} == {(2, 1, 1), (3, 1, 2), (3, 2, 1), (4, 1, 3), (4, 2, 2), (4, 3, 1), (5, 1, 5), (6, 1, 7), (7, 1, 6)}
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    edges = spark.createDataFrame([(1, 2), (1, 2), (2, 3), (3, 1), (2, 4), (4, 5), (9, 9)], "src long, dst long")
    counted = spark.sparkContext.accumulator(0)

    def once(batches):
        for b in batches:
            counted.add(b.num_rows)
            yield b

    read = edges.mapInArrow(once, "src long, dst long")
    got = graph.reachable(read, spark.createDataFrame([(1,)], "node long"), spark.createDataFrame([(4,), (4,)], "node long"))
    assert {tuple(r) for r in got.collect()} == {(1, 0), (2, 1), (3, 2)}
    assert counted.value == 7
