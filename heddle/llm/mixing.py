"""Operator 2, mixing sources to target weights by Pfair scheduling.

The rows of each source, in hash order, form blocks of equal size. Block i of a source with weight w is released at
slot floor(i / w) and due by slot ceil((i + 1) / w); every slot takes the released block with the earliest deadline
(ties: earliest release, then source name). The weights of a phase sum to one exactly (they are rational numbers, never
rounded), so at every slot each source is within less than one block of its target share. When a source has no blocks
left, a new phase begins in which the rest share its weight in proportion, and the bound holds anew from there.

Nothing is dropped, repeated or sampled: the result orders all rows. `weights` None means weights in proportion to
rows ** `power`.

Scale: a block has `block_rows` rows, or as many more as keep the schedule at `SLOTS` slots (and one for each source),
so a block is never more than a 2**18th of a large table. The driver schedules blocks, not rows: it sees a row a source
and sends out a row a block. Rows are ranked within a source without bringing a source together: a source is dealt into
many hash buckets (a multiple of the shuffle partitions), each ranked alone, and bucket sizes are summed up in a table
of one row a bucket.

Defined cases: a null source is a source of its own; rows of sources without a positive weight come last, mixed by
their sizes; rows that repeat a doc_id are ordered by their text's hash, equal rows are interchangeable; null ids come
first within their bucket; texts of any length are one row each; an empty table gives an empty result; other columns
pass through `mix_rows`, whatever their names, but for those it adds.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.common import materialize, read_table

BLOCK_ROWS = 16
SLOTS = 1 << 18
ADDED = ("mix_block", "mix_phase", "mix_slot", "mix_release", "mix_deadline", "mix_position")


def block_size(rows: int, least: int = BLOCK_ROWS, slots: int = SLOTS) -> int:
    return max(least, -(-rows // slots))


def schedule(blocks: dict[str, int], weights: dict[str, float]) -> list[tuple[str, int, int, int, int, int]]:
    """(source, block, phase, slot, release, deadline) of every block."""
    left = {s: n for s, n in blocks.items() if n > 0}
    used, base, phase, rows = dict.fromkeys(left, 0), 0, 0, []
    while left:
        own = {s: Fraction(weights[s]) for s in left if weights.get(s, 0) > 0} or {s: Fraction(blocks[s]) for s in left}
        total = sum(own.values())
        rate = {s: total / w for s, w in own.items()}  # slots a block
        rate = {s: (x.numerator, x.denominator) for s, x in rate.items()}
        waiting = [(0, s, 0) for s in sorted(own)]
        ready: list[tuple[int, int, str, int]] = []
        t, over = 0, False
        while not over:
            while waiting and waiting[0][0] <= t:
                release, s, i = heapq.heappop(waiting)
                p, q = rate[s]
                heapq.heappush(ready, (-(-(i + 1) * p // q), release, s, i))
            due, release, s, i = heapq.heappop(ready)
            rows.append((s, used[s], phase, base + t, base + release, base + due))
            used[s] += 1
            left[s] -= 1
            if left[s]:
                p, q = rate[s]
                heapq.heappush(waiting, ((i + 1) * p // q, s, i + 1))
            else:
                over = True
                del left[s]
            t += 1
        base, phase = base + t, phase + 1
    return rows


def rank_rows(rows: DataFrame, group: str, key: list[str], seed: int = 0) -> DataFrame:
    """rows with `_rank`, the place of a row within its group in hash order of its key, counted without bringing a group together."""
    buckets = 8 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("_hash", F.xxhash64(F.lit(seed), key[0])).withColumn("_bucket", F.pmod("_hash", F.lit(buckets)))
    sizes = rows.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col(group).alias("_group"), F.col("_bucket").alias("_b"), F.coalesce(F.sum("_n").over(W.partitionBy(group).orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    placed = rows.withColumn("_place", F.row_number().over(W.partitionBy(group, "_bucket").orderBy("_hash", *key)))
    joined = placed.join(before, (F.col(group) == F.col("_group")) & (F.col("_bucket") == F.col("_b")))
    return joined.withColumn("_rank", F.col("_before") + F.col("_place") - 1).drop("_hash", "_bucket", "_place", "_group", "_b", "_before")


def _scheduled(docs: DataFrame, weights: dict[str, float] | None, power: float, block_rows: int) -> tuple[dict[str, int], int, list[tuple]]:
    """Rows of each source, rows of a block, and the schedule."""
    sizes = {r["s"]: r["n"] for r in docs.groupBy(F.coalesce("source", F.lit("")).alias("s")).agg(F.count("*").alias("n")).collect()}
    size = block_size(sum(sizes.values()), block_rows)
    return sizes, size, schedule({s: -(-n // size) for s, n in sorted(sizes.items())}, weights if weights is not None else {s: n**power for s, n in sizes.items()})


def _local_table(spark: SparkSession, rows: list[tuple], columns: list[tuple[str, pa.DataType]]) -> DataFrame:
    """The driver's rows as a table. By Arrow, since a plain list would be read by Python workers of its own on the executors."""
    return spark.createDataFrame(pa.Table.from_arrays([pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(columns)], schema=pa.schema(columns)))


def mix_rows(docs: DataFrame, weights: dict[str, float] | None = None, power: float = 0.5, block_rows: int = BLOCK_ROWS, seed: int = 0) -> DataFrame:
    """docs with mix_block, mix_phase, mix_slot, mix_release, mix_deadline and mix_position, the row's place in the mixture (ascending, not dense).

    Null sources are named "" in `weights`.
    """
    source = F.coalesce(F.col("source"), F.lit(""))
    columns = [c for c in docs.columns if c not in ADDED]
    text = F.xxhash64("text") if "text" in columns else F.lit(0)
    packed = docs.select(F.struct(*columns).alias("_row"), source.alias("_source"), F.col("doc_id").alias("_id"), text.alias("_text"))
    _, size, table = _scheduled(docs, weights, power, block_rows)
    plan = _local_table(docs.sparkSession, table, [("_s", pa.string()), ("mix_block", pa.int64()), ("mix_phase", pa.int32()), ("mix_slot", pa.int64()), ("mix_release", pa.int64()), ("mix_deadline", pa.int64())])
    if len(table) <= 2 * SLOTS:  # always, unless there are more than SLOTS sources
        plan = F.broadcast(plan)
    rows = rank_rows(packed, "_source", ["_id", "_text"], seed).withColumn("_block", F.expr(f"_rank div {size}"))
    both = rows.join(plan, (F.col("_source") == F.col("_s")) & (F.col("_block") == F.col("mix_block")))
    return both.withColumn("mix_position", F.col("mix_slot") * size + F.col("_rank") % size).select("_row.*", *ADDED)


def in_mixed_order(docs: DataFrame, **options) -> DataFrame:
    """docs, its columns as they are, sorted by their place in the mixture."""
    rows = docs.unionByName(docs.limit(0))  # what is sorted has no files any more (see dealt_positions)
    return mix_rows(rows, **options).orderBy("mix_position").select(*docs.columns)


def dealt_positions(docs: DataFrame, power: float = 0.5, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with mix_position, the schedule's positions dealt out in the order in which the rows stand: for rows that
    `in_mixed_order` wrote, those of `mix_rows`.

    A table read from Parquet stands in the order of its files and of the rows in them; parts of such a table, and rows
    that know no files, are written first. A table read and then sorted otherwise than by `in_mixed_order` must be written
    by the caller. Only numbers of rows are looked at (the driver sees one a file and one a source); nothing is shuffled.
    Spark's functions alone: a Python function here would hold a second worker for each task of a stage that encodes.
    """
    columns = [c for c in docs.columns if c not in ADDED]
    try:
        meta = docs.metadataColumn("_metadata")
        rows = docs.select(*columns, meta["file_path"].alias("_file"), meta["row_index"].alias("_index"))
        files = rows.groupBy("_file").agg(F.count("*").alias("n"), F.max("_index").alias("last")).collect()
        whole = all(f["n"] == f["last"] + 1 for f in files)
    except AnalysisException:
        whole = False
    if not whole:
        return dealt_positions(materialize(docs.select(*columns), "mix-order"), power, block_rows)
    # slots follow each other, so a position is a row's place and what the blocks before it lack: a source's last may be short
    sizes, size, table = _scheduled(docs, None, power, block_rows)
    ends, gaps, upto, lack = [], [0], 0, 0
    for source, block, *_ in table:
        rest = min(size, sizes[source] - block * size)
        upto += rest
        if rest < size:
            lack += size - rest
            ends.append(upto)
            gaps.append(lack)
    parts, start = [], 0
    for f in sorted(files, key=lambda f: (len(f["_file"]), f["_file"])):  # a part's number has five digits or more
        first, last = bisect_right(ends, start), bisect_right(ends, start + f["n"] - 1)
        parts.append((f["_file"], start, ends[first:last], gaps[first : last + 1]))
        start += f["n"]
    longs = pa.list_(pa.int64())
    known = _local_table(docs.sparkSession, parts, [("_path", pa.string()), ("_start", pa.int64()), ("_ends", longs), ("_gaps", longs)])
    placed = rows.join(F.broadcast(known), F.col("_file") == F.col("_path")).withColumn("_place", F.col("_start") + F.col("_index"))
    # how many of the file's ends lie at or before a place, by bisection: a step for each power of two, the largest first
    steps = [1 << i for i in reversed(range(max((len(p[2]) for p in parts), default=0).bit_length()))]
    passed = lambda n, step: F.when(F.get("_ends", n + step - 1) <= F.col("_place"), n + step).otherwise(n)
    before = F.aggregate(F.array(*map(F.lit, steps)).cast("array<int>"), F.lit(0), passed)
    return placed.select(*columns, (F.col("_place") + F.get("_gaps", before)).alias("mix_position"))


def op2_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mix_rows(docs)
