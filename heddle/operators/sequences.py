"""Transitions, runs, chunks, schedules and prefix folds over integer steps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def transitions(steps: DataFrame, keys: list[str], step: str, bootstrap: bool = True) -> DataFrame:
    """(keys, source_step, target_step) of adjacent distinct steps; with `bootstrap` also -1 to 0 where there is a step 0."""
    own = steps.select(*keys, step).distinct()
    pairs = own.withColumn("_next", F.lead(step).over(W.partitionBy(*keys).orderBy(step))).filter(F.col("_next") == F.col(step) + 1)
    out = pairs.select(*keys, F.col(step).cast("long").alias("source_step"), F.col("_next").cast("long").alias("target_step"))
    if bootstrap:
        out = out.unionByName(own.filter(F.col(step) == 0).select(*keys, F.lit(-1).cast("long").alias("source_step"), F.lit(0).cast("long").alias("target_step")))
    return out


def adjacent_count(steps: Column) -> Column:
    """Steps of an array whose successor is there as well."""
    s = F.array_distinct(steps)
    return F.size(F.filter(s, lambda x: F.array_contains(s, x + 1)))


def training_count(steps: Column) -> Column:
    """adjacent_count() and one more if the steps contain 0."""
    return adjacent_count(steps) + F.array_contains(steps, F.lit(0)).cast("int")


def runs(steps: DataFrame, keys: list[str], step: str) -> DataFrame:
    """(keys, first_step, last_step, length) of maximal runs of consecutive steps."""
    own = steps.select(*keys, step).distinct().withColumn("_island", F.col(step) - F.row_number().over(W.partitionBy(*keys).orderBy(step)))
    return own.groupBy(*keys, "_island").agg(F.min(step).cast("long").alias("first_step"), F.max(step).cast("long").alias("last_step"), F.count("*").alias("length")).drop("_island")


def rollout_windows(steps: DataFrame, keys: list[str], step: str, horizon: int) -> DataFrame:
    """Runs cut into windows of at most `horizon` steps."""
    own = steps.select(*keys, step).distinct().withColumn("_island", F.col(step) - F.row_number().over(W.partitionBy(*keys).orderBy(step)))
    place = F.row_number().over(W.partitionBy(*keys, "_island").orderBy(step)) - 1
    cut = own.withColumn("_chunk", F.floor(place / horizon))
    return cut.groupBy(*keys, "_island", "_chunk").agg(F.min(step).cast("long").alias("first_step"), F.max(step).cast("long").alias("last_step"), F.count("*").alias("length")).drop("_island", "_chunk")


def history(turns: DataFrame, keys: list[str], order: str, values: Column, size: int, keep) -> Column:
    """The `size` rows before a row, in order; `keep` filters them after the cut."""
    w = W.partitionBy(*keys).orderBy(order).rowsBetween(-size, -1)
    return F.filter(F.collect_list(values).over(w), keep)


def previous_same_key(rows: DataFrame, keys: list[str], order: str, name: str) -> Column:
    return F.lag(name).over(W.partitionBy(*keys).orderBy(order))


def sequential_schedule(items: Column) -> Column:
    """Fold over an ordered array of structs (id, activation, delay, depends_on): launch at the latest of the activation and
    the dependencies' arrivals; arrive after the delay, but after the item before."""
    one = "struct(x.id as id, {launch} as launch, {arrive} as arrive)"
    launch = "greatest(x.activation, coalesce(array_max(transform(filter(acc, y -> array_contains(x.depends_on, y.id)), y -> y.arrive)), 0))"
    arrive = f"greatest({launch} + x.delay, coalesce(try_element_at(acc, -1).arrive + 1, 0))"
    return F.expr(f"aggregate({{items}}, cast(array() as array<struct<id:string,launch:long,arrive:long>>), (acc, x) -> concat(acc, array({one.format(launch=launch, arrive=arrive)})))".replace("{items}", items))


def revision_label(before: Column, after: Column, dead: float = 1e-6) -> Column:
    """REOPEN if the noise rises, STABILIZE if it falls, KEEP within the dead band, null without a value before."""
    change = after - before
    return F.when(change > dead, "REOPEN").when(change < -dead, "STABILIZE").when(change.isNotNull(), "KEEP")


def proportional_block(place: Column, count: Column, blocks: int) -> Column:
    """Block of the place-th of count rows when block i ends at floor((i + 1) * count / blocks)."""
    return F.floor(((place + 1) * blocks - 1) / count)
