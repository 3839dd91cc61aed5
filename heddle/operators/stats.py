"""Counts, histograms, exact index quantiles, manifests, audits and loss balancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.sources.shared import materialize



#: Share of a group's rows on either side of the wanted place that a bracket holds.
BRACKET = 1e-3


def index_quantile(df: DataFrame, by: list[str], value: str, q: float, rounding: str) -> DataFrame:
    """(by, quantile): the value at index (n - 1) * q, rounded half to even ("round") or down ("floor"); nulls don't count.

    Two passes over the values alone: the first brackets the place by sketched quantiles, the second counts what lies below
    the bracket and, value by value, what lies in it. Neither sorts or moves the rows; a group of any size is counted in tasks
    first, and what is ranked at last are a bracket's different values. Should a sketch miss, its group is ranked as a whole.
    """
    rows = df.select(*by, F.col(value).alias("_v")).filter("_v is not null")
    places = F.array(F.lit(max(q - BRACKET, 0.0)), F.lit(min(q + BRACKET, 1.0)))
    first = rows.groupBy(*by).agg(F.count("*").alias("_n"), F.percentile_approx("_v", places, F.lit(int(4 / BRACKET))).alias("_p"))
    last = (F.col("_n") - 1) * F.lit(q)
    bracket = first.select(*by, (F.bround(last) if rounding == "round" else F.floor(last)).cast("long").alias("_at"), F.col("_p")[0].alias("_lo"), F.col("_p")[1].alias("_hi"))

    def ranked(rows: DataFrame, bracket: DataFrame) -> DataFrame:
        """(by, _at, _hit): the value at the place, null if the bracket doesn't reach it."""
        side = F.when(F.col("_v") < F.col("_lo"), F.lit(None)).otherwise(F.col("_v"))  # all below the bracket count as one
        same = [F.col(b).eqNullSafe(F.col(f"_b{i}")) for i, b in enumerate(by)]
        on = same[0] if same else F.lit(True)
        for c in same[1:]:
            on &= c
        met = rows.join(bracket.select(*(F.col(b).alias(f"_b{i}") for i, b in enumerate(by)), "_at", "_lo", "_hi"), on).filter(F.col("_v") <= F.col("_hi"))
        counted = met.groupBy(*by, "_at", side.alias("_s")).agg(F.count("*").alias("_k"))
        upto = F.sum("_k").over(W.partitionBy(*by).orderBy(F.col("_s").asc_nulls_first()).rowsBetween(W.unboundedPreceding, W.currentRow))
        hit = counted.withColumn("_upto", upto).filter((F.col("_at") < F.col("_upto")) & (F.col("_at") >= F.col("_upto") - F.col("_k")))
        return hit.select(*by, F.col("_s").alias("quantile"))

    found = materialize(ranked(rows, bracket), "quantiles")  # a row a group
    if not by:
        return found
    missed = bracket.join(found.filter("quantile is not null").select(*(F.col(b).alias(f"_f{i}") for i, b in enumerate(by))), [F.col(b).eqNullSafe(F.col(f"_f{i}")) for i, b in enumerate(by)], "left_anti")
    whole = rows.groupBy(*by).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi"))
    if missed.isEmpty():
        return found
    wide = missed.drop("_lo", "_hi").join(whole.select(*(F.col(b).alias(f"_w{i}") for i, b in enumerate(by)), "_lo", "_hi"), [F.col(b).eqNullSafe(F.col(f"_w{i}")) for i, b in enumerate(by)])
    return found.filter("quantile is not null").unionByName(ranked(rows, wide.select(*by, "_at", "_lo", "_hi")))


def group_share(df: DataFrame, by: str) -> DataFrame:
    """(n_groups, n_rows, largest, distinct_ratio) of a key's groups."""
    g = df.groupBy(by).agg(F.count("*").alias("n"))
    return g.agg(F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.max("n").alias("largest"), F.round(F.count("*") / F.sum("n"), 6).alias("distinct_ratio"))


def majority(df: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """(keys, value, votes): the most common value; ties go to the value seen first."""
    votes = df.groupBy(*keys, value).agg(F.count("*").alias("votes"), F.min(order).alias("_first"))
    best = F.max_by(F.struct(value, "votes"), F.struct(F.col("votes"), -F.col("_first")))
    return votes.groupBy(*keys).agg(best.alias("_b")).select(*keys, f"_b.{value}", "_b.votes")


def mode_conflicts(df: DataFrame, key: str, mode: str) -> DataFrame:
    """(mode, n) of keys with more than one mode; such a key counts once for each."""
    many = df.groupBy(key).agg(F.collect_set(mode).alias("m")).filter(F.size("m") > 1)
    return many.select(F.explode("m").alias(mode)).groupBy(mode).agg(F.count("*").alias("n"))


def balance_weights(df: DataFrame, task: str, weight: str, size: str) -> DataFrame:
    """df with `loss_weight` = T * w / (W * n): a task's windows weigh w together in proportion, and the mean over all T transitions is one.

    n is the task's transitions, W the sum of the tasks' weights. The totals are one row, joined to every row.
    """
    tasks = df.groupBy(task).agg(F.sum(size).alias("_n"), F.max(weight).alias("_w"))
    total = tasks.agg(F.sum("_n").alias("_t"), F.sum("_w").alias("_sum"))
    return df.join(tasks.select(task, "_n"), task).join(F.broadcast(total)).withColumn("loss_weight", F.col("_t") * F.col(weight) / (F.col("_sum") * F.col("_n"))).drop("_n", "_t", "_sum")


def optimizer_steps(windows: DataFrame, by: list[str], length: str, world: int, micro: int, accumulate: int) -> DataFrame:
    """One row: steps of an epoch when each bucket is padded to the world and cut into micro-batches."""
    n = windows.groupBy(*by).agg(F.count("*").alias("n"))
    per = F.ceil(F.ceil(F.col("n") / world) / micro) * F.col(length)
    return n.agg(F.ceil(F.sum(per) / accumulate).alias("steps"))


def manifest(steps: DataFrame, example: str, step: str, slot: str, source: str) -> DataFrame:
    """One row: examples, transitions, bootstrap and training transitions, trainable and untrainable examples, sources, capacity, most steps."""
    by = steps.groupBy(example).agg(F.collect_set(step).alias("s"), F.max(F.col(slot) + 1).alias("cap"))
    adjacent = F.size(F.filter("s", lambda x: F.array_contains("s", x + 1)))
    boot = F.array_contains("s", F.lit(0)).cast("int")
    rows = by.select(adjacent.alias("a"), boot.alias("b"), "cap", F.size("s").alias("k"))
    one = rows.agg(
        F.count("*").alias("examples"), F.sum("a").alias("transitions"), F.sum("b").alias("bootstrap"), F.sum(F.col("a") + F.col("b")).alias("training"),
        F.count_if(F.col("a") + F.col("b") > 0).alias("trainable"), F.count_if(F.col("a") + F.col("b") == 0).alias("untrainable"), F.max("cap").cast("long").alias("capacity"), F.max("k").cast("long").alias("most_steps"),
    )
    return one.join(F.broadcast(steps.agg(F.count_distinct(source).alias("sources"))))


def rate(part: Column, whole: Column, empty: float) -> Column:
    """part / whole, `empty` where there is nothing to divide by."""
    return F.when(F.coalesce(whole, F.lit(0)) == 0, F.lit(empty)).otherwise(part / whole)


def first_delay(trace: DataFrame, keys: list[str], kind: str, first: str, second: Column, step: str, seq: str) -> DataFrame:
    """(keys, delay): step of the first `second` row less that of the first row of kind `first`, for keys that have both."""
    a = F.min_by(F.when(F.col(kind) == first, F.col(step)), F.when(F.col(kind) == first, F.col(seq)))
    b = F.min_by(F.when(second, F.col(step)), F.when(second, F.col(seq)))
    return trace.groupBy(*keys).agg(a.alias("_a"), b.alias("_b")).filter("_a is not null and _b is not null").select(*keys, (F.col("_b") - F.col("_a")).alias("delay"))


def delay_after(trace: DataFrame, keys: list[str], first: Column, second: Column, step: str, seq: str) -> DataFrame:
    """(keys, delay): from the first `first` row to the first `second` row *emitted after it*."""
    w = W.partitionBy(*keys)
    seen = F.min(F.when(first, F.col(seq))).over(w)
    later = trace.withColumn("_seen", seen).filter((F.col(seq) == F.col("_seen")) | (second & (F.col(seq) > F.col("_seen"))))
    at = F.min(F.when(F.col(seq) == F.col("_seen"), F.col(step)))
    then = F.min_by(F.when(F.col(seq) > F.col("_seen"), F.col(step)), F.when(F.col(seq) > F.col("_seen"), F.col(seq)))
    return later.groupBy(*keys).agg(at.alias("_a"), then.alias("_b")).filter("_b is not null").select(*keys, (F.col("_b") - F.col("_a")).alias("delay"))
