"""Pairing starts with finishes, merging and overlapping intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def pair_intervals(trace: DataFrame, keys: list[str], kind: str, start: str, finish: str, time: str, seq: str) -> DataFrame:
    """(keys, start, finish): each finish with the latest start of its key before it that has no finish; others are left out."""
    w = W.partitionBy(*keys).orderBy(seq)
    own = trace.filter(F.col(kind).isin(start, finish)).withColumns({"_before": F.lag(kind).over(w), "start": F.lag(time).over(w)})
    return own.filter((F.col(kind) == finish) & (F.col("_before") == start)).select(*keys, "start", F.col(time).alias("finish"))


def merge_intervals(intervals: DataFrame, keys: list[str], start: str = "start", finish: str = "finish") -> DataFrame:
    """Disjoint union of each key's intervals; intervals that only touch merge too."""
    w = W.partitionBy(*keys).orderBy(start, finish)
    reach = F.max(finish).over(w.rowsBetween(W.unboundedPreceding, -1))
    with_reach = intervals.withColumn("_reach", reach)
    marked = with_reach.withColumn("_new", (F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))).cast("int"))
    marked = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(finish).alias(finish)).drop("_island")


def overlaps(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of intervals of one key that overlap, with the overlap's length. Equal keys meet first; the range is a filter on them."""
    x = a.select(*keys, F.col("start").alias("a_start"), F.col("finish").alias("a_finish"))
    y = b.select(*keys, F.col("start").alias("b_start"), F.col("finish").alias("b_finish"))
    return x.join(y, keys).filter("a_start < b_finish and b_start < a_finish").withColumn("overlap", F.expr("least(a_finish, b_finish) - greatest(a_start, b_start)"))


def binned_overlaps(a: DataFrame, b: DataFrame, keys: list[str], width: int) -> DataFrame:
    """overlaps() for keys with many intervals: both sides are cut into bins of `width`, so a hot key spreads; each pair is kept in the bin where its overlap begins."""
    def cut(df: DataFrame, p: str) -> DataFrame:
        out = df.select(*keys, F.col("start").alias(f"{p}_start"), F.col("finish").alias(f"{p}_finish"))
        return out.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(f"{p}_start") / width), F.floor(F.col(f"{p}_finish") / width))))

    both = cut(a, "a").join(cut(b, "b"), [*keys, "_bin"]).filter("a_start < b_finish and b_start < a_finish")
    return both.filter(F.floor(F.greatest("a_start", "b_start") / width) == F.col("_bin")).drop("_bin").withColumn("overlap", F.expr("least(a_finish, b_finish) - greatest(a_start, b_start)"))


def interval_overlap(s1: Column, e1: Column, s2: Column, e2: Column) -> Column:
    return F.greatest(F.least(e1, e2) - F.greatest(s1, s2), F.lit(0))
