"""Hash-ordered samples, strata, shards and micro-batches. No random numbers: every order is a hash of a key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.functions.keys import joined, stable_hash
from heddle.operators.ranking import place_in_order


def hash_order(seed: str, *parts: Column | str) -> Column:
    return stable_hash(joined(F.lit(seed), *parts))


def top_by_hash(df: DataFrame, n: int, seed: str, key: str) -> DataFrame:
    """The first n rows in hash order (top-n in each task, then one merge of n rows a task)."""
    return df.withColumn("_h", hash_order(seed, key)).orderBy("_h", key).limit(n).drop("_h")


def stratified(df: DataFrame, by: list[str], n: int, seed: str, key: str) -> DataFrame:
    """The first n rows of each stratum in hash order, with their rank."""
    w = W.partitionBy(*by).orderBy(hash_order(seed, key), key)
    return df.withColumn("stratum_rank", F.row_number().over(w)).filter(F.col("stratum_rank") <= n)


def quota_with_drops(df: DataFrame, by: str, key: str, order: list[Column | str], quota: int, bad: Column) -> DataFrame:
    """(by, rank, key, dropped_before): accepted rows until the quota fills, each with the rows dropped up to it.

    Rows that are bad, and repeats of a key, are dropped; drops after the row that fills the quota don't count.
    """
    w = W.partitionBy(by).orderBy(*order)
    seen = F.row_number().over(W.partitionBy(by, key).orderBy(bad.cast("int"), *order))
    rows = df.withColumn("_ok", ~bad & (seen == 1))
    upto = w.rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.withColumns({"rank": F.sum(F.col("_ok").cast("long")).over(upto), "dropped_before": F.sum((~F.col("_ok")).cast("long")).over(upto)})
    return rows.filter(F.col("_ok") & (F.col("rank") <= quota)).drop("_ok")


def round_robin_shards(df: DataFrame, world: int, order: list[Column | str], by: list[str] | None = None) -> DataFrame:
    """df with `shard`: rows in the given order dealt to `world` ranks, in each bucket of `by` alone; short buckets wrap around.

    Padding repeats rows modulo the bucket's size, so that all ranks get equally many also where a bucket is smaller than the world.
    """
    ranked = place_in_order(df, order, by, "_i", "_n")
    padded = F.ceil(F.col("_n") / world) * world
    copies = F.sequence(F.lit(0), F.floor((padded - 1 - F.col("_i")) / F.col("_n")).cast("int"))
    dealt = ranked.withColumn("_copy", F.explode(copies)).withColumn("place", F.col("_i") + F.col("_copy") * F.col("_n"))
    return dealt.withColumns({"shard": (F.col("place") % world).cast("int"), "shard_place": F.floor(F.col("place") / world)}).drop("_i", "_n", "_copy", "place")


def micro_batches(df: DataFrame, by: list[str], order: list[Column | str], size: int) -> DataFrame:
    """df with `batch`: consecutive rows of a bucket, `size` at a time."""
    return place_in_order(df, order, by).withColumn("batch", F.floor(F.col("_place") / size)).drop("_place")
