"""First-wins deduplication, exclusion and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.sources.shared import materialize


def first_by(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in the given order. One shuffle on the key; the rank limit is pushed below it."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


def mark_duplicates(df: DataFrame, fingerprint: str, order: list[Column | str], name: str) -> DataFrame:
    """df with `duplicate_of`: the name of the first row with the same fingerprint, null on the first row itself."""
    firsts = df.groupBy(fingerprint).agg(F.min_by(name, F.struct(*order)).alias("_first"))  # a hot fingerprint is a minimum in each task, and one row
    known = firsts.withColumnRenamed(fingerprint, "_fingerprint")
    return df.join(known, F.col(fingerprint).eqNullSafe(F.col("_fingerprint"))).withColumn("duplicate_of", F.when(F.col("_first") != F.col(name), F.col("_first"))).drop("_first", "_fingerprint")


def exclude(df: DataFrame, other: DataFrame, key: str) -> DataFrame:
    return df.join(other.select(key).distinct(), key, "left_anti")


def disjoint_violations(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that stand on both sides of a split that must be disjoint."""
    return a.select(key).intersect(b.select(key))


def sequential_quota(df: DataFrame, source: str, sources: list[str], key: str, order: list[str], quotas: dict[str, int]) -> DataFrame:
    """Of each source in turn the first `quota` rows by `order`, one a key, without keys that an earlier source *accepted*.

    A key that an earlier source merely held, beyond its quota, stays open. Each source's accepted rows are written
    before the next source is looked at (the number of sources is the length of a registry, not of the data).
    """
    accepted = None
    for name in sources:
        own = df.filter(F.col(source) == name)
        if accepted is not None:
            own = own.join(accepted.select(key), key, "left_anti")
        own = first_by(own, [key], order).withColumn("_rank", F.lit(1))
        own = own.orderBy(*order).limit(quotas[name]).drop("_rank")
        own = materialize(own, "quota")
        accepted = own if accepted is None else accepted.unionByName(own)
    return accepted
