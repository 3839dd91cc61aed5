"""Latest-per-key, as-of, carry-forward, freshness and work sharing over ordered events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def latest_per_key(events: DataFrame, keys: list[str], order: list[str], values: list[str]) -> DataFrame:
    """The last row of each key; ties go to the later element of `order`. One aggregation with map-side maxima."""
    best = F.max_by(F.struct(*values), F.struct(*order))
    return events.groupBy(*keys).agg(best.alias("_v")).select(*keys, *(F.col(f"_v.{v}").alias(v) for v in values))


def as_of(probes: DataFrame, versions: DataFrame, keys: list[str], time: str, values: list[str], version_order: str) -> DataFrame:
    """probes with the values of the last version at or before their time (null if there is none).

    Both sides are united and scanned in order once: one shuffle on the keys, no range join. A version at the probe's
    own time is visible to it.
    """
    names = [c for c in probes.columns if c not in keys and c != time]
    left = probes.select(*keys, time, F.lit(1).alias("_side"), F.lit(None).cast(versions.schema[version_order].dataType).alias("_order"), F.struct(*names).alias("_probe"), F.lit(None).cast(versions.select(F.struct(*values)).schema[0].dataType).alias("_version"))
    right = versions.select(*keys, time, F.lit(0).alias("_side"), F.col(version_order).alias("_order"), F.lit(None).cast(left.schema["_probe"].dataType).alias("_probe"), F.struct(*values).alias("_version"))
    w = W.partitionBy(*keys).orderBy(time, "_side", "_order").rowsBetween(W.unboundedPreceding, W.currentRow)
    both = left.unionByName(right).withColumn("_seen", F.last("_version", ignorenulls=True).over(w)).filter("_side = 1")
    return both.select(*keys, time, *(F.col(f"_probe.{n}").alias(n) for n in names), *(F.col(f"_seen.{v}").alias(f"asof_{v}") for v in values))


def delivered_versions(polls: DataFrame, versions: DataFrame, keys: list[str], time: str, version: str) -> DataFrame:
    """Polls that deliver something new: the newest due version, if it wasn't delivered by the poll before. Versions between two polls are skipped."""
    seen = as_of(polls, versions, keys, time, [version], version)
    seen = seen.withColumn("_before", F.lag(f"asof_{version}").over(W.partitionBy(*keys).orderBy(time)))
    return seen.filter(F.col(f"asof_{version}").isNotNull() & ~F.col(f"asof_{version}").eqNullSafe(F.col("_before"))).drop("_before")


def changed_only(events: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Rows whose value differs from the row before of their key (a version probe that reads only what changed)."""
    marked = events.withColumn("_before", F.lag(value).over(W.partitionBy(*keys).orderBy(*order)))
    return marked.filter(~F.col(value).eqNullSafe(F.col("_before"))).drop("_before")


def freshness(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """expected rows with status fresh, stale or missing. Both have `version` and `value`; a null expected version isn't compared."""
    o = observed.select(F.col(key), F.col("version").alias("_version"), F.col("value").alias("_value"), F.lit(True).alias("_there"))
    status = F.when(F.col("_there").isNull(), "missing").when(F.col("version").isNotNull() & ~F.col("version").eqNullSafe(F.col("_version")), "stale").when(~F.col("value").eqNullSafe(F.col("_value")), "stale").otherwise("fresh")
    return expected.join(o, key, "left").withColumn("status", status).drop("_version", "_value", "_there")


def refresh_due(policy: Column, seen: Column, age: Column, max_age: Column) -> Column:
    """Is a read due: `once` only before the first observation, `always` at every step, `max_age` from that age on."""
    return F.when(~seen, True).when(policy == "always", True).when(policy == "max_age", F.coalesce(age >= max_age, F.lit(False))).otherwise(False)


def share_work(requests: DataFrame, work_key: str, order: list[str]) -> DataFrame:
    """requests with `owner` (the first of each work key reads; the rest wait for it) and `deduplicated`."""
    w = W.partitionBy(work_key).orderBy(*order)
    rn = F.row_number().over(w)
    return requests.withColumn("deduplicated", rn > 1)


def carry_forward(steps: DataFrame, arrivals: DataFrame, keys: list[str], step: str, value: str, order: str) -> DataFrame:
    """Each step with the value of the last arrival."""
    return as_of(steps, arrivals, keys, step, [value], order)
