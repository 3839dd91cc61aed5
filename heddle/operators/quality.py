"""Integrity rules as tables of violations: (rule, key, detail), empty if all hold."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _row(df: DataFrame, rule: str, key: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), key.cast("string").alias("key"), detail.cast("string").alias("detail"))


def range_violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """One row for each rule that a row breaks; a condition that is null counts as broken. One pass for all rules."""
    broken = F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), name) for name, ok in rules.items())))
    return df.select(F.explode(broken).alias("rule"), F.col(key).cast("string").alias("key"), F.lit(None).cast("string").alias("detail"))


def duplicate_keys(df: DataFrame, keys: list[str], rule: str = "unique") -> DataFrame:
    return _row(df.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n > 1"), rule, F.concat_ws("|", *keys), F.col("_n"))


def dangling(child: DataFrame, foreign: str, parent: DataFrame, primary: str, rule: str = "reference") -> DataFrame:
    """References without a target."""
    return _row(child.filter(F.col(foreign).isNotNull()).join(parent.select(F.col(primary).alias(foreign)), foreign, "left_anti"), rule, F.col(foreign), F.lit(None))


def order_violations(edges: DataFrame, parent_pos: str, child_pos: str, key: str) -> DataFrame:
    """Edges whose parent doesn't stand before its child."""
    return _row(edges.filter(F.col(parent_pos) >= F.col(child_pos)), "topological", F.col(key), F.concat_ws(">", parent_pos, child_pos))


def unknown_keys(df: DataFrame, key: str, json: str, allowed: list[str]) -> DataFrame:
    extra = F.array_except(F.json_object_keys(json), F.array(*map(F.lit, allowed)))
    return _row(df.withColumn("_extra", extra).filter(F.size("_extra") > 0), "unknown_keys", F.col(key), F.array_join("_extra", ","))


def forbidden_keys(df: DataFrame, key: str, json: str, forbidden: list[str]) -> DataFrame:
    """Keys that may stand at no depth: matched as JSON names (a quoted name before a colon), JVM-side."""
    pattern = '"(' + "|".join(forbidden) + ')"[ \\t\\r\\n]*:'
    return _row(df.filter(F.regexp_like(json, F.lit(pattern))), "forbidden_keys", F.col(key), F.regexp_extract(json, pattern, 1))


def vanished(frames: DataFrame, keys: list[str], pos: str, cell: str, retired: str) -> DataFrame:
    """Cells that are gone in the next frame without having been retired, and cells that return after they were."""
    k = [*keys, cell]
    last = F.max(pos).over(W.partitionBy(*keys))
    nxt = F.lead(pos).over(W.partitionBy(*k).orderBy(pos))
    before = F.max(F.col(retired).cast("int")).over(W.partitionBy(*k).orderBy(pos).rowsBetween(W.unboundedPreceding, -1))
    marked = frames.withColumns({"_last": last, "_next": nxt, "_before": before})
    gone = marked.filter(~F.col(retired) & (F.col(pos) < F.col("_last")) & (F.col("_next").isNull() | (F.col("_next") > F.col(pos) + 1)))
    back = marked.filter((F.col("_before") == 1) & ~F.col(retired))
    name = F.concat_ws("|", *k)
    return _row(gone, "vanished", name, F.col(pos)).unionByName(_row(back, "reactivated", name, F.col(pos)))


def contract_mismatch(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on one side only (needs without a contract, contracts without a need)."""
    x, y = a.select(*keys).distinct().withColumn("_a", F.lit(1)), b.select(*keys).distinct().withColumn("_b", F.lit(1))
    both = x.join(y, keys, "full_outer").filter("_a is null or _b is null")
    return _row(both, "contract", F.concat_ws("|", *keys), F.when(F.col("_a").isNull(), "missing").otherwise("extra"))


def assert_none(violations: DataFrame, shown: int = 20) -> None:
    """Raise if there are violations, showing the first few."""
    if rows := violations.limit(shown).collect():
        raise ValueError("; ".join(f"{r['rule']}: {r['key']} {r['detail'] or ''}".strip() for r in rows))
