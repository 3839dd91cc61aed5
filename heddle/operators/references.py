"""References between files, found in JSON of any depth as Spark's VARIANT."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import materialize

# The fields that name another file, and where such files lie.
REFERENCE_KEYS = ("causal_jobs", "input_pool", "manifest", "path", "reference_manifest", "seed_trajectory_manifest", "semantic_mixture", "trajectory_manifest")
PREFIXES = ("data/", "manifests/", "metadata/")


def references(df: DataFrame, key: str, json: str, fields: tuple[str, ...] = REFERENCE_KEYS, prefixes: tuple[str, ...] = PREFIXES) -> DataFrame:
    """(key, path, target): every string under one of the fields that begins with one of the prefixes; paths are like `a.b[0].c`.

    One level of all documents at a time: objects and arrays are exploded, references kept, and what is nested goes on
    to the next level. The levels shrink, each is written once, and there are as many as the deepest document has.
    Null and invalid JSON have no references; rows that repeat a key are documents of their own; a field may hold both a
    reference and, elsewhere, an object.
    """
    level = df.select(F.col(key).alias("_key"), F.lit("").alias("_path"), F.try_parse_json(json).alias("_value"))
    found = []
    while True:
        level = materialize(level.filter(F.substring(F.to_json("_value"), 1, 1).isin("{", "[")), "references")
        if level.isEmpty():
            break
        each = level.lateralJoin(df.sparkSession.tvf.variant_explode(F.col("_value").outer()))
        dot = F.when(F.col("_path") == "", "").otherwise(".")
        path = F.when(F.col("key").isNull(), F.concat("_path", F.lit("["), F.col("pos").cast("string"), F.lit("]"))).otherwise(F.concat("_path", dot, "key"))
        level = each.select("_key", path.alias("_path"), F.col("key").alias("_field"), F.col("value").alias("_value"))
        text = F.try_variant_get("_value", "$", "string")
        named = level.filter(F.col("_field").isin(*fields) & (F.substring(F.to_json("_value"), 1, 1) == '"'))
        found.append(named.select(F.col("_key").alias(key), F.col("_path").alias("path"), text.alias("target")).filter(F.expr(" or ".join(f"startswith(target, '{p}')" for p in prefixes))))
        level = level.drop("_field")
    out = df.select(key, F.lit("").alias("path"), F.lit("").alias("target")).limit(0)
    for f in found:
        out = out.unionByName(f)
    return out


def missing_references(df: DataFrame, key: str, json: str, available: DataFrame, path: str = "path") -> DataFrame:
    """The references whose target is not among the available paths."""
    known = available.select(F.col(path).alias("target")).distinct()
    return references(df, key, json).join(known, "target", "left_anti").select(key, "path", "target")
