"""Places of rows in a total order, counted without bringing a group to one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.sources.shared import materialize


def place_in_order(df: DataFrame, order: list[Column | str], by: list[str] | None = None, place: str = "_place", total: str | None = None) -> DataFrame:
    """df with `place`, each row's place (from 0) in the order, within its values of `by`; and `total`, the rows of those.

    Rows are dealt by ranges of (by, order) and written, since the ranges must stay as they are; each part is ranked
    alone, and what stands before a part comes from a table of one row a part and value of `by`. A hot value is many parts.
    """
    by = by or []
    names = [f"_order{i}" for i in range(len(order))]
    rows = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order, strict=True)})
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = materialize(rows.repartitionByRange(parts, *by, *names).withColumn("_part", F.spark_partition_id()), "places")
    sizes = dealt.groupBy(*by, "_part").agg(F.count("*").alias("_n"))
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(0))  # a row a part: `parts` rows for each value of `by` at most
    upto = F.sum("_n").over(own.orderBy("_part").rowsBetween(W.unboundedPreceding, W.currentRow))
    known = sizes.select(*(F.col(b).alias(f"_by{i}") for i, b in enumerate(by)), F.col("_part").alias("_p"), (upto - F.col("_n")).alias("_before"), F.sum("_n").over(own).alias("_all"))
    on = F.col("_part") == F.col("_p")
    for i, b in enumerate(by):
        on &= F.col(b).eqNullSafe(F.col(f"_by{i}"))
    out = dealt.withColumn("_own", F.row_number().over(W.partitionBy(*by, "_part").orderBy(*names)) - 1).join(known, on)
    added = [(F.col("_before") + F.col("_own")).alias(place)] + ([F.col("_all").alias(total)] if total else [])
    return out.select(*(F.col(c) for c in df.columns), *added)
