"""Sinks. Spark's commit protocol publishes a folder's files together; a failed job leaves none of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with nulls kept, in partitions."""
    df.write.option("ignoreNullFields", False).json(path)


def sorted_keyed(df: DataFrame, path: str, keys: list[str]) -> None:
    """Range-sorted by key over all files."""
    df.orderBy(*keys).write.parquet(path)


def unsorted(spark: SparkSession, path: str, key: str) -> DataFrame:
    """(n, unsorted): the rows of a folder of Parquet files, and how many have a smaller `key`, a number, than the row before them in their file.

    Files are read in order, so each stretch of rows that follow one another gives a row, and only those are put side by side."""

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, file = batch.column(0), batch.column(1).dictionary_encode()
            code, at = np.asarray(file.indices), np.asarray(batch.column(2))
            first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (at[1:] != at[:-1] + 1)])
            last = np.r_[first[1:], len(at)] - 1
            less = np.asarray(pa.compute.less(keys[1:], keys[:-1]).fill_null(False), dtype=bool)  # null is not less
            less = np.r_[False, less]
            less[first] = False
            out = [file.dictionary.take(pa.array(code[first])), pa.array(at[first]), keys.take(pa.array(first)), keys.take(pa.array(last)), pa.array(last - first + 1), pa.array(np.add.reduceat(less.astype(np.int64), first))]
            yield pa.RecordBatch.from_arrays(out, ["file", "start", "a", "z", "n", "k"])

    x = spark.read.parquet(path).select(key, "_metadata.file_path", F.col("_metadata.row_index").alias("row_index"))
    kind = x.schema[key].dataType.simpleString()
    met = x.mapInArrow(stretches, f"file string, start long, a {kind}, z {kind}, n long, k long")
    before = F.lag("z").over(W.partitionBy("file").orderBy("start"))
    return met.withColumn("b", before).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.col("k") + F.coalesce(F.col("b") > F.col("a"), F.lit(False)).cast("long")), F.lit(0)).cast("int").alias("unsorted"))


def manifest(one_row: DataFrame, path: str) -> None:
    """A one-row table as one JSON document."""
    one_row.coalesce(1).write.json(path)


def partitioned(df: DataFrame, path: str, by: list[str]) -> None:
    """One folder a partition value; rows are dealt by it first, so that each is written by few tasks."""
    df.repartition(*by).write.partitionBy(*by).parquet(path)


def with_rejects(df: DataFrame, good: str, rejects: str, error: Column) -> None:
    """Rows without an error to `good`, the others with the error to `rejects`. An error that isn't null rejects."""
    marked = df.withColumn("error", error)
    marked.filter("error is null").drop("error").write.parquet(good)
    marked.filter("error is not null").write.json(rejects)
