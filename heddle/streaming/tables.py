"""Streams into tables: incremental views with watermarks, first-wins keys, and idempotent keyed upserts."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from heddle.sources.shared import shared_dir


def read_stream(spark: SparkSession, path: str, schema, files: int = 1) -> DataFrame:
    """A stream of the Parquet files at a path: those of a folder, or one file."""
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files)
    folder, _, name = path.rpartition("/")
    found = spark.read.schema(schema).parquet(path).inputFiles()
    if len(found) == 1 and found[0].rpartition("/")[2] == name:
        return source.option("pathGlobFilter", name).parquet(folder)
    return source.parquet(path)


def run_to_table(df: DataFrame, tag: str, mode: str = "append", each: Callable[[DataFrame, int], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what there is and read back what it wrote.

    Append mode uses the file sink (exactly once). Other modes write each micro-batch to a folder of its own number,
    overwritten if the batch is repeated; the latest batch of a row wins in `latest()`.
    """
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/heddle/stream-{tag}-{uuid.uuid4().hex}"
    writer = df.writeStream.outputMode(mode).option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True)
    if mode == "append" and each is None:
        q = writer.format("parquet").option("path", f"{root}/out").start()
    else:
        def put(batch: DataFrame, number: int) -> None:
            out = each(batch, number) if each else batch
            out.write.mode("overwrite").parquet(f"{root}/out/batch={number}")

        q = writer.foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()
    plain = mode == "append" and each is None
    return spark.read.schema(df.schema if plain else T.StructType([*df.schema.fields, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/out")


def with_state_store(spark: SparkSession, run: Callable[[], DataFrame]) -> DataFrame:
    """Run a stream whose operators keep state of their own, which only RocksDB holds; the session's setting is put back."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return run()
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def latest(df: DataFrame, keys: list[str]) -> DataFrame:
    """The row of each key's latest batch."""
    rn = F.row_number().over(W.partitionBy(*keys).orderBy(F.col("batch").desc()))
    return df.withColumn("_rn", rn).filter("_rn = 1").drop("_rn", "batch")


def windowed_counts(events: DataFrame, time: str, width: str, late: str, by: str) -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), by).agg(F.count("*").alias("n"))


def upsert(old: DataFrame | None, new: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, payload, status): inserted, unchanged, kept, or conflict where a key comes with another payload (the old one stays)."""
    if old is None:
        return new.select(key, payload, F.lit("inserted").alias("status"))
    both = old.select(key, F.col(payload).alias("_old")).join(new.select(key, F.col(payload).alias("_new")), key, "full_outer")
    status = F.when(F.col("_new").isNull(), "kept").when(F.col("_old").isNull(), "inserted").when(F.col("_old").eqNullSafe(F.col("_new")), "unchanged").otherwise("conflict")
    return both.select(key, F.coalesce("_old", "_new").alias(payload), status.alias("status"))
