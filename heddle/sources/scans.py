"""Scans with explicit schemas: JSON lines, JSON objects, archives' documents, Parquet with row keys, digests, key sets."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def jsonl(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Strict JSON lines: the first bad line ends the read; blank lines are skipped."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def json_objects(spark: SparkSession, path: str, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects): lines that are objects of the schema, and the others with their text."""
    whole = T.StructType([*schema.fields, T.StructField("_corrupt", T.StringType())])
    lines = spark.read.text(path).filter(F.trim("value") != "")
    parsed = lines.withColumn("j", F.from_json("value", whole, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    bad = F.col("j._corrupt").isNotNull() | ~F.startswith(F.trim("value"), F.lit("{"))
    return parsed.filter(~bad).select("j.*").drop("_corrupt"), parsed.filter(bad).select(F.col("value").alias("line"), F.lit("not a JSON object of this schema").alias("error"))


def with_defaults(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def parquet_with_row_key(spark: SparkSession, path: str) -> DataFrame:
    """All columns and `row_key`, the file's name and the row's number in it."""
    return spark.read.parquet(path).withColumn("row_key", F.concat_ws(":", "_metadata.file_name", F.col("_metadata.row_index").cast("string")))


def json_documents(spark: SparkSession, root: str) -> DataFrame:
    """(path, text, parsed) of every .json file below a folder; `parsed` is null for bad JSON."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(root)
    return files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"), F.try_parse_json("value").alias("parsed"))


def keyed_documents(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of a file that holds one JSON map."""
    text = spark.read.option("wholetext", True).text(path)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias("key", "value"))


def file_digests(spark: SparkSession, path: str) -> DataFrame:
    """(path, bytes, sha256) of files, hashed where they are read."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def selected(df: DataFrame, ids: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows whose key is asked for, asked keys that have no row)."""
    return df.join(ids.select(key).distinct(), key, "left_semi"), ids.select(key).distinct().join(df, key, "left_anti")


class VersionedMapping(DataSource):
    """A keyed mapping with a version per key, as a Spark data source: options `entries` (JSON object) and `version`."""

    @classmethod
    def name(cls) -> str:
        return "heddle_mapping"

    def schema(self) -> str:
        return "key string, value string, version string"

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _MappingReader(self.options)


class _MappingReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        import json

        self.entries = sorted(json.loads(options.get("entries", "{}")).items())
        self.version = options.get("version", "static")

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(i) for i in range(min(4, max(1, len(self.entries))))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        n = min(4, max(1, len(self.entries)))
        for k, v in self.entries[partition.value :: n]:
            yield k, str(v), f"{self.version}:{k}"
