"""Keyed tables that are replaced in one step, and reads that go on where they stopped.

A version's rows are written to a folder of their own. It becomes the current one when a manifest of its number is renamed
into place: the only step that readers can see, and one that fails if another writer has taken the number. A job that dies
before that leaves the version before it as it was, and a folder that nobody reads. Paths are those of any Hadoop file system.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class Conflict(RuntimeError):
    """Another writer has committed this version."""


def _fs(spark: SparkSession, path: str):
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _names(spark: SparkSession, folder: str) -> list[str]:
    fs, p = _fs(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def _put(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file under another name, then rename it into place; never over one that is there."""
    fs, p = _fs(spark, path)
    held = spark._jvm.org.apache.hadoop.fs.Path(f"{p.getParent()}/.{p.getName()}.{uuid.uuid4().hex}")
    out = fs.create(held, True)
    try:
        out.write(text.encode())
        out.hsync()
    finally:
        out.close()
    if fs.exists(p) or not fs.rename(held, p):
        fs.delete(held, False)
        raise Conflict(path)


def _get(spark: SparkSession, path: str) -> dict:
    return json.loads("\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect()))


def current(spark: SparkSession, root: str, kind: str = "manifests") -> dict | None:
    """The manifest of the current version; null before the first."""
    names = [n for n in _names(spark, f"{root}/{kind}") if not n.startswith(".")]
    return _get(spark, f"{root}/{kind}/{names[-1]}") if names else None


def stage(df: DataFrame, root: str, keys: list[str]) -> str:
    """Write a version's rows, sorted by key over all files; nobody reads them yet. Rows that share a key, or have none, are refused."""
    spark, path = df.sparkSession, f"{root}/data/{uuid.uuid4().hex}"
    df.orderBy(*keys).write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    bad = written.groupBy(*keys).count().filter(F.expr("count > 1 or " + " or ".join(f"`{k}` is null" for k in keys))).head(1)
    if bad:
        raise ValueError(f"duplicate or missing key {bad[0].asDict()}")
    return path


def publish(spark: SparkSession, root: str, path: str, keys: list[str], schema: str, version: int) -> dict:
    """Make staged rows the version of this number. The manifest holds a line a file: its name and its rows, in key order."""
    counts = spark.read.parquet(path).groupBy(F.col("_metadata.file_name").alias("f")).agg(F.count("*").alias("n")).collect() if _names(spark, path) else []
    manifest = {"version": version, "path": path, "keys": keys, "schema": schema, "files": sorted([r["f"], r["n"]] for r in counts)}
    _put(spark, f"{root}/manifests/{version:012d}.json", json.dumps(manifest))
    return manifest


def commit(df: DataFrame, root: str, keys: list[str]) -> dict:
    """Replace the table at root by df."""
    spark = df.sparkSession
    before = current(spark, root)
    return publish(spark, root, stage(df, root, keys), keys, df._jdf.schema().toDDL(), before["version"] + 1 if before else 1)


def read(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """The current version, or one of a number."""
    m = current(spark, root) if version is None else _get(spark, f"{root}/manifests/{version:012d}.json")
    if m is None:
        raise ValueError(f"nothing is committed at {root}")
    return spark.read.schema(m["schema"]).parquet(m["path"])


@dataclass(frozen=True)
class Cursor:
    """Where a read stopped: of a version, the next place in an epoch's order."""

    version: int
    epoch: int = 0
    place: int = 0


def take(spark: SparkSession, root: str, cursor: Cursor, n: int, seed: int = 0) -> tuple[DataFrame, Cursor]:
    """(the next n rows with `epoch` and `place`, the cursor behind them).

    An epoch's order is one of the files, drawn from a hash of seed and epoch; within a file rows stand by key. Only the files
    that hold wanted places are read. Each epoch has every row once; n may reach into the next epochs. The cursor names a
    version, so a table that is replaced meanwhile changes nothing for a read that has begun.
    """
    m = _get(spark, f"{root}/manifests/{cursor.version:012d}.json")
    total = sum(k for _, k in m["files"])
    out, epoch, place, left = None, cursor.epoch, cursor.place, n if total else 0
    source = spark.read.schema(m["schema"])
    while left:
        order = sorted(m["files"], key=lambda f: hashlib.sha256(f"{seed}|{epoch}|{m['files'].index(f)}".encode()).digest())
        end, at, wanted = min(place + left, total), 0, []
        for name, k in order:
            if at < end and at + k > place:
                wanted.append((name, at, max(place - at, 0), min(end - at, k)))
            at += k
        for name, offset, first, last in wanted:
            rows = source.parquet(f"{m['path']}/{name}")
            index = F.col("_metadata.row_index")
            part = rows.select("*", F.lit(epoch).alias("epoch"), (index + offset).alias("place")).filter((index >= first) & (index < last))
            out = part if out is None else out.unionByName(part)
        left -= end - place
        place = end
        if place == total:
            epoch, place = epoch + 1, 0
    empty = spark.createDataFrame([], m["schema"]).select("*", F.lit(0).alias("epoch"), F.lit(0).cast("long").alias("place"))
    return (empty if out is None else out), Cursor(cursor.version, epoch, place)


def save(spark: SparkSession, root: str, cursor: Cursor, step: int) -> None:
    """Keep a cursor as that of a step; a step is saved once, whoever comes first."""
    _put(spark, f"{root}/cursors/{step:012d}.json", json.dumps(asdict(cursor)))


def resume(spark: SparkSession, root: str) -> Cursor:
    """The cursor of the last step that was saved; the beginning of the current version before the first."""
    saved = current(spark, root, "cursors")
    return Cursor(**saved) if saved else Cursor((current(spark, root) or {"version": 1})["version"])
