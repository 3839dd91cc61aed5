"""Nearest neighbours by cosine, over an inverted file: centroids, lists, multi-probe search and an exact re-rank.

The centroids are fitted on at most `SAMPLE` rows (those with the least hashes of their keys), every row is indexed. A list
keeps the greatest angle between its centroid and its members, so a search can also be exact: no member of a list is nearer
to a query than the angle to the centroid less that radius, and lists that can't hold anything better are not looked at.

Scale: centroids (at most `MOST_LISTS`) are broadcast, rows and radii are not. A list is compared in blocks of `BLOCK` rows
and `BLOCK` queries, each pair of blocks one matrix product in one task, so a list may hold a third of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.sources.shared import materialize

SAMPLE, MOST_LISTS, BLOCK = 20_000, 4096, 1 << 13


def _units(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Which rows have a direction, and the unit vectors of those."""
    rows = column.to_pylist()
    wide = max((len(r) for r in rows if r), default=1)
    x = np.array([r if r and len(r) == wide and None not in r else [0.0] * wide for r in rows], np.float64).reshape(len(rows), wide)
    norm = np.sqrt((x * x).sum(axis=1))
    ok = np.isfinite(norm) & (norm > 0)
    return ok, x[ok] / norm[ok, None]


def fit(df: DataFrame, key: str, vector: str, lists: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids, by Lloyd's rounds on the sample; as many as the square root of the rows, or `lists`."""
    total = df.count()
    lists = min(lists or max(1, round(math.sqrt(total))), MOST_LISTS)
    rows = df.select(vector).orderBy(F.xxhash64(key), key).limit(sample).toArrow()
    _, x = _units(rows.column(0).combine_chunks())
    if not len(x):
        return np.ones((1, 1))
    centre = x[np.linspace(0, len(x) - 1, min(lists, len(x))).astype(int)]
    for _ in range(rounds):
        own = (x @ centre.T).argmax(axis=1)
        total_ = np.zeros_like(centre)
        np.add.at(total_, own, x)
        norm = np.sqrt((total_ * total_).sum(axis=1))
        centre = np.where(norm[:, None] > 0, total_ / np.where(norm > 0, norm, 1)[:, None], centre)
    return centre


def build(df: DataFrame, key: str, vector: str, centroids: np.ndarray, group: str | None = None) -> DataFrame:
    """(group, list, key, unit, angle) of every row that has a direction: its nearest centroid and the angle to it."""
    shared = df.sparkSession.sparkContext.broadcast(centroids)
    schema = f"_key {dict(df.dtypes)[key]}, _group string, _list int, _unit array<double>, _angle double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok, x = _units(batch.column("_v"))
            if len(x):
                near = x @ shared.value.T
                own = near.argmax(axis=1)
                angle = np.arccos(np.clip(near[np.arange(len(x)), own], -1, 1))
                keep = pa.array(ok)
                yield pa.RecordBatch.from_arrays([batch.column("_key").filter(keep), batch.column("_group").filter(keep), pa.array(own, pa.int32()), pa.array(list(x), pa.list_(pa.float64())), pa.array(angle)], ["_key", "_group", "_list", "_unit", "_angle"])

    by = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    return materialize(df.select(F.col(key).alias("_key"), by.alias("_group"), F.col(vector).alias("_v")).mapInArrow(run, schema), "index")


def _ask(queries: DataFrame, centroids: np.ndarray) -> DataFrame:
    """queries (_key, _group, _unit) with the angle to every centroid."""
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array(batch.column("_unit").to_pylist(), np.float64)
            if len(x):
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("_key", "_group", "_unit")), pa.array(list(np.arccos(np.clip(x @ shared.value.T, -1, 1))), pa.list_(pa.float64()))], ["_key", "_group", "_unit", "_angles"])

    kind = dict(queries.dtypes)["_key"]
    return queries.select("_key", "_group", "_unit").mapInArrow(run, f"_key {kind}, _group string, _unit array<double>, _angles array<double>")


def _compare(asked: DataFrame, index: DataFrame, k: int, block: int) -> DataFrame:
    """(_key, _match, _similarity): the k best rows of each pair of blocks for each of its queries; asked has (_key, _group, _list, _unit)."""
    where = ["_group", "_list"]
    rows, wants = index.groupBy(*where).agg(F.count("*").alias("_n")), asked.groupBy(*where).agg(F.count("*").alias("_m"))
    cuts = rows.join(wants, where).select(*where, F.ceil(F.col("_n") / block).cast("int").alias("_rows"), F.ceil(F.col("_m") / block).cast("int").alias("_wants"))
    part = lambda c: F.pmod(F.xxhash64("_key"), F.col(c)).cast("int")
    spread = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    left = index.join(cuts, where).select(*where, part("_rows").alias("_r"), spread("_wants").alias("_w"), "_key", "_unit")
    right = asked.join(cuts, where).select(*where, spread("_rows").alias("_r"), part("_wants").alias("_w"), "_key", "_unit")
    kind = dict(index.dtypes)["_key"]

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if not len(a) or not len(b):
            return pd.DataFrame({"_key": [], "_match": [], "_similarity": []})
        a = a.sort_values("_key", kind="stable")
        name, x, out = a["_key"].to_numpy(), np.stack(a["_unit"].to_numpy()), []
        for at in range(0, len(b), 512):
            asks = b.iloc[at : at + 512]
            near = np.stack(asks["_unit"].to_numpy()) @ x.T
            near[asks["_key"].to_numpy()[:, None] == name[None, :]] = -2.0  # itself
            for q, row in zip(asks["_key"], near, strict=True):
                top = np.argpartition(-row, min(k, len(row) - 1))[: k + 1] if len(row) > k else np.arange(len(row))
                top = np.flatnonzero(row >= row[top].min()) if len(row) > k else top  # ties go to the smallest key
                top = top[np.lexsort((top, -row[top]))][:k]
                out += [(q, name[i], row[i]) for i in top.tolist() if row[i] > -2.0]
        return pd.DataFrame(out, columns=["_key", "_match", "_similarity"])

    by = [*where, "_r", "_w"]
    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(best, f"_key {kind}, _match {kind}, _similarity double")


def _top(found: DataFrame, k: int) -> DataFrame:
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("_similarity")).alias("d"), F.col("_match").alias("m")))), 1, k)
    return found.groupBy("_key").agg(best.alias("_best"))


def search(index: DataFrame, queries: DataFrame, centroids: np.ndarray, k: int = 1, probes: int = 8, exact: bool = False, threshold: float = -1.0, block: int = BLOCK) -> DataFrame:
    """(key, rank, match, similarity): the k nearest rows of the query's group, itself left out, ties to the smallest key, none below the threshold.

    queries are rows of `build`. The `probes` lists with the nearest centroids are compared; `exact` then compares every other
    list that might hold something at least as near as the k-th found so far. A query without any row of its group has no result.
    """
    asks = materialize(_ask(queries, centroids), "asked")
    lists = F.transform("_angles", lambda a, i: F.struct(a.alias("a"), i.alias("i")))
    order = asks.select("_key", "_group", "_unit", F.explode(F.slice(F.array_sort(lists), 1, probes)).alias("_x")).select("_key", "_group", "_unit", F.col("_x.i").alias("_list"))
    first = _top(_compare(order, index, k, block), k)
    if exact:
        first = materialize(first, "probed")
        radius = index.groupBy("_group", "_list").agg(F.max("_angle").alias("_radius"))
        worst = F.when(F.col("_best").isNull() | (F.size("_best") < k), F.lit(math.pi)).otherwise(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -F.element_at("_best", -1)["d"]))))
        reach = asks.join(first, "_key", "left").withColumn("_worst", F.coalesce(worst, F.lit(math.pi)))
        rest = reach.select("_key", "_group", "_unit", "_worst", F.explode(F.slice(F.array_sort(lists), probes + 1, len(centroids))).alias("_x")) if len(centroids) > probes else None
        if rest is not None:
            rest = rest.select("_key", "_group", "_unit", "_worst", F.col("_x.a").alias("_a"), F.col("_x.i").alias("_list")).join(radius, ["_group", "_list"]).filter(F.col("_a") - F.col("_radius") <= F.col("_worst") + 1e-9)
            more = _compare(rest.select("_key", "_group", "_list", "_unit"), index, k, block)
            known = first.select("_key", F.explode("_best").alias("b")).select("_key", F.col("b.m").alias("_match"), (-F.col("b.d")).alias("_similarity"))
            first = _top(known.unionByName(more), k)
    out = first.select("_key", F.posexplode("_best").alias("rank", "b")).select(F.col("_key").alias("key"), (F.col("rank") + 1).alias("rank"), F.col("b.m").alias("match"), (-F.col("b.d")).alias("similarity"))
    return out.filter(F.col("similarity") >= threshold)


def tune(index: DataFrame, centroids: np.ndarray, k: int = 10, recall: float = 0.95, sample: int = 256) -> int:
    """How many lists to probe so that the share `recall` of the true k nearest is found, as measured on `sample` rows (those with the least hashes)."""
    asks = materialize(index.orderBy(F.xxhash64("_key", F.lit("tune")), "_key").limit(sample), "tuning")
    true = search(index, asks, centroids, k, exact=True).select(F.col("key").alias("_key"), "match")
    nearest = F.transform(F.array_sort(F.transform("_angles", lambda a, i: F.struct(a.alias("a"), i.alias("i")))), lambda x: x["i"])
    held = index.select(F.col("_key").alias("match"), F.col("_list").alias("_held"))
    place = true.join(held, "match").join(_ask(asks, centroids).select("_key", nearest.alias("_order")), "_key").select(F.array_position("_order", F.col("_held")).alias("p"))
    at = sorted(r["p"] for r in place.collect())  # sample * k numbers at most
    return int(at[min(len(at) - 1, math.ceil(recall * len(at)))]) if at else 1
