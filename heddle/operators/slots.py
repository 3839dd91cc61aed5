"""Slot allocation, candidate programs and unordered matching: the few group-wise steps that need Python."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def allocate_slots(cells: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, frame_pos, cell_id, slot): each cell keeps its slot while it lives; a slot is free again after the frame in which its cell retires.

    cells(key, frame_pos, cell_id, retired). Free slots are taken in a hash order of the key, so runs agree. A task walks its
    keys' cells in order, holding the live cells of one key, which the capacity bounds; more live cells than slots is an error.
    """
    kind = cells.schema[key].dataType.simpleString()

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, frame, free, held, gone = None, None, [], {}, []
        for batch in batches:
            keys, order = batch.column(0).to_pylist(), {}
            names = list(dict.fromkeys(map(str, keys)))
            if names:
                hashes = pd.util.hash_array(np.array([f"{k}|{i}" for k in names for i in range(capacity)], dtype=object)).reshape(len(names), capacity)
                order = dict(zip(names, hashes.argsort(axis=1, kind="stable").tolist(), strict=True))
            slot = []
            for k, pos, cell, retired in zip(map(str, keys), *(batch.column(i).to_pylist() for i in (1, 2, 3)), strict=True):
                if k != name:
                    name, frame, free, held, gone = k, pos, list(order[k]), {}, []
                elif pos != frame:
                    free += [held.pop(c) for c in gone]
                    frame, gone = pos, []
                if cell not in held:
                    if not free:
                        raise ValueError(f"{name}: more than {capacity} live cells")
                    held[cell] = free.pop(0)
                slot.append(held[cell])
                if retired:
                    gone.append(cell)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(slot, pa.int32())], [key, "frame_pos", "cell_id", "slot"])

    rows = cells.select(key, F.col("frame_pos").cast("int").alias("frame_pos"), F.col("cell_id").cast("string").alias("cell_id"), "retired")
    return rows.repartition(key).sortWithinPartitions(key, "frame_pos", "cell_id").mapInArrow(walk, f"{key} {kind}, frame_pos int, cell_id string, slot int")


SAFE_IMPORTS = frozenset(("math", "itertools", "functools", "collections", "re", "string", "heapq", "bisect", "fractions", "decimal"))
UNSAFE_NAMES = frozenset(("eval", "exec", "compile", "open", "input", "__import__", "globals", "locals", "vars", "getattr", "setattr", "delattr", "breakpoint"))


def unsafe_reason(code: str | None) -> str | None:
    """Why a candidate program may not run: bad syntax, an import or a name that isn't allowed, a dunder attribute; null if it may."""
    if code is None:
        return "no code"
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return "syntax"
    for node in ast.walk(tree):
        if isinstance(node, ast.Import) and any(a.name.split(".")[0] not in SAFE_IMPORTS for a in node.names):
            return "import"
        if isinstance(node, ast.ImportFrom) and (node.level or (node.module or "").split(".")[0] not in SAFE_IMPORTS):
            return "import"
        if isinstance(node, ast.Name) and node.id in UNSAFE_NAMES:
            return f"name {node.id}"
        if isinstance(node, ast.Attribute) and node.attr.startswith("__"):
            return f"attribute {node.attr}"
    return None


def screen_programs(df: DataFrame, key: str, code: str) -> DataFrame:
    """(key, reason) for every row; programs are read, never run."""
    kind = df.schema[key].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            yield pd.DataFrame({key: pdf[key], "reason": pdf[code].map(unsafe_reason)})

    return df.select(key, code).mapInPandas(run, f"{key} {kind}, reason string")


def same_multiset(a: str, b: str) -> Column:
    """Do two arrays hold the same values equally often: an unordered bijection of equal parts."""
    return F.array_sort(a) == F.array_sort(b)
