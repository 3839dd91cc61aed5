"""Operator 7, suffix-array dedup of 400-byte strings.

Every byte covered by a 400-byte string that also starts elsewhere (in another document, or elsewhere in the same) is
removed; here the first occurrence goes too.

1. Whole texts that are equal collapse to one; if they have 400 bytes or more, all of them go whole.
2. Anchors (see anchors.py) find the strings that may recur, as stretches of text around repeated anchors. Equal
   stretches collapse.
3. The suffixes that begin at the anchors are range-partitioned by their leading 64 bytes; Spark samples the splitters.
   Since splitters are compared as whole keys, suffixes with one anchor are never cut apart, and no common prefix of
   64 bytes crosses a boundary: the comparison across boundaries is settled by the splitters.
4. Each bucket sorts its suffixes, and the reversed prefixes before the anchors, by multikey quicksort (eight bytes a
   level, all undecided groups of a level at once) and takes the common lengths of neighbours. For each offset o, a
   400-byte string that begins o bytes before its anchor has an equal if another stretch agrees on the o bytes before
   and the 400 - o bytes after: both are intervals of the two sorted orders. This is linear in the stretches of a
   bucket, without pairs.
5. The covered ranges go back to their texts.

Different stretches are compared by bytes; stretches that are equal as a whole, and windows with a hot anchor (see
anchors.py), by 128 bits of hash. Scale: texts are shuffled once; anchors are counted with map-side sums and there is
one for some 170 bytes; a bucket holds at most the different stretches around anchors of at most `HOT` texts.

Defined cases: a null text is the empty text; shorter texts lose nothing; rows that repeat a text, even with the same
doc_id, are copies; null ids are ids like any other; texts of any length are read whole; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.anchors import HOT, by_row, distinct_texts, keyed, mix, repeated_anchors, segments, unpacked, whole_groups, with_ranges
from heddle.llm.common import as_bytes, read_table

WINDOW = 400
GRAM = 64
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def byte_units(text: bytes) -> np.ndarray:
    return _BYTE[np.frombuffer(text, np.uint8)]


def cut_bytes(text: bytes) -> Callable[[np.ndarray, np.ndarray], list[bytes]]:
    return lambda first, end: [text[a:b] for a, b in zip(first.tolist(), end.tolist(), strict=True)]


def padded(parts: list[bytes], width: int) -> np.ndarray:
    """The first `width` bytes of each string as a row, zeros after its end."""
    return np.frombuffer(b"".join(p[:width].ljust(width, b"\0") for p in parts), np.uint8).reshape(len(parts), width)


def multikey_quicksort(rows: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Order of byte rows within their groups (groups in ascending order), equal rows in the order given.

    Every undecided group takes the word (eight bytes) of its middle row at the group's level as a pivot and splits in
    three by it; rows that are equal to the pivot go on with the next word, the others stay at their level. All groups
    are split at once; one of a single row, or of rows with no word left, is decided.
    """
    words = np.ascontiguousarray(rows[:, : rows.shape[1] // 8 * 8]).view(">u8").astype(np.uint64)
    order = np.argsort(group, kind="stable")
    start = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]])) if len(order) else np.zeros(0, np.int64)
    size = np.diff(np.concatenate([start, [len(order)]]))
    level = np.zeros(len(start), np.int64)
    while True:
        left = (size > 1) & (level < words.shape[1])
        start, size, level = start[left], size[left], level[left]
        if not len(start):
            return order
        of = np.repeat(np.arange(len(start)), size)
        at = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size) + start[of]
        own = order[at]
        word, pivot = words[own, level[of]], words[order[start + size // 2], level]
        side = 3 * of + 1 + (word > pivot[of]) - (word < pivot[of]).astype(np.int64)
        order[at] = own[np.argsort(side, kind="stable")]
        size = np.bincount(side, minlength=3 * len(start))
        start = np.repeat(start, 3) + (np.cumsum(size.reshape(-1, 3), axis=1) - size.reshape(-1, 3)).reshape(-1)
        level = np.repeat(level, 3) + np.tile([0, 1, 0], len(level))


def common_lengths(rows: np.ndarray, order: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Bytes that each row in the order has in common with its predecessor; -1 where a group begins."""
    out = np.full(len(order), -1)
    step = max(1, (4 << 20) // rows.shape[1])
    for s in range(1, len(order), step):
        a, b = order[s : s + step], order[s - 1 : min(len(order), s + step) - 1]
        differ = rows[a] != rows[b]
        out[s : s + step] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    g = group[order]
    out[1:][g[1:] != g[:-1]] = -1
    return out


def recurring_ranges(stretches: list[bytes], shift: np.ndarray, group: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Of each of the different stretches the range that its recurring windows cover, as (low, high), equal if there are none.

    `shift` is where the anchor begins, the same anchor within a group."""
    n = len(stretches)
    right = padded([s[a:] for s, a in zip(stretches, shift.tolist(), strict=True)], window)
    left = padded([s[:a][::-1] for s, a in zip(stretches, shift.tolist(), strict=True)], (window - GRAM + 7) // 8 * 8)
    after = np.array([len(s) for s in stretches]) - shift
    low, high = np.full(n, window * 2), np.full(n, -1)
    orders = []
    for rows in (right, left):
        order = multikey_quicksort(rows, group)
        orders.append((order, common_lengths(rows, order, group)))
    for o in range(window - GRAM + 1):
        inside = np.flatnonzero((shift >= o) & (after >= window - o))
        if len(inside) < 2:
            continue
        key = np.zeros(n, np.int64)
        for (order, common), length in zip(orders, (window - o, o), strict=True):
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(common < length)
            key = key * (n + 1) + rank
        by = inside[np.argsort(key[inside], kind="stable")]
        same = key[by][1:] == key[by][:-1]
        found = by[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
        low[found] = np.minimum(low[found], shift[found] - o)
        high[found] = np.maximum(high[found], shift[found] - o + window)
    return np.where(high < 0, 0, low), np.maximum(high, 0)


def covered(found: DataFrame) -> DataFrame:
    """(key, id, first, last): bytes [first, last) of the texts that recurring windows cover."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    times = F.when(F.col("again").isNull(), 1).otherwise(2)
    distinct = found.groupBy("anchor", "stretch", "shift", "units").agg(F.sum(times).alias("copies"), F.first("text").alias("text"))
    lead = F.when(F.col("text") == F.lit(b""), F.unhex(F.hex("anchor"))).otherwise(F.substring("text", F.col("shift") + 1, F.lit(GRAM)))  # windows of hot anchors go anywhere
    dealt = distinct.withColumn("lead", lead).repartitionByRange(n, "lead").sortWithinPartitions("lead", "anchor").drop("lead")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            text = as_bytes(batch.column("text"))
            anchor, shift, copies = (np.asarray(batch.column(c)) for c in ("anchor", "shift", "copies"))
            many = np.unique(anchor, return_inverse=True, return_counts=True)
            use = np.flatnonzero((many[2][many[1]] > 1) & np.array([len(t) > 0 for t in text]))
            low, high = np.zeros(len(text), np.int64), np.zeros(len(text), np.int64)
            if len(use):
                low[use], high[use] = recurring_ranges([text[i] for i in use.tolist()], shift[use].astype(np.int64), many[1][use])
            whole = copies > 1
            low[whole], high[whole] = 0, np.asarray(batch.column("units"))[whole]
            got = np.flatnonzero(high > low)
            own = batch.select(["anchor", "stretch"]).take(pa.array(got))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(low[got].astype(np.int32)), pa.array(high[got].astype(np.int32))], ["anchor", "stretch", "low", "high"])

    ranges = dealt.mapInArrow(run, "anchor long, stretch long, low int, high int")
    here = F.array(F.struct((F.col("start") + F.col("low")).alias("first"), (F.col("start") + F.col("high")).alias("last")))
    both = found.select("anchor", "stretch", "key", "id", "start", "again").join(ranges, ["anchor", "stretch"])
    return both.select("key", "id", F.explode(F.concat(here, F.coalesce("again", F.array().cast("array<struct<first: int, last: int>>")))).alias("r")).select("key", "id", "r.first", "r.last")


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, ranges) for every row; `ranges` are the maximal removed runs of bytes."""
    rows = keyed(docs)
    base, firsts = distinct_texts(rows)
    hits = repeated_anchors(base, byte_units, WINDOW, GRAM, hot)
    ranges = covered(segments(base, hits, byte_units, cut_bytes, WINDOW, GRAM))
    spans = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            n, removed, digest, runs = [], [], [], []
            for t, got in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                gone: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"]) for x in got or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                at, kept = 0, hashlib.sha256()
                for a, b in gone:
                    kept.update(t[at:a])
                    at = b
                kept.update(t[at:])
                n.append(len(t))
                removed.append(sum(b - a for a, b in gone))
                digest.append(kept.hexdigest())
                runs.append([{"first": a, "last": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(runs, spans)], ["key", "n_bytes", "n_removed", "kept_sha256", "ranges"])

    of_text = with_ranges(base, ranges).mapInArrow(run, "key long, n_bytes long, n_removed long, kept_sha256 string, ranges array<struct<first: int, last: int>>")
    # a copy is no first row: it has no line in of_text, and its text occurs elsewhere
    own = by_row(rows.withColumn("n", F.octet_length("text").cast("long")).withColumn("digest", F.sha2("text", 256)).drop("text"), firsts, of_text.drop("n_bytes"))
    copied = F.coalesce("copies", F.lit(2)) > 1
    gone, same = copied & (F.col("n") >= WINDOW), copied & (F.col("n") < WINDOW)
    pick = lambda whole, none, other: F.when(gone, whole).when(same, none).otherwise(other)
    none = F.array().cast("array<struct<first: int, last: int>>")
    all_of_it = F.array(F.struct(F.lit(0).alias("first"), F.col("n").cast("int").alias("last")))
    out = own.select("doc_id", F.col("n").alias("n_bytes"), pick(F.col("n"), F.lit(0).cast("long"), F.col("n_removed")).alias("n_removed"), pick(F.sha2(F.lit(""), 256), F.col("digest"), F.col("kept_sha256")).alias("kept_sha256"), pick(all_of_it, none, F.col("ranges")).alias("ranges"))
    return out.withColumn("n_spans", F.size("ranges").cast("long"))


def op7_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
