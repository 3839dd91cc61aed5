"""Candidates for repeated windows: what operators 4 and 7 share.

A window is a fixed number of consecutive units (words or bytes) of one text. In every window the k-gram with the
least hash (the leftmost of equal ones) is the window's anchor. The choice depends on the window's content alone, so
equal windows have equal anchors at equal places; a window whose anchor occurs once in the corpus has no equal, and
only windows with a repeated anchor need a closer look. Consecutive windows share anchors: there is one anchor for
some half a window of text, so what is counted and shuffled is a small part of the input.

An anchor that more than `HOT` texts have (a passage that very many share) would bring as many stretches to one task as
texts have it with different surroundings. Its windows are therefore grouped one by one, each by 128 bits of its own
hash: equal windows still meet, and are summed in tasks before they do; no group grows with the passage's fame.

Texts that are equal as a whole are collapsed first (`distinct_texts`): thousands of copies count as one. So are equal
stretches of one text, as it is read, block by block: a text that repeats a short unit for megabytes is a few stretches.

The steps are one lazy plan, so Spark shuffles the texts once, by key, and reads that exchange again for each later
step. Texts travel compressed one by one: only Python reads them, and a row's text compresses better than a shuffle block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import as_bytes, chunks

#: Low bits of a hash that hold a place while minima are taken; a block of text has fewer units.
_PLACE = np.uint64((1 << 24) - 1)
BLOCK_UNITS = 1 << 20
HOT = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def gram_hashes(unit: np.ndarray, size: int) -> np.ndarray:
    """Hash of every `size` consecutive units (`size` a power of two) by doubling."""
    h, n = unit, 1
    with np.errstate(over="ignore"):
        while n < size:
            h = h[:-n] * np.uint64(0x9E3779B97F4A7C15 + 2 * n) + h[n:]
            n *= 2
    return mix(h)


def window_hashes(unit: np.ndarray, window: int, seed: int) -> np.ndarray:
    """Hash of every window of `window` consecutive units, from the hashes of its power-of-two parts."""
    n = len(unit) - window + 1
    out, at = np.full(n, seed, np.uint64), 0
    with np.errstate(over="ignore"):
        for bit in reversed(range(window.bit_length())):
            if window >> bit & 1:
                out = mix(out * np.uint64(0x9E3779B97F4A7C15) + gram_hashes(unit[at : at + n + (1 << bit) - 1], 1 << bit) + np.uint64(seed))
                at += 1 << bit
    return out


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every `width` consecutive values."""
    n = 1
    while 2 * n <= width:
        x = np.minimum(x[:-n], x[n:])
        n *= 2
    return np.minimum(x[: len(x) - (width - n)], x[width - n :]) if n < width else x


Runs = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def run_blocks(unit: np.ndarray, window: int, gram: int) -> Iterator[Runs]:
    """(anchor hash, anchor place, first window, last window) of each run of windows of one text with the same anchor, block by block.

    A long text is cut into blocks that overlap by a window; a run may then be split, which changes nothing for its windows.
    """
    for at in range(0, max(1, len(unit) - window + 1), BLOCK_UNITS):
        block = unit[at : at + BLOCK_UNITS + window - 1]
        if len(block) < window:
            continue
        grams = gram_hashes(block, gram)
        least = sliding_min(grams & ~_PLACE | np.arange(len(grams), dtype=np.uint64), window - gram + 1) & _PLACE
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        last = np.concatenate([first[1:], [len(least)]]) - 1
        place = least[first].astype(np.int64)
        yield grams[place].view(np.int64), place + at, first + at, last + at


def window_runs(unit: np.ndarray, window: int, gram: int) -> Runs:
    """All blocks' runs."""
    parts = list(run_blocks(unit, window, gram))
    if not parts:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def merged(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of ranges [first, last), as ranges in order; those that touch become one."""
    if not len(first):
        return first, last
    order = np.argsort(first, kind="stable")
    first, reach = first[order], np.maximum.accumulate(last[order])
    fresh = np.concatenate([[True], first[1:] > reach[:-1]])
    return first[fresh], reach[np.concatenate([fresh[1:], [True]])]


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, its place in the order of documents (null last), the text (null: empty) and the text's two hashes."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(7), "text")})


def distinct_texts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, id, packed): a row for each different text, that of the smallest id, its text compressed; and (key, copies) of those.

    `key` hashes id, t1 and t2: copies of a text have different keys, unless they have one id. Rows that are joined by key
    carry the id too where a stranger's row would matter.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("key", "id")), pa.array([squeeze(t) for t in as_bytes(batch.column("text"))], pa.binary())], ["key", "id", "packed"])

    firsts = rows.groupBy("t1", "t2").agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
    firsts = firsts.select(F.xxhash64("first_id", "t1", "t2").alias("key"), "copies")
    all_rows = rows.select(F.xxhash64("id", "t1", "t2").alias("key"), "id", "text").mapInArrow(pack, "key long, id long, packed binary")
    return all_rows.join(firsts.select("key").hint("merge"), "key", "left_semi"), firsts


def unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of batches with their texts."""
    for batch in chunks(batches, "packed", 1 << 20):
        expand = zstandard.ZstdDecompressor().decompress
        yield batch, [expand(x) for x in batch.column("packed").to_pylist()]


Units = Callable[[bytes], np.ndarray]
#: Of a text, a function that gives the stretches of units [first, end).
Cutter = Callable[[bytes], Callable[[np.ndarray, np.ndarray], list[bytes]]]


def repeated_anchors(base: DataFrame, units: Units, window: int, gram: int, hot: int = HOT) -> DataFrame:
    """(key, anchors, hot): of each text the anchors that occur twice or more in the corpus, and which of them are hot."""

    def of(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hashes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for h, place, _, _ in run_blocks(unit, window, gram):
            h = h[np.concatenate([[True], place[1:] != place[:-1]])]
            hashes, at = np.unique(np.concatenate([hashes, h]), return_inverse=True)
            counts = np.bincount(at, np.concatenate([counts, np.ones(len(h), np.int64)])).astype(np.int64)
        return hashes, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            anchors, counts, at = [], [], []
            for i, t in enumerate(texts):
                h, n = of(units(t))
                anchors.append(h)
                counts.append(n.astype(np.int32))
                at.append(np.full(len(h), i))
            if at:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(anchors)), pa.array(np.concatenate(counts)), batch.column("key").take(pa.array(np.concatenate(at)))], ["anchor", "n", "key"])

    found = base.mapInArrow(run, "anchor long, n int, key long")  # all columns of base: one exchange serves every step
    often = found.groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1").select("anchor", (F.col("n") > hot).alias("hot"))
    own = found.select("anchor", "key").join(often, "anchor").groupBy("key")
    return own.agg(F.collect_list("anchor").alias("anchors"), F.collect_list(F.when(F.col("hot"), F.col("anchor"))).alias("hot"))


AGAIN = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))


class Stretches:
    """The stretches of one text. One that repeats an earlier stretch of the text is no row: what it covers goes to the earlier one's `again`."""

    def __init__(self, cut: Callable[[np.ndarray, np.ndarray], list[bytes]]) -> None:
        self.cut, self.place = cut, {}
        self.rows: list[tuple] = []
        self.repeats: dict[int, list[tuple[int, int]]] = {}

    def add(self, h: int, digest: int, start: int, shift: int, length: int, text: bytes) -> None:
        at = self.place.setdefault((h, digest, shift), len(self.rows))
        if at == len(self.rows):
            self.rows.append((h, digest, start, shift, length, text))
        else:
            self.repeats.setdefault(at, []).append((start, start + length))
            if len(self.repeats[at]) > 1 << 12:
                self.repeats[at] = self.union(at)

    def union(self, at: int) -> list[tuple[int, int]]:
        first, last = np.array(self.repeats[at]).T
        return list(zip(*(x.tolist() for x in merged(first, last)), strict=True))

    def stretches(self, h: np.ndarray, place: np.ndarray, first: np.ndarray, end: np.ndarray, step: int = 1 << 14) -> None:
        for s in range(0, len(h), step):
            f, e, shift = first[s : s + step], end[s : s + step], (place - first)[s : s + step].tolist()
            text = self.cut(f, e)
            for row in zip(h[s : s + step].tolist(), map(xxhash.xxh64_intdigest, text, shift), f.tolist(), shift, (e - f).tolist(), text, strict=True):
                self.add(*row)


def segments(base: DataFrame, hits: DataFrame, units: Units, cut: Cutter, window: int, gram: int) -> DataFrame:
    """Stretches of text that hold the windows with one repeated anchor.

    (anchor, stretch, key, id, start, shift, units, text, again): `start` is the first window's place, `shift` the anchor's
    within the text, `units` the length, `stretch` hashes the text, to be compared among those of one anchor; `again` are
    the ranges that later equal stretches of the same text cover. Every such window is in exactly one stretch of its text.
    A window with a hot anchor is a stretch of its own, with its own hash as `anchor` and an empty text: its group holds
    its equals only.
    """
    schema = "anchor long, stretch long, key long, id long, start int, shift int, units int, text binary, again array<struct<first: int, last: int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            rows, again, at = [], [], []
            for i, (t, hit, hot) in enumerate(zip(texts, batch.column("anchors"), batch.column("hot"), strict=True)):
                unit, wanted, famous = units(t), np.asarray(hit.values), np.asarray(hot.values)
                own = Stretches(cut(t))
                for h, place, first, last in run_blocks(unit, window, gram):
                    use = np.isin(h, wanted)
                    if len(famous) and (lone := use & np.isin(h, famous)).any():
                        use &= ~lone
                        low, high = int(first[lone][0]), int(last[lone][-1]) + 1
                        a, b = (window_hashes(unit[low : high + window - 1], window, seed).view(np.int64) for seed in (1, 2))
                        for f, e in zip(first[lone].tolist(), last[lone].tolist(), strict=True):
                            for k in range(f, e + 1):
                                own.add(int(a[k - low]), int(b[k - low]), k, 0, window, b"")
                    own.stretches(h[use], place[use], first[use], last[use] + window)
                rows += own.rows
                again += [[{"first": f, "last": e} for f, e in own.union(k)] if k in own.repeats else None for k in range(len(own.rows))]
                at.append(np.full(len(own.rows), i))
            if rows:
                anchor, digest, start, shift, length, text = zip(*rows, strict=True)
                of = batch.select(["key", "id"]).take(pa.array(np.concatenate(at)))
                digest = np.array([x & (1 << 64) - 1 for x in digest], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(anchor, pa.int64()), pa.array(digest), *of.columns, *(pa.array(x, pa.int32()) for x in (start, shift, length)), pa.array(text, pa.binary()), pa.array(again, AGAIN)], ["anchor", "stretch", "key", "id", "start", "shift", "units", "text", "again"])

    return base.join(hits.hint("merge"), "key").mapInArrow(run, schema)


def with_ranges(base: DataFrame, ranges: DataFrame) -> DataFrame:
    """base with `ranges`, its removed stretches from (key, id, first, last)."""
    by_key = ranges.groupBy("key").agg(F.collect_set(F.struct("id", "first", "last")).alias("ranges"))
    both = base.join(by_key.hint("merge"), "key", "left")
    own = F.filter("ranges", lambda r: r["id"] == F.col("id"))
    return both.select("key", "packed", F.transform(own, lambda r: F.struct(r["first"].alias("first"), r["last"].alias("last"))).alias("ranges"))


def by_row(rows: DataFrame, firsts: DataFrame, of_text: DataFrame) -> DataFrame:
    """rows with the columns of of_text (key, ...) and `copies`: those of a text's first row; null on its copies.

    Copies have keys of their own, so a text that very many share brings no rows together."""
    known = firsts.join(of_text.dropDuplicates(["key"]).hint("merge"), "key")
    return rows.withColumn("key", F.xxhash64("id", "t1", "t2")).join(known.hint("merge"), "key", "left")


def whole_groups(batches: Iterator[pa.RecordBatch], column: str = "anchor", least: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Batches that hold whole groups of equal values of a sorted column, each of at least `least` bytes of text where there are so many."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size < least:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        x = np.asarray(table.column(column).combine_chunks())
        cut = np.flatnonzero(x != x[-1])
        if len(cut):
            yield table.slice(0, cut[-1] + 1).combine_chunks().to_batches()[0]
            held = table.slice(cut[-1] + 1).combine_chunks().to_batches()
        else:
            held = table.to_batches()
        size = sum(b.nbytes for b in held)
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        if table.num_rows:
            yield table.to_batches()[0]
