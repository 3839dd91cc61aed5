"""Operator 13, phrase collocations: phrases of each language whose words stand together more often than apart.

1. Every task counts the phrases of its chunks of text exactly and adds them to a count-min sketch; the sketches are merged
   slice by slice, in two steps, and become one bit a cell: whether `least` may be reached. A sketch overestimates only.
2. A second scan counts the phrases whose cells are all set, in chunks and then over all tasks: exactly, by the phrases
   themselves. Whatever has `least` occurrences is among them, and so are its parts.
3. The counts are joined to each candidate's cuts, the lowest-scoring cut counts (whole-number arithmetic, decimals of 38
   digits), phrases that are mostly part of a longer one go, and each language's best are ranked.

The sketch has `CELLS` cells a row at any size of the input: 64 MB of counters in a task, 8 MB of broadcast bits. From
some gigabytes of text in a language's phrases on it lets rare phrases pass; the second pass then counts more of them, and the
result stays the same. What a task sends of it is coded as a plane of bits and the counters that aren't zero.

Scale: what a task sends is distinct phrases, not occurrences; the joins are on phrases, whose hot ones (a famous word is
a part of very many) Spark's adaptive execution splits; the ranking keeps 2,000 a language in each task before it shuffles.

Defined cases: null and empty texts have no words; a null lang is `und`; rows that repeat an id or a text all count; a text
of any length is read whole, in segments that overlap by a phrase; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from heddle.llm.anchors import mix
from heddle.llm.common import as_bytes, chunks, materialize, read_table

LONGEST = 3
LEAST = 10
#: A phrase goes if a longer one has this share (in hundredths) of its occurrences.
SHARE = 50
TOP = 2000
CHUNK = 2 << 20
DEPTH = 2
CELLS = 1 << 25
SLICE = 1 << 16
#: Tasks whose sketches are merged at first, and rows of an Arrow batch.
MERGED, ROWS = 16, 1 << 15

# Classes of bytes: 0 in a word, 1 between words, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[list(b" \t")] = 1
_CLASS[list(b".,;:!?\n\v\f\r")] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_END = re.compile(rb"[\x09-\x0D .,;:!?]")


def segments(text: bytes, longest: int, limit: int = CHUNK) -> Iterator[tuple[bytes, int]]:
    """(segment, length of its own part): a long text in parts, each with the words after it that a phrase may reach."""
    more = re.compile(rb"(?:[ \t]+[^\x09-\x0D .,;:!?]+){0,%d}" % (longest - 1))
    at = 0
    while len(text) - at > limit and (end := _END.search(text, at + limit)):
        yield text[at : more.match(text, end.start()).end()], end.start() - at
        at = end.start()
    yield text[at:], len(text) - at


def runs(code: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first place, rank, count): of each distinct code the first place and the count, and each code's rank among them."""
    bits = max(len(code) - 1, 1).bit_length()
    if int(code.max(initial=0)).bit_length() + bits > 63:
        _, first, rank, count = np.unique(code, return_index=True, return_inverse=True, return_counts=True)
        return first, rank, count
    both = np.sort(code << bits | np.arange(len(code)))  # one plain sort is several times as fast as one of places
    place, code = both & ((1 << bits) - 1), both >> bits
    head = np.concatenate([[True], code[1:] != code[:-1]]) if len(code) else np.zeros(0, bool)
    rank = np.empty(len(code), np.int64)
    rank[place] = np.cumsum(head) - 1
    at = np.flatnonzero(head)
    return place[at], rank, np.diff(np.concatenate([at, [len(code)]]))


class Phrases:
    """Distinct phrases of a chunk with their counts: `groups` has (size, first word's place, count) of each."""

    def __init__(self, texts: list[tuple[bytes, int]], lang: list[int], longest: int) -> None:
        low = _LOWER[np.frombuffer(b"\n".join(t for t, _ in texts), np.uint8)]
        kind = _CLASS[low]
        between = kind > 0
        edge = np.diff(np.concatenate([[True], between, [True]]).astype(np.int8))
        start, end = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        base = np.concatenate([[0], np.cumsum([len(t) + 1 for t, _ in texts])])
        own = base[:-1] + [n for _, n in texts]
        text = np.searchsorted(base, start, "right") - 1
        piece = np.cumsum(kind == 2, dtype=np.int32)[start]
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), len(start), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(low[~between].tobytes())]).dictionary_encode()
        self.words, self.id = words.dictionary, np.asarray(words.indices).astype(np.int64)
        self.lang = np.asarray(lang, np.int64)[text]
        self.owned = start < own[text]
        self.groups: list[tuple[int, np.ndarray, np.ndarray]] = []
        many = max(len(self.words), 1)
        last = self.lang * many + self.id
        many *= int(self.lang.max(initial=0)) + 1
        code, place = last, np.arange(len(start))
        for size in range(1, longest + 1):
            if size > 1:
                reach = place + size - 1
                fits = reach < len(start)
                fits[fits] = piece[place[fits]] == piece[reach[fits]]
                place = place[fits]
                code = code[fits] * many + last[place + size - 1]
            first, code, count = runs(code)
            if not self.owned.all():  # a segment's overlap is counted by the next one
                count = np.bincount(code, self.owned[place], len(first)).astype(np.int64)
            self.groups.append((size, place[first], count))

    def hashes(self, size: int, place: np.ndarray, names: np.ndarray) -> np.ndarray:
        """Hash of each phrase with its language; `names` has the languages' hashes."""
        if not hasattr(self, "_unit"):
            self._unit = np.array([xxhash.xxh64_intdigest(w, 13) for w in self.words.to_pylist()], np.uint64)
        h = names[self.lang[place]]
        with np.errstate(over="ignore"):
            for k in range(size):
                h = mix(h * np.uint64(0x9E3779B97F4A7C15) + self._unit[self.id[place + k]])
        return h

    def texts(self, size: int, place: np.ndarray) -> pa.Array:
        parts = [self.words.take(pa.array(self.id[place + k])) for k in range(size)]
        return (pc.binary_join_element_wise(*parts, b" ") if size > 1 else parts[0]).cast(pa.string())


def read_phrases(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[tuple[Phrases, list[str], np.ndarray]]:
    for batch in chunks(batches, limit=CHUNK):
        lang = batch.column("lang").dictionary_encode()
        names = lang.dictionary.to_pylist()
        parts, single = [], []
        for t, code in zip(as_bytes(batch.column("text")), lang.indices.to_pylist(), strict=True):
            if len(t) > CHUNK:
                single += [([s], [code]) for s in segments(t, longest)]
            else:
                parts.append(((t, len(t)), code))
        if parts:
            single.insert(0, ([p[0] for p in parts], [p[1] for p in parts]))
        for texts, codes in single:
            yield Phrases(texts, codes, longest), names, np.array([xxhash.xxh64_intdigest(n, 17) for n in names], np.uint64)


def cells(h: np.ndarray, row: int, width: int) -> np.ndarray:
    return (mix(h ^ np.uint64(0xD6E8FEB86659FD93 * (row + 1) % 2**64)) & np.uint64(width - 1)).astype(np.int64)


def coded(x: np.ndarray) -> bytes:
    """Counters, compressed: a bit for each that isn't zero, then those."""
    return zstandard.compress(np.packbits(x > 0, bitorder="little").tobytes() + x[x > 0].tobytes(), 1)


def decoded(data: bytes, kind: np.dtype, size: int) -> np.ndarray:
    data = zstandard.decompress(data)
    out = np.zeros(size, kind)
    out[np.unpackbits(np.frombuffer(data, np.uint8, size // 8), bitorder="little").astype(bool)] = np.frombuffer(data, kind, offset=size // 8)
    return out


def added(row: np.ndarray, cell: np.ndarray, count: np.ndarray, least: int) -> None:
    """Add counts to a row of counters, which stop at `least`."""
    bits = least.bit_length()
    both = np.sort(cell << bits | np.minimum(count, least))
    cell = both >> bits
    at = np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])) if len(cell) else np.zeros(0, np.int64)
    if len(at):
        total = np.minimum(np.add.reduceat(both & ((1 << bits) - 1), at), least)
        row[cell[at]] = np.minimum(row[cell[at]] + total, least)


def sketch(docs: DataFrame, longest: int, least: int, width: int, depth: int = DEPTH) -> np.ndarray:
    """A bit for each cell of each row (packed): whether phrases of it occur `least` times or more together."""
    kind, cut = np.min_scalar_type(2 * least), min(SLICE, width)  # counters stop at `least`, so a sum of two never overflows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for found, _, names in read_phrases(batches, longest):
            table = np.zeros((depth, width), kind) if table is None else table
            for size, place, count in found.groups:
                h = found.hashes(size, place, names)
                for row in range(depth):
                    added(table[row], cells(h, row, width), count, least)
        if table is not None:
            part = TaskContext.get().partitionId() // MERGED
            for i, x in enumerate(table.reshape(-1, cut)):
                if x.any():
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([part], pa.int32()), pa.array([coded(x)], pa.binary())], ["slice", "part", "n"])

    def merged(found: pd.Series) -> np.ndarray:
        total = np.zeros(cut, kind)
        for x in found:
            total = np.minimum(total + decoded(x, kind, cut), least).astype(kind)
        return total

    def some(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(n=[coded(merged(pdf["n"]))])

    def final(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1)[["slice"]].assign(bits=[np.packbits(merged(pdf["n"]) >= least, bitorder="little").tobytes()])

    schema = "slice int, part int, n binary"
    parts = docs.mapInArrow(run, schema).groupBy("slice", "part").applyInPandas(some, schema)
    out = np.zeros((depth * width // cut, cut // 8), np.uint8)
    for r in parts.groupBy("slice").applyInPandas(final, "slice int, bits binary").toLocalIterator():
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.reshape(depth, -1)


def phrase_counts(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, width: int = CELLS) -> DataFrame:
    """(lang, phrase, f): every phrase of 1 to `longest` words with `least` occurrences or more; the empty phrase has the number of words.

    `width`: cells of a row of the sketch, a power of two of 8 or more.
    """
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text").filter("text is not null")
    often = docs.sparkSession.sparkContext.broadcast(sketch(rows.select("lang", "text"), longest, least, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for found, langs, names in read_phrases(batches, longest):
            known = pa.array(langs, pa.string())
            total = np.bincount(found.lang, found.owned, len(langs)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([known, pa.array([""] * len(langs), pa.string()), pa.array(total)], ["lang", "phrase", "n"])
            for size, place, count in found.groups:
                h, keep = found.hashes(size, place, names), count > 0
                for row, bits in enumerate(often.value):
                    at = cells(h, row, width)
                    keep &= (bits[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
                place, count = place[keep], count[keep]
                for at in range(0, len(place), ROWS):
                    some = place[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([known.take(pa.array(found.lang[some])), found.texts(size, some), pa.array(count[at : at + ROWS], pa.int64())], ["lang", "phrase", "n"])

    counted = rows.select("lang", "text").mapInArrow(run, "lang string, phrase string, n long")
    return counted.groupBy("lang", "phrase").agg(F.sum("n").alias("f")).filter((F.col("f") >= least) | (F.col("phrase") == ""))


def _part(words: str, first: str, size: str):
    return F.expr(f"array_join(slice({words}, {first}, {size}), ' ')")


def scored(counts: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, score): each phrase of two words or more by its lowest-scoring cut, the first of equal ones."""
    exact = lambda c: F.col(c).cast("decimal(38,0)")
    cuts = counts.filter("phrase like '% %'").select("lang", "phrase", F.col("f").alias("a"), F.split("phrase", " ").alias("w")).withColumn("k", F.explode(F.sequence(F.lit(1), F.size("w") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", _part("w", "1", "k").alias("first"), _part("w", "k + 1", "size(w)").alias("rest"))
    left, right = counts.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), counts.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r"))
    both = cuts.join(left, ["lang", "first"]).join(right, ["lang", "rest"])
    score = both.select("lang", "phrase", "a", "k", "l", "r", ((F.lit(1_000_000).cast("decimal(7,0)") * exact("a") * exact("a")).cast("decimal(38,0)")).alias("x"), (exact("l") * exact("r")).cast("decimal(38,0)").alias("y"))
    best = score.withColumn("score", F.expr("x div y")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("m"))
    return best.select("lang", "phrase", "a", "m.l", "m.r", "m.score")


def subsumed(counts: DataFrame, share: int = SHARE) -> DataFrame:
    """(lang, phrase) of the phrases that are mostly part of one longer phrase."""
    words = counts.filter("phrase like '% % %'").select("lang", "f", F.split("phrase", " ").alias("w"))
    parts = F.expr("flatten(transform(sequence(2, size(w) - 1), m -> transform(sequence(1, size(w) - m + 1), i -> array_join(slice(w, i, m), ' '))))")
    longer = words.select("lang", "f", F.explode(parts).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("most"))
    return counts.join(longer, ["lang", "phrase"]).filter(100 * F.col("most") >= share * F.col("f")).select("lang", "phrase")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, share: int = SHARE, top: int = TOP, width: int = CELLS) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's `top` phrases of 2 to `longest` words with `least` occurrences or more."""
    counts = materialize(phrase_counts(docs, longest, least, width), "phrases")
    phrases = counts.filter("phrase <> '' and f >= " + str(least))
    left = scored(phrases).join(subsumed(phrases, share), ["lang", "phrase"], "left_anti")
    order = W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = left.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
    words = counts.filter("phrase = ''").select("lang", F.col("f").alias("n"))
    return best.join(words, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(read_table(spark, sf_dir, "documents"))
