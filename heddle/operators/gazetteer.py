"""Names from a list, found in texts: a trie of words for lists of a checked size, a join on phrases beyond.

Texts are walked word by word, and hits leave a task some thousands at a time, so memory doesn't grow with a batch or a
text's hits. Before the join, a phrase is dropped in its task if a bitmap of fixed size knows no entry that begins with its
words: that loses no hit, and what the bitmap lets pass by chance the join drops.

A hit is a run of whole words that equals an entry, whatever the case, with single or more spaces between the words. Of
overlapping hits the leftmost stays, of those the longest (`overlapping` keeps all).
"""

from __future__ import annotations

import re
import zlib
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of a list that is broadcast as a trie; a longer one is joined.
LIMIT = 16 << 20
#: Rows of texts that become Python objects at once, and hits that leave a task together.
ROWS, HITS = 64, 1 << 14
#: Bits of the bitmap that phrases pass before the join, as a power of two: 8 MB.
BITS = 26
#: Words that a task remembers as beginning an entry or not.
KNOWN = 1 << 18
_WORD = re.compile(r"\w+")


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, str]]:
    """(batch, row, text), few of them as Python objects at once."""
    for batch in batches:
        column = batch.column("_text")
        for at in range(0, batch.num_rows, ROWS):
            for i, t in enumerate(column.slice(at, ROWS).to_pylist(), at):
                yield batch, i, t


def _cut(found: Iterable[tuple], carried: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of HITS rows at most, of (batch, row, start, end, name): the carried columns of the row, start, end, name."""
    found = iter(found)
    while some := list(islice(found, HITS)):
        parts: list[tuple[pa.RecordBatch, list[int]]] = []
        for f in some:
            if not parts or parts[-1][0] is not f[0]:
                parts.append((f[0], []))
            parts[-1][1].append(f[1])
        own = [pa.concat_arrays([b.column(c).take(pa.array(at, pa.int64())) for b, at in parts]) for c in carried]
        yield pa.RecordBatch.from_arrays([*own, pa.array([f[2] for f in some], pa.int32()), pa.array([f[3] for f in some], pa.int32()), pa.array([f[4] for f in some], pa.string())], [*carried, "start", "end", "name"])


class Trie:
    """Entries by their words; `find` walks a text once."""

    def __init__(self, entries: Iterable[str]) -> None:
        self.root: dict = {}
        for entry in entries:
            words = _WORD.findall(entry.casefold())
            if words:
                node = self.root
                for w in words:
                    node = node.setdefault(w, {})
                node.setdefault("", []).append(entry)  # no word is empty

    def find(self, text: str, overlapping: bool = False) -> Iterator[tuple[int, int, str]]:
        """(start, end, entry), in order; of entries that differ in case only the first."""
        root, free = self.root, 0  # where the last hit ended, unless they may overlap
        rest, ahead = _WORD.finditer(text), deque()  # the words that a walk has looked at beyond its first
        while ahead or (m := next(rest, None)):
            start, end, word = ahead.popleft() if ahead else (m.start(), m.end(), m[0].casefold())
            if start < free or word not in root:
                continue
            node, last, best, j = root[word], end, [], 0
            while True:
                if "" in node:
                    best.append((start, last, node[""][0]))
                if len(node) == ("" in node):  # nothing longer
                    break
                if j == len(ahead):
                    if not (m := next(rest, None)):
                        break
                    ahead.append((m.start(), m.end(), m[0].casefold()))
                after = ahead[j]
                if after[2] not in node or not text[last : after[0]].isspace():
                    break
                node, last, j = node[after[2]], after[1], j + 1
            if overlapping:
                yield from best
            elif best:
                free = best[-1][1]
                yield best[-1]


def hits(df: DataFrame, key: str, text: str, entries: DataFrame, entry: str, overlapping: bool = False, limit: int = LIMIT) -> DataFrame:
    """(key, start, end, entry): every hit of the list `entries` in the texts; places are characters, the end exclusive.

    The list's size decides the way, not the result: up to `limit` bytes it is a trie in each task, else the texts' phrases
    are joined with it. Null texts and null entries have no hits, rows that repeat a key hit each for themselves.
    """
    names = entries.select(F.col(entry).alias("entry")).filter("entry is not null").distinct()
    size = names.agg(F.sum(F.octet_length("entry") + 64)).first()[0] or 0
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text")).filter("_text is not null")
    kind = dict(df.dtypes)[key]
    if size > limit:
        return _joined(rows, names, overlapping).withColumnRenamed("_key", key)
    known = df.sparkSession.sparkContext.broadcast(sorted(r["entry"] for r in names.collect()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie(known.value)
        yield from (b.rename_columns(["_key", "start", "end", "entry"]) for b in _cut(((batch, i, *h) for batch, i, t in _texts(batches) for h in trie.find(t, overlapping)), ["_key"]))

    return rows.mapInArrow(run, f"_key {kind}, start int, end int, entry string").withColumnRenamed("_key", key)


def _joined(rows: DataFrame, names: DataFrame, overlapping: bool) -> DataFrame:
    """The same by a join: phrases of the texts, as long as the longest entry, meet the entries by their words."""
    spelled = F.udf(lambda x: " ".join(_WORD.findall(x.casefold())), "string")  # a row an entry
    listed = names.select("entry", spelled("entry").alias("phrase")).filter("phrase <> ''").groupBy("phrase").agg(F.min("entry").alias("entry"))
    grams = _phrases(rows.withColumn("_row", F.monotonically_increasing_id()), listed)
    found = grams.join(listed, "phrase").select("_key", "_row", "start", "end", "entry")
    if overlapping:
        return found.drop("_row")
    # leftmost, longest: a fold over each text's hits in order
    by = found.groupBy("_key", "_row").agg(F.array_sort(F.collect_list(F.struct("start", (-F.col("end")).alias("e"), "entry"))).alias("h"))
    kept = F.aggregate("h", F.array().cast("array<struct<start:int,e:int,entry:string>>"), lambda acc, x: F.when((F.size(acc) == 0) | (x["start"] >= -F.try_element_at(acc, F.lit(-1))["e"]), F.concat(acc, F.array(x))).otherwise(acc))
    return by.select("_key", F.explode(kept).alias("x")).select("_key", "x.start", (-F.col("x.e")).alias("end"), "x.entry")


def _bitmap(listed: DataFrame) -> np.ndarray:
    """Bits at the checksums of the entries' words and of all that they begin with; the driver sees at most a row a byte of the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = set()
            for p in batch.column("phrase").to_pylist():
                words = p.split(" ")
                bits.update(_bit(" ".join(words[:n])) for n in range(1, len(words) + 1))
            at = np.array(sorted(bits), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at >> 3), pa.array((1 << (at & 7)).astype(np.int32))], ["at", "bits"])

    got = listed.select("phrase").mapInArrow(run, "at long, bits int").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(1 << BITS - 3, np.uint8)
    out[got.column("at").to_numpy()] = got.column("bits").to_numpy()
    return out


def _bit(phrase: str) -> int:
    return zlib.crc32(phrase.encode("utf-8", "surrogatepass")) & (1 << BITS) - 1


def _phrases(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """(_key, _row, start, end, phrase): the phrases of texts that may be entries."""
    shared = rows.sparkSession.sparkContext.broadcast(_bitmap(listed))
    kind = dict(rows.dtypes)["_key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = memoryview(shared.value)
        first: dict[str, bool] = {}

        def begins(phrase: str) -> bool:
            at = _bit(phrase)
            return bool(bits[at >> 3] >> (at & 7) & 1)

        def walk(text: str) -> Iterator[tuple[int, int, str]]:
            rest, ahead = _WORD.finditer(text), deque()
            while ahead or (m := next(rest, None)):
                start, end, phrase = ahead.popleft() if ahead else (m.start(), m.end(), m[0].casefold())
                known = first.get(phrase)
                if known is None:
                    if len(first) >= KNOWN:
                        first.clear()
                    known = first[phrase] = begins(phrase)
                j = 0
                while known:
                    yield start, end, phrase
                    if j == len(ahead):
                        if not (m := next(rest, None)):
                            break
                        ahead.append((m.start(), m.end(), m[0].casefold()))
                    after = ahead[j]
                    if not text[end : after[0]].isspace():
                        break
                    end, phrase, j = after[1], f"{phrase} {after[2]}", j + 1
                    known = begins(phrase)

        found = ((batch, i, *h) for batch, i, t in _texts(batches) for h in walk(t))
        yield from (b.rename_columns(["_key", "_row", "start", "end", "phrase"]) for b in _cut(found, ["_key", "_row"]))

    return rows.mapInArrow(run, f"_key {kind}, _row long, start int, end int, phrase string")
