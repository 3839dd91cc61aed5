"""Operator 4, substring dedup by repeated-phrase automata.

A window of 20 words that also starts earlier (in a document with a smaller id, or earlier in the same) is removed.

1. Whole texts that are equal collapse to the document with the smallest id.
2. Anchors (see anchors.py) find the windows that may recur; the stretches of text around repeated anchors are dealt
   out by anchor, so that all windows that may be equal meet. Equal stretches collapse before they are dealt.
3. Each task confirms the recurring windows among its stretches, compiles them into Aho-Corasick automata over word
   numbers (pyahocorasick, in shards of at most `SHARD` phrases), and streams every stretch of the anchor through
   them to locate all occurrences; the earliest stays.
4. The removed ranges go back to their texts; copies of a text of 20 words or more lose all their words.

Windows in different stretches are confirmed and located by their words; stretches that are equal as a whole, and
windows with a hot anchor (see anchors.py), by 128 bits of hash. Scale: texts are shuffled once; anchors are counted
with map-side sums; no task sees all of a common passage, at most the different stretches around one anchor of at most
`HOT` texts.

Defined cases: a null text is the empty text; fewer than 20 words lose none; texts of any length are read whole; a null doc_id comes after all others;
rows that repeat an id and a text are one document stated twice, with the same result; rows that repeat an id with
another text are ordered by a hash of the text; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.anchors import HOT, by_row, distinct_texts, keyed, repeated_anchors, segments, unpacked, whole_groups, with_ranges
from heddle.llm.common import as_bytes, chunks, read_table

WINDOW = 20
GRAM = 8
SHARD = 20_000


def word_units(text: bytes) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, text.split()), np.uint64)


def cut_words(text: bytes) -> Callable[[np.ndarray, np.ndarray], list[bytes]]:
    """Of a text, a function that gives the words [first, end), joined by one space, for each stretch."""
    made: list = []

    def cut(first: np.ndarray, end: np.ndarray) -> list[bytes]:
        if not len(first):
            return []
        if not made:
            words = text.split()
            made.extend((b" ".join(words), np.cumsum([0, *(len(w) + 1 for w in words)])))
        joined, at = made
        return [joined[a:b] for a, b in zip(at[first].tolist(), (at[end] - 1).tolist(), strict=True)]

    return cut


def automata(phrases: list[tuple[int, ...]]) -> Iterator[ahocorasick.Automaton]:
    """Automata over the phrases, SHARD in each; a phrase's value is its number."""
    for s in range(0, len(phrases), SHARD):
        own = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
        for i, p in enumerate(phrases[s : s + SHARD], s):
            own.add_word(p, i)
        own.make_automaton()
        yield own


def recurring_windows(stretches: list[bytes], window: int = WINDOW) -> list[list[int]]:
    """Of each stretch, in the order given, the starts of the windows that occurred earlier (in an earlier stretch, or before in the same)."""
    number: dict[bytes, int] = {}
    as_numbers = [tuple(number.setdefault(w, len(number)) for w in s.split(b" ")) for s in stretches]
    seen, twice = set(), {}
    for x in as_numbers:  # confirm: the windows that occur twice or more
        for i in range(len(x) - window + 1):
            w = x[i : i + window]
            if w in seen:
                twice.setdefault(w, None)
            else:
                seen.add(w)
    out: list[list[int]] = [[] for _ in stretches]
    if not twice:
        return out
    phrases = list(twice)
    del seen, twice
    met = bytearray(len(phrases))
    for own in automata(phrases):  # locate: every occurrence, the first of each phrase stays
        for k, x in enumerate(as_numbers):
            for end, phrase in own.iter(x):
                if met[phrase]:
                    out[k].append(end - window + 1)
                met[phrase] = 1
    return out


def removed_ranges(found: DataFrame) -> DataFrame:
    """(key, id, first, last): words [first, last) of the texts that a window which started earlier covers."""
    n = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = F.struct("id", "key", "start")
    # the text is part of the value, so that both uses below ask for the same columns and share one exchange
    distinct = found.groupBy("anchor", "stretch").agg(F.min_by(F.struct("id", "key", "start", "text"), order).alias("m"))
    dealt = distinct.select("anchor", "m.key", "m.id", "m.start", "m.text").filter("text <> X''").repartition(n, "anchor").sortWithinPartitions("anchor", "id", "key", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches):
            anchor, start = np.asarray(batch.column("anchor")), np.asarray(batch.column("start"))
            cuts = np.flatnonzero(np.diff(anchor)) + 1
            many = np.diff(np.concatenate([[0], cuts, [len(anchor)]]))
            rows = np.flatnonzero(np.repeat(many, many) > 1)  # equal windows have one anchor: a stretch that is alone with its anchor has none
            text = batch.column("text")
            at, first, last = [], [], []
            for r, starts in zip(rows.tolist(), recurring_windows([text[i].as_py() for i in rows.tolist()]), strict=True):
                for a, b in _runs(sorted(starts)):
                    at.append(r)
                    first.append(start[r] + a)
                    last.append(start[r] + b)
            own = batch.select(["key", "id"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*own.columns, pa.array(first, pa.int32()), pa.array(last, pa.int32())], ["key", "id", "first", "last"])

    located = dealt.mapInArrow(run, "key long, id long, first int, last int")
    # every other occurrence of a stretch repeats the first; occurrences are told apart by place, which no hot passage shares
    own = F.struct("start", F.col("start").alias("first"), (F.col("start") + F.col("units")).alias("last"))
    within = F.transform("again", lambda r: F.struct(F.lit(-1).alias("start"), r["first"].alias("first"), r["last"].alias("last")))  # start -1: nobody's first
    spans = found.select("key", "id", F.explode(F.when(F.col("again").isNull(), F.array(own)).otherwise(F.concat(F.array(own), within))).alias("r")).select("key", "id", "r.start", "r.first", "r.last")
    later = spans.join(distinct.select("m.key", "m.id", "m.start"), ["key", "id", "start"], "left_anti")
    return located.unionByName(later.select("key", "id", "first", "last"))


def _runs(starts: list[int], window: int = WINDOW) -> list[tuple[int, int]]:
    """The union of [s, s + window)."""
    out: list[list[int]] = []
    for s in starts:
        if out and s <= out[-1][1]:
            out[-1][1] = s + window
        else:
            out.append([s, s + window])
    return [(a, b) for a, b in out]


RESULT = pa.schema([("key", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("ranges", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())])))])


def remove_passages(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, ranges) for every row; `ranges` are the removed stretches of words."""
    rows = keyed(docs)
    base, firsts = distinct_texts(rows)
    hits = repeated_anchors(base, word_units, WINDOW, GRAM, hot)
    ranges = removed_ranges(segments(base, hits, word_units, cut_words, WINDOW, GRAM))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Words of each text, and for a text too short to lose any the digest of its words."""
        for batch in chunks(batches):
            words = [t.split() for t in as_bytes(batch.column("text"))]
            digest = [hashlib.sha256(b" ".join(w)).hexdigest() if len(w) < WINDOW else None for w in words]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "id", "t1", "t2"]).columns, pa.array([len(w) for w in words], pa.int64()), pa.array(digest, pa.string())], ["doc_id", "id", "t1", "t2", "n", "digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in unpacked(batches):
            n, removed, digest, spans = [], [], [], []
            for t, got in zip(texts, batch.column("ranges").to_pylist(), strict=True):
                words = t.split()
                gone: list[list[int]] = []
                for a, b in sorted((x["first"], x["last"]) for x in got or ()):
                    if gone and a <= gone[-1][1]:
                        gone[-1][1] = max(gone[-1][1], b)
                    else:
                        gone.append([a, b])
                kept, at = [], 0
                for a, b in gone:
                    kept += words[at:a]
                    at = b
                kept += words[at:]
                n.append(len(words))
                removed.append(len(words) - len(kept))
                digest.append(hashlib.sha256(b" ".join(kept)).hexdigest())
                spans.append([{"first": a, "last": b} for a, b in gone])
            yield pa.RecordBatch.from_arrays([batch.column("key"), *(pa.array(x, f.type) for x, f in zip((n, removed, digest, spans), list(RESULT)[1:], strict=True))], schema=RESULT)

    of_text = with_ranges(base, ranges).mapInArrow(run, "key long, n_words long, n_removed long, kept_sha256 string, ranges array<struct<first: int, last: int>>")
    # a copy is no first row: it has no line in of_text, and all its windows started in the first
    own = by_row(rows.mapInArrow(count, "doc_id long, id long, t1 long, t2 long, n long, digest string"), firsts, of_text.drop("n_words"))
    copy, n = F.col("copies").isNull(), F.col("n")
    pick = lambda whole, none, other: F.when(copy & (n >= WINDOW), whole).when(copy, none).otherwise(other)
    none = F.array().cast("array<struct<first: int, last: int>>")
    all_of_it = F.array(F.struct(F.lit(0).alias("first"), n.cast("int").alias("last")))
    return own.select("doc_id", n.alias("n_words"), pick(n, F.lit(0).cast("long"), F.col("n_removed")).alias("n_removed"), pick(F.sha2(F.lit(""), 256), F.col("digest"), F.col("kept_sha256")).alias("kept_sha256"), pick(all_of_it, none, F.col("ranges")).alias("ranges"))


def op4_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_passages(read_table(spark, sf_dir, "documents")).drop("ranges")
