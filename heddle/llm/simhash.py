"""Operator 8, SimHash near-duplicates with pivot distance tables.

Fingerprints: one pass; each word shingle's XXH64 votes on 64 bits. Equal fingerprints collapse to one row before
anything is compared. Candidates: the 64 bits are cut into five blocks; fingerprints at three or fewer differing bits
agree on two whole blocks at least, so every link has its two ends together in one of ten tables keyed by two blocks.
Within a bucket the Hamming distances to many reference fingerprints (pivots) are computed once per row; by the
triangle inequality a pair whose distances to some pivot differ by more than three is no link, so the bucket is sorted
by its first pivot, only rows within three are paired, pairs are discarded by their maximum coordinate difference,
and the survivors are verified by an exact comparison. No cap is set anywhere.

A bucket emits a spanning forest of its links, not all pairs: components stay the same. Components are found by
alternating large-star and small-star steps over the links, each written to the shared folder, until none changes.

Scale: copies cost one row each; hot texts collapse in the map-side aggregation. Rows move as 16-byte pairs, ten
times. Buckets hold distinct fingerprints that agree on 25 or 26 bits; beyond some 10**9 distinct fingerprints
`blocks` = 6 (twenty tables of three blocks, 32 bits) keeps them small.

Defined cases: null and empty texts have fingerprint zero, linked like any other; fewer words than a shingle give one
shingle of all words; repeated rows are copies; rows with a null doc_id are fingerprinted and take the component of
their copies; the smallest doc_id names a component; rows that repeat an id with another text are rows of their own;
texts of any length are read whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import as_bytes, chunks, materialize, read_table

SEED = 42
MAX_BITS = 3
PIVOTS = 24
#: Tasks that the rows of one hot key are dealt to in a join.
SALT = 8


def simhash(text: bytes, size: int = 3) -> int:
    """Unsigned 64-bit fingerprint: a bit is set if it is set in over half of the shingles' hashes."""
    words = text.lower().split()
    if not words:
        return 0
    h = xxhash.xxh64_intdigest
    joined = b" ".join(words)
    if len(words) <= size:
        return h(joined, SEED)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - size + 1].tolist()
    ends = (ends[size - 1 :] - 1).tolist()
    return majority(np.array([h(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], np.uint64))


_BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    lanes = hashes.astype("<u8").view(np.uint8).reshape(n, 8)
    if n < 512:
        counts = np.unpackbits(lanes, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    else:  # by histograms of each byte lane
        counts = np.concatenate([np.bincount(lanes[:, i], minlength=256) @ _BYTE_BITS for i in range(8)])
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, size: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            fp = np.array([simhash(t, size) for t in as_bytes(batch.column("text"))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(fp)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def block_masks(blocks: int = 5, max_bits: int = MAX_BITS) -> list[int]:
    """Masks of the tables: every choice of `blocks - max_bits` blocks."""
    cuts = np.linspace(0, 64, blocks + 1).round().astype(int).tolist()
    one = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [sum(c) for c in combinations(one, blocks - max_bits)]


def pivots(n: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints, spread by a fixed mixing function (the same everywhere)."""
    with np.errstate(over="ignore"):
        z = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def _find(parent: list[int], x: int) -> int:
    while parent[x] != x:
        parent[x] = parent[parent[x]]
        x = parent[x]
    return x


def bucket_links(fp: np.ndarray, reference: np.ndarray, max_bits: int = MAX_BITS) -> list[tuple[int, int]]:
    """Links (as positions) that span the components of one bucket of fingerprints."""
    m = len(fp)
    table = np.bitwise_count(fp[:, None] ^ reference[None, :]).astype(np.int8)  # the pivot distance table
    order = np.argsort(table[:, 0], kind="stable")
    first = table[order, 0]
    last = np.searchsorted(first, first + max_bits, "right")
    parent, out = list(range(m)), []
    step = max(1, (1 << 20) // m)
    for s in range(0, m, step):  # a block of rows against those within reach of it by the first pivot
        e = min(m, s + step)
        width = last[s:e] - np.arange(s, e) - 1
        i = np.repeat(np.arange(s, e), width)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(width) - width, width)
        a, b = order[i], order[j]
        for k in range(1, table.shape[1]):  # the maximum coordinate difference, one coordinate at a time
            if not len(a):
                break
            near = np.abs(table[a, k] - table[b, k]) <= max_bits
            a, b = a[near], b[near]
        near = np.bitwise_count(fp[a] ^ fp[b]) <= max_bits
        for x, y in zip(a[near].tolist(), b[near].tolist(), strict=True):
            if (p := _find(parent, x)) != (q := _find(parent, y)):
                parent[max(p, q)] = min(p, q)
                out.append((x, y))
    return out


def links(distinct: DataFrame, blocks: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): links between distinct fingerprints, enough of them to span every component."""
    masks = block_masks(blocks, max_bits)
    as_long = lambda x: x - (1 << 64) if x >> 63 else x
    tables = F.array(*(F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(as_long(m))).alias("key")) for i, m in enumerate(masks)))
    rows = distinct.select("fp", F.explode(tables).alias("x")).select("x.t", "x.key", "fp")
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = rows.repartition(n, "t", "key").sortWithinPartitions("t", "key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reference, held = pivots(), None
        for batch in batches:
            t, key, fp = (np.asarray(batch.column(i)) for i in range(3))
            if held is not None:
                t, key, fp = (np.concatenate(x) for x in zip(held, (t, key, fp), strict=True))
            last = int(np.flatnonzero((t != t[-1]) | (key != key[-1]))[-1] + 1) if len(t) and ((t != t[-1]) | (key != key[-1])).any() else 0
            held = (t[last:], key[last:], fp[last:])
            yield from emit(t[:last], key[:last], fp[:last], reference)
        if held is not None:
            yield from emit(*held, reference)

    def emit(t: np.ndarray, key: np.ndarray, fp: np.ndarray, reference: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(t) < 2:
            return
        cut = np.flatnonzero((t[1:] != t[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(t)]])
        a, b = [], []
        unsigned = fp.view(np.uint64)
        for s, e in zip(starts[ends - starts > 1].tolist(), ends[ends - starts > 1].tolist(), strict=True):
            for x, y in bucket_links(unsigned[s:e], reference, max_bits):
                a.append(fp[s + x])
                b.append(fp[s + y])
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return sorted_rows.mapInArrow(run, "a long, b long").distinct()


def _salted(rows: DataFrame, table: DataFrame, key: str, spread: str) -> DataFrame:
    """rows joined with a table of one row a key; a hot key's rows are dealt to `SALT` tasks."""
    many = table.withColumn("_salt", F.explode(F.array(*map(F.lit, range(SALT)))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")).join(many, [key, "_salt"]).drop("_salt")


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """(node, root): the smallest node of each connected component, for the nodes that have an edge.

    Large-star links every node's larger neighbours to its smallest neighbour, small-star the smaller ones; the two
    alternate until the edges stay the same. The number of rounds grows with the logarithm of a component's diameter.
    """
    edges = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), tag)
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = _salted(both.filter("b > a"), low, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lower = large.groupBy("a").agg(F.min("b").alias("m"))
        small = _salted(large, lower, "a", "b").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").unionByName(lower.select("a", F.col("m").alias("b")))
        edges = materialize(small.distinct(), tag)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == before:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root"))).distinct()
        before = now


def near_duplicates(docs: DataFrame, size: int = 3, blocks: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of docs."""
    rows = materialize(fingerprints(docs, size), "simhash")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-distinct")
    root = components(links(distinct.select("fp"), blocks, max_bits), "simhash-links")
    member = distinct.join(root, distinct["fp"] == root["node"], "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = member.groupBy("root").agg(F.min("first_id").alias("component_id"))
    known = member.join(named, "root").select("fp", "component_id")
    return _salted(rows, known, "fp", "doc_id").select("doc_id", "fp", "component_id")


def keep_first(docs: DataFrame, size: int = 3) -> DataFrame:
    """docs with one document of each group of linked fingerprints: the smallest doc_id. Rows with a null doc_id stay."""
    spare = near_duplicates(docs, size).filter("doc_id <> component_id").select("doc_id")
    return docs.join(spare, "doc_id", "left_anti").select(*docs.columns)


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
