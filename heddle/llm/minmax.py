"""Operator 12, near duplicates by min-max hashing: documents whose word shingles have a Jaccard similarity of 0.8 or more.

Every permutation of the shingle hashes gives two values of the signature, its minimum and its maximum, so `BANDS` bands of
four values need two permutations each: half the hash evaluations of minima alone. Two sets of similarity s agree in a value with
probability s, in a band with s ** 4 (a little less for small sets, whose minimum and maximum exclude one another: 0.36
for sets of five in place of 0.41 at s = 0.8). A pair at the similarity itself is missed in all 40 bands with a
probability of 2e-8 at most.

1. Texts of equal sets collapse to one node, that of the smallest doc_id.
2. The nodes of a band key form a star around the smallest; hot keys are counted in tasks, and split when joined. The
   star's links are confirmed on the full sets. This costs one row a node and band, however many share a key.
3. Of the keys whose nodes are in several components now, the pairs of different components are looked at: a pair goes if
   the sizes, or parity bitmaps of the sets (each shingle flips one of four bits or more a shingle), show that they differ
   in more shingles than the similarity allows. Both tests lose no link, and pass few pairs below 0.78. A key of more
   than `BLOCK` nodes is dealt as pairs of blocks. Only nodes outside a key's largest component are compared with others.
4. Enough pairs to span what passed are confirmed on the full sets; then what a failed pair had seemed to hold together.

Links are confirmed on the texts themselves. No pairs are emitted within a component, nothing is capped or sampled.

Defined cases: a text without words, and a null one, is a component of its own; texts of fewer words than a shingle have
one shingle of all words; rows that repeat a doc_id are one document, linked by any of its texts; a row with a null doc_id
has the component of a document with an equal set (null and kept where there is none) and links nothing itself; texts of
any length are read whole; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.anchors import mix, whole_groups
from heddle.llm.common import as_bytes, chunks, materialize, read_table
from heddle.llm.near_copies import allowed, packed_texts, shingle_set, shingles
from heddle.llm.simhash import _salted, components

SIZE = 2
SIMILARITY = 0.8
BANDS = 40
#: Permutations of a band; each gives two values.
BAND_PERMUTATIONS = 2
#: Nodes of a key that one task compares.
BLOCK = 1 << 14


def permutations(bands: int = BANDS) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and summands: x -> a * x + b modulo 2**64 permutes the shingle hashes."""
    seeds = mix(np.arange(1, 2 * bands * BAND_PERMUTATIONS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return seeds[::2] | np.uint64(1), seeds[1::2]


def signature(own: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Minimum and maximum of a set under each permutation."""
    low, high = np.full(len(a), np.iinfo(np.uint64).max, np.uint64), np.zeros(len(a), np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(own), step):
            x = a[:, None] * own[None, at : at + step] + b[:, None]
            low, high = np.minimum(low, x.min(axis=1)), np.maximum(high, x.max(axis=1))
    return low, high


def band_keys(own: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One key a band, of the minima and maxima of its permutations; none of an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    low, high = signature(own, a, b)
    values = np.concatenate([low.reshape(-1, BAND_PERMUTATIONS), high.reshape(-1, BAND_PERMUTATIONS)], axis=1)
    key = np.arange(1, len(values) + 1, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for column in values.T:
            key = mix(key * np.uint64(0x9E3779B97F4A7C15) + mix(column))
    return key.view(np.int64)


def width(n: int) -> int:
    """Bits of a set's parity bitmap: four or more a shingle, within bounds."""
    return min(max(1 << (4 * max(n, 1) - 1).bit_length(), 1 << 8), 1 << 17)


def parity(own: np.ndarray) -> bytes:
    bits = width(len(own))
    flips = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(flips.astype(np.uint8), bitorder="little").tobytes()


def set_rows(docs: DataFrame, size: int = SIZE) -> DataFrame:
    """(doc_id, t1, t2, n) for every row: two hashes of the set and its size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_named([shingles(t, size) for t in as_bytes(batch.column("text"))])], ["doc_id", "t1", "t2", "n"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n long")


def _named(sets: list[np.ndarray]) -> list[pa.Array]:
    t1, t2 = (pa.array(np.array([xxhash.xxh64_intdigest(s.tobytes(), seed) for s in sets], np.uint64).view(np.int64)) for seed in (1, 2))
    return [t1, t2, pa.array([len(s) for s in sets], pa.int64())]


def signed_rows(docs: DataFrame, size: int = SIZE, bands: int = BANDS) -> DataFrame:
    """(doc_id, t1, t2, n, bits, keys): the same with each set's bitmap and band keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = permutations(bands)
        for batch in chunks(batches):
            sets = [shingles(t, size) for t in as_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_named(sets), pa.array([parity(s) for s in sets], pa.binary()), pa.array([band_keys(s, a, b) for s in sets], pa.list_(pa.int64()))], ["doc_id", "t1", "t2", "n", "bits", "keys"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, t1 long, t2 long, n long, bits binary, keys array<long>")


def _folded(bits: bytes, w: int) -> np.ndarray:
    """A bitmap as 64-bit words, folded to w bytes (half of its own, or all)."""
    x = np.frombuffer(bits, "<u8")
    return x if len(bits) == w else x[: len(x) // 2] ^ x[len(x) // 2 :]


def cross_pairs(n: np.ndarray, bits: list[bytes], root: np.ndarray, similarity: float, span: bool) -> list[tuple[int, int]]:
    """Pairs (as positions) of different roots that pass both tests: all of them, or (`span`) enough to join what they join."""
    names, inverse, counts = np.unique(root, return_inverse=True, return_counts=True)
    label = inverse.copy()
    outside = inverse != int(np.argmax(counts))
    wide = np.array([len(x) for x in bits])
    tables = {}
    for w in np.unique(wide).tolist():  # sets that may be similar have bitmaps of equal widths, or one twice the other
        own = np.flatnonzero((wide == w) | (wide == 2 * w))
        tables[w] = own, np.stack([_folded(bits[k], w) for k in own.tolist()])
    out = []
    for i in np.flatnonzero(outside).tolist():
        for w in (int(wide[i]), int(wide[i]) // 2):
            if w not in tables:
                continue
            own, table = tables[w]
            fits = (label[own] != label[i]) & (n[own] >= similarity * n[i] - 1e-9) & (n[i] >= similarity * n[own] - 1e-9) & (~outside[own] | (own > i))
            fits &= wide[own] >= wide[i] if w == wide[i] else wide[own] == w
            some = np.flatnonzero(fits)
            if not len(some):
                continue
            limit = np.floor((n[i] + n[own[some]]) * (1 - similarity) / (1 + similarity) + 1e-9)
            got = own[some[np.bitwise_count(table[some] ^ _folded(bits[i], w)).sum(axis=1) <= limit]]
            if span and len(got):
                got = got[np.sort(np.unique(label[got], return_index=True)[1])]
                label[np.isin(label, label[got])] = label[i]
            out += [(i, j) for j in got.tolist()]
    return out


def blocked(rows: DataFrame, sizes: DataFrame, block: int = BLOCK) -> DataFrame:
    """rows (key, node) with `part`: the rows of a key with more than `block` of them meet as pairs of blocks."""
    dealt = _salted(rows, sizes.select("key", F.ceil(F.col("rows") / block).cast("int").alias("_parts")), "key", "node")
    own = F.pmod(F.xxhash64("node"), F.col("_parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("_parts") - 1), lambda j: F.least(own, j) * F.col("_parts") + F.greatest(own, j))
    return dealt.withColumn("part", F.explode(pairs)).drop("_parts")


def candidates(rows: DataFrame, similarity: float, span: bool) -> DataFrame:
    """(a, b), a < b: pairs from rows (key, part, node, n, bits, root) that share key and part, pass the tests and differ in root."""
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select(F.xxhash64("key", "part").alias("key"), "node", "n", "bits", "root").repartition(count, "key").sortWithinPartitions("key", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            key, node, n, root = (np.asarray(batch.column(c)) for c in ("key", "node", "n", "root"))
            bits, cut = batch.column("bits"), np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts) if len(key) else np.zeros(0, bool)
            a, b = [], []
            for s, e in zip(starts[: len(mixed)][mixed].tolist(), ends[: len(mixed)][mixed].tolist(), strict=True):
                for i, j in cross_pairs(n[s:e], bits[s:e].to_pylist(), root[s:e], similarity, span):
                    a.append(node[s + i])
                    b.append(node[s + j])
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def confirmed(pairs: DataFrame, packed: DataFrame, size: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose texts' sets have at least the similarity; an `a` of many pairs is dealt to several tasks."""
    heads = packed.join(pairs.select(F.col("a").alias("doc_id")).distinct(), "doc_id", "left_semi").select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a"))
    first = _salted(pairs, heads, "a", "b")
    both = first.join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        head = lru_cache(8)(lambda x: shingle_set(expand(x), size))
        for batch in chunks(batches, "text_b", 1 << 20):
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                s, t = head(x), shingle_set(expand(y), size)
                both = len(s & t)
                keep.append(both >= similarity * (len(s) + len(t) - both) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long").distinct()


def roots(docs: DataFrame, members: DataFrame, nodes: DataFrame, size: int, similarity: float, block: int = BLOCK) -> DataFrame:
    """(node, root) of the nodes that are linked with others."""
    rows = nodes.select(F.explode("keys").alias("key"), "node")
    sizes = materialize(rows.groupBy("key").agg(F.count("*").alias("rows"), F.min("node").alias("head")).filter("rows > 1"), "minmax-keys")
    live = materialize(rows.join(sizes.select("key", "head"), "key").select("key", "node", "head"), "minmax-live")  # adaptive execution splits a hot key's rows: both sides are plain exchanges
    texts = packed_texts(docs)
    packed = materialize(texts.join(live.select(F.col("node").alias("doc_id")).distinct().hint("merge"), "doc_id", "left_semi"), "minmax-texts")
    many = members.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a <> z").select("doc_id", "a")
    repeated = members.join(many, "doc_id").select("a", F.col("node").alias("b")).filter("a <> b")
    tried = materialize(live.filter("node <> head").select(F.col("head").alias("a"), F.col("node").alias("b")).distinct(), "minmax-stars")
    root = components(confirmed(tried, packed, size, similarity).unionByName(repeated), "minmax-links")
    for span in (True, False):
        named = live.join(root, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
        mixed = materialize(named.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("rows")).filter("x <> y"), "minmax-mixed")
        apart = blocked(named, mixed, block).join(nodes.select("node", "n", "bits"), "node")
        new = materialize(candidates(apart, similarity, span).join(tried, ["a", "b"], "left_anti"), "minmax-pairs")
        tried = tried.unionByName(new)
        root = components(root.filter("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(confirmed(new, packed, size, similarity)), "minmax-links")
    return root


def near_duplicates(docs: DataFrame, size: int = SIZE, similarity: float = SIMILARITY, bands: int = BANDS, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of docs."""
    rows = materialize(set_rows(docs, size), "minmax-rows")  # texts are read once more for what is wide, which then is written once a set
    some = rows.filter("n > 0")
    named = signed_rows(docs, size, bands).filter("n > 0").groupBy("t1", "t2").agg(F.min("doc_id").alias("node"), F.min_by(F.struct("n", "bits", "keys"), "doc_id").alias("x"))
    sets = materialize(named.select(F.struct("t1", "t2").alias("set"), "node", "x.*"), "minmax-nodes")
    nodes = sets.filter("node is not null")
    members = materialize(_salted(some.select("doc_id", F.struct("t1", "t2").alias("set"), "n"), sets.select("set", "node"), "set", "doc_id").select("doc_id", "n", "node"), "minmax-members")
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    root = roots(known, members.filter("doc_id is not null"), nodes, size, similarity, block)
    found = _salted(members.filter("node is not null"), nodes.select("node").join(root, "node", "left").distinct(), "node", "doc_id").select("doc_id", "n", F.coalesce("root", "node").alias("component_id"))
    alone = rows.filter("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")).unionByName(members.filter("node is null").select("doc_id", "n", F.col("node").alias("component_id")))
    return found.unionByName(alone).select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op12_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))
