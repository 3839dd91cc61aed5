"""Near copies for the pipeline's SimHash stage: operator 8's links, and every pair of texts whose five-word shingles have a Jaccard similarity of 0.8 or more.

One fingerprint at three bits misses most such pairs, so the second kind of link has a candidate search of its own,
which is complete:

1. A count sketch of all shingles (a fixed number of cells, summed over every document) gives one order of shingles for
   the whole corpus, rare ones first. Any fixed order is correct; this one keeps famous passages out of the search.
2. Two sets at the similarity t or more share one of their first |x| - ceil(t |x|) + 1 shingles in that order. Only these
   are dealt out, as keys of buckets; keys that one text alone has go at once. A key that the sketch counts more than
   `BLOCK` times is dealt as pairs of blocks, so that no bucket grows with the fame of its key, and no pair is lost.
3. Within a bucket a pair is discarded if the sizes are too far apart, or if the parity bitmaps of the two sets (each
   shingle flips one bit) differ in more bits than the sets may differ in shingles. Both tests never lose a link.
4. A span of what remains is verified on the texts. Since an unverified pair that fails may have held two true copies
   together, all pairs of a bucket that no *verified* link holds together are then verified too.

Nothing is capped or drawn at random. Texts with equal words collapse to one node before anything is dealt out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.llm.anchors import mix, whole_groups, window_hashes
from heddle.llm.common import as_bytes, chunks, materialize
from heddle.llm.simhash import components, links, simhash

SIZE = 5
SIMILARITY = 0.8
#: Cells of the count sketch, and how they are cut for the sum.
CELLS = 1 << 20
SLICE = 1 << 12
#: Rows of a bucket, as the sketch counts them.
BLOCK = 1 << 15
_SMALL = 24


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the word shingles (all words if there are fewer; none of an empty text)."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    unit = np.array(list(map(xxhash.xxh64_intdigest, words)), np.uint64)
    return np.unique(mix(window_hashes(unit, min(size, len(words)), 3)))


def parity(own: np.ndarray) -> int:
    """Bitmap in which every shingle flips one bit: as many bits as the least power of two that is twice the set (2**8 to 2**16)."""
    bits = width(len(own))
    flips = np.bincount((own & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return int.from_bytes(np.packbits(flips.astype(np.uint8), bitorder="little").tobytes(), "little")


def width(n: int) -> int:
    return min(max(1 << (2 * max(n, 1) - 1).bit_length(), 1 << 8), 1 << 16)


def allowed(a: int, b: int, similarity: float) -> int:
    """Shingles in which sets of a and b may differ."""
    return math.floor((a + b) * (1 - similarity) / (1 + similarity) + 1e-9)


def sketch(docs: DataFrame) -> np.ndarray:
    """How many texts have a shingle of each cell. CELLS integers reach the driver, whatever the input."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.int64)
        for batch in chunks(batches):
            own = [shingles(t) for t in as_bytes(batch.column("text"))]
            counts += np.bincount((np.concatenate(own) & np.uint64(CELLS - 1)).astype(np.int64), minlength=CELLS)
        if counts.any():
            cut = counts.reshape(-1, SLICE)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cut), dtype=np.int32)), pa.array(np.full(len(cut), TaskContext.get().partitionId() % 64, np.int32)), pa.array([x.tobytes() for x in cut], pa.binary())], ["slice", "part", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.head(1).assign(n=np.sum([np.frombuffer(x, np.int64) for x in pdf["n"]], axis=0).tobytes())

    schema = "slice int, part int, n binary"
    parts = docs.select("text").mapInArrow(run, schema).groupBy("slice", "part").applyInPandas(add, schema)
    out = np.zeros((CELLS // SLICE, SLICE), np.int64)
    for r in parts.groupBy("slice").applyInPandas(add, schema).collect():
        out[r["slice"]] = np.frombuffer(r["n"], np.int64)
    return out.reshape(-1)


def keys_of(own: np.ndarray, counts: np.ndarray, level: np.ndarray, similarity: float, salt: int) -> np.ndarray:
    """Keys of the buckets that a text goes to."""
    if not len(own):
        return own
    cell = (own & np.uint64(CELLS - 1)).astype(np.int64)
    first = np.argsort(level[cell], kind="stable")[: len(own) - math.ceil(similarity * len(own) - 1e-9) + 1]
    key, parts = own[first], -(-counts[cell[first]] // BLOCK)
    out = [key[parts <= 1]]
    for k, n in zip(key[parts > 1].tolist(), parts[parts > 1].tolist(), strict=True):  # block against block
        b, j = salt % n, np.arange(n)
        pair = np.minimum(b, j) * n + np.maximum(b, j) + 1
        out.append(mix(np.uint64(k) ^ mix(pair.astype(np.uint64))))
    return np.concatenate(out)


def text_nodes(docs: DataFrame, counts: np.ndarray, similarity: float = SIMILARITY) -> DataFrame:
    """(node, u, fp, n, bits, keys): a row for each different sequence of words, that of the smallest doc_id; u hashes the text as it is."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        level = np.frexp(counts.astype(np.float64))[1].astype(np.uint8)
        for batch in chunks(batches):
            rows = []
            for i, t in zip(batch.column("doc_id").to_pylist(), as_bytes(batch.column("text")), strict=True):
                own, bare = shingles(t), b" ".join(t.lower().split())
                bits = parity(own)
                rows.append((xxhash.xxh64_intdigest(bare, 1), xxhash.xxh64_intdigest(bare, 2), simhash(t), len(own), bits.to_bytes(width(len(own)) // 8, "little"), keys_of(own, counts, level, similarity, xxhash.xxh64_intdigest(b"%d" % i)).view(np.int64)))
            t1, t2, fp = (pa.array(np.array([r[k] for r in rows], np.uint64).view(np.int64)) for k in range(3))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("u"), t1, t2, fp, pa.array([r[3] for r in rows], pa.int32()), pa.array([r[4] for r in rows], pa.binary()), pa.array([r[5] for r in rows], pa.list_(pa.int64()))], ["doc_id", "u", "t1", "t2", "fp", "n", "bits", "keys"])

    rows = docs.select("doc_id", F.xxhash64("text").alias("u"), "text").mapInArrow(run, "doc_id long, u long, t1 long, t2 long, fp long, n int, bits binary, keys array<long>")
    first = F.min_by(F.struct("doc_id", "u", "fp", "n", "bits", "keys"), F.struct("doc_id", "u"))
    return rows.groupBy("t1", "t2").agg(first.alias("m")).select(F.col("m.doc_id").alias("node"), "m.u", "m.fp", "m.n", "m.bits", "m.keys")


def shared_keys(nodes: DataFrame) -> DataFrame:
    """(key, node) of the keys that two nodes or more have."""
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = nodes.select(F.explode("keys").alias("key"), "node").repartition(n, "key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            key = np.asarray(batch.column("key"))
            same = np.concatenate([[False], key[1:] == key[:-1]])
            yield batch.filter(pa.array(same | np.concatenate([same[1:], [False]])))

    return dealt.mapInArrow(run, "key long, node long")


def bucket_pairs(n: list[int], bits: list[bytes], root: np.ndarray, similarity: float, span: bool) -> list[tuple[int, int]]:
    """Pairs (as positions) of one bucket that pass both tests and have different roots: all of them, or (`span`) enough to join what they join.

    Sizes must ascend."""
    m, out = len(n), []
    root = root.copy()
    if m <= _SMALL:
        whole = [int.from_bytes(b, "little") for b in bits]
        for i in range(m):
            w = 8 * len(bits[i])
            for j in range(i + 1, m):
                if n[i] < similarity * n[j] - 1e-9:
                    break
                if root[i] != root[j]:
                    other = whole[j] if len(bits[j]) == len(bits[i]) else whole[j] & ((1 << w) - 1) ^ whole[j] >> w
                    if (whole[i] ^ other).bit_count() <= allowed(n[i], n[j], similarity):
                        out.append((i, j))
                        if span:
                            root[root == root[j]] = root[i]
        return out
    size, wide = np.array(n), np.array([len(b) for b in bits])
    for w in np.unique(wide).tolist():  # a set and those up to 1 / similarity larger, folded to its own width
        own = np.flatnonzero((wide == w) | (wide == 2 * w))
        table = np.stack([_folded(bits[k], w) for k in own.tolist()])
        last = np.searchsorted(size[own], np.floor(size[own] / similarity + 1e-9), "right")
        for at in np.flatnonzero(wide[own] == w).tolist():
            i, e = int(own[at]), int(last[at])
            some = np.arange(at + 1, e)
            some = some[root[own[some]] != root[i]]
            if not len(some):
                continue
            limit = np.floor((size[i] + size[own[some]]) * (1 - similarity) / (1 + similarity) + 1e-9)
            got = own[some[np.bitwise_count(table[some] ^ table[at]).sum(axis=1) <= limit]]
            if span:
                got = got[np.sort(np.unique(root[got], return_index=True)[1])]
                joined = np.isin(root, root[got])
                root[joined] = root[i]
            out += [(i, j) for j in got.tolist()]
    return out


def _folded(bits: bytes, w: int) -> np.ndarray:
    x = np.frombuffer(bits, "<u8")
    return x if len(bits) == w else x[: len(x) // 2] ^ x[len(x) // 2 :]


def candidates(rows: DataFrame, similarity: float, span: bool) -> DataFrame:
    """(a, b), a < b: pairs from rows (key, node, n, bits, root) that share a key, pass the tests and differ in root."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("key", "node", "n", "bits", "root").repartition(n, "key").sortWithinPartitions("key", "n", "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, "key"):
            key, node, root = (np.asarray(batch.column(c)) for c in ("key", "node", "root"))
            size, bits = batch.column("n").to_pylist(), batch.column("bits")
            cut = np.flatnonzero(key[1:] != key[:-1]) + 1
            starts, ends = np.concatenate([[0], cut]), np.concatenate([cut, [len(key)]])
            mixed = np.minimum.reduceat(root, starts) != np.maximum.reduceat(root, starts)
            a, b = [], []
            for s, e in zip(starts[mixed].tolist(), ends[mixed].tolist(), strict=True):
                for i, j in bucket_pairs(size[s:e], bits[s:e].to_pylist(), root[s:e], similarity, span):
                    a.append(node[s + i])
                    b.append(node[s + j])
            x, y = np.array(a, np.int64), np.array(b, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return dealt.mapInArrow(run, "a long, b long").distinct()


def packed_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, packed): each text, compressed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1).compress
        for batch in chunks(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([squeeze(t) for t in as_bytes(batch.column("text"))], pa.binary())], ["doc_id", "packed"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, packed binary")


def verified(pairs: DataFrame, packed: DataFrame, size: int = SIZE, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs (a, b) of doc_ids whose texts' word shingles have at least the Jaccard similarity."""
    first = pairs.join(packed.select(F.col("doc_id").alias("a"), F.col("packed").alias("text_a")), "a")
    both = first.join(packed.select(F.col("doc_id").alias("b"), F.col("packed").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for batch in chunks(batches, "text_a", 1 << 20):
            keep = []
            for x, y in zip(batch.column("text_a").to_pylist(), batch.column("text_b").to_pylist(), strict=True):
                s, t = shingle_set(expand(x), size), shingle_set(expand(y), size)
                keep.append(len(s & t) >= similarity * len(s | t) - 1e-9)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(run, "a long, b long")


def shingle_set(text: bytes, size: int = SIZE) -> set[bytes]:
    words = text.lower().split()
    return {b" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def near_copy_links(docs: DataFrame, nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(a, b): links of both kinds between nodes, enough of them to span every group."""
    by_fp = nodes.groupBy("fp").agg(F.min("node").alias("head"))
    x, y = (by_fp.select(F.col("fp").alias(c), F.col("head").alias(h)) for c, h in (("a", "x"), ("b", "y")))
    heads = links(by_fp.select("fp")).join(x, "a").join(y, "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
    same = nodes.select("node", "fp").join(by_fp, "fp").filter("node <> head").select(F.col("node").alias("a"), F.col("head").alias("b"))
    close = materialize(heads.unionByName(same), "copies-fp")
    live = materialize(shared_keys(nodes).join(nodes.select("node", "n", "bits"), "node"), "copies-keys")
    wanted = live.select("node").distinct().hint("merge")
    texts = packed_texts(docs)
    packed = materialize(texts.join(wanted, texts["doc_id"] == wanted["node"], "left_semi"), "copies-texts")
    first = materialize(candidates(live.withColumn("root", F.col("node")), similarity, True), "copies-first")
    edges = materialize(close.unionByName(verified(first, packed, similarity=similarity)), "copies-verified")
    root = components(edges, "copies-links")
    apart = live.join(root, "node", "left").withColumn("root", F.coalesce("root", "node"))
    rest = materialize(candidates(apart, similarity, False).join(first, ["a", "b"], "left_anti"), "copies-rest")
    return edges.unionByName(verified(rest, packed, similarity=similarity))


def drop_near_copies(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs with one document, that of the smallest doc_id, of each group of near copies; a group is what links of either kind connect.

    Defined cases: rows with a null doc_id stay; null and empty texts are copies of each other; texts of fewer words than
    a shingle have one shingle of all words; rows that repeat an id and a text stay or go together; rows that repeat an
    id with another text are judged each by its own text; an empty table stays empty; other columns pass through.
    """
    known = docs.filter("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    nodes = materialize(text_nodes(known, sketch(known), similarity), "copies-nodes")
    root = components(near_copy_links(known, nodes, similarity), "copies-links")
    kept = nodes.select("node", "u").join(root.filter("node <> root"), "node", "left_anti").select(F.col("node").alias("_near_id"), F.col("u").alias("_near_u")).distinct()
    rows = docs.withColumns({"_near_key": F.col("doc_id").cast("long"), "_near_hash": F.xxhash64("text")})
    out = rows.join(kept, (F.col("_near_key") == F.col("_near_id")) & (F.col("_near_hash") == F.col("_near_u")), "left_semi").select(*docs.columns)
    return out.unionByName(docs.filter("doc_id is null"))
