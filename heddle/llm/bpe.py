"""Operator 3, byte-level BPE with a hierarchical-bitmap rank queue.

Pieces of text (the pre-tokens) are merged pair by pair, the lowest rank first, the leftmost of equal ranks first. A
bucket per rank holds the linked-list positions whose pair has that rank; a three-level bitmap over the ranks finds
the first bucket that is not empty; entries whose position or pair has changed meanwhile are stale and are skipped.
All pieces that a chunk of text has and the task has not met before share one arena, so a bucket's positions are
merged together (pieces don't touch each other: the first and last byte of each has no neighbour). A piece costs
O(n log n) at most, so very long pieces are as cheap per byte as short ones.

Scale: one pass without a shuffle; ranks are read once a worker. Known pieces are kept in a bounded two-generation
table, a speed-up that results don't depend on.

Defined cases: a null text is the empty text (no ids); special tokens don't exist; repeated rows give repeated
results; texts of any length are encoded whole; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import as_bytes, chunks, read_table

KNOWN_PIECES = 150_000
#: Bytes of text whose new pieces share an arena.
ARENA_BYTES = 4 << 20


class RankQueue:
    """A set of ranks as a bitmap of 64-bit words with two summary levels, and a bucket of positions for each rank."""

    def __init__(self, size: int) -> None:
        self.low = [0] * ((size >> 6) + 1)
        self.mid = [0] * ((size >> 12) + 1)
        self.top = 0
        self.bucket: dict[int, list] = {}

    def push(self, rank: int, entry) -> None:
        if rank in self.bucket:
            self.bucket[rank].append(entry)
            return
        self.bucket[rank] = [entry]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, list] | None:
        """The lowest rank and its bucket: find-first-set on each level."""
        if not self.top:
            return None
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        rank = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return rank, self.bucket.pop(rank)


class Known(dict):
    """Ids of the pieces met so far, as lists. A piece that isn't known gets an empty list, filled in later; `new` holds those."""

    def __init__(self, older: dict[str, list[int]]) -> None:
        self.older, self.new = older, {}

    def __missing__(self, piece: str) -> list[int]:
        ids = self.older.get(piece)
        if ids is None:
            ids = self.new[piece] = []
        self[piece] = ids
        return ids


class Encoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.ranks, self.split = ranks, regex.compile(pattern).findall
        self.size = max(ranks.values()) + 1
        self.token = [b""] * self.size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.decimal = [b"%d" % i for i in range(self.size)]
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    pairs[a << 32 | b] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[k] for k in self.keys.tolist()], np.int64)
        self.known = Known({})

    def pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each pair of ids, -1 where they don't merge."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], -1)

    def encode_pieces(self, pieces: list[bytes]) -> list[tuple[int, ...]]:
        """Ids of each piece, all pieces in one arena."""
        out: list = [None] * len(pieces)
        rest = []
        for i, p in enumerate(pieces):
            if (rank := self.ranks.get(p)) is not None:
                out[i] = (rank,)
            elif p:
                rest.append(i)
            else:
                out[i] = ()
        if not rest:
            return out
        arena = [pieces[i] for i in rest]
        n = sum(map(len, arena))
        starts = np.cumsum([0, *map(len, arena)])
        ids = self.byte_id[np.frombuffer(b"".join(arena), np.uint8)]
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[starts[1:] - 1], prv[starts[:-1]] = -1, -1
        at = np.full(n, -1)  # rank of the pair that begins at a position
        inner = np.flatnonzero(nxt >= 0)
        at[inner] = self.pair_ranks(ids[inner], ids[inner + 1])
        queue, strange = RankQueue(self.size), set()
        inner = np.flatnonzero(at >= 0)
        self._push(queue, inner, at[inner])
        lists = [memoryview(x) for x in (ids, nxt, prv, at)]
        while got := queue.pop():
            rank, entries = got
            if len(entries) <= 8 and not any(isinstance(x, np.ndarray) for x in entries):
                for p in sorted(entries):
                    if lists[3][p] == rank:
                        self._merge_one(queue, rank, p, *lists, strange)
                continue
            p = np.unique(np.concatenate([np.atleast_1d(x) for x in entries]))
            p = p[at[p] == rank]
            if not len(p):
                continue
            q = nxt[p]
            if len(p) > 1 and (touch := p[1:] == q[:-1]).any():  # in a run of touching pairs every second one is stale
                first = np.concatenate([[True], ~touch])
                place = np.arange(len(p))
                keep = (place - place[first][np.cumsum(first) - 1]) % 2 == 0
                p, q = p[keep], q[keep]
            after, before = nxt[q], prv[p]
            ids[p], ids[q], at[q], at[p] = rank, -1, -1, -1
            nxt[p] = after
            has = after >= 0
            prv[after[has]] = p[has]
            left, right = p[has], before[before >= 0]
            new = np.concatenate([left, right])
            right_rank = self.pair_ranks(ids[right], ids[nxt[right]])
            new_rank = np.concatenate([self.pair_ranks(ids[left], ids[after[has]]), right_rank])
            at[new] = new_rank
            ok = new_rank >= 0
            new, new_rank = new[ok], new_rank[ok]
            if len(low := new[new_rank < rank]):
                strange.update(low.tolist())
            self._push(queue, new, new_rank)
        alive = ids >= 0
        flat = ids[alive].tolist()
        cut = np.concatenate([[0], np.cumsum(alive)])[starts].tolist()
        for k, i in enumerate(rest):
            out[i] = tuple(flat[cut[k] : cut[k + 1]])
        for k in {int(np.searchsorted(starts, p, "right")) - 1 for p in strange}:  # a merge opened a lower rank: order within the piece matters
            out[rest[k]] = self.encode_alone(arena[k])
        return out

    def _push(self, queue: RankQueue, at: np.ndarray, rank: np.ndarray) -> None:
        if len(at) < 12:
            for p, r in zip(at.tolist(), rank.tolist(), strict=True):
                queue.push(r, p)
            return
        order = np.argsort(rank, kind="stable")
        at, rank = at[order], rank[order]
        cut = np.flatnonzero(np.diff(rank)) + 1
        ends = [*cut.tolist(), len(at)]
        s = 0
        for r, e in zip(rank[[0, *cut.tolist()]].tolist(), ends, strict=True):
            if e - s > 8:
                queue.push(r, at[s:e])
            else:
                for p in at[s:e].tolist():
                    queue.push(r, p)
            s = e

    def _merge_one(self, queue: RankQueue, rank: int, p: int, ids, nxt, prv, at, strange: set) -> None:
        q = nxt[p]
        after, before = nxt[q], prv[p]
        ids[p], ids[q], at[q], at[p], nxt[p] = rank, -1, -1, -1, after
        if after >= 0:
            prv[after] = p
            r = self.pairs.get(rank << 32 | ids[after], -1)
            at[p] = r
            if r >= 0:
                queue.push(r, p)
                if r < rank:
                    strange.add(p)
        if before >= 0:
            r = self.pairs.get(ids[before] << 32 | rank, -1)
            at[before] = r
            if r >= 0:
                queue.push(r, before)
                if r < rank:
                    strange.add(before)

    def encode_alone(self, piece: bytes) -> tuple[int, ...]:
        """One piece, one merge at a time: the lowest rank, then the leftmost."""
        ids = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n = len(ids)
        nxt, prv = [*range(1, n), -1], list(range(-1, n - 1))
        heap = [(r, p) for p in range(n - 1) if (r := self.pairs.get(ids[p] << 32 | ids[p + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            rank, p = heapq.heappop(heap)
            q = nxt[p]
            if ids[p] < 0 or q < 0 or self.pairs.get(ids[p] << 32 | ids[q]) != rank:
                continue
            ids[p], ids[q], nxt[p] = rank, -1, nxt[q]
            if nxt[p] >= 0:
                prv[nxt[p]] = p
                if (r := self.pairs.get(rank << 32 | ids[nxt[p]])) is not None:
                    heapq.heappush(heap, (r, p))
            if prv[p] >= 0 and (r := self.pairs.get(ids[prv[p]] << 32 | rank)) is not None:
                heapq.heappush(heap, (r, prv[p]))
        return tuple(x for x in ids if x >= 0)

    def encode_texts(self, texts: list[str]) -> Iterator[list[int]]:
        """Ids of each text; pieces that are new to this worker are encoded together first."""
        known = self.known
        look_up, split = known.__getitem__, self.split
        rows = [list(map(look_up, split(t))) for t in texts]
        if new := known.new:
            for ids, got in zip(new.values(), self.encode_pieces([p.encode() for p in new]), strict=True):
                ids.extend(got)
            known.new = {}
        for row in rows:
            yield list(chain.from_iterable(row))
        if len(known) > KNOWN_PIECES:
            known.older = {}
            self.known = Known(known)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


@cache
def encoder(name: str) -> Encoder:
    """The encoder of a public vocabulary, once a worker. Its file is read where the task runs."""
    import public_tokenizers

    return Encoder(load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN)


VOCABULARY = "byte_bpe_50k.tiktoken"


def encode(docs: DataFrame, *carried: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, carried columns, ids): the ids of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in chunks(batches, limit=ARENA_BYTES):
            ids = pa.array(list(own.encode_texts([x.decode() for x in as_bytes(batch.column("text"))])), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", *carried]).columns, ids], ["doc_id", *carried, "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, "text")
    return rows.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "text") + ", ids array<int>")


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, data): the bytes of each row's ids; null ids give null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([None if x is None else own.decode(x) for x in batch.column("ids").to_pylist()], pa.binary())], ["doc_id", "data"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """encode() and decode() in one pass, with digests in place of ids and bytes, so that neither is shipped out of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for batch in chunks(batches, limit=ARENA_BYTES):
            n, digest, back = [], [], []
            for ids in own.encode_texts([x.decode() for x in as_bytes(batch.column("text"))]):
                n.append(len(ids))
                digest.append(hashlib.sha256(b" ".join(map(own.decimal.__getitem__, ids))).hexdigest())
                back.append(hashlib.sha256(own.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(digest, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(read_table(spark, sf_dir, "documents"))
