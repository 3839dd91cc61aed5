"""Operator 1, secret scans with a recursive decoding worklist.

Every text is scanned for assignments, access keys and long hex runs. A worklist then unwraps URL escapes, Unicode
escapes, base64 runs and compressed data inside them, layer by layer, until nothing new appears; a layer that was seen
before (same content at the same place) is not taken again, which ends cycles. Every layer is rescanned, and a span
found in it is mapped back to code points of the original text through all layers above it.

One pass without a shuffle: hot sources, copies and lost executors cost nothing. Compressed data of any size (gzip, zlib,
bzip2, xz, Zstandard; all members) are read as a stream, in windows that end between runs: memory is bounded by `LONGEST`,
the length from which a single run without an end is cut. Data within `DEEPEST` compressions are scanned as they are there.
What only looks compressed (a stream that breaks off, gives nothing or has more behind it) is scanned as it is, too.
Escapes that escape themselves over and over (`%252525...`) are taken in one step, so any nesting costs a few layers.
Decoded data may be UTF-8, ASCII as UTF-16, or have readable parts among others. Base64 runs of fewer than `SHORTEST`
characters are not opened.

Defined cases: a null text is the empty text; empty texts have no spans; texts of any length are scanned whole; spans are sorted by start, then by kind in
the order of KINDS, then by end; repeated rows give repeated results; an empty table gives an empty result; other columns are ignored or passed through.
"""

from __future__ import annotations

import base64
import bz2
import hashlib
import lzma
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import as_texts, chunks, read_table

KINDS = ("assign", "access", "hex")
#: Bytes of compressed data's content that are read, and scanned, at once; a run without an end is cut at LONGEST.
PIECE, WINDOW, LONGEST = 1 << 16, 1 << 22, 1 << 24
#: Compressions directly within one another.
DEEPEST = 64
#: Characters of a base64 run: twelve bytes can hold no secret and its key.
SHORTEST = 16
_ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
_CUE = ("passw", "secret", "token", "api")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(r"\\u\{([0-9A-Fa-f]{1,6})\}|[\\%]u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#[xX]([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});|\\([0-3][0-7]{2})|&(equals|colon|quot|apos|lowbar|sol|plus|amp);")
_NAMED = {"equals": "=", "colon": ":", "quot": '"', "apos": "'", "lowbar": "_", "sol": "/", "plus": "+", "amp": "&"}
#: An escaped escape character, again and again.
_CHAIN = re.compile(r"%(?:25){16,}(?=[0-9A-Fa-f]{2})|&(?:#38;){16,}|&(?:amp;){16,}|\\(?:x5[cC]){16,}|\\(?:u005[cC]){16,}|\\(?:134){16,}")
_URL_MAGIC = re.compile(r"%1[fF]%8[bB]|(?:x|%78)%(?:01|9[cC]|[dD][aA])|(?:x|%78)(?:%5[eE]|\^)|BZh[1-9]1AY|%[fF][dD]7zXZ|(?:\(|%28)%[bB]5(?:/|%2[fF])%[fF][dD]")
_URL_RUN = re.compile(r"(?:%[0-9A-Fa-f]{2}|[!-$&-~])+")
_URL_BYTE = re.compile(r"%[0-9A-Fa-f]{2}|.")
_BETWEEN = re.compile(rb"[^A-Za-z0-9+/_.=%&#;:\\\x20\r\n\t\x00\x80-\xff'\"{}!()~@?-]")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}")
#: The same over line breaks, and a line of it.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{16,}(?:[ \t]*(?:\r\n?|\n)[ \t]*[A-Za-z0-9+/_-]+)+")
_LINE = re.compile(r"[A-Za-z0-9+/_-]+")
_GLUE = re.compile(r"[/_-]")
#: Printable UTF-8, and ASCII as UTF-16.
_UTF8 = re.compile(rb"(?:[\t-\r\x20-\x7e]|\xc2[\xa0-\xbf]|[\xc3-\xdf][\x80-\xbf]|(?!\xef\xbf\xbd)(?:\xe0[\xa0-\xbf]|\xed[\x80-\x9f]|[\xe1-\xec\xee\xef][\x80-\xbf])[\x80-\xbf]|(?:\xf0[\x90-\xbf]|[\xf1-\xf3][\x80-\xbf]|\xf4[\x80-\x8f])[\x80-\xbf]{2})++")
_UTF16LE, _UTF16BE = re.compile(rb"(?:[\t-\r\x20-\x7e]\x00){8,}"), re.compile(rb"(?:\x00[\t-\r\x20-\x7e]){8,}")


def scan(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, kind as an index into KINDS: leftmost and not overlapping within a kind."""
    found = []
    low = text.lower()
    if any(x in low for x in _CUE):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A decoded text; character i covers [starts[i], ends[i]) of the original text. Of compressed data all characters cover the same."""

    __slots__ = ("ends", "starts", "text")

    def __init__(self, text: str, starts: np.ndarray, ends: np.ndarray) -> None:
        self.text, self.starts, self.ends = text, starts, ends

    def key(self) -> tuple:
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), int(self.starts[0]), int(self.ends[-1])


def _codec(data: bytes):
    """What makes a decompressor of the stream that begins with the data, or null."""
    if data[:2] == b"\x1f\x8b" or (data[:1] == b"\x78" and len(data) > 2 and (data[0] * 256 + data[1]) % 31 == 0):
        return lambda: zlib.decompressobj(47)
    if data[:3] == b"BZh":
        return bz2.BZ2Decompressor
    if data[:6] == b"\xfd7zXZ\x00":
        return lzma.LZMADecompressor
    if data[:4] == b"\x28\xb5\x2f\xfd":
        return zstandard.ZstdDecompressor
    return None


class Feed:
    """Bytes in pieces, with a look at what comes next."""

    def __init__(self, pieces: Iterator[bytes]) -> None:
        self.pieces, self.held = pieces, b""
        self.read_out = False  # whether all that was fed was a stream, from its first byte to its last

    def peek(self, n: int) -> bytes:
        while len(self.held) < n and (more := next(self.pieces, b"")):
            self.held += more
        return self.held[:n]

    def read(self, n: int = PIECE) -> bytes:
        out = self.peek(n)
        self.held = self.held[n:]
        return out

    def push(self, data: bytes) -> None:
        self.held = data + self.held


def _inflated(feed: Feed) -> Iterator[bytes]:
    """Decompressed data of all members, a piece at a time; cut or broken data end where they are."""
    while make := _codec(feed.peek(6)):
        try:
            member = make()
            if hasattr(member, "stream_reader"):
                reader = member.stream_reader(feed, read_across_frames=True)
                while got := reader.read(PIECE):
                    yield got
                    feed.read_out = not feed.peek(1)
                return
            while not member.eof:
                data = getattr(member, "unconsumed_tail", b"") or (feed.read() if getattr(member, "needs_input", True) else b"")
                if not data and getattr(member, "needs_input", True):
                    return
                if got := member.decompress(data, PIECE):
                    yield got
            feed.push(member.unused_data)
            while feed.peek(1) == b"\0":
                feed.read(1)
            feed.read_out = not feed.peek(1)
        except Exception:  # whatever a codec raises on data that only looks compressed
            return


def _unpacked(data: bytes) -> tuple[Feed, Feed] | None:
    """The data, and what they hold, however often they are compressed; null if they aren't. Data that hold themselves end there."""
    first = feed = Feed(iter((data,)))
    seen = set()
    while _codec(head := feed.peek(1 << 12)) and head not in seen and len(seen) < DEEPEST:
        seen.add(head)
        feed = Feed(_inflated(feed))
    return (first, feed) if seen else None


def _windows(feed: Feed) -> Iterator[bytes]:
    """The data in windows that end between runs that might be an escape, base64 or a secret; a run of more than LONGEST is cut."""
    held, size = [], 0
    while more := feed.read():
        cut = 0
        if size + len(more) >= WINDOW:
            ends = [m.end() for m in _BETWEEN.finditer(more)]
            cut = ends[-1] if ends else len(more) * (size >= LONGEST)
        if cut:
            yield b"".join([*held, more[:cut]])
            held, size, more = [], 0, more[cut:]
        held.append(more)
        size += len(more)
    if size:
        yield b"".join(held)


def _printable(data: bytes) -> Iterator[tuple[int, int, str]]:
    """(begin, end, text) of the readable parts of data: UTF-8, or ASCII as UTF-16."""
    for m in _UTF8.finditer(data):
        if len(m[0]) >= 12:
            yield *m.span(), m[0].decode()
    if b"\0" in data:
        for pattern, name in ((_UTF16LE, "utf-16-le"), (_UTF16BE, "utf-16-be")):
            for m in pattern.finditer(data):
                yield *m.span(), m[0].decode(name)


Place = Callable[[np.ndarray], np.ndarray]


def _opened(layer: Layer, data: bytes, begin: Place, end: Place) -> Iterator[Layer]:
    """Layers in decoded data; byte i comes from characters [begin(i), end(i)) of `layer`. What compressed data hold maps to the whole stretch that held them."""
    if (both := _unpacked(data)) is not None:
        first, feed = both
        edge = np.array([0, len(data) - 1])
        low, high = layer.starts[begin(edge)[0]], layer.ends[end(edge)[1] - 1]
        for window in _windows(feed):
            for _, _, text in _printable(window):
                yield Layer(text, np.broadcast_to(low, len(text)), np.broadcast_to(high, len(text)))
        if first.read_out:
            return
    for a, e, text in _printable(data):
        part = np.frombuffer(data, np.uint8, e - a, a)
        first = np.flatnonzero((part & 0xC0) != 0x80) if e - a != 2 * len(text) or text.isascii() and 0 not in part else np.arange(0, e - a, 2)
        last = np.concatenate([first[1:], [e - a]]) - 1
        yield Layer(text, layer.starts[begin(a + first)], layer.ends[end(a + last) - 1])


def _inline(layer: Layer, pattern: re.Pattern, decode) -> Layer | None:
    """The layer with every match of the pattern replaced by what it stands for."""
    parts, starts, ends, at = [], [], [], 0
    for m in pattern.finditer(layer.text):
        got = decode(m)
        if got is None:
            continue
        parts.append(layer.text[at : m.start()])
        starts.append(layer.starts[at : m.start()])
        ends.append(layer.ends[at : m.start()])
        text, spans = got
        parts.append(text)
        starts.append(np.array([layer.starts[s] for s, _ in spans], np.int64))
        ends.append(np.array([layer.ends[e - 1] for _, e in spans], np.int64))
        at = m.end()
    if not parts:
        return None
    text = "".join([*parts, layer.text[at:]])
    return Layer(text, np.concatenate([*starts, layer.starts[at:]]), np.concatenate([*ends, layer.ends[at:]])) if text else None


def _url(m: re.Match) -> tuple[str, list[tuple[int, int]]]:
    """UTF-8, and bytes that aren't as Latin-1."""
    data = bytes.fromhex(m[0].replace("%", ""))
    text = data.decode("utf-8", "surrogateescape")
    at = np.cumsum([0, *(1 if 0xDC80 <= ord(c) <= 0xDCFF else len(c.encode()) for c in text)]).tolist()
    text = "".join(chr(ord(c) & 0xFF) if 0xDC80 <= ord(c) <= 0xDCFF else c for c in text)
    return text, [(m.start() + 3 * a, m.start() + 3 * b) for a, b in zip(at, at[1:], strict=False)]


def _escape(m: re.Match) -> tuple[str, list[tuple[int, int]]] | None:
    hexed = next((x for x in m.groups()[:5] if x), None)
    code = ord(_NAMED[m[8]]) if m[8] else int(hexed, 16) if hexed else int(m[6]) if m[6] else int(m[7], 8)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return chr(code), [(m.start(), m.end())]


def unwrap(layer: Layer) -> Iterator[Layer]:
    """All layers one step below: the URL-decoded and the unescaped text, and what each base64 run or compressed URL run holds."""
    text = layer.text
    chain = _inline(layer, _CHAIN, lambda m: (m[0][0], [m.span()])) if _CHAIN.search(text) else None
    if chain:
        yield chain
    if "%" in text:
        if not chain and (out := _inline(layer, _URL, _url)):
            yield out
        for m in _URL_MAGIC.finditer(text):  # compressed data, of which only some bytes need an escape
            run = _URL_RUN.match(text, m.start())
            parts = list(_URL_BYTE.finditer(run[0]))
            data = bytes(int(x[0][1:], 16) if x[0][0] == "%" else ord(x[0]) for x in parts)
            if _unpacked(data) is not None:
                at = np.array([m.start() + x.start() for x in parts] + [run.end()])
                yield from _opened(layer, data, at.__getitem__, lambda i, at=at: at[i + 1])
    if not chain and ("\\" in text or "&" in text or "%u" in text) and (out := _inline(layer, _ESCAPE, _escape)):
        yield out
    for m in _BASE64.finditer(text):
        yield from _base64(layer, m[0], np.arange(*m.span()), [0])
    if "\n" in text or "\r" in text:
        for m in _WRAPPED.finditer(text):
            lines = [(m.start() + x.start(), x[0]) for x in _LINE.finditer(m[0])]
            begins = np.cumsum([0, *(len(x) for _, x in lines[:-1])]).tolist()
            yield from _base64(layer, "".join(x for _, x in lines), np.concatenate([np.arange(a, a + len(x)) for a, x in lines]), begins)


def _base64(layer: Layer, run: str, at: np.ndarray, begins: list[int]) -> Iterator[Layer]:
    """Layers in a run, character i of which is character at[i] of `layer`: it begins at one of `begins` or behind a / - or _, and ends anywhere."""
    shifts: dict[int, list[int]] = {}
    for b in [*begins, *(m.end() for m in _GLUE.finditer(run))]:
        if len(run) - b >= SHORTEST:
            shifts.setdefault(b % 4, []).append((b - b % 4) // 4 * 3)
    run = run.translate({45: 43, 95: 47})
    for shift, starts in shifts.items():
        n = len(run) - shift
        n -= n % 4 == 1
        data = base64.b64decode(run[shift : shift + n] + "=" * (-n % 4))
        begin = lambda i, shift=shift: at[shift + i * 8 // 6]
        end = lambda i, shift=shift: at[shift + (i * 8 + 7) // 6] + 1
        for i in starts:
            if _codec(data[i : i + 6]):
                yield from _opened(layer, data[i:], lambda k, i=i, f=begin: f(k + i), lambda k, i=i, f=end: f(k + i))
        for a, e, _ in _printable(data):
            yield from _opened(layer, data[a:e], lambda k, a=a, f=begin: f(k + a), lambda k, a=a, f=end: f(k + a))


_MAY_UNWRAP = re.compile(r"%[0-9A-Fa-fu]|\\[uUx0-3]|&[#a-z]|[A-Za-z0-9+/_-]{16}")


def find_secrets(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans, each (start, kind, end), sorted."""
    base = sorted(scan(text))
    if not _MAY_UNWRAP.search(text):
        return base, base
    found = set(base)
    at = np.arange(len(text))
    work, seen = [Layer(text, at, at + 1)], set()
    while work:
        for layer in unwrap(work.pop()):
            if (key := layer.key()) in seen:
                continue
            seen.add(key)
            found |= {(int(layer.starts[s]), k, int(layer.ends[e - 1])) for s, k, e in scan(layer.text)}
            work.append(layer)
    return base, sorted(found)


def spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def redact(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with every covered stretch replaced by one mark; overlapping spans become one."""
    parts, at = [], 0
    for s, k, e in spans:
        if s >= at:
            parts += [text[at:s], f"[{KINDS[k]}]"]
        at = max(at, e)
    return "".join([*parts, text[at:]])


SPANS = "array<struct<kind: string, start: int, end: int>>"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base_spans, spans): the spans as arrays of kind, start and end, for use downstream."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            both = [find_secrets(t) for t in as_texts(batch.column("text"))]
            as_rows = lambda x: [{"kind": KINDS[k], "start": s, "end": e} for s, k, e in x]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array([as_rows(x[i]) for x in both], kind) for i in (0, 1))], ["doc_id", "base_spans", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, base_spans {SPANS}, spans {SPANS}")


def redact_secrets(docs: DataFrame) -> DataFrame:
    """docs with every secret in `text` replaced by its kind in brackets, and n_chars, where there is one, counted anew. Null texts stay null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = [None if t is None else redact(t, find_secrets(t)[1]) for t in batch.column("text").to_pylist()]
            fresh = {"text": texts, "n_chars": [None if t is None else len(t) for t in texts]}
            yield pa.RecordBatch.from_arrays([pa.array(fresh[f.name], f.type) if f.name in fresh else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base_spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    joined = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return found.select("doc_id", *(count(k) for k in KINDS), F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))
