"""Operator 9, media columns: Netpbm and BMP decoded to numpy arrays, area-resized by integral images, written as NPY tiles with difference hashes.

`media_features(df, column)` decodes a binary column of images; `text_media(docs)` stores texts losslessly as grey
Netpbm images and reads them back. Both are one pass without a shuffle, so neither skew nor repeated rows matter.

Defined cases: a null text is the empty text (64 zero bytes); null or undecodable media give null features and the
error; repeated rows give repeated results; texts of any length become one image; other columns of the input are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.llm.common import as_bytes, chunks, read_table, to_batch

WIDTH = 64
TILE = 32
_HEADER = re.compile(rb"(P[1-6])(?:\s|#[^\n]*\n)+(\d+)(?:\s|#[^\n]*\n)+(\d+)")
_MAXVAL = re.compile(rb"(?:\s|#[^\n]*\n)+(\d+)")


def encode_pgm(img: np.ndarray) -> bytes:
    """8-bit grey Netpbm (P5)."""
    return b"P5\n%d %d\n255\n" % (img.shape[1], img.shape[0]) + img.tobytes()


def encode_bmp(img: np.ndarray) -> bytes:
    """8-bit grey BMP with a palette, rows from the bottom, padded to four bytes."""
    h, w = img.shape
    stride = (w + 3) // 4 * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, :w] = img[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, axis=1)
    palette[:, 3] = 0
    at = 54 + 1024
    head = b"BM" + struct.pack("<IHHI", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8, 0, rows.size, 2835, 2835, 256, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """(h, w) or (h, w, 3) array of P1 to P6; 16-bit samples stay 16 bits."""
    m = _HEADER.match(data)
    if not m:
        raise ValueError("not a Netpbm header")
    kind, w, h = m[1], int(m[2]), int(m[3])
    at, top = m.end(), 1
    if kind not in (b"P1", b"P4"):
        m = _MAXVAL.match(data, at)
        if not m or not 0 < int(m[1]) < 65536:
            raise ValueError("bad maxval")
        at, top = m.end(), int(m[1])
    depth = 3 if kind in (b"P3", b"P6") else 1
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n]*", b"", data[at:])
        samples = np.frombuffer(re.sub(rb"\s", b"", body), np.uint8)[: w * h] - 48 if kind == b"P1" else np.array(body.split()[: w * h * depth], dtype=np.int64)
        if kind == b"P1":
            samples, top = (1 - samples) * 255, 255
        out = samples.astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        rows = np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1)
        out = (1 - np.unpackbits(rows, axis=1)[:, :w]) * np.uint8(255)
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", w * h * depth, at + 1)
    if out.size != w * h * depth:
        raise ValueError("too few samples")
    return out.reshape((h, w, 3) if depth == 3 else (h, w))


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 8 bits (grey or palette), 24 or 32 bits."""
    at, head = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    w, h, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if bits not in (8, 24, 32) or packing != 0 or w <= 0 or h == 0:
        raise ValueError("a BMP of this kind is not supported")
    stride = (w * bits // 8 + 3) // 4 * 4
    rows = np.frombuffer(data, np.uint8, stride * abs(h), at).reshape(abs(h), stride)
    rows = rows[::-1] if h > 0 else rows
    if bits == 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + head).reshape(-1, 4)
        if (palette[:, 0] == palette[:, 1]).all() and (palette[:, 1] == palette[:, 2]).all():
            return palette[:, 0][rows[:, :w]]
        return palette[:, 2::-1][rows[:, :w]]
    return rows[:, : w * bits // 8].reshape(abs(h), w, bits // 8)[:, :, 2::-1]


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(img: np.ndarray) -> np.ndarray:
    """Luma of colour images by the integer weights 299, 587 and 114 in 1000."""
    return img if img.ndim == 2 else (img.astype(np.int64) @ np.array([299, 587, 114]) // 1000)


def _prefix(img: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Rows of the integral image's first axis at fractional positions: sums of all rows before each cut."""
    whole = np.floor(cuts).astype(np.int64)
    if img.shape[0] <= 4096:
        sums = np.zeros((img.shape[0] + 1, *img.shape[1:]), np.int64)
        np.cumsum(img, axis=0, dtype=np.int64, out=sums[1:])
        at = sums[whole]
    else:  # a long image: only the sums at the cuts are kept
        starts = np.unique(np.concatenate([[0], whole[whole < img.shape[0]]]))
        part = np.concatenate([np.zeros((1, *img.shape[1:]), np.int64), np.cumsum(np.add.reduceat(img, starts, axis=0, dtype=np.int64), axis=0)])
        at = part[np.searchsorted(starts, whole)]
    rest = (cuts - whole)[:, None]
    return at + rest * img[np.minimum(whole, img.shape[0] - 1)]


def area_resize(img: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of the source area under each target sample, from the integral image read at fractional corners."""
    h, w = img.shape
    rows = _prefix(img, np.arange(height + 1) * (h / height))
    columns = np.concatenate([np.zeros((height, 1)), np.cumsum(np.diff(rows, axis=0), axis=1)], axis=1)
    cuts = np.arange(width + 1) * (w / width)
    whole = np.floor(cuts).astype(np.int64)
    step = np.diff(columns, axis=1)
    both = columns[:, whole] + (cuts - whole) * step[:, np.minimum(whole, w - 1)]
    return np.diff(both, axis=1) / ((h / height) * (w / width))


def difference_hash(img: np.ndarray) -> str:
    """64 bits: is each sample of the 8 x 9 reduction brighter than its right neighbour."""
    small = np.round(area_resize(img, 8, 9), 6)
    return np.packbits(small[:, :-1] > small[:, 1:]).tobytes().hex()


def npy_tile(img: np.ndarray, size: int = TILE) -> bytes:
    out = io.BytesIO()
    np.save(out, np.clip(np.rint(area_resize(img, size, size)), 0, 65535).astype(np.uint8 if img.dtype == np.uint8 else np.uint16))
    return out.getvalue()


FEATURES = "height int, width int, channels int, dhash string, tile binary, error string"


def media_features(df: DataFrame, key: str, column: str, size: int = TILE) -> DataFrame:
    """Decode a binary column of Netpbm or BMP images: shape, difference hash and a `size` x `size` NPY tile. Rows with null media stay, with nulls."""
    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, {FEATURES}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, column):
            rows = []
            for data in batch.column(column).to_pylist():
                try:
                    img = decode(bytes(data)) if data is not None else None
                    if img is None or not img.size:
                        raise ValueError("no image")
                    flat = grey(img)
                    rows.append((*img.shape[:2], img.shape[2] if img.ndim == 3 else 1, difference_hash(flat), npy_tile(flat, size), None))
                except (ValueError, struct.error, OverflowError, IndexError) as e:
                    rows.append((None, None, None, None, None, str(e)))
            names = ["height", "width", "channels", "dhash", "tile", "error"]
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column(key), *(pa.array([r[i] for r in rows], kinds[i]) for i in range(6))], [key, *names])

    return df.select(key, column).mapInArrow(run, schema)


TEXT_MEDIA = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("tile", pa.binary())])


def text_media(docs: DataFrame, fmt: str = "pgm") -> DataFrame:
    """Store each text as an 8-bit grey image of 64 columns (`fmt` pgm or bmp), read the stored bytes back, and hash what was read.

    One row per row of docs. `feature` is the difference hash and the mean sample; `tile` is the NPY tile.
    """
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[fmt]

    def one(text: bytes) -> tuple:
        padded = text + bytes(-len(text) % WIDTH or (0 if text else WIDTH))
        stored = encode(np.frombuffer(padded, np.uint8).reshape(-1, WIDTH))
        img = decode(stored)
        payload = img.tobytes()
        tile = npy_tile(img)
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{difference_hash(img)}:{int(img.sum(dtype=np.int64)) / img.size:.4f}", tile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            rows = [one(x) for x in as_bytes(batch.column("text"))]
            yield to_batch(TEXT_MEDIA, {"doc_id": batch.column("doc_id")} | {f.name: [r[i] for r in rows] for i, f in enumerate(list(TEXT_MEDIA)[1:])})

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = text_media(read_table(spark, sf_dir, "documents"))
    return found.withColumns({"tile_bytes": F.octet_length("tile").cast("long"), "tile_sha256": F.sha2("tile", 256)}).drop("tile")
