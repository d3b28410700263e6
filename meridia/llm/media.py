"""Media columns: Netpbm and BMP decoded to numpy arrays, resized, tiled, hashed.

``decode`` reads PBM, PGM and PPM, plain and raw, of 8 or 16 bits, and
uncompressed BMP of 1, 4, 8, 24 or 32 bits. ``area_resize`` averages over exact
areas by an integral image, ``npy_tiles`` cuts an array to tiles and serialises
each as NPY, ``difference_hash`` compares neighbours of a small resized image.

``media_of_texts`` stores any text losslessly as a raw PGM of 8-bit samples, 64
to a row, and as a BMP of 8-bit grey samples, reads both back, which have to be the
same, and computes the features of what was read: the difference hash, all of its NPY
tiles, and an area-resized thumbnail as one more NPY tile.

Edge cases: a null text counts as an empty one; its payload is one row of zero
bytes. Very long texts give tall images: one document is in memory at a time.
Equal texts give equal values. A broken image, and one whose header promises more than
its bytes can hold, gives null columns in
``decode_column``, never an error. Rows are worked on one by one, an empty
table gives an empty result, and only the named columns are read.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridia.llm.common import lean

WIDTH = 64
HASH_SIDE = 8

_SPACE = b" \t\n\v\f\r"
_GREYS = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4).tobytes()


def _header(data: bytes, fields: int) -> tuple[list[int], int]:
    """Whole numbers after a Netpbm magic, comments skipped; the offset after them."""
    out, at = [], 2
    while len(out) < fields:
        while at < len(data) and (data[at] in _SPACE or data[at : at + 1] == b"#"):
            if data[at : at + 1] == b"#":
                end = data.find(b"\n", at)
                at = len(data) if end < 0 else end
            at += 1
        start = at
        while at < len(data) and 48 <= data[at] <= 57:
            at += 1
        if start == at:
            raise ValueError("broken Netpbm header")
        out.append(int(data[start:at]))
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """(rows, columns, channels) of samples; PBM's 1 (black) becomes 0 and its 0 becomes 255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm image")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    numbers, at = _header(data, 2 if bitmap else 3)
    width, height, peak = *numbers[:2], 1 if bitmap else numbers[2]
    if not 0 < peak < 65536:
        raise ValueError("broken Netpbm peak")
    n = width * height * channels
    if kind == b"P4":
        stride = (width + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, stride * height, at + 1).reshape(height, stride), axis=1)
        return ((1 - bits[:, :width]) * 255).astype(np.uint8)[:, :, None]
    if kind == b"P1":
        digits = np.frombuffer(data, np.uint8, offset=at)
        flat = digits[(digits == 48) | (digits == 49)][:n] - 48
        flat = ((1 - flat) * 255).astype(np.uint8)
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[:n], dtype=np.uint16 if peak > 255 else np.uint8)
    elif peak > 255:
        flat = np.frombuffer(data, ">u2", n, at + 1).astype(np.uint16)
    else:
        flat = np.frombuffer(data, np.uint8, n, at + 1)
    if len(flat) != n:
        raise ValueError("short Netpbm image")
    return flat.reshape(height, width, channels)


def encode_pgm(samples: np.ndarray) -> bytes:
    """A raw PGM (P5) of 8-bit samples."""
    height, width = samples.shape[:2]
    return b"P5\n%d %d\n255\n" % (width, height) + samples.astype(np.uint8, copy=False).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """(rows, columns, 3) of an uncompressed BMP, top row first, red first."""
    if data[:2] != b"BM" or len(data) < 54:
        raise ValueError("no BMP image")
    offset, size, width, height, _, depth, compression, _, _, _, colours = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    if depth not in {0: (1, 4, 8, 16, 24, 32), 3: (16, 32)}.get(compression, ()) or width <= 0 or height == 0:
        raise ValueError("BMP kind not supported")
    rows, stride = abs(height), (width * depth + 31) // 32 * 4
    raw = np.frombuffer(data, np.uint8, stride * rows, offset).reshape(rows, stride)
    raw = raw[::-1] if height > 0 else raw
    if compression == 3 or depth == 16:
        # fields of bits: those that the file names after the header, or five bits a colour
        masks = struct.unpack_from("<III", data, 54) if compression == 3 else (0x7C00, 0x03E0, 0x001F)
        return _fields(raw[:, : width * depth // 8].copy().view(f"<u{depth // 8}"), masks)
    if depth >= 24:
        return raw[:, : width * depth // 8].reshape(rows, width, depth // 8)[:, :, 2::-1]
    if depth == 8:
        index = raw[:, :width]
    else:
        bits = np.unpackbits(raw, axis=1).reshape(rows, -1, depth)[:, :width]
        index = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2)
    palette = np.frombuffer(data, np.uint8, 4 * (colours or 1 << depth), 14 + size).reshape(-1, 4)
    return palette[index][:, :, 2::-1]


def _fields(pixels: np.ndarray, masks: tuple[int, ...]) -> np.ndarray:
    """(rows, columns, 3) of 8 bits from each pixel's fields; a mask of 0 is black."""
    out = np.zeros((*pixels.shape, 3), np.uint8)
    for i, mask in enumerate(masks):
        low = mask & -mask
        if low:
            most = mask // low
            if most & (most + 1):
                raise ValueError("a BMP mask has gaps")
            out[:, :, i] = ((pixels & mask) // low * 255 + most // 2) // most
    return out


def encode_bmp(samples: np.ndarray) -> bytes:
    """A 24-bit BMP, bottom row first."""
    height, width = samples.shape[:2]
    three = np.repeat(samples.reshape(height, width, -1)[:, :, :1], 3, axis=2) if samples.ndim == 2 or samples.shape[2] == 1 else samples
    stride = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, : width * 3] = three[::-1, :, ::-1].reshape(height, width * 3)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def encode_grey_bmp(samples: np.ndarray) -> bytes:
    """An 8-bit BMP of grey samples (rows, columns) with a palette of 256 greys, bottom row first."""
    height, width = samples.shape
    stride = (width + 3) // 4 * 4
    rows = np.zeros((height, stride), np.uint8)
    rows[:, :width] = samples[::-1]
    head = struct.pack("<2sIHHI", b"BM", 54 + 1024 + rows.size, 0, 0, 54 + 1024)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, rows.size, 2835, 2835, 256, 0) + _GREYS + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def grey(samples: np.ndarray) -> np.ndarray:
    """Rows by columns: the mean of the channels."""
    return samples[:, :, 0] if samples.shape[2] == 1 else samples.mean(axis=2)


def _edges(samples: np.ndarray, n: int, axis: int) -> np.ndarray:
    """The integral along ``axis``, read at ``n`` + 1 equal steps, between whole samples linearly."""
    size = samples.shape[axis]
    at = np.linspace(0, size, n + 1)
    low = np.minimum(at.astype(np.int64), size - 1)
    part = (at - low).reshape([-1 if k == axis else 1 for k in range(samples.ndim)])
    total = np.cumsum(samples, axis=axis, dtype=np.float64)
    total = np.concatenate([np.zeros_like(np.take(total, [0], axis)), total], axis=axis)
    first = np.take(total, low, axis)
    return first + part * (np.take(total, low + 1, axis) - first)


def area_resize(samples: np.ndarray, height: int, width: int) -> np.ndarray:
    """Means over exact areas of a two-dimensional array, by its integral image.

    The integral image is bilinear between whole samples, so reading it along
    one axis and then along the other equals reading it in two dimensions.
    """
    if min(samples.shape) < 1:
        raise ValueError("empty image")
    down = np.diff(_edges(samples, height, 0), axis=0)
    both = np.diff(_edges(down, width, 1), axis=1)
    return both / (samples.shape[0] / height * samples.shape[1] / width)


def difference_hash(samples: np.ndarray, side: int = HASH_SIDE) -> str:
    """side * side bits, 1 where a cell of the resized image is darker (by more than rounding) than the next to its right."""
    small = area_resize(samples, side, side + 1)
    return np.packbits(small[:, :-1] + 1e-6 < small[:, 1:]).tobytes().hex()


def npy_tiles(samples: np.ndarray, side: int = WIDTH) -> Iterator[tuple[int, int, bytes]]:
    """(tile row, tile column, NPY bytes) of each tile; those at the edges may be smaller."""
    for y in range(0, samples.shape[0], side):
        for x in range(0, samples.shape[1], side):
            out = io.BytesIO()
            np.save(out, np.ascontiguousarray(samples[y : y + side, x : x + side]), allow_pickle=False)
            yield y // side, x // side, out.getvalue()


def payload_of(text: str) -> tuple[int, np.ndarray]:
    """Unpadded length in bytes, and rows of 64 bytes: UTF-8, filled up with zero bytes."""
    raw = text.encode("utf-8", "replace")
    rows = max(1, -(-len(raw) // WIDTH))
    return len(raw), np.frombuffer(raw.ljust(rows * WIDTH, b"\0"), np.uint8).reshape(rows, WIDTH)


def tiles_digest(samples: np.ndarray) -> tuple[int, str]:
    """How many tiles ``npy_tiles`` writes, and a digest of their bytes in order."""
    n, digest = 0, hashlib.sha256()
    for _, _, npy in npy_tiles(samples):
        digest.update(npy)
        n += 1
    return n, digest.hexdigest()


def _digest(text: str) -> tuple:
    n, rows = payload_of(text)
    media, bmp = encode_pgm(rows), encode_grey_bmp(rows)
    back = grey(decode(media))
    if not (decode(bmp) == back[:, :, None]).all():
        raise AssertionError("the BMP doesn't hold what the PGM holds")
    payload = back.tobytes()
    tile = area_resize(back, HASH_SIDE, HASH_SIDE).round().astype(np.uint8)
    feature = f"{difference_hash(back)}:{hashlib.sha256(next(npy_tiles(tile))[2]).hexdigest()[:16]}"
    return (
        n,
        len(payload),
        hashlib.sha256(payload).hexdigest(),
        zlib.crc32(payload[-WIDTH:]),
        len(media),
        hashlib.sha256(media).hexdigest(),
        feature,
        hashlib.sha256(bmp).hexdigest(),
        *tiles_digest(back),
    )


def decode_column(images: DataFrame, *, key: str, image: str, tile: int = WIDTH, size: tuple[int, int] | None = None) -> DataFrame:
    """NPY tiles of a column of Netpbm and BMP bytes: key, tile_row, tile_col, tile, dhash.

    ``size`` (rows, columns) area-resizes to grey first. An image that can't be
    decoded, a null one too, gives one row with null tile columns.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out: list[tuple] = []
                try:
                    samples = grey(decode(batch.column(1)[i].as_py() or b""))
                    hashed = difference_hash(samples)
                    samples = area_resize(samples, *size).round().astype(np.uint8) if size else samples
                    out = [(y, x, npy, hashed) for y, x, npy in npy_tiles(samples, tile)]
                except (ValueError, IndexError, OverflowError, MemoryError, struct.error):
                    out = [(None, None, None, None)]
                columns = [pa.array(x, t) for x, t in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                keys = pa.array([batch.column(0)[i].as_py()] * len(out), batch.column(0).type)
                yield pa.RecordBatch.from_arrays([keys, *columns], names=["key", "tile_row", "tile_col", "tile", "dhash"])

    kind = images.schema[key].dataType.simpleString()
    return images.select(key, image).mapInArrow(lean(work), f"key {kind}, tile_row int, tile_col int, tile binary, dhash string").withColumnRenamed("key", key)


def text_to_media(docs: DataFrame, *, key: str = "doc_id", text: str = "text", kind: str = "pgm") -> DataFrame:
    """key and media: every text stored losslessly as a PGM (or, grey, as a 24-bit BMP)."""
    encode = {"pgm": encode_pgm, "bmp": encode_bmp}[kind]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                media = encode(payload_of(batch.column(1)[i].as_py() or "")[1])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([media], pa.binary())], names=["key", "media"])

    return docs.select(key, text).mapInArrow(lean(work), f"key {docs.schema[key].dataType.simpleString()}, media binary").withColumnRenamed("key", key)


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, bmp_sha256 string, n_tiles long, tiles_sha256 string"
TYPES = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string())


def media_of_texts(docs: DataFrame, *, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of each text's stored image as read back, and its features."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [_digest(x.as_py() or "") for x in batch.column(1)]
            columns = zip(*rows) if rows else [[]] * len(TYPES)
            arrays = [pa.array(x, t) for x, t in zip(columns, TYPES, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(lean(work), SCHEMA)


def op10_media_columns(docs: DataFrame) -> DataFrame:
    return media_of_texts(docs)
