"""Media columns: Netpbm and BMP images as numpy arrays, area-resized tiles and difference hashes.

Images decode to (height, width, channels) uint8 arrays. Area resizing takes the mean of the source area under each
target cell, edges weighted by what they cover, from the integral image: its cost does not depend on the scale, and the
integral is run through in blocks of rows, of which only the rows at cell edges are kept. Tiles are stored in NPY form;
the difference hash compares neighbours of an 8 x 9 grey tile. `store_payloads` keeps any bytes losslessly as 8-bit grey
samples of a PGM image, with their tile beside them.

Null texts are empty ones. An image that is null, has no pixels or can't be read has nulls. Repeated rows stay, an empty
table gives an empty one, equal images have equal features, and a column that has the name of a new one gives way.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldlab.llm.common import bounded_batches, stage, steps, table

UNIT, WIDTH, TILE = 576, 24, 16
#: Samples of which sums are held at a time.
BLOCK_SAMPLES = 1_000_000
_SPACE = re.compile(rb"(?:\s|#[^\n\r]*[\n\r])+")


# --- formats


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 with comments; samples of other depths are scaled to 0..255."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("not a Netpbm image")
    at, numbers = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        space = _SPACE.match(data, at)
        token = re.compile(rb"\d+").match(data, space.end() if space else at)
        if not token:
            raise ValueError("a Netpbm header without its numbers")
        numbers.append(int(token.group()))
        at = token.end()
    (width, height), top = numbers[:2], numbers[2] if len(numbers) > 2 else 1
    if not 0 < top < 65_536:
        raise ValueError("a Netpbm image with a depth out of range")
    bands = 3 if kind in (b"P3", b"P6") else 1
    n = width * height * bands
    if kind in (b"P1", b"P2", b"P3"):
        body = re.sub(rb"#[^\n\r]*", b"", data[at:])
        digits = re.findall(rb"[01]" if kind == b"P1" else rb"\d+", body)
        samples = np.array(digits[:n], dtype=np.int64)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        samples = np.unpackbits(packed, axis=1)[:, :width].reshape(-1).astype(np.int64)
    else:
        samples = np.frombuffer(data, ">u2" if top > 255 else np.uint8, n, at + 1)
    if len(samples) < n:
        raise ValueError("a Netpbm image that ends early")
    samples = samples.reshape(height, width, bands)
    if kind in (b"P1", b"P4"):
        return ((1 - samples) * 255).astype(np.uint8)
    if top == 255:
        return samples.astype(np.uint8)
    return ((samples.astype(np.int64) * 510 + top) // (2 * top)).astype(np.uint8)


def encode_netpbm(image: np.ndarray) -> bytes:
    """P5 or P6 of a uint8 array."""
    height, width = image.shape[:2]
    bands = 1 if image.ndim == 2 else image.shape[2]
    return b"P%d\n%d %d\n255\n" % (6 if bands == 3 else 5, width, height) + np.ascontiguousarray(image).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits, bottom-up or top-down; palettes are resolved to RGB."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP image")
    start, size, width, height, _, bits, packing = struct.unpack_from("<IIiiHHI", data, 10)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("a BMP image of a kind that isn't read")
    down, height = height < 0, abs(height)
    row = (width * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * height, start).reshape(height, row)
    if bits <= 8:
        colours = struct.unpack_from("<I", data, 46)[0] or 1 << bits
        palette = np.frombuffer(data, np.uint8, 4 * colours, 14 + size).reshape(-1, 4)[:, 2::-1]
        if bits == 8:
            at = rows[:, :width]
        elif bits == 4:
            at = np.stack((rows >> 4, rows & 15), axis=2).reshape(height, -1)[:, :width]
        else:
            at = np.unpackbits(rows, axis=1)[:, :width]
        image = palette[at]
    else:
        image = rows[:, : width * bits // 8].reshape(height, width, bits // 8)[:, :, 2::-1]
    return np.ascontiguousarray(image if down else image[::-1])


def encode_bmp(image: np.ndarray) -> bytes:
    """24-bit bottom-up BMP of a uint8 array; grey is repeated in the three bands."""
    image = image.reshape(*image.shape[:2], -1)
    rgb = np.repeat(image, 3, axis=2) if image.shape[2] == 1 else image
    height, width = rgb.shape[:2]
    row = (width * 3 + 3) // 4 * 4
    rows = np.zeros((height, row), np.uint8)
    rows[:, : width * 3] = rgb[::-1, :, ::-1].reshape(height, -1)
    head = struct.pack("<2sIHHI", b"BM", 54 + rows.size, 0, 0, 54)
    return head + struct.pack("<IiiHHIIiiII", 40, width, height, 1, 24, 0, rows.size, 2835, 2835, 0, 0) + rows.tobytes()


def decode_image(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


# --- resizing and hashes


def _integral_rows(image: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The wanted rows (ascending, from 0) of the integral image, whose row r sums up the r rows above it."""
    rows, columns, bands = image.shape
    out = np.zeros((len(wanted), columns + 1, bands))
    held, block = np.zeros((columns, bands)), max(1, BLOCK_SAMPLES // (columns * bands))
    for a in range(0, rows, block):
        sums = np.cumsum(image[a : a + block], axis=0, dtype=np.float64)
        sums += held
        first, stop = np.searchsorted(wanted, [a + 1, a + len(sums) + 1])
        out[first:stop, 1:] = np.cumsum(sums[wanted[first:stop] - a - 1], axis=1)
        held = sums[-1]
    return out


def area_grids(image: np.ndarray, shapes: list[tuple[int, int]]) -> list[np.ndarray]:
    """Mean of the source area under each cell of height x width grids, as floats (height, width, channels); one pass."""
    image = image.reshape(*image.shape[:2], -1)
    rows, columns = image.shape[:2]
    if not image.size:
        raise ValueError("an image without pixels")

    def edges(cells: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The places of the cells' edges: a row and the share of the next one."""
        at = np.arange(cells + 1) * (size / cells)
        low = np.minimum(at.astype(np.int64), size - 1)
        return low, at - low

    down = [edges(height, rows) for height, _ in shapes]
    wanted = np.unique(np.concatenate([x for low, _ in down for x in (low, low + 1)]))
    total = _integral_rows(image, wanted)
    out = []
    for (height, width), (low, part) in zip(shapes, down):
        above, below = total[np.searchsorted(wanted, low)], total[np.searchsorted(wanted, low + 1)]
        strips = np.diff(above + (below - above) * part[:, None, None], axis=0)
        low, part = edges(width, columns)
        cells = np.diff(strips[:, low] + (strips[:, low + 1] - strips[:, low]) * part[:, None], axis=1)
        out.append(cells * (height * width / (rows * columns)))
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    return area_grids(image, [(height, width)])[0]


def _rounded(grid: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(grid), 0, 255).astype(np.uint8)


def _brighter(grid: np.ndarray) -> str:
    grey = grid.mean(axis=2)
    return np.packbits(grey[:, 1:] > grey[:, :-1] + 1e-9).tobytes().hex()


def tile(image: np.ndarray, side: int = TILE) -> np.ndarray:
    return _rounded(area_resize(image, side, side))


def difference_hash(image: np.ndarray) -> str:
    """16 hex digits: whether each cell of an 8 x 9 grey tile is brighter than its left neighbour."""
    return _brighter(area_resize(image, 8, 9))


def tile_and_hash(image: np.ndarray, side: int = TILE) -> tuple[bytes, str]:
    """The tile in NPY form and the difference hash, from one integral image."""
    square, wide = area_grids(image, [(side, side), (8, 9)])
    return to_npy(_rounded(square)), _brighter(wide)


def to_npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array, allow_pickle=False)
    return out.getvalue()


# --- Spark


def media_features(media: DataFrame, column: str = "media", side: int = TILE) -> DataFrame:
    """media's columns but the image, with height, width, tile (NPY bytes) and dhash. An image that is null or can't be
    read has nulls."""
    kept = [c for c in media.columns if c not in (column, "height", "width", "tile", "dhash")]
    bounded_batches(media.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for value in batch.column(len(kept)).to_pylist():
                try:
                    image = decode_image(value or b"")
                    rows.append((*image.shape[:2], *tile_and_hash(image, side)))
                except (ValueError, struct.error):
                    rows.append((None,) * 4)
            new = [pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.string()))]
            if rows:
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], *new], names=[*kept, *_FEATURES])

    schema = media.select(*kept).schema
    for name, kind in zip(_FEATURES, ("integer", "integer", "binary", "string")):
        schema = schema.add(name, kind)
    return media.select(*kept, column).mapInArrow(run, schema)


_FEATURES = ["height", "width", "tile", "dhash"]


def payload_image(text: str) -> tuple[int, bytes]:
    """UTF-8 bytes of a text, and the PGM of them and of bytes 255 up to a positive multiple of UNIT."""
    data = text.encode()
    payload = data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))
    return len(data), encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, WIDTH))


def store_payloads(docs: DataFrame, side: int = TILE) -> DataFrame:
    """doc_id, n_bytes, media, tile (NPY bytes), dhash of every text, written in the shared folder and read back."""
    bounded_batches(docs.sparkSession)
    names = ["doc_id", "n_bytes", "media", "tile", "dhash"]

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in steps(texts):
                made = [payload_image(t) for t in texts[a:b]]
                found = [tile_and_hash(decode_image(m), side) for _, m in made]
                new = [[n for n, _ in made], [m for _, m in made], *zip(*found)]
                kinds = (pa.int64(), pa.binary(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *[pa.array(x, t) for x, t in zip(new, kinds)]], names=names)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    made = texts.mapInArrow(run, "doc_id long, n_bytes long, media binary, tile binary, dhash string")
    return stage(made, "media", compression="zstd")


def payload_features(stored: DataFrame) -> DataFrame:
    """Digests of stored payloads, from the decoded image, and their feature: width x height, difference hash, and the
    checksum of the stored tile's samples."""
    bounded_batches(stored.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for media, small, dhash in zip(*(batch.column(k).to_pylist() for k in (2, 3, 4))):
                image = decode_image(media)
                payload = image.tobytes()
                samples = np.load(io.BytesIO(small), allow_pickle=False)
                rows.append(
                    (
                        len(payload),
                        hashlib.sha256(payload).hexdigest(),
                        zlib.crc32(payload[-32:]),
                        len(media),
                        hashlib.sha256(media).hexdigest(),
                        f"{image.shape[1]}x{image.shape[0]}:{dhash}:{zlib.crc32(samples.tobytes()):08x}",
                    )
                )
            if rows:
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                new = [pa.array(x, t) for x, t in zip(zip(*rows), types)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *new], names=_DIGESTS)

    return stored.select("doc_id", "n_bytes", "media", "tile", "dhash").mapInArrow(
        run,
        "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, "
        "media_sha256 string, feature string",
    )


_DIGESTS = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and features of the stored payloads of every whole text of `documents`."""
    return payload_features(store_payloads(table(spark, sf_dir, "documents")))
