"""Media columns: Netpbm and BMP decoded to numpy, resized by integral images, written as NPY tiles.

Images in a binary column are decoded to arrays of height x width x channels,
resized to a small tile by exact area averaging and written as NPY bytes with a
difference hash. Payloads of bytes can be stored as 8-bit grey images and read back.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathom.llm.stage import by_bytes

WIDTH = 64
TILE = 32
STRIP_ROWS = 4096

# Netpbm magic numbers as (channels, is plain text, is bitmap).
NETPBM = {
    b"P1": (1, True, True),
    b"P2": (1, True, False),
    b"P3": (3, True, False),
    b"P4": (1, False, True),
    b"P5": (1, False, False),
    b"P6": (3, False, False),
}
_FIELD = re.compile(rb"(?:\s|#[^\r\n]*[\r\n])+(\d+)")


def encode_pgm(samples: np.ndarray) -> bytes:
    """A height x width array of bytes as binary PGM."""
    height, width = samples.shape
    return b"P5\n%d %d\n255\n" % (width, height) + samples.tobytes()


def encode_bmp(samples: np.ndarray) -> bytes:
    """A height x width array of bytes as an 8-bit BMP with a grey palette, rows from below."""
    height, width = samples.shape
    row = (width + 3) // 4 * 4
    pixels = np.zeros((height, row), np.uint8)
    pixels[:, :width] = samples[::-1]
    start = 14 + 40 + 1024
    grey = np.arange(256, dtype=np.uint8)
    palette = np.column_stack([grey, grey, grey, np.zeros_like(grey)]).tobytes()
    head = struct.pack("<2sIHHI", b"BM", start + pixels.size, 0, 0, start)
    info = struct.pack("<IiiHHIIiiII", 40, width, height, 1, 8, 0, pixels.size, 2835, 2835, 256, 256)
    return head + info + palette + pixels.tobytes()


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as height x width x channels; 16-bit samples where the maximum is over 255. Bitmaps: 1 is black, 0."""
    channels, plain, bitmap = NETPBM[data[:2]]
    at, fields = 2, []
    while len(fields) < (2 if bitmap else 3):
        m = _FIELD.match(data, at)
        if not m:
            raise ValueError("bad Netpbm header")
        fields.append(int(m[1]))
        at = m.end()
    width, height = fields[:2]
    most = 1 if bitmap else fields[2]
    if not (width and height and 0 < most < 65536):
        raise ValueError("no pixels, or no such samples")
    kind = np.dtype(np.uint8 if most < 256 else ">u2")
    n = width * height * channels
    if n > 8 * len(data):  # not even a bit for each sample
        raise ValueError("short Netpbm image")
    if plain:
        body = re.sub(rb"#[^\r\n]*", b"", data[at:])
        values = [int(x) for x in (re.findall(rb"[01]", body) if bitmap else body.split())[:n]]
        if values and not 0 <= min(values) <= max(values) <= most:
            raise ValueError("sample beyond the maximum")
        out = np.array(values, np.uint8 if most < 256 else np.uint16)
    elif bitmap:
        rows = np.frombuffer(data, np.uint8, (width + 7) // 8 * height, at + 1).reshape(height, -1)
        out = np.unpackbits(rows, axis=1)[:, :width].ravel()
    else:
        out = np.frombuffer(data, kind, n, at + 1)
    if len(out) < n:
        raise ValueError("short Netpbm image")
    out = out.reshape(height, width, channels)
    return 1 - out if bitmap else out.astype(kind.newbyteorder("="), copy=False)


def decode_bmp(data: bytes) -> np.ndarray:
    """Uncompressed BMP of 1, 4, 8, 24 or 32 bits as height x width x channels; grey palettes give one channel."""
    if len(data) < 54:
        raise ValueError("short BMP header")
    start, size = struct.unpack_from("<I", data, 10)[0], struct.unpack_from("<I", data, 14)[0]
    width, height, _, bits, packing = struct.unpack_from("<iiHHI", data, 18)
    if packing not in (0, 3) or bits not in (1, 4, 8, 24, 32) or width <= 0 or not height:
        raise ValueError("unsupported BMP")
    row = (width * bits + 31) // 32 * 4
    if start + row * abs(height) > len(data):
        raise ValueError("short BMP image")
    rows = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    rows = rows[::-1] if height > 0 else rows
    if bits >= 24:
        return rows[:, : width * bits // 8].reshape(abs(height), width, bits // 8)[:, :, 2::-1]
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(-1, 4)[:, 2::-1]
    if bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(abs(height), -1, bits)
        rows = (parts << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=2, dtype=np.uint8)
    index = rows[:, :width]
    if index.max() >= len(palette):
        raise ValueError("pixel beyond the palette")
    if (palette == palette[:, :1]).all():
        grey = np.ascontiguousarray(palette[:, 0])
        return (index if np.array_equal(grey, np.arange(len(grey))) else grey[index])[:, :, None]
    return palette[index]


#: What a broken image raises when it is decoded.
BROKEN = (ValueError, KeyError, IndexError, OverflowError, struct.error)


def decode(data: bytes) -> np.ndarray:
    if data[:2] in NETPBM:
        return decode_netpbm(data)
    if data[:2] == b"BM":
        return decode_bmp(data)
    raise ValueError("neither Netpbm nor BMP")


def _integral_at(image: np.ndarray, parts: int) -> np.ndarray:
    """parts * the integral over rows up to k * height / parts, for k from 0 to parts, exactly.

    The running sums are kept for a strip of rows at a time.
    """
    height = len(image)
    out = np.zeros((parts + 1, *image.shape[1:]), np.int64)
    total = np.zeros(image.shape[1:], np.int64)
    for top in range(0, height, STRIP_ROWS):
        strip = image[top : top + STRIP_ROWS].astype(np.int64)
        sums = np.concatenate([total[None], total + np.cumsum(strip, axis=0)])
        for k in range(-(-top * parts // height), (top + len(strip)) * parts // height + 1):
            row, rest = divmod(k * height, parts)
            row -= top
            if 0 <= row < len(strip):
                out[k] = parts * sums[row] + rest * strip[row]
            elif row == len(strip):
                out[k] = parts * sums[row]
        total = sums[-1]
    return out


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """image resized to height x width by area averages, as float64; enlarging repeats pixels by area."""
    bands = np.diff(_integral_at(image, height), axis=0)
    cells = np.diff(_integral_at(bands.swapaxes(0, 1), width), axis=0).swapaxes(0, 1)
    return cells / (image.shape[0] * image.shape[1])


def difference_hash(image: np.ndarray) -> str:
    """64 bits, as hex: whether each of 8 x 8 area averages is below its right neighbour."""
    small = area_resize(image, 8, 9).sum(axis=2)
    return np.packbits(small[:, :-1] < small[:, 1:]).tobytes().hex()


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile_of(data: bytes, size: int = TILE) -> tuple[bytes, str]:
    """The NPY tile (size x size x channels, rounded to the image's own kind) and the difference hash of an image."""
    image = decode(data)
    tile = np.rint(area_resize(image, size, size)).astype(image.dtype)
    return npy(tile), difference_hash(image)


def tiles(media: DataFrame, media_col: str = "media", size: int = TILE) -> DataFrame:
    """media with tile (NPY bytes) and dhash; both null where the image is null, empty or can't be decoded.

    An image without pixels, or with pixels beyond its palette, can't be decoded.
    Rows stay in their partitions. Columns with these two names are replaced.
    """
    rest = [c for c in media.columns if c.lower() not in ("tile", "dhash")]
    frame = media.select(*rest)
    at = rest.index(media_col)
    schema = frame.withColumn("tile", F.lit(None).cast("binary")).withColumn("dhash", F.lit(None).cast("string")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            made = []
            for data in batch.column(at).to_pylist():
                try:
                    made.append(tile_of(data, size) if data else (None, None))
                except BROKEN:
                    made.append((None, None))
            extra = [pa.array([m[i] for m in made], kind) for i, kind in ((0, pa.binary()), (1, pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*rest, "tile", "dhash"])

    return frame.mapInArrow(run, schema)


def payload_of(text: bytes | None) -> bytes:
    """text and zero bytes up to a positive multiple of 64."""
    text = text or b""
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def store_payloads(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One image per text: id, n_bytes and media, an 8-bit grey image 64 pixels wide that holds the padded bytes.

    Payloads whose crc32 is even are stored as binary PGM, the others as BMP. A
    null text is an empty one; equal texts give equal images.
    """
    frame = docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("_text"))
    schema = frame.select(id_col, F.lit(0).cast("long").alias("n_bytes"), F.lit(None).cast("binary").alias("media")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, 1):
            media, sizes = [], []
            for text in batch.column(1).to_pylist():
                payload = payload_of(text)
                samples = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
                media.append((encode_bmp if zlib.crc32(payload) & 1 else encode_pgm)(samples))
                sizes.append(len(text or b""))
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "media"])

    return frame.mapInArrow(run, schema)


def payload_digests(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with what the stored bytes hold when decoded: payload_bytes, payload_sha256, tail_crc32.

    All three are null where the image is null, empty or can't be decoded. Columns
    with these names are replaced.
    """
    rest = [c for c in media.columns if c.lower() not in ("payload_bytes", "payload_sha256", "tail_crc32")]
    at = rest.index(media_col)
    frame = media.select(*rest)
    schema = frame.selectExpr("*", "cast(null as bigint) payload_bytes", "cast(null as string) payload_sha256", "cast(null as bigint) tail_crc32").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, at):
            found = []
            for data in batch.column(at).to_pylist():
                try:
                    payload = np.ascontiguousarray(decode(data)).tobytes() if data else None
                except BROKEN:
                    payload = None
                found.append((None,) * 3 if payload is None else (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:])))
            n, sha, crc = zip(*found, strict=True) if found else ((), (), ())
            extra = [pa.array(n, pa.int64()), pa.array(sha, pa.string()), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*rest, "payload_bytes", "payload_sha256", "tail_crc32"])

    return frame.mapInArrow(run, schema)
