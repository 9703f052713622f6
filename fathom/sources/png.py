"""16-bit grey PNG images: many decoded at once, single ones encoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Sequence

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"


def _raw(data: bytes | None) -> np.ndarray | None:
    """The filtered lines of a 16-bit grey PNG without interlace, each after the number of its filter; None for anything else."""
    try:
        if not data or data[:8] != SIGNATURE:
            return None
        at, body, head = 8, [], None
        while at < len(data):
            size, kind = struct.unpack_from(">I4s", data, at)
            chunk = data[at + 8 : at + 8 + size]
            at += size + 12
            if kind == b"IHDR":
                head = struct.unpack(">IIBBBBB", chunk)
            elif kind == b"IDAT":
                body.append(chunk)
        if head is None or head[2:4] != (16, 0) or head[6] or not head[0] or not head[1]:
            return None
        raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(head[1], 1 + 2 * head[0])
    except (struct.error, zlib.error, ValueError):
        return None
    return raw if raw[:, 0].max() <= 4 else None


def _by_rows(raw: np.ndarray) -> np.ndarray:
    """The bytes of an image whose filters need no pixel to the left but by a running sum: none, left, up."""
    height, width = raw.shape
    out = np.zeros((height + 1, width - 1), np.uint8)
    for y in range(height):
        line, kind = raw[y, 1:], raw[y, 0]
        if kind == 1:
            line = np.cumsum(line.reshape(-1, 2), axis=0, dtype=np.uint8).ravel()
        out[y + 1] = line + out[y] if kind == 2 else line
    return out[1:]


def _by_diagonals(raw: np.ndarray) -> np.ndarray:
    """The bytes of images of one shape with any filters: images x rows x 2 * width.

    A pixel needs those to its left, above, and above to the left; so all pixels
    of a diagonal, of all images, are worked out together from the two diagonals
    before it.
    """
    n, height, width = raw.shape[0], raw.shape[1], raw.shape[2] // 2
    # A row of pixels of all images after the other; a diagonal is every (width - 1)-th of them.
    line = raw[:, :, 1:].reshape(n, height * width, 2).transpose(1, 0, 2).reshape(height * width, 2 * n).astype(np.int16)
    out = np.empty(line.shape, np.uint8)
    kind = np.repeat(raw[:, :, 0].T, 2, axis=1)
    is_ = {k: kind == k for k in (1, 2, 3, 4)}
    whole = {k: x.all() for k, x in is_.items()}
    some = [k for k in (4, 3, 2, 1) if is_[k].any()]
    # A row more than the image: what is above the first one is 0, as is what is left of a row.
    one, two, new = (np.zeros((height + 1, 2 * n), np.int16) for _ in range(3))
    for d in range(height + width - 1):
        lo, hi = max(0, d - width + 1), min(height, d + 1)
        first, step = lo * width + d - lo, max(1, width - 1)
        here = slice(first, first + (hi - lo - 1) * step + 1, step)
        a, b, c = one[lo + 1 : hi + 1], one[lo:hi], two[lo:hi]
        total = line[here]
        for k in some:
            if k == 4:
                pa, pb = b - c, a - c
                pc = np.abs(pa + pb)
                np.abs(pa, out=pa)
                np.abs(pb, out=pb)
                guess = np.where(pa <= np.minimum(pb, pc), a, np.where(pb <= pc, b, c))
            else:
                guess = (a + b) >> 1 if k == 3 else b if k == 2 else a
            total = total + (guess if whole[k] else guess * is_[k][lo:hi])
        np.bitwise_and(total, 255, out=new[lo + 1 : hi + 1])
        out[here] = new[lo + 1 : hi + 1]
        one, two, new = new, one, two
    return np.ascontiguousarray(out.reshape(height, width, n, 2).transpose(2, 0, 1, 3)).reshape(n, height, 2 * width)


def decode_many(images: Sequence[bytes | None]) -> list[np.ndarray | None]:
    """The pixels of 16-bit grey PNG images; None for anything else. Images of one shape are decoded together."""
    raws = [_raw(x) for x in images]
    out: list[np.ndarray | None] = [None] * len(raws)
    shapes: dict[tuple, list[int]] = {}
    for k, raw in enumerate(raws):
        if raw is None:
            continue
        if raw[:, 0].max() <= 2:
            out[k] = _by_rows(raw)
        else:
            shapes.setdefault(raw.shape, []).append(k)
    for places in shapes.values():
        for k, made in zip(places, _by_diagonals(np.stack([raws[k] for k in places])), strict=True):
            out[k] = made
    return [x if x is None else x.view(">u2").astype(np.int32) for x in out]


def decode_png16(data: bytes) -> np.ndarray | None:
    return decode_many([data])[0]


def _file(width: int, height: int, depth: int, colour: int, lines: np.ndarray, level: int) -> bytes:
    """A PNG of filtered lines."""

    def chunk(kind: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))

    head = struct.pack(">IIBBBBB", width, height, depth, colour, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + chunk(b"IEND", b"")


def _above(rows: np.ndarray) -> np.ndarray:
    """Rows of bytes by their differences to the one above, each after the number of that filter."""
    lines = np.empty((rows.shape[0], 1 + rows.shape[1]), np.uint8)
    lines[:, 0] = 2
    lines[0, 1:], lines[1:, 1:] = rows[0], rows[1:] - rows[:-1]
    return lines


def encode_png16(image: np.ndarray, level: int = 3) -> bytes:
    """A height x width image of 0 to 65535 as a grey PNG, each row by its difference to the one above."""
    height, width = image.shape
    if not height or not width or image.min() < 0 or image.max() > 65535:
        raise ValueError("a 16-bit image has pixels, from 0 to 65535")
    return _file(width, height, 16, 0, _above(image.astype(">u2").view(np.uint8).reshape(height, 2 * width)), level)


def encode_png_rgb(image: np.ndarray, level: int = 6) -> bytes:
    """A height x width x 3 image of bytes as a colour PNG."""
    height, width, _ = image.shape
    return _file(width, height, 8, 2, _above(np.ascontiguousarray(image).reshape(height, 3 * width)), level)
