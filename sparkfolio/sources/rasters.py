"""Decoders of raster files in numpy (PNG, BMP, TIFF with its usual compressions, portable pixmaps), and pages of images as rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from sparkfolio.operators import images
from sparkfolio.sources.notes import Unreadable
from sparkfolio.sources.writers import read_pnm, read_tiff

#: Pixels of a page at most: one that claims more is refused before it takes memory.
MOST_PIXELS = 1 << 28
#: Samples a pixel by the colour type of a PNG.
SAMPLES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}
#: The seven passes of an interlaced PNG: first column and row, steps.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))


def unfiltered(raw: np.ndarray, height: int, stride: int, step: int) -> np.ndarray:
    """Rows of a PNG without their filters; each row depends on the one before."""
    rows = raw[: height * (stride + 1)].reshape(height, stride + 1)
    out = np.zeros((height, stride), np.uint8)
    above = np.zeros(stride, np.uint8)
    for k in range(height):
        kind, row = int(rows[k, 0]), rows[k, 1:].copy()
        if kind == 1:  # sums along each sample
            wide = np.zeros(-(-stride // step) * step, np.uint8)
            wide[:stride] = row
            row = np.cumsum(wide.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)[:stride]
        elif kind == 2:
            row += above
        elif kind in (3, 4):
            now, up = bytearray(row.tobytes()), above.tobytes()
            for x in range(stride):
                a, b = (now[x - step] if x >= step else 0), up[x]
                if kind == 3:
                    now[x] = (now[x] + (a + b) // 2) & 255
                else:
                    c = up[x - step] if x >= step else 0
                    far = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    now[x] = (now[x] + (a if far[0] <= far[1] and far[0] <= far[2] else b if far[1] <= far[2] else c)) & 255
            row = np.frombuffer(bytes(now), np.uint8)
        elif kind:
            raise Unreadable(f"PNG filter {kind}")
        out[k] = above = row
    return out


def png_pass(raw: np.ndarray, width: int, height: int, bits: int, samples: int) -> tuple[np.ndarray, int]:
    """Samples (height, width, samples) of one pass as they are stored, 16 bits by their upper half, and the bytes that it takes."""
    stride = -(-width * samples * bits // 8)
    rows = unfiltered(raw, height, stride, max(1, samples * bits // 8))
    if bits == 16:
        rows = rows[:, ::2]
    elif bits < 8:
        cells = np.unpackbits(rows, axis=1).reshape(height, -1, bits)
        rows = (cells @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8)
    return rows[:, : width * samples].reshape(height, width, samples), height * (stride + 1)


def read_png(data: bytes) -> np.ndarray:
    """Grey or colour of 8 bits; what is transparent shows white paper."""
    at, body, palette, clear = 8, [], None, None
    head: tuple[int, ...] = ()
    while at + 8 <= len(data):
        size, kind = struct.unpack_from(">I4s", data, at)
        part = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"PLTE":
            palette = np.frombuffer(part, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            clear = np.frombuffer(part, np.uint8)
        elif kind == b"IDAT":
            body.append(part)
        at += size + 12
    if not head or head[3] not in SAMPLES or head[0] * head[1] > MOST_PIXELS or not head[0] * head[1]:
        raise Unreadable("not a PNG of a size that can be read")
    width, height, bits, colour, _, _, laced = head
    samples = SAMPLES[colour]
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8)
    if laced:
        pixels, used = np.zeros((height, width, samples), np.uint8), 0
        for x, y, dx, dy in PASSES:
            w, h = -(-(width - x) // dx), -(-(height - y) // dy)
            if w > 0 and h > 0:
                pixels[y::dy, x::dx], n = png_pass(raw[used:], w, h, bits, samples)
                used += n
    else:
        pixels = png_pass(raw, width, height, bits, samples)[0]
    if colour == 3:
        if palette is None:
            raise Unreadable("PNG without its palette")
        alpha = np.full(len(palette), 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear
        index = np.minimum(pixels[:, :, 0], len(palette) - 1)
        return on_paper(palette[index], alpha[index])
    if bits < 8:
        pixels = pixels * (255 // ((1 << bits) - 1))
    if samples in (2, 4):
        return on_paper(pixels[:, :, 0] if samples == 2 else pixels[:, :, :3], pixels[:, :, -1])
    return pixels[:, :, 0] if samples == 1 else pixels


def on_paper(pixels: np.ndarray, alpha: np.ndarray) -> np.ndarray:
    share = alpha.astype(np.uint16) if pixels.ndim == 2 else alpha.astype(np.uint16)[:, :, None]
    return ((pixels * share + 255 * (255 - share) + 127) // 255).astype(np.uint8)


def read_bmp(data: bytes) -> np.ndarray:
    """Plain bitmaps of 8, 24 or 32 bits."""
    start, _, width, height, _, bits, method, _, _, _, colours = struct.unpack_from("<IIiiHHIIiiI", data, 10)
    rows = abs(height)
    if method not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or not 0 < width * rows <= MOST_PIXELS:
        raise Unreadable("bitmap of an unsupported kind")
    stride = (width * bits + 31) // 32 * 4
    flat = np.frombuffer(data, np.uint8, stride * rows, start).reshape(rows, stride)
    flat = flat[::-1] if height > 0 else flat
    if bits == 8:
        table = np.frombuffer(data, np.uint8, 4 * (colours or 256), 14 + struct.unpack_from("<I", data, 14)[0]).reshape(-1, 4)
        return np.ascontiguousarray(table[flat[:, :width]][:, :, 2::-1])
    return np.ascontiguousarray(flat[:, : width * bits // 8].reshape(rows, width, bits // 8)[:, :, 2::-1])


def frames(data: bytes) -> list[np.ndarray]:
    """The pages of a raster file, by its first bytes."""
    try:
        if data.startswith(b"\x89PNG\r\n\x1a\n"):
            return [read_png(data)]
        if data[:2] in (b"II", b"MM"):
            return read_tiff(data)
        if data.startswith(b"BM"):
            return [read_bmp(data)]
        if data[:1] == b"P" and data[1:2].isdigit():
            return [read_pnm(data)]
    except Unreadable:
        raise
    except Exception as e:  # a damaged file fails by itself
        raise Unreadable(f"{type(e).__name__}: {e}") from e
    raise Unreadable("unsupported: no raster file that can be decoded")


BOX = "struct<x0:int,y0:int,x1:int,y1:int,ticked:boolean>"
IMAGE_PAGES = f"page_index int, width int, height int, channels int, dark boolean, skew double, coloured boolean, ticks array<{BOX}>, error string"


def image_pages(files: DataFrame, key: str = "path") -> DataFrame:
    """A row for each page of raster files (key, content): size, whether it is dark, its skew, whether it has coloured ink, and its tick boxes; a file that fails is a row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(IMAGE_PAGES))}

    def pages(data: bytes) -> Iterator[dict]:
        blank = dict.fromkeys(kinds)
        try:
            for k, page in enumerate(frames(data)):
                ink = images.coloured_ink(page) if page.ndim == 3 else None
                yield blank | {"page_index": k, "width": page.shape[1], "height": page.shape[0], "channels": page.shape[2] if page.ndim == 3 else 1, "dark": images.is_dark(page), "skew": float(images.skew(page)), "coloured": ink is not None, "ticks": images.tick_boxes(page)}
        except Unreadable as e:
            yield blank | {"error": str(e)[:500]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a page at a time
                for row in pages(b.column(1)[at].as_py() or b""):
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1)] + [pa.array([row[c]], t) for c, t in kinds.items()], names=[key, *kinds])

    return files.select(key, "content").mapInArrow(run, f"`{key}` {dict(files.dtypes)[key]}, {IMAGE_PAGES}")
