"""Raster files, encoded here by hand, and their pages as rows."""

import struct
import zlib

import numpy as np
import pytest

from sparkfolio.sources import rasters
from sparkfolio.sources.notes import Unreadable
from sparkfolio.sources.writers import lzw, plain_strip, read_tiff, un_lzw, write_tiff

RND = np.random.default_rng(3)


def filtered(rows, step, kinds):
    """Rows with the filter of each of the kinds in turn."""
    out, above = [], [0] * rows.shape[1]
    for k, row in enumerate(rows.tolist()):
        kind, made = kinds[k % len(kinds)], []
        for x, v in enumerate(row):
            a, b, c = (row[x - step] if x >= step else 0), above[x], (above[x - step] if x >= step else 0)
            paeth = min((a, b, c), key=lambda v: abs(a + b - c - v))
            made.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) % 256)
        out.append(bytes([kind, *made]))
        above = row
    return b"".join(out)


def png(width, height, bits, colour, raw, laced=0, **parts):
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    body = zlib.compress(raw)
    more = b"".join(chunk(k.encode(), v) for k, v in parts.items())
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, bits, colour, 0, 0, laced)) + more + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


def test_png_of_all_filters_and_kinds():
    for colour, samples in ((0, 1), (2, 3)):
        page = RND.integers(0, 256, (11, 7, samples), dtype=np.uint8)
        got = rasters.read_png(png(7, 11, 8, colour, filtered(page.reshape(11, -1), samples, (0, 1, 2, 3, 4))))
        assert (got.reshape(page.shape) == page).all()
    deep = RND.integers(0, 256, (4, 5, 2), dtype=np.uint8)  # 16 bits, upper half first
    assert (rasters.read_png(png(5, 4, 16, 0, filtered(deep.reshape(4, -1), 2, (1, 4)))) == deep[:, :, 0]).all()
    bits = RND.integers(0, 2, (6, 13), dtype=np.uint8)
    assert (rasters.read_png(png(13, 6, 1, 0, filtered(np.packbits(bits, axis=1), 1, (0,)))) == bits * 255).all()
    table = RND.integers(0, 256, (4, 3), dtype=np.uint8)
    index = RND.integers(0, 4, (3, 9), dtype=np.uint8)
    cells = np.packbits(np.unpackbits(index[:, :, None], axis=2)[:, :, 6:].reshape(3, -1), axis=1)
    got = rasters.read_png(png(9, 3, 2, 3, filtered(cells, 1, (0,)), PLTE=table.tobytes(), tRNS=b"\x00"))
    assert (got == np.where(index[:, :, None] == 0, 255, table[index])).all()
    clear = np.dstack([np.full((2, 2, 3), 10, np.uint8), np.array([[0, 255], [128, 255]], np.uint8)])
    assert rasters.read_png(png(2, 2, 8, 6, filtered(clear.reshape(2, -1), 4, (0,))))[:, :, 0].tolist() == [[255, 10], [132, 10]]


def test_png_in_passes():
    page = RND.integers(0, 256, (9, 10), dtype=np.uint8)
    raw = b"".join(filtered(np.ascontiguousarray(page[y::dy, x::dx]), 1, (0, 2)) for x, y, dx, dy in rasters.PASSES if page[y::dy, x::dx].size)
    assert (rasters.read_png(png(10, 9, 8, 0, raw, laced=1)) == page).all()


def test_bitmaps():
    page = RND.integers(0, 256, (3, 5, 3), dtype=np.uint8)
    rows = b"".join(r[:, ::-1].tobytes() + b"\0" for r in page[::-1])
    data = b"BM" + struct.pack("<IIIIiiHHIIiiII", 54 + len(rows), 0, 54, 40, 5, 3, 1, 24, 0, len(rows), 0, 0, 0, 0) + rows
    assert (rasters.frames(data)[0] == page).all()


@pytest.mark.parametrize("data", [b"", b"a", b"ab" * 1000, RND.integers(0, 256, 30_000, dtype=np.uint8).tobytes(), RND.integers(0, 3, 60_000, dtype=np.uint8).tobytes()])
def test_lzw_there_and_back(data):
    assert un_lzw(lzw(data)) == data


def test_tiff_compressions():
    pages = [RND.integers(0, 256, (20, 30), dtype=np.uint8), np.full((40, 50, 3), 7, np.uint8)]
    for compression in ("none", "lzw", "deflate"):
        assert all((a == b).all() for a, b in zip(read_tiff(write_tiff(pages, compression)), pages, strict=True))
    assert plain_strip(b"\x02abc\xfed\x80\x00e", 32773) == b"abcddde"
    with pytest.raises(Unreadable):
        plain_strip(b"", 7)


def test_pages_of_images(spark):
    form = np.full((200, 1000), 255, np.uint8)
    form[50:80, 100:130] = 0
    form[53:77, 103:127] = 255
    red = np.full((100, 100, 3), 255, np.uint8)
    red[20:60, 20:60] = (220, 20, 20)
    files = [("a.tif", write_tiff([form, red], "lzw")), ("b.png", b"\x89PNG\r\n\x1a\nbroken"), ("c.gif", b"GIF89a"), ("d", None)]
    got = {(r["path"], r["page_index"]): r for r in rasters.image_pages(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert set(got) == {("a.tif", 0), ("a.tif", 1), ("b.png", None), ("c.gif", None), ("d", None)}
    first, second = got["a.tif", 0], got["a.tif", 1]
    assert (first["width"], first["height"], first["channels"], first["dark"], [t["ticked"] for t in first["ticks"]]) == (1000, 200, 1, False, [False])
    assert (second["channels"], second["coloured"], first["coloured"]) == (3, True, False) and all(got[k]["error"] for k in got if k[1] is None)
