"""Writers of PDF with an invisible text layer and of multi-page TIFF, by the standard library and numpy."""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass

import numpy as np

from sparkfolio.sources.notes import Unreadable
from sparkfolio.sources.pdf import Pdf, Stream


@dataclass
class Picture:
    """Pixels (height, width) or (height, width, 3), and the lines of text on them with boxes in pixels."""

    pixels: np.ndarray
    lines: list[dict]
    dpi: float = 200.0


def literal(text: str) -> bytes:
    """A string of the Windows character set; other characters become question marks."""
    out = bytearray(b"(")
    for c in text.encode("cp1252", "replace"):
        out += b"\\" + bytes([c]) if c in b"\\()" else bytes([c])
    return bytes(out + b")")


def layer(lines: list[dict], height: float, dpi: float) -> bytes:
    """Content that shows each line in mode 3, which isn't seen, stretched to its box."""
    out = [b"BT 3 Tr"]
    for x in lines:
        size = max(1.0, (x["y1"] - x["y0"]) * 72 / dpi)
        wide = (x["x1"] - x["x0"]) * 72 / dpi
        natural = 0.5 * size * max(1, len(x["text"]))
        out.append(b"/F1 %.2f Tf %.2f Tz 1 0 0 1 %.2f %.2f Tm %s Tj" % (size, 100 * wide / natural, x["x0"] * 72 / dpi, (height - x["y1"]) * 72 / dpi + 0.2 * size, literal(x["text"])))
    return b"\n".join([*out, b"ET"])


FONT = b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding /FirstChar 0 /LastChar 255 /Widths [" + b"500 " * 256 + b"] >>"


def searchable_pdf(pictures: list[Picture]) -> bytes:
    """Pages of pictures under a text layer."""
    objects: list[bytes] = [b"", b"", FONT]

    def add(body: bytes) -> int:
        objects.append(body)
        return len(objects)

    def stream(head: bytes, data: bytes) -> int:
        raw = zlib.compress(data)
        return add(b"<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream" % (head, len(raw), raw))

    kids = []
    for p in pictures:
        h, w = p.pixels.shape[:2]
        colour = b"/DeviceRGB" if p.pixels.ndim == 3 else b"/DeviceGray"
        image = stream(b"/Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8" % (w, h, colour), np.ascontiguousarray(p.pixels, np.uint8).tobytes())
        wide, high = w * 72 / p.dpi, h * 72 / p.dpi
        content = stream(b"", b"q %.2f 0 0 %.2f 0 0 cm /Im Do Q\n" % (wide, high) + layer(p.lines, h, p.dpi))
        kids.append(add(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %.2f %.2f] /Contents %d 0 R /Resources << /Font << /F1 3 0 R >> /XObject << /Im %d 0 R >> >> >>" % (wide, high, content, image)))
    objects[0] = b"<< /Type /Catalog /Pages 2 0 R >>"
    objects[1] = b"<< /Type /Pages /Count %d /Kids [%s] >>" % (len(kids), b" ".join(b"%d 0 R" % k for k in kids))
    out, at = bytearray(b"%PDF-1.7\n"), []
    for n, body in enumerate(objects, 1):
        at.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % a for a in at)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def plan_overlay(data: bytes, skip_text: bool = True) -> list[dict]:
    """For each page of a PDF its size in points, rotation, and whether it needs a text layer."""
    pdf, out = Pdf(data), []
    for k, page in enumerate(pdf.pages()):
        x0, y0, x1, y1 = (float(pdf.get(v)) for v in pdf.get(page.get("CropBox") or page.get("MediaBox") or [0, 0, 612, 792]))
        parts = pdf.get(page.get("Contents"))
        content = b"\n".join(s.data() for c in (parts if isinstance(parts, list) else [parts]) if isinstance(s := pdf.get(c), Stream))
        shows = any(op in content.split() for op in (b"Tj", b"TJ", b"'", b'"'))
        out.append({"page_index": k, "width": x1 - x0, "height": y1 - y0, "rotate": int(pdf.get(page.get("Rotate")) or 0) % 360, "needs_ocr": not (shows and skip_text)})
    return out


def write_tiff(pages: list[np.ndarray], compression: str = "deflate", dpi: int = 200) -> bytes:
    """Pages of 8-bit grey or colour in one file; compression is none, lzw or deflate."""
    packed = {"none": (1, bytes), "lzw": (5, lzw), "deflate": (8, zlib.compress)}
    if compression not in packed:
        raise ValueError(f"unknown compression {compression!r}; use {', '.join(packed)}")
    method, pack = packed[compression]
    if not pages:
        raise Unreadable("no pages")
    out = bytearray(struct.pack("<2sHI", b"II", 42, 0))
    link = 4
    for p in pages:
        h, w = p.shape[:2]
        colours = 3 if p.ndim == 3 else 1
        raw = np.ascontiguousarray(p, np.uint8).tobytes()
        raw = pack(raw)
        data = len(out)
        out += raw + b"\0" * (len(raw) % 2)
        bits = len(out)
        out += struct.pack("<3H", 8, 8, 8) + b"\0\0"
        res = len(out)
        out += struct.pack("<2I", dpi, 1)
        struct.pack_into("<I", out, link, len(out))
        tags = [(256, 4, 1, w), (257, 4, 1, h), (258, 3, colours, bits if colours == 3 else 8), (259, 3, 1, method), (262, 3, 1, 2 if colours == 3 else 1), (273, 4, 1, data), (277, 3, 1, colours), (278, 4, 1, h), (279, 4, 1, len(raw)), (282, 5, 1, res), (283, 5, 1, res), (296, 3, 1, 2)]
        out += struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", *t) for t in tags)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def plain_strip(part: bytes, method: int) -> bytes:
    """A strip without its compression: none, LZW, deflate or runs of bytes."""
    if method == 1:
        return part
    if method == 5:
        return un_lzw(part)
    if method in (8, 32946):
        return zlib.decompress(part)
    if method == 32773:
        out, at = bytearray(), 0
        while at < len(part):
            n = part[at]
            if n < 128:
                out += part[at + 1 : at + n + 2]
                at += n + 2
            else:
                out += part[at + 1 : at + 2] * (257 - n if n > 128 else 0)
                at += 2 if n > 128 else 1
        return bytes(out)
    raise Unreadable(f"TIFF compression {method}")


CLEAR, END = 256, 257


def un_lzw(data: bytes) -> bytes:
    """LZW with codes of 9 to 12 bits, the upper bit first, which grow one code early, as TIFF has it."""
    out, table, last = bytearray(), [], b""
    held, bits, width = 0, 0, 9
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & ((1 << width) - 1)
        if code == END:
            break
        if code == CLEAR:
            table, last, width = [], b"", 9
            continue
        if code < CLEAR:
            word = bytes((code,))
        elif code - 258 < len(table):
            word = table[code - 258]
        elif last:
            word = last + last[:1]
        else:
            raise Unreadable("LZW code out of order")
        out += word
        if last:
            table.append(last + word[:1])
        last = word
        width = min(12, (len(table) + 259).bit_length())
    return bytes(out)


def lzw(data: bytes) -> bytes:
    """data as un_lzw reads it."""
    out, held, bits, sent = bytearray(), 0, 0, 0

    def put(code: int) -> None:
        """A code, as wide as the reader expects it: its table lags a code behind."""
        nonlocal held, bits, sent
        width = min(12, (max(0, sent - 1) + 259).bit_length())
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
            held &= (1 << bits) - 1
        sent = 0 if code == CLEAR else sent + 1

    fresh = {bytes((k,)): k for k in range(256)}
    codes, word = dict(fresh), b""
    put(CLEAR)
    for k in range(len(data)):
        more = word + data[k : k + 1]
        if more in codes:
            word = more
            continue
        put(codes[word])
        codes[more] = len(codes) + 2
        word = data[k : k + 1]
        if len(codes) > 4000:
            put(codes[word])
            put(CLEAR)
            codes, word = dict(fresh), b""
    if word:
        put(codes[word])
    put(END)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def read_tiff(data: bytes) -> list[np.ndarray]:
    """Frames of a TIFF: 1, 4 or 8 bits of grey, or colour; one strip or more, plain or deflated."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise Unreadable("not a TIFF")
    at, out, seen = struct.unpack_from(f"{order}I", data, 4)[0], [], set()
    while at and at not in seen:
        seen.add(at)
        n = struct.unpack_from(f"{order}H", data, at)[0]
        tags: dict[int, list[int]] = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack_from(f"{order}HHII", data, at + 2 + 12 * k)
            size = {1: 1, 3: 2, 4: 4}.get(kind)
            if size is None:
                continue
            where = at + 2 + 12 * k + 8 if size * count <= 4 else value
            tags[tag] = list(struct.unpack_from(f"{order}{count}{ {1: 'B', 2: 'H', 4: 'I'}[size] }".replace(" ", ""), data, where))
        w, h, bits, colours = tags[256][0], tags[257][0], tags.get(258, [1])[0], tags.get(277, [1])[0]
        raw = b""
        for a, size in zip(tags[273], tags[279], strict=True):
            part = data[a : a + size]
            method = tags.get(259, [1])[0]
            raw += plain_strip(part, method)
        stride = (w * colours * bits + 7) // 8
        flat = np.frombuffer(raw[: stride * h], np.uint8).reshape(h, stride)
        if tags.get(317, [1])[0] == 2 and bits == 8:  # differences along the row
            flat = np.cumsum(flat.reshape(h, w, colours), axis=1, dtype=np.uint8).reshape(h, stride)
        if bits == 8:
            page = flat.reshape(h, w, colours) if colours > 1 else flat
        elif bits in (1, 2, 4):
            cells = np.unpackbits(flat, axis=1).reshape(h, -1, bits)
            page = (cells @ (1 << np.arange(bits - 1, -1, -1)))[:, : w * colours] * (255 // ((1 << bits) - 1))
            page = page.astype(np.uint8)
        else:
            raise Unreadable(f"{bits} bits a sample")
        out.append(255 - page if tags.get(262, [1])[0] == 0 else page)
        at = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)[0]
    return out


def read_pnm(data: bytes) -> np.ndarray:
    """PBM, PGM or PPM, plain or raw."""
    tokens, at = [], 0
    while len(tokens) < (3 if data[:2] in (b"P1", b"P4") else 4):
        while data[at : at + 1].isspace() or data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1 if data[at : at + 1] == b"#" else at + 1
        start = at
        while at < len(data) and not data[at : at + 1].isspace():
            at += 1
        tokens.append(data[start:at])
    kind, w, h = tokens[0], int(tokens[1]), int(tokens[2])
    if kind == b"P4":
        return 255 - 255 * np.unpackbits(np.frombuffer(data, np.uint8, (w + 7) // 8 * h, at + 1).reshape(h, -1), axis=1)[:, :w]
    if kind in (b"P5", b"P6"):
        flat = np.frombuffer(data, np.uint8, w * h * (3 if kind == b"P6" else 1), at + 1)
        return flat.reshape((h, w, 3) if kind == b"P6" else (h, w))
    if kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split(), np.int64) * 255 // int(tokens[3])
        return flat.astype(np.uint8).reshape((h, w, 3) if kind == b"P3" else (h, w))
    raise Unreadable(f"not a portable pixmap: {kind!r}")
