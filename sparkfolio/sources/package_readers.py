"""Readers of packages: word processing, spreadsheets, slides, OpenDocument, EPUB, archives."""

from __future__ import annotations

import io
import math
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from datetime import date, timedelta

from sparkfolio.sources.html_reader import html_note
from sparkfolio.sources.notes import Block, Note, Unreadable, clean, escape
from sparkfolio.sources.text_readers import decode

#: Limits of a package: bytes of a part, members, bytes unpacked, cells.
PART, MEMBERS, UNPACKED, CELLS = 512 << 20, 10_000, 2 << 30, 1_000_000


def local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def attr(x: ET.Element, name: str, default: str = "") -> str:
    """An attribute by its local name."""
    for k, v in x.attrib.items():
        if local(k) == name:
            return v
    return default


def under(x: ET.Element, *names: str) -> Iterator[ET.Element]:
    return (y for y in x.iter() if local(y.tag) in names)


def child(x: ET.Element | None, name: str) -> ET.Element | None:
    return None if x is None else next((y for y in x if local(y.tag) == name), None)


class Package:
    """A zip whose parts are found in any case."""

    def __init__(self, data: bytes) -> None:
        try:
            self.zip = zipfile.ZipFile(io.BytesIO(data))
        except zipfile.BadZipFile as e:
            raise Unreadable(f"not a package: {e}") from None
        self.names = {n.lower().lstrip("/"): n for n in self.zip.namelist()}

    def read(self, name: str) -> bytes | None:
        real = self.names.get(name.lower().lstrip("/"))
        if real is None:
            return None
        if self.zip.getinfo(real).file_size > PART:
            raise Unreadable(f"{name} is too large")
        try:
            return self.zip.read(real)
        except (RuntimeError, zipfile.BadZipFile) as e:
            raise Unreadable(f"{name}: {e}") from None

    def xml(self, name: str) -> ET.Element | None:
        data = self.read(name)
        if data is None:
            return None
        try:
            return ET.fromstring(data)
        except ET.ParseError as e:
            raise Unreadable(f"{name}: {e}") from None

    def relations(self, part: str) -> dict[str, str]:
        """Targets by id; those within the package as part names."""
        folder, name = posixpath.split(part)
        x = self.xml(f"{folder}/_rels/{name}.rels")
        out = {}
        for r in x if x is not None else ():
            to = r.get("Target", "")
            out[r.get("Id", "")] = to if r.get("TargetMode") == "External" or re.match(r"[a-z]+:", to) else posixpath.normpath(posixpath.join(folder, to)) if not to.startswith("/") else to[1:]
        return out

    def properties(self) -> dict[str, object]:
        x, out = self.xml("docProps/core.xml"), {}
        for y in x if x is not None else ():
            name = {"creator": "author", "title": "title", "description": "description", "keywords": "keywords", "created": "created", "modified": "modified", "subject": "subject"}.get(local(y.tag))
            if name and y.text and y.text.strip():
                out[name] = y.text.strip()
        return out


# word processing


def docx(data: bytes) -> Note:
    p = Package(data)
    root = p.xml("word/document.xml")
    if root is None:
        raise Unreadable("no document part")
    relations = p.relations("word/document.xml")
    styles, numbers = {}, {}
    for s in under(p.xml("word/styles.xml") if p.read("word/styles.xml") else ET.Element("x"), "style"):
        name, based = child(s, "name"), child(s, "basedOn")
        outline = next(under(s, "outlineLvl"), None)
        styles[attr(s, "styleId")] = (attr(name, "val").lower() if name is not None else "", attr(based, "val") if based is not None else "", attr(outline, "val") if outline is not None else "", next(under(s, "numId"), None))
    numbering = p.xml("word/numbering.xml")
    if numbering is not None:
        kinds = {attr(a, "abstractNumId"): {attr(v, "ilvl"): attr(child(v, "numFmt"), "val") if child(v, "numFmt") is not None else "bullet" for v in under(a, "lvl")} for a in under(numbering, "abstractNum")}
        for n in under(numbering, "num"):
            a = child(n, "abstractNumId")
            numbers[attr(n, "numId")] = kinds.get(attr(a, "val") if a is not None else "", {})
    notes: dict[str, ET.Element] = {}
    for kind in ("footnotes", "endnotes"):
        x = p.xml(f"word/{kind}.xml")
        for n in under(x, kind[:-1]) if x is not None else ():
            if attr(n, "type") not in ("separator", "continuationSeparator"):
                notes[f"{kind[0]}{attr(n, 'id')}"] = n
    out, used, counts = [], [], {}

    def level_of(style: str) -> int:
        """Heading level by the chain of styles, 0 for none."""
        seen = set()
        while style in styles and style not in seen:
            seen.add(style)
            name, based, outline, _ = styles[style]
            if outline.isdigit() and int(outline) < 9:
                return int(outline) + 1
            if m := re.fullmatch(r"heading (\d)", name):
                return int(m[1])
            if name == "title":
                return 1
            style = based
        return 0

    def runs(x: ET.Element) -> str:
        parts: list[str] = []
        for r in x:
            tag = local(r.tag)
            if tag == "hyperlink":
                to, inner = relations.get(attr(r, "id"), ""), runs(r)
                parts.append(f"[{inner}]({to})" if to and inner.strip() else inner)
            elif tag in ("ins", "smartTag", "sdt", "sdtContent", "fldSimple", "customXml"):
                parts.append(runs(r))
            elif tag == "oMath" or tag == "oMathPara":
                parts.append(f"${tex_of(r)}$")
            elif tag == "r":
                props = child(r, "rPr")
                on = lambda n: (y := child(props, n)) is not None and attr(y, "val", "1") not in ("0", "false", "none")  # noqa: B023, E731
                if on("vanish"):
                    continue
                text = ""
                for y in r:
                    t = local(y.tag)
                    if t == "t":
                        text += escape_inline(y.text or "")
                    elif t == "tab":
                        text += " "
                    elif t in ("br", "cr"):
                        text += "\\\n" if attr(y, "type") not in ("page", "column") else ""
                    elif t == "noBreakHyphen":
                        text += "-"
                    elif t in ("footnoteReference", "endnoteReference"):
                        key = f"{t[0]}{attr(y, 'id')}"
                        if key in notes:
                            if key not in used:
                                used.append(key)
                            text += f"[^{used.index(key) + 1}]"
                mark = "**" * on("b") + "*" * on("i") + "~~" * on("strike")
                parts.append(wrapped(text, mark))
        return re.sub(r"(\*\*|~~)(\s*)\1", r"\2", "".join(parts))

    def paragraph(x: ET.Element) -> None:
        props = child(x, "pPr")
        style = attr(s, "val") if (s := child(props, "pStyle")) is not None else ""
        text = runs(x).strip()
        if not text:
            return
        outline = next(under(props, "outlineLvl"), None) if props is not None else None
        level = int(attr(outline, "val")) + 1 if outline is not None and attr(outline, "val").isdigit() and int(attr(outline, "val")) < 9 else level_of(style)
        number = child(props, "numPr")
        number = number if number is not None else None
        num_id = attr(n, "val") if (n := child(number, "numId")) is not None else (attr(styles[style][3], "val") if style in styles and styles[style][3] is not None else "")
        at = int(attr(n, "val") or 0) if (n := child(number, "ilvl")) is not None else 0
        if level:
            out.append(Block("heading", re.sub(r"^\*\*(.*)\*\*$", r"\1", text), min(6, level)))
        elif num_id and num_id != "0":
            kind = numbers.get(num_id, {}).get(str(at), "bullet")
            for k in [k for k in counts if k[0] == num_id and k[1] > at]:
                del counts[k]
            counts[num_id, at] = counts.get((num_id, at), 0) + 1
            out.append(Block("item", text, depth=at, mark="-" if kind in ("bullet", "none") else f"{counts[num_id, at]}."))
        elif m := re.fullmatch(r"list (bullet|number) ?(\d?)", styles.get(style, ("",))[0]):
            out.append(Block("item", text, depth=int(m[2] or 1) - 1, mark="-" if m[1] == "bullet" else "1."))
        elif styles.get(style, ("",))[0] in ("quote", "intense quote"):
            out.append(Block("quote", text, depth=1))
        else:
            out.append(Block("paragraph", text))

    def table(x: ET.Element) -> None:
        rows = []
        for tr in (y for y in x if local(y.tag) == "tr"):
            row: list[str] = []
            skipped = next(under(tr, "gridBefore"), None)
            row += [""] * (int(attr(skipped, "val") or 0) if skipped is not None else 0)
            for tc in (y for y in tr if local(y.tag) == "tc"):
                props = child(tc, "tcPr")
                merge = child(props, "vMerge")
                text = "" if merge is not None and attr(merge, "val", "continue") == "continue" else clean(" ".join(runs(q) for q in under(tc, "p")))
                span = child(props, "gridSpan")
                row += [text] + [""] * (int(attr(span, "val") or 1) - 1 if span is not None else 0)
            rows.append(row)
        used_columns = {k for r in rows for k, c in enumerate(r) if c}
        if len(used_columns) > 1:
            out.append(Block("table", rows=rows))
        else:
            out.extend(Block("paragraph", c) for r in rows for c in r if c)

    def walk(x: ET.Element) -> None:
        for y in x:
            tag = local(y.tag)
            if tag == "p":
                paragraph(y)
            elif tag == "tbl":
                table(y)
            elif tag in ("sdt", "sdtContent", "ins", "customXml"):
                walk(y)

    walk(root if local(root.tag) == "body" else child(root, "body"))
    for k, key in enumerate(used):
        out.append(Block("footnote", clean(" ".join(runs(q) for q in under(notes[key], "p"))), mark=str(k + 1)))
    return Note(out, p.properties())


def escape_inline(text: str) -> str:
    return re.sub(r"([\\`*\[\]])", r"\\\1", text)


def wrapped(text: str, mark: str) -> str:
    """The mark around the text, blanks outside."""
    core = text.strip()
    if not mark or not core:
        return text
    left, right = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    return f"{left}{mark}{core}{mark[::-1]}{right}"


def tex_of(x: ET.Element) -> str:
    """A formula as TeX, by its structure."""
    tag = local(x.tag)
    part = lambda n: tex_all(child(x, n)) if child(x, n) is not None else ""
    if tag == "t":
        return x.text or ""
    if tag == "f":
        return rf"\frac{{{part('num')}}}{{{part('den')}}}"
    if tag == "sSup":
        return f"{part('e')}^{{{part('sup')}}}"
    if tag == "sSub":
        return f"{part('e')}_{{{part('sub')}}}"
    if tag == "sSubSup":
        return f"{part('e')}_{{{part('sub')}}}^{{{part('sup')}}}"
    if tag == "rad":
        return rf"\sqrt[{d}]{{{part('e')}}}" if (d := part("deg")) else rf"\sqrt{{{part('e')}}}"
    if tag == "d":
        return rf"\left({part('e')}\right)"
    if tag == "nary":
        sign = next((attr(c, "val") for c in under(x, "chr")), "∫")
        name = {"∑": r"\sum", "∏": r"\prod", "∫": r"\int"}.get(sign, sign)
        return f"{name}_{{{part('sub')}}}^{{{part('sup')}}} {part('e')}"
    return tex_all(x)


def tex_all(x: ET.Element | None) -> str:
    return "" if x is None else "".join(tex_of(y) for y in x if not local(y.tag).endswith("Pr"))


def mathml_tex(text: str) -> str:
    """MathML as TeX."""

    def made(x: ET.Element) -> str:
        kids = [made(y) for y in x]
        tag = local(x.tag)
        if tag == "mfrac" and len(kids) == 2:
            return rf"\frac{{{kids[0]}}}{{{kids[1]}}}"
        if tag in ("msup", "msub") and len(kids) == 2:
            return f"{kids[0]}{'^' if tag == 'msup' else '_'}{{{kids[1]}}}"
        if tag == "msubsup" and len(kids) == 3:
            return f"{kids[0]}_{{{kids[1]}}}^{{{kids[2]}}}"
        if tag == "msqrt":
            return rf"\sqrt{{{''.join(kids)}}}"
        if tag == "mroot" and len(kids) == 2:
            return rf"\sqrt[{kids[1]}]{{{kids[0]}}}"
        if tag in ("mi", "mn", "mo", "mtext"):
            t = (x.text or "").strip()
            return {"×": r"\times ", "≤": r"\le ", "≥": r"\ge ", "∑": r"\sum", "∫": r"\int", "π": r"\pi ", "α": r"\alpha ", "β": r"\beta ", "∞": r"\infty "}.get(t, rf"\text{{{t}}}" if tag == "mtext" else t)
        return "".join(kids)

    try:
        return made(ET.fromstring(text))
    except ET.ParseError as e:
        raise Unreadable(f"formula: {e}") from None


# spreadsheets


#: Days of a spreadsheet that have a date: up to the year 9999.
LAST_DAY = 2_958_465


def excel_date(serial: float, base_1904: bool = False) -> str:
    """A day number as a date, or a date and time, to the second; a time below 1. Numbers that are no date stay numbers.

    Spreadsheets count a 29th of February 1900, number 60, which is shown as the day after it.
    """
    if not 0 <= serial <= LAST_DAY:
        return number_text(repr(serial))
    days, seconds = divmod(int(serial * 86400 + 0.5), 86400)
    clock = f"{seconds // 3600:02}:{seconds // 60 % 60:02}:{seconds % 60:02}"
    if serial < 1:
        return clock
    try:
        day = date(1904, 1, 1) + timedelta(days=days) if base_1904 else date(1899, 12, 31) + timedelta(days=days - (days > 60))
    except OverflowError:  # beyond the year 9999, by the later count
        return number_text(repr(serial))
    return f"{day.isoformat()} {clock}" if seconds else day.isoformat()


def number_text(text: str) -> str:
    """A number as it is shown: whole ones without a point, others to 15 figures; what is no finite number stays as it is."""
    try:
        value = float(text)
    except ValueError:
        return text
    if not math.isfinite(value):
        return text
    whole = value.is_integer() and abs(value) <= 2**53
    return str(int(value)) if whole else format(value, ".15g")


def cell_place(name: str) -> tuple[int, int]:
    m = re.fullmatch(r"\$?([A-Za-z]+)\$?(\d+)", name)
    if not m:
        raise Unreadable(f"no cell: {name}")
    column = 0
    for c in m[1].upper():
        column = column * 26 + ord(c) - 64
    return int(m[2]) - 1, column - 1


DATED = {14, 15, 16, 17, 22, 27, 30, 36, 45, 46, 47, 50, 57, 18, 19, 20, 21}


def xlsx(data: bytes, max_rows: int = 5000) -> Note:
    """Visible sheets as headings and tables; empty rows part tables."""
    p = Package(data)
    book = p.xml("xl/workbook.xml")
    if book is None:
        raise Unreadable("no workbook part")
    relations = p.relations("xl/workbook.xml")
    pr = next(under(book, "workbookPr"), None)
    base_1904 = pr is not None and attr(pr, "date1904") in ("1", "true")
    shared = []
    strings = p.xml("xl/sharedStrings.xml")
    for si in (x for x in strings if local(x.tag) == "si") if strings is not None else ():
        shared.append("".join(t.text or "" for t in under(si, "t")))
    formats, kinds = {}, []
    styles = p.xml("xl/styles.xml")
    if styles is not None:
        formats = {int(attr(f, "numFmtId") or 0): attr(f, "formatCode") for f in under(styles, "numFmt")}
        xfs = next(under(styles, "cellXfs"), None)
        kinds = [int(attr(x, "numFmtId") or 0) for x in xfs] if xfs is not None else []
    blocks, n_rows, cells = [], 0, 0

    def shown(text: str, style: str) -> str:
        fmt = kinds[int(style)] if style.isdigit() and int(style) < len(kinds) else 0
        said = re.sub(r"\"[^\"]*\"|\\.|\[[^\]h]*\]", "", formats.get(fmt, "")).lower()
        try:
            x = float(text)
        except ValueError:
            return text
        if "[h]" in said:
            s = int(x * 86400 + 0.5)
            return f"{s // 3600}:{s // 60 % 60:02d}:{s % 60:02d}"
        if fmt in DATED or re.search(r"[ymdhs]", said) and "general" not in said:
            return excel_date(x, base_1904)
        if fmt in (9, 10) or "%" in said:
            return f"{number_text(f'{x * 100:.10g}')} %"
        return number_text(text)

    sheets = [s for s in under(book, "sheet") if attr(s, "state", "visible") == "visible"]
    for s in sheets:
        x = p.xml(relations.get(attr(s, "id"), ""))
        if x is None:
            continue
        hidden = {k for c in under(x, "col") if attr(c, "hidden") in ("1", "true") for k in range(int(attr(c, "min") or 1) - 1, min(int(attr(c, "max") or 1), 16384))}
        rows: dict[int, dict[int, str]] = {}
        dropped = 0
        for at, r in enumerate(under(x, "row")):
            if attr(r, "hidden") in ("1", "true"):
                continue
            n = int(attr(r, "r") or at + 1) - 1
            own: dict[int, str] = {}
            for k, c in enumerate(y for y in r if local(y.tag) == "c"):
                col = cell_place(attr(c, "r"))[1] if attr(c, "r") else k
                v, kind = child(c, "v"), attr(c, "t")
                text = v.text or "" if v is not None else ""
                if kind == "s":
                    text = shared[int(text)] if text.isdigit() and int(text) < len(shared) else ""
                elif kind == "inlineStr":
                    text = "".join(t.text or "" for t in under(c, "t"))
                elif kind == "b":
                    text = "TRUE" if text == "1" else "FALSE"
                elif kind not in ("str", "e"):
                    text = shown(text, attr(c, "s")) if text else ""
                if text.strip() and col not in hidden:
                    own[col] = clean(text)
            if not own:
                continue
            cells += len(own)
            if len(rows) > max_rows or cells > CELLS:
                dropped += 1
                continue
            rows[n] = own
        blocks.append(Block("heading", escape(attr(s, "name")), 2))
        n_rows += len(rows) + dropped
        part: list[int] = []
        for n in [*sorted(rows), None]:
            if part and (n is None or n > part[-1] + 1):
                left, right = min(min(rows[k]) for k in part), max(max(rows[k]) for k in part)
                blocks.append(Block("table", rows=[[rows[k].get(c, "") for c in range(left, right + 1)] for k in part]))
                part = []
            if n is not None:
                part.append(n)
        if dropped:
            blocks.append(Block("paragraph", f"*{dropped} more rows not shown*"))
    return Note(blocks, p.properties() | {"sheets": len(sheets), "rows": n_rows})


# slides


def pptx(data: bytes) -> Note:
    p = Package(data)
    root = p.xml("ppt/presentation.xml")
    if root is None:
        raise Unreadable("no presentation part")
    relations, out, n = p.relations("ppt/presentation.xml"), [], 0
    for s in under(root, "sldId"):
        part = relations.get(next((v for k, v in s.attrib.items() if k.endswith("}id")), ""), "")
        x = p.xml(part)
        if x is None or attr(x, "show") == "0":
            continue
        n += 1
        out.append(Block("marker", f"slide {n}"))
        shapes = sorted((y for y in under(x, "sp", "graphicFrame")), key=lambda y: next(((int(attr(o, "y") or 0), int(attr(o, "x") or 0)) for o in under(y, "off")), (0, 0)))
        kind = lambda y: next((attr(h, "type") for h in under(y, "ph")), "")
        title = next((y for y in shapes if kind(y) in ("title", "ctrTitle")), None)
        said = clean(" ".join(t.text or "" for t in under(title, "t"))) if title is not None else ""
        out.append(Block("heading", escape(said or f"Slide {n}"), 2))
        for y in shapes:
            if y is title or kind(y) in ("sldNum", "ftr", "dt"):
                continue
            if tbl := next(under(y, "tbl"), None):
                out.append(Block("table", rows=[[clean(" ".join(t.text or "" for t in under(c, "t"))) for c in r if local(c.tag) == "tc"] for r in under(tbl, "tr")]))
                continue
            for q in under(y, "p"):
                text = clean("".join(t.text or "" if local(t.tag) == "t" else " " for t in under(q, "t", "br")))
                level = int(attr(child(q, "pPr"), "lvl") or 0) if child(q, "pPr") is not None else 0
                if text:
                    plain = child(q, "pPr") is not None and child(child(q, "pPr"), "buNone") is not None
                    out.append(Block("paragraph", escape(text)) if plain or not list(under(y, "ph")) else Block("item", escape(text), depth=level, mark="-"))
        for to in p.relations(part).values():
            if "notesslide" in to.lower() and (notes := p.xml(to)) is not None:
                for y in under(notes, "sp"):
                    text = clean(" ".join(t.text or "" for t in under(y, "t")))
                    if kind(y) == "body" and text:
                        out.append(Block("quote", escape(text), depth=1))
    return Note(out, p.properties() | {"slides": n})


# OpenDocument


def odf(data: bytes, max_rows: int = 5000) -> Note:
    """Text, sheets or slides: headings, lists and tables in order; hidden sheets, rows and columns are left out."""
    p = Package(data)
    root = p.xml("content.xml")
    if root is None:
        raise Unreadable("no content part")
    out: list[Block] = []
    said = lambda x: clean("".join(x.itertext()))
    gone = {attr(s, "name") for s in under(root, "style") for q in under(s, "table-properties") if attr(q, "display") == "false"}

    def table(x: ET.Element) -> None:
        rows, dropped = [], 0
        for r in under(x, "table-row"):
            if attr(r, "visibility") in ("collapse", "filter"):
                continue
            row: list[str] = []
            for c in (y for y in r if local(y.tag) in ("table-cell", "covered-table-cell")):
                row += [said(c)] * min(int(attr(c, "number-columns-repeated") or 1), 1024)
            while row and not row[-1]:
                row.pop()
            times = int(attr(r, "number-rows-repeated") or 1) if row else 1
            for _ in range(times):
                if len(rows) > max_rows:
                    dropped += times
                    break
                rows.append(row[:1024])
        part: list[list[str]] = []
        for r in [*rows, []]:
            if r:
                part.append(r)
            elif part:
                out.append(Block("table", rows=part))
                part = []
        if dropped:
            out.append(Block("paragraph", f"*{dropped} more rows not shown*"))

    def walk(x: ET.Element, depth: int) -> None:
        for y in x:
            tag = local(y.tag)
            if tag == "h":
                out.append(Block("heading", escape(said(y)), min(6, int(attr(y, "outline-level") or 1))))
            elif tag == "p" and said(y):
                out.append(Block("item" if depth else "paragraph", escape(said(y)), depth=max(0, depth - 1), mark="-" if depth else ""))
            elif tag == "list":
                walk(y, depth + 1)
            elif tag == "table":
                if attr(y, "style-name") in gone:
                    continue
                if x_kind == "spreadsheet":
                    out.append(Block("heading", escape(attr(y, "name")), 2))
                table(y)
            elif tag == "page":
                out.append(Block("marker", f"slide {sum(b.kind == 'marker' for b in out) + 1}"))
                walk(y, 0)
            elif tag not in ("h", "p", "tracked-changes", "forms", "sequence-decls"):
                walk(y, depth)

    body = next(under(root, "body"), root)
    x_kind = local(body[0].tag) if len(body) else ""
    walk(body, 0)
    meta: dict[str, object] = {}
    m = p.xml("meta.xml")
    for y in m.iter() if m is not None else ():
        name = {"title": "title", "creator": "author", "description": "description", "creation-date": "created", "date": "modified", "subject": "subject"}.get(local(y.tag))
        if name and y.text:
            meta[name] = y.text.strip()
    return Note([b for b in out if b.text or b.rows or b.kind == "rule"], meta)


# books and archives


def epub(data: bytes) -> Note:
    p = Package(data)
    box = p.xml("META-INF/container.xml")
    path = attr(next(under(box, "rootfile")), "full-path") if box is not None else ""
    opf = p.xml(path)
    if opf is None:
        raise Unreadable("no package document")
    folder, out = posixpath.dirname(path), []
    items = {attr(i, "id"): posixpath.normpath(posixpath.join(folder, attr(i, "href"))) for i in under(opf, "item")}
    n = 0
    for ref in under(opf, "itemref"):
        if attr(ref, "linear") == "no" or (page := p.read(items.get(attr(ref, "idref"), ""))) is None:
            continue
        n += 1
        out += [Block("marker", f"chapter {n}"), *html_note(decode(page)).blocks]
    meta: dict[str, object] = {}
    for y in opf.iter():
        name = {"title": "title", "creator": "author", "language": "language", "description": "description", "date": "created"}.get(local(y.tag)) if "dc/elements" in y.tag else None
        if name and y.text:
            meta.setdefault(name, clean(y.text))
    return Note(out, meta)


def members(data: bytes) -> list[tuple[str, bytes]]:
    """Name and content of an archive's visible files; names that differ in case alone get a number."""
    p, out, seen, total = Package(data), [], {}, 0
    infos = [i for i in p.zip.infolist() if not i.is_dir()]
    if len(infos) > MEMBERS:
        raise Unreadable(f"more than {MEMBERS} members")
    for i in infos:
        parts = i.filename.replace("\\", "/").split("/")
        if i.flag_bits & 1 or ".." in parts or any(x.startswith((".", "~$")) or x == "__MACOSX" for x in parts):
            continue
        total += i.file_size
        if total > UNPACKED:
            raise Unreadable("more than 2 GiB unpacked")
        name = "/".join(x for x in parts if x)
        n = seen[name.lower()] = seen.get(name.lower(), 0) + 1
        if n > 1:
            stem, dot, suffix = name.rpartition(".")
            name = f"{stem}~{n}.{suffix}" if dot else f"{name}~{n}"
        try:
            out.append((name, p.zip.read(i)))
        except (RuntimeError, zipfile.BadZipFile, OSError) as e:
            raise Unreadable(f"{i.filename}: {e}") from None
    return out
