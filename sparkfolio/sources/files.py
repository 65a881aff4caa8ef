"""Files as tables: listing, dispatch by suffix, notes, pages, and rows for what can't be read.

Contents come from Spark's binaryFile source, so that any file system that Spark reads will do. A file that
fails is a row with its error; no file ends a job.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import suffix
from sparkfolio.sources import html_reader, mail_rtf, package_readers, pdf, text_readers
from sparkfolio.sources.notes import BLOCKS, Block, Note, Unreadable, rendered, title_of

DEEP = 5
READERS: dict[str, Callable[[bytes], Note]] = {
    **dict.fromkeys(("txt", "text", "asc"), text_readers.txt), **dict.fromkeys(("md", "markdown", "mdown"), text_readers.md), **dict.fromkeys(("htm", "html", "xhtml"), html_reader.html),
    "csv": text_readers.delimited, **dict.fromkeys(("tsv", "tab"), lambda d: text_readers.delimited(d, "\t")), **dict.fromkeys(("srt", "vtt"), text_readers.subtitles), "rtf": mail_rtf.rtf,
    **dict.fromkeys(("docx", "docm", "dotx"), package_readers.docx), **dict.fromkeys(("xlsx", "xlsm", "xltx"), package_readers.xlsx), **dict.fromkeys(("pptx", "pptm", "ppsx"), package_readers.pptx),
    **dict.fromkeys(("odt", "ods", "odp", "ott", "ots", "otp"), package_readers.odf), "epub": package_readers.epub,
}
IMAGES = ("png", "jpg", "jpeg", "jpe", "jfif", "webp", "tif", "tiff", "bmp", "gif", "pnm", "pbm", "pgm", "ppm", "tga", "hdr", "qoi")
LEGACY = ("doc", "xls", "ppt")
SUFFIXES = (*READERS, *text_readers.CODE, "eml", "mht", "mhtml", "zip", "pdf", *IMAGES, *LEGACY)
NOTES = f"status string, error_kind string, error string, title string, markdown string, meta map<string,string>, blocks array<struct<{BLOCKS.replace(' int', ':int').replace(' string', ':string').replace(' array', ':array')}>>"
PAGES = "page_index int, width int, height int, rotation double, origin string, line_ord int, text string, x0 double, y0 double, x1 double, y1 double, error string"


def suffix_of(name: str) -> str:
    m = re.search(r"\.([A-Za-z0-9]+)$", name)
    return m[1].lower() if m else re.split(r"[/\\]", name)[-1].lower()


def read_note(data: bytes, name: str, depth: int = 0) -> Note | None:
    """The note of a file by its suffix; None for a suffix that has no reader. Failures are Unreadable."""
    kind = suffix_of(name)
    if depth > DEEP:
        raise Unreadable("nested too deeply")
    nested = lambda d, n, k: read_quietly(d, n, k)
    try:
        if kind in READERS:
            return READERS[kind](data)
        if kind in text_readers.CODE:
            return text_readers.code(data, kind)
        if kind in ("eml", "mht", "mhtml"):
            return mail_rtf.eml(data, nested, depth)
        if kind == "zip":
            note = Note()
            for inner, content in package_readers.members(data):
                got = read_quietly(content, inner, depth + 1)
                if got is not None:
                    note.blocks += [Block("heading", inner, 1), *got.blocks]
                    if got.body:
                        note.blocks.append(Block("paragraph", got.body))
            return note
        if kind == "pdf":
            note = Note()
            pages = pdf.pdf_pages(data)
            for p in pages:
                note.blocks.append(Block("marker", f"page {p['index'] + 1}"))
                note.blocks += text_readers.text_blocks("\n".join(x["text"] for x in p["lines"]))
            note.meta["pages"] = len(pages)
            return note
        if kind in LEGACY or kind in IMAGES:
            raise Unreadable(f"unsupported: {kind}")
    except Unreadable:
        raise
    except Exception as e:  # any other failure of a reader is one of its file
        raise Unreadable(f"{type(e).__name__}: {e}") from e
    return None


def read_quietly(data: bytes, name: str, depth: int) -> Note | None:
    try:
        return read_note(data, name, depth)
    except Unreadable:
        return None


def retried[T](attempt: Callable[[], T], times: int = 2, delay: float = 0.05) -> T:
    """Again after transient errors of the system, each time after twice the wait."""
    for k in range(times + 1):
        try:
            return attempt()
        except (InterruptedError, TimeoutError, BlockingIOError, ConnectionError):
            if k == times:
                raise
            time.sleep(delay * 2**k)
    raise AssertionError


def files(spark: SparkSession, paths: str | list[str], suffixes: tuple[str, ...] = SUFFIXES) -> DataFrame:
    """path, modificationTime, length and content of the readable files below paths, each once; names are pruned before contents are read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    name = F.element_at(F.split("path", "/"), -1)
    shown = ~F.startswith(name, F.lit(".")) & ~F.startswith(name, F.lit("~$")) & ~F.contains("path", F.lit("/__MACOSX/"))
    kept = found.where(shown & F.substring(suffix(F.col("path")), 2, 20).isin(*suffixes))
    return kept if isinstance(paths, str) or len(paths) < 2 else kept.dropDuplicates(["path"])  # paths may overlap


def container(content: Column | str = "content") -> Column:
    """pdf, tiff, png, jpeg, gif, bmp, webp, zip or other, by the first bytes."""
    head = F.hex(F.substring(content, 1, 12))
    kinds = (("25504446", "pdf"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("47494638", "gif"), ("424D", "bmp"), ("504B0304", "zip"))
    out = F.when(head.rlike("^52494646.{8}57454250"), "webp")
    for mark, kind in kinds:
        out = out.when(F.startswith(head, F.lit(mark)), kind)
    return out.otherwise("other")


def notes_of(rows: DataFrame, key: str = "path") -> DataFrame:
    """key and NOTES of files (key, content): status ok, error or skipped, the note as Markdown and as blocks."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(NOTES))}

    def one(data: bytes | None, name: str) -> dict:
        blank = dict.fromkeys(kinds)
        try:
            note = read_note(data or b"", name)
        except Unreadable as e:
            return blank | {"status": "error", "error_kind": "unsupported" if str(e).startswith("unsupported") else "unreadable", "error": str(e)[:500]}
        if note is None:
            return blank | {"status": "skipped"}
        note.meta.setdefault("title", title_of(note, name))
        blocks = [{"block_ord": k, "kind": b.kind, "text": b.text, "level": b.level, "depth": b.depth, "mark": b.mark, "rows": b.rows} for k, b in enumerate(note.blocks)]
        return blank | {"status": "ok", "title": note.meta["title"], "markdown": rendered(note), "meta": [(k, str(v)) for k, v in note.meta.items()], "blocks": blocks}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):  # a file at a time: contents may be large
                name = str(b.column(0)[at].as_py())
                got = one(b.column(1)[at].as_py(), name)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, 1)] + [pa.array([got[k]], t) for k, t in kinds.items()], names=[key, *kinds])

    return rows.select(key, "content").mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, {NOTES}")


def pdf_lines(rows: DataFrame, key: str = "path", pages: list[int] | None = None, dpi: float = 200.0) -> DataFrame:
    """Lines of the text layers of PDF files, only of the pages asked for (from 0); a file that fails is one row with its error."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    kinds = {f.name: f.type for f in to_arrow_schema(_parse_datatype_string(PAGES))}

    def lines(data: bytes) -> list[dict]:
        blank = dict.fromkeys(kinds)
        try:
            found = pdf.pdf_pages(data, dpi, set(pages) if pages is not None else None)
        except Exception as e:
            return [blank | {"error": f"{type(e).__name__}: {e}"[:500]}]
        return [blank | {"page_index": p["index"], "width": p["width"], "height": p["height"], "rotation": p["rotation"], "origin": "pdf_text", "line_ord": k, **{c: x[c] for c in ("text", "x0", "y0", "x1", "y1")}} for p in found for k, x in enumerate(p["lines"])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(b.num_rows):
                got = lines(b.column(1)[at].as_py() or b"")
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[at].as_py()] * len(got), b.column(0).type)] + [pa.array([g[k] for g in got], t) for k, t in kinds.items()], names=[key, *kinds])

    return rows.select(key, "content").mapInArrow(run, f"`{key}` {dict(rows.dtypes)[key]}, {PAGES}")


def parse_pages(spec: str) -> list[int]:
    """Page numbers from 0 of a text like 1,3-5, which counts from 1."""
    out: list[int] = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(\d+)\s*(?:-\s*(\d+)\s*)?", part)
        if not m or int(m[1]) < 1 or (m[2] and int(m[2]) < int(m[1])):
            raise ValueError(f"no pages: {part!r}")
        out += range(int(m[1]) - 1, int(m[2] or m[1]))
    return sorted(set(out))
