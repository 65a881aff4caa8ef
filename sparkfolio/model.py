"""The positioned model as tables: pages, blocks, lines and words, keyed by (doc_id, page_index, block_ord, line_ord).

Stored texts become positioned lines by LinesOfText's geometry: a text is one page of WIDTH pixels, each
line of the text is STEP pixels below the one before, HEIGHT high and CHAR pixels a character wide; a run of
blank lines separates blocks and takes GAP more. The page is as high as its last line needs, SHEET at least.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH, SHEET, LEFT, TOP, STEP, GAP, HEIGHT, CHAR = 1654, 2338, 100, 300, 40, 30, 30, 12
#: How far into the page the header and footer bands reach.
BAND = 0.12
#: Between blocks of a text.
BLANK_LINES = r"\n(?:[ \t]*\n)+"

BOX = "x0: double, y0: double, x1: double, y1: double"
WORD = f"struct<text: string, {BOX}, confidence: double>"
CELL = f"struct<row: int, column: int, column_span: int, text: string, {BOX}, confidence: double>"
LINE = f"struct<text: string, {BOX}, confidence: double, angle: double, words: array<{WORD}>, segments: array<{WORD}>>"
BLOCK = f"struct<kind: string, {BOX}, lines: array<{LINE}>, table: struct<rows: int, columns: int, cells: array<{CELL}>>>"
PAGE = f"struct<index: int, width: int, height: int, rotation: double, origin: string, quality: double, blocks: array<{BLOCK}>>"
DOCUMENT = f"source string, pages array<{PAGE}>, elapsed_ms double"
LINES = f"doc_id string, page_index int, block_ord int, block_kind string, line_ord int, text string, {BOX.replace(':', '')}, confidence double, page_width int, page_height int"
ORIGINS = ("image", "pdf_page", "tiff_frame", "pdf_text")
KINDS = ("paragraph", "heading", "list_item", "table", "stamp", "tick_box")


def document_type() -> T.StructType:
    return T._parse_datatype_string(DOCUMENT)  # noqa: SLF001


def blocks_of_text(text: Column | str = "text") -> Column:
    """The blocks of a text as an array."""
    return F.split(text, BLANK_LINES)


def lines_of_texts(docs: DataFrame, *keys: str) -> DataFrame:
    """keys, block_ord, line_ord and text of each line that isn't blank; no shuffle."""
    blocks = docs.select(*keys, F.posexplode(blocks_of_text()).alias("block_ord", "block"))
    lines = blocks.select(*keys, "block_ord", F.posexplode(F.split("block", "\n")).alias("line_ord", "text"))
    return lines.where(F.trim("text") != "")


def positioned_lines(docs: DataFrame, key: str = "doc_id") -> DataFrame:
    """Lines with boxes and the page's size. Each text is laid out in an array, so that nothing is shuffled."""
    rows = F.split("text", "\n")
    step = F.transform(rows, lambda x: F.struct(x.alias("text"), (F.trim(x) == "").alias("blank")))
    laid = docs.select(key, F.posexplode(step).alias("at", "x"), F.size(rows).alias("n_rows"))
    laid = laid.where("not x.blank").select(key, "n_rows", F.col("at").alias("line_ord"), F.col("x.text").alias("text"))
    y = F.lit(float(TOP)) + F.col("line_ord") * STEP
    return laid.select(
        key, F.lit(0).alias("page_index"), "line_ord", "text", F.lit(float(LEFT)).alias("x0"), y.alias("y0"),
        (F.lit(float(LEFT)) + F.length("text") * CHAR).alias("x1"), (y + HEIGHT).alias("y1"), F.lit(0.98).alias("confidence"), F.lit(WIDTH).alias("page_width"),
        F.greatest(F.lit(SHEET), (F.lit(TOP * 2) + F.col("n_rows") * STEP)).cast("int").alias("page_height"),
    )


def zone(y0: Column | str = "y0", y1: Column | str = "y1", height: Column | str = "page_height") -> Column:
    """header, footer or body, by the middle of a box; a page without height is all body."""
    a, b, h = (F.col(c) if isinstance(c, str) else c for c in (y0, y1, height))
    middle = (a + b) / 2 / h
    return F.when((h > 0) & (middle < BAND), "header").when((h > 0) & (middle > 1 - BAND), "footer").otherwise("body")


def exploded(documents: DataFrame) -> DataFrame:
    """Documents in nested form as lines, with the ordinals of page, block and line."""
    pages = documents.select("source", F.posexplode("pages").alias("page_ord", "page"))
    blocks = pages.select("source", F.col("page.index").alias("page_index"), F.col("page.width").alias("page_width"), F.col("page.height").alias("page_height"), F.posexplode("page.blocks").alias("block_ord", "block"))
    return blocks.select("source", "page_index", "page_width", "page_height", "block_ord", F.col("block.kind").alias("block_kind"), F.posexplode("block.lines").alias("line_ord", "line")).select(
        "source", "page_index", "page_width", "page_height", "block_ord", "block_kind", "line_ord", "line.*"
    )


def text_of(pages: Column) -> Column:
    """The text of a document: lines joined by a line feed, blocks by two, pages by a form feed on a line of its own."""
    block = lambda b: F.array_join(F.transform(b["lines"], lambda x: x["text"]), "\n")
    return F.array_join(F.transform(pages, lambda p: F.array_join(F.transform(p["blocks"], block), "\n\n")), "\n\f\n")
