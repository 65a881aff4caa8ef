"""Documents of the nested model as text, Markdown, JSON, CSV, hOCR and ALTO, by built-in expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.functions.text import escape_cell, escape_csv, escape_xml
from sparkfolio.model import text_of


def grid(table: Column) -> Column:
    """Rows of a table as arrays of texts; gaps are empty."""
    cells = lambda r: F.transform(F.sequence(F.lit(0), table["columns"] - 1), lambda c: F.array_join(F.transform(F.filter(table["cells"], lambda x: (x["row"] == r) & (x["column"] == c)), lambda x: x["text"]), " "))
    return F.transform(F.sequence(F.lit(0), table["rows"] - 1), cells)


def table_csv(table: Column) -> Column:
    return F.array_join(F.transform(grid(table), lambda r: F.array_join(F.transform(r, escape_csv), ",")), "\n")


def table_markdown(table: Column) -> Column:
    line = lambda r: F.concat(F.lit("| "), F.array_join(F.transform(r, escape_cell), " | "), F.lit(" |"))
    rows = F.transform(grid(table), line)
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), table["columns"]))
    return F.array_join(F.concat(F.slice(rows, 1, 1), F.array(rule), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))), "\n")


def lines_text(block: Column, glue: str = "\n") -> Column:
    return F.array_join(F.transform(block["lines"], lambda x: x["text"]), glue)


def markdown(pages: Column) -> Column:
    """Headings of the second level, items with dashes, pipe tables; a rule between pages, no tick boxes."""
    bullet = r"^\s*[•‣◦▪\-*·]\s+"
    block = lambda b: (
        F.when(b["kind"] == "heading", F.concat(F.lit("## "), lines_text(b, " ")))
        .when(b["kind"] == "list_item", F.concat(F.lit("- "), F.regexp_replace(lines_text(b, " "), bullet, "")))
        .when((b["kind"] == "table") & b["table"].isNotNull(), table_markdown(b["table"]))
        .otherwise(lines_text(b))
    )
    page = lambda p: F.array_join(F.transform(F.filter(p["blocks"], lambda b: b["kind"] != "tick_box"), block), "\n\n")
    return F.array_join(F.transform(pages, page), "\n\n---\n\n")


def json(document: DataFrame) -> Column:
    return F.to_json(F.struct("source", "pages", "elapsed_ms"))


def csv_rows(pages: Column) -> Column:
    """page, block, line, box, confidence and text of each line."""
    head = F.lit("page,block,line,x0,y0,x1,y1,confidence,text")
    line = lambda p, b, x, l: F.concat_ws(",", (p["index"] + 1).cast("string"), b.cast("string"), l.cast("string"), *(F.format_string("%.1f", x[k]) for k in ("x0", "y0", "x1", "y1")), F.format_string("%.4f", x["confidence"]), escape_csv(x["text"]))
    rows = F.flatten(F.flatten(F.transform(pages, lambda p: F.transform(p["blocks"], lambda b, k: F.transform(b["lines"], lambda x, l: line(p, k, x, l))))))
    return F.array_join(F.concat(F.array(head), rows), "\n")


def place(x: Column) -> Column:
    return F.format_string("bbox %d %d %d %d", *(F.round(x[k]).cast("int") for k in ("x0", "y0", "x1", "y1")))


def spelled(x: Column) -> Column:
    """Words of a line if they spell it, else the line as one."""
    own = F.array_join(F.transform(x["words"], lambda w: w["text"]), " ")
    whole = F.array(F.struct(x["text"].alias("text"), *(x[k].alias(k) for k in ("x0", "y0", "x1", "y1", "confidence"))))
    return F.when((F.size(x["words"]) > 0) & (own == x["text"]), x["words"]).otherwise(whole)


def hocr(source: Column, pages: Column) -> Column:
    word = lambda w: F.concat(F.lit("<span class='ocrx_word' title='"), place(w), F.format_string("; x_wconf %d'>", F.round(w["confidence"] * 100).cast("int")), escape_xml(w["text"]), F.lit("</span>"))
    line = lambda x: F.concat(F.lit("<span class='ocr_line' title='"), place(x), F.lit("'>"), F.array_join(F.transform(spelled(x), word), " "), F.lit("</span>"))
    block = lambda b: F.concat(F.lit("<div class='ocr_carea' title='"), place(b), F.lit("'><p class='ocr_par' title='"), place(b), F.lit("'>\n"), F.array_join(F.transform(b["lines"], line), "\n"), F.lit("\n</p></div>"))
    page = lambda p: F.concat(F.format_string("<div class='ocr_page' id='page_%d' title='bbox 0 0 %d %d'>\n", p["index"] + 1, p["width"], p["height"]), F.array_join(F.transform(p["blocks"], block), "\n"), F.lit("\n</div>"))
    head = F.concat(F.lit("<!DOCTYPE html>\n<html><head><meta charset='utf-8'/><meta name='ocr-capabilities' content='ocr_page ocr_carea ocr_par ocr_line ocrx_word'/><title>"), escape_xml(source), F.lit("</title></head><body>\n"))
    return F.concat(head, F.array_join(F.transform(pages, page), "\n"), F.lit("\n</body></html>\n"))


def alto(source: Column, pages: Column) -> Column:
    at = lambda x: F.format_string('HPOS="%d" VPOS="%d" WIDTH="%d" HEIGHT="%d"', F.round(x["x0"]).cast("int"), F.round(x["y0"]).cast("int"), F.round(x["x1"] - x["x0"]).cast("int"), F.round(x["y1"] - x["y0"]).cast("int"))
    word = lambda w: F.concat(F.lit("<String "), at(w), F.format_string(' WC="%.4f" CONTENT="', w["confidence"]), escape_xml(w["text"]), F.lit('"/>'))
    line = lambda x: F.concat(F.lit("<TextLine "), at(x), F.lit(">"), F.array_join(F.transform(spelled(x), word), "<SP/>"), F.lit("</TextLine>"))
    block = lambda b: F.concat(F.lit("<TextBlock "), at(b), F.lit(">"), F.array_join(F.transform(b["lines"], line), ""), F.lit("</TextBlock>"))
    page = lambda p: F.concat(F.format_string('<Page ID="p%d" PHYSICAL_IMG_NR="%d" WIDTH="%d" HEIGHT="%d"><PrintSpace>', p["index"] + 1, p["index"] + 1, p["width"], p["height"]), F.array_join(F.transform(p["blocks"], block), ""), F.lit("</PrintSpace></Page>"))
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit><sourceImageInformation><fileName>'), escape_xml(source), F.lit("</fileName></sourceImageInformation></Description><Layout>"))
    return F.concat(head, F.array_join(F.transform(pages, page), ""), F.lit("</Layout></alto>\n"))


FORMATS: dict[str, Callable[[], Column]] = {
    "text": lambda: text_of(F.col("pages")),
    "markdown": lambda: markdown(F.col("pages")),
    "json": lambda: F.to_json(F.struct("source", "pages", "elapsed_ms")),
    "csv": lambda: csv_rows(F.col("pages")),
    "hocr": lambda: hocr(F.col("source"), F.col("pages")),
    "alto": lambda: alto(F.col("source"), F.col("pages")),
}
ALIASES = {"txt": "text", "md": "markdown", "xml": "alto"}


def export(documents: DataFrame, form: str) -> DataFrame:
    """source and content of documents in a format; aliases count."""
    name = ALIASES.get(form, form)
    if name not in FORMATS:
        raise ValueError(f"unknown format {form!r}; use {', '.join([*FORMATS, *ALIASES])}")
    return documents.select("source", FORMATS[name]().alias("content"))


def documents_of_texts(docs: DataFrame) -> DataFrame:
    """Stored texts in the nested model: a page each, blocks between blank lines, by the model's geometry. No shuffle."""
    from sparkfolio.model import BLOCK, CHAR, HEIGHT, LEFT, LINE, SHEET, STEP, TOP, WIDTH

    line = lambda text, at: F.struct(text.alias("text"), F.lit(float(LEFT)).alias("x0"), (F.lit(float(TOP)) + at * STEP).alias("y0"), (F.lit(float(LEFT)) + F.length(text) * CHAR).alias("x1"), (F.lit(float(TOP + HEIGHT)) + at * STEP).alias("y1"), F.lit(0.98).alias("confidence"), F.lit(0.0).alias("angle"), F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>").alias("words"), F.array().cast("array<struct<text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>").alias("segments"))
    rows = F.transform(F.split("text", "\n"), lambda x, k: F.struct(x.alias("text"), k.alias("at")))
    # a blank line is an empty struct between blocks: rows are cut there by a fold over lines
    state = F.struct(F.array().cast(f"array<array<{LINE}>>").alias("done"), F.array().cast(f"array<{LINE}>").alias("now"))
    step = lambda s, x: F.when(F.trim(x["text"]) != "", F.struct(s["done"].alias("done"), F.array_append(s["now"], line(x["text"], x["at"])).alias("now"))).otherwise(F.struct(F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]).alias("done"), F.array().cast(f"array<{LINE}>").alias("now")))
    folded = F.aggregate(rows, state, step, lambda s: F.when(F.size(s["now"]) > 0, F.array_append(s["done"], s["now"])).otherwise(s["done"]))
    block = lambda b: F.struct(F.lit("paragraph").alias("kind"), F.lit(float(LEFT)).alias("x0"), b[0]["y0"].alias("y0"), F.array_max(F.transform(b, lambda x: x["x1"])).alias("x1"), F.element_at(b, -1)["y1"].alias("y1"), b.alias("lines"), F.lit(None).cast("struct<rows:int,columns:int,cells:array<struct<row:int,column:int,column_span:int,text:string,x0:double,y0:double,x1:double,y1:double,confidence:double>>>").alias("table")).cast(BLOCK)
    page = F.struct(F.lit(0).alias("index"), F.lit(WIDTH).alias("width"), F.greatest(F.lit(SHEET), F.lit(2 * TOP) + F.size(F.split("text", "\n")) * STEP).alias("height"), F.lit(0.0).alias("rotation"), F.lit("pdf_text").alias("origin"), F.lit(None).cast("double").alias("quality"), F.transform(folded, block).alias("blocks"))
    return docs.where("text is not null").select(F.col("doc_id").cast("string").alias("source"), F.array(page).alias("pages"), F.lit(0.0).alias("elapsed_ms"))
