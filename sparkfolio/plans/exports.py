"""Queries of exports: texts through the nested model and out again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import escape_cell, escape_csv
from sparkfolio.model import document_type
from sparkfolio.operators.exports import documents_of_texts, export, table_csv, table_markdown
from sparkfolio.plans.searches import LINES
from sparkfolio.operators.terms import mapped
from sparkfolio.registry import query, table
from sparkfolio.sources import notes


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents_of_texts(table(spark, sf_dir, "documents"))


TEXT = f"WITH {LINES}, b AS (SELECT doc_id, block_ord, string_agg(text, chr(10) ORDER BY line_ord) AS t FROM lines GROUP BY ALL), d AS (SELECT doc_id, string_agg(t, chr(10) || chr(10) ORDER BY block_ord) AS t FROM b GROUP BY doc_id), e AS (SELECT documents.doc_id, t FROM documents LEFT JOIN d ON documents.doc_id = d.doc_id)"


@query(f"{TEXT} SELECT doc_id::VARCHAR AS source, coalesce(t, '') AS content FROM e")
def text_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(documents(spark, sf_dir), "text")


@query(f"{TEXT} SELECT doc_id::VARCHAR AS source, coalesce(t, '') AS content FROM e")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs alone, so that it is the text."""
    return export(documents(spark, sf_dir), "markdown")


#: Lines of documents with their number in the text, block and place in it, and the size of their page.
LAID = r"""
    r AS (SELECT doc_id, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos, greatest(2338, 600 + len(l) * 40) AS height FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
    k AS (SELECT *, trim(text, ' ') <> '' AS full_ FROM r),
    b AS (SELECT *, CASE WHEN full_ AND NOT coalesce(lag(full_) OVER (PARTITION BY doc_id ORDER BY pos), false) THEN 1 ELSE 0 END AS opens FROM k),
    c AS (SELECT *, sum(opens) OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS block FROM b),
    l AS (SELECT *, row_number() OVER (PARTITION BY doc_id, block ORDER BY pos) - 1 AS line, 300 + pos * 40 AS y, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS xml FROM c WHERE full_),
    d AS (SELECT doc_id, max(height) AS height FROM r GROUP BY doc_id)
"""
AREA = "printf('bbox 100 %d %d %d', min(y), CAST(100 + 12 * max(length(text)) AS INT), CAST(max(y) + 30 AS INT))"
PLACE = "printf('bbox 100 %d %d %d', y, CAST(100 + 12 * length(text) AS INT), CAST(y + 30 AS INT))"
SPAN = """printf('HPOS="100" VPOS="%d" WIDTH="%d" HEIGHT="30"', y, CAST(12 * length(text) AS INT))"""


@query(
    rf"""
    WITH {LAID}, t AS (SELECT doc_id, pos, printf('1,%d,%d,%.1f,%.1f,%.1f,%.1f,%.4f,', block, line, 100.0, 300.0 + pos * 40, 100.0 + length(text) * 12, 330.0 + pos * 40, 0.98)
                 || CASE WHEN regexp_matches(text, '[",\n\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS row_ FROM l)
    SELECT d.doc_id::VARCHAR AS source, 'page,block,line,x0,y0,x1,y1,confidence,text' || coalesce(chr(10) || string_agg(row_, chr(10) ORDER BY pos), '') AS content FROM d LEFT JOIN t ON d.doc_id = t.doc_id GROUP BY d.doc_id
    """
)
def lines_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(documents(spark, sf_dir), "csv")


@query(f"{TEXT} SELECT doc_id::VARCHAR AS source, sha256(coalesce(t, '')) AS sha256 FROM e")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as JSON and back: the same text."""
    back = export(documents(spark, sf_dir), "json").select(F.from_json("content", document_type()).alias("d")).select("d.*")
    return export(back, "text").select("source", F.sha2("content", 256).alias("sha256"))


@query(
    f"""
    WITH {LAID}, n AS (SELECT *, '<span class=''ocr_line'' title=''' || {PLACE} || '''><span class=''ocrx_word'' title=''' || {PLACE} || '; x_wconf 98''>' || xml || '</span></span>' AS html FROM l),
    a AS (SELECT doc_id, block, '<div class=''ocr_carea'' title=''' || {AREA} || '''><p class=''ocr_par'' title=''' || {AREA} || '''>' || chr(10) || string_agg(html, chr(10) ORDER BY pos) || chr(10) || '</p></div>' AS html FROM n GROUP BY doc_id, block)
    SELECT d.doc_id::VARCHAR AS source, '<!DOCTYPE html>' || chr(10) || '<html><head><meta charset=''utf-8''/><meta name=''ocr-capabilities'' content=''ocr_page ocr_carea ocr_par ocr_line ocrx_word''/><title>' || d.doc_id || '</title></head><body>' || chr(10)
           || '<div class=''ocr_page'' id=''page_1'' title=''bbox 0 0 1654 ' || any_value(height) || '''>' || chr(10) || coalesce(string_agg(html, chr(10) ORDER BY block), '') || chr(10) || '</div>' || chr(10) || '</body></html>' || chr(10) AS content
    FROM d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id
    """
)
def hocr_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(documents(spark, sf_dir), "hocr")


@query(
    f"""
    WITH {LAID}, n AS (SELECT *, '<TextLine ' || {SPAN} || '><String ' || {SPAN} || ' WC="0.9800" CONTENT="' || xml || '"/></TextLine>' AS html FROM l),
    a AS (SELECT doc_id, block, printf('<TextBlock HPOS="100" VPOS="%d" WIDTH="%d" HEIGHT="%d">', min(y), CAST(12 * max(length(text)) AS INT), CAST(max(y) - min(y) + 30 AS INT)) || string_agg(html, '' ORDER BY pos) || '</TextBlock>' AS html FROM n GROUP BY doc_id, block)
    SELECT d.doc_id::VARCHAR AS source, '<?xml version="1.0" encoding="UTF-8"?>' || chr(10) || '<alto xmlns="http://www.loc.gov/standards/alto/ns-v4#"><Description><MeasurementUnit>pixel</MeasurementUnit><sourceImageInformation><fileName>' || d.doc_id
           || '</fileName></sourceImageInformation></Description><Layout><Page ID="p1" PHYSICAL_IMG_NR="1" WIDTH="1654" HEIGHT="' || any_value(height) || '"><PrintSpace>' || coalesce(string_agg(html, '' ORDER BY block), '') || '</PrintSpace></Page></Layout></alto>' || chr(10) AS content
    FROM d LEFT JOIN a ON d.doc_id = a.doc_id GROUP BY d.doc_id
    """
)
def alto_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    return export(documents(spark, sf_dir), "alto")


def grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations by region as tables: a row a nation; a cell is missing where the key is odd."""
    n = table(spark, sf_dir, "nation")
    cell = lambda c, text: F.struct((F.col("k") - 1).cast("int").alias("row"), F.lit(c).alias("column"), F.lit(1).alias("column_span"), text.alias("text"))
    from pyspark.sql import Window

    n = n.withColumn("k", F.row_number().over(Window.partitionBy("n_regionkey").orderBy("n_nationkey")))
    cells = F.array_compact(F.array(cell(0, F.col("n_name")), F.when(F.col("n_nationkey") % 2 == 0, cell(1, F.concat(F.lit("a|b, "), F.col("n_nationkey").cast("string"))))))
    return n.groupBy("n_regionkey").agg(F.max("k").cast("int").alias("rows"), F.flatten(F.collect_list(cells)).alias("cells")).select("n_regionkey", F.struct("rows", F.lit(2).alias("columns"), "cells").alias("t"))


GRID = "WITH n AS (SELECT n_regionkey, n_nationkey AS k, n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'a|b, ' || n_nationkey ELSE '' END AS v FROM nation)"


@query(f"""{GRID} SELECT n_regionkey, string_agg(n_name || ',' || CASE WHEN v <> '' THEN '"' || v || '"' ELSE '' END, chr(10) ORDER BY k) AS csv FROM n GROUP BY 1""")
def table_as_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("n_regionkey", table_csv(F.col("t")).alias("csv"))


@query(
    f"""{GRID}, r AS (SELECT *, '| ' || n_name || ' | ' || replace(v, '|', '\\|') || ' |' AS row_, row_number() OVER (PARTITION BY n_regionkey ORDER BY k) AS o FROM n)
    SELECT n_regionkey, string_agg(CASE WHEN o = 1 THEN row_ || chr(10) || '| --- | --- |' ELSE row_ END, chr(10) ORDER BY o) AS md FROM r GROUP BY 1"""
)
def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grids(spark, sf_dir).select("n_regionkey", table_markdown(F.col("t")).alias("md"))


@query("SELECT l_shipdate::DATE AS day, coalesce(sum(CASE WHEN l_returnflag = 'A' THEN l_quantity END), 0) AS a, coalesce(sum(CASE WHEN l_returnflag = 'N' THEN l_quantity END), 0) AS n, coalesce(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity END), 0) AS r FROM lineitem GROUP BY 1")
def table_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("day")).pivot("l_returnflag", ["A", "N", "R"]).agg(F.sum("l_quantity"))
    return li.na.fill(0.0).withColumnsRenamed({"A": "a", "N": "n", "R": "r"})


@query(
    r"""
    SELECT doc_id, '---' || chr(10) || CASE WHEN title <> '' THEN 'title: ' || to_json(title)::VARCHAR || chr(10) ELSE '' END || CASE WHEN lang IS NOT NULL THEN 'language: ' || to_json(lang)::VARCHAR || chr(10) ELSE '' END || 'rows: ' || n_chars || chr(10) || '---' || chr(10) AS head
    FROM (SELECT *, trim(regexp_replace(substring(string_split(text, chr(10))[1], 1, 40), '\s+', ' ', 'g')) AS title FROM documents WHERE text IS NOT NULL AND n_chars IS NOT NULL)
    """
)
def front_matter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Properties in fixed order; those that are null are left out."""
    first = F.substring(F.get(F.split("text", "\n"), F.lit(0)), 1, 40)
    docs = table(spark, sf_dir, "documents").where("text is not null and n_chars is not null").select("doc_id", F.struct(F.col("n_chars").alias("rows"), F.col("lang").alias("language"), first.alias("title")).alias("meta"))
    return mapped(docs, "doc_id", "meta", "head string", lambda meta: [{"head": notes.front_matter(meta)}])


@query("""SELECT conv_id, turn, role || ',' || CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv, '| ' || role || ' | ' || replace(regexp_replace(text, '\\s*\\n\\s*', ' ', 'g'), '|', '\\|') || ' |' AS md FROM conversations""")
def turns_as_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select("conv_id", "turn", F.concat("role", F.lit(","), escape_csv(F.col("text"))).alias("csv"), F.concat(F.lit("| "), "role", F.lit(" | "), escape_cell(F.col("text")), F.lit(" |")).alias("md"))
