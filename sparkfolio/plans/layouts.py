"""Queries of geometry, columns, tables and reading order; customers and parts give boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.functions.geometry import bounds, box, horizontal_overlap, iou, quarter_turned, vertical_overlap
from sparkfolio.operators import tables
from sparkfolio.operators.layout import Box, blocks_of_pages, paragraphs
from sparkfolio.operators.marks import unread
from sparkfolio.operators.terms import mapped
from sparkfolio.registry import query, table

BOXES = "b AS (SELECT p_partkey AS id, p_partkey // 20 AS page, CAST(p_partkey % 7 * 100 AS DOUBLE) AS x0, CAST(p_partkey % 5 * 40 AS DOUBLE) AS y0, p_partkey % 7 * 100 + p_size * 4.0::DOUBLE AS x1, CAST(p_partkey % 5 * 40 + 30 AS DOUBLE) AS y1 FROM part)"


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes on pages of twenty."""
    k = F.col("p_partkey")
    x0, y0 = (k % 7 * 100).cast("double"), (k % 5 * 40).cast("double")
    return table(spark, sf_dir, "part").select(k.alias("id"), F.floor(k / 20).cast("bigint").alias("page"), x0.alias("x0"), y0.alias("y0"), (x0 + F.col("p_size") * 4.0).alias("x1"), (y0 + 30).alias("y1"))


@query(
    f"""
    WITH {BOXES}, p AS (SELECT a.page, a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) * greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) AS i,
          (a.x1 - a.x0) * (a.y1 - a.y0) AS s, (b.x1 - b.x0) * (b.y1 - b.y0) AS t FROM b a JOIN b ON a.page = b.page AND a.id < b.id)
    SELECT page, a, b, round(i / (s + t - i), 8) AS iou FROM p WHERE i > 0
    """
)
def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page that overlap: pages have twenty boxes each, so their pairs are bounded."""
    b = boxes(spark, sf_dir)
    left, right = b.select("page", *(F.col(c).alias(f"a_{c}") for c in ("id", "x0", "y0", "x1", "y1"))), b.select("page", *(F.col(c).alias(f"b_{c}") for c in ("id", "x0", "y0", "x1", "y1")))
    pairs = left.join(right, "page").where("a_id < b_id")
    return pairs.select("page", F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(iou(box("a_"), box("b_")), 8).alias("iou")).where("iou > 0")


@query(f"WITH {BOXES} SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM b GROUP BY page")
def page_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes(spark, sf_dir).groupBy("page").agg(*bounds())


@query(
    f"""
    WITH {BOXES}, e AS (SELECT page, x0 AS x, 1 AS s FROM b UNION ALL SELECT page, x1, -1 FROM b),
    g AS (SELECT page, x, sum(s) AS s FROM e GROUP BY page, x),
    r AS (SELECT page, x, sum(s) OVER (PARTITION BY page ORDER BY x) AS n, lead(x) OVER (PARTITION BY page ORDER BY x) AS after FROM g),
    k AS (SELECT *, n >= 2 AND coalesce(lag(n) OVER (PARTITION BY page ORDER BY x), 0) < 2 AS opens FROM r),
    i AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY x) AS band FROM k)
    SELECT page, CAST(band AS BIGINT) AS band, min(x) AS x0, max(after) AS x1 FROM i WHERE n >= 2 GROUP BY page, band
    """
)
def column_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stretches that two boxes of a page or more cover."""
    each = lambda cells: [{"band": k, "x0": a, "x1": b} for k, (a, b) in enumerate(tables.column_bands([(c["x0"], c["x1"], "") for c in cells], 1e-9), 1)]
    return mapped(cells_of_pages(spark, sf_dir), "page", "cells", "band bigint, x0 double, x1 double", each)


def cells_of_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes of each page as an array."""
    return boxes(spark, sf_dir).groupBy("page").agg(F.sort_array(F.collect_list(F.struct("y0", "x0", "id", "x1"))).alias("cells"))


@query(
    f"""
    WITH {BOXES}, o AS (SELECT page, y0, x0 - lag(x1) OVER (PARTITION BY page, y0 ORDER BY x0, id) AS gap FROM b),
    s AS (SELECT page, list_sort(list(gap) FILTER (gap > 0)) AS g, count(gap) AS n FROM o GROUP BY page),
    j AS (SELECT page, g, n, list_max(list_transform(list_filter(range(1, len(g)), lambda k: g[k + 1] / g[k] >= 1.5 AND k >= 0.1 * len(g)), lambda k: struct_pack(r := g[k + 1] / g[k], m := sqrt(g[k] * g[k + 1])))) AS jump FROM s),
    w AS (SELECT page, CASE WHEN jump IS NULL THEN 0 ELSE least(2 * CASE WHEN len(g) > 0 THEN g[CAST(floor((len(g) - 1) * 0.25 + 0.5) AS BIGINT) + 1] ELSE 30 END, jump.m) END AS wide FROM j)
    SELECT page, round(least(greatest(22.5, 1, wide), 75), 8) AS gutter FROM w
    """
)
def gutter_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The least gap that parts cells of a page, where text is 30 high."""

    def each(cells: list[dict]) -> list[dict]:
        gaps = [b["x0"] - a["x1"] for a, b in zip(cells, cells[1:], strict=False) if a["y0"] == b["y0"]]
        return [{"gutter": round(float(tables.gutter(gaps, 30.0)), 8)}]

    return mapped(cells_of_pages(spark, sf_dir), "page", "cells", "gutter double", each)


@query(
    f"""
    WITH {BOXES}, c AS (SELECT unnest(range(7)) AS k), p AS (SELECT id, k, least(x1, k * 100 + 80) - greatest(x0, k * 100) AS o, least(80, x1 - x0) AS n, abs((x0 + x1) / 2 - (k * 100 + 40)) AS far FROM b, c),
    h AS (SELECT id, min(CASE WHEN n > 0 AND o >= 0.2 * n THEN k END) AS a, max(CASE WHEN n > 0 AND o >= 0.2 * n THEN k END) AS z, arg_min(k, far * 10 + k) AS near FROM p GROUP BY id)
    SELECT id, CAST(coalesce(a, near) AS INT) AS col, CAST(coalesce(z - a, 0) + 1 AS INT) AS span FROM h
    """
)
def cell_placement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns that each box falls into: those it overlaps by a fifth of the narrower, else the nearest."""
    columns = [(k * 100.0, k * 100.0 + 80) for k in range(7)]

    def each(cells: list[dict]) -> list[dict]:
        found = [tables.place((c["x0"], c["x1"], ""), columns) for c in cells]
        return [{"id": c["id"], "col": k, "span": n} for c, (k, n) in zip(cells, found, strict=True)]

    return mapped(cells_of_pages(spark, sf_dir), "page", "cells", "id bigint, col int, span int", each).drop("page")


@query(
    """
    WITH o AS (SELECT o_custkey AS page, o_orderkey, row_number() OVER w AS k, CASE WHEN o_orderkey % 5 = 0 AND row_number() OVER w > 1 THEN 1 ELSE 0 END AS opens FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)),
    p AS (SELECT *, sum(opens) OVER (PARTITION BY page ORDER BY k) AS part FROM o)
    SELECT page, CAST(part AS BIGINT) AS part, count(*) AS n_lines, min(o_orderkey)::VARCHAR AS first_line FROM p GROUP BY page, part
    """
)
def paragraph_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages in paragraphs, which a wide gap parts: a customer's orders, with one before each fifth number."""
    o = table(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    y = F.row_number().over(w) * 35.0 + F.sum(F.when(F.col("o_orderkey") % 5 == 0, 60.0).otherwise(0.0)).over(w)
    lines = o.select(F.col("o_custkey").alias("page"), F.struct(y.alias("y0"), F.col("o_orderkey").cast("string").alias("text")).alias("x")).groupBy("page").agg(F.sort_array(F.collect_list("x")).alias("lines"))

    def each(rows: list[dict]) -> list[dict]:
        parts = paragraphs([Box(r["text"], 100.0, r["y0"], 400.0, r["y0"] + 30.0) for r in rows])
        return [{"part": k, "n_lines": len(p), "first_line": p[0].text} for k, p in enumerate(parts)]

    return mapped(lines, "page", "lines", "part bigint, n_lines bigint, first_line string", each)


def tables_of_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of twenty parts printed as price lists: name, size and price in columns."""
    p = table(spark, sf_dir, "part").withColumn("page", F.floor(F.col("p_partkey") / 20).cast("bigint"))
    y = 200.0 + F.pmod("p_partkey", F.lit(20)) * 45.0
    cell = lambda text, x: F.struct(text.alias("text"), F.lit(float(x)).alias("x0"), y.alias("y0"), (F.lit(float(x)) + F.length(text) * 9.0).alias("x1"), (y + 30).alias("y1"), F.lit(0.98).alias("confidence"))
    cells = F.array(cell(F.col("p_name"), 100), cell(F.col("p_size").cast("string"), 800), cell(F.format_string("%.2f", "p_retailprice"), 1200))
    rows = p.select("page", F.explode(cells).alias("c"))
    return rows.groupBy("page").agg(F.lit(1654.0).alias("width"), F.sort_array(F.collect_list("c")).alias("boxes"))


@query("SELECT p_partkey // 20 AS page, count(*) AS n_rows, 3 AS n_columns, sum(p_size) AS total FROM part GROUP BY 1 HAVING count(*) >= 3")
def table_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables found on pages, with the sum of their second column."""
    found = blocks_of_pages(tables_of_parts(spark, sf_dir)).where("kind = 'table'")
    second = F.aggregate(F.filter("cells", lambda c: c["column"] == 1), F.lit(0).cast("bigint"), lambda n, c: n + c["text"].try_cast("bigint"))
    return found.select("page", F.col("n_rows").cast("bigint").alias("n_rows"), "n_columns", second.alias("total"))


@query("SELECT o_custkey AS page, string_agg(o_orderkey::VARCHAR, ' ' ORDER BY o_orderkey) AS words FROM orders GROUP BY o_custkey HAVING count(*) >= 8")
def reading_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages in two columns, given in no order, read column by column."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("page"), "o_orderkey")
    w = Window.partitionBy("page").orderBy("o_orderkey")
    o = o.withColumns({"k": F.row_number().over(w) - 1, "n": F.count("*").over(Window.partitionBy("page"))}).where("n >= 8")
    half = F.ceil(F.col("n") / 2)
    x = F.when(F.col("k") < half, 100.0).otherwise(900.0)
    y = 200.0 + F.pmod("k", half) * 40.0
    b = F.struct(F.col("o_orderkey").cast("string").alias("text"), x.alias("x0"), y.alias("y0"), (x + 500).alias("x1"), (y + 30).alias("y1"), F.lit(0.98).alias("confidence"))
    pages = o.groupBy("page").agg(F.lit(1654.0).alias("width"), F.array_sort(F.collect_list(b)).alias("boxes"))
    blocks = blocks_of_pages(pages)
    by = blocks.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("block_ord", "text"))).alias("b"))
    return by.select("page", F.regexp_replace(F.array_join(F.transform("b", lambda b: b["text"]), " "), "\n", " ").alias("words"))


@query(
    f"""
    WITH {BOXES}, p AS (SELECT a.id AS a, b.id AS b, greatest(least(a.x1, b.x1) - greatest(a.x0, b.x0), 0) / least(a.x1 - a.x0, b.x1 - b.x0) AS across, greatest(least(a.y1, b.y1) - greatest(a.y0, b.y0), 0) / least(a.y1 - a.y0, b.y1 - b.y0) AS down FROM b a JOIN b ON b.id = a.id + 1)
    SELECT a, b, round(across, 8) AS across, round(down, 8) AS down FROM p
    """
)
def neighbour_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each box and the next one share their width and height."""
    b = boxes(spark, sf_dir)
    side = lambda c, k: b.select((F.col("id") - k).alias("k"), *(F.col(x).alias(f"{c}_{x}") for x in ("id", "x0", "y0", "x1", "y1")))
    pairs = side("a", 0).join(side("b", 1), "k")
    return pairs.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), F.round(horizontal_overlap(box("a_"), box("b_")), 8).alias("across"), F.round(vertical_overlap(box("a_"), box("b_")), 8).alias("down"))


@query(f"WITH {BOXES} SELECT id, CASE id % 4 WHEN 0 THEN x0 WHEN 1 THEN y0 WHEN 2 THEN 1000 - x0 ELSE 1000 - y0 END AS x, CASE id % 4 WHEN 0 THEN y0 WHEN 1 THEN 1400 - x0 WHEN 2 THEN 1400 - y0 ELSE x0 END AS y FROM b")
def turned_corners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Corners of boxes on pages that were turned by quarters."""
    p = quarter_turned(F.col("x0"), F.col("y0"), F.lit(1000.0), F.lit(1400.0), (F.col("id") % 4).cast("int"))
    return boxes(spark, sf_dir).select("id", p.alias("p")).select("id", "p.x", "p.y")


@query(
    f"""
    WITH {BOXES}, t AS (SELECT b.*, p_brand AS text FROM b JOIN part ON p_partkey = id), s AS (SELECT id, page, upper(replace(text, '#', ' #')) AS text, x0 + 20 AS x0, y0 + 3 AS y0, x1 + 20 AS x1, y1 + 3 AS y1 FROM t WHERE id % 2 = 0),
    l AS (SELECT * FROM t WHERE id % 4 <> 2),
    m AS (SELECT s.id FROM s JOIN l ON s.page = l.page AND lower(regexp_replace(s.text, '\\s+', '', 'g')) = lower(regexp_replace(l.text, '\\s+', '', 'g'))
          WHERE greatest(least(s.x1, l.x1) - greatest(s.x0, l.x0), 0) * greatest(least(s.y1, l.y1) - greatest(s.y0, l.y0), 0) > 0.5 * ((s.x1 - s.x0) * (s.y1 - s.y0) + (l.x1 - l.x0) * (l.y1 - l.y0) - greatest(least(s.x1, l.x1) - greatest(s.x0, l.x0), 0) * greatest(least(s.y1, l.y1) - greatest(s.y0, l.y0), 0)))
    SELECT id, page FROM s WHERE id NOT IN (SELECT id FROM m)
    """
)
def unread_stamps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second box as a stamp, a little aside: those that no line has read."""
    brand = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("text"))
    lines = boxes(spark, sf_dir).join(brand, "id")
    aside = {"text": F.upper(F.replace("text", F.lit("#"), F.lit(" #"))), **{c: F.col(c) + 20 for c in ("x0", "x1")}, **{c: F.col(c) + 3 for c in ("y0", "y1")}}
    return unread(lines.where("id % 2 = 0").withColumns(aside), lines.where("id % 4 <> 2"), "page").select("id", "page")
