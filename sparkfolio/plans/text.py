"""Queries of scalar functions and of operators on sequences of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.functions import text as t
from sparkfolio.model import blocks_of_text, lines_of_texts
from sparkfolio.operators.sequences import budgeted, capped, hyphenated, joined_text
from sparkfolio.operators.terms import mapped
from sparkfolio.plans.searches import LINES
from sparkfolio.registry import query, table
from sparkfolio.sources.text_readers import separator


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g'), ' ') AS text FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single spaces; the tables have no invisible characters."""
    return table(spark, sf_dir, "documents").select("doc_id", t.clean(F.col("text")).alias("text"))


@query("SELECT doc_id, sha256(text) AS sha256, md5(text) AS md5 FROM documents")
def sha256_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256"), F.md5(F.col("text").cast("binary")).alias("md5"))


@query("SELECT doc_id, CAST(to_json(text) AS VARCHAR) AS quoted FROM documents")
def json_quote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.yaml(F.col("text")).alias("quoted"))


@query("""SELECT item_id, replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), chr(39), '&#39;') AS xml,
          CASE WHEN regexp_matches(text, '[",\\n\\r]') THEN '"' || replace(text, '"', '""') || '"' ELSE text END AS csv FROM benchmark""")
def escapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select("item_id", t.escape_xml(F.col("text")).alias("xml"), t.escape_csv(F.col("text")).alias("csv"))


_ROMAN = "||".join(f"(['', {', '.join(repr(x) for x in names)}])[CAST(floor(n / {size}) AS INT) % 10 + 1]" for size, names in ((1000, ("M", "MM", "MMM")), (100, ("C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM")), (10, ("X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC")), (1, ("I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"))))


@query(f"WITH p AS (SELECT p_partkey, p_partkey AS n FROM part) SELECT p_partkey, CASE WHEN n BETWEEN 1 AND 3999 THEN {_ROMAN} ELSE n::VARCHAR END AS roman, CASE WHEN n >= 1 THEN repeat(chr(CAST(97 + (n - 1) % 26 AS INT)), CAST(floor((n - 1) / 26) + 1 AS BIGINT)) ELSE n::VARCHAR END AS letters FROM p")
def numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Roman and letter numbers."""
    n = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", t.roman(n).alias("roman"), t.letters(n).alias("letters"))


@query("SELECT o_orderkey, CASE WHEN s >= 1 THEN TIMESTAMP '1970-01-01' + to_seconds(CAST(floor((s - 25569.0) * 86400 + 0.5) AS BIGINT)) END AS stamp FROM (SELECT o_orderkey, o_totalprice / 10 + 60.0 AS s FROM orders)")
def excel_serial_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Day numbers of a spreadsheet, to the second."""
    return table(spark, sf_dir, "orders").select("o_orderkey", t.excel_date(F.col("o_totalprice") / 10 + 60.0).alias("stamp"))


@query("""SELECT p_partkey, list_extract([',', ';', chr(9), '|'], list_position(list_transform([',', ';', chr(9), '|'], lambda d: length(p) - length(replace(p, d, ''))), list_max(list_transform([',', ';', chr(9), '|'], lambda d: length(p) - length(replace(p, d, '')))))) AS delimiter
          FROM (SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ';;' WHEN 1 THEN '||,' ELSE ',,' END || p_brand AS p FROM part)""")
def delimiter_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The separator that occurs most; the first of equals."""
    n = F.pmod("p_partkey", F.lit(3))
    line = F.concat("p_name", F.when(n == 0, ";;").when(n == 1, "||,").otherwise(",,"), "p_brand")
    lines = table(spark, sf_dir, "part").select("p_partkey", line.alias("line"))
    return mapped(lines, "p_partkey", "line", "delimiter string", lambda x: [{"delimiter": separator(x)}])


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) <= 5")
def row_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first five rows of each sheet: the cap is the feature."""
    return capped(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey", 5)


@query("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, sum(o_orderkey % 7 + 1) OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders) WHERE n <= 20")
def cell_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", (F.pmod("o_orderkey", F.lit(7)) + 1).alias("n_cells"))
    return budgeted(rows, "o_custkey", "o_orderkey", "n_cells", 20).drop("n_cells")


@query(
    rf"""
    WITH {LINES}, n AS (SELECT doc_id, block_ord, line_ord, text, lead(text) OVER (PARTITION BY doc_id, block_ord ORDER BY line_ord) AS after FROM lines)
    SELECT doc_id, CAST(block_ord AS INT) AS block_ord, CAST(line_ord AS INT) AS line_ord, text, after FROM n
    WHERE regexp_matches(text, '[a-z.,]$') AND regexp_matches(after, '^[A-Za-z]')
    """
)
def hyphen_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that the next one may carry on, found within the block's array."""
    return hyphenated(table(spark, sf_dir, "documents"), "[a-z.,]$", "^[A-Za-z]")


@query(
    """
    WITH t AS (SELECT list(list_reduce(list_prepend(i::BIGINT, range(8)), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS crc FROM (SELECT unnest(range(256)) AS i)),
    b AS (SELECT page_id, url, list_prepend(4294967295::BIGINT, list_transform(range(1, length(url) + 1), lambda i: unicode(substring(url, i, 1))::BIGINT)) AS bytes FROM pages WHERE url IS NOT NULL)
    SELECT page_id, url FROM b, t WHERE xor(list_reduce(bytes, lambda c, b: xor(c >> 8, crc[CAST(xor(c, b) & 255 AS INT) + 1])), 4294967295) % 5 = 1
    """
)
def shard_crc32(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard 2 of 5 of the page addresses."""
    return table(spark, sf_dir, "pages").where(t.shard(F.col("url"), 2, 5)).select("page_id", "url")


@query("SELECT doc_id, CASE WHEN n < 1000 THEN n || ' B' WHEN n < 1000000 THEN printf('%.1f kB', round(n / 1e3, 1)) ELSE printf('%.1f MB', round(n / 1e6, 1)) END AS size, (n % 3) || CASE WHEN n % 3 = 1 THEN ' page' ELSE ' pages' END AS pages FROM (SELECT doc_id, n_chars AS n FROM documents)")
def human_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", t.size_text(F.col("n_chars")).alias("size"), t.count_text(F.pmod("n_chars", F.lit(3)), "page").alias("pages"))


@query("SELECT doc_id FROM documents WHERE regexp_matches(trim(string_split(text, chr(10))[1], ' '), '^[0-9]+$')")
def figure_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose first line is a figure."""
    first = F.get(F.split("text", "\n"), F.lit(0))
    return table(spark, sf_dir, "documents").where(t.is_figure(F.trim(first))).select("doc_id")


@query(rf"WITH {LINES} SELECT doc_id, max(length(text)) AS longest FROM lines GROUP BY doc_id")
def longest_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = lines_of_texts(table(spark, sf_dir, "documents"), "doc_id")
    return lines.groupBy("doc_id").agg(F.max(F.length("text")).cast("bigint").alias("longest"))


@query(
    """
    SELECT l_orderkey, l_linenumber, printf('%d:%02d:%02d', s // 3600, s // 60 % 60, s % 60) AS duration, CASE WHEN ms < 1000 THEN ms || ' ms' WHEN ms < 60000 THEN printf('%.1f s', ms / 1000) ELSE printf('%d min %d s', ms // 60000, ms % 60000 // 1000) END AS shown
    FROM (SELECT *, CAST(floor(l_discount * 30 * 86400 + 0.5) AS BIGINT) AS s, CAST(l_partkey * 100 AS BIGINT) AS ms FROM lineitem)
    """
)
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of days as hours and minutes, milliseconds for people."""
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", t.duration(F.col("l_discount") * 30).alias("duration"), t.duration_text((F.col("l_partkey") * 100).cast("bigint")).alias("shown"))


@query(rf"WITH {LINES}, b AS (SELECT doc_id, block_ord, list(text ORDER BY line_ord) AS l FROM lines GROUP BY ALL) SELECT doc_id, CAST(block_ord AS INT) AS block_ord, array_to_string(l, ' ') AS text FROM b WHERE NOT list_has_any(list_transform(l, lambda x: right(x, 1)), ['-', chr(173)])")
def joined_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks without parted words as one text each."""
    blocks = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks_of_text()).alias("block_ord", "block"))
    lines = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    made = blocks.select("doc_id", "block_ord", lines.alias("l")).where(F.size("l") > 0)
    return made.where(~F.exists("l", lambda x: x.rlike("[-\u00ad]$"))).select("doc_id", "block_ord", joined_text(F.col("l")).alias("text"))
