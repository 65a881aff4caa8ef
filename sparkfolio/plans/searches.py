"""Queries of lines and of search in lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.model import blocks_of_text, lines_of_texts, positioned_lines, zone
from sparkfolio.operators.search import near, search, search_counts
from sparkfolio.registry import query, table

#: The lines of documents in SQL, as the model has them.
LINES = r"""
    blocks AS (SELECT doc_id, lang, source, unnest(b) AS block, generate_subscripts(b, 1) - 1 AS block_ord
               FROM (SELECT doc_id, lang, source, regexp_split_to_array(text, '\n(?:[ \t]*\n)+') AS b FROM documents WHERE text IS NOT NULL)),
    rows AS (SELECT doc_id, lang, source, block_ord, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS line_ord
             FROM (SELECT doc_id, lang, source, block_ord, string_split(block, chr(10)) AS l FROM blocks)),
    lines AS (SELECT * FROM rows WHERE trim(text, ' ') <> '')
"""


@query(
    """
    SELECT lang, source, count(*) AS n_docs, CAST(sum(len(regexp_extract_all(text, '[0-9]{3}-[0-9]{4}'))) AS BIGINT) AS n_hits
    FROM documents GROUP BY lang, source
    """
)
def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and hits of a phone-like pattern per language and source."""
    docs = table(spark, sf_dir, "documents")
    return docs.groupBy("lang", "source").agg(F.count("*").alias("n_docs"), F.sum(F.regexp_count("text", F.lit("[0-9]{3}-[0-9]{4}"))).cast("bigint").alias("n_hits"))


@query(f"WITH {LINES} SELECT doc_id, CAST(block_ord AS INT) AS block_ord, CAST(line_ord AS INT) AS line_ord, text FROM lines")
def lines_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_texts(table(spark, sf_dir, "documents"), "doc_id")


@query(f"WITH {LINES} SELECT doc_id, CAST(block_ord AS INT) AS block_ord, count(*) AS n_lines, CAST(sum(length(text)) AS BIGINT) AS n_chars FROM lines GROUP BY doc_id, block_ord")
def blocks_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with their lines, counted within the block's array."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(blocks_of_text()).alias("block_ord", "block"))
    own = F.filter(F.split("block", "\n"), lambda x: F.trim(x) != "")
    made = docs.select("doc_id", "block_ord", own.alias("own")).where(F.size("own") > 0)
    chars = F.aggregate("own", F.lit(0).cast("bigint"), lambda n, x: n + F.length(x))
    return made.select("doc_id", "block_ord", F.size("own").cast("bigint").alias("n_lines"), chars.alias("n_chars"))


@query(rf"WITH {LINES} SELECT doc_id, count(*) AS n_lines, CAST(sum(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+'))) AS BIGINT) AS n_words FROM lines GROUP BY doc_id")
def line_word_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines and words of each document, without a shuffle."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    rows = F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")
    words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+")).cast("bigint")
    return docs.select("doc_id", F.size(rows).cast("bigint").alias("n_lines"), words.alias("n_words")).where("n_lines > 0")


@query(
    r"""
    WITH r AS (SELECT doc_id, lang, unnest(l) AS text, generate_subscripts(l, 1) - 1 AS pos, len(l) AS n
               FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS l FROM documents)),
    z AS (SELECT lang, (300 + pos * 40 + 15.0) / greatest(2338, 600 + n * 40) AS m FROM r WHERE trim(text, ' ') <> '')
    SELECT lang, CASE WHEN m < 0.12 THEN 'header' WHEN m > 1 - 0.12 THEN 'footer' ELSE 'body' END AS zone, count(*) AS n_lines FROM z GROUP BY 1, 2
    """
)
def zone_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lines = positioned_lines(docs.select(F.struct("doc_id", "lang").alias("doc"), "text"), "doc")
    return lines.groupBy(F.col("doc.lang").alias("lang"), zone().alias("zone")).agg(F.count("*").alias("n_lines"))


@query(
    rf"""
    WITH {LINES}, m AS (SELECT doc_id, block_ord, line_ord, unnest(h) AS match, generate_subscripts(h, 1) - 1 AS match_ord
                        FROM (SELECT *, regexp_extract_all(text, '[A-Za-z0-9._]+@[A-Za-z0-9.]+') AS h FROM lines))
    SELECT doc_id, CAST(block_ord AS INT) AS block_ord, CAST(line_ord AS INT) AS line_ord, CAST(match_ord AS INT) AS match_ord, match FROM m
    """
)
def search_regex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in the lines of documents."""
    return search(lines_of_texts(table(spark, sf_dir, "documents"), "doc_id"), r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", regex=True, case=True)


@query(rf"WITH {LINES} SELECT doc_id, CAST(sum(len(regexp_extract_all(text, '(?i)\bthe\b'))) AS BIGINT) AS n_hits FROM lines WHERE regexp_matches(text, '(?i)\bthe\b') GROUP BY doc_id")
def search_whole_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_counts(table(spark, sf_dir, "documents"), "the", whole_words=True)


@query("SELECT lang, source, CAST(sum(len(regexp_extract_all(text, '(?i)license'))) AS BIGINT) AS n_hits, count_if(regexp_matches(text, '(?i)license')) AS n_docs FROM documents GROUP BY lang, source")
def search_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = F.regexp_count("text", F.lit("(?i)license"))
    return table(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.sum(hits).cast("bigint").alias("n_hits"), F.count_if(hits > 0).alias("n_docs"))


NEAR = r"""
    WITH d AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text IS NOT NULL),
    p AS (SELECT doc_id, t, string_split(t, 'license') AS parts FROM d WHERE contains(t, 'license')),
    e AS (SELECT doc_id, t, k, CAST(list_sum(list_transform(parts[1:k], lambda x: length(x) + 7)) - 7 AS BIGINT) AS pos
          FROM (SELECT *, unnest(range(1, len(parts))) AS k FROM p))
    SELECT doc_id, pos FROM e
    WHERE {}(contains(substring(t, greatest(pos - 40, 0) + 1, pos - greatest(pos - 40, 0)), 'work') OR contains(substring(t, pos + 8, 40), 'work'))
"""


@query(NEAR.format(""))
def search_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of a word with another one within 40 characters on either side."""
    return near(table(spark, sf_dir, "documents"), "license", ["work"], 40)


@query(NEAR.format("NOT "))
def search_not_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near(table(spark, sf_dir, "documents"), "license", ["work"], 40, wanted=False)
