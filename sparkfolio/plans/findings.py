"""Queries of term search and markings over documents, with pages of literal lines beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.markings import inspect_texts
from sparkfolio.operators.quality import at_least, max_severity
from sparkfolio.operators.terms import find_in_texts, parse
from sparkfolio.registry import query, table

PROFILE = {
    "settings": {"severity": "low"},
    "term": [
        {"name": "license", "match": ["license", "licence"], "severity": "medium"},
        {"name": "phone", "regex": [r"\b\d{3}-\d{4}\b"], "category": "contact"},
        {"name": "terms of use", "match": "terms of use", "near": ["license", "content"]},
    ],
}
FUZZY = {"term": [{"match": "internatoinal agreement"}, {"match": "public licensc", "fuzzy": 2}]}
#: Texts that documents don't have: a marked one, one that speaks about grades, a clean one.
MARKED = [(-1, "VS-NfD\n\nSehr geehrte Damen und Herren,\nanbei die Unterlagen."), (-2, "Die VS-NfD-Zulassung liegt vor."), (-3, "Ein Text ohne alles."), (-4, "NATO RESTRICTED\n\nSECRET")]


@query()
def find_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a profile in all documents."""
    return find_in_texts(table(spark, sf_dir, "documents"), parse(PROFILE))


@query(r"SELECT doc_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(^|[^0-9A-Za-z-])[0-9]{3}-[0-9]{4}([^0-9A-Za-z-]|$)')) AS h FROM documents) GROUP BY doc_id")
def find_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of a regular expression per document."""
    hits = find_in_texts(table(spark, sf_dir, "documents"), parse({"term": [{"name": "phone", "regex": [r"(?<![0-9A-Za-z-])\d{3}-\d{4}(?![0-9A-Za-z-])"]}]}))
    return hits.groupBy("doc_id").agg(F.count("*").alias("n"))


@query()
def find_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Misspelt and misread forms of words, with how they were found."""
    hits = find_in_texts(table(spark, sf_dir, "documents"), parse(FUZZY))
    return hits.select("doc_id", "term", "text", F.array_join("how", ",").alias("how"), F.round("score", 6).alias("score"))


@query()
def severity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest severity and the number of hits of each document, from medium on."""
    hits = find_in_texts(table(spark, sf_dir, "documents"), parse(PROFILE))
    return max_severity(hits, "doc_id").where(at_least("severity", "medium"))


@query()
def markings_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in documents and in literal texts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").unionByName(spark.createDataFrame(MARKED, "doc_id bigint, text string"))
    return inspect_texts(docs).select("doc_id", "kind", "scheme", "level", "label", "match", "page", "reason", "fuzzy")


#: Literal texts, and what is found in them: (text, term, match, how).
CASES = (
    (1, "The public license applies.", "license", "license", "exact"), (2, "A pub1ic licence", "license", "licence", "exact"), (3, "l i c e n s e", "license", "l i c e n s e", "spaced"), (4, "the li-\ncense of it", "license", "li\ncense", "hyphenated"),
    (5, "liccnse", "license", "liccnse", "fuzzy"), (6, "call 555-1234 now", "phone", "555-1234", "regex"), (7, "terms\nof use of this content", "terms of use", "terms\nof use", "split"), (8, "terms of use", None, None, None), (9, "licensee", "license", "licensee", "fuzzy"), (10, "licentiate", None, None, None),
)
_EXPECTED = ", ".join(f"({k}, '{term}', '{match}', '{how}')" for k, _, term, match, how in CASES if term).replace("\n", "' || chr(10) || '")


@query(f"SELECT * FROM (VALUES {_EXPECTED}) AS t(doc_id, term, match, how)")
def term_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits in literal texts that are spelled, spaced and broken in different ways."""
    docs = spark.createDataFrame([(k, text) for k, text, *_ in CASES], "doc_id bigint, text string")
    return find_in_texts(docs, parse(PROFILE)).select("doc_id", "term", F.col("text").alias("match"), F.array_join("how", ",").alias("how"))


@query(
    """
    SELECT * FROM (VALUES (1, 'marking', 'VS-NfD', 1, 'standalone'), (2, 'mention', 'NATO SECRET', 3, 'compound word'), (4, 'marking', 'NATO RESTRICTED', 1, 'standalone'), (4, 'marking', 'SECRET', 3, 'standalone'), (5, 'mention', 'VS-NfD', 1, 'negated'),
                   (6, 'marking', 'AT VERTRAULICH', 2, 'standalone'), (7, 'marking', 'TLP:AMBER', 0, 'standalone')) AS t(doc_id, kind, label, level, reason)
    """
)
def marking_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings in literal texts."""
    texts = ("VS-NfD\n\nAn die Leitung", "Die NATO-SECRET-Freigabe fehlt noch.", "Ohne alles.", "NATO RESTRICTED\n\nSECRET", "Das ist nicht VS-NfD.", "VERTRAULICH\n\nRepublik Österreich", "TLP:AMBER")
    docs = spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")
    return inspect_texts(docs).select("doc_id", "kind", "label", "level", "reason")
