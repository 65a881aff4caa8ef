"""The operators' queries, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm.bpe import bpe_encode
from sparkfolio.llm.common import fold_of, table
from sparkfolio.llm import exact_dedup
from sparkfolio.llm.exact_dedup import dedup
from sparkfolio.llm.html_extract import extract_text
from sparkfolio.llm.language_id import identify_language, learn_languages
from sparkfolio.llm.mixing import mix_report
from sparkfolio.llm.near_dedup import near_duplicates
from sparkfolio.llm.ogg import store_as_ogg
from sparkfolio.llm.secret_scan import scan_secrets
from sparkfolio.llm.toxicity import learn_toxicity, score_toxicity
from sparkfolio.llm.url_filter import judge_urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def vocabulary() -> str:
    """Path of the vocabulary file, which every executor's installation has."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op1_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(table(spark, sf_dir, "pages"), ["page_id", "url"])


@query
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = exact_dedup.ORACLE


@query
def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 5) == 0
    machine = learn_toxicity(docs.where(~held_out), table(spark, sf_dir, "labels").where(~held_out))
    scored = score_toxicity(docs, machine, ["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


@query
def op7_ogg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store_as_ogg(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


@query
def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents"), ["doc_id"])


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = fold_of("doc_id", 4) == 2
    model = learn_languages(docs.where(~held_out))
    return identify_language(docs, model, ["doc_id"]).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
