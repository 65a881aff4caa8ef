"""The training-data pipeline: documents that are neither toxic nor copies, mixed by source and encoded.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept. All but the last return
the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkfolio.llm.bpe import bpe_encode
from sparkfolio.llm.common import settled, table
from sparkfolio.llm.exact_dedup import keep_one_of_equals
from sparkfolio.llm.mixing import mix_documents
from sparkfolio.llm.near_dedup import keep_one_of_near
from sparkfolio.llm.queries import vocabulary
from sparkfolio.llm.toxicity import drop_toxic

#: SQL can't express the factorization machine or the encoding; the stages are tested against brute force.
ORACLE_SQL = None


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score is below 0.5, by a machine learned from all labelled ones."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of texts that are equal but for white space."""
    return keep_one_of_equals(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 or more on five-word shingles."""
    return keep_one_of_near(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources by target weights; a document has a row for each pass that takes it."""
    return mix_documents(docs)


def bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of each text of the mix, with the digests of ids and of the text decoded from them."""
    return bpe_encode(docs, vocabulary(), ["doc_id", "lang", "source"], with_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("toxicity", toxicity), ("exact_dedup", exact_dedup), ("near_dedup", near_dedup), ("mixing", mixing), ("bpe", bpe)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        if k + 1 < len(STAGES):
            docs = settled(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir))
        else:
            docs = stage(spark, docs, sf_dir)
    return docs
