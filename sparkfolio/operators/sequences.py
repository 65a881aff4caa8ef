"""Operators on rows in order: runs, caps, joins of neighbours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.model import blocks_of_text


def capped(rows: DataFrame, key: str, order: str, most: int) -> DataFrame:
    """The first rows of each key."""
    return rows.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("r") <= most).drop("r")


def budgeted(rows: DataFrame, key: str, order: str, size: str, budget: int) -> DataFrame:
    """The first rows of each key whose sizes add up to the budget at most."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("till", F.sum(size).over(w)).where(F.col("till") <= budget).drop("till")


def hyphenated(docs: DataFrame, end: str, start: str) -> DataFrame:
    """doc_id, block_ord, line_ord, text and after of lines whose text and successor in the block match. No shuffle."""
    blocks = docs.select("doc_id", F.posexplode(blocks_of_text()).alias("block_ord", "block"))
    lines = F.filter(F.transform(F.split("block", "\n"), lambda x, k: F.struct(k.alias("at"), x.alias("text"))), lambda x: F.trim(x["text"]) != "")
    both = blocks.select("doc_id", "block_ord", lines.alias("lines"))
    pairs = F.zip_with(F.slice("lines", 1, F.size("lines") - 1), F.slice("lines", 2, F.size("lines")), lambda a, b: F.struct(a["at"].alias("line_ord"), a["text"].alias("text"), b["text"].alias("after")))
    made = both.where(F.size("lines") > 1).select("doc_id", "block_ord", F.explode(pairs).alias("p")).select("doc_id", "block_ord", "p.*")
    return made.where(F.col("text").rlike(end) & F.col("after").rlike(start))


def joined_text(lines: Column) -> Column:
    """Lines of a paragraph as one text: a hyphen at the end of a line and a small letter after it join the word,

    an abbreviated compound ("in- und") keeps its hyphen and gets a space, all else is joined by a space.
    """
    join = lambda a, x: (
        F.when(a == "", x)
        .when(a.rlike("­$"), F.concat(F.regexp_replace(a, "­$", ""), x))
        .when(a.rlike(r"\p{L}-$") & x.rlike(r"^(?:und|oder|bzw|sowie|and|or|et|ou|y|e)\b"), F.concat(a, F.lit(" "), x))
        .when(a.rlike(r"\p{L}-$") & x.rlike(r"^\p{Ll}"), F.concat(F.regexp_replace(a, "-$", ""), x))
        .when(a.rlike(r"\p{L}-$") & x.rlike(r"^\p{Lu}"), F.concat(a, x))
        .otherwise(F.concat(a, F.lit(" "), x))
    )
    return F.aggregate(lines, F.lit(""), join)
