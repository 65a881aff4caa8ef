"""Search for a text or a regular expression in lines, by built-in expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Of Java's syntax, what a literal needs escaped.
SPECIAL = re.compile(r"([\\.\[\]{}()*+?^$|#&~\-])")


def pattern(needle: str, regex: bool = False, case: bool = False, whole_words: bool = False) -> str:
    """The regular expression of a needle: in composed form, in any case unless case is set."""
    if not needle:
        raise ValueError("nothing to search for")
    made = needle if regex else SPECIAL.sub(r"\\\1", unicodedata.normalize("NFC", needle))
    if whole_words:
        made = rf"\b(?:{made})\b"
    return made if case else f"(?iu){made}"


def search(lines: DataFrame, needle: str, regex: bool = False, case: bool = False, whole_words: bool = False) -> DataFrame:
    """Columns of lines but its text, with match_ord and match of each hit; hits never cross lines."""
    made = pattern(needle, regex, case, whole_words)
    keys = [c for c in lines.columns if c != "text"]
    found = lines.where(F.col("text").rlike(made))
    return found.select(*keys, F.posexplode(F.regexp_extract_all("text", F.lit(made), F.lit(0))).alias("match_ord", "match"))


def search_counts(docs: DataFrame, needle: str, regex: bool = False, case: bool = False, whole_words: bool = False) -> DataFrame:
    """doc_id and n_hits of the documents with a hit. Lines are searched in place, so that nothing is shuffled."""
    made = F.lit(pattern(needle, regex, case, whole_words))
    hits = F.aggregate(F.split("text", "\n"), F.lit(0).cast("bigint"), lambda n, x: n + F.regexp_count(x, made))
    return docs.select("doc_id", hits.alias("n_hits")).where("n_hits > 0")


def near(docs: DataFrame, word: str, others: list[str], window: int, wanted: bool = True) -> DataFrame:
    """doc_id and pos (characters before it) of each place of word that has one of the others within so many characters beside it, or that has none."""
    word, others = word.lower(), [x.lower() for x in others]
    low = docs.select("doc_id", F.lower("text").alias("t")).where(F.contains("t", F.lit(word)))
    parts = F.split("t", SPECIAL.sub(r"\\\1", word))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("places"))
    ends = F.aggregate(
        F.slice(parts, 1, F.size(parts) - 1), state, lambda s, x: F.struct((s["at"] + F.length(x) + len(word)).alias("at"), F.array_append(s["places"], s["at"] + F.length(x)).alias("places"))
    )
    placed = low.select("doc_id", "t", F.explode(ends["places"]).alias("at"))
    since = F.greatest(F.col("at") - window, F.lit(0))
    before, after = F.substring("t", since + 1, F.col("at") - since), F.substring("t", F.col("at") + len(word) + 1, F.lit(window))
    beside = F.lit(False)
    for x in others:
        beside = beside | F.contains(before, F.lit(x)) | F.contains(after, F.lit(x))
    return placed.where(beside if wanted else ~beside).select("doc_id", F.col("at").cast("bigint").alias("pos"))


def composed(text: Column) -> Column:
    """Text in composed form (NFC): Spark has no expression for it, so that texts beyond ASCII go through Arrow."""

    @F.pandas_udf("string")
    def nfc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v is None or v.isascii() else unicodedata.normalize("NFC", v))

    return nfc(text)


def edits_of_bytes(a: Column, b: Column) -> Column:
    """Levenshtein distance of two texts in UTF-8, a byte being what an edit changes; SQL engines may count so."""
    return F.levenshtein(*(F.decode(F.encode(c, "UTF-8"), "ISO-8859-1") for c in (a, b)))


def similarity(a: Column, b: Column, edits: Callable[[Column, Column], Column] = F.levenshtein) -> Column:
    """Share of the longer of two texts that stays, by edits: 1 for equal ones, case aside."""
    a, b = F.lower(a), F.lower(b)
    longer = F.greatest(F.length(a), F.length(b))
    return F.when(longer == 0, 1.0).otherwise(1 - edits(a, b) / longer)


def closest_lines(lines: DataFrame, needle: str, keys: list[str], top: int = 3, edits: Callable[[Column, Column], Column] = F.levenshtein) -> DataFrame:
    """keys, text and score of the lines of each key that are closest to the needle: the best so many distinct texts, ties by text.

    A line counts by its best stretch of as many words as the needle has.
    """
    n = len(needle.split())
    words = F.filter(F.split("text", r"\s+"), lambda w: w != "")
    starts = F.sequence(F.lit(1), F.greatest(F.size("own") - (n - 1), F.lit(1)))
    best = F.array_max(F.transform(starts, lambda k: similarity(F.array_join(F.slice("own", k, F.lit(n)), " "), F.lit(needle), edits)))
    scored = lines.select(*keys, "text", words.alias("own")).where(F.size("own") > 0).select(*keys, "text", F.round(best, 8).alias("score")).distinct()
    window = Window.partitionBy(*keys).orderBy(F.desc("score"), "text")
    return scored.withColumn("place", F.row_number().over(window)).where(F.col("place") <= top).drop("place")
