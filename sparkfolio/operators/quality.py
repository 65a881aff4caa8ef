"""Counts, confidence and quality of pages and documents, and what a report sums up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Fixed values of the estimate: the bias, and the weights of line length, weak confidence, line height, mean confidence and least margin.
WEIGHTS = (0.85323, 2.00461, 0.91330, -1.42933, 0.53614, 0.47998)
#: Lines that a page needs to be judged.
LEAST_LINES = 5
SEVERITIES = ("info", "low", "medium", "high", "critical")


def logit(p: Column) -> Column:
    p = F.least(F.greatest(p, F.lit(1e-3)), F.lit(1 - 1e-3))
    return F.ln(p / (1 - p))


def readable(lines: DataFrame, least: float = 0.5) -> DataFrame:
    """Lines that have a text and were read with that confidence."""
    return lines.where((F.trim("text") != "") & (F.col("confidence") >= least))


def page_quality(lines: DataFrame, *keys: str) -> DataFrame:
    """keys, n_lines and quality (null below LEAST_LINES lines) of pages, from lines with chars, confidence, height_ratio and margin."""
    sums = lines.groupBy(*keys).agg(
        F.count("*").alias("n_lines"), F.avg("chars").alias("chars"), F.avg("confidence").alias("mean"), F.avg("height_ratio").alias("height"),
        F.min("margin").alias("margin"), F.sort_array(F.collect_list("confidence")).alias("all"),
    )
    weak = F.get("all", F.floor(F.col("n_lines") / 10).cast("int"))
    values = (
        F.least("chars", F.lit(60.0)) / 30, logit(weak) / 5, F.least(F.col("height") * 40, F.lit(3.0)), logit(F.col("mean")) / 5,
        F.least(F.greatest("margin", F.lit(0.0)), F.lit(1.0)),
    )
    z = F.lit(WEIGHTS[0])
    for w, v in zip(WEIGHTS[1:], values, strict=True):
        z = z + w * v
    z = F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))
    return sums.select(*keys, "n_lines", F.when(F.col("n_lines") >= LEAST_LINES, 1 / (1 + F.exp(-z))).alias("quality"))


def document_quality(pages: DataFrame, *keys: str) -> DataFrame:
    """The mean quality of the pages that have one, by their number of lines, 1 at least."""
    w = F.greatest("n_lines", F.lit(1))
    judged = F.col("quality").isNotNull()
    return pages.groupBy(*keys).agg((F.sum(F.when(judged, F.col("quality") * w)) / F.sum(F.when(judged, w))).alias("quality"))


def rank_of(severity: Column | str) -> Column:
    """0 for info to 4 for critical, null for others."""
    at = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col(severity) if isinstance(severity, str) else severity)
    return F.when(at > 0, (at - 1).cast("int"))


def at_least(severity: Column | str, least: str) -> Column:
    if least not in SEVERITIES:
        raise ValueError(f"unknown severity {least!r}; use {', '.join(SEVERITIES)}")
    return rank_of(severity) >= SEVERITIES.index(least)


def max_severity(hits: DataFrame, *keys: str) -> DataFrame:
    return hits.groupBy(*keys).agg(F.max_by("severity", rank_of("severity")).alias("severity"), F.count("*").alias("n_hits"))


def gate_any(level: Column, tlp: Column, company: Column, n_hits: Column) -> Column:
    """Whether a report trips the gate `any`: a grade, a traffic light but clear, a company marking or a hit."""
    return (F.coalesce(level, F.lit(0)) >= 1) | F.coalesce(tlp != "CLEAR", F.lit(False)) | company.isNotNull() | (F.coalesce(n_hits, F.lit(0)) > 0)


def winning_label(findings: DataFrame, *keys: str) -> DataFrame:
    """Of the labels of the highest level: one that names a grade first, then the most clean reads, the most findings, the first seen.

    findings: level, label, names_grade, fuzzy and ord beside keys.
    """
    top = Window.partitionBy(*keys)
    high = findings.withColumn("top", F.max("level").over(top)).where("level = top")
    by = high.groupBy(*keys, "level", "label").agg(F.max("names_grade").alias("names"), F.count_if(~F.col("fuzzy")).alias("clean"), F.count("*").alias("n"), F.min("ord").alias("first"))
    return by.groupBy(*keys).agg(F.max_by(F.struct("level", "label"), F.struct("names", "clean", "n", -F.col("first"))).alias("x")).select(*keys, "x.level", "x.label")


def unmarked_pages(levels: DataFrame, key: str) -> DataFrame:
    """The pages of level 0 of documents with two pages or more, of which one has a grade. levels: key, page, level."""
    by = levels.groupBy(key).agg(F.max("level").alias("level"), F.count("*").alias("n"), F.array_sort(F.collect_list(F.when(F.col("level") == 0, F.col("page")))).alias("pages"))
    return by.where("level >= 1 and n >= 2").select(key, F.col("pages").alias("unmarked_pages"))


def distinct_in_order(rows: DataFrame, key: str, value: str, ord_: str) -> DataFrame:
    """The distinct values of each key, first seen first."""
    first = rows.groupBy(key, value).agg(F.min(ord_).alias("at"))
    pairs = F.array_sort(F.collect_list(F.struct("at", value)))
    return first.groupBy(key).agg(F.transform(pairs, lambda x: x[value]).alias(f"{value}s"))
