"""Reports of findings over many files: rows for a table, tallies, and gates that decide whether a run failed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.operators.markings import REPORT_COLUMNS
from sparkfolio.operators.quality import at_least, gate_any

GATES = ("any", "none", "grade", "severity")


def report_rows(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each finding, and one for each file without: its status alone. files: source and status; findings: source and some of the columns."""
    kinds = {"page": "int", "level": "int", "confidence": "double", "fuzzy": "boolean", **dict.fromkeys(("x0", "y0", "x1", "y1"), "double")}
    made = [F.col(c) if c in findings.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in REPORT_COLUMNS if c not in ("source", "status")]
    found = findings.select(F.col("source").alias("own"), *made)
    return files.join(found, files["source"].eqNullSafe(found["own"]), "left").select(*REPORT_COLUMNS)


def of_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """A row for each file: status, level, whether it has a traffic light but clear or a company marking, n_hits and severities of its terms."""
    marks = F.col("kind") == "marking"
    by = findings.groupBy(F.col("source").alias("own")).agg(
        F.max(F.when(marks & ~F.col("scheme").isin("tlp", "company"), F.col("level"))).alias("level"), F.max(F.when(marks & (F.col("scheme") == "tlp") & (F.col("label") != "TLP:CLEAR"), F.lit("set"))).alias("tlp"),
        F.max(F.when(marks & (F.col("scheme") == "company"), F.col("label"))).alias("company"), F.count_if(F.col("kind") == "term").alias("n_hits"), F.collect_set("severity").alias("severities"),
    )
    joined = files.join(by, files["source"].eqNullSafe(by["own"]), "left").drop("own")
    return joined.withColumns({"level": F.coalesce("level", F.lit(0)), "n_hits": F.coalesce("n_hits", F.lit(0)), "severities": F.coalesce("severities", F.array().cast("array<string>"))})


def trips(mode: str, least: int | str | None = None) -> Column:
    """Whether a file's row of of_files trips a gate: any (a grade, a light, a company's marking or a hit), grade (its level is least or more), severity (a term's is), or none."""
    if mode == "none":
        return F.lit(False)
    if mode == "any":
        return gate_any(F.col("level"), F.col("tlp"), F.col("company"), F.col("n_hits"))
    if mode == "grade" and isinstance(least, int):
        return F.col("level") >= least
    if mode == "severity" and isinstance(least, str):
        at_least(F.lit(least), least)  # an unknown one is an error
        return F.exists("severities", lambda s: at_least(s, least))
    raise ValueError(f"no gate {mode!r} with {least!r}; use {', '.join(GATES)}")


def summary(rows: DataFrame, tripped: Column) -> DataFrame:
    """One row over all files: files, marked, with_hits, unreadable, clean and tripped. rows: of_files."""
    ok = F.col("status") == "ok"
    marked = (F.col("level") >= 1) | F.col("tlp").isNotNull() | F.col("company").isNotNull()
    return rows.agg(
        F.count("*").alias("files"), F.count_if(ok & marked).alias("marked"), F.count_if(ok & (F.col("n_hits") > 0)).alias("with_hits"), F.count_if(~ok).alias("unreadable"),
        F.count_if(ok & ~marked & (F.col("n_hits") == 0)).alias("clean"), F.count_if(ok & tripped).alias("tripped"),
    )


def tally(findings: DataFrame) -> DataFrame:
    """label, files and n of the markings."""
    return findings.where("kind = 'marking'").groupBy("label").agg(F.countDistinct("source").alias("files"), F.count("*").alias("n"))


def exit_status(rows: DataFrame, tripped: Column) -> DataFrame:
    """status: 3 where a gate is tripped, else 1 where a file can't be read, else 0."""
    ok = F.col("status") == "ok"
    return rows.agg(F.when(F.count_if(ok & tripped) > 0, 3).when(F.count_if(~ok) > 0, 1).otherwise(0).alias("status"))


def as_json_lines(files: DataFrame, findings: DataFrame) -> DataFrame:
    """source and line: one JSON object for each file, with its findings in order of page and place."""
    cells = [c for c in REPORT_COLUMNS if c not in ("source", "status") and c in findings.columns]
    order = [F.col(c) for c in ("page", "y0", "x0") if c in cells]
    each = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), F.struct(*cells).alias("row"))))
    by = findings.groupBy(F.col("source").alias("own")).agg(F.transform(each, lambda x: x["row"]).alias("findings"))
    joined = files.join(by, files["source"].eqNullSafe(by["own"]), "left")
    return joined.select("source", F.to_json(F.struct("source", "status", "findings")).alias("line"))
