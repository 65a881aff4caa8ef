"""The command line: read files, search them, find markings, keep a folder of notes.

    python -m sparkfolio scan PATHS
    python -m sparkfolio find PATHS --profile FILE [--fail-on any|none|severity] [--least LEVEL]
    python -m sparkfolio vs PATHS [--fail-on grade|any|none] [--least LEVEL]
    python -m sparkfolio markdown SOURCE OUT [--prune] [--force]
    python -m sparkfolio languages | formats

The status is 0 where all went well, 1 where a file couldn't be read, 2 for wrong arguments, and 3 where a gate is tripped.
"""

from __future__ import annotations

import argparse
import json
import sys
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators import reports
from sparkfolio.operators.exports import ALIASES, FORMATS
from sparkfolio.operators.language import LETTERS
from sparkfolio.operators.markings import inspect_texts, level_for
from sparkfolio.operators.quality import SEVERITIES
from sparkfolio.operators.store import sync
from sparkfolio.operators.terms import ProfileError, find_in_texts, load
from sparkfolio.sources.expansion import notes, strict

OK, UNREADABLE, WRONG, TRIPPED = 0, 1, 2, 3


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="sparkfolio", description="Read, search and keep documents with Spark.")
    commands = top.add_subparsers(dest="command", required=True)

    def reading(name: str, what: str) -> argparse.ArgumentParser:
        p = commands.add_parser(name, help=what)
        p.add_argument("paths", nargs="+", help="files, folders and patterns; - is the standard input")
        p.add_argument("--name", default="stdin.txt", help="name of the standard input, which tells how it is read")
        p.add_argument("--strict", action="store_true", help="stop at the first file that can't be read")
        p.add_argument("--out", help="folder of the result, instead of the standard output")
        return p

    reading("scan", "the text of files as Markdown")
    for name, what in (("find", "terms of a profile"), ("vs", "classification markings")):
        p = reading(name, what)
        p.add_argument("--profile", required=name == "find", help="search profile")
        p.add_argument("--format", choices=("text", "csv", "json", "jsonl"), default="text")
        p.add_argument("--fail-on", choices=reports.GATES, default="any" if name == "find" else "grade")
        p.add_argument("--least", help="level of the gate: a grade or a severity")
    p = commands.add_parser("markdown", help="keep a folder of notes up to date with a folder of files")
    p.add_argument("source"), p.add_argument("out")
    p.add_argument("--prune", action="store_true"), p.add_argument("--force", action="store_true")
    commands.add_parser("languages", help="codes of languages that are told apart")
    commands.add_parser("formats", help="formats of exports")
    return top


def gate(mode: str, least: str | None) -> tuple[str, int | str | None]:
    """The gate's mode and level; ValueError names what is wrong."""
    if mode == "grade":
        return mode, level_for(least) if least else 1
    if mode == "severity":
        if (least or "high") not in SEVERITIES:
            raise ValueError(f"unknown severity {least!r}; use {', '.join(SEVERITIES)}")
        return mode, least or "high"
    return mode, None


def read(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    stdin = sys.stdin.buffer.read() if "-" in args.paths else None
    found = notes(spark, [p for p in args.paths if p != "-"], stdin, args.name)
    return strict(found) if args.strict else found


def found_in(texts: DataFrame, args: argparse.Namespace) -> DataFrame:
    """Findings of markings and terms, as a report has them."""
    columns = "source, page, kind, level, label, scheme, match, text, confidence, fuzzy, reason, x0, y0, x1, y1, severity"
    parts = []
    if args.profile:
        hits = find_in_texts(texts, load(Path(args.profile).read_text(encoding="utf-8")), "source")
        parts.append(hits.selectExpr("source", "page", "'term' AS kind", "CAST(NULL AS int) AS level", "term AS label", "CAST(NULL AS string) AS scheme", "text AS match", "text", "score AS confidence", "array_contains(how, 'fuzzy') AS fuzzy", "array_join(how, '+') AS reason", "x0", "y0", "x1", "y1", "severity"))
    if args.command == "vs":
        parts.append(inspect_texts(texts, "source").withColumn("severity", F.lit(None).cast("string")).selectExpr(*columns.split(", ")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def shown(rows: DataFrame, out: str | None, form: str) -> None:
    """A result as files in a folder, or row by row on the standard output."""
    if out:
        writer = rows.write.mode("overwrite")
        writer.option("header", "true").csv(out) if form == "csv" else writer.text(out) if rows.columns == ["line"] else writer.json(out)
        return
    if form == "csv":
        print(",".join(rows.columns))
    for r in rows.toLocalIterator():
        if rows.columns == ["line"]:
            print(r["line"])
        elif form == "csv":
            print(",".join("" if v is None else json.dumps(v, ensure_ascii=False) if isinstance(v, str) and set(v) & set(',"\n') else str(v) for v in r))
        else:
            print(json.dumps(r.asDict(True), ensure_ascii=False, default=str))


def searched(spark: SparkSession, args: argparse.Namespace) -> int:
    mode, least = gate(args.fail_on, args.least)
    every = read(spark, args).where("status != 'skipped'").select(F.col("path").alias("source"), "status", "error", "markdown").persist()
    files = every.select("source", F.when(F.col("status") == "ok", "ok").otherwise("error").alias("status"))
    findings = found_in(every.where("status = 'ok'").select("source", F.col("markdown").alias("text")), args).persist()
    of = reports.of_files(files, findings)
    tripped = reports.trips(mode, least)
    if args.format == "csv":
        shown(reports.report_rows(files, findings), args.out, "csv")
    elif args.format == "text":
        line = F.concat_ws(": ", "source", F.when(F.col("status") != "ok", F.lit("can't be read")).when(F.col("kind").isNull(), F.lit("clean")).otherwise(F.concat_ws(" ", "kind", "label", F.col("match"), F.concat(F.lit("p. "), "page"))))
        shown(reports.report_rows(files, findings).select(F.regexp_replace(line, "\n", " ").alias("line")), args.out, "text")
    else:
        if args.format == "json":
            print(json.dumps({"summary": reports.summary(of, tripped).first().asDict(), "by_label": {r["label"]: r["n"] for r in reports.tally(findings).collect()}}, ensure_ascii=False))
        shown(reports.as_json_lines(files, findings).select("line"), args.out, "jsonl")
    return reports.exit_status(of, tripped).first()["status"]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    try:
        args = parser().parse_args(argv)
        if args.command in ("find", "vs"):
            gate(args.fail_on, args.least)
            if args.profile:
                load(Path(args.profile).read_text(encoding="utf-8"))
    except SystemExit as e:
        return int(e.code or 0)
    except (ProfileError, ValueError, OSError) as e:
        print(e, file=sys.stderr)
        return WRONG
    if args.command in ("languages", "formats"):
        print("\n".join(LETTERS if args.command == "languages" else [*FORMATS, *ALIASES]))
        return OK
    spark = spark or SparkSession.builder.appName("sparkfolio").getOrCreate()
    if args.command == "markdown":
        done = sync(spark, args.source, args.out, prune=args.prune, force=args.force)
        shown(done.groupBy("action").agg(F.count("*").alias("n")), None, "json")
        return OK
    if args.command == "scan":
        every = read(spark, args).where("status != 'skipped'").select("path", "status", "error", "title", "markdown").persist()
        shown(every, args.out, "json")
        return UNREADABLE if every.where("status = 'error'").limit(1).count() else OK
    return searched(spark, args)


if __name__ == "__main__":
    sys.exit(main())
