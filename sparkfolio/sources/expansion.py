"""What a list of paths, folders and patterns stands for, on any file system that Spark reads, and why some stand for nothing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.sources.files import SUFFIXES, files, notes_of, suffix_of


@dataclass
class Expanded:
    """Folders and files that are there, and for each other source the reason why it isn't read."""

    paths: list[str]
    missing: dict[str, str]


def expand(spark: SparkSession, sources: Iterable[str]) -> Expanded:
    """Each source once, in order; patterns as Hadoop's file systems read them. Folders are listed by Spark, not here."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    out = Expanded([], {})
    for source in dict.fromkeys(sources):
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)  # noqa: SLF001
        found = path.getFileSystem(conf).globStatus(path) or []
        if not len(found):
            out.missing[source] = "nothing matches" if set(source) & set("*?[{") else "no such file"
        for status in found:
            name = status.getPath().toString()
            if status.isDirectory() or suffix_of(name) in SUFFIXES:
                out.paths.append(name)
            else:
                out.missing[name] = f"unsupported: {suffix_of(name)}"
    out.paths = list(dict.fromkeys(out.paths))
    return out


def notes(spark: SparkSession, sources: Iterable[str], stdin: bytes | None = None, name: str = "stdin.txt") -> DataFrame:
    """path and the columns of notes of all files that the sources stand for; what is missing has a row with status error.

    stdin: contents of a further file, whose name tells how it is read.
    """
    expanded = expand(spark, sources)
    parts = []
    if expanded.paths:
        parts.append(notes_of(files(spark, expanded.paths).select("path", "content")))
    if stdin is not None:
        parts.append(notes_of(spark.createDataFrame([(name, bytearray(stdin))], "path string, content binary")))
    if expanded.missing or not parts:
        empty = notes_of(spark.createDataFrame([], "path string, content binary"))
        rows = spark.createDataFrame(list(expanded.missing.items()), "path string, error string")
        made = [F.col(c) if c in rows.columns else F.lit("error").alias(c) if c == "status" else F.lit("missing").alias(c) if c == "error_kind" else F.lit(None).cast(empty.schema[c].dataType).alias(c) for c in empty.columns]
        parts.append(rows.select(*made))
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def strict(rows: DataFrame) -> DataFrame:
    """notes of which none may fail: the job ends with the first error, which it names."""
    return rows.withColumn("status", F.when(F.col("status") == "error", F.raise_error(F.concat("path", F.lit(": "), F.coalesce("error", F.lit("unreadable"))))).otherwise(F.col("status")))
