"""The note store: a manifest table of what was written, and what a listing asks for next.

A manifest is a folder of parquet versions; the newest complete one counts, and a run writes the next. Notes
that were edited by hand are never overwritten nor deleted; notes of vanished files go.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from contextlib import suppress

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.functions.text import safe_name
from sparkfolio.sources.files import files, notes_of

MANIFEST = "key string, size bigint, mtime bigint, sha string, note string, note_sha string, error string"


def actions(listing: DataFrame, manifest: DataFrame) -> DataFrame:
    """key, the columns of both sides and the action: write, touch (same content, new time), unchanged, keep (edited by hand) or prune.

    listing: key, size, mtime, sha; manifest: the same and edited.
    """
    old = manifest.select(F.col("key").alias("old_key"), F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha").alias("old_sha"), *(c for c in manifest.columns if c not in ("key", "size", "mtime", "sha")))
    both = listing.join(old, listing["key"] == old["old_key"], "full_outer")
    same = (F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime"))
    action = (
        F.when(F.col("old_key").isNull(), "write")
        .when(F.col("key").isNull(), F.when(F.col("edited"), "keep").otherwise("prune"))
        .when(same, "unchanged")
        .when(F.col("sha") == F.col("old_sha"), "touch")
        .when(F.col("edited"), "keep")
        .otherwise("write")
    )
    return both.withColumn("action", action).withColumn("key", F.coalesce("key", "old_key")).drop("old_key")


def prunable(manifest: DataFrame, listing: DataFrame) -> DataFrame:
    """Entries whose file is gone and whose note is as it was written."""
    return manifest.where("not edited").join(listing, "key", "left_anti")


def resumed(inputs: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Inputs that aren't done."""
    return inputs.join(done, key, "left_anti")


def latest(journal: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key: an aggregation, so that rows of a key meet once for each task."""
    rest = F.struct(*(F.col(c) for c in journal.columns))
    return journal.groupBy(key).agg(F.max_by(rest, F.struct(*order)).alias("row")).select("row.*")


def edited(notes: DataFrame, manifest: DataFrame) -> DataFrame:
    """manifest with edited: whether the note on disk (note, sha of its bytes) differs from what was written; a note that is gone isn't."""
    now = notes.select("note", F.col("sha").alias("disk_sha"))
    return manifest.join(now, "note", "left").withColumn("edited", F.coalesce(F.col("disk_sha") != F.col("note_sha"), F.lit(False))).drop("disk_sha")


def versions(folder: str) -> list[str]:
    return sorted(d for d in (os.listdir(folder) if os.path.isdir(folder) else []) if d.startswith("v") and os.path.exists(f"{folder}/{d}/_SUCCESS"))


def sync(spark: SparkSession, source: str, out: str, prune: bool = False, force: bool = False) -> DataFrame:
    """Bring the notes in out up to date with the files below source; key and action of each file.

    source and out are folders that driver and executors share. A note is written under a name of its own and
    renamed, so that a lost task leaves none half written; the manifest's next version is written last. Files
    of the size and time that the manifest has aren't read.
    """
    os.makedirs(out, exist_ok=True)
    folder = f"{out}/.manifest"
    done = versions(folder)
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/{done[-1]}") if done else spark.createDataFrame([], MANIFEST)
    root = F.regexp_replace("path", "^file:", "")
    listed = files(spark, source).select(root.alias("key"), F.col("length").alias("size"), F.unix_micros("modificationTime").alias("mtime"))
    # only files whose size or time has changed are read, to be hashed
    before = manifest.select("key", F.col("size").alias("old_size"), F.col("mtime").alias("old_mtime"), F.col("sha").alias("old_sha"))
    marked = listed.join(before, "key", "left").withColumn("same", F.coalesce((F.col("size") == F.col("old_size")) & (F.col("mtime") == F.col("old_mtime")), F.lit(False)))
    marked.write.mode("overwrite").parquet(f"{folder}/listed")
    marked = spark.read.schema(marked.schema).parquet(f"{folder}/listed")
    contents = files(spark, source).select(root.alias("key"), "content")
    changed = contents.join(marked.where("not same").select("key", "size", "mtime"), "key")
    changed.select("key", "size", "mtime", F.sha2("content", 256).alias("sha")).write.mode("overwrite").parquet(f"{folder}/hashed")
    kinds = "key string, size bigint, mtime bigint, sha string"
    found = marked.where("same").select("key", "size", "mtime", F.col("old_sha").alias("sha")).unionByName(spark.read.schema(kinds).parquet(f"{folder}/hashed"))
    have = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(out).select(F.regexp_replace("path", "^file:", "").alias("note"), F.sha2("content", 256).alias("sha"))
    known = edited(have, manifest) if done else manifest.withColumn("edited", F.lit(False))
    if force:
        known = known.withColumn("edited", F.lit(False))
    plan = actions(found, known)
    wanted = contents.join(plan.where("action = 'write'").select("key"), "key")
    name = F.regexp_replace(F.regexp_replace("key", r"^.*/", ""), r"\.[A-Za-z0-9]+$", "")
    below = F.regexp_replace(F.substring(F.regexp_replace("key", r"[^/]*$", ""), len(os.path.abspath(source)) + 2, 1 << 20), "/$", "")
    # files that differ in suffix alone share a name: the first keeps it, the others carry their suffix
    named = found.select("key", below.alias("below"), name.alias("name"), F.regexp_extract("key", r"\.([A-Za-z0-9]+)$", 1).alias("suffix"))
    rank = F.row_number().over(Window.partitionBy("below", F.lower("name")).orderBy("key"))
    named = named.withColumn("name", F.when(rank > 1, F.concat("name", F.lit("-"), "suffix")).otherwise(F.col("name")))
    named = named.select("key", F.concat_ws("/", F.lit(os.path.abspath(out)), F.when(F.col("below") != "", F.col("below")), F.concat(safe_name(F.col("name")), F.lit(".md"))).alias("note"))
    made = notes_of(wanted.select("key", "content"), "key").select("key", "status", "error", "markdown").join(named, "key")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for note, text in zip(b["note"], b["markdown"], strict=True):
                if text is not None:
                    os.makedirs(os.path.dirname(note), exist_ok=True)
                    temporary = f"{note}.{os.getpid()}.tmp"
                    with open(temporary, "w", encoding="utf-8", newline="\n") as f:
                        f.write(text)
                        f.flush()
                        os.fsync(f.fileno())
                    os.replace(temporary, note)
            yield b[["key", "status", "error", "note", "note_sha"]]

    written = made.withColumn("note_sha", F.sha2(F.col("markdown").cast("binary"), 256)).select("key", "status", "error", "note", "note_sha", "markdown")
    # a task that runs twice writes the same bytes under the same name
    result = written.mapInPandas(write, "key string, status string, error string, note string, note_sha string")
    kept = plan.where("action in ('unchanged', 'touch', 'keep')").where("old_sha is not null")
    old = kept.select("key", F.coalesce("size", "old_size").alias("size"), F.coalesce("mtime", "old_mtime").alias("mtime"), F.when(F.col("action") == "keep", F.col("old_sha")).otherwise(F.coalesce("sha", "old_sha")).alias("sha"), "note", "note_sha", "error")
    new = result.join(found.select("key", "size", "mtime", "sha"), "key").select("key", "size", "mtime", "sha", "note", F.when(F.col("status") == "ok", F.col("note_sha")).alias("note_sha"), "error")
    if not prune:
        old = old.unionByName(plan.where("action = 'prune'").select("key", F.col("old_size").alias("size"), F.col("old_mtime").alias("mtime"), F.col("old_sha").alias("sha"), "note", "note_sha", "error"))
    told = plan.select("key", F.when((F.col("action") == "prune") & F.lit(not prune), "vanished").otherwise(F.col("action")).alias("action"))
    report = f"{folder}/report-{len(done) + 1:06d}"
    told.write.mode("overwrite").parquet(report)
    old.unionByName(new).write.mode("overwrite").parquet(f"{folder}/v{len(done) + 1:06d}")
    if prune:

        def remove(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for b in batches:
                for note in b["note"].dropna():
                    with suppress(FileNotFoundError):  # a task that runs again
                        os.remove(note)
                yield b

        # by the manifest's last version, which this run leaves as it is
        pruned = manifest.join(spark.read.parquet(report).where("action = 'prune'"), "key").select("note")
        pruned.mapInPandas(remove, "note string").write.format("noop").mode("overwrite").save()
    return spark.read.parquet(report)
