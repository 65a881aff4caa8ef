"""What the operators share: tables in the shared folder, batches of rows, the hold-out rule."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Between words: space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Folders in the shared folder that the calls of settled() now under way have asked for, innermost last.
OPEN = threading.local()


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share.

    Where that setting is absent, as in tests of one machine, a temporary folder stands in for it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="shared-")
    path = f"{base.rstrip('/')}/tables/{uuid.uuid4().hex}"
    if frames := getattr(OPEN, "frames", None):
        frames[-1].append(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends there, and a lost executor costs no rerun."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders of the shared folder, on whatever file system it is."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()  # noqa: SLF001
    for p in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)  # noqa: SLF001
        path.getFileSystem(conf).delete(path, True)


def settled(spark: SparkSession, make: Callable[[], DataFrame]) -> DataFrame:
    """What make returns, written to the shared folder; the folders that were asked for meanwhile are deleted then."""
    frames = OPEN.__dict__.setdefault("frames", [])
    own: list[str] = []
    frames.append(own)
    try:
        df = make()
    finally:
        frames.pop()
    out = cut(df)
    drop(spark, own)
    return out


def fold_of(doc_id: Column | str, n: int) -> Column:
    """crc32(doc_id as text) mod n; a null doc_id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def texts_of(column: pa.Array) -> list[str]:
    """The column's texts, null as the empty text."""
    return [t or "" for t in column.to_pylist()]


def map_texts(
    df: DataFrame,
    keys: list[str],
    start: Callable[[], Callable[[list[str]], dict[str, pa.Array]]],
    schema: str,
    text: str = "text",
    with_text: bool = False,
) -> DataFrame:
    """keys and the column text of df, mapped batch by batch in Arrow; start() runs once a task and returns the function of texts.

    with_text: the column goes along as it is, last.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for b in batches:
            for at in range(0, b.num_rows, 512):  # bounded memory beside the batch
                part = b.slice(at, 512)
                made = work(texts_of(part.column(len(keys))))
                columns = part.columns[: len(keys)] + list(made.values()) + [part.column(len(keys))] * with_text
                yield pa.RecordBatch.from_arrays(columns, names=[*keys, *made] + [text] * with_text)

    kinds = dict(df.dtypes)
    out = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), schema] + [f"`{text}` string"] * with_text)
    return df.select(*(F.col(f"`{k}`") for k in [*keys, text])).mapInArrow(run, out)
