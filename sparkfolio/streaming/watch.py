"""A watched folder: each file is taken once, when it has stopped growing."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def watched(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """New files below folder as a stream; Spark's checkpoint remembers those taken."""
    return spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(folder)


def to_json_lines(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Rows of the stream appended to JSON Lines in out; a run after a crash goes on where the last one stopped."""
    w = stream.writeStream.format("json").option("path", out).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def settled(polls: DataFrame, times: int = 2) -> DataFrame:
    """path and length of files whose length was the same and above 0 in so many polls in a row, each once.

    polls: a stream of path, length and poll (a number that grows).
    """

    def judge(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:  # noqa: ANN001
        length, same, done = state.get if state.exists else (-1, 0, False)
        rows = pd.concat(list(batches)).sort_values("poll")
        out = []
        for n in rows["length"]:
            same = same + 1 if n == length and n > 0 else 1 if n > 0 else 0
            length = int(n)
            if same >= times and not done:
                done = True
                out.append((key[0], length))
        state.update((int(length), int(same), bool(done)))
        yield pd.DataFrame(out, columns=["path", "length"])

    return polls.groupBy("path").applyInPandasWithState(judge, "path string, length bigint", "length bigint, same int, done boolean", "append", "NoTimeout")


def windowed(events: DataFrame, late: str, width: str, slide: str | None = None) -> DataFrame:
    """Events counted by window and type, those later than the watermark left out."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width, slide) if slide else F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
