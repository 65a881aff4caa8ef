"""Exact dedup (operator 3): stateful streaming deduplication.

Each text arrives as a row of digest (SHA-256 of the text without white space), stable identifier,
length and content locator (the row's hash of its whole text, by which that text is found again). The
rows stream into an aggregation keyed by digest, whose state in RocksDB never expires: it keeps the
best arrival (most code points, then smallest identifier), and the number of arrivals. Given a state
folder, a later run takes the files of its own batch only and judges them with all that came before.
Afterwards the state is read as a table.

Full bytes are checked on hits: the texts of a digest that arrived more than once are read again
by locator and compared byte by byte. Where one differs, which SHA-256 makes unheard of but a shorter
digest doesn't, the rows of that digest are grouped again by the whole text.

Defined results: null counts as the empty text, and all texts of white space only are equal to it.
Ties in length go to the smallest doc_id, null last; repeated doc_ids are rows of their own in
group_size. Other columns don't matter. keep_one_of_equals keeps them as they are, whatever their names,
nulls included: of rows that repeat both identifier and text one stays, of groups without any doc_id
one row; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import SPACES, cut, settled, shared_folder

#: State in RocksDB. A store is closed when its batch is written, all of an executor's share a bounded memory, and files aren't allocated ahead, so that many small stores take little memory and disk.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.unloadOnCommit": "true",
    "spark.sql.streaming.stateStore.maintenanceInterval": "3s",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "256",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}


#: By which a row's whole text is found again.
LOCATOR = "xxhash64(coalesce(text, ''))"


def squeezed(text: str = "text") -> Column:
    """The text without white space, null as the empty text."""
    c = F.coalesce(F.col(text), F.lit(""))
    for x in SPACES:
        c = F.replace(c, F.lit(x), F.lit(""))
    return c


def digest_of(own: str, bits: int) -> Column:
    return F.unhex(F.sha2(F.col(own).cast("binary"), 256)).substr(1, bits // 8)


def arrivals(docs: DataFrame, digest_bits: int = 256, *more: str) -> DataFrame:
    """doc_id, digest, its hexadecimal form, the length in code points and the locator of each row; fewer bits of digest serve tests."""
    rows = docs.withColumn("own", squeezed()) if "own" not in more else docs
    n = F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")
    return rows.select("doc_id", digest_of("own", digest_bits).alias("digest"), F.sha2(F.col("own").cast("binary"), 256).alias("sha"), n.alias("n"), F.expr(LOCATOR).alias("locator"), *more)


def best_of(n: str = "n", doc_id: str = "doc_id") -> Column:
    """The row that stays is the greatest of these: longest, then smallest doc_id."""
    return F.struct(F.col(n).alias("n"), (-F.col(doc_id)).alias("back"))


def stream_into_state(rows: DataFrame, folder: str, path: str = "") -> DataFrame:
    """Take the files of rows, a table in the shared folder, into the state below folder; the state as digest, keep_id, n_rows.

    path: a folder of batches instead, of which those that the state hasn't seen are taken.
    """
    spark = rows.sparkSession
    path = path or rows.inputFiles()[0].rsplit("/", 1)[0]
    before = {k: spark.conf.get(k, None) for k in STATE}
    for k, v in STATE.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(rows.schema).parquet(path)
        state = stream.groupBy("digest").agg(F.max(best_of()).alias("best"), F.count("*").alias("n_rows"))
        run = state.writeStream.format("noop").outputMode("update").option("checkpointLocation", folder).trigger(availableNow=True).start()
        run.awaitTermination()
        kept = spark.read.format("statestore").load(folder)
        kinds = [f.name for f in kept.schema["value"].dataType.fields]
        best, count = (F.col("value").getField(k) for k in kinds[:2])
        return kept.select(F.col("key.digest").alias("digest"), (-best["back"]).alias("keep_id"), count.alias("n_rows"))
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def dedup(docs: DataFrame, digest_bits: int = 256, state_folder: str | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept and text_sha256 of every row of docs.

    state_folder: a folder in shared storage that outlives the run. The next call with it takes a further
    batch of rows: their keep_id and group_size count the batches before, whose rows aren't judged anew,
    and bytes are compared within the batch. A batch counts once only: a call that failed may be made
    again, as the folder `batches` below it has the rows that were taken.
    """
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    if state_folder is None:
        rows = cut(arrivals(docs, digest_bits))
        state = settled(spark, lambda: stream_into_state(rows, shared_folder(spark)))
    else:
        rows = cut(arrivals(docs, digest_bits))
        batch = rows.agg(F.count("*").alias("n"), F.sum(F.xxhash64("doc_id", "locator").cast("decimal(38,0)")).alias("s")).first()
        name = f"{state_folder.rstrip('/')}/batches/rows={batch.n}/sum={batch.s}"  # the same rows have the same name
        rows.write.mode("ignore").parquet(name)
        state = settled(spark, lambda: stream_into_state(rows, f"{state_folder.rstrip('/')}/state", f"{state_folder.rstrip('/')}/batches"))
    judged = rows.join(state, "digest")

    # the bytes of every hit, read again by locator; a row for each digest and task meets in the shuffle
    hits = judged.where("n_rows > 1").select("locator", "digest").distinct()
    read = docs.select(F.expr(LOCATOR).alias("locator"), squeezed().alias("own")).join(hits, "locator").where(digest_of("own", digest_bits) == F.col("digest"))
    differing = cut(read.groupBy("digest").agg(F.min("own").alias("a"), F.max("own").alias("b")).where("a != b").select("digest"))

    alike = judged.select("doc_id", "keep_id", F.col("n_rows").alias("group_size"), "sha", "digest")
    if not differing.isEmpty():
        full = arrivals(docs.withColumn("own", squeezed()), digest_bits, "own").join(differing, "digest", "left_semi")
        groups = full.groupBy("digest", "own").agg((-F.max(best_of())["back"]).alias("keep_id"), F.count("*").alias("group_size"))
        apart = full.join(groups, ["digest", "own"]).select("doc_id", "keep_id", "group_size", "sha", "digest")
        alike = alike.join(differing, "digest", "left_anti").unionByName(apart)
    return alike.select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256")
    )


def keep_one_of_equals(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with their columns; of rows that repeat both identifier and text one stays."""
    stay = settled(docs.sparkSession, lambda: dedup(docs).where("kept").groupBy("doc_id", "text_sha256").agg(F.count("*").alias("n_rows")))
    own = F.sha2(squeezed().cast("binary"), 256)

    def of(rows: DataFrame) -> DataFrame:
        return docs.join(rows, docs["doc_id"].eqNullSafe(rows["doc_id"]) & (own == rows["text_sha256"]), "left_semi")

    repeated = stay.where("n_rows > 1")
    if repeated.isEmpty():
        return of(stay)
    longest = F.struct(F.length("text").alias("n"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    one = of(repeated).groupBy("doc_id", own.alias("own")).agg(F.max_by(longest["row"], longest["n"]).alias("row"))
    return of(stay.where("n_rows = 1")).unionByName(one.select("row.*"))


ORACLE = r"""
    WITH t AS (SELECT doc_id, coalesce(text, '') AS x, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS own FROM documents)
    SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY own) AS group_size,
           doc_id = first_value(doc_id) OVER w AS kept, sha256(own) AS text_sha256
    FROM t WINDOW w AS (PARTITION BY own ORDER BY length(x) DESC, doc_id)
"""
