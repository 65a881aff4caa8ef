"""Mixing sources to target weights (operator 6), by DataFrame functions only.

The words of each source, its documents in a pseudorandom order, are packed into blocks of BLOCK
words. The mix is a sequence of output shards of SHARD slots. Each shard draws from a multinomial how
many of its slots each source gets, with the sources' quotas as weights. Shards take up a source's
quota in their order: one that draws n slots gets the source's next n, as far as the quota goes. Slots
drawn beyond a quota go, in order, to sources whose quota isn't used up, so that totals meet the
targets. Which shard a slot of a source stands in is thus decided by the draws.

A source's slots are numbered through; number j stands for block perm(j mod blocks), where perm is a
pseudorandom permutation of the source's block numbers (swap or not: in each round a number and its
partner trade places or don't, by a hashed bit), so that a pass takes each block once. Slots and
blocks meet in a join by source and block number.

Quotas cover targets, at most two passes; where whole blocks take more words than the target, the
last slot is cut short. All choices are hashes of doc_id, source, slot and a seed: reruns agree.

Running totals are taken in BUCKET_ROWS-sized buckets and over the buckets' sums, so that a source
with a third of all rows isn't one task. Windows over sources hold one row a source, those by source
a row for each shard or bucket.

Defined results: a null text or one without words has size 0 and is never taken; a null source is
a source of its own, sorted last; repeated rows count each; an empty table gives an empty result.
mix_documents keeps the other columns as they are, whatever their names, nulls included. A document
that is taken whole keeps its text; one that is taken in part has its words joined by single spaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.llm.common import cut, settled

#: Words of a block, slots of an output shard, rows of a bucket, slots of a task, rounds of the permutation, cells of the draw, and the seed of all draws.
BLOCK, SHARD, BUCKET_ROWS, TASK_SLOTS, ROUNDS, CELLS, SEED = 128, 1024, 4096, 1 << 16, 8, 1024, 20_250
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2
WORD = r"[^\x20\x09-\x0D]+"


def uniform(seed: int, *of: Column) -> Column:
    """A pseudorandom number in [0, 1) from the values."""
    return F.pmod(F.xxhash64(F.lit(seed), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """source_no, source, source_size, weight and target from source and its size (both summed up): one small row a source.

    With sources in order of the weight at which they reach their limit, the level after k full
    sources is (total - their limits) / (weights of the rest); the first level that fills no further
    source holds.
    """
    in_order = Window.orderBy(F.col("source").asc_nulls_last())
    s = sizes.withColumn("source_no", F.row_number().over(in_order))
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), F.pmod(F.col("source_no") - 1, F.lit(len(WEIGHTS))).cast("int") + 1)
    s = s.withColumns({"weight": weight.cast("double"), "most": (F.col("source_size") * MOST).cast("double")})
    s = s.withColumn("ratio", F.col("most") / F.col("weight"))
    every = Window.partitionBy()
    till = Window.orderBy("ratio", "source_no").rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumns(
        {
            "left": F.lit(SHARE) * F.sum("source_size").over(every) - F.coalesce(F.sum("most").over(till), F.lit(0.0)),
            "open": F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(till), F.lit(0.0)),
        }
    )
    s = s.withColumn("level", F.col("left") / F.col("open"))
    # the first source in this order that its level doesn't fill sets the level of all behind it
    level = F.min_by(F.when(F.col("level") <= F.col("ratio"), F.col("level")), F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "source_no"))).over(every)
    s = s.withColumn("target", F.least("most", F.coalesce(level, F.col("ratio")) * F.col("weight")))
    return s.select("source_no", "source", "source_size", "weight", "target")


def permuted(df: DataFrame, number: str, n: str, *key: Column) -> DataFrame:
    """df with the column number mapped by a pseudorandom permutation of [0, n) for each key."""
    for r in range(ROUNDS):
        turn = F.pmod(F.xxhash64(F.lit(SEED), F.lit(r), *key), F.col(n))
        df = df.withColumn("partner", F.pmod(turn - F.col(number), F.col(n)))
        bit = F.xxhash64(F.lit(SEED + 1), F.lit(r), *key, F.greatest(number, "partner")).bitwiseAND(F.lit(1)) == 1
        df = df.withColumn(number, F.when(bit, F.col("partner")).otherwise(F.col(number)))
    return df.drop("partner")


def positions(sized: DataFrame, buckets: int) -> DataFrame:
    """sized with start: the words of the same source before the row, in an order by hash of doc_id."""
    turn = F.xxhash64(F.lit(SEED), "doc_id")
    rows = sized.withColumns({"turn": turn, "bucket": F.floor((F.shiftrightunsigned(turn, 1) / F.lit(float(1 << 63))) * buckets)})
    sums = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("turn", "row_no").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(sums, ["source_no", "bucket"])
    return rows.withColumn("start", F.col("base") + F.coalesce(F.sum("size").over(within), F.lit(0))).drop("turn", "bucket", "base")


def drawn_counts(quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """source_no, shard and n: how many slots each shard draws for each source.

    quotas: one row a source with source_no, quota, total (of all quotas) and its share [since, to) of [0, 1).
    """
    total = quotas.agg(F.max("total")).first()[0] or 0
    drawn = quotas.sparkSession.range(total).select((F.col("id") / SHARD).cast("bigint").alias("shard"), uniform(seed, F.lit("slot"), F.col("id")).alias("u"))
    drawn = drawn.withColumn("cell", F.floor(F.col("u") * CELLS))
    # each source's share of [0, 1) by the cells that it touches, so that the draw is a join by cell
    cells = quotas.withColumn("cell", F.explode(F.sequence(F.floor(F.col("since") * CELLS), F.floor(F.least("to", F.lit(1.0)) * CELLS))))
    cells = cells.select("cell", "source_no", "since", "to")
    drawn = drawn.join(cells, "cell").where("since <= u and u < to")
    return drawn.groupBy("source_no", "shard").agg(F.count("*").alias("n"))


def slots(quotas: DataFrame, seed: int = SEED) -> DataFrame:
    """source_no, slot number j in its source and shard, for all slots of the mix."""
    quota = quotas.select("source_no", "quota")
    before = Window.partitionBy("source_no").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = drawn_counts(quotas, seed).withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0)))
    total = quotas.agg(F.max("total")).first()[0] or 0
    # a small row stands for many slots, so that tasks are counted by these
    counts = cut(counts.join(quota, "source_no").repartition(max(1, total // TASK_SLOTS), "source_no", "shard"))

    def numbered(runs: DataFrame, *more: str) -> DataFrame:
        """A row for each number j of the runs [first, last]."""
        pieces = runs.where("first <= last").select(*more, F.explode(F.sequence("first", "last", F.lit(SHARD).cast("bigint"))).alias("at"), "last")
        return pieces.select(*more, F.explode(F.sequence("at", F.least(F.col("at") + SHARD - 1, "last"))).alias("j"))

    own = numbered(counts.select("source_no", "shard", "first", (F.least(F.col("first") + F.col("n"), "quota") - 1).alias("last")), "source_no", "shard")
    # what is drawn beyond a quota, and what is left of others, each numbered through over all sources
    totals = counts.groupBy("source_no").agg(F.sum("n").alias("drawn"))
    sums = quota.join(totals, "source_no", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0)))
    upto = Window.orderBy("source_no").rowsBetween(Window.unboundedPreceding, -1)
    base = lambda c: F.coalesce(F.sum(F.greatest(c, F.lit(0))).over(upto), F.lit(0))
    sums = sums.withColumns({"base": base(F.col("drawn") - F.col("quota")), "open": base(F.col("quota") - F.col("drawn"))})
    surplus = counts.select("source_no", "shard", F.greatest("first", "quota").alias("first"), (F.col("first") + F.col("n") - 1).alias("last"))
    surplus = numbered(surplus, "source_no", "shard").join(sums, "source_no").select("shard", (F.col("base") + F.col("j") - F.col("quota")).alias("turn"))
    short = numbered(sums.select("source_no", "open", "drawn", F.col("drawn").alias("first"), (F.col("quota") - 1).alias("last")), "source_no", "open", "drawn")
    short = short.select("source_no", "j", (F.col("open") + F.col("j") - F.col("drawn")).alias("turn"))
    return own.unionByName(short.join(surplus, "turn").select("source_no", "j", "shard"))


def sized_of(docs: DataFrame, row_no: str = "") -> DataFrame:
    number = F.col(row_no) if row_no else F.monotonically_increasing_id()
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("bigint")
    return docs.select("doc_id", "source", size.alias("size"), number.alias("row_no"))


def mix(docs: DataFrame, row_no: str = "", seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """Rows of docs (row_no, doc_id, size, source_size, target) and their pieces in the mix (row_no, pass, at, words, shard).

    A piece is words number at to at + words of the row, in one slot of the shard; pass: how many times its
    block was taken before.
    """
    sized = cut(sized_of(docs, row_no))
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goals = cut(targets(sums.drop("n_rows")))
    buckets = max(1, (sums.agg(F.max("n_rows")).first()[0] or 0) // BUCKET_ROWS)
    rows = sized.join(goals, sized.source.eqNullSafe(goals.source)).select(
        "row_no", "doc_id", "size", "source_no", "source_size", "target"
    )
    placed = positions(rows.where("size > 0").select("row_no", "doc_id", "size", "source_no"), buckets)

    blocks = F.ceil(F.col("source_size") / BLOCK).cast("bigint")
    q = goals.where("source_size > 0").withColumn("blocks", blocks)
    q = q.withColumn("quota", F.least(F.ceil(F.col("target") / BLOCK).cast("bigint"), F.col("blocks") * MOST)).where("quota > 0")
    every, upto = Window.partitionBy(), Window.orderBy("source_no")
    q = q.withColumns({"total": F.sum("quota").over(every), "to": F.sum("quota").over(upto) / F.sum("quota").over(every)})
    q = q.withColumn("since", F.coalesce(F.lag("to").over(upto), F.lit(0.0)))
    q = cut(q.withColumn("to", F.when(F.col("source_no") == F.max("source_no").over(every), F.lit(2.0)).otherwise(F.col("to"))))

    small = q.select("source_no", "blocks", "quota", "source_size", "target")
    taken = slots(q, seed).join(small, "source_no").withColumns({"pass": F.floor(F.col("j") / F.col("blocks")), "block": F.pmod("j", "blocks")})
    taken = permuted(taken, "block", "blocks", F.col("source_no"), F.col("pass"))
    # all slots take whole blocks, but for the last block of a source and the last slot, which is cut short by what is over
    length = F.when(F.col("block") == F.col("blocks") - 1, F.col("source_size") - F.col("block") * BLOCK).otherwise(F.lit(BLOCK))
    taken = cut(taken.withColumn("length", length))
    over = taken.groupBy("source_no").agg(F.greatest(F.sum("length") - F.round(F.first("target")).cast("bigint"), F.lit(0)).alias("over"))
    whole = F.when(F.col("j") == F.col("quota") - 1, F.greatest(F.col("length") - F.col("over"), F.lit(0))).otherwise(F.col("length"))
    taken = taken.join(over, "source_no").select("source_no", "block", "pass", "shard", whole.alias("length"))

    first, last = F.floor(F.col("start") / BLOCK), F.floor((F.col("start") + F.col("size") - 1) / BLOCK)
    parts = placed.withColumn("block", F.explode(F.sequence(first, last))).join(taken, ["source_no", "block"])
    begin = F.greatest("start", F.col("block") * BLOCK)
    end = F.least(F.col("start") + F.col("size"), F.col("block") * BLOCK + F.col("length"))
    return rows, parts.select("row_no", "pass", (begin - F.col("start")).alias("at"), (end - begin).alias("words"), "shard").where("words > 0")


def mix_report(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken and shards (those that have words of it) of every row of docs."""
    rows, pieces = mix(docs, seed=seed)
    taken = pieces.groupBy("row_no").agg(F.sum("words").alias("taken"), F.sort_array(F.collect_set("shard")).alias("shards"))
    return rows.join(taken, "row_no", "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"), F.coalesce("shards", F.array().cast("array<bigint>")).alias("shards")
    )


def mix_documents(docs: DataFrame, shard: str = "", seed: int = SEED) -> DataFrame:
    """The mix as documents, with the columns of docs: a row for each pass in which a document was taken, its text the words taken in that pass.

    shard: name of a further column with the shard of the row's first word. A shard's rows lie in
    one file, one behind the other in a pseudorandom order. n_chars, where docs has it, is that of the new text.
    """
    names = docs.columns
    numbered = cut(docs.select(F.struct(*(F.col(f"`{c}`") for c in names)).alias("row")).withColumn("row_no", F.monotonically_increasing_id()))

    def of_rows() -> DataFrame:
        pieces = mix(numbered.select("row.doc_id", "row.source", "row.text", "row_no"), "row_no", seed)[1]
        return pieces.groupBy("row_no", "pass").agg(F.sort_array(F.collect_list(F.struct("at", "words", "shard"))).alias("pieces"))

    got = settled(docs.sparkSession, of_rows).withColumn("shard", F.col("pieces")[0]["shard"])
    both = numbered.select("row_no", "row").join(got, "row_no")
    words = F.regexp_extract_all("row.text", F.lit(f"({WORD})"), F.lit(1))
    count = F.aggregate("pieces", F.lit(0).cast("bigint"), lambda s, p: s + p["words"])
    chosen = F.array_join(F.flatten(F.transform("pieces", lambda p: F.slice(F.col("words_of"), p["at"].cast("int") + 1, p["words"].cast("int")))), " ")
    both = both.withColumn("words_of", words)
    both = both.withColumn("new", F.when(count == F.size("words_of"), F.col("row.text")).otherwise(chosen))
    both = both.repartition("shard").sortWithinPartitions("shard", uniform(seed, F.lit("row"), F.col("row_no"), F.col("pass")))
    made = {"text": F.col("new"), "n_chars": F.length("new").cast(dict(docs.dtypes).get("n_chars", "bigint"))}
    shown = [made[c].alias(c) if c in made else F.col("row").getField(c).alias(c) for c in names]
    return both.select(*shown, *([F.col("shard").alias(shard)] if shard else []))
