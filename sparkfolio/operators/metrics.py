"""Rates of error and agreement between expected and found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def folded(c: Column) -> Column:
    """For comparison: quotes and dashes of any form alike, invisible characters dropped, single spaces."""
    c = F.translate(c, "‘’‚‛“”„‟«»‐‑‒–—―−", "''''\"\"\"\"\"\"-------")
    return F.trim(F.regexp_replace(F.regexp_replace(c, "[­​-‏⁠﻿]", ""), r"\s+", " "))


def cer(expected: Column, found: Column) -> Column:
    """Edits a character of the expected text, 1 at most; for an empty one 0 or 1."""
    n = F.length(expected)
    return F.when(n == 0, F.when(F.length(found) == 0, 0.0).otherwise(1.0)).otherwise(F.least(F.levenshtein(expected, found) / n, F.lit(1.0)))


def as_symbols(words: Column, vocabulary: Column) -> Column:
    """One character for each word, so that edits of words are edits of characters; vocabulary holds all words."""
    return F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.format_string("%08x", (F.array_position(vocabulary, w) + 0x4E00).cast("int"))), "UTF-32")), "")


def wer(expected: Column, found: Column) -> Column:
    """Edits a word, 1 at most; pairs of some 10,000 distinct words at most (one of each needs a symbol)."""
    a, b = (F.filter(F.split(c, r"\s+"), lambda w: w != "") for c in (expected, found))
    vocabulary = F.array_union(a, b)
    symbols = F.transform(F.array(vocabulary), lambda v: F.struct(as_symbols(a, v).alias("a"), as_symbols(b, v).alias("b")))[0]
    return F.transform(F.array(symbols), lambda s: cer(s["a"], s["b"]))[0]


def word_recall(pairs: DataFrame, key: str) -> DataFrame:
    """The share of the expected words, each as often as it stands, that were found. pairs: key, expected, found."""
    words = lambda c: F.explode(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != ""))
    both = pairs.select(key, F.lit(1).alias("e"), F.lit(0).alias("f"), words("expected").alias("w")).unionByName(pairs.select(key, F.lit(0).alias("e"), F.lit(1).alias("f"), words("found").alias("w")))
    by = both.groupBy(key, "w").agg(F.sum("e").alias("e"), F.sum("f").alias("f"))
    return by.groupBy(key).agg(F.when(F.sum("e") > 0, F.sum(F.least("e", "f")) / F.sum("e")).otherwise(F.lit(1.0)).alias("recall"))


def prf(rows: DataFrame, *keys: str) -> DataFrame:
    """tp, fp, fn, precision, recall and f1 of boolean columns expected and found; rates with nothing below the line are 1."""
    by = rows.groupBy(*keys).agg(
        F.count_if(F.col("expected") & F.col("found")).alias("tp"), F.count_if(~F.col("expected") & F.col("found")).alias("fp"), F.count_if(F.col("expected") & ~F.col("found")).alias("fn")
    )
    share = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(1.0))
    by = by.withColumns({"precision": share(F.col("tp"), F.col("tp") + F.col("fp")), "recall": share(F.col("tp"), F.col("tp") + F.col("fn"))})
    return by.withColumn("f1", share(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def confusion(rows: DataFrame, expected: str, found: str, values: list) -> DataFrame:
    """Rows by expected, a column of counts for each found value."""
    return rows.groupBy(expected).pivot(found, values).count().na.fill(0)


def spearman(rows: DataFrame, key: str, a: str, b: str, ord_: Column) -> DataFrame:
    """Pearson's correlation of ordinal ranks; ties rank in the order of ord_. Each key is ranked on its own."""
    w = Window.partitionBy(key)
    ranked = rows.select(key, F.row_number().over(w.orderBy(a, ord_)).alias("ra"), F.row_number().over(w.orderBy(b, ord_)).alias("rb"))
    return ranked.groupBy(key).agg(F.corr("ra", "rb").alias("rho"))


def by_category(results: DataFrame, *keys: str) -> DataFrame:
    """Files, those read, pages, and means of the rates. results: ok, pages, ms, cer, wer, word_recall, confidence beside keys."""
    ok = lambda c: F.when(F.col("ok"), F.col(c))
    return results.groupBy(*keys).agg(
        F.count("*").alias("files"), F.count_if("ok").alias("n_ok"), F.sum(ok("pages")).alias("pages"), (F.sum(ok("ms")) / F.sum(ok("pages"))).alias("ms_page"), F.avg(ok("cer")).alias("mean_cer"),
        F.median(ok("cer")).alias("median_cer"), F.avg(ok("wer")).alias("mean_wer"), F.avg(ok("word_recall")).alias("mean_recall"), F.avg(ok("confidence")).alias("mean_confidence"),
    )


def judged_terms(expected: DataFrame, found: DataFrame, keys: list[str], min_overlap: float = 0.2) -> DataFrame:
    """keys and the tp, fp and fn of boxes: found boxes are assigned to expected ones of the same keys, each once, best overlap first.

    expected and found: keys, id and a box (x0, y0, x1, y1). The pairs are those of one page and term.
    """
    side = lambda df, c: df.select(*keys, *(F.col(x).alias(f"{c}_{x}") for x in ("id", "x0", "y0", "x1", "y1")))
    shared = overlap_of("e", "f")
    pairs = side(expected, "e").join(side(found, "f"), keys).withColumn("overlap", shared).where(F.col("overlap") >= min_overlap)
    by = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("overlap")).alias("far"), "e_id", "f_id"))).alias("p"))
    state = F.struct(F.array().cast("array<bigint>").alias("e"), F.array().cast("array<bigint>").alias("f"))
    taken = F.aggregate("p", state, lambda s, x: F.when(F.array_contains(s["e"], x["e_id"]) | F.array_contains(s["f"], x["f_id"]), s).otherwise(F.struct(F.array_append(s["e"], x["e_id"]).alias("e"), F.array_append(s["f"], x["f_id"]).alias("f"))))
    hits = by.select(*keys, F.size(taken["e"]).alias("tp"))
    counts = expected.groupBy(*keys).agg(F.count("*").alias("n_e")).join(found.groupBy(*keys).agg(F.count("*").alias("n_f")), keys, "full_outer").join(hits, keys, "left")
    tp = F.coalesce("tp", F.lit(0)).cast("bigint")
    return counts.select(*keys, tp.alias("tp"), (F.coalesce("n_f", F.lit(0)) - tp).alias("fp"), (F.coalesce("n_e", F.lit(0)) - tp).alias("fn"))


def overlap_of(a: str, b: str) -> Column:
    """Shared area over the area of the smaller box."""
    shared = lambda n: F.greatest(F.least(f"{a}_{n}1", f"{b}_{n}1") - F.greatest(f"{a}_{n}0", f"{b}_{n}0"), F.lit(0.0))
    area = lambda c: (F.col(f"{c}_x1") - F.col(f"{c}_x0")) * (F.col(f"{c}_y1") - F.col(f"{c}_y0"))
    return shared("x") * shared("y") / F.least(area(a), area(b))
