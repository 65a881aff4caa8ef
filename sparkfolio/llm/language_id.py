"""Language ID (operator 10): word-first backoff.

A known word adds its log frequency in each language. An unseen word falls back to character n-grams
of the word with its borders marked, the longest first: where no n-gram of a length is known, the
next shorter length is tried, each step down at a fixed discount; single letters are the last resort.
The prediction is the language with the highest sum; the score is its share among the languages by
the mean log frequency a word, so that it doesn't saturate with length.

Counts are taken over a sample of labelled documents, SAMPLE rows of each language: a row is in it
where its hash falls below SAMPLE / (rows of its language), so that rare languages are read whole. They
are DataFrame aggregations; the model holds the WORDS commonest words and GRAMS commonest n-grams of
each language. The words are ranked in parts of each language first, so that a language that has most
rows isn't one task. Every word of every text is scored.

Defined results: a null text, or one without a letter, is `und` with score 0; with no labelled rows
every text is `und`. Equal sums go to the language that sorts first. Rows that repeat both doc_id and
text are in the sample together or not at all.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from sparkfolio.llm.common import cut, map_texts

#: Bounds of the model for each language: labelled rows that are read (expected), words and n-grams kept. Longest n-gram, parts of a language's words.
SAMPLE, WORDS, GRAMS, LONGEST, PARTS = 8_000, 20_000, 20_000, 4, 16
#: Log discount of each step to shorter n-grams, and words kept in a task's cache.
STEP, CACHED = math.log(0.4), 1 << 18
LETTERS = regex.compile(r"\p{L}+")


@dataclass
class Backoff:
    """langs in order; words and grams: text -> log frequency in each language."""

    langs: list[str]
    words: dict[str, np.ndarray]
    grams: list[dict[str, np.ndarray]]
    floor: np.ndarray

    def word(self, w: str) -> np.ndarray:
        """Log frequency of w in each language: as a word, else by its longest known n-grams."""
        if (found := self.words.get(w)) is not None:
            return found
        marked = f"<{w}>"
        for n in range(LONGEST, 0, -1):
            known = self.grams[n]
            got = [g for k in range(len(marked) - n + 1) if (g := known.get(marked[k : k + n])) is not None]
            if got:
                return np.mean(got, axis=0) + STEP * (LONGEST - n + 1)
        return self.floor

    def text(self, text: str, cache: dict[str, np.ndarray]) -> tuple[str, float]:
        counts = Counter(LETTERS.findall(text.lower()))
        if not counts or not self.langs:
            return "und", 0.0
        for w in counts:
            if w not in cache:
                cache[w] = self.word(w)
        logs = np.array([cache[w] for w in counts])
        n = np.fromiter(counts.values(), float, len(counts))
        sums = n @ logs / n.sum()
        best = int(np.argmax(sums))
        return self.langs[best], float(1 / np.exp(sums - sums[best]).sum())


def learn_languages(labelled: DataFrame, sample: int = SAMPLE) -> Backoff:
    """labelled: text, lang and doc_id; rows without a lang don't count."""
    rows = labelled.select("doc_id", "text", "lang").where("lang is not null and text is not null")
    # a row for each language, as a table whose size Spark knows: it is broadcast where small, so that texts aren't shuffled
    shares = cut(rows.groupBy("lang").agg((F.lit(float(sample)) / F.count("*")).alias("share")))
    turn = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    rows = rows.join(shares, "lang").where(turn < F.col("share"))
    words = rows.select("lang", F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("w")).where("w != ''").groupBy("lang", "w").count()
    order = (F.desc("count"), "w")
    parts = words.withColumn("part", F.pmod(F.xxhash64("w"), F.lit(PARTS)))
    parts = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("k") <= 2 * WORDS)
    kept = parts.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).where(F.col("k") <= 2 * WORDS)
    got = kept.select("lang", "w", "count", "k").toPandas()
    langs = sorted(set(got["lang"]))
    at = {x: k for k, x in enumerate(langs)}
    tables: list[dict[str, np.ndarray]] = [{} for _ in range(LONGEST + 1)]
    counts: dict[str, np.ndarray] = {}
    blank = np.zeros(len(langs))
    for lang, w, n, k in got.itertuples(index=False):
        if k <= WORDS and n > 1:
            counts.setdefault(w, blank.copy())[at[lang]] += n
        marked = f"<{w}>"
        for size in range(1, LONGEST + 1):
            t = tables[size]
            for i in range(len(marked) - size + 1):
                g = marked[i : i + size]
                if g not in t:
                    t[g] = blank.copy()
                t[g][at[lang]] += n

    def logs(t: dict[str, np.ndarray], most: int) -> dict[str, np.ndarray]:
        if not t:
            return {}
        every = sorted(t)
        m = np.array([t[k] for k in every])
        of_each = [np.argsort(-c, kind="stable")[: min(most, int((c > 0).sum()))] for c in m.T]  # a frequent language crowds out no other
        best = np.unique(np.concatenate(of_each))
        keys, m = [every[k] for k in best], m[best]
        m = np.log((m + 0.1) / (m.sum(axis=0) + 0.1 * len(keys)))
        return dict(zip(keys, m, strict=True))

    floor = np.full(len(langs), -20.0)
    return Backoff(langs, logs(counts, WORDS), [logs(t, GRAMS) for t in tables], floor)


def identify_language(docs: DataFrame, model: Backoff, keys: list[str]) -> DataFrame:
    """keys of docs with lang_pred and score, of the whole text."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        cache: dict[str, np.ndarray] = {}
        learned = sent.value

        def work(texts: list[str]) -> dict[str, pa.Array]:
            if len(cache) > CACHED:
                cache.clear()
            got = [learned.text(t, cache) for t in texts]
            return {"lang_pred": pa.array([x[0] for x in got], pa.string()), "score": pa.array([x[1] for x in got], pa.float64())}

        return work

    return map_texts(docs, keys, start, "lang_pred string, score double")
