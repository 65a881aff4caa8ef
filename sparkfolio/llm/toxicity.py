"""Toxicity (operator 5): a factorization machine over hashed terms.

A text's features are its distinct hashed words; the score is the logistic of
w0 + sum w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j, whose second sum learns that words are harmful
together where neither is alone. A word's value x_i is the same in texts of any length, so that a few
insults in a long text still count: the size of its log odds between the labels where that is
GATE standard errors from zero or more, else a share BASE of its rarity, so that words which mean
nothing by themselves can still do so in pairs. Weights start at zero and factors at random; both are
fitted together by scaled gradient steps (running means of gradient and square) on the logistic loss,
in which either label has half the weight, with a penalty on squares. One in HELD of the examples is
held out; passes end when its loss hasn't fallen for PATIENCE of them, and the best pass counts.

Training takes a bounded sample of labelled rows (SAMPLE, by hash of doc_id, an equal number of either
label where there are so many), hashed on the executors.

Defined results: null and empty texts have no features and get the score of the bias alone; without
labelled rows of both kinds every score is 0. Of rows that share a doc_id the sample has one: that of
the least features. drop_toxic keeps rows whose columns are null, repeated rows, and columns named
score or predicted as they are; an empty table stays empty.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkfolio.llm.common import map_texts

#: Labelled rows of each kind at most, hashed features, latent factors, seed.
SAMPLE, BITS, FACTORS, SEED = 6_000, 20, 6, 7
#: Examples that a feature must have, standard errors of the log odds that count, value of the other words by their rarity.
LEAST, GATE, BASE = 4, 2.5, 0.3
#: Passes at most, passes without gain that end training, part that is held out, rows of a step, size of steps, spread of factors at the start.
PASSES, PATIENCE, HELD, BATCH, RATE, SPREAD = 80, 12, 8, 128, 0.01, 0.05
#: Penalty on the squares of weights and of factors, for the whole sample.
WEIGHT_DECAY, FACTOR_DECAY = 10.0, 3.0
CACHED = 1 << 17
WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


class Terms:
    """Texts as distinct feature numbers, with a bounded cache of words."""

    def __init__(self) -> None:
        self.cache: dict[str, int] = {}  # set.difference() is fast for a plain dict alone

    def __call__(self, text: str) -> np.ndarray:
        words = set(WORD.findall(text.lower()))
        cache = self.cache
        if len(cache) > CACHED:
            cache.clear()
        for w in words.difference(cache):
            cache[w] = xxhash.xxh64_intdigest(w.encode()) >> (64 - BITS)
        return np.unique(np.fromiter(map(cache.__getitem__, words), np.int32, len(words)))


@dataclass
class Machine:
    """Bias, and values, weights and factors of the features that occur in training; rows maps a feature to its row, 0 if it has none."""

    bias: float
    rows: np.ndarray
    x: np.ndarray
    w: np.ndarray
    v: np.ndarray

    def raw(self, features: np.ndarray) -> float:
        r = self.rows[features]
        r = r[r > 0]
        x = self.x[r]
        s = self.v[r] * x[:, None]
        total = s.sum(axis=0)
        return float(self.bias + self.w[r] @ x + 0.5 * (total @ total - (s * s).sum()))

    def score(self, features: np.ndarray) -> float:
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, self.raw(features))))) if self.bias > -math.inf else 0.0


def values_of(seen: np.ndarray, toxic: np.ndarray, n: int, n_toxic: int) -> np.ndarray:
    """Value of each feature from the number of examples, and of toxic ones, that have it."""
    clean = seen - toxic
    odds = np.log((toxic + 0.5) / (n_toxic + 1)) - np.log((clean + 0.5) / (n - n_toxic + 1))
    error = np.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))
    rarity = np.log(n / seen) / max(1.0, np.log(n / LEAST))
    return np.where(np.abs(odds) > GATE * error, np.abs(odds), BASE * rarity)


def fit_machine(examples: list[np.ndarray], labels: list[int], seed: int = SEED) -> Machine:
    """examples: the features of each; labels: 0 or 1."""
    y = np.array(labels, float)
    rows = np.zeros(1 << BITS, np.int32)
    if not len(y) or y.min() == y.max():
        return Machine(-math.inf, rows, np.zeros(1), np.zeros(1), np.zeros((1, FACTORS)))
    seen = np.bincount(np.concatenate(examples), minlength=1 << BITS)
    used = np.flatnonzero(seen >= LEAST)
    rows[used] = np.arange(1, len(used) + 1)
    toxic = np.bincount(np.concatenate([e for e, t in zip(examples, labels, strict=True) if t]), minlength=1 << BITS)
    x = np.append(0.0, values_of(seen[used], toxic[used], len(y), int(y.sum())))
    kept = [r[r > 0] for r in (rows[e] for e in examples)]

    rnd = np.random.default_rng(seed)
    order = rnd.permutation(len(kept))
    apart, train = (order[::HELD], np.delete(order, np.s_[::HELD])) if len(order) >= 4 * HELD else (order, order)
    cost = (0.5 * len(y) / np.array([np.sum(y == 0), np.sum(y == 1)]))[y.astype(int)]  # either label has half the weight
    # column 0 has the weights, the others the factors
    p = np.concatenate([np.zeros((len(x), 1)), rnd.normal(0, SPREAD, (len(x), FACTORS))], axis=1)
    p[0], bias = 0, np.zeros(1)
    penalty = np.array([WEIGHT_DECAY, *[FACTOR_DECAY] * FACTORS]) / len(train)

    def forward(batch: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Feature rows and their examples, weights and factors times values and their sums by example, and what the logistic is taken of."""
        ids = np.concatenate([kept[k] for k in batch])
        of = np.repeat(np.arange(len(batch)), [len(kept[k]) for k in batch])
        own = p[ids] * x[ids][:, None]
        total = np.stack([np.bincount(of, c, len(batch)) for c in own.T], axis=1)
        squares = np.bincount(of, (own[:, 1:] ** 2).sum(axis=1), len(batch))
        return ids, of, own, total, bias[0] + total[:, 0] + 0.5 * ((total[:, 1:] ** 2).sum(axis=1) - squares)

    state = [(q, np.zeros_like(q), np.zeros_like(q)) for q in (p, bias)]
    steps, least, left, best = 0, math.inf, PATIENCE, (0.0, p.copy())
    for _ in range(PASSES):
        train = rnd.permutation(train)
        for at in range(0, len(train), BATCH):
            batch = train[at : at + BATCH]
            ids, of, own, total, raw = forward(batch)
            d = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - y[batch]) * cost[batch] / len(batch)
            each = np.concatenate([np.ones((len(ids), 1)), total[of, 1:] - own[:, 1:]], axis=1) * (d[of] * x[ids])[:, None]
            slope = np.stack([np.bincount(ids, c, len(x)) for c in each.T], axis=1) + penalty * p
            steps += 1
            for (q, mean, square), g in zip(state, (slope, d.sum()), strict=True):
                mean += 0.1 * (g - mean)
                square += 0.001 * (g * g - square)
                q -= RATE * (mean / (1 - 0.9**steps)) / (np.sqrt(square / (1 - 0.999**steps)) + 1e-6)
        raw = forward(apart)[4]
        loss = float((cost[apart] * np.logaddexp(0, np.where(y[apart] > 0, -raw, raw))).mean())
        left -= 1
        if loss < least - 1e-4:
            least, left, best = loss, PATIENCE, (float(bias[0]), p.copy())
        if not left:
            break
    return Machine(best[0], rows, x, best[1][:, 0], best[1][:, 1:])


def learn_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Machine:
    """labels: doc_id and toxic (0 or 1; others don't count); docs: doc_id and text."""
    wanted = labels.select("doc_id", "toxic").where("toxic in (0, 1)").dropDuplicates(["doc_id"])
    keyed = wanted.withColumn("turn", F.xxhash64("doc_id"))
    parts = [keyed.where(F.col("toxic") == k).orderBy("turn", "doc_id").limit(sample) for k in (0, 1)]
    chosen = parts[0].unionAll(parts[1]).drop("turn")

    def start():
        terms = Terms()
        return lambda texts: {"ids": pa.array([terms(t) for t in texts], pa.list_(pa.int32()))}

    # the chosen rows are at most 2 * sample pairs of integers
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    hashed = map_texts(rows, ["doc_id", "toxic"], start, "ids array<int>")
    got = hashed.groupBy("doc_id").agg(F.min("ids").alias("ids"), F.first("toxic").alias("toxic")).toArrow()
    order = sorted(range(got.num_rows), key=lambda k, d=got["doc_id"].to_pylist(): d[k])
    ids, y = got["ids"].combine_chunks(), got["toxic"].to_pylist()
    return fit_machine([np.asarray(ids[k].values) for k in order], [y[k] for k in order])


def score_toxicity(docs: DataFrame, machine: Machine, keys: list[str], with_text: bool = False) -> DataFrame:
    """keys of docs with score and predicted, of the whole text, and the text itself if asked for."""
    sent = docs.sparkSession.sparkContext.broadcast(machine)

    def start():
        terms, learned = Terms(), sent.value

        def work(texts: list[str]) -> dict[str, pa.Array]:
            scores = [learned.score(terms(t)) for t in texts]
            return {"score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= 0.5) for s in scores], pa.int32())}

        return work

    return map_texts(docs, keys, start, "score double, predicted int", with_text=with_text)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs whose predicted is 0, with their columns; the machine is learned from the labelled rows of docs."""
    machine = learn_toxicity(docs, labels)
    names = docs.columns
    docs = docs.withColumnsRenamed({n: f"own {n}" for n in ("score", "predicted")})  # columns of these names stay as they were
    scored = score_toxicity(docs, machine, [n for n in docs.columns if n != "text"], with_text=True)
    kept = scored.where("predicted = 0").drop("score", "predicted").withColumnsRenamed({f"own {n}": n for n in ("score", "predicted")})
    return kept.select(*(f"`{n}`" for n in names))
