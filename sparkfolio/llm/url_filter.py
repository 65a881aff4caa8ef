"""URL filters (operator 4), by DataFrame functions only.

Host and path rules decide where one fits; the longest that fits wins. Any other url is judged by a
logistic regression on hashed character n-grams of host and path, trained from the small labelled
table below by stochastic gradient descent with decay. Training is one aggregation over the table's rows in an
array, pass after pass; its state is the array of BUCKETS weights.

Defined results: a null url, or one without `://`, has an empty host and path and no rule, and is
judged by the model on no n-grams, whose bias allows it. A score of exactly 0.5 blocks. Urls of any
length are read whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hashed n-grams, their lengths, passes over the table, the step of descent, the score without evidence, and what is left of the weights after each step.
BUCKETS, GRAMS, PASSES, STEP, BIAS, DECAY = 4096, (3, 4, 5), 15, 1.0, -1.5, 0.9995
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))

BAD = (
    "casino poker jackpot slots roulette bets betting free-bets casino-win win-big cheap-pills pills viagra pharmacy-deals cheap-meds spam spam-farm "
    "link-farm ads ads-track adserver track-click clickbait popup-ads adult adult-x xxx porn sex-cams escorts payday-loans quick-loan fast-cash warez "
    "crack-keygen torrent-hub free-download replica-watches phish-login lottery-prize get-rich forex-signals"
).split()
GOOD = (
    "news daily-post blog journal library school university college docs wiki handbook recipes kitchen garden museum weather science physics travel hiking "
    "health clinic forum support archive music history gazette council parish theatre football chess books poetry maps railway harbour observatory nature "
    "orchard village bakery workshop education station-guide national-library nation-review translation-office action-arts the-times thesaurus mathematics "
    "anthology northern-lights southern-cross weather-station brother-printers another-place further-reading thistle-farm"
).split()


def labelled_urls() -> list[tuple[str, int]]:
    """The small labelled table: sites of either kind in like surroundings, 1 to block."""
    out = []
    for kind, sites in ((1, BAD), (0, GOOD)):
        for k, site in enumerate(sites):
            sub, end, lang = ("", "www.", "m.", "blog.")[k % 4], ("com", "net", "org")[k % 3], ("en", "de", "fr", "es")[k // 2 % 4]
            out.append((f"https://{sub}{site}.example.{end}/{lang}/{137 * (k + 3) % 997}", kind))
            out.append((f"http://{('', 'www.')[k % 2]}{site}.example.{('org', 'com', 'net')[k % 3]}/{lang}/{211 * (k + 5) % 991}{('.html', '/', '')[k % 3]}", kind))
            out.append((f"https://{sub}site{k}.example.{end}/{lang}/{site}/{53 * (k + 1) % 983}", kind))
    return sorted(out, key=lambda x: (sum(map(ord, x[0])) * 7919 % 1009, x))


def parts(url: Column) -> tuple[Column, Column]:
    """Host in lower case and path of url; empty where there is no `://`."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.coalesce(F.translate(host, upper, upper.lower()), F.lit("")), F.coalesce(path, F.lit(""))


def features(text: Column, kind: str) -> Column:
    """The distinct hashed n-grams of text between its borders, all digits alike; none of an empty text."""
    alike = F.translate(text, "123456789", "0" * 9)
    chars = F.filter(F.split(F.concat(F.lit("^"), alike, F.lit("$")), ""), lambda c: c != "")

    made = F.transform(F.array(chars), lambda c: F.array_distinct(F.flatten(F.array(*(grams_of(c, n, kind) for n in GRAMS)))))
    return F.when(text == "", F.array().cast("array<int>")).otherwise(made[0])


def grams_of(chars: Column, n: int, kind: str) -> Column:
    at = F.when(F.size(chars) >= n, F.sequence(F.lit(0), F.size(chars) - n)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.pmod(F.xxhash64(F.lit(kind), *(F.get(chars, i + k) for k in range(n))), F.lit(BUCKETS)).cast("int"))


def raw_score(weights: Column, host: Column, path: Column) -> Column:
    """Weights of either part's n-grams over the root of their number, and the bias, which stands last."""
    part = lambda f: F.aggregate(f, F.lit(0.0), lambda s, k: s + F.get(weights, k)) / F.sqrt(F.greatest(F.size(f), F.lit(1)).cast("double"))
    return part(host) + part(path) + F.get(weights, F.lit(BUCKETS))


def logistic(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def train(spark: SparkSession, table: list[tuple[str, int]] | None = None) -> list[float]:
    """The weights; the bias is held at BIAS, so that a url without evidence is allowed."""
    values = ", ".join("('{}', {})".format(u.replace("'", "''"), y) for u, y in table or labelled_urls())
    rows = spark.sql(f"SELECT url, CAST(y AS DOUBLE) AS y FROM VALUES {values} AS t(url, y)")
    host, path = parts(F.col("url"))
    rows = rows.select("url", "y", host.alias("h"), path.alias("p")).select("url", "y", features(F.col("h"), "h").alias("h"), features(F.col("p"), "p").alias("p"))
    share = lambda f, i: F.when(F.array_contains(f, i), 1 / F.sqrt(F.size(f).cast("double"))).otherwise(F.lit(0.0))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS)), lambda i: share(F.col("h"), i) + share(F.col("p"), i))  # the bias has no n-gram
    rows = rows.select(F.xxhash64("url").alias("turn"), "y", "h", "p", dense.alias("x"))
    examples = rows.groupBy().agg(F.sort_array(F.collect_list(F.struct("turn", "y", "h", "p", "x"))).alias("table"))
    start = F.array_append(F.array_repeat(F.lit(0.0), BUCKETS), F.lit(BIAS))

    def learn(w: Column, e: Column) -> Column:
        push = F.array(F.lit(STEP) * (e["y"] - logistic(raw_score(w, e["h"], e["p"]))))  # computed once for all weights
        kept = lambda v, i: F.when(i < BUCKETS, DECAY * v).otherwise(v)
        return F.transform(push, lambda m: F.zip_with(F.transform(w, kept), e["x"], lambda v, x: v + m * x))[0]

    turns = F.sequence(F.lit(1), F.lit(PASSES))
    return examples.select(F.aggregate(turns, start, lambda w, _: F.aggregate("table", w, learn)).alias("w")).first()["w"]


def judge_urls(pages: DataFrame, weights: list[float] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and score (of the model, also where a rule decides) of every row of pages."""
    w = F.split(F.lit(",".join(map(repr, weights or train(pages.sparkSession)))), ",").cast("array<double>")
    host, path = parts(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    fits = lambda h, p: ((F.col("host") == h) | F.col("host").endswith(f".{h}")) & F.col("path").startswith(p)
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        rule, verdict = F.when(fits(h, p), F.lit(h + p)).otherwise(rule), F.when(fits(h, p), F.lit(kind)).otherwise(verdict)
    score = logistic(raw_score(w, features(F.col("host"), "h"), features(F.col("path"), "p")))
    rows = rows.withColumns({"rule": rule, "decided": verdict, "score": score})
    by_score = F.when(F.col("score") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return rows.select("page_id", "host", "path", "rule", F.coalesce("decided", by_score).alias("verdict"), "score")
