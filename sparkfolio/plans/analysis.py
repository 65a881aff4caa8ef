"""Queries of quality, language, error rates and reports over the tables; lineitem's rows serve as lines of pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.functions.text import is_unspaced, page_ranges
from sparkfolio.operators import metrics, quality
from sparkfolio.operators.language import LETTERS, SHORT_WORDS, coverage, language
from sparkfolio.registry import query, table


def lines_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of pages: an order is a document, its halves by line number are pages."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_orderkey").alias("doc_id"), F.pmod("l_linenumber", F.lit(2)).alias("page"), F.col("l_linenumber").alias("ord"), (F.col("l_quantity") + 5).alias("chars"),
        (1 - F.col("l_discount")).alias("confidence"), (F.col("l_quantity") / 2000).alias("height_ratio"), F.col("l_tax").alias("margin"),
    )


ORDERS = """l AS (SELECT l_orderkey AS doc_id, l_linenumber % 2 AS page, l_linenumber AS ord, l_quantity + 5 AS chars, 1 - l_discount AS confidence, l_quantity / 2000 AS height_ratio, l_tax AS margin FROM lineitem)"""
QUALITY = f"""{ORDERS}, s AS (
        SELECT doc_id, count(*) AS n_lines, avg(chars) AS chars, avg(confidence) AS mean, avg(height_ratio) AS height, min(margin) AS margin, list_sort(list(confidence)) AS c FROM l GROUP BY doc_id),
    f AS (SELECT doc_id, n_lines, least(chars, 60) / 30 AS x1, ln(greatest(least(c[n_lines // 10 + 1], 0.999), 0.001) / (1 - greatest(least(c[n_lines // 10 + 1], 0.999), 0.001))) / 5 AS x2,
            least(height * 40, 3) AS x3, ln(greatest(least(mean, 0.999), 0.001) / (1 - greatest(least(mean, 0.999), 0.001))) / 5 AS x4, greatest(least(margin, 1), 0) AS x5 FROM s),
    q AS (SELECT doc_id, n_lines, CASE WHEN n_lines >= 5 THEN 1 / (1 + exp(-greatest(least(0.85323::DOUBLE + 2.00461 * x1 + 0.91330 * x2 - 1.42933 * x3 + 0.53614 * x4 + 0.47998 * x5, 30), -30))) END AS quality FROM f)"""


@query(f"WITH {QUALITY} SELECT doc_id, n_lines, round(quality, 8) AS quality FROM q")
def page_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.page_quality(lines_of_orders(spark, sf_dir), "doc_id").withColumn("quality", F.round("quality", 8))


@query(f"WITH {QUALITY} SELECT doc_id % 100 AS source, round(sum(CASE WHEN quality IS NOT NULL THEN quality * n_lines END) / sum(CASE WHEN quality IS NOT NULL THEN n_lines END), 8) AS quality FROM q GROUP BY 1")
def doc_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = quality.page_quality(lines_of_orders(spark, sf_dir), "doc_id").withColumn("source", F.col("doc_id") % 100)
    return quality.document_quality(pages, "source").withColumn("quality", F.round("quality", 8))


@query(f"WITH {ORDERS} SELECT doc_id, count(*) AS n_lines, round(avg(confidence), 8) AS confidence FROM l GROUP BY doc_id")
def doc_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_of_orders(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.round(F.avg("confidence"), 8).alias("confidence"))


@query(r"SELECT doc_id, 1 AS n_pages, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines, len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')) AS n_words, length(text) AS n_chars FROM documents")
def document_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""))
    words = F.regexp_count("text", F.lit(r"[^ \t\n\x0B\f\r]+"))
    return table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("n_pages"), *(c.cast("bigint").alias(n) for c, n in ((rows, "n_lines"), (words, "n_words"), (F.length("text"), "n_chars"))))


_WORDS = ", ".join(f"('{lang}', {k}, '{w}')" for k, lang in enumerate(SHORT_WORDS) for w in sorted(set(SHORT_WORDS[lang].split())))
LANGUAGE = rf"""
    s(code, k, w) AS (VALUES {_WORDS}),
    w AS (SELECT doc_id, unnest(regexp_extract_all(lower(substring(text, 1, 200000)), '\p{{L}}+')) AS w FROM documents),
    n AS (SELECT doc_id, count(*) AS n FROM w GROUP BY doc_id),
    c AS (SELECT doc_id, code, k, count(*) AS c FROM w JOIN s USING (w) GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c DESC, k) AS r FROM c),
    p AS (SELECT doc_id, max(CASE WHEN r = 1 THEN code END) AS code, max(CASE WHEN r = 1 THEN c END) AS top, coalesce(max(CASE WHEN r = 2 THEN c END), 0) AS second FROM r GROUP BY doc_id),
    g AS (SELECT d.doc_id, d.lang, CASE WHEN n.n >= 40 AND top >= 0.08 * n.n AND top >= 1.5 * second THEN code END AS detected
          FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN p USING (doc_id))"""


@query(f"WITH {LANGUAGE} SELECT doc_id, detected FROM g")
def language_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language(table(spark, sf_dir, "documents"), "doc_id").select("doc_id", "detected")


@query(f"WITH {LANGUAGE} SELECT lang, {', '.join(f"count_if(coalesce(detected, 'none') = '{x}') AS n_{x}" for x in ('de', 'en', 'fr', 'es', 'it', 'nl', 'pt', 'none'))} FROM g GROUP BY lang")
def language_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language(table(spark, sf_dir, "documents"), "doc_id", "lang").select("lang", F.coalesce("detected", F.lit("none")).alias("detected"))
    values = [*SHORT_WORDS, "none"]
    return metrics.confusion(found, "lang", "detected", values).withColumnsRenamed({x: f"n_{x}" for x in values})


_LETTERS = ", ".join(f"('{k}', '{''.join(sorted(set('abcdefghijklmnopqrstuvwxyz' + v)))}')" for k, v in LETTERS.items())


@query(
    f"""
    WITH n(lang, letters) AS (VALUES {_LETTERS}),
    c AS (SELECT coalesce(source, '') AS name, list_distinct(flatten(list(string_split(lower(text), '')))) AS own FROM documents WHERE text IS NOT NULL GROUP BY 1),
    m AS (SELECT name, lang, length(letters) AS n, list_filter(string_split(letters, ''), lambda x: NOT list_contains(own, x)) AS missing FROM c, n)
    SELECT name, lang, array_to_string(missing, '') AS missing, 1 - len(missing) / n AS ratio FROM m
    """
)
def charset_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the characters of each source cover the languages."""
    docs = table(spark, sf_dir, "documents").where("text is not null")
    own = docs.select("source", F.array_distinct(F.split(F.lower("text"), "")).alias("c"))
    sets = own.select("source", F.explode("c").alias("c")).distinct().groupBy("source").agg(F.array_join(F.sort_array(F.collect_list("c")), "").alias("chars"))
    return coverage(sets.select(F.coalesce("source", F.lit("")).alias("name"), "chars"))


PLAIN = "regexp_replace({}.text, '[^\\x00-\\x7F]', '?', 'g')"  # edits are counted in bytes there
PAIRS = f"p AS (SELECT a.item_id, {PLAIN.format('a')} AS expected, {PLAIN.format('b')} AS found FROM benchmark a JOIN benchmark b ON b.item_id = a.item_id + 1)"


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark").withColumn("text", F.regexp_replace("text", r"[^\x00-\x7F]", "?"))
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("found"))
    return b.select("item_id", F.col("text").alias("expected")).join(after, "item_id")


@query(f"WITH {PAIRS} SELECT item_id, round(least(levenshtein(expected, found) / length(expected), 1), 8) AS cer FROM p")
def cer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item_id", F.round(metrics.cer(F.col("expected"), F.col("found")), 8).alias("cer"))


@query(
    rf"""
    WITH {PAIRS}, w AS (SELECT item_id, unnest(regexp_extract_all(lower(expected), '\S+')) AS w, 1 AS e, 0 AS f FROM p
                        UNION ALL SELECT item_id, unnest(regexp_extract_all(lower(found), '\S+')), 0, 1 FROM p),
    c AS (SELECT item_id, w, sum(e) AS e, sum(f) AS f FROM w GROUP BY ALL)
    SELECT item_id, round(sum(least(e, f)) / sum(e), 8) AS recall FROM c GROUP BY item_id
    """
)
def word_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.word_recall(pairs(spark, sf_dir), "item_id").withColumn("recall", F.round("recall", 8))


@query(
    rf"""
    WITH RECURSIVE {PAIRS}, w AS (SELECT item_id, list_filter(regexp_split_to_array(lower(expected), '\s+'), lambda x: x <> '') AS a, list_filter(regexp_split_to_array(lower(found), '\s+'), lambda x: x <> '') AS b FROM p),
    v AS (SELECT item_id, a, b, list_distinct(list_concat(a, b)) AS v FROM w),
    s AS (SELECT item_id, len(a) AS n, array_to_string(list_transform(a, lambda x: chr(CAST(32 + list_position(v, x) AS INT))), '') AS a, array_to_string(list_transform(b, lambda x: chr(CAST(32 + list_position(v, x) AS INT))), '') AS b, len(v) AS k FROM v)
    SELECT item_id, round(least(levenshtein(a, b) / n, 1), 8) AS wer FROM s
    """
)
def wer_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select("item_id", F.round(metrics.wer(F.lower("expected"), F.lower("found")), 8).alias("wer"))


@query(
    """
    WITH r AS (SELECT d.lang, toxic = 1 AS expected, quality = 0 AS found FROM labels JOIN documents d USING (doc_id) WHERE toxic IS NOT NULL AND quality IS NOT NULL),
    s AS (SELECT lang, count_if(expected AND found) AS tp, count_if(NOT expected AND found) AS fp, count_if(expected AND NOT found) AS fn FROM r GROUP BY lang)
    SELECT lang, tp, fp, fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1 END AS recall,
           CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 1 END AS f1 FROM s
    """
)
def prf_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id").where("toxic is not null and quality is not null")
    return metrics.prf(rows.select("lang", (F.col("toxic") == 1).alias("expected"), (F.col("quality") == 0).alias("found")), "lang")


@query(
    """
    WITH r AS (SELECT l_shipdate::DATE AS day, row_number() OVER (PARTITION BY l_shipdate::DATE ORDER BY l_quantity, l_orderkey, l_linenumber) AS a,
                      row_number() OVER (PARTITION BY l_shipdate::DATE ORDER BY l_extendedprice, l_orderkey, l_linenumber) AS b FROM lineitem)
    SELECT day, round(corr(a, b), 8) + 0.0 AS rho FROM r GROUP BY day HAVING count(*) > 2
    """
)
def spearman_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank correlation of quantity and price on each day."""
    li = table(spark, sf_dir, "lineitem").withColumn("day", F.to_date("l_shipdate"))
    many = li.groupBy("day").count().where("count > 2").select("day")
    rho = metrics.spearman(li, "day", "l_quantity", "l_extendedprice", F.struct("l_orderkey", "l_linenumber"))
    return rho.join(many, "day").withColumn("rho", F.round("rho", 8) + 0.0)


SEVERE = "CASE WHEN event_type = 'purchase' THEN 'critical' WHEN value > 60 THEN 'high' WHEN value > 30 THEN 'medium' WHEN value > 10 THEN 'low' ELSE 'info' END"


def hits_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("severity", F.expr(SEVERE))


@query(f"WITH e AS (SELECT user_id, {SEVERE} AS severity FROM events) SELECT user_id, arg_max(severity, list_position(['info', 'low', 'medium', 'high', 'critical'], severity)) AS severity, count(*) AS n_hits FROM e GROUP BY user_id")
def max_severity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.max_severity(hits_of_events(spark, sf_dir), "user_id")


@query(
    """
    WITH r AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey % 3 AS INT) AS level, CASE o_orderstatus WHEN 'F' THEN 'CLEAR' WHEN 'O' THEN 'AMBER' END AS tlp, CASE WHEN o_orderpriority LIKE '1%' THEN 'INTERN' END AS company FROM orders)
    SELECT doc_id, level >= 1 OR coalesce(tlp <> 'CLEAR', false) OR company IS NOT NULL AS trips FROM r
    """
)
def gate_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    tlp = F.when(F.col("o_orderstatus") == "F", "CLEAR").when(F.col("o_orderstatus") == "O", "AMBER")
    company = F.when(F.col("o_orderpriority").startswith("1"), "INTERN")
    return o.select(F.col("o_orderkey").alias("doc_id"), quality.gate_any(F.col("o_orderkey") % 3, tlp, company, F.lit(0)).alias("trips"))


FINDINGS = "f AS (SELECT l_orderkey AS doc_id, l_partkey * 100 + l_linenumber AS ord, CAST(l_suppkey % 4 AS INT) AS level, l_returnflag || l_linestatus AS label, CASE WHEN l_returnflag = 'N' THEN 0 ELSE 1 END AS names_grade, l_tax > 0.04 AS fuzzy, l_linenumber AS page FROM lineitem)"


def findings_of_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("doc_id"), (F.col("l_partkey") * 100 + F.col("l_linenumber")).alias("ord"), (F.col("l_suppkey") % 4).cast("int").alias("level"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.when(F.col("l_returnflag") == "N", 0).otherwise(1).alias("names_grade"), (F.col("l_tax") > 0.04).alias("fuzzy"), F.col("l_linenumber").alias("page"),
    )


@query(
    f"""
    WITH {FINDINGS}, t AS (SELECT *, max(level) OVER (PARTITION BY doc_id) AS top FROM f),
    g AS (SELECT doc_id, level, label, max(names_grade) AS names, count_if(NOT fuzzy) AS clean, count(*) AS n, min(ord) AS first FROM t WHERE level = top GROUP BY ALL)
    SELECT doc_id, level, label FROM g QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY names DESC, clean DESC, n DESC, first) = 1
    """
)
def label_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ties of all keys can't be: first is distinct."""
    rows = findings_of_orders(spark, sf_dir)
    return quality.winning_label(rows, "doc_id")


@query(
    f"""
    WITH {FINDINGS}, p AS (SELECT doc_id, page, max(level) AS level FROM f GROUP BY ALL),
    d AS (SELECT doc_id, max(level) AS level, count(*) AS n, coalesce(list_sort(list(page) FILTER (level = 0)), []) AS u FROM p GROUP BY doc_id)
    SELECT doc_id, array_to_string(u, ',') AS unmarked_pages FROM d WHERE level >= 1 AND n >= 2
    """
)
def unmarked_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = findings_of_orders(spark, sf_dir).groupBy("doc_id", "page").agg(F.max("level").alias("level"))
    return quality.unmarked_pages(levels, "doc_id").withColumn("unmarked_pages", F.array_join("unmarked_pages", ","))


@query(
    f"""
    WITH {FINDINGS}, g AS (SELECT doc_id, label, min(ord) AS pos FROM f GROUP BY ALL)
    SELECT doc_id, string_agg(label, ',' ORDER BY pos, label) AS labels FROM g GROUP BY doc_id
    """
)
def caveats_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct labels of a document in the order first seen."""
    return quality.distinct_in_order(findings_of_orders(spark, sf_dir), "doc_id", "label", "ord").withColumn("labels", F.array_join("labels", ","))


@query(
    """
    WITH p AS (SELECT DISTINCT l_orderkey AS doc_id, CAST(l_linenumber AS INT) AS p FROM lineitem WHERE l_returnflag <> 'A'),
    i AS (SELECT doc_id, p, p - row_number() OVER (PARTITION BY doc_id ORDER BY p) AS g FROM p),
    r AS (SELECT doc_id, min(p) AS a, max(p) AS b FROM i GROUP BY doc_id, g),
    s AS (SELECT doc_id, count(*) AS n, min(a) = max(b) AS one, string_agg(CASE WHEN a = b THEN a::VARCHAR WHEN b = a + 1 THEN a || ', ' || b ELSE a || '-' || b END, ', ' ORDER BY a) AS t FROM r GROUP BY doc_id)
    SELECT doc_id, CASE WHEN one THEN 'p. ' ELSE 'pp. ' END || t AS pages FROM s
    """
)
def page_range_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").where("l_returnflag <> 'A'")
    return li.groupBy(F.col("l_orderkey").alias("doc_id")).agg(page_ranges(F.collect_set("l_linenumber")).alias("pages"))


@query("SELECT lang, count_if(regexp_matches(text, '[\\x{4E00}-\\x{9FFF}\\x{3040}-\\x{30FF}]')) AS n_unspaced, count(*) AS n FROM documents GROUP BY lang")
def script_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count_if(is_unspaced(F.col("text"))).alias("n_unspaced"), F.count("*").alias("n"))
