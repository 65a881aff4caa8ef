"""Queries of reports of findings: lineitem's rows serve as findings, orders as the files that they are found in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators import metrics, reports
from sparkfolio.registry import query, table

#: Files and their findings in SQL, as files() and findings() have them.
ROWS = """
    files AS (SELECT o_orderkey::VARCHAR AS source, CASE WHEN o_orderkey % 17 = 0 THEN 'error' ELSE 'ok' END AS status FROM orders),
    found AS (SELECT l_orderkey::VARCHAR AS source, CAST(l_linenumber AS INT) AS page, CASE WHEN l_partkey % 3 = 0 THEN 'term' WHEN l_partkey % 3 = 1 THEN 'marking' ELSE 'mention' END AS kind, CAST(l_suppkey % 5 AS INT) AS level,
                     CASE WHEN l_suppkey % 7 = 0 THEN 'TLP:CLEAR' WHEN l_suppkey % 7 = 1 THEN 'TLP:RED' ELSE l_returnflag || l_linestatus END AS label, CASE WHEN l_suppkey % 7 < 2 THEN 'tlp' WHEN l_suppkey % 7 = 2 THEN 'company' ELSE 'de' END AS scheme,
                     CASE WHEN l_partkey % 3 = 0 THEN (['info', 'low', 'medium', 'high', 'critical'])[CAST(l_partkey % 5 AS INT) + 1] END AS severity, l_quantity AS x0, l_tax AS y0 FROM lineitem WHERE l_quantity > 30),
    by_file AS (SELECT source, max(CASE WHEN kind = 'marking' AND scheme = 'de' THEN level END) AS level, max(CASE WHEN kind = 'marking' AND scheme = 'tlp' AND label <> 'TLP:CLEAR' THEN 1 END) AS tlp, max(CASE WHEN kind = 'marking' AND scheme = 'company' THEN 1 END) AS company,
                       count_if(kind = 'term') AS n_hits, list(severity) FILTER (severity IS NOT NULL) AS severities FROM found GROUP BY source),
    f AS (SELECT source, status, coalesce(level, 0) AS level, tlp, company, coalesce(n_hits, 0) AS n_hits, coalesce(severities, []) AS severities FROM files LEFT JOIN by_file USING (source)),
    g AS (SELECT *, level >= 1 OR tlp IS NOT NULL OR company IS NOT NULL AS marked, level >= 1 OR tlp IS NOT NULL OR company IS NOT NULL OR n_hits > 0 AS any_, level >= 3 AS grade, list_has_any(severities, ['high', 'critical']) AS severity FROM f)
"""


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(k.cast("string").alias("source"), F.when(k % 17 == 0, "error").otherwise("ok").alias("status"))


def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, supp = F.col("l_partkey") % 3, F.col("l_suppkey") % 7
    return table(spark, sf_dir, "lineitem").where("l_quantity > 30").select(
        F.col("l_orderkey").cast("string").alias("source"), F.col("l_linenumber").cast("int").alias("page"), F.when(part == 0, "term").when(part == 1, "marking").otherwise("mention").alias("kind"), (F.col("l_suppkey") % 5).cast("int").alias("level"),
        F.when(supp == 0, "TLP:CLEAR").when(supp == 1, "TLP:RED").otherwise(F.concat("l_returnflag", "l_linestatus")).alias("label"), F.when(supp < 2, "tlp").when(supp == 2, "company").otherwise("de").alias("scheme"),
        F.when(part == 0, F.get(F.array(*map(F.lit, ("info", "low", "medium", "high", "critical"))), (F.col("l_partkey") % 5).cast("int"))).alias("severity"), F.col("l_quantity").alias("x0"), F.col("l_tax").alias("y0"),
    )


@query(f"WITH {ROWS} SELECT source, status, page, kind, level, label, scheme, severity, x0, y0 FROM files LEFT JOIN found USING (source)")
def report_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each finding, and one for each clean file."""
    return reports.report_rows(files(spark, sf_dir), findings(spark, sf_dir)).select("source", "status", "page", "kind", "level", "label", "scheme", "severity", "x0", "y0")


@query(f"WITH {ROWS} SELECT source, any_, false AS none_, grade, severity FROM g")
def gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four gates for each file."""
    rows = reports.of_files(files(spark, sf_dir), findings(spark, sf_dir))
    return rows.select("source", reports.trips("any").alias("any_"), reports.trips("none").alias("none_"), reports.trips("grade", 3).alias("grade"), reports.trips("severity", "high").alias("severity"))


@query(f"WITH {ROWS} SELECT count(*) AS files, count_if(status = 'ok' AND marked) AS marked, count_if(status = 'ok' AND n_hits > 0) AS with_hits, count_if(status <> 'ok') AS unreadable, count_if(status = 'ok' AND NOT any_) AS clean, count_if(status = 'ok' AND any_) AS tripped FROM g")
def report_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.summary(reports.of_files(files(spark, sf_dir), findings(spark, sf_dir)), reports.trips("any"))


@query(f"WITH {ROWS} SELECT label, count(DISTINCT source) AS files, count(*) AS n FROM found WHERE kind = 'marking' GROUP BY label")
def report_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.tally(findings(spark, sf_dir))


@query(f"WITH {ROWS} SELECT CAST(CASE WHEN count_if(status = 'ok' AND grade) > 0 THEN 3 WHEN count_if(status <> 'ok') > 0 THEN 1 ELSE 0 END AS INT) AS status FROM g")
def exit_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.exit_status(reports.of_files(files(spark, sf_dir), findings(spark, sf_dir)), reports.trips("grade", 3))


@query(f"WITH {ROWS}, n AS (SELECT source, count(*) AS n FROM found GROUP BY source) SELECT source, status, coalesce(n, 0) AS n FROM files LEFT JOIN n USING (source)")
def report_json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports as JSON Lines, read again: the number of findings of each file."""
    made = reports.as_json_lines(files(spark, sf_dir), findings(spark, sf_dir))
    kind = "struct<source:string,status:string,findings:array<struct<page:int,kind:string,label:string>>>"
    return made.select(F.from_json("line", kind).alias("r")).select("r.source", "r.status", F.coalesce(F.size("r.findings"), F.lit(0)).cast("bigint").alias("n"))


@query(
    """
    WITH r AS (SELECT o_orderpriority AS category, o_orderkey % 9 <> 0 AS ok, o_orderkey % 4 + 1 AS pages, o_totalprice / 100 AS ms, (o_orderkey % 100) / 100 AS cer, (o_orderkey % 50) / 50 AS wer, 1 - (o_orderkey % 20) / 20 AS word_recall, (o_orderkey % 30) / 30 AS confidence FROM orders)
    SELECT category, count(*) AS files, count_if(ok) AS n_ok, CAST(sum(CASE WHEN ok THEN pages END) AS BIGINT) AS pages, round(sum(CASE WHEN ok THEN ms END) / sum(CASE WHEN ok THEN pages END), 6) AS ms_page, round(avg(CASE WHEN ok THEN cer END), 6) AS mean_cer,
           round(median(CASE WHEN ok THEN cer END), 6) AS median_cer, round(avg(CASE WHEN ok THEN wer END), 6) AS mean_wer, round(avg(CASE WHEN ok THEN word_recall END), 6) AS mean_recall, round(avg(CASE WHEN ok THEN confidence END), 6) AS mean_confidence FROM r GROUP BY category
    """
)
def metrics_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        F.col("o_orderpriority").alias("category"), (k % 9 != 0).alias("ok"), (k % 4 + 1).alias("pages"), (F.col("o_totalprice") / 100).alias("ms"), (k % 100 / 100).alias("cer"), (k % 50 / 50).alias("wer"), (1 - k % 20 / 20).alias("word_recall"), (k % 30 / 30).alias("confidence")
    )
    made = metrics.by_category(rows, "category")
    return made.select("category", "files", "n_ok", "pages", *(F.round(c, 6).alias(c) for c in made.columns[4:]))


@query(
    """
    WITH e AS (SELECT p_partkey // 20 AS page, p_partkey AS id, p_partkey % 5 * 100.0 AS x0, p_partkey % 4 * 50.0 AS y0 FROM part WHERE p_partkey % 2 = 0),
    f AS (SELECT p_partkey // 20 AS page, p_partkey AS id, p_partkey % 5 * 100.0 + p_size AS x0, p_partkey % 4 * 50.0 AS y0 FROM part WHERE p_partkey % 3 = 0),
    c AS (SELECT coalesce(a.page, b.page) AS page, coalesce(a.n, 0) AS n_e, coalesce(b.n, 0) AS n_f FROM (SELECT page, count(*) AS n FROM e GROUP BY page) a FULL JOIN (SELECT page, count(*) AS n FROM f GROUP BY page) b USING (page))
    SELECT page, n_e, n_f FROM c
    """
)
def evaluation_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected and found boxes of pages, assigned to one another: every box is a hit, a miss or too much."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    at = lambda x: (F.floor(k / 20).cast("bigint").alias("page"), k.alias("id"), x.alias("x0"), (k % 4 * 50.0).alias("y0"), (x + 60).alias("x1"), (k % 4 * 50.0 + 30).alias("y1"))
    expected, found = p.where("p_partkey % 2 = 0").select(*at(k % 5 * 100.0)), p.where("p_partkey % 3 = 0").select(*at(k % 5 * 100.0 + F.col("p_size")))
    judged = metrics.judged_terms(expected, found, ["page"])
    return judged.select("page", (F.col("tp") + F.col("fn")).alias("n_e"), (F.col("tp") + F.col("fp")).alias("n_f"))
