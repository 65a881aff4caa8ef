"""Queries of the note store and of reports: what to do with each file, what to keep, what to leave out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.operators.store import actions, latest, prunable, resumed
from sparkfolio.registry import query, table

MANIFEST = "m AS (SELECT c_custkey::VARCHAR AS key, c_nationkey AS size, c_custkey % 50 AS mtime, c_mktsegment AS sha, c_custkey % 11 = 0 AS edited FROM customer WHERE c_custkey % 3 <> 0)"
LISTING = "l AS (SELECT c_custkey::VARCHAR AS key, c_nationkey + CASE WHEN c_custkey % 7 = 0 THEN 1 ELSE 0 END AS size, c_custkey % 50 + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS mtime, CASE WHEN c_custkey % 7 = 0 THEN 'new' ELSE c_mktsegment END AS sha FROM customer WHERE c_custkey % 4 <> 0)"


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A manifest as an earlier run left it: two thirds of the customers as files."""
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 3 != 0).select(k.cast("string").alias("key"), F.col("c_nationkey").alias("size"), (k % 50).alias("mtime"), F.col("c_mktsegment").alias("sha"), (k % 11 == 0).alias("edited"))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").where(k % 4 != 0).select(
        k.cast("string").alias("key"), (F.col("c_nationkey") + (k % 7 == 0).cast("int")).alias("size"), (k % 50 + (k % 5 == 0).cast("int")).alias("mtime"), F.when(k % 7 == 0, "new").otherwise(F.col("c_mktsegment")).alias("sha")
    )


@query(
    f"""
    WITH {MANIFEST}, {LISTING}
    SELECT coalesce(l.key, m.key) AS key, CASE WHEN m.key IS NULL THEN 'write' WHEN l.key IS NULL THEN CASE WHEN m.edited THEN 'keep' ELSE 'prune' END
           WHEN l.size = m.size AND l.mtime = m.mtime THEN 'unchanged' WHEN l.sha = m.sha THEN 'touch' WHEN m.edited THEN 'keep' ELSE 'write' END AS action
    FROM l FULL JOIN m ON l.key = m.key
    """
)
def manifest_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return actions(listing(spark, sf_dir), manifest(spark, sf_dir)).select("key", "action")


@query(f"WITH {MANIFEST}, {LISTING} SELECT key FROM m WHERE NOT edited AND key NOT IN (SELECT key FROM l)")
def prune_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prunable(manifest(spark, sf_dir), listing(spark, sf_dir)).select("key")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber >= 4)")
def resume_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inputs that a report doesn't have yet."""
    done = table(spark, sf_dir, "lineitem").where("l_linenumber >= 4").select(F.col("l_orderkey").alias("o_orderkey"))
    return resumed(table(spark, sf_dir, "orders").select("o_orderkey"), done, "o_orderkey")


@query("SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def journal_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last entry of each key in a journal."""
    return latest(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("SELECT regexp_extract(url, '://[^/]*/([a-z]+)', 1) AS folder, count(*) AS n, count(*) - count(DISTINCT url) AS n_repeated FROM pages GROUP BY 1")
def source_census(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources by folder, and how many are named twice."""
    p = table(spark, sf_dir, "pages").select("url", F.regexp_extract("url", "://[^/]*/([a-z]+)", 1).alias("folder"))
    return p.groupBy("folder").agg(F.count("*").alias("n"), (F.count("*") - F.countDistinct("url")).alias("n_repeated"))
