"""Queries of graph, near-duplicate and streaming operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.operators.graph import components, crawl_depth
from auditmill.operators.near_duplicates import classes, pairs, simhash_classes, simhash_pairs
from auditmill.session import cut, shared_dir, table
from auditmill.streaming import responses

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")


def _linked(members: DataFrame, near: DataFrame) -> DataFrame:
    links = near.select(F.col("a").alias("class_id")).unionByName(near.select(F.col("b").alias("class_id"))).groupBy("class_id").agg(F.count(F.lit(1)).alias("links"))
    return members.select("id", "class_id").join(links, "class_id", "left").withColumn("links", F.coalesce("links", F.lit(0)))


@query()
def jn18_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """One row per document: its class of equal texts and how many other classes are near it."""
    texts = _texts(spark, d)
    members = cut(classes(texts))
    return _linked(members, cut(pairs(texts, members)))


@query()
def jn18_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Near pairs between classes."""
    texts = _texts(spark, d)
    return pairs(texts, cut(classes(texts)))


@query()
def jn18_simhash(spark: SparkSession, d: str) -> DataFrame:
    """The reference's variant: one row per text of 50 words or more, near by SimHash."""
    members = cut(simhash_classes(_texts(spark, d)))
    return _linked(members, simhash_pairs(members))


@query()
def gr2_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Clusters of near texts."""
    return components(jn18_pairs(spark, d).select("a", "b"))


@query("""
    WITH RECURSIVE e AS (SELECT id AS a, redirect_to_id AS b FROM urls WHERE redirect_to_id IS NOT NULL AND redirect_to_id <> id),
    u AS (SELECT a, b FROM e UNION SELECT b, a FROM e),
    w AS (SELECT DISTINCT a AS id, a AS root FROM u UNION SELECT u.b, w.root FROM w JOIN u ON u.a = w.id)
    SELECT id, min(root) AS component FROM w GROUP BY id""")
def gr2_redirect_components(spark: SparkSession, d: str) -> DataFrame:
    """URLs that redirects connect, whatever their direction."""
    return components(table(spark, d, "urls").filter("redirect_to_id IS NOT NULL").select(F.col("id").alias("a"), F.col("redirect_to_id").alias("b")))


@query("""
    WITH RECURSIVE e AS (SELECT DISTINCT source_id, target_id FROM links WHERE type = 0),
    w(id, depth) USING KEY (id) AS (SELECT id, 0 AS depth FROM hub_urls UNION
        SELECT e.target_id, min(w.depth) + 1 FROM w JOIN e ON e.source_id = w.id WHERE NOT EXISTS (SELECT 1 FROM recurring.w AS r WHERE r.id = e.target_id) GROUP BY e.target_id)
    SELECT id, depth FROM w""")
def gr3_crawl_depth(spark: SparkSession, d: str) -> DataFrame:
    """Clicks from the shared template pages, breadth first."""
    edges = table(spark, d, "links").filter("type = 0").select("source_id", "target_id")
    return crawl_depth(edges, table(spark, d, "hub_urls").select("id"))


def _checkpoint(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/auditmill/stream-{uuid.uuid4().hex}"


@query("SELECT time_bucket(INTERVAL 5 MINUTE, ts) AS window_start, time_bucket(INTERVAL 5 MINUTE, ts) + INTERVAL 5 MINUTE AS window_end, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, round(avg(value), 6) AS mean_value FROM events GROUP BY ALL")
def stream_windows(spark: SparkSession, d: str) -> DataFrame:
    """Tumbling windows over the event files read as a stream."""
    agg = responses.windowed(responses.events(spark, d))
    out = responses.drained(agg, f"w{uuid.uuid4().hex}", "complete", _checkpoint(spark))
    ntz = {c: F.col(c).cast("timestamp_ntz") for c in ("window_start", "window_end")}
    return out.withColumns(ntz).withColumn("mean_value", F.round("mean_value", 6))


@query()
def stream_control(spark: SparkSession, d: str) -> DataFrame:
    """Concurrency limits kept as state per kind of event."""
    return responses.drained(responses.controlled(responses.events(spark, d)), f"c{uuid.uuid4().hex}", "append", _checkpoint(spark))
