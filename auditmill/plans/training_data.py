"""Queries of the general training-data operators, and SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.operators.hierarchy import descendants, paths, trees
from auditmill.operators.packed import FieldRule, learn_dialects, split_values
from auditmill.operators.skew import balanced_count, balanced_join
from auditmill.operators.snapshots import snapshot_changes
from auditmill.session import cut, table

PACKED_RULES = {"x_robots_tag": FieldRule(blank_separates=True), "meta_robots": FieldRule(blank_separates=True), "availability": FieldRule()}
LARGE_SHARE = 0.02


def packed_fields(spark: SparkSession, d: str) -> DataFrame:
    def field(name: str, of: str, key: str) -> DataFrame:
        return table(spark, d, of).select(F.lit(name).alias("field_name"), F.col(key).alias("url_id"), F.col(name).alias("raw"))

    return field("x_robots_tag", "urls", "id").unionByName(field("meta_robots", "page_records", "url_id")).unionByName(field("availability", "products", "url_id"))


def link_sides(spark: SparkSession, d: str) -> DataFrame:
    """Both ends of every link, one row each."""
    ends = F.array(F.struct(F.lit("source").alias("side"), F.col("source_id").alias("url_id")), F.struct(F.lit("target").alias("side"), F.col("target_id").alias("url_id")))
    return table(spark, d, "links").select(F.inline(ends))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return snapshot_changes(table(spark, d, "url_snapshots"), table(spark, d, "crawls"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return split_values(packed_fields(spark, d), PACKED_RULES, least=2)


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    """Every value of every field, single ones included."""
    return split_values(packed_fields(spark, d), PACKED_RULES)


def p4_dialects(spark: SparkSession, d: str) -> DataFrame:
    """How many distinct fields each dialect was chosen for."""
    return learn_dialects(packed_fields(spark, d), PACKED_RULES).groupBy("field_name", "dialect").agg(F.count(F.lit(1)).alias("fields"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return trees(table(spark, d, "urls").select("id", "redirect_to_id"))


def p5_paths(spark: SparkSession, d: str) -> DataFrame:
    p = paths(table(spark, d, "urls").select("id", "redirect_to_id"))
    return p.select("id", "root_id", "depth", "is_cycle", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


def p5_descendants(spark: SparkSession, d: str) -> DataFrame:
    return descendants(table(spark, d, "urls").select("id", "redirect_to_id"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    counts = balanced_count(link_sides(spark, d), ["side", "url_id"])
    rows = table(spark, d, "links").count()
    return counts.filter(F.col("url_id").isNotNull() & (F.col("n") >= LARGE_SHARE * rows)).select("side", "url_id")


def p7_counts(spark: SparkSession, d: str) -> DataFrame:
    """Links per source and per target."""
    return balanced_count(link_sides(spark, d), ["side", "url_id"], name="links")


def p7_target_profile(spark: SparkSession, d: str) -> DataFrame:
    """Per target its host and how many links it gets, from its own host and from others."""
    links = table(spark, d, "links").select("source_id", "target_id")
    hosts = table(spark, d, "urls").select("id", "host").unionByName(table(spark, d, "hub_urls").select("id", "host"))
    at_target = cut(balanced_join(links, hosts.select(F.col("id").alias("target_id"), F.col("host").alias("target_host")), ["target_id"]))
    both = balanced_join(at_target, hosts.select(F.col("id").alias("source_id"), F.col("host").alias("source_host")), ["source_id"], "left")
    return both.groupBy("target_id", "target_host").agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col("source_host") == F.col("target_host")).alias("own_host_links"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_values, p4_dialects, p5_found, p5_paths, p5_descendants, p7_found, p7_counts, p7_target_profile)}

ORACLES = {
    "p2_found": """
        WITH c AS (SELECT crawl_id, host, lag(crawl_id) OVER w AS prev_id, lead(crawl_id) OVER w AS next_id
                   FROM crawls WHERE status = 'done' WINDOW w AS (PARTITION BY host ORDER BY started_at, crawl_id)),
        s AS (SELECT u.crawl_id, u.url, u.status_code, u.indexability, c.prev_id, c.next_id
              FROM url_snapshots u JOIN c USING (crawl_id)
              QUALIFY row_number() OVER (PARTITION BY u.crawl_id, u.url ORDER BY u.crawled_at DESC NULLS LAST, u.received_at DESC NULLS LAST) = 1)
        SELECT a.crawl_id AS from_crawl_id, a.next_id AS to_crawl_id, a.url,
               CASE WHEN b.crawl_id IS NULL THEN 'removed' ELSE 'changed' END AS change_kind
        FROM s a LEFT JOIN s b ON b.crawl_id = a.next_id AND b.url IS NOT DISTINCT FROM a.url
        WHERE a.next_id IS NOT NULL AND (b.crawl_id IS NULL OR a.status_code IS DISTINCT FROM b.status_code OR a.indexability IS DISTINCT FROM b.indexability)
        UNION ALL
        SELECT a.prev_id, a.crawl_id, a.url, 'added' FROM s a LEFT JOIN s b ON b.crawl_id = a.prev_id AND b.url IS NOT DISTINCT FROM a.url
        WHERE a.prev_id IS NOT NULL AND b.crawl_id IS NULL""",
    "p5_found": """
        WITH RECURSIVE e AS (SELECT id, min(redirect_to_id) AS nxt FROM urls WHERE redirect_to_id IS NOT NULL GROUP BY id),
        w AS (SELECT id, nxt AS cur, 1 AS hops, [id] AS seen FROM e
              UNION ALL
              SELECT w.id, e.nxt, w.hops + 1, list_append(w.seen, w.cur) FROM w JOIN e ON e.id = w.cur WHERE NOT list_contains(w.seen, w.cur)),
        z AS (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1)
        SELECT id, CASE WHEN list_contains(seen, cur) THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_id,
               CAST(CASE WHEN list_contains(seen, cur) THEN list_position(seen, cur) - 1 ELSE hops END AS INT) AS depth,
               CAST(list_contains(seen, cur) AS INT) AS is_cycle FROM z""",
    "p5_paths": """
        WITH RECURSIVE e AS (SELECT id, min(redirect_to_id) AS nxt FROM urls WHERE redirect_to_id IS NOT NULL GROUP BY id),
        w AS (SELECT id, nxt AS cur, 1 AS hops, [id] AS seen FROM e
              UNION ALL
              SELECT w.id, e.nxt, w.hops + 1, list_append(w.seen, w.cur) FROM w JOIN e ON e.id = w.cur WHERE NOT list_contains(w.seen, w.cur)),
        z AS (SELECT *, list_contains(seen, cur) AS ring FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1)
        SELECT id, CASE WHEN ring THEN list_min(seen[list_position(seen, cur):]) ELSE cur END AS root_id,
               CAST(CASE WHEN ring THEN list_position(seen, cur) - 1 ELSE hops END AS INT) AS depth, CAST(ring AS INT) AS is_cycle,
               array_to_string(CASE WHEN ring THEN seen[:list_position(seen, cur)] ELSE list_append(seen, cur) END, '>') AS path FROM z""",
    "p5_descendants": """
        WITH RECURSIVE e AS (SELECT id, min(redirect_to_id) AS nxt FROM urls WHERE redirect_to_id IS NOT NULL GROUP BY id),
        w AS (SELECT id, nxt AS cur, 1 AS hops, [id] AS seen FROM e
              UNION ALL
              SELECT w.id, e.nxt, w.hops + 1, list_append(w.seen, w.cur) FROM w JOIN e ON e.id = w.cur WHERE NOT list_contains(w.seen, w.cur)),
        z AS (SELECT *, list_contains(seen, cur) AS ring FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1),
        p AS (SELECT id, CASE WHEN ring THEN seen[:list_position(seen, cur)] ELSE list_append(seen, cur) END AS path FROM z)
        SELECT path[i + 1] AS ancestor_id, id, CAST(i AS INT) AS hops FROM (SELECT id, path, unnest(range(1, len(path))) AS i FROM p)""",
    "p7_found": """
        WITH s AS (SELECT 'source' AS side, source_id AS url_id FROM links UNION ALL SELECT 'target', target_id FROM links)
        SELECT side, url_id FROM s WHERE url_id IS NOT NULL GROUP BY ALL HAVING count(*) >= 0.02 * (SELECT count(*) FROM links)""",
    "p7_counts": """
        SELECT side, url_id, count(*) AS links FROM (SELECT 'source' AS side, source_id AS url_id FROM links UNION ALL SELECT 'target', target_id FROM links) GROUP BY ALL""",
    "p7_target_profile": """
        WITH h AS (SELECT id, host FROM urls UNION ALL SELECT id, host FROM hub_urls)
        SELECT l.target_id, t.host AS target_host, count(*) AS links, count(*) FILTER (WHERE s.host = t.host) AS own_host_links
        FROM links l JOIN h t ON t.id = l.target_id LEFT JOIN h s ON s.id = l.source_id GROUP BY ALL""",
}
