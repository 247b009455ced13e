"""Queries of the audit operators over the tables of a crawl, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditmill.audit import cross_rules, row_rules, visibility
from auditmill.audit.catalogue import CATALOGUE, frame
from auditmill.functions import measures, text, urls as U
from auditmill.operators import compare, tables
from auditmill.operators.hierarchy import trees
from auditmill.session import cut, table

QUERIES: dict = {}
ORACLES: dict = {}
PIXELS = ("title_over_561_pixels", "meta_description_over_985_pixels")
DIRECTIVES = ("directives_noindex", "directives_nofollow", "canonical_canonicalised")


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "urls")


def facts(spark: SparkSession, d: str) -> DataFrame:
    """One row per URL with the fields of its page."""
    pages = table(spark, d, "page_records").withColumn("parsed", F.lit(True))
    u = urls(spark, d).withColumns({"failed": F.col("error").isNotNull(), "site_is_https": F.lit(True)})
    return u.join(pages.withColumnRenamed("url_id", "id"), "id", "left").withColumn("parsed", F.coalesce("parsed", F.lit(False)))


PAGE_SQL = "SELECT u.*, p.url_id IS NOT NULL AS parsed, p.title, p.title_count, p.meta_description, p.h1, p.h1_count, p.meta_robots, p.word_count FROM urls u LEFT JOIN page_records p ON p.url_id = u.id"
PATH_SQL = r"CASE WHEN regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1) END"
LATER_SQL = r"""(coalesce(try_cast(nullif(regexp_extract(url, '^[^?#]*\?(?:[^#]*&)?(?:[pP][aA][gG][eE]|[pP][aA][gG][eE][dD])=([0-9]{1,9})(?:&|#|$)', 1), '') AS INT), 1) >= 2
                 OR coalesce(try_cast(nullif(regexp_extract(url, '^[^?#]*/[pP][aA][gG][eE]/([0-9]{1,9})/?(?:[?#]|$)', 1), '') AS INT), 1) >= 2)"""
INDEXABLE_SQL = "is_internal AND state = 1 AND resource_type = 0 AND indexability = 1"

_ROW_SQL = {
    "response_internal_blocked_robots": "is_internal AND blocked_by_robots",
    "response_internal_no_response": "is_internal AND error IS NOT NULL AND NOT coalesce(blocked_by_robots, false)",
    **{f"response_internal_{n}xx": f"is_internal AND NOT coalesce(blocked_by_robots, false) AND error IS NULL AND status_code BETWEEN {n}00 AND {n}99" for n in (3, 4, 5)},
    "response_external_broken": "NOT is_internal AND (error IS NOT NULL OR status_code >= 400) AND NOT coalesce(status_code IN (401, 402, 403, 406, 407, 429, 999), false)",
    "response_external_unverified": "NOT is_internal AND status_code IN (401, 402, 403, 406, 407, 429, 999)",
    "response_slow": "pg AND response_ms > 1000",
    "links_high_crawl_depth": "pg AND depth >= 4",
    "url_uppercase": rf"is_internal AND resource_type = 0 AND status_code BETWEEN 200 AND 299 AND regexp_matches({PATH_SQL}, '\p{{Lu}}')",
    "url_underscores": f"is_internal AND resource_type = 0 AND status_code BETWEEN 200 AND 299 AND contains({PATH_SQL}, '_')",
    "url_over_115_characters": "is_internal AND resource_type = 0 AND status_code BETWEEN 200 AND 299 AND length(url) > 115",
    "url_http_on_https_site": "is_internal AND resource_type = 0 AND status_code BETWEEN 200 AND 299 AND lower(url) LIKE 'http://%'",
    "title_missing": "pg AND coalesce(title, '') = ''",
    "title_multiple": "pg AND coalesce(title, '') <> '' AND title_count > 1",
    "title_over_60_characters": "pg AND length(title) > 60",
    "title_below_30_characters": "pg AND coalesce(title, '') <> '' AND length(title) < 30",
    "title_same_as_h1": "pg AND coalesce(title, '') <> '' AND lower(title) = lower(h1)",
    "meta_description_missing": "pg AND coalesce(meta_description, '') = ''",
    "meta_description_over_155_characters": "pg AND length(meta_description) > 155",
    "meta_description_below_70_characters": "pg AND coalesce(meta_description, '') <> '' AND length(meta_description) < 70",
    "h1_missing": "pg AND coalesce(h1, '') = ''",
    "h1_multiple": "pg AND coalesce(h1, '') <> '' AND h1_count > 1",
    "h1_over_70_characters": "pg AND length(h1) > 70",
    "content_low_word_count": "pg AND indexability = 1 AND word_count < 200",
    "images_over_100kb": "is_internal AND status_code BETWEEN 200 AND 299 AND resource_type = 1 AND size_bytes > 102400",
}
ROW_RULES_SQL = f"WITH f AS (SELECT *, is_internal AND status_code BETWEEN 200 AND 299 AND parsed AS pg FROM ({PAGE_SQL})) " + " UNION ALL ".join(
    f"SELECT '{code}' AS code, id AS url_id FROM f WHERE {cond}" for code, cond in _ROW_SQL.items()
)


@query(ROW_RULES_SQL)
def rules_row(spark: SparkSession, d: str) -> DataFrame:
    return row_rules.audit(facts(spark, d), skip=PIXELS + DIRECTIVES)


@query()
def rules_row_pixels_and_directives(spark: SparkSession, d: str) -> DataFrame:
    f = row_rules.audit(facts(spark, d))
    return f.filter(F.col("code").isin(*PIXELS, *DIRECTIVES))


DUPLICATES_SQL = f"""
    WITH c AS (SELECT * FROM ({PAGE_SQL}) WHERE {INDEXABLE_SQL} AND NOT {LATER_SQL}),
    d AS (SELECT * FROM (SELECT 'title_duplicate' AS code, id AS url_id, title AS v FROM c UNION ALL SELECT 'meta_description_duplicate', id, meta_description FROM c UNION ALL SELECT 'h1_duplicate', id, h1 FROM c) WHERE v <> '')
    SELECT code, url_id FROM d QUALIFY count(*) OVER (PARTITION BY code, v) > 1"""


@query(DUPLICATES_SQL)
def rules_duplicates(spark: SparkSession, d: str) -> DataFrame:
    pages = facts(spark, d).filter(cross_rules.duplicate_candidates())
    return cross_rules.duplicates(pages, {"title": "title_duplicate", "meta_description": "meta_description_duplicate", "h1": "h1_duplicate"})


BROKEN_SQL = "(coalesce(status_code >= 400, false) OR (status_code IS NULL AND NOT coalesce(blocked_by_robots, false)))"
REFUSED_SQL = "coalesce(status_code IN (401, 402, 403, 406, 407, 429, 999), false)"
DESIGN_SQL = " OR ".join(f"url ILIKE '%{p}%' OR coalesce(redirect_url, '') ILIKE '%{p}%'" for p in U.BY_DESIGN)


@query(f"""
    WITH t AS (SELECT id, is_internal, {BROKEN_SQL} AS broken, {REFUSED_SQL} AS refused, coalesce(status_code BETWEEN 300 AND 399, false) AS moved, ({DESIGN_SQL}) AS design FROM urls WHERE state = 1),
    k AS (SELECT id, 'links_to_broken_internal' AS code FROM t WHERE is_internal AND broken UNION ALL SELECT id, 'links_to_redirect_internal' FROM t WHERE is_internal AND moved AND NOT design
          UNION ALL SELECT id, 'links_to_broken_external' FROM t WHERE NOT is_internal AND broken AND NOT refused UNION ALL SELECT id, 'links_to_unverified_external' FROM t WHERE NOT is_internal AND refused)
    SELECT DISTINCT k.code, l.source_id AS url_id FROM links l JOIN k ON k.id = l.target_id WHERE l.type = 0""")
def rules_link_targets(spark: SparkSession, d: str) -> DataFrame:
    return cross_rules.link_targets(table(spark, d, "links"), urls(spark, d))


@query("SELECT target_id AS id, count(*) AS inlinks, count(DISTINCT source_id) AS unique_inlinks FROM links WHERE type NOT IN (4, 5) GROUP BY target_id")
def ag3_inlinks(spark: SparkSession, d: str) -> DataFrame:
    return cross_rules.inlink_counts(table(spark, d, "links"))


CHAIN_SQL = """
    WITH RECURSIVE e AS (SELECT id, min(redirect_to_id) AS nxt FROM urls WHERE redirect_to_id IS NOT NULL GROUP BY id),
    w AS (SELECT id, nxt AS cur, 1 AS hops, [id] AS seen FROM e UNION ALL
          SELECT w.id, e.nxt, w.hops + 1, list_append(w.seen, w.cur) FROM w JOIN e ON e.id = w.cur WHERE NOT list_contains(w.seen, w.cur)),
    z AS (SELECT *, list_contains(seen, cur) AS ring FROM w QUALIFY row_number() OVER (PARTITION BY id ORDER BY hops DESC) = 1)"""


@query(CHAIN_SQL + " SELECT CASE WHEN ring THEN 'redirect_loop' ELSE 'redirect_chain' END AS code, id AS url_id FROM z WHERE ring OR hops >= 2")
def rules_redirects(spark: SparkSession, d: str) -> DataFrame:
    return cross_rules.redirect_issues(trees(urls(spark, d).select("id", "redirect_to_id")))


CHAIN_ENDS_SQL = CHAIN_SQL + """
    SELECT z.id, CASE WHEN NOT ring THEN z.hops END AS hops, CASE WHEN NOT ring THEN f.url END AS final_url, CASE WHEN NOT ring THEN f.status_code END AS final_status, s.url AS start_url
    FROM z JOIN urls s ON s.id = z.id LEFT JOIN urls f ON f.id = z.cur WHERE ring OR z.hops >= 2"""


@query(CHAIN_ENDS_SQL)
def jn9_redirect_chains(spark: SparkSession, d: str) -> DataFrame:
    """Chains with where they start and end; loops end nowhere."""
    u = urls(spark, d).select("id", "url", "status_code", "redirect_to_id")
    chains = trees(u.select("id", "redirect_to_id")).filter("is_cycle = 1 OR depth >= 2")
    final = u.select(F.col("id").alias("root_id"), F.col("url").alias("f_url"), F.col("status_code").alias("f_status"))
    straight = F.col("is_cycle") == 0
    return (
        chains.join(u.select("id", F.col("url").alias("start_url")), "id")
        .join(final, "root_id", "left")
        .select("id", F.when(straight, F.col("depth")).alias("hops"), F.when(straight, F.col("f_url")).alias("final_url"), F.when(straight, F.col("f_status")).alias("final_status"), "start_url")
    )


@query("""
    WITH t AS (SELECT id AS cid, status_code AS s, indexability AS i FROM urls WHERE state = 1)
    SELECT DISTINCT CASE WHEN coalesce(s BETWEEN 200 AND 299, false) THEN 'canonical_target_non_indexable' ELSE 'canonical_target_non_200' END AS code, u.id AS url_id
    FROM urls u JOIN t ON t.cid = u.redirect_to_id WHERE u.redirect_to_id <> u.id AND (NOT coalesce(s BETWEEN 200 AND 299, false) OR i = 2)""")
def rules_canonical_targets(spark: SparkSession, d: str) -> DataFrame:
    """Run over redirect targets, as the tables hold no canonicals."""
    u = urls(spark, d)
    return cross_rules.canonical_targets(u, u.select("id", F.col("redirect_to_id").alias("canonical_id")))


@query("""
    WITH h AS (SELECT source_id, target_id FROM links WHERE type = 5)
    SELECT DISTINCT 'hreflang_non_200_target' AS code, h.source_id AS url_id FROM h JOIN urls t ON t.id = h.target_id WHERE t.state = 1 AND NOT coalesce(t.status_code BETWEEN 200 AND 299, false)
    UNION ALL
    SELECT DISTINCT 'hreflang_missing_return_links', source_id FROM h WHERE source_id <> target_id AND NOT EXISTS (SELECT 1 FROM h r WHERE r.source_id = h.target_id AND r.target_id = h.source_id)""")
def rules_hreflang_targets(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "links").filter("type = 5").select("source_id", "target_id")
    return cross_rules.hreflang_targets(edges, urls(spark, d))


@query(f"""
    WITH u AS (SELECT * FROM urls WHERE is_internal AND state = 1), i AS (SELECT target_id, count(*) AS n FROM links WHERE type NOT IN (4, 5) GROUP BY 1)
    SELECT 'sitemap_non_200' AS code, id AS url_id FROM u WHERE found_via = 1 AND NOT coalesce(status_code BETWEEN 200 AND 299, false)
    UNION ALL SELECT 'sitemap_non_indexable', id FROM u WHERE found_via = 1 AND status_code BETWEEN 200 AND 299 AND indexability = 2
    UNION ALL SELECT 'sitemap_orphan', id FROM u LEFT JOIN i ON i.target_id = u.id WHERE found_via = 1 AND status_code BETWEEN 200 AND 299 AND coalesce(n, 0) = 0
    UNION ALL SELECT 'sitemap_missing', id FROM u WHERE {INDEXABLE_SQL} AND coalesce(found_via <> 1, true)""")
def rules_sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """URLs found in a sitemap are those with found_via 1."""
    u = urls(spark, d)
    return cross_rules.sitemap_audit(u, u.filter("found_via = 1").select("id"), cross_rules.inlink_counts(table(spark, d, "links")))


@query(f"""
    SELECT DISTINCT 'ecom_product_duplicate_path' AS code, id AS url_id FROM urls WHERE {INDEXABLE_SQL} AND status_code = 200 AND regexp_matches({PATH_SQL}, '(?i)/collections/.*/products/')
    UNION ALL SELECT DISTINCT 'ecom_links_to_duplicate_product', l.source_id FROM links l JOIN urls ON urls.id = l.target_id WHERE l.type = 0 AND is_internal AND regexp_matches({PATH_SQL}, '(?i)/collections/.*/products/')""")
def rules_product_paths(spark: SparkSession, d: str) -> DataFrame:
    return cross_rules.product_paths(urls(spark, d), table(spark, d, "links"))


@query()
def rules_product_reach(spark: SparkSession, d: str) -> DataFrame:
    return cross_rules.product_reach(urls(spark, d), table(spark, d, "links"))


@query("""
    WITH m AS (SELECT id AS url_id, 100 - ttfb_ms / 20 AS ms, 100 - response_ms / 20 AS ds, response_ms * 4 AS ml, ttfb_ms * 4 AS dl FROM urls WHERE is_internal AND isfinite(ttfb_ms) AND isfinite(response_ms))
    SELECT 'lh_low_score' AS code, url_id FROM m WHERE ms < 50 OR ds < 50
    UNION ALL SELECT 'lh_needs_improvement', url_id FROM m WHERE (ms < 90 OR ds < 90) AND NOT (ms < 50 OR ds < 50)
    UNION ALL SELECT 'lh_poor_lcp', url_id FROM m WHERE ml > 4000 OR dl > 4000""")
def rules_speed(spark: SparkSession, d: str) -> DataFrame:
    """Run over scores derived from the timings, as the tables hold no speed reports."""
    ok = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    u = urls(spark, d).filter(F.col("is_internal") & ok("ttfb_ms") & ok("response_ms"))
    none = F.lit(None).cast("double")
    m = u.select(F.col("id").alias("url_id"), (100 - F.col("ttfb_ms") / 20).alias("m_score"), (100 - F.col("response_ms") / 20).alias("d_score"), (F.col("response_ms") * 4).alias("m_lcp_ms"), (F.col("ttfb_ms") * 4).alias("d_lcp_ms"), none.alias("m_cls"), none.alias("d_cls"), none.alias("m_tbt_ms"), none.alias("d_tbt_ms"))
    return cross_rules.speed(m)


def some_issues(spark: SparkSession, d: str) -> DataFrame:
    return rules_row(spark, d).unionByName(rules_duplicates(spark, d))


IGNORED = [("title_below_30_characters", ""), ("h1_missing", "")]
SHOWN_SQL = ", ".join(f"'{c}'" for c in visibility.SHOWN)
LATER_SHOWN_SQL = ", ".join(f"'{c}'" for c in visibility.SHOWN_LATER)
PLACES_SQL = f"""
    SELECT code, url_id, CASE WHEN code IN ('title_below_30_characters', 'h1_missing') THEN 'ignored'
        WHEN is_internal AND state = 1 AND resource_type = 0 AND CASE WHEN indexability = 2 THEN code NOT IN ({SHOWN_SQL}) ELSE {LATER_SQL} AND code NOT IN ({LATER_SHOWN_SQL}) END THEN 'set_aside' ELSE 'listed' END AS place
    FROM (SELECT * FROM ({ROW_RULES_SQL}) UNION ALL SELECT * FROM ({DUPLICATES_SQL})) i JOIN urls ON urls.id = i.url_id"""


@query(PLACES_SQL)
def set3_places(spark: SparkSession, d: str) -> DataFrame:
    rules = spark.createDataFrame(IGNORED, "code string, url string")
    return visibility.placed(some_issues(spark, d), urls(spark, d), rules)


@query(f"SELECT code, count(*) AS n FROM ({ROW_RULES_SQL}) GROUP BY code")
def ag4_issue_counts(spark: SparkSession, d: str) -> DataFrame:
    return rules_row(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


_CATALOGUE_SQL = ", ".join(f"('{r.code}', '{r.severity}', '{r.group}')" for r in CATALOGUE.values())


@query(f"""
    SELECT c.severity, c.rule_group, count(*) AS issues, count(DISTINCT url_id) AS pages FROM ({ROW_RULES_SQL}) i JOIN (VALUES {_CATALOGUE_SQL}) c(code, severity, rule_group) USING (code) GROUP BY ALL""")
def ag15_severity_totals(spark: SparkSession, d: str) -> DataFrame:
    met = rules_row(spark, d).join(F.broadcast(frame(spark)), "code")
    return met.groupBy("severity", "rule_group").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("url_id").alias("pages"))


@query(f"SELECT place, count(*) AS issues, count(DISTINCT url_id) AS pages FROM ({PLACES_SQL}) GROUP BY place")
def ag11_place_counts(spark: SparkSession, d: str) -> DataFrame:
    return set3_places(spark, d).groupBy("place").agg(F.count(F.lit(1)).alias("issues"), F.countDistinct("url_id").alias("pages"))


_FILTERS_SQL = {
    "all": "true", "internal_all": "is_internal AND state = 1", "internal_html": "is_internal AND state = 1 AND resource_type = 0", "external": "NOT is_internal AND state = 1", "images": "resource_type = 1 AND state = 1", "css_and_javascript": "resource_type IN (2, 3) AND state = 1",
    "not_crawled": "state <> 1", "no_response": "state = 1 AND status_code IS NULL", **{f"status_{n}xx": f"state = 1 AND status_code BETWEEN {n}00 AND {n}99" for n in (2, 3, 4, 5)},
}


@query(" UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) AS urls FROM urls WHERE {v}" for k, v in _FILTERS_SQL.items()))
def ag5_filter_counts(spark: SparkSession, d: str) -> DataFrame:
    return tables.filter_counts(urls(spark, d))


@query(" UNION ALL ".join(f"SELECT '{k}' AS filter, id FROM urls WHERE {v}" for k, v in _FILTERS_SQL.items()))
def fi1_filters(spark: SparkSession, d: str) -> DataFrame:
    named = tables.filters()
    hits = F.array_compact(F.array(*[F.when(c, F.lit(k)) for k, c in named.items()]))
    return urls(spark, d).select(F.explode(hits).alias("filter"), "id")


@query("SELECT u.id, u.url FROM urls u WHERE EXISTS (SELECT 1 FROM links l WHERE l.source_id = u.id AND l.type = 6)")
def jn13_semi(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "links").filter("type = 6").select("source_id")
    return tables.with_ids(urls(spark, d), ids, "source_id").select("id", "url")


@query("SELECT u.id FROM urls u LEFT JOIN page_records p ON p.url_id = u.id WHERE coalesce(url ILIKE '%tea%', false) OR coalesce(title ILIKE '%tea%', false) OR coalesce(h1 ILIKE '%tea%', false)")
def fi2_search(spark: SparkSession, d: str) -> DataFrame:
    return facts(spark, d).filter(tables.search("tea")).select("id")


@query(f"SELECT id, {BROKEN_SQL} AS broken, {REFUSED_SQL} AS refused, coalesce(status_code = 429, false) AS throttled, ({DESIGN_SQL}) AS by_design FROM urls WHERE state = 1")
def fi5_link_verdicts(spark: SparkSession, d: str) -> DataFrame:
    by_design = U.redirects_by_design(F.col("url")) | F.coalesce(U.redirects_by_design(F.col("redirect_url")), F.lit(False))
    s = F.col("status_code")
    return urls(spark, d).filter("state = 1").select("id", measures.is_broken(s, F.col("blocked_by_robots")).alias("broken"), measures.is_refused(s).alias("refused"), measures.is_throttled(s).alias("throttled"), by_design.alias("by_design"))


@query(f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY host, {PATH_SQL} ORDER BY id) AS k FROM urls WHERE contains(url, '?')) WHERE k > 1")
def fi13_query_variants(spark: SparkSession, d: str) -> DataFrame:
    """Addresses beyond the first of a path that differ only in their query."""
    u = urls(spark, d).filter(F.col("url").contains("?")).withColumn("path", U.path(F.col("url")))
    first = u.groupBy("host", "path").agg(F.min("id").alias("first"))
    return u.join(first, ["host", "path"]).filter("id <> first").select("id")


@query(f"""
    SELECT id, CAST(coalesce(max(n), 0) AS INT) AS repeats FROM (SELECT id, s, count(*) AS n FROM (SELECT id, unnest(string_split({PATH_SQL}, '/')) AS s FROM urls) WHERE s <> '' GROUP BY ALL) GROUP BY id""")
def fi14_repeated_segments(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", U.most_repeated_segment(F.col("url")).alias("repeats")).filter("repeats > 0")


@query("SELECT id, host, size_bytes, row_number() OVER (ORDER BY size_bytes DESC NULLS LAST, id) AS pos FROM urls WHERE is_internal AND state = 1 AND resource_type = 0 ORDER BY pos LIMIT 200")
def so1_largest_pages(spark: SparkSession, d: str) -> DataFrame:
    """A report of the 200 largest pages."""
    top = tables.Request("internal_html", sort="size_bytes", ascending=False, limit=200).run(urls(spark, d), ["id", "host", "size_bytes"])
    return top.withColumn("pos", F.row_number().over(Window.orderBy(F.col("size_bytes").desc_nulls_last(), "id")))


@query("""
    WITH i AS (SELECT target_id AS id, count(*) AS inlinks, count(DISTINCT source_id) AS unique_inlinks FROM links WHERE type NOT IN (4, 5) GROUP BY 1)
    SELECT u.id FROM urls u LEFT JOIN i USING (id) WHERE is_internal AND state = 1 AND resource_type = 0 AND indexability = 1
    ORDER BY (depth = 0) DESC NULLS LAST, coalesce(unique_inlinks, 0) DESC, coalesce(inlinks, 0) DESC, depth NULLS FIRST, u.id LIMIT 25""")
def so3_speed_candidates(spark: SparkSession, d: str) -> DataFrame:
    """The 25 pages to measure: home first, then the most linked."""
    counts = cross_rules.inlink_counts(table(spark, d, "links"))
    pages = urls(spark, d).filter(cross_rules.indexable_html()).join(counts, "id", "left").na.fill(0, ["inlinks", "unique_inlinks"])
    return pages.orderBy((F.col("depth") == 0).desc_nulls_last(), F.desc("unique_inlinks"), F.desc("inlinks"), F.col("depth").asc_nulls_first(), "id").limit(25).select("id")


@query("SELECT target_id, source_id, text, flags FROM (SELECT DISTINCT target_id, source_id, text, flags FROM links WHERE type = 0) QUALIFY row_number() OVER (PARTITION BY target_id ORDER BY source_id, text NULLS FIRST, flags NULLS FIRST) <= 5")
def so2_first_inlinks(spark: SparkSession, d: str) -> DataFrame:
    """Up to five links to every target, as a page's report shows them."""
    links = table(spark, d, "links").filter("type = 0").select("target_id", "source_id", "text", "flags").distinct()
    return tables.top_per_group(links, ["target_id"], [F.col("source_id").asc(), F.col("text").asc_nulls_first(), F.col("flags").asc_nulls_first()], 5).drop("rank")


@query("""
    SELECT count(*) AS urls, count(*) FILTER (WHERE state = 1) AS crawled, count(*) FILTER (WHERE state = 0) AS queued, count(*) FILTER (WHERE state = 2) AS skipped, count(*) FILTER (WHERE is_internal) AS internal, count(*) FILTER (WHERE NOT is_internal) AS external,
        count(*) FILTER (WHERE is_internal AND state = 1 AND resource_type = 0) AS pages, count(*) FILTER (WHERE is_internal AND state = 1 AND resource_type = 0 AND indexability = 1) AS indexable, count(*) FILTER (WHERE is_internal AND state = 1 AND resource_type = 0 AND indexability = 2) AS non_indexable,
        count(*) FILTER (WHERE blocked_by_robots) AS blocked, round(avg(response_ms) FILTER (WHERE is_internal AND state = 1 AND resource_type = 0 AND NOT isnan(response_ms)), 3) AS mean_response_ms FROM urls""")
def ag6_overview(spark: SparkSession, d: str) -> DataFrame:
    return tables.overview(urls(spark, d)).withColumn("mean_response_ms", F.round("mean_response_ms", 3))


@query(" UNION ALL ".join(f"SELECT '{k}' AS bucket, count(*) AS urls FROM urls WHERE state = 1 AND {v}" for k, v in {**{f"{n}xx": f"status_code BETWEEN {n}00 AND {n}99" for n in (2, 3, 4, 5)}, "Blocked": "blocked_by_robots", "No response": "status_code IS NULL AND NOT coalesce(blocked_by_robots, false)"}.items()))
def ag7_status_classes(spark: SparkSession, d: str) -> DataFrame:
    return tables.status_buckets(urls(spark, d))


@query("SELECT least(depth, 10) AS depth, count(*) AS pages, CASE WHEN least(depth, 10) = 10 THEN '10+' ELSE CAST(least(depth, 10) AS VARCHAR) END AS label FROM urls WHERE is_internal AND state = 1 AND resource_type = 0 AND depth IS NOT NULL GROUP BY ALL")
def ag8_depths(spark: SparkSession, d: str) -> DataFrame:
    return tables.depth_histogram(urls(spark, d))


@query(" UNION ALL ".join(f"SELECT '{k}' AS bin, count(*) AS urls FROM urls WHERE state = 1 AND NOT isnan(response_ms) AND response_ms >= {lo}" + (f" AND response_ms < {hi}" if hi else "") for k, lo, hi in tables.RESPONSE_BINS))
def ag9_response_times(spark: SparkSession, d: str) -> DataFrame:
    return tables.response_histogram(urls(spark, d))


@query("""
    SELECT brand, count(*) AS entities, sum(variants) AS variants, sum(with_price) AS with_price, max(images) AS images, min(CASE WHEN NOT isnan(low_price) THEN low_price END) AS low_price, max(CASE WHEN NOT isnan(high_price) THEN high_price END) AS high_price,
        coalesce(array_to_string(list_sort(list_distinct(list(availability) FILTER (WHERE availability IS NOT NULL))), ', '), '') AS availabilities FROM products GROUP BY brand""")
def ag16_merged_products(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "products").withColumns({c: F.nanvl(c, F.lit(None).cast("double")) for c in ("low_price", "high_price")})
    return tables.merged_products(p, ["brand"])


@query("SELECT word, count(*) AS uses FROM (SELECT unnest(string_split_regex(lower(name), '[^\\p{L}]+')) AS word FROM products) WHERE length(word) >= 4 GROUP BY word ORDER BY uses DESC, word LIMIT 1")
def ag17_commonest_word(spark: SparkSession, d: str) -> DataFrame:
    return tables.commonest_word(table(spark, d, "products").select(F.col("name").alias("text")))


_SIDES = """
    c AS (SELECT crawl_id, host, row_number() OVER (PARTITION BY host ORDER BY started_at, crawl_id) AS a, row_number() OVER (PARTITION BY host ORDER BY started_at DESC, crawl_id DESC) AS z FROM crawls WHERE status = 'done'),
    s AS (SELECT u.url, u.status_code, u.indexability, c.a, c.z FROM url_snapshots u JOIN c USING (crawl_id) WHERE url IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY u.crawl_id, u.url ORDER BY u.crawled_at DESC NULLS LAST, u.received_at DESC NULLS LAST) = 1),
    o AS (SELECT url, coalesce(CAST(status_code AS VARCHAR), '') AS status_code, coalesce(CAST(indexability AS VARCHAR), '') AS indexability FROM s WHERE a = 1), n AS (SELECT url, coalesce(CAST(status_code AS VARCHAR), '') AS status_code, coalesce(CAST(indexability AS VARCHAR), '') AS indexability FROM s WHERE z = 1)"""


def first_and_last(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The rows of every host's first and last complete crawl."""
    done = table(spark, d, "crawls").filter("status = 'done'")
    at = F.struct("started_at", "crawl_id")
    ends = done.groupBy("host").agg(F.min_by("crawl_id", at).alias("first"), F.max_by("crawl_id", at).alias("last"))
    rows = table(spark, d, "url_snapshots").filter(F.col("url").isNotNull()).select("crawl_id", "url", "status_code", "indexability", "crawled_at", "received_at")
    kept = rows.join(ends.select(F.explode(F.array_distinct(F.array("first", "last"))).alias("crawl_id"), "first", "last"), "crawl_id")
    now = cut(tables.latest(kept, ["crawl_id", "url"], F.col("crawled_at"), F.col("received_at")))
    side = lambda which: now.filter(F.col("crawl_id") == F.col(which)).select("url", "status_code", "indexability")
    return side("first"), side("last")


@query("WITH " + _SIDES + """
    SELECT coalesce(o.url, n.url) AS url, 'added' AS kind, NULL AS field, NULL AS old_value, NULL AS new_value FROM o FULL JOIN n ON o.url = n.url WHERE o.url IS NULL
    UNION ALL SELECT o.url, 'removed', NULL, NULL, NULL FROM o LEFT JOIN n ON o.url = n.url WHERE n.url IS NULL
    UNION ALL SELECT o.url, 'changed', 'status_code', o.status_code, n.status_code FROM o JOIN n ON o.url = n.url WHERE o.status_code <> n.status_code
    UNION ALL SELECT o.url, 'changed', 'indexability', o.indexability, n.indexability FROM o JOIN n ON o.url = n.url WHERE o.indexability <> n.indexability""")
def jn7_compared_crawls(spark: SparkSession, d: str) -> DataFrame:
    old, new = first_and_last(spark, d)
    return compare.compared(old, new, ["url"], ["status_code", "indexability"])


_BAD = "CASE WHEN status_code LIKE '4%' THEN '4xx' WHEN status_code LIKE '5%' THEN '5xx' END"


@query("WITH " + _SIDES + f""",
    a AS (SELECT url, {_BAD} AS code FROM o), b AS (SELECT url, {_BAD} AS code FROM n)
    SELECT b.code, b.url, 'new' AS kind FROM b JOIN a ON a.url = b.url WHERE b.code IS NOT NULL AND a.code IS DISTINCT FROM b.code
    UNION ALL SELECT a.code, a.url, 'fixed' FROM a JOIN b ON a.url = b.url WHERE a.code IS NOT NULL AND a.code IS DISTINCT FROM b.code""")
def jn8_issue_changes(spark: SparkSession, d: str) -> DataFrame:
    sides = [s.select("url", measures.status_class(F.col("status_code")).alias("code")) for s in first_and_last(spark, d)]
    bad = [s.filter(F.col("code").isin("4xx", "5xx")) for s in sides]
    return compare.issue_changes(bad[0], bad[1], sides[0], sides[1])


@query("WITH " + _SIDES + f""",
    a AS (SELECT {_BAD} AS code, count(*) AS k FROM o GROUP BY 1), b AS (SELECT {_BAD} AS code, count(*) AS k FROM n GROUP BY 1)
    SELECT coalesce(a.code, b.code) AS code, coalesce(a.k, 0) AS before, coalesce(b.k, 0) AS after, coalesce(b.k, 0) - coalesce(a.k, 0) AS change FROM a FULL JOIN b ON a.code = b.code WHERE coalesce(a.code, b.code) IS NOT NULL AND coalesce(b.k, 0) <> coalesce(a.k, 0)""")
def ag14_issue_deltas(spark: SparkSession, d: str) -> DataFrame:
    old, new = (s.select(measures.status_class(F.col("status_code")).alias("code")).filter(F.col("code").isin("4xx", "5xx")) for s in first_and_last(spark, d))
    return tables.deltas(old, new)


@query("""
    WITH w AS (SELECT DISTINCT code FROM (VALUES ('a'), ('b'), ('c')) v(code)), e AS (SELECT * FROM (VALUES ('b', true), ('c', false), ('d', true), ('e', true), ('f', false)) v(code, is_open))
    SELECT coalesce(w.code, e.code) AS code, CASE WHEN w.code IS NOT NULL AND e.code IS NULL THEN 'create' WHEN w.code IS NOT NULL AND is_open THEN 'update' WHEN w.code IS NOT NULL THEN 'reopen' WHEN is_open AND e.code = 'e' THEN 'close' ELSE 'leave' END AS action FROM w FULL JOIN e ON w.code = e.code""")
def set4_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Tasks brought in line after an incomplete crawl: only the ignored one closes."""
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    have = spark.createDataFrame([("b", True), ("c", False), ("d", True), ("e", True), ("f", False)], "code string, is_open boolean")
    return visibility.reconciled(wanted, have, spark.createDataFrame([("e",)], "code string"), complete=False)


@query("""
    WITH c AS (SELECT crawl_id, host, row_number() OVER (PARTITION BY host ORDER BY started_at DESC, crawl_id DESC) AS z FROM crawls WHERE status = 'done'),
    s AS (SELECT u.url, u.status_code // 100 AS k, c.host, c.z FROM url_snapshots u JOIN c USING (crawl_id) WHERE u.url IS NOT NULL
          QUALIFY row_number() OVER (PARTITION BY u.crawl_id, u.url ORDER BY u.crawled_at DESC NULLS LAST, u.received_at DESC NULLS LAST) = 1),
    i AS (SELECT k || 'xx ' || coalesce(host, '') || ' ' || url AS code, z FROM s WHERE k IN (4, 5)),
    t AS (SELECT code, bool_or(z = 1) AS wanted, bool_or(z = 2) AS is_open, bool_or(z > 1) AS known FROM i GROUP BY code)
    SELECT code, CASE WHEN wanted AND NOT known THEN 'create' WHEN wanted AND is_open THEN 'update' WHEN wanted THEN 'reopen' WHEN is_open THEN 'close' ELSE 'leave' END AS action FROM t""")
def set4_crawls_reconciled(spark: SparkSession, d: str) -> DataFrame:
    """Tasks for the 4xx and 5xx of earlier complete crawls, open if the last but one had them, in line with the last one's."""
    z = F.row_number().over(Window.partitionBy("host").orderBy(F.desc("started_at"), F.desc("crawl_id")))
    done = table(spark, d, "crawls").filter("status = 'done'").select("crawl_id", F.coalesce("host", F.lit("")).alias("host"), z.alias("z"))
    rows = table(spark, d, "url_snapshots").filter(F.col("url").isNotNull()).select("crawl_id", "url", "status_code", "crawled_at", "received_at").join(done, "crawl_id")
    now = tables.latest(rows, ["crawl_id", "url"], F.col("crawled_at"), F.col("received_at")).withColumn("kind", measures.status_class(F.col("status_code")))
    issues = cut(now.filter(F.col("kind").isin("4xx", "5xx")).select(F.concat_ws(" ", "kind", "host", "url").alias("code"), "z"))
    existing = issues.filter("z > 1").groupBy("code").agg((F.min("z") == 2).alias("is_open"))
    return visibility.reconciled(issues.filter("z = 1"), existing, spark.createDataFrame([], "code string"), complete=True)


@query("SELECT id FROM (SELECT url_id AS id FROM page_records WHERE coalesce(h1, '') = '') WHERE id IN (SELECT url_id FROM page_records WHERE coalesce(title, '') = '')")
def set7_both_missing(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "page_records")
    empty = lambda c: p.filter(F.coalesce(c, F.lit("")) == "").select(F.col("url_id").alias("id"))
    return empty("h1").intersect(empty("title"))


@query("SELECT id, CASE WHEN state = 2 THEN coalesce(error, 'Skipped') WHEN state = 0 THEN 'Queued' WHEN blocked_by_robots THEN 'Blocked by robots.txt' WHEN error IS NOT NULL THEN error ELSE status_text END AS status, coalesce(status_text, error) AS sorted_by, CASE WHEN state = 1 AND response_ms IS NOT NULL AND isfinite(response_ms) THEN CAST(CAST(round_even(response_ms, 0) AS BIGINT) AS VARCHAR) ELSE '' END AS response FROM urls")
def pr4_described(spark: SparkSession, d: str) -> DataFrame:
    real = F.when(~F.isnan("response_ms") & (F.abs("response_ms") != float("inf")), F.rint("response_ms").cast("long").cast("string"))
    return urls(spark, d).select("id", tables.described().alias("status"), F.coalesce("status_text", "error").alias("sorted_by"), F.when(F.col("state") == 1, F.coalesce(real, F.lit(""))).otherwise("").alias("response"))


@query("SELECT url_id, max(CASE WHEN f = 'title' THEN v END) AS title, max(CASE WHEN f = 'h1' THEN v END) AS h1 FROM (SELECT url_id, 'title' AS f, title AS v FROM page_records UNION ALL SELECT url_id, 'h1', h1 FROM page_records) GROUP BY url_id")
def pr6_pivoted(spark: SparkSession, d: str) -> DataFrame:
    cells = F.inline(F.array(F.struct(F.lit("title").alias("name"), F.col("title").alias("value")), F.struct(F.lit("h1").alias("name"), F.col("h1").alias("value"))))
    return tables.wide(table(spark, d, "page_records").select("url_id", cells), ["title", "h1"])


@query("SELECT host, count(*) FILTER (WHERE state = 1) AS crawled, count(*) AS urls FROM urls GROUP BY host")
def sc2_summary(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).groupBy("host").agg(F.count_if(F.col("state") == 1).alias("crawled"), F.count(F.lit(1)).alias("urls"))


@query("SELECT u.id, u.url, a.pos FROM (VALUES (17, 0), (4999, 1), (-5, 2), (1200, 3), (33, 4)) a(id, pos) JOIN urls u ON u.id = a.id")
def sc4_lookup(spark: SparkSession, d: str) -> DataFrame:
    return tables.lookup(urls(spark, d), [17, 4999, -5, 1200, 33]).select("id", "url", "pos")


@query("SELECT id, url, depth FROM urls WHERE state = 0 AND id > 1000 ORDER BY id LIMIT 100")
def sc6_next_queued(spark: SparkSession, d: str) -> DataFrame:
    return tables.next_queued(urls(spark, d), 1000, 100)


@query("SELECT url, arg_max_null(status_code, (crawled_at, received_at)) AS status_code FROM url_snapshots WHERE url IS NOT NULL AND crawled_at IS NOT NULL GROUP BY url")
def sk12_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last answer of every URL."""
    s = table(spark, d, "url_snapshots").filter("url IS NOT NULL AND crawled_at IS NOT NULL").select("url", "status_code", "crawled_at", "received_at")
    return tables.latest(s, ["url"], F.col("crawled_at"), F.col("received_at")).select("url", "status_code")


_Q = "regexp_extract(url, '^[^?#]*\\?([^#]*)', 1)"


@query(f"""
    SELECT id, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)) AS scheme, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)', 1)) AS origin, {PATH_SQL} AS path, {_Q} AS query,
        {PATH_SQL} || CASE WHEN {_Q} = '' THEN '' ELSE '?' || {_Q} END AS path_and_query FROM urls""")
def ur11_url_parts(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return urls(spark, d).select("id", U.scheme(u).alias("scheme"), U.origin(u).alias("origin"), U.path(u).alias("path"), U.query(u).alias("query"), U.path_and_query(u).alias("path_and_query"))


_MK = "^(?:/[a-z]{2}(?:-[a-z]{2,4})?)?"


@query(f"""
    SELECT id, nullif(lower(regexp_extract({PATH_SQL}, '(?i){_MK}(?:/collections/[^/?#]+)?/products/([^/?#]+)', 1)), '') AS handle, regexp_matches({PATH_SQL}, '(?i){_MK}/collections/[^/?#]+/products/[^/?#]+') AS in_collection,
        regexp_matches({PATH_SQL}, '(?i){_MK}/collections/[^/?#]+/?$') AS is_collection, {LATER_SQL} AS later_page FROM urls""")
def ur6_shop_paths(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("url")
    return urls(spark, d).select("id", U.product_handle(u).alias("handle"), U.in_collection(u).alias("in_collection"), U.is_collection(u).alias("is_collection"), U.later_page(u).alias("later_page"))


@query("""
    WITH p AS (SELECT id, url, regexp_replace(regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1), '^/[a-z]{2}(?:-[a-z]{2,4})?($|/$|/(?:collections|products|blogs|pages))', '\\1') AS p FROM urls WHERE url NOT LIKE '%?%'),
    s AS (SELECT id, list_filter(string_split(p, '/'), lambda x: x <> '') AS s FROM p)
    SELECT id, CASE WHEN len(s) = 0 THEN 'home' WHEN len(s) = 2 AND s[1] = 'collections' THEN CASE WHEN s[2] = 'all' THEN 'all_products' ELSE 'collection' END WHEN len(s) = 2 AND s[1] = 'products' THEN 'product'
        WHEN len(s) = 2 AND s[1] = 'blogs' THEN 'blog' WHEN len(s) = 3 AND s[1] = 'blogs' AND s[3] <> 'tagged' THEN 'article' WHEN len(s) = 2 AND s[1] = 'pages' THEN 'page' END AS template FROM s""")
def ur7_templates(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).filter(~F.col("url").contains("?")).select("id", U.template(F.col("url")).alias("template"))


_TRACK = "|".join(U.TRACKING)


@query(f"""
    WITH i AS (SELECT id, url, list_filter(string_split({_Q}, '&'), lambda x: x <> '') AS items FROM urls WHERE contains(url, '?')),
    k AS (SELECT id, url, items, list_filter(items, lambda x: NOT regexp_matches(x, '(?i)^(?:(?:{_TRACK})(?:=|$)|utm_)')) AS kept FROM i)
    SELECT id, regexp_extract(url, '^([^?#]*)', 1) || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(kept, '&') END || regexp_extract(url, '(#.*)$', 1) AS clean FROM k WHERE len(kept) < len(items)""")
def ur8_without_tracking(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", U.without_tracking(F.col("url")).alias("clean")).filter(F.col("clean").isNotNull())


@query(r"""
    SELECT url_id, trim(regexp_replace(title, '\s+', ' ', 'g')) AS collapsed, len(list_filter(string_split_regex(coalesce(title, ''), '\s+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))) AS words,
        CASE WHEN regexp_matches(title, '[",\r\n]') THEN '"' || replace(title, '"', '""') || '"' ELSE title END AS csv,
        regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, CASE WHEN length(title) > 40 THEN rtrim(substring(title, 1, 39)) || '…' ELSE title END AS short FROM page_records WHERE title IS NOT NULL""")
def st1_title_texts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("title")
    return table(spark, d, "page_records").filter(t.isNotNull()).select("url_id", text.collapse(t).alias("collapsed"), text.word_count(t).alias("words"), text.csv_field(t).alias("csv"), text.slug(t).alias("slug"), text.truncated(t, 40).alias("short"))


@query("""
    SELECT doc_id, CAST(CASE WHEN h >= 9223372036854775808 THEN CAST(h AS HUGEINT) - 18446744073709551616 ELSE CAST(h AS HUGEINT) END AS BIGINT) AS hash FROM (
        SELECT doc_id, list_reduce(list_transform(range(1, octet_length(encode(source)) + 1), lambda i: CAST(ord(source[i]) AS UHUGEINT)), lambda a, b: xor(a, b) * 1099511628211 % 18446744073709551616, CAST(14695981039346656037 AS UHUGEINT)) AS h FROM documents WHERE source IS NOT NULL)""")
def st4_hashes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").filter(F.col("source").isNotNull()).select("doc_id", text.fnv1a64_udf("source").alias("hash"))


@query()
def st4_text_hashes(spark: SparkSession, d: str) -> DataFrame:
    """The content hash of every document's whole text; null for none."""
    return table(spark, d, "documents").select("doc_id", text.fnv1a64_udf("text").alias("hash"))


@query("""
    SELECT type, count(*) AS links, count(*) FILTER (WHERE flags & 1 <> 0) AS nofollow, count(*) FILTER (WHERE flags & 2 <> 0) AS ugc, count(*) FILTER (WHERE flags & 4 <> 0) AS sponsored, count(*) FILTER (WHERE ((flags & 1792) >> 8) BETWEEN 1 AND 4) AS in_template,
        count(*) FILTER (WHERE trim(lower(text)) IN ('click here', 'click', 'here', 'read more', 'more', 'learn more', 'this page', 'link', 'go', 'this', 'more info', 'find out more')) AS generic FROM links GROUP BY type""")
def st12_link_flags(spark: SparkSession, d: str) -> DataFrame:
    f = F.col("flags")
    bit = lambda b: F.count_if(f.bitwiseAND(F.lit(b)) != 0)
    position = F.shiftright(f.bitwiseAND(F.lit(0x700)), 8)
    return table(spark, d, "links").groupBy("type").agg(
        F.count(F.lit(1)).alias("links"), bit(1).alias("nofollow"), bit(2).alias("ugc"), bit(4).alias("sponsored"), F.count_if(position.between(1, 4)).alias("in_template"),
        F.count_if(F.trim(F.lower("text")).isin(*text.GENERIC_ANCHORS)).alias("generic"),
    )


@query("SELECT status_code, CASE WHEN status_code BETWEEN 200 AND 599 THEN CAST(status_code // 100 AS VARCHAR) || 'xx' END AS class, count(*) AS urls FROM urls GROUP BY ALL")
def ma2_statuses(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).groupBy("status_code", measures.status_class(F.col("status_code")).alias("class")).agg(F.count(F.lit(1)).alias("urls"))


@query("""
    WITH c AS (SELECT lower(trim(regexp_extract(content_type, '^([^;]*)', 1))) AS c, content_type FROM urls)
    SELECT content_type, CASE WHEN content_type IS NULL OR c = '' THEN NULL WHEN c IN ('text/html', 'application/xhtml+xml') THEN 0 WHEN c LIKE 'image/%' THEN 1 WHEN c = 'text/css' THEN 2 WHEN c LIKE '%javascript%' OR c LIKE '%ecmascript%' THEN 3 WHEN c = 'application/pdf' THEN 4 ELSE 5 END AS kind, count(*) AS urls FROM c GROUP BY ALL""")
def ma3_resource_types(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).groupBy("content_type", measures.resource_type(F.col("content_type")).alias("kind")).agg(F.count(F.lit(1)).alias("urls"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def js3_properties(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("""
    SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events, count(*) FILTER (WHERE event_type = 'error') AS failures, round(avg(value), 6) AS mean_value FROM events GROUP BY 1""")
def window_hourly(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    w = e.groupBy(F.window("ts", "1 hour")).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"), F.round(F.avg("value"), 6).alias("mean_value"))
    return w.select(F.col("window.start").cast("timestamp_ntz").alias("window_start"), "events", "failures", "mean_value")


@query("""
    SELECT type, CASE WHEN pages >= 10 OR (pages >= 2 AND in_template) THEN 'theme' ELSE 'page' END AS place, count(*) AS fixes, sum(pages) AS pages FROM (
        SELECT target_id, text, type, count(DISTINCT source_id) AS pages, bool_or(((flags & 1792) >> 8) BETWEEN 1 AND 4) AS in_template FROM links GROUP BY ALL) GROUP BY ALL""")
def fx6_link_fixes(spark: SparkSession, d: str) -> DataFrame:
    """Links with the same target and text are one fix: the theme's where many pages or the template hold them."""
    position = F.shiftright(F.col("flags").bitwiseAND(F.lit(0x700)), 8)
    one = table(spark, d, "links").groupBy("target_id", "text", "type", "source_id").agg(F.bool_or(position.between(1, 4)).alias("t"))
    g = one.groupBy("target_id", "text", "type").agg(F.count(F.lit(1)).alias("pages"), F.bool_or("t").alias("in_template"))
    place = F.when((F.col("pages") >= 10) | ((F.col("pages") >= 2) & F.col("in_template")), "theme").otherwise("page")
    return g.groupBy("type", place.alias("place")).agg(F.count(F.lit(1)).alias("fixes"), F.sum("pages").alias("pages"))


@query("""
    WITH g AS (SELECT 'title' AS field, title AS v, list_sort(list(url_id)) AS pages FROM page_records WHERE title <> '' GROUP BY title HAVING count(*) > 1 UNION ALL SELECT 'h1', h1, list_sort(list(url_id)) FROM page_records WHERE h1 <> '' GROUP BY h1 HAVING count(*) > 1),
    m AS (SELECT pages, array_to_string(list_sort(list(DISTINCT field)), '+') AS fields FROM g GROUP BY pages)
    SELECT fields, count(*) AS clusters, sum(len(pages)) AS pages FROM m GROUP BY fields""")
def fx10_merged_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Duplicate clusters with the same pages are one; page sets are compared by two order-free hashes and their size."""
    p = table(spark, d, "page_records")
    cells = F.inline(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("v")) for f in ("title", "h1")]))
    rows = p.select("url_id", cells).filter("v <> ''")
    mix = lambda seed: F.sum(F.pmod(F.xxhash64("url_id", F.lit(seed)), F.lit(1 << 40)))
    sets = rows.groupBy("field", "v").agg(F.count(F.lit(1)).alias("n"), mix(1).alias("a"), mix(2).alias("b")).filter("n > 1")
    merged = sets.groupBy("n", "a", "b").agg(F.array_join(F.array_sort(F.collect_set("field")), "+").alias("fields"))
    return merged.groupBy("fields").agg(F.count(F.lit(1)).alias("clusters"), F.sum("n").alias("pages"))
