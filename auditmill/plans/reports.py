"""Queries of tables, exports, comparisons, fixes and evidence, each with SQL for DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditmill import sinks
from auditmill.audit import cross_rules
from auditmill.audit.catalogue import CATALOGUE
from auditmill.functions import measures, text, urls as U
from auditmill.operators import columns, compare, patterns, store, tables
from auditmill.plans import graph_and_stream, site_audit as SA
from auditmill.session import cut, table
from auditmill.sources import robots, scope

QUERIES: dict = {}
ORACLES: dict = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "urls")


@query("SELECT id, url, state FROM urls")
def sc3_index(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", "url", "state")


@query("SELECT h.kind, u.id, u.status_code FROM hub_urls h LEFT JOIN urls u ON u.url = h.url")
def sc5_by_url(spark: SparkSession, d: str) -> DataFrame:
    """The crawled rows of the shared pages' addresses, as far as there are any."""
    return table(spark, d, "hub_urls").select("kind", "url").join(urls(spark, d).select("id", "url", "status_code"), "url", "left").select("kind", "id", "status_code")


SORTS = ("responseMs", "statusCode", "address", "status")
_SORT_SQL = {"responseMs": "response_ms", "statusCode": "status_code", "address": "url", "status": "coalesce(status_text, error)"}


@query(" UNION ALL ".join(f"SELECT '{k}' AS sorted_by, id, pos FROM (SELECT id, row_number() OVER (ORDER BY {v} DESC NULLS LAST, id) AS pos FROM urls) WHERE pos <= 100" for k, v in _SORT_SQL.items()))
def so1_sorted(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred rows of the table sorted by several of its columns, falling."""
    u = urls(spark, d)
    top = [columns.ordered(u, k, ascending=False).limit(100).select(F.lit(k).alias("sorted_by"), "id", columns.sort_key(k, u).alias("key")) for k in SORTS]
    number = [t.select("sorted_by", "id", F.row_number().over(Window.orderBy(F.col("key").desc_nulls_last(), "id")).alias("pos")) for t in top]
    return cross_rules.union(number)


_REAL = "CASE WHEN {c} IS NOT NULL AND NOT isnan({c}) AND isfinite({c}) THEN CAST(CAST(round_even({c}, 0) AS BIGINT) AS VARCHAR) ELSE '' END"
_CELL = "CASE WHEN state = 1 AND {c} IS NOT NULL THEN {v} ELSE '' END"


@query("SELECT id, url AS address, " + ", ".join(f"{_CELL.format(c=c, v=v)} AS {n}" for n, c, v in (
    ("statusCode", "status_code", "CAST(status_code AS VARCHAR)"), ("responseMs", "response_ms", _REAL.format(c="response_ms")), ("ttfbMs", "ttfb_ms", _REAL.format(c="ttfb_ms")), ("sizeBytes", "size_bytes", "CAST(size_bytes AS VARCHAR)"), ("contentType", "content_type", "content_type"))) + " FROM urls")
def pr3_displayed(spark: SparkSession, d: str) -> DataFrame:
    u = urls(spark, d)
    return u.select("id", *[columns.display(c, u).alias(c) for c in ("address", "statusCode", "responseMs", "ttfbMs", "sizeBytes", "contentType")])


@query("SELECT * FROM (VALUES " + ", ".join(f"('{c.name}', '{c.title}', '{c.kind}', {c.width})" for c in columns.REGISTRY.values()) + ") v(name, title, kind, width)")
def pr2_columns(spark: SparkSession, d: str) -> DataFrame:
    """The columns a table can show."""
    return spark.createDataFrame([(c.name, c.title, c.kind, c.width) for c in columns.REGISTRY.values()], "name string, title string, kind string, width int")


@query("""
    WITH l AS (SELECT DISTINCT source_id, type, target_id, text FROM links)
    SELECT l.source_id, l.type, u.url, l.text, row_number() OVER (PARTITION BY l.source_id ORDER BY l.type, u.url, l.text NULLS FIRST) AS pos FROM l JOIN urls u ON u.id = l.target_id QUALIFY pos <= 20""")
def jn11_outlinks(spark: SparkSession, d: str) -> DataFrame:
    """Up to twenty links of every page, by kind and address, as its report shows them."""
    links = table(spark, d, "links").select("source_id", "type", "target_id", "text").distinct()
    met = links.join(urls(spark, d).select(F.col("id").alias("target_id"), "url"), "target_id").select("source_id", "type", "url", "text")
    return tables.top_per_group(met, ["source_id"], [F.col("type").asc(), F.col("url").asc(), F.col("text").asc_nulls_first()], 20).withColumnRenamed("rank", "pos")


@query("""
    WITH s AS (SELECT target_id, type, text, count(DISTINCT source_id) AS shared_by FROM links GROUP BY ALL)
    SELECT DISTINCT l.source_id, l.target_id, l.type, l.text, s.shared_by FROM links l JOIN s ON s.target_id = l.target_id AND s.type = l.type AND s.text IS NOT DISTINCT FROM l.text""")
def jn19_shared_links(spark: SparkSession, d: str) -> DataFrame:
    """Every link once, with the number of pages that hold the same.

    Both sides come from one reduction to distinct links; the count per link is
    joined back by its whole key, so a target with a tenth of the links is
    spread over its texts and split at run time.
    """
    one = cut(table(spark, d, "links").select("target_id", "type", F.col("text").isNull().alias("untold"), F.coalesce("text", F.lit("")).alias("said"), "source_id").distinct())
    key = ["target_id", "type", "untold", "said"]
    shared = one.groupBy(*key).agg(F.count(F.lit(1)).alias("shared_by"))
    return one.join(shared, key).select("source_id", "target_id", "type", F.when(~F.col("untold"), F.col("said")).alias("text"), "shared_by")


_CLEAN = SA.ORACLES["ur8_without_tracking"]


@query(f"WITH k AS ({_CLEAN}) SELECT k.id FROM k JOIN urls u ON u.id = k.id WHERE NOT contains(k.clean, '?') AND u.is_internal AND EXISTS (SELECT 1 FROM urls o WHERE o.url = k.clean AND o.status_code IS NOT NULL)")
def jn16_tracking_copies(spark: SparkSession, d: str) -> DataFrame:
    """Internal addresses that are another crawled one with only tracking added."""
    u = urls(spark, d)
    copies = u.filter("is_internal").filter(U.is_tracking_copy(F.col("url"))).select("id", U.without_tracking(F.col("url")).alias("clean"))
    return copies.join(u.filter("status_code IS NOT NULL").select(F.col("url").alias("clean")), "clean", "left_semi").select("id")


@query("""
    SELECT host, name FROM (SELECT u.host, coalesce(t.url, u.url) AS name, row_number() OVER (PARTITION BY u.host ORDER BY u.depth, u.id) AS k
        FROM urls u LEFT JOIN urls t ON t.id = u.redirect_to_id WHERE u.is_internal AND u.state = 1) WHERE k = 1""")
def jn17_front_pages(spark: SparkSession, d: str) -> DataFrame:
    """Every audited host's first page, at the address it redirects to if it does."""
    u = urls(spark, d)
    first = u.filter("is_internal AND state = 1").groupBy("host").agg(F.min_by(F.struct("url", "redirect_to_id"), F.struct(F.col("depth").isNotNull(), "depth", "id")).alias("r"))
    to = u.select(F.col("id").alias("to_id"), F.col("url").alias("to_url"))
    return first.join(to, first.r.redirect_to_id == F.col("to_id"), "left").select("host", F.coalesce("to_url", "r.url").alias("name"))


@query("""
    WITH w AS (SELECT doc_id, array_to_string(list_filter(string_split_regex(lower(coalesce(text, '')), '\\s+'), lambda x: regexp_matches(x, '[\\p{L}\\p{N}]')), ' ') AS t FROM documents)
    SELECT 'content_exact_duplicate' AS code, doc_id FROM w WHERE t <> '' QUALIFY count(*) OVER (PARTITION BY t) > 1""")
def ag2_exact_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose words are those of another, found by content hash and word count."""
    docs = table(spark, d, "documents").select("doc_id", text.content_hash_udf("text").alias("h"), text.word_count(F.col("text")).alias("n")).filter("n > 0")
    docs = cut(docs)
    shared = docs.groupBy("h", "n").agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    return docs.join(shared, ["h", "n"], "left_semi").select(F.lit("content_exact_duplicate").alias("code"), "doc_id")


@query()
def ag2_near_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Documents with another near them, a row each."""
    near = graph_and_stream.jn18_near_duplicates(spark, d)
    return near.filter("links > 0").select(F.lit("content_near_duplicate").alias("code"), F.col("id").alias("doc_id"))


_IGNORED_SQL = f"SELECT code, count(*) AS issues, count(*) FILTER (WHERE place = 'ignored') AS ignored FROM ({SA.PLACES_SQL}) GROUP BY code"


@query(f"SELECT code, ignored, ignored = issues AS wholly FROM ({_IGNORED_SQL}) WHERE ignored > 0")
def ag12_ignored(spark: SparkSession, d: str) -> DataFrame:
    """Per code how many issues are ignored, and whether all are."""
    g = SA.set3_places(spark, d).groupBy("code").agg(F.count(F.lit(1)).alias("issues"), F.count_if(F.col("place") == "ignored").alias("ignored"))
    return g.filter("ignored > 0").select("code", "ignored", (F.col("ignored") == F.col("issues")).alias("wholly"))


@query(f"SELECT code, url_id, k FROM (SELECT code, url_id, row_number() OVER (PARTITION BY code ORDER BY url_id) AS k FROM ({SA.ROW_RULES_SQL})) WHERE k <= 5")
def w_first_per_issue(spark: SparkSession, d: str) -> DataFrame:
    """Five example pages of every issue."""
    return tables.top_per_group(SA.rules_row(spark, d), ["code"], [F.col("url_id").asc()], 5).withColumnRenamed("rank", "k")


@query("SELECT url_id, CASE WHEN k = 1 THEN title ELSE title || ' (' || k || ')' END AS name FROM (SELECT url_id, title, row_number() OVER (PARTITION BY title ORDER BY url_id) AS k FROM page_records WHERE title <> '')")
def w_numbered_names(spark: SparkSession, d: str) -> DataFrame:
    """Titles told apart by a number."""
    k = F.row_number().over(Window.partitionBy("title").orderBy("url_id"))
    p = table(spark, d, "page_records").filter("title <> ''").select("url_id", "title", k.alias("k"))
    return p.select("url_id", F.when(F.col("k") == 1, F.col("title")).otherwise(F.concat("title", F.lit(" ("), F.col("k").cast("string"), F.lit(")"))).alias("name"))


@query(f"""
    WITH t AS ({SA.ORACLES["ur7_templates"]})
    SELECT u.host, t.template, u.id FROM t JOIN urls u ON u.id = t.id WHERE t.template IS NOT NULL AND u.is_internal AND u.state = 1
    QUALIFY row_number() OVER (PARTITION BY u.host, t.template ORDER BY u.depth NULLS FIRST, u.id) <= CASE WHEN t.template = 'product' THEN 3 ELSE 1 END""")
def w_template_pages(spark: SparkSession, d: str) -> DataFrame:
    """Pages to measure of every host: three products, one of every other template."""
    u = urls(spark, d).filter("is_internal AND state = 1").select("host", U.template(F.col("url")).alias("template"), "id", "depth").filter("template IS NOT NULL")
    top = tables.top_per_group(u, ["host", "template"], [F.col("depth").asc_nulls_first(), F.col("id").asc()], 3)
    return top.filter((F.col("rank") == 1) | (F.col("template") == "product")).select("host", "template", "id")


@query(f"SELECT host, template, count(*) AS pages, count(*) >= 10 AS shared FROM ({SA.ORACLES['ur7_templates']}) t JOIN urls u USING (id) WHERE template IS NOT NULL GROUP BY ALL")
def ag19_template_pages(spark: SparkSession, d: str) -> DataFrame:
    """How many pages every template of a host has, and whether they are many enough to speak of the template."""
    u = urls(spark, d).select("host", U.template(F.col("url")).alias("template")).filter("template IS NOT NULL")
    return u.groupBy("host", "template").agg(F.count(F.lit(1)).alias("pages")).withColumn("shared", F.col("pages") >= 10)


_LAST_SQL = "SELECT u.id, s.status_code, s.indexability FROM (SELECT url, arg_max_null(status_code, (crawled_at, received_at)) AS status_code, arg_max_null(indexability, (crawled_at, received_at)) AS indexability FROM url_snapshots WHERE crawled_at IS NOT NULL AND received_at IS NOT NULL GROUP BY url) s JOIN urls u ON u.url = s.url"


@query(f"WITH r AS ({_LAST_SQL}) SELECT u.id, u.url, u.depth, CASE WHEN r.id IS NOT NULL THEN r.status_code ELSE u.status_code END AS status_code, CASE WHEN r.id IS NOT NULL THEN r.indexability ELSE u.indexability END AS indexability FROM urls u LEFT JOIN r ON r.id = u.id")
def sk2_upserted(spark: SparkSession, d: str) -> DataFrame:
    """URLs with what their last snapshot says."""
    u = urls(spark, d).select("id", "url", "depth", "status_code", "indexability")
    s = table(spark, d, "url_snapshots").filter("url IS NOT NULL AND crawled_at IS NOT NULL AND received_at IS NOT NULL").select("url", "status_code", "indexability", "crawled_at", "received_at")
    last = tables.latest(s, ["url"], F.col("crawled_at"), F.col("received_at")).select("url", "status_code", "indexability")
    return store.upserted(u, last.join(u.select("id", "url"), "url").select("id", "status_code", "indexability"))


@query("""
    WITH p AS (SELECT id FROM urls WHERE status_code BETWEEN 300 AND 399)
    SELECT source_id, target_id, text FROM links WHERE source_id NOT IN (SELECT id FROM p) OR source_id IS NULL
    UNION ALL SELECT DISTINCT source_id, target_id, NULL FROM links WHERE source_id IN (SELECT id FROM p)""")
def sk3_replaced_links(spark: SparkSession, d: str) -> DataFrame:
    """Links with those of redirecting pages replaced by one to each target, without a text."""
    links = table(spark, d, "links").select("source_id", "target_id", "text")
    fresh = links.select("source_id", "target_id").distinct().withColumn("text", F.lit(None).cast("string"))
    return store.replaced_children(links, fresh, urls(spark, d).filter("status_code BETWEEN 300 AND 399").select(F.col("id").alias("source_id")), "source_id")


@query("""
    WITH a AS (SELECT t.url, min(s.depth + 1) AS d FROM links l JOIN urls s ON s.id = l.source_id JOIN urls t ON t.id = l.target_id WHERE t.status_code >= 500 GROUP BY t.url)
    SELECT u.id, CASE WHEN a.url IS NOT NULL THEN 0 ELSE u.state END AS state, least(u.depth, a.d) AS depth FROM urls u LEFT JOIN a ON a.url = u.url""")
def sk4_requeued(spark: SparkSession, d: str) -> DataFrame:
    """URLs with failing ones that are linked queued again."""
    u = urls(spark, d)
    to = u.filter("status_code >= 500").select(F.col("id").alias("target_id"), "url")
    pairs = table(spark, d, "links").select("source_id", "target_id").distinct().join(to, "target_id")
    again = pairs.join(u.select(F.col("id").alias("source_id"), (F.col("depth") + 1).alias("depth")), "source_id").select("url", "depth")
    return store.requeued(u, again).select("id", "state", "depth")


def _csv_sql(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_matches({c}, '[\",\\r\\n]') THEN '\"' || replace({c}, '\"', '\"\"') || '\"' ELSE {c} END, '')"


@query("SELECT CAST(url_id AS VARCHAR) || ',' || " + " || ',' || ".join(_csv_sql(c) for c in ("title", "meta_description", "h1", "lang")) + " || ',' || coalesce(CAST(word_count AS VARCHAR), '') AS line FROM page_records")
def sk5_csv(spark: SparkSession, d: str) -> DataFrame:
    """Pages as lines of a CSV file."""
    return sinks.csv_lines(table(spark, d, "page_records").select("url_id", "title", "meta_description", "h1", "lang", "word_count"))


@query("SELECT (row_number() OVER (ORDER BY id) - 1) // 1000 + 1 AS sheet, (row_number() OVER (ORDER BY id) - 1) % 1000 + 1 AS row, id, substring(url, 1, 40) AS url FROM urls")
def sk6_sheets(spark: SparkSession, d: str) -> DataFrame:
    """URLs on sheets of a thousand rows and cells of forty characters."""
    return sinks.sheets(urls(spark, d).select("id", "url"), [F.col("id")], rows=1000, cell=40)


@query("SELECT '{\"host\":\"' || host || '\",\"urls\":' || count(*) || ',\"crawled\":' || count(*) FILTER (WHERE state = 1) || '}' AS json FROM urls WHERE host IS NOT NULL GROUP BY host")
def sk10_json(spark: SparkSession, d: str) -> DataFrame:
    """A summary object per host."""
    g = urls(spark, d).filter("host IS NOT NULL").groupBy("host").agg(F.count(F.lit(1)).alias("urls"), F.count_if(F.col("state") == 1).alias("crawled"))
    return sinks.json_summary(g)


_START = "www.mossgate-goods.example"
_REPEATS = f"coalesce((SELECT max(n) FROM (SELECT count(*) AS n FROM (SELECT unnest(string_split({SA.PATH_SQL}, '/')) AS s) WHERE s <> '' GROUP BY s)), 0)"


@query(f"""
    SELECT id, CASE WHEN regexp_matches(url, '[?&]utm_') THEN 'ignore' WHEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) <> '{_START}' AND NOT follow THEN 'skip: Nofollow external link'
        WHEN lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)) <> '{_START}' THEN 'crawl' WHEN resource_type = 1 THEN 'skip: Image crawling disabled'
        WHEN depth > 3 THEN 'skip: Beyond max crawl depth' WHEN octet_length(encode(url)) > 70 THEN 'skip: URL longer than limit' ELSE 'crawl' END AS decision
    FROM (SELECT *, NOT coalesce(found_via = 1, false) AS follow FROM urls)""")
def fi11_scope(spark: SparkSession, d: str) -> DataFrame:
    """What a crawl of one shop would do with every address."""
    s = scope.Scope(_START, exclude=("[?&]utm_",), external_nofollow=False, images=False, max_depth=3, max_length=70)
    follow = ~F.coalesce(F.col("found_via") == 1, F.lit(False))
    return urls(spark, d).select("id", scope.decision(s, F.col("url"), F.col("depth"), F.col("resource_type"), follow).alias("decision"))


@query("SELECT id, CASE " + " ".join(f"WHEN regexp_matches(url, '{p}') THEN '{w.replace(chr(39), chr(39) * 2)}'" for p, w in scope.EXCLUSIONS) + " END AS reason FROM urls")
def fi15_exclusions(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", scope.excluded(F.col("url")).alias("reason"))


_REASON_SQL = ", ".join(f"({k}, '{v.replace(chr(39), chr(39) * 2)}')" for k, v in measures.REASONS.items())


@query(f"SELECT u.id, coalesce(r.name, CASE WHEN u.status_code BETWEEN 100 AND 599 THEN (['Informational', 'Success', 'Redirection', 'Client Error', 'Server Error'])[u.status_code // 100] WHEN u.status_code IS NOT NULL THEN 'Unknown' END) AS reason FROM urls u LEFT JOIN (VALUES {_REASON_SQL}) r(code, name) ON r.code = u.status_code")
def ma2_reasons(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", measures.reason(F.col("status_code")).alias("reason"))


@query("WITH b AS (SELECT id, url, regexp_extract(url, '^([^?]*)\\?page=[^&]*$', 1) AS b FROM urls), t AS (" + SA.ORACLES["ur7_templates"].replace("WHERE url NOT LIKE '%?%'", "").replace("SELECT id, url, regexp_replace(regexp_extract(url,", "SELECT id, b AS url, regexp_replace(regexp_extract(b,").replace("FROM urls", "FROM b WHERE b <> ''") + ") SELECT b.id, b.b AS base FROM b JOIN t ON t.id = b.id WHERE b.b <> '' AND template IN ('collection', 'all_products', 'blog')")
def ur5_pagination(spark: SparkSession, d: str) -> DataFrame:
    """Later pages of lists and the first page of their list."""
    return urls(spark, d).select("id", U.pagination_base(F.col("url")).alias("base")).filter("base IS NOT NULL")


@query()
def ur10_labels(spark: SparkSession, d: str) -> DataFrame:
    return urls(spark, d).select("id", U.readable(F.col("url")).alias("label"), U.image_file(F.col("url")).alias("file"))


_ADDRESS_SQL = f"""
    SELECT id, pq AS path, status_code AS status, CASE WHEN lower(regexp_extract(redirect_url, '^[a-z]+://([^/?#:]+)', 1)) = lower(regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1)) THEN rq END AS redirect
    FROM (SELECT *, {SA.PATH_SQL} || CASE WHEN {SA._Q} = '' THEN '' ELSE '?' || {SA._Q} END AS pq, {SA.PATH_SQL.replace("url", "redirect_url")} || CASE WHEN {SA._Q.replace("url", "redirect_url")} = '' THEN '' ELSE '?' || {SA._Q.replace("url", "redirect_url")} END AS rq FROM urls)
    WHERE is_internal AND state = 1 AND (status_code >= 300 OR status_code IS NULL)"""
_REWRITE_SQL = """
    SELECT id, CASE WHEN gone = '' AND new = '' THEN NULL
        WHEN new = '' AND NOT contains(gone, '/') THEN 'removed:' || CASE WHEN regexp_matches(gone, '^-?[0-9]+$') THEN regexp_replace(gone, '[0-9]+', '#') ELSE gone END
        WHEN gone = '' AND NOT contains(new, '/') THEN 'inserted:' || CASE WHEN regexp_matches(new, '^-?[0-9]+$') THEN regexp_replace(new, '[0-9]+', '#') ELSE new END
        WHEN starts_with(right(a, t), '/') AND t > 2 THEN 'moved:' || left(a, length(a) - t) || '>' || left(b, length(b) - t) END AS kind
    FROM (SELECT *, substring(a, h + 1, length(a) - h - t) AS gone, substring(b, h + 1, length(b) - h - t) AS new FROM (
        SELECT *, list_max(list_filter(range(0, least(length(a), length(b)) - h + 1), lambda i: i = 0 OR right(a, i) = right(b, i))) AS t FROM (
            SELECT id, a, b, list_max(list_filter(range(0, least(length(a), length(b)) + 1), lambda i: left(a, i) = left(b, i))) AS h
            FROM (SELECT id, lower(path) AS a, lower(redirect) AS b FROM x WHERE redirect IS NOT NULL))))"""


@query(f"WITH x AS ({_ADDRESS_SQL}) SELECT id, kind FROM ({_REWRITE_SQL}) WHERE kind IS NOT NULL")
def st14_rewrites(spark: SparkSession, d: str) -> DataFrame:
    """How redirecting addresses were rewritten."""
    a = patterns.addresses(urls(spark, d))
    return a.select("id", text.rewrite_kind(F.col("path"), F.col("redirect")).alias("kind")).filter("kind IS NOT NULL")


@query(f"""
    WITH x AS ({_ADDRESS_SQL}), r AS ({_REWRITE_SQL}),
    d AS (SELECT id, lower(redirect) AS reason FROM x WHERE redirect IS NOT NULL QUALIFY count(*) OVER (PARTITION BY lower(redirect)) >= 3),
    w AS (SELECT id, kind AS reason FROM r WHERE kind IS NOT NULL AND id NOT IN (SELECT id FROM d) QUALIFY count(*) OVER (PARTITION BY kind) >= 3),
    l AS (SELECT id, path FROM x WHERE coalesce(status >= 400, redirect IS NULL) AND id NOT IN (SELECT id FROM d) AND id NOT IN (SELECT id FROM w)),
    n AS (SELECT id FROM l WHERE regexp_matches(path, '^(?:/[a-z]{{2}}(?:-[a-z]{{2,4}})?)?/products/[0-9]+/?$') QUALIFY count(*) OVER () >= 3),
    c AS (SELECT id FROM l WHERE regexp_matches(path, '(?i)^(?:/[a-z]{{2}}(?:-[a-z]{{2,4}})?)?/collections/[^/?#]+/products/[^/?#]+') AND id NOT IN (SELECT id FROM n) QUALIFY count(*) OVER () >= 3)
    SELECT id, 'destination' AS kind, reason FROM d UNION ALL SELECT id, 'rewrite', reason FROM w UNION ALL SELECT id, 'product_numbers', 'product_numbers' FROM n UNION ALL SELECT id, 'removed_from_collections', 'removed_from_collections' FROM c""")
def fx4_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Broken and redirecting addresses by the reason they share."""
    return patterns.reasons(patterns.addresses(urls(spark, d)))


_TARGET_SQL = SA.ORACLES["rules_link_targets"].replace("SELECT DISTINCT k.code, l.source_id AS url_id", "SELECT k.code, k.id, count(DISTINCT l.source_id) AS pages, count(*) AS links") + " GROUP BY ALL"


@query(_TARGET_SQL)
def fx2_target_fixes(spark: SparkSession, d: str) -> DataFrame:
    """One fix per bad target, with how many pages link to it and how often."""
    return cross_rules.target_fixes(table(spark, d, "links"), urls(spark, d))


@query(f"WITH f AS ({_TARGET_SQL}), c AS ({_CLEAN}) SELECT f.code, coalesce(c.clean, u.url) AS address, count(*) AS targets, sum(f.links) AS links FROM f JOIN urls u ON u.id = f.id LEFT JOIN c ON c.id = f.id GROUP BY ALL")
def fx5_merged_targets(spark: SparkSession, d: str) -> DataFrame:
    """Fixes whose addresses are the same but for tracking are one."""
    f = fx2_target_fixes(spark, d).join(urls(spark, d).select("id", "url"), "id")
    clean = F.coalesce(U.without_tracking(F.col("url")), F.col("url"))
    return f.groupBy("code", clean.alias("address")).agg(F.count(F.lit(1)).alias("targets"), F.sum("links").alias("links"))


_SEVERITIES = ", ".join(f"('{r.code}', '{r.severity}')" for r in CATALOGUE.values())


@query(f"WITH i AS ({SA.ROW_RULES_SQL}), s(code, severity) AS (VALUES {_SEVERITIES}) SELECT url_id, count(*) AS issues, min(severity) AS first_severity, string_agg(code, ', ' ORDER BY code) AS codes FROM i JOIN s USING (code) GROUP BY url_id")
def fx12_by_page(spark: SparkSession, d: str) -> DataFrame:
    """What is left per page: its issues in one row."""
    from auditmill.audit.catalogue import frame

    met = SA.rules_row(spark, d).join(F.broadcast(frame(spark).select("code", "severity")), "code")
    return met.groupBy("url_id").agg(F.count(F.lit(1)).alias("issues"), F.min("severity").alias("first_severity"), F.array_join(F.array_sort(F.collect_list("code")), ", ").alias("codes"))


_DUP_SQL = SA.DUPLICATES_SQL.replace("SELECT code, url_id FROM d QUALIFY count(*) OVER (PARTITION BY code, v) > 1", "SELECT code, v AS value, count(*) AS pages, min(url_id) AS first_page FROM d GROUP BY code, v HAVING count(*) > 1")


@query(_DUP_SQL)
def fx9_duplicate_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Pages that share a value, a row per value."""
    pages = SA.facts(spark, d).filter(cross_rules.duplicate_candidates())
    cells = F.array(*[F.struct(F.lit(c).alias("code"), F.col(f).alias("value"), F.col("id").alias("url_id")) for f, c in (("title", "title_duplicate"), ("meta_description", "meta_description_duplicate"), ("h1", "h1_duplicate"))])
    g = pages.select(F.inline(cells)).filter("value <> ''").groupBy("code", "value").agg(F.count(F.lit(1)).alias("pages"), F.min("url_id").alias("first_page"))
    return g.filter("pages > 1")


_SAID = {
    "title_over_60_characters": ("concat(length(title), ' characters: ', title)", "title"),
    "title_below_30_characters": ("concat(length(title), ' characters: ', title)", "title"),
    "title_same_as_h1": ("concat('title and h1: ', title)", "title"),
    "meta_description_over_155_characters": ("concat(length(meta_description), ' characters: ', meta_description)", "meta_description"),
    "meta_description_below_70_characters": ("concat(length(meta_description), ' characters: ', meta_description)", "meta_description"),
    "h1_multiple": ("concat(h1_count, ' h1, the first: ', h1)", "h1"),
    "content_low_word_count": ("concat(word_count, ' words')", "word_count"),
    "response_internal_3xx": ("concat(status_code, ' to ', coalesce(redirect_url, 'nowhere'))", "status_code"),
    "response_internal_4xx": ("concat(status_code, ' ', coalesce(status_text, ''))", "status_code"),
    "links_high_crawl_depth": ("concat(depth, ' clicks from the start')", "depth"),
}


@query(f"SELECT i.code, i.url_id, CASE i.code " + " ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in _SAID.items()) + f" END AS said FROM ({SA.ROW_RULES_SQL}) i JOIN ({SA.PAGE_SQL}) f ON f.id = i.url_id WHERE i.code IN ({', '.join(repr(k) for k in _SAID)})")
def fx18_evidence(spark: SparkSession, d: str) -> DataFrame:
    """What on a page an issue is about, in words."""
    said = F.expr("CASE code " + " ".join(f"WHEN '{k}' THEN {v}" for k, (v, _) in _SAID.items()) + " END")
    met = SA.rules_row(spark, d).filter(F.col("code").isin(*_SAID)).join(SA.facts(spark, d).withColumnRenamed("id", "url_id"), "url_id")
    return met.select("code", "url_id", said.alias("said"))


@query("WITH l AS (SELECT DISTINCT target_id, source_id FROM links WHERE type = 0), n AS (SELECT target_id, count(*) AS n FROM l GROUP BY 1) SELECT l.target_id, l.source_id, n.n > 25 AS more FROM l JOIN n USING (target_id) QUALIFY row_number() OVER (PARTITION BY l.target_id ORDER BY l.source_id) <= 25")
def fx18_linked_from(spark: SparkSession, d: str) -> DataFrame:
    """Up to 25 pages that link to a target, and whether there are more.

    A group's first 26 are enough to know, so the sort of a crowded target is all it costs.
    """
    one = table(spark, d, "links").filter("type = 0").select("target_id", "source_id").distinct()
    first = cut(tables.top_per_group(one, ["target_id"], [F.col("source_id").asc()], 26))
    more = first.groupBy("target_id").agg((F.max("rank") > 25).alias("more"))
    return first.filter("rank <= 25").join(more, "target_id").select("target_id", "source_id", "more")


@query("WITH " + SA._SIDES + f""", a AS (SELECT url, {SA._BAD} AS code FROM o), b AS (SELECT url, {SA._BAD} AS code FROM n),
    z AS (SELECT CASE WHEN o.url IS NULL THEN 'added' ELSE 'removed' END AS what FROM o FULL JOIN n ON o.url = n.url WHERE o.url IS NULL OR n.url IS NULL
        UNION ALL SELECT 'changed_status_code' FROM o JOIN n ON o.url = n.url WHERE o.status_code <> n.status_code UNION ALL SELECT 'changed_indexability' FROM o JOIN n ON o.url = n.url WHERE o.indexability <> n.indexability
        UNION ALL SELECT 'new_issues' FROM b JOIN a ON a.url = b.url WHERE b.code IS NOT NULL AND a.code IS DISTINCT FROM b.code UNION ALL SELECT 'fixed_issues' FROM a JOIN b ON a.url = b.url WHERE a.code IS NOT NULL AND a.code IS DISTINCT FROM b.code)
    SELECT what, count(*) AS n FROM z GROUP BY what""")
def compare_summary(spark: SparkSession, d: str) -> DataFrame:
    """Exact counts of everything that differs between every host's first and last complete crawl."""
    old, new = SA.first_and_last(spark, d)
    return compare.summary(compare.compared(old, new, ["url"], ["status_code", "indexability"]), SA.jn8_issue_changes(spark, d))


@query("WITH " + SA._SIDES + f""", a AS (SELECT url AS url_id, {SA._BAD} AS code FROM o), b AS (SELECT url AS url_id, {SA._BAD} AS code, status_code <> '' AS answered FROM n)
    SELECT a.code, count(*) FILTER (WHERE answered AND b.code IS DISTINCT FROM a.code) AS resolved, count(*) FILTER (WHERE answered AND b.code = a.code) AS remaining, count(*) FILTER (WHERE NOT answered) AS unanswered FROM a JOIN b USING (url_id) WHERE a.code IS NOT NULL GROUP BY a.code""")
def ag22_recheck(spark: SparkSession, d: str) -> DataFrame:
    """What became of the first crawl's failures in the last one."""
    old, new = SA.first_and_last(spark, d)
    bad = lambda s: s.select(measures.status_class(F.col("status_code")).alias("code"), F.col("url").alias("url_id")).filter(F.col("code").isin("4xx", "5xx"))
    return store.recheck(bad(old), bad(new), new.select(F.col("url").alias("url_id"), F.col("status_code").isNotNull().alias("answered")))


@query("SELECT id, CASE WHEN h THEN 2 ELSE state END AS state, CASE WHEN NOT h THEN status_code END AS status_code, CASE WHEN NOT h THEN size_bytes END AS size_bytes FROM (SELECT *, coalesce(is_internal AND state = 1 AND status_code = 429, false) AS h FROM urls)")
def refusals_corrected(spark: SparkSession, d: str) -> DataFrame:
    """URLs with throttled answers taken back."""
    return store.corrected_refusals(urls(spark, d), measures.is_throttled(F.col("status_code"))).select("id", "state", "status_code", "size_bytes")


ROBOTS = "User-agent: *\nDisallow: /help/\nAllow: /help/s\nDisallow: *utm_source=\nDisallow: /blogs/*-rug$\n\nUser-agent: otherbot\nDisallow: /\n"


@query(f"""
    WITH t AS (SELECT DISTINCT url, {SA.PATH_SQL} || CASE WHEN {SA._Q} = '' THEN '' ELSE '?' || {SA._Q} END AS p FROM urls)
    SELECT url, CASE WHEN contains(p, 'utm_source=') THEN false WHEN regexp_matches(p, '^/blogs/.*-rug$') THEN false WHEN starts_with(p, '/help/s') THEN true WHEN starts_with(p, '/help/') THEN false ELSE true END AS allowed FROM t""")
def fi9_robots(spark: SparkSession, d: str) -> DataFrame:
    """Every address against a robots.txt that all origins have."""
    u = urls(spark, d).select("url", U.origin(F.col("url")).alias("origin"), U.path_and_query(F.col("url")).alias("target"))
    files = u.select("origin").distinct().withColumn("body", F.lit(ROBOTS))
    return robots.verdicts(u, robots.rules(files), "auditbot").select("url", "allowed")
