"""Rules the whole crawl decides: duplicates, link targets, canonicals, hreflang, sitemaps, redirects, speed.

All frames are named as their tables. Results are (code, url_id), each once.
Joins on link targets are left to the optimizer, with skew handled at run time;
reductions to distinct sources come right after them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions import measures, urls as U


def issues(df: DataFrame, code: str, key: str = "id") -> DataFrame:
    return df.select(F.lit(code).alias("code"), F.col(key).alias("url_id")).distinct()


def union(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def indexable_html() -> Column:
    return F.col("is_internal") & (F.col("state") == 1) & (F.col("resource_type") == 0) & (F.col("indexability") == 1)


def duplicate_candidates() -> Column:
    return indexable_html() & ~U.later_page(F.col("url"))


def duplicates(pages: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Pages that share a non-empty value of a column with another; ``columns`` gives each its code.

    ``pages`` has id and the columns. Counting comes first and is combined on
    the map side, so one value on a third of all pages is no burden.
    """
    cells = F.array(*[F.struct(F.lit(code).alias("code"), F.col(column).cast("string").alias("value"), F.col("id").alias("url_id")) for column, code in columns.items()])
    rows = pages.select(F.inline(cells)).filter("value <> ''")
    shared = rows.groupBy("code", "value").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(shared, ["code", "value"], "left_semi").select("code", "url_id")


def bad_targets(urls: DataFrame) -> DataFrame:
    """(target_id, code) of crawled URLs that a page should not link to."""
    broken = measures.is_broken(F.col("status_code"), F.col("blocked_by_robots"))
    refused = measures.is_refused(F.col("status_code"))
    by_design = U.redirects_by_design(F.col("url")) | F.coalesce(U.redirects_by_design(F.col("redirect_url")), F.lit(False))
    kind = F.array_compact(
        F.array(
            F.when(F.col("is_internal") & broken, "links_to_broken_internal"),
            F.when(F.col("is_internal") & F.col("status_code").between(300, 399) & ~by_design, "links_to_redirect_internal"),
            F.when(~F.col("is_internal") & broken & ~refused, "links_to_broken_external"),
            F.when(~F.col("is_internal") & refused, "links_to_unverified_external"),
        )
    )
    return urls.filter(F.col("state") == 1).select(F.col("id").alias("target_id"), F.explode(kind).alias("code"))


def link_targets(links: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages that link to broken, redirecting or unverifiable targets."""
    rows = links.filter(F.col("type") == 0).select("source_id", "target_id")
    return rows.join(bad_targets(urls), "target_id").select("code", F.col("source_id").alias("url_id")).distinct()


def target_fixes(links: DataFrame, urls: DataFrame) -> DataFrame:
    """(code, id, pages, links) of bad targets that are linked; links are counted before they are joined, so a hot target is one row."""
    pairs = links.filter(F.col("type") == 0).groupBy("target_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    counted = pairs.groupBy("target_id").agg(F.count(F.lit(1)).alias("pages"), F.sum("n").alias("links"))
    return counted.join(bad_targets(urls), "target_id").select("code", F.col("target_id").alias("id"), "pages", "links")


def inlink_counts(links: DataFrame, left_out: Sequence[int] = (4, 5)) -> DataFrame:
    """(id, inlinks, unique_inlinks); canonical and hreflang edges aren't links."""
    rows = links.filter(~F.col("type").isin(*left_out)).groupBy("target_id", "source_id").agg(F.count(F.lit(1)).alias("n"))
    return rows.groupBy(F.col("target_id").alias("id")).agg(F.sum("n").alias("inlinks"), F.count(F.lit(1)).alias("unique_inlinks"))


def canonical_targets(urls: DataFrame, canonicals: DataFrame) -> DataFrame:
    """Pages whose canonical (id, canonical_id) is another URL that is no good target."""
    t = urls.select(F.col("id").alias("canonical_id"), "status_code", "indexability", "state")
    met = canonicals.filter("canonical_id <> id").join(t, "canonical_id").filter("state = 1")
    good = F.col("status_code").between(200, 299)
    return issues(met.filter(~F.coalesce(good, F.lit(False))), "canonical_target_non_200").unionByName(issues(met.filter(good & (F.col("indexability") == 2)), "canonical_target_non_indexable"))


def hreflang_targets(hreflang: DataFrame, urls: DataFrame) -> DataFrame:
    """Pages with hreflang entries (source_id, lang, target_id) to bad targets, or without a way back."""
    t = urls.filter("state = 1").select(F.col("id").alias("target_id"), "status_code")
    bad = hreflang.join(t, "target_id").filter(~F.coalesce(F.col("status_code").between(200, 299), F.lit(False)))
    back = hreflang.select(F.col("source_id").alias("target_id"), F.col("target_id").alias("source_id")).distinct()
    alone = hreflang.filter("source_id <> target_id").join(back, ["source_id", "target_id"], "left_anti")
    return issues(bad, "hreflang_non_200_target", "source_id").unionByName(issues(alone, "hreflang_missing_return_links", "source_id"))


def sitemap_audit(urls: DataFrame, listed: DataFrame, inlinks: DataFrame) -> DataFrame:
    """Sitemap coverage; ``listed`` has the ids sitemaps name. Nothing is missing where no sitemap was read."""
    u = urls.filter(F.col("is_internal") & (F.col("state") == 1))
    inside = u.join(listed.select("id").distinct(), "id", "left_semi")
    ok = F.col("status_code").between(200, 299)
    counted = inside.join(inlinks.select("id", "inlinks"), "id", "left")
    parts = [
        issues(inside.filter(~F.coalesce(ok, F.lit(False))), "sitemap_non_200"),
        issues(inside.filter(ok & (F.col("indexability") == 2)), "sitemap_non_indexable"),
        issues(counted.filter(ok & (F.coalesce("inlinks", F.lit(0)) == 0)), "sitemap_orphan"),
    ]
    if not listed.isEmpty():
        parts.append(issues(u.filter(indexable_html()).join(listed.select("id").distinct(), "id", "left_anti"), "sitemap_missing"))
    return union(parts)


def redirect_issues(chains: DataFrame) -> DataFrame:
    """``chains`` has (id, depth, is_cycle) of every redirecting URL."""
    return issues(chains.filter("is_cycle = 1"), "redirect_loop").unionByName(issues(chains.filter("is_cycle = 0 AND depth >= 2"), "redirect_chain"))


def speed(measured: DataFrame) -> DataFrame:
    """``measured`` has url_id and mobile and desktop score, lcp_ms, cls and tbt_ms (m_*, d_*)."""
    either = lambda name, test: F.coalesce(test(F.col(f"m_{name}")), F.lit(False)) | F.coalesce(test(F.col(f"d_{name}")), F.lit(False))
    low = either("score", lambda c: c < 50)
    rules = {
        "lh_low_score": low,
        "lh_needs_improvement": either("score", lambda c: c < 90) & ~low,
        "lh_poor_lcp": either("lcp_ms", lambda c: c > 4000),
        "lh_poor_cls": either("cls", lambda c: c > 0.25),
        "lh_high_tbt": either("tbt_ms", lambda c: c > 600),
    }
    return measured.select("url_id", F.explode(F.array_compact(F.array(*[F.when(v, F.lit(k)) for k, v in rules.items()]))).alias("code")).select("code", "url_id")


def product_paths(urls: DataFrame, links: DataFrame) -> DataFrame:
    """Products served below a collection as well, and the pages that link to such addresses."""
    doubled = U.path(F.col("url")).rlike("(?i)/collections/.*/products/")
    dup = urls.filter(indexable_html() & (F.col("status_code") == 200) & doubled)
    to = urls.filter(F.col("is_internal") & doubled).select(F.col("id").alias("target_id"))
    linked = links.filter("type = 0").join(to, "target_id", "left_semi")
    return issues(dup, "ecom_product_duplicate_path").unionByName(issues(linked, "ecom_links_to_duplicate_product", "source_id"))


def product_reach(urls: DataFrame, links: DataFrame, complete: bool = True) -> DataFrame:
    """Products no page links to, and products no collection lists.

    Found only on complete crawls; where more than half of at least ten
    products would be named, the crawl says nothing about them.
    """
    handle = U.product_handle(F.col("url"))
    products = urls.filter(indexable_html()).withColumn("handle", handle).filter(F.col("handle").isNotNull()).select("id", "handle")
    sides = urls.filter("is_internal").select(F.col("id"), "url")
    edges = (
        links.filter("type = 0")
        .join(sides.select(F.col("id").alias("target_id"), handle.alias("handle")).filter(F.col("handle").isNotNull()), "target_id")
        .join(sides.select(F.col("id").alias("source_id"), handle.alias("from_handle"), U.is_collection(F.col("url")).alias("from_list")), "source_id")
        .filter(~F.col("handle").eqNullSafe(F.col("from_handle")))
        .groupBy("handle")
        .agg(F.bool_or("from_list").alias("listed"))
    )
    flagged = products.join(edges, "handle", "left")
    counts = flagged.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("listed").isNull()).alias("orphans"), F.count_if(F.col("listed") == False).alias("unlisted"), F.count_if("listed").alias("listed")).first()  # noqa: E712
    empty = issues(flagged.filter(F.lit(False)), "ecom_product_orphan")
    if not complete or not counts.listed:
        return empty
    few = lambda k: not (counts.n >= 10 and k > counts.n / 2)
    parts = [empty]
    if few(counts.orphans):
        parts.append(issues(flagged.filter(F.col("listed").isNull()), "ecom_product_orphan"))
    if few(counts.unlisted):
        parts.append(issues(flagged.filter(~F.col("listed")), "ecom_product_no_collection"))
    return union(parts)
