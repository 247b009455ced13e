"""Rules one row decides, as one projection: conditions become codes, codes become rows.

``facts`` has one row per URL. Columns it lacks are taken as null, so the same
rules run over full pages and over tables that hold only some of the fields.
A null condition doesn't hold.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.functions import measures, text, urls

TITLE_PIXELS, TITLE_SIZE = 561.0, 20.0
DESCRIPTION_PIXELS, DESCRIPTION_SIZE = 985.0, 14.0

LINK = "array<struct<href:string,type:int,text:string,flags:bigint,is_internal:boolean>>"
# Fact columns and their types; only these are read.
FACTS = {
    "id": "bigint", "url": "string", "is_internal": "boolean", "blocked_by_robots": "boolean", "failed": "boolean", "status_code": "int", "depth": "int",
    "resource_type": "int", "response_ms": "double", "size_bytes": "bigint", "indexability": "int", "headers": "map<string,string>", "x_robots_tag": "string",
    "parsed": "boolean", "site_is_https": "boolean", "title": "string", "title_count": "int", "meta_description": "string", "meta_description_count": "int",
    "h1": "string", "h1_count": "int", "h2_count": "int", "meta_robots": "string", "meta_refresh": "string", "word_count": "int", "internal_outlinks": "int",
    "links": LINK, "canonicals": "array<struct<href:string,in_head:boolean,resolved:string>>", "hreflang": "array<struct<lang:string,href:string,resolved:string>>",
    "json_ld_errors": "int", "render_error": "string", "js_rendered": "boolean", "raw_word_count": "int", "raw_link_count": "int", "rendered_link_count": "int",
    "raw_title": "string", "raw_meta_description": "string", "raw_canonical": "string", "rendered_canonical": "string",
    "product": "struct<variants:int,with_price:int,with_availability:int,with_identifier:int,images:int>",
}


def complete(facts: DataFrame) -> DataFrame:
    """``facts`` with every fact column, null where it had none."""
    have = {c.lower() for c in facts.columns}
    return facts.select(*[F.col(c).cast(t).alias(c) if c in have else F.lit(None).cast(t).alias(c) for c, t in FACTS.items()])


def indexability(failed: Column | None = None) -> tuple[Column, Column]:
    """(code, reason) of a URL by the facts, the first reason that holds."""
    status = F.col("status_code")
    noindex = text.robots_directive(F.col("meta_robots"), F.col("x_robots_tag"), "noindex")
    targets = F.array_distinct(F.transform(F.coalesce("canonicals", F.array().cast(FACTS["canonicals"])), lambda c: c["resolved"]))
    elsewhere = (F.size(targets) == 1) & (F.get(targets, F.lit(0)) != F.col("url"))
    why = (
        F.when(F.coalesce("blocked_by_robots", F.lit(False)), "Blocked by robots.txt")
        .when(F.coalesce("failed", F.lit(False)) | status.isNull(), "No response")
        .when(status.between(300, 399), "Redirected")
        .when(status.between(400, 499), "Client error")
        .when(status >= 500, "Server error")
        .when(~status.between(200, 299), "Non-200 status")
        .when(noindex, "Noindex")
        .when(elsewhere, "Canonicalised")
        .otherwise("Indexable")
    )
    return F.when(why == "Indexable", 1).otherwise(2), why


def conditions(ecommerce: bool = False) -> dict[str, Column]:
    """Code to condition over complete facts."""
    c = F.col
    internal, status = c("is_internal"), c("status_code")
    ok = internal & status.between(200, 299)
    page = ok & c("parsed")
    indexable = page & (c("indexability") == 1)
    answered = ~F.coalesce(c("blocked_by_robots"), F.lit(False)) & ~F.coalesce(c("failed"), F.lit(False))
    refused = measures.is_refused(status, c("headers"))
    title, desc, h1 = c("title"), c("meta_description"), c("h1")
    has = lambda x: F.coalesce(x, F.lit("")) != ""
    links = F.coalesce(c("links"), F.array().cast(LINK))
    flag = lambda link, bit: link["flags"].bitwiseAND(F.lit(bit).cast("long")) != 0
    anchors = F.filter(links, lambda x: (x["type"] == 0) & x["is_internal"])
    images = F.filter(links, lambda x: x["type"] == 1)
    canonicals = F.coalesce(c("canonicals"), F.array().cast(FACTS["canonicals"]))
    targets = F.array_distinct(F.transform(canonicals, lambda x: x["resolved"]))
    langs = F.coalesce(c("hreflang"), F.array().cast(FACTS["hreflang"]))
    header = lambda name: F.element_at(F.coalesce(c("headers"), F.create_map().cast("map<string,string>")), F.lit(name))
    https = urls.scheme(c("url")) == "https"
    noindex = text.robots_directive(c("meta_robots"), c("x_robots_tag"), "noindex")
    nofollow = text.robots_directive(c("meta_robots"), c("x_robots_tag"), "nofollow")
    p = urls.path(c("url"))
    is_page = internal & (c("resource_type") == 0) & status.between(200, 299)
    rendered = page & c("js_rendered")
    differs = lambda a, b: ~F.coalesce(c(a), F.lit("")).eqNullSafe(F.coalesce(c(b), F.lit("")))
    out = {
        "response_internal_blocked_robots": internal & c("blocked_by_robots"),
        "response_internal_no_response": internal & c("failed") & ~F.coalesce(c("blocked_by_robots"), F.lit(False)),
        "response_internal_3xx": internal & answered & status.between(300, 399),
        "response_internal_4xx": internal & answered & status.between(400, 499),
        "response_internal_5xx": internal & answered & status.between(500, 599),
        "response_external_broken": ~internal & (F.coalesce(c("failed"), F.lit(False)) | (status >= 400)) & ~refused,
        "response_external_unverified": ~internal & refused,
        "response_slow": page & (c("response_ms") > 1000),
        "response_meta_refresh": page & has(c("meta_refresh")),
        "links_internal_nofollow": page & F.exists(anchors, lambda x: flag(x, 1)),
        "links_no_internal_outlinks": indexable & (c("internal_outlinks") == 0),
        "links_non_descriptive_anchor": page & F.exists(anchors, lambda x: F.lower(text.collapse(x["text"])).isin(*text.GENERIC_ANCHORS)),
        "links_high_crawl_depth": page & (c("depth") >= 4),
        "url_uppercase": is_page & p.rlike(r"\p{Lu}"),
        "url_underscores": is_page & p.contains("_"),
        "url_over_115_characters": is_page & (F.length(c("url")) > 115),
        "url_http_on_https_site": is_page & c("site_is_https") & (urls.scheme(c("url")) == "http"),
        "security_mixed_content": page & https & F.exists(links, lambda x: x["type"].isin(1, 2, 3, 7) & F.lower(x["href"]).startswith("http://")),
        "security_missing_hsts": page & https & c("headers").isNotNull() & header("strict-transport-security").isNull(),
        "security_missing_nosniff": page & c("headers").isNotNull() & ~F.coalesce(F.lower(header("x-content-type-options")).contains("nosniff"), F.lit(False)),
        "security_missing_csp": page & c("headers").isNotNull() & header("content-security-policy").isNull(),
        "title_missing": page & ~has(title),
        "title_multiple": page & has(title) & (c("title_count") > 1),
        "title_over_60_characters": page & (F.length(title) > 60),
        "title_over_561_pixels": page & has(title) & (text.pixel_width_udf(TITLE_SIZE)(title) > TITLE_PIXELS),
        "title_below_30_characters": page & has(title) & (F.length(title) < 30),
        "title_same_as_h1": page & has(title) & (F.lower(title) == F.lower(h1)),
        "meta_description_missing": page & ~has(desc),
        "meta_description_multiple": page & has(desc) & (c("meta_description_count") > 1),
        "meta_description_over_155_characters": page & (F.length(desc) > 155),
        "meta_description_over_985_pixels": page & has(desc) & (text.pixel_width_udf(DESCRIPTION_SIZE)(desc) > DESCRIPTION_PIXELS),
        "meta_description_below_70_characters": page & has(desc) & (F.length(desc) < 70),
        "h1_missing": page & ~has(h1),
        "h1_multiple": page & has(h1) & (c("h1_count") > 1),
        "h1_over_70_characters": page & (F.length(h1) > 70),
        "h2_missing": page & (c("h2_count") == 0),
        "content_low_word_count": indexable & (c("word_count") < 200),
        "images_missing_alt_attribute": page & F.exists(images, lambda x: flag(x, 8)),
        "images_missing_alt_text": page & F.exists(images, lambda x: ~flag(x, 8) & (F.coalesce(x["text"], F.lit("")) == "")),
        "images_alt_over_100_characters": page & F.exists(images, lambda x: F.length(x["text"]) > 100),
        "images_missing_dimensions": page & F.exists(images, lambda x: flag(x, 16)),
        "images_over_100kb": ok & (c("resource_type") == 1) & (c("size_bytes") > 102_400),
        "canonical_missing": indexable & c("canonicals").isNotNull() & (F.size(canonicals) == 0),
        "canonical_canonicalised": page & (c("indexability") == 2) & F.exists(targets, lambda t: t != c("url")) & ~noindex,
        "canonical_multiple_conflicting": page & (F.size(targets) > 1),
        "canonical_relative": page & F.exists(canonicals, lambda x: ~F.lower(x["href"]).rlike("^https?://")),
        "canonical_outside_head": page & F.exists(canonicals, lambda x: ~x["in_head"]),
        "directives_noindex": page & noindex,
        "directives_nofollow": page & nofollow,
        "hreflang_invalid_code": page & F.exists(langs, lambda x: ~text.valid_hreflang(x["lang"])),
        "hreflang_missing_self_reference": page & (F.size(langs) > 0) & ~F.exists(langs, lambda x: x["resolved"] == c("url")),
        "hreflang_missing_x_default": page & (F.size(langs) > 0) & ~F.exists(langs, lambda x: F.lower(F.trim(x["lang"])) == "x-default"),
        "javascript_render_failed": page & has(c("render_error")),
        "javascript_content_only_rendered": rendered & ((c("word_count") > c("raw_word_count") + 50) | (c("word_count") > c("raw_word_count") * 5 / 4)),
        "javascript_links_only_rendered": rendered & (c("rendered_link_count") > c("raw_link_count")),
        "javascript_title_changed": rendered & differs("title", "raw_title"),
        "javascript_meta_description_changed": rendered & differs("meta_description", "raw_meta_description"),
        "javascript_canonical_changed": rendered & differs("rendered_canonical", "raw_canonical"),
        "structured_data_parse_error": page & (c("json_ld_errors") > 0),
    }
    if ecommerce:
        product = c("product")
        out |= {
            "ecom_product_schema_missing": page & urls.product_handle(c("url")).isNotNull() & product.isNull(),
            "ecom_product_no_price": page & (product["with_price"] < product["variants"]),
            "ecom_product_no_availability": page & (product["with_availability"] < product["variants"]),
            "ecom_product_no_image": page & (product["images"] == 0),
            "ecom_product_no_identifier": page & (product["with_identifier"] == 0),
        }
    return out


def audit(facts: DataFrame, ecommerce: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """(code, url_id) of every row rule that holds."""
    rules = {k: v for k, v in conditions(ecommerce).items() if k not in skip}
    codes = F.filter(F.array(*[F.when(cond, F.lit(code)) for code, cond in rules.items()]), lambda x: x.isNotNull())
    return complete(facts).select(F.col("id").alias("url_id"), F.explode(codes).alias("code")).select("code", "url_id")
