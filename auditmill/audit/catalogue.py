"""The 92 rules as data: code, severity, category, and whether one row decides (row) or the whole crawl (post)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

# E error, W warning, N notice.
RULES = """
response_internal_blocked_robots W responseCodes row
response_internal_no_response E responseCodes row
response_internal_3xx W responseCodes row
response_internal_4xx E responseCodes row
response_internal_5xx E responseCodes row
response_external_broken W responseCodes row
response_external_unverified N responseCodes row
response_slow N responseCodes row
response_meta_refresh W responseCodes row
redirect_chain W responseCodes post
redirect_loop E responseCodes post
links_to_broken_internal E links post
links_to_redirect_internal N links post
links_to_broken_external W links post
links_to_unverified_external N links post
links_internal_nofollow N links row
links_no_internal_outlinks W links row
links_non_descriptive_anchor N links row
links_high_crawl_depth N links row
url_uppercase N url row
url_underscores N url row
url_over_115_characters N url row
url_http_on_https_site W url row
security_mixed_content W security row
security_missing_hsts N security row
security_missing_nosniff N security row
security_missing_csp N security row
title_missing E titles row
title_multiple W titles row
title_duplicate W titles post
title_over_60_characters N titles row
title_over_561_pixels W titles row
title_below_30_characters N titles row
title_same_as_h1 N titles row
meta_description_missing W metaDescription row
meta_description_multiple W metaDescription row
meta_description_duplicate W metaDescription post
meta_description_over_155_characters N metaDescription row
meta_description_over_985_pixels N metaDescription row
meta_description_below_70_characters N metaDescription row
h1_missing W h1 row
h1_multiple N h1 row
h1_duplicate N h1 post
h1_over_70_characters N h1 row
h2_missing N h2 row
content_low_word_count N content row
content_near_duplicate W content post
content_exact_duplicate W content post
images_missing_alt_attribute W images row
images_missing_alt_text N images row
images_alt_over_100_characters N images row
images_missing_dimensions N images row
images_over_100kb W images row
canonical_missing N canonicals row
canonical_canonicalised N canonicals row
canonical_multiple_conflicting E canonicals row
canonical_relative N canonicals row
canonical_outside_head W canonicals row
canonical_target_non_200 E canonicals post
canonical_target_non_indexable W canonicals post
directives_noindex W directives row
directives_nofollow N directives row
hreflang_invalid_code E hreflang row
hreflang_missing_self_reference N hreflang row
hreflang_missing_x_default N hreflang row
hreflang_missing_return_links W hreflang post
hreflang_non_200_target W hreflang post
javascript_render_failed E javaScript row
javascript_content_only_rendered W javaScript row
javascript_links_only_rendered W javaScript row
javascript_title_changed N javaScript row
javascript_meta_description_changed N javaScript row
javascript_canonical_changed W javaScript row
sitemap_non_200 E sitemaps post
sitemap_non_indexable W sitemaps post
sitemap_orphan W sitemaps post
sitemap_missing N sitemaps post
lh_low_score W speed post
lh_needs_improvement N speed post
lh_poor_lcp W speed post
lh_poor_cls W speed post
lh_high_tbt N speed post
structured_data_parse_error E structuredData row
ecom_product_schema_missing W ecommerce row
ecom_product_no_price E ecommerce row
ecom_product_no_availability W ecommerce row
ecom_product_no_image W ecommerce row
ecom_product_no_identifier N ecommerce row
ecom_product_duplicate_path W ecommerce post
ecom_links_to_duplicate_product N ecommerce post
ecom_product_orphan W ecommerce post
ecom_product_no_collection N ecommerce post
"""

SEVERITIES = {"E": "error", "W": "warning", "N": "notice"}
SEVERITY_RANK = {"error": 0, "warning": 1, "notice": 2}
SHOWN_CATEGORIES = ("responseCodes", "canonicals", "directives", "sitemaps")
HIDDEN_CODES = ("response_slow", "canonical_canonicalised")
HIDDEN_ON_LATER_PAGES = ("sitemap_missing", "sitemap_orphan")


@dataclass(frozen=True)
class Rule:
    """One rule. ``group`` is where reports list it: by severity, or with speed and sitemaps apart."""

    code: str
    severity: str
    category: str
    kind: str

    @property
    def group(self) -> str:
        return {"speed": "lighthouse", "sitemaps": "sitemap"}.get(self.category, self.severity)

    @property
    def shown_when_non_indexable(self) -> bool:
        return self.category in SHOWN_CATEGORIES and self.code not in HIDDEN_CODES

    @property
    def shown_on_later_pages(self) -> bool:
        return self.shown_when_non_indexable and self.code not in HIDDEN_ON_LATER_PAGES


CATALOGUE = {c: Rule(c, SEVERITIES[s], cat, kind) for c, s, cat, kind in (line.split() for line in RULES.split("\n") if line)}


def frame(spark: SparkSession) -> DataFrame:
    """The catalogue as a table of 92 rows, fit to be broadcast."""
    rows = [(r.code, r.severity, SEVERITY_RANK[r.severity], r.category, r.group, r.kind) for r in CATALOGUE.values()]
    return spark.createDataFrame(rows, "code string, severity string, severity_rank int, category string, rule_group string, kind string")
