"""What a crawl follows: scope decisions, the shop platform's exclusions and parameters, and lists of URLs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.functions import urls as U

# Addresses of a shop platform that no owner can mend, and why.
EXCLUSIONS = (
    (r"[?&]filter\.", "Storefront filters — every combination is its own URL"),
    (r"[?&]sort_by=", "Collection sorting"),
    (r"^https?://[^/]+(/[a-z]{2}(-[a-z]{2})?)?/search([/?#]|$)", "Site search results"),
    (r"/collections/[^?#]*(\+|%2[bB])", "Collection tag combinations"),
    (r"[?&](oseid|preview_theme_id|preview_script_id)=", "Theme previews and tracking"),
    (r"^https?://(www\.)?(facebook\.com/sharer|(twitter|x)\.com/intent|pinterest\.[a-z.]+/pin/create|linkedin\.com/(share|shareArticle)|wa\.me/|api\.whatsapp\.com/send)", "Share buttons"),
    (r"^https?://(www\.)?shopify\.com/\d+/account", "Shopify customer accounts"),
    (r"^https?://[^/]+(/[a-z]{2}(-[a-z]{2})?)?/customer_authentication/", "Shopify customer sign-in"),
)
# Parameters that are removed from every address of such a shop.
STRIPPED = ("variant", "_pos", "_psq", "_ss", "_v", "_sid", "_fid", "_psid", "srsltid", "pr_prod_strat", "pr_rec_id", "pr_rec_pid", "pr_ref_pid", "pr_seq")
# Link types that lead to pages.
PAGE_LINKS = (0, 6, 7, 8)


@dataclass(frozen=True)
class Scope:
    """Settings of a crawl; 0 is no limit."""

    start_host: str
    subdomains: bool = False
    start_folder: str = "/"
    outside_start_folder: bool = True
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    external: bool = True
    external_nofollow: bool = True
    internal_nofollow: bool = True
    images: bool = True
    stylesheets: bool = True
    scripts: bool = True
    canonicals: bool = True
    hreflang: bool = True
    max_depth: int = 0
    max_length: int = 0
    max_repeats: int = 0


def decision(s: Scope, url: Column, depth: Column, link_type: Column, followable: Column) -> Column:
    """'crawl', 'ignore', or 'skip: ' and the first reason that holds, in the order of the rules."""
    any_of = lambda patterns: F.lit(False) if not patterns else F.coalesce(url.rlike("|".join(f"(?:{p})" for p in patterns)), F.lit(False))
    internal = F.coalesce(U.is_internal(url, s.start_host, s.subdomains), F.lit(False))
    skip = lambda why: F.lit(f"skip: {why}")
    rules: list[tuple[Column, Column]] = [(any_of(s.exclude), F.lit("ignore"))]
    if not s.external:
        rules.append((~internal, skip("External link (not checked)")))
    if not s.external_nofollow:
        rules.append((~internal & ~followable, skip("Nofollow external link")))
    rules.append((~internal, F.lit("crawl")))
    if not s.outside_start_folder:
        rules.append((link_type.isin(*PAGE_LINKS) & ~U.path(url).startswith(s.start_folder), skip("Outside start folder")))
    if s.include:
        rules.append((~any_of(s.include), skip("Doesn't match include pattern")))
    for on, code, name in ((s.images, 1, "Image"), (s.stylesheets, 2, "CSS"), (s.scripts, 3, "JavaScript"), (s.canonicals, 4, "Canonical"), (s.hreflang, 5, "Hreflang")):
        if not on:
            rules.append((link_type == code, skip(f"{name} crawling disabled")))
    if not s.internal_nofollow:
        rules.append((~followable, skip("Nofollow link")))
    if s.max_depth:
        rules.append((depth > s.max_depth, skip("Beyond max crawl depth")))
    if s.max_length:
        rules.append((F.octet_length(url) > s.max_length, skip("URL longer than limit")))
    if s.max_repeats:
        rules.append((U.most_repeated_segment(url) > s.max_repeats, skip("Repeating path segments (possible crawler trap)")))
    return F.coalesce(*[F.when(test, then) for test, then in rules], F.lit("crawl"))


def excluded(url: Column) -> Column:
    """Why a shop platform's address is left out; null where it isn't."""
    return F.coalesce(*[F.when(url.rlike(p), F.lit(why)) for p, why in EXCLUSIONS])


def url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url) of a text file with one address a line; blank lines are none."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "[\\r\\ufeff]", "")).alias("url")).filter("url <> ''")
