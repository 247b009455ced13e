"""The columns a table of URLs can show: titles, kinds, widths, defaults per filter, display values and sort keys."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Name, title, kind, and the table column that it shows and sorts by.
_COLUMNS = (
    ("address", "Address", "text", "url"), ("contentType", "Content Type", "text", "content_type"), ("statusCode", "Status Code", "integer", "status_code"),
    ("status", "Status", "text", "status_text"), ("indexability", "Indexability", "text", "indexability"), ("indexabilityReason", "Indexability Status", "text", "indexability_reason"),
    ("title", "Title", "text", "title"), ("titleLength", "Title Length", "integer", "title_length"), ("titlePixels", "Title Pixel Width", "decimal", "title_pixels"), ("titleCount", "Title Count", "integer", "title_count"),
    ("metaDescription", "Meta Description", "text", "meta_description"), ("metaDescriptionLength", "Meta Description Length", "integer", "meta_description_length"),
    ("metaDescriptionPixels", "Meta Description Pixel Width", "decimal", "meta_description_pixels"), ("metaDescriptionCount", "Meta Description Count", "integer", "meta_description_count"),
    ("h1", "H1", "text", "h1"), ("h1Length", "H1 Length", "integer", "h1_length"), ("h1Count", "H1 Count", "integer", "h1_count"), ("h1Second", "H1 (2nd)", "text", "h1_second"),
    ("h2", "H2", "text", "h2"), ("h2Count", "H2 Count", "integer", "h2_count"), ("canonical", "Canonical", "text", "canonical"), ("canonicalCount", "Canonical Count", "integer", "canonical_count"),
    ("metaRobots", "Meta Robots", "text", "meta_robots"), ("xRobotsTag", "X-Robots-Tag", "text", "x_robots_tag"), ("lang", "Language", "text", "lang"), ("wordCount", "Word Count", "integer", "word_count"),
    ("sizeBytes", "Size (bytes)", "integer", "size_bytes"), ("responseMs", "Response Time (ms)", "decimal", "response_ms"), ("ttfbMs", "TTFB (ms)", "decimal", "ttfb_ms"), ("depth", "Crawl Depth", "integer", "depth"),
    ("inlinks", "Inlinks", "integer", "inlinks"), ("uniqueInlinks", "Unique Inlinks", "integer", "unique_inlinks"), ("outlinks", "Outlinks", "integer", "outlinks"), ("externalOutlinks", "External Outlinks", "integer", "external_outlinks"),
    ("redirectURL", "Redirect URL", "text", "redirect_url"), ("hreflangCount", "Hreflang Count", "integer", "hreflang_count"), ("structuredDataCount", "JSON-LD Blocks", "integer", "structured_data_count"),
    ("resourceType", "Type", "text", "resource_type"), ("crawledAt", "Crawled", "text", "crawled_at"), ("javaScriptRendered", "Rendered", "text", "js_rendered"), ("rawWordCount", "Raw Word Count", "integer", "raw_word_count"),
    ("rawLinkCount", "Raw Link Count", "integer", "raw_link_count"), ("renderedLinkCount", "Rendered Link Count", "integer", "rendered_link_count"), ("renderMs", "Render Time (ms)", "decimal", "render_ms"), ("inSitemap", "In Sitemap", "text", "in_sitemap"),
    ("lhMobileScore", "Mobile Score", "decimal", "lh_m_score"), ("lhMobileLCP", "Mobile LCP (ms)", "decimal", "lh_m_lcp_ms"), ("lhMobileCLS", "Mobile CLS", "decimal", "lh_m_cls"), ("lhMobileTBT", "Mobile TBT (ms)", "decimal", "lh_m_tbt_ms"),
    ("lhDesktopScore", "Desktop Score", "decimal", "lh_d_score"), ("lhDesktopLCP", "Desktop LCP (ms)", "decimal", "lh_d_lcp_ms"), ("lhDesktopCLS", "Desktop CLS", "decimal", "lh_d_cls"), ("lhDesktopTBT", "Desktop TBT (ms)", "decimal", "lh_d_tbt_ms"),
)
# Columns wider than their kind's default.
_WIDE = {320: ("address", "title", "metaDescription", "canonical", "redirectURL"), 180: ("h1", "h1Second", "h2", "status", "indexabilityReason"), 140: ("contentType", "metaRobots", "xRobotsTag", "crawledAt")}
SPEED = tuple(c[0] for c in _COLUMNS if c[0].startswith("lh"))
# What a filter's table shows unless told otherwise.
_PAGE = ("address", "statusCode", "status", "indexability", "indexabilityReason", "title", "titleLength", "titlePixels", "metaDescription", "metaDescriptionLength", "h1", "h1Count", "canonical", "metaRobots", "wordCount", "depth", "inlinks", "outlinks", "responseMs", "sizeBytes")
_ANY = ("address", "contentType", "statusCode", "status", "indexability", "indexabilityReason", "title", "depth", "inlinks", "sizeBytes", "responseMs")
_FILE = ("address", "contentType", "statusCode", "status", "sizeBytes", "inlinks")
_ISSUE = ("address", "statusCode", "status", "indexability", "title", "inlinks")
_FOUND = ("address", "statusCode", "indexability", "title", "wordCount")
DEFAULTS = {
    "all": _PAGE, "internal_html": _PAGE, "internal_all": _ANY, "no_response": _ANY, **{f"status_{n}xx": _ANY for n in (2, 3, 4, 5)},
    "external": ("address", "contentType", "statusCode", "status", "inlinks", "responseMs"), "images": _FILE, "css_and_javascript": _FILE, "not_crawled": ("address", "status", "depth", "inlinks"),
    "redirect_chains": ("address", "statusCode", "status", "redirectURL", "inlinks"), "in_sitemap": ("address", "statusCode", "status", "indexability", "indexabilityReason", "inlinks", "depth"),
    "extraction": _FOUND, "search_hit": _FOUND, "near_duplicates": (*_FOUND, "inlinks"), "issue": _ISSUE, "ignored": _ISSUE,
}


@dataclass(frozen=True)
class Shown:
    """A column of the table."""

    name: str
    title: str
    kind: str
    source: str

    @property
    def width(self) -> int:
        return next((w for w, names in _WIDE.items() if self.name in names), 110 if self.kind == "text" else 90)


REGISTRY = {c[0]: Shown(*c) for c in _COLUMNS}


def issue_columns(own: tuple[str, ...] = ()) -> tuple[str, ...]:
    """What an issue's table shows: the address, what the issue is about, then what helps with any; each once."""
    return tuple(dict.fromkeys(("address", *own, "statusCode", "indexability", "inlinks")))


def with_speed(names: tuple[str, ...], measured: bool) -> tuple[str, ...]:
    """The speed columns come last, where there are measurements at all."""
    return (*names, *[s for s in SPEED if s not in names]) if measured else names


def sort_key(name: str, df: DataFrame) -> Column:
    """What a column is sorted by: its source; a status by its text, else the error, else why it was skipped."""
    if name == "status":
        return F.coalesce(*[F.col(c) for c in ("status_text", "error", "skip_reason") if c in df.columns])
    return F.col(REGISTRY[name].source)


def ordered(df: DataFrame, name: str, ascending: bool = True) -> DataFrame:
    """Rows in order of any column, nulls lowest, ties by id."""
    key = sort_key(name, df)
    return df.orderBy(key.asc_nulls_first() if ascending else key.desc_nulls_last(), F.col("id").asc())


def display(name: str, df: DataFrame) -> Column:
    """A cell as text: nothing unless crawled, decimals rounded (shift scores to three places), booleans in words."""
    shown = REGISTRY[name]
    c = F.col(shown.source)
    if name == "address":
        return c
    kind = dict(df.dtypes)[shown.source]
    number = c.cast("double")
    real = F.when(~F.isnan(number) & (F.abs(number) != float("inf")), number)
    places = 3 if name.endswith("CLS") else 0
    whole = F.rint(real).cast("long").cast("string") if places == 0 else F.format_string("%.3f", real)
    text = F.when(c, "Yes").otherwise("No") if kind == "boolean" else F.when(real.isNotNull(), whole) if shown.kind == "decimal" else c.cast("string")
    return F.when((F.col("state") == 1) & c.isNotNull(), F.coalesce(text, F.lit(""))).otherwise("")
