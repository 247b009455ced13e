"""URL functions as native column expressions; UDFs only where parsing needs state.

Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from auditmill.functions.text import let

# Query parameters that only say where a click came from; utm_* too.
TRACKING = (
    "gclid", "gclsrc", "gbraid", "wbraid", "dclid", "msclkid", "fbclid", "srsltid",
    "pscid", "mc_cid", "mc_eid", "_ga", "_gl", "igshid", "yclid", "ref_src",
    "sh", "si", "smid",
    "_psid", "_pos", "_psq", "_ss", "_v", "_sid", "_fid",
    "pr_prod_strat", "pr_rec_id", "pr_rec_pid", "pr_ref_pid", "pr_seq",
)
# Extensions of image files.
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "avif", "svg", "bmp", "tif", "tiff", "ico", "heic")
# Paths that redirect by design.
BY_DESIGN = (
    "/customer_authentication/", "/account", "/login", "/log-in", "/signin", "/sign-in",
    "/cart", "/basket", "/checkout", "/wp-login.php", "/my-account", "/auth/",
)
# The named sizes a shop's image files come in, and where they may be cropped.
IMAGE_SIZES = ("pico", "icon", "thumb", "small", "compact", "medium", "large", "grande", "original", "master")
IMAGE_CROPS = ("top", "center", "bottom", "left", "right")

MARKET = r"(?:/[a-z]{2}(?:-[a-z]{2,4})?)?"


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


def origin(url: Column) -> Column:
    """Scheme, host and port if given."""
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1))


def path(url: Column) -> Column:
    """The path, '/' if empty."""
    p = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", F.lit("/")).otherwise(p)


def query(url: Column) -> Column:
    """What stands after the first '?', empty without one."""
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def path_and_query(url: Column) -> Column:
    q = query(url)
    return F.when(q == "", path(url)).otherwise(F.concat(path(url), F.lit("?"), q))


def page_number(url: Column) -> Column:
    """The page of a list an address is, 1 where it says none."""
    asked = F.regexp_extract(url, r"^[^?#]*\?(?:[^#]*&)?(?i:page|paged)=([0-9]{1,9})(?:&|#|$)", 1)
    walked = F.regexp_extract(url, r"^[^?#]*/(?i:page)/([0-9]{1,9})/?(?:[?#]|$)", 1)
    number = lambda c: F.when(c != "", c.cast("int"))
    return F.coalesce(F.when(number(asked) >= 2, number(asked)), F.when(number(walked) >= 2, number(walked)), F.lit(1))


def later_page(url: Column) -> Column:
    """Whether an address is page 2 or later of a list."""
    return F.coalesce(page_number(url) >= 2, F.lit(False))


def product_handle(url: Column) -> Column:
    """The product a path names, lower case; null for none."""
    h = F.lower(F.regexp_extract(path(url), rf"(?i)^{MARKET}(?:/collections/[^/?#]+)?/products/([^/?#]+)", 1))
    return F.when(h != "", h)


def in_collection(url: Column) -> Column:
    """Whether a product's path goes through a collection."""
    return path(url).rlike(rf"(?i)^{MARKET}/collections/[^/?#]+/products/[^/?#]+")


def is_collection(url: Column) -> Column:
    return path(url).rlike(rf"(?i)^{MARKET}/collections/[^/?#]+/?$")


def template(url: Column, with_query: bool = False) -> Column:
    """The kind of shop page an address is built from; null for others and, unless ``with_query``, for queries."""
    p = F.regexp_replace(path(url), r"^/[a-z]{2}(?:-[a-z]{2,4})?(?=/?$|/(?:collections|products|blogs|pages)(?:/|$))", "")
    kind = (
        F.when(p.rlike("^/?$"), "home")
        .when(p.rlike("^/+collections/+all/*$"), "all_products")
        .when(p.rlike("^/+collections/+[^/]+/*$"), "collection")
        .when(p.rlike("^/+products/+[^/]+/*$"), "product")
        .when(p.rlike("^/+blogs/+[^/]+/*$"), "blog")
        .when(p.rlike("^/+blogs/+[^/]+/+tagged/*$"), F.lit(None))
        .when(p.rlike("^/+blogs/+[^/]+/+[^/]+/*$"), "article")
        .when(p.rlike("^/+pages/+[^/]+/*$"), "page")
    )
    return kind if with_query else F.when(~url.contains("?"), kind)


def without_tracking(url: Column) -> Column:
    """The address without tracking parameters; null where it has none."""
    names = "|".join(re.escape(n) for n in TRACKING)
    fragment = F.regexp_extract(url, "(#.*)$", 1)
    base = F.regexp_extract(url, r"^([^?#]*)", 1)
    items = F.filter(F.split(query(url), "&"), lambda x: x != "")
    kept = F.filter(items, lambda x: ~x.rlike(rf"(?i)^(?:(?:{names})(?:=|$)|utm_)"))
    clean = F.concat(base, F.when(F.size(kept) == 0, F.lit("")).otherwise(F.concat(F.lit("?"), F.array_join(kept, "&"))), fragment)
    return F.when(url.contains("?") & (F.size(kept) < F.size(items)), clean)


def is_tracking_copy(url: Column) -> Column:
    """Whether an address is another with nothing but tracking added."""
    return F.coalesce(~without_tracking(url).contains("?"), F.lit(False))


def shop_file(url: Column) -> Column:
    """The store's own path of a file on the shop platform's shared host, whose folders are numbers of four digits; null for others."""
    tail = F.regexp_extract(url, r"^https?://cdn\.shopify\.com/s/files/1/(.+)$", 1)
    steps = F.split(tail, "/")
    four = lambda i: F.coalesce(F.get(steps, F.lit(i)).rlike("^[0-9]{4}$"), F.lit(False))
    skipped = F.when(four(0) & four(1) & four(2) & (F.size(steps) > 3), 3).when(four(0) & four(1) & (F.size(steps) > 2), 2)
    rest = F.array_join(F.slice(steps, skipped + 1, F.size(steps)), "/")
    return F.when((tail != "") & skipped.isNotNull() & (rest != ""), F.concat(F.lit("/cdn/shop/"), rest))


def image_file(url: Column, origin: str = "") -> Column:
    """An image's file whatever size it is asked for at.

    The query goes where the path names an image file. A file of the shop's
    shared host is the same as the store's own at ``origin``. From a shop file's
    name the marks behind its last parts go: a density (@2x), a crop, and a size
    in pixels or by name; a crop or density counts only behind a size.
    """
    bare = F.regexp_extract(url, r"^([^?]*)", 1)
    named = F.lower(F.element_at(F.split(bare, r"\."), -1)).isin(*IMAGE_EXTENSIONS) & bare.contains(".")
    file = F.when(named, bare).otherwise(url)
    file = F.coalesce(F.concat(F.lit(origin), shop_file(file)), file)

    def unsized(f: Column) -> Column:
        ending = F.regexp_extract(f, r"\.[A-Za-z0-9]+$", 0)
        words = F.split(F.regexp_replace(F.substr(f, F.lit(1), F.length(f) - F.length(ending)), "@[0-9]x$", ""), "_")
        return let(F.struct(f.alias("file"), ending.alias("ending"), words.alias("words")), parts)

    def parts(x: Column) -> Column:
        words, ending = x["words"], x["ending"]
        last = lambda i: F.coalesce(F.get(words, F.size(words) - i), F.lit(""))
        cropped = (last(2) == "crop") & last(1).isin(*IMAGE_CROPS)
        size = F.when(cropped, last(3)).otherwise(last(1))
        measured = (F.translate(size, "0123456789", "") == "x") & (size != "x")
        kept = F.size(words) - F.when(cropped, 3).otherwise(1)
        sized = (measured | size.isin(*IMAGE_SIZES)) & (kept > 0) & (ending != "")
        plain = F.concat(F.array_join(F.slice(words, 1, F.greatest(kept, F.lit(0))), "_"), ending)
        return F.when((x["file"].contains("/cdn/shop/") | x["file"].contains("cdn.shopify.com/")) & sized, plain).otherwise(x["file"])

    return let(file, unsized)


def pagination_base(url: Column) -> Column:
    """The first page of a list for one of its later pages; null for anything else."""
    base = F.regexp_extract(url, r"^([^?]*)\?page=[^&]*$", 1)
    return F.when((base != "") & template(base).isin("collection", "all_products", "blog"), base)


def redirects_by_design(url: Column) -> Column:
    """Sign-in, account, basket and checkout paths. As in LIKE, '_' stands for any character."""
    return url.rlike("(?i)" + "|".join(re.escape(p).replace("_", ".") for p in BY_DESIGN))


def is_internal(url: Column, start_host: str, subdomains: bool = False) -> Column:
    h = host(url)
    if not subdomains:
        return h == start_host
    root = start_host.removeprefix("www.")
    return (h == root) | h.endswith("." + root)


def most_repeated_segment(url: Column) -> Column:
    """How often the most frequent path segment occurs."""
    parts = F.filter(F.split(path(url), "/"), lambda x: x != "")
    return F.coalesce(F.array_max(F.transform(parts, lambda p: F.size(F.filter(parts, lambda x: x == p)))), F.lit(0))


def decoded(url: Column) -> Column:
    """Percent escapes read, where they all can be."""
    return F.coalesce(F.try_url_decode(F.replace(url, F.lit("+"), F.lit("%2B"))), url)


def readable(url: Column, most: int = 80) -> Column:
    """Another site's address as a label: without https and tracking, read, and a long one without the middle of its path.

    http and www stay, as either can be why a link redirects. Of a long path as
    many last segments stay as fit, at least one.
    """
    site = F.concat(F.when(scheme(url) == "https", F.lit("")).otherwise(F.concat(scheme(url), F.lit("://"))), F.regexp_replace(origin(url), "^[^:]+://(?:[^/@]*@)?", ""))
    p = decoded(path(url))
    q = query(F.coalesce(without_tracking(url), url))
    whole = F.concat(site, F.when(p == "/", F.lit("")).otherwise(p), F.when(q == "", F.lit("")).otherwise(F.concat(F.lit("?"), q)))

    def shown(x: Column) -> Column:
        steps = F.reverse(F.filter(F.split(x["path"], "/"), lambda t: t != ""))
        room = most - F.length(x["site"]) - 3
        start = F.struct(F.lit("").alias("tail"), F.lit(True).alias("open"))

        def longer(acc: Column, step: Column) -> Column:
            tail = F.when(acc["tail"] == "", step).otherwise(F.concat(step, F.lit("/"), acc["tail"]))
            fits = acc["open"] & ((acc["tail"] == "") | (F.length(tail) <= room))
            return F.struct(F.when(fits, tail).otherwise(acc["tail"]).alias("tail"), fits.alias("open"))

        short = F.concat(x["site"], F.lit("/…/"), F.aggregate(steps, start, longer)["tail"])
        cut_short = let(short, lambda t: F.when(F.length(t) > most, F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…"))).otherwise(t))
        return F.when(F.length(x["whole"]) <= most, x["whole"]).otherwise(cut_short)

    return F.when(origin(url) == "", url).otherwise(let(F.struct(site.alias("site"), p.alias("path"), whole.alias("whole")), shown))


UNRESERVED = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-._~")
KEPT = UNRESERVED | frozenset("!$&'()*+,;=:@/?%[]")


def normalize_escapes(text: str) -> str:
    """Percent escapes in upper case, needless ones resolved, needed ones added."""
    out, i, raw = [], 0, text
    while i < len(raw):
        ch = raw[i]
        if ch == "%" and re.match(r"[0-9A-Fa-f]{2}", raw[i + 1 : i + 3]):
            code = chr(int(raw[i + 1 : i + 3], 16))
            out.append(code if code in UNRESERVED else "%" + raw[i + 1 : i + 3].upper())
            i += 3
            continue
        out.append(ch if ch in KEPT and ch != "%" else "".join(f"%{b:02X}" for b in ch.encode("utf-8", "replace")))
        i += 1
    return "".join(out)


def remove_dots(p: str) -> str:
    out: list[str] = []
    parts = p.split("/")
    for k, seg in enumerate(parts):
        if seg in (".", ".."):
            if seg == ".." and len(out) > 1:
                out.pop()
            if k == len(parts) - 1:
                out.append("")
        else:
            out.append(seg)
    joined = "/".join(out)
    return joined if joined.startswith("/") else "/" + joined


def normalize(raw: str | None, base: str | None = None, strip: tuple[str, ...] = ()) -> str | None:
    """The address under which a page is kept: resolved, lower-case host, no default port,
    fragment, user or dot segments, and without the named parameters ('x*' names a prefix).
    None for what is no http(s) address.
    """
    text = (raw or "").strip()
    if not text:
        return None
    try:
        parts = urlsplit(urljoin(base, text) if base else text)
        kind = parts.scheme.lower()
        name, port = (parts.hostname or "").rstrip("."), parts.port
        if kind not in ("http", "https") or not name:
            return None
        if not name.isascii():
            name = name.encode("idna").decode("ascii")
    except (ValueError, UnicodeError):
        return None
    where = name.lower() + (f":{port}" if port and port != {"http": 80, "https": 443}[kind] else "")
    p = remove_dots(normalize_escapes(parts.path or "/"))
    q = parts.query
    if strip and q:
        def dropped(item: str) -> bool:
            key = item.split("=", 1)[0].lower()
            return any(key.startswith(s[:-1].lower()) if s.endswith("*") else key == s.lower() for s in strip)

        q = "&".join(x for x in q.split("&") if not dropped(x))
    return f"{kind}://{where}{p}" + (f"?{normalize_escapes(q)}" if q else "")


def normalize_udf(strip: tuple[str, ...] = ()):
    """``normalize`` for columns (raw, base)."""

    @F.pandas_udf(StringType())
    def run(raw: pd.Series, base: pd.Series) -> pd.Series:
        return pd.Series([normalize(r, b, strip) for r, b in zip(raw, base, strict=True)], dtype=object)

    return run
