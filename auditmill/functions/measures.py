"""Statuses, types, prices and other small conversions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What status codes are called.
REASONS = {
    100: "Continue", 101: "Switching Protocols", 103: "Early Hints",
    200: "OK", 201: "Created", 202: "Accepted", 203: "Non-Authoritative Information", 204: "No Content", 205: "Reset Content", 206: "Partial Content",
    300: "Multiple Choices", 301: "Moved Permanently", 302: "Found", 303: "See Other", 304: "Not Modified", 307: "Temporary Redirect", 308: "Permanent Redirect",
    400: "Bad Request", 401: "Unauthorized", 402: "Payment Required", 403: "Forbidden", 404: "Not Found", 405: "Method Not Allowed", 406: "Not Acceptable",
    407: "Proxy Authentication Required", 408: "Request Timeout", 409: "Conflict", 410: "Gone", 411: "Length Required", 412: "Precondition Failed", 413: "Content Too Large",
    414: "URI Too Long", 415: "Unsupported Media Type", 416: "Range Not Satisfiable", 417: "Expectation Failed", 418: "I'm a Teapot", 421: "Misdirected Request",
    422: "Unprocessable Content", 425: "Too Early", 426: "Upgrade Required", 428: "Precondition Required", 429: "Too Many Requests",
    431: "Request Header Fields Too Large", 451: "Unavailable For Legal Reasons",
    500: "Internal Server Error", 501: "Not Implemented", 502: "Bad Gateway", 503: "Service Unavailable", 504: "Gateway Timeout", 505: "HTTP Version Not Supported",
    507: "Insufficient Storage", 508: "Loop Detected", 511: "Network Authentication Required", 520: "Web Server Returned an Unknown Error", 521: "Web Server Is Down",
    522: "Connection Timed Out", 523: "Origin Is Unreachable", 525: "SSL Handshake Failed",
}
# What the classes of other codes are called, from 1xx to 5xx.
CLASS_REASONS = ("Informational", "Success", "Redirection", "Client Error", "Server Error")
# Statuses by which a site refuses an automated check.
REFUSALS = (401, 402, 403, 406, 407, 429, 999)
# Headers that bot protection adds.
CHALLENGES = ("cf-mitigated", "x-datadome", "x-amzn-waf-action", "x-px-block")
RESOURCE_TYPES = ("page", "image", "css", "javascript", "pdf", "other")


def status_class(status: Column) -> Column:
    """'2xx' to '5xx', null for others."""
    return F.when(status.between(200, 599), F.concat((F.floor(status / 100)).cast("int").cast("string"), F.lit("xx")))


def reason(status: Column) -> Column:
    """What a status is called, by its class where the code has no name; null only for null."""
    names = F.create_map(*[x for k, v in REASONS.items() for x in (F.lit(k), F.lit(v))])
    group = F.when(status.between(100, 599), F.element_at(F.array(*[F.lit(c) for c in CLASS_REASONS]), F.floor(F.greatest(status, F.lit(100)) / 100).cast("int")))
    return F.when(status.isNotNull(), F.coalesce(F.try_element_at(names, status), group, F.lit("Unknown")))


def resource_type(content_type: Column) -> Column:
    """The resource type's code by a content type; null without one."""
    c = F.lower(F.trim(F.regexp_extract(content_type, "^([^;]*)", 1)))
    return (
        F.when(content_type.isNull() | (c == ""), F.lit(None))
        .when(c.isin("text/html", "application/xhtml+xml"), 0)
        .when(c.startswith("image/"), 1)
        .when(c == "text/css", 2)
        .when(c.contains("javascript") | c.contains("ecmascript"), 3)
        .when(c == "application/pdf", 4)
        .otherwise(5)
    )


def has_challenge(headers: Column) -> Column:
    """Whether a map of headers holds one that bot protection adds."""
    names = F.transform(F.map_keys(headers), F.lower)
    return F.coalesce(F.arrays_overlap(names, F.array(*[F.lit(c) for c in CHALLENGES])), F.lit(False))


def is_refused(status: Column, headers: Column | None = None) -> Column:
    """Refused to a crawler, which says nothing about the page."""
    said = status.isin(*REFUSALS)
    if headers is not None:
        said = said | ((status >= 400) & has_challenge(headers))
    return F.coalesce(said, F.lit(False))


def is_throttled(status: Column, headers: Column | None = None) -> Column:
    said = status == 429
    if headers is not None:
        said = said | ((status >= 400) & has_challenge(headers))
    return F.coalesce(said, F.lit(False))


def is_broken(status: Column, blocked: Column) -> Column:
    return F.coalesce(status >= 400, F.lit(False)) | (status.isNull() & ~F.coalesce(blocked, F.lit(False)))


def price(text: Column) -> Column:
    """The number in a price such as '£1,299.00'; null without one."""
    digits = F.regexp_replace(text, r"[^0-9.,-]", "")
    plain = F.when(digits.rlike(r",[0-9]{1,2}$"), F.replace(F.regexp_replace(digits, r"[.](?=[0-9]{3})", ""), F.lit(","), F.lit("."))).otherwise(F.replace(digits, F.lit(","), F.lit("")))
    return plain.try_cast("double")


def retry_after(value: Column, now: Column) -> Column:
    """Seconds to wait: a number, or a date of RFC 1123 less ``now``; never below 0."""
    at = F.try_to_timestamp(F.regexp_extract(value, r"^\w{3}, (.*) GMT$", 1), F.lit("dd MMM yyyy HH:mm:ss"))
    wait = F.coalesce(F.trim(value).try_cast("double"), F.unix_timestamp(at).cast("double") - F.unix_timestamp(now).cast("double"))
    return F.greatest(wait, F.lit(0.0))


def header_rows(headers_json: Column) -> Column:
    """A JSON object of headers as (name, value) rows in order of name."""
    return F.array_sort(F.map_entries(F.from_json(headers_json, "map<string,string>")))


def opportunities(report_json: Column, most: int = 8) -> Column:
    """The ``most`` largest savings of a speed report given as a JSON array of (id, title, score, savings_ms, kind)."""
    rows = F.from_json(report_json, "array<struct<id:string,title:string,score:double,savings_ms:double,kind:string>>")
    open_ = F.filter(rows, lambda r: (r["score"] < 0.9) & ~F.coalesce(r["kind"].isin("metric", "hidden", "informative", "notApplicable", "manual"), F.lit(False)))
    ranked = F.array_sort(F.transform(open_, lambda r: F.struct((-F.coalesce(r["savings_ms"], F.lit(0.0))).alias("by"), r["id"].alias("id"), r["title"].alias("title"), r["score"].alias("score"))))
    return F.slice(ranked, 1, most)


def batch_seconds(pages: Column) -> Column:
    """How long a batch of speed runs takes: two runs a page of 15 seconds."""
    return pages * 30
