"""HTML pages to nested rows: one Arrow UDF that parses, native expressions for the rest.

The parser is the standard library's tokenizer with an ancestor stack. Void
elements take no children, a few elements close their like (p, li, td, ...),
script and style are raw text. What a broken page means is decided as leniently
as browsers do, not more precisely.
"""

from __future__ import annotations

import json
import re
from html.parser import HTMLParser
from urllib.parse import urljoin

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.functions.text import fnv1a64, page_words, simhash64
from auditmill.functions.urls import normalize

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
UNSEEN = frozenset("script style noscript template svg".split())
INLINE = frozenset("a abbr b bdi bdo cite code data dfn em font i kbd mark q s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_LIKE = frozenset("p li td th tr option dt dd".split())
# Link types and flag bits as the link table codes them.
ANCHOR, IMAGE, STYLESHEET, SCRIPT, CANONICAL, HREFLANG, REDIRECT, IFRAME, REFRESH = range(9)
NOFOLLOW, UGC, SPONSORED, NO_ALT, NO_SIZE = 1, 2, 4, 8, 16
POSITIONS = {"nav": 1, "header": 2, "footer": 3, "aside": 4, "main": 5, "article": 5}


def collapse(text: str) -> str:
    return " ".join(text.split())


def decode(data: bytes | None, header_charset: str | None = None) -> str:
    """Bytes as text: the header's charset, a byte order mark, the page's own charset, else UTF-8."""
    if data is None:
        return ""
    data = bytes(data)
    named = header_charset
    if not named:
        for mark, enc in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
            if data.startswith(mark):
                named = enc
                break
    if not named and (m := re.search(rb"charset\s*=\s*[\"']?\s*([\w-]+)", data[:2048], re.I)):
        named = m[1].decode("ascii")
    named = (named or "utf-8").strip().lower()
    if named in ("iso-8859-1", "latin1", "latin-1", "us-ascii", "ascii"):
        named = "windows-1252"
    try:
        return data.decode(named)
    except (LookupError, UnicodeDecodeError):
        try:
            return data.decode("utf-8")
        except UnicodeDecodeError:
            return data.decode("windows-1252", "replace")


class _Page(HTMLParser):
    def __init__(self, base: str | None):
        super().__init__(convert_charrefs=True)
        self.base = base
        self.stack: list[str] = []
        self.titles, self.descriptions, self.h1, self.h2 = [], [], [], []
        self.robots, self.canonicals, self.langs, self.links, self.blocks = [], [], [], [], []
        self.lang = self.refresh = None
        self.text: list[str] = []
        self.open: list[tuple[str, list[str], dict]] = []

    def place(self) -> int:
        return next((POSITIONS[t] for t in reversed(self.stack) if t in POSITIONS), 0)

    def resolved(self, href: str | None) -> str | None:
        return normalize(href, self.base) if href is not None else None

    def link(self, href: str | None, kind: int, text: str, flags: int) -> None:
        if href is not None:
            self.links.append((href, kind, text, flags | self.place() << 8, self.resolved(href)))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_starttag(self, tag, attrs):
        a = {k: v if v is not None else "" for k, v in reversed(attrs)}
        if tag not in INLINE:
            self.text.append(" ")
        rel = set((a.get("rel") or "").lower().split())
        if tag in CLOSES_LIKE and self.stack and self.stack[-1] == tag:
            self.handle_endtag(tag)
        if tag == "html" and self.lang is None:
            self.lang = a.get("lang")
        elif tag == "base" and a.get("href"):
            self.base = urljoin(self.base or "", a["href"])
        elif tag == "meta":
            name, content = (a.get("name") or "").lower(), a.get("content") or ""
            if name == "description":
                self.descriptions.append(collapse(content))
            elif name in ("robots", "googlebot"):
                self.robots.append(content)
            elif (a.get("http-equiv") or "").lower() == "refresh" and self.refresh is None:
                self.refresh = content
        elif tag == "link" and "href" in a:
            if "canonical" in rel:
                self.canonicals.append((a["href"], "body" not in self.stack, self.resolved(a["href"])))
                self.link(a["href"], CANONICAL, "", 0)
            elif "alternate" in rel and "hreflang" in a:
                self.langs.append((a["hreflang"], a["href"], self.resolved(a["href"])))
                self.link(a["href"], HREFLANG, a["hreflang"], 0)
            elif "stylesheet" in rel:
                self.link(a["href"], STYLESHEET, "", 0)
        elif tag == "img":
            flags = (NO_ALT if "alt" not in a else 0) | (NO_SIZE if not (a.get("width") and a.get("height")) else 0)
            self.link(a.get("src"), IMAGE, collapse(a.get("alt", "")), flags)
            for _, parts, kind in self.open:
                if kind.get("anchor"):
                    parts.append(a.get("alt", ""))
        elif tag == "script" and a.get("src"):
            self.link(a["src"], SCRIPT, "", 0)
        elif tag == "iframe":
            self.link(a.get("src"), IFRAME, "", 0)
        if tag in VOID:
            return
        self.stack.append(tag)
        if tag in ("title", "h1", "h2"):
            self.open.append((tag, [], {}))
        elif tag == "a" and "href" in a:
            flags = (NOFOLLOW if "nofollow" in rel else 0) | (UGC if "ugc" in rel else 0) | (SPONSORED if "sponsored" in rel else 0)
            self.open.append((tag, [], {"anchor": a["href"], "flags": flags}))
        elif tag == "script" and (a.get("type") or "").lower().strip() == "application/ld+json":
            self.open.append((tag, [], {}))

    def handle_endtag(self, tag):
        if tag not in self.stack:
            return
        if tag not in INLINE:
            self.text.append(" ")
        while self.stack:
            top = self.stack[-1]
            if self.open and self.open[-1][0] == top:
                self.close_open(*self.open.pop())
            self.stack.pop()
            if top == tag:
                break

    def close_open(self, tag, parts, info):
        text = "".join(parts)
        if tag == "title" and "svg" not in self.stack:
            self.titles.append(collapse(text))
        elif tag in ("h1", "h2"):
            getattr(self, tag).append(collapse(text))
        elif tag == "a":
            self.link(info["anchor"], ANCHOR, collapse(text), info["flags"])
        elif tag == "script":
            self.blocks.append(text)

    def handle_data(self, data):
        for _, parts, _ in self.open:
            parts.append(data)
        if "body" in self.stack and not UNSEEN & set(self.stack):
            self.text.append(data)

    def finish(self):
        self.close()
        for t in list(reversed(self.stack)):
            self.handle_endtag(t)


def type_names(node) -> list[str]:
    """Every @type in a JSON-LD value, in order."""
    out: list[str] = []
    if isinstance(node, list):
        for x in node:
            out += type_names(x)
    elif isinstance(node, dict):
        kinds = node.get("@type")
        out += [k for k in (kinds if isinstance(kinds, list) else [kinds]) if isinstance(k, str)]
        if "@graph" in node:
            out += type_names(node["@graph"])
    return out


def json_ld(source: str) -> tuple[list[str], str | None, object]:
    """(types, error, value) of a block of structured data; trailing commas are errors."""
    try:
        value = json.loads(source, parse_constant=lambda c: (_ for _ in ()).throw(ValueError(c)))
    except ValueError as e:
        return [], str(e)[:200], None
    return type_names(value), None, value


def number(value) -> float | None:
    if isinstance(value, bool):
        return None
    if isinstance(value, (int, float)):
        return float(value)
    m = re.search(r"-?\d[\d,]*(?:\.\d+)?", str(value or ""))
    return float(m[0].replace(",", "")) if m else None


def _offers(value) -> list[dict]:
    if isinstance(value, list):
        return [o for v in value for o in _offers(v)]
    if isinstance(value, dict):
        return _offers(value["offers"]) if "offers" in value and "price" not in value and "lowPrice" not in value else [value]
    return []


def _kinds(node: dict) -> set[str]:
    k = node.get("@type")
    return {str(x) for x in (k if isinstance(k, list) else [k])}


def products(value) -> list[dict]:
    """Products and product groups anywhere in a JSON-LD value."""
    if isinstance(value, list):
        return [p for v in value for p in products(v)]
    if not isinstance(value, dict):
        return []
    if not _kinds(value) & {"Product", "ProductGroup"}:
        return [p for v in value.values() if isinstance(v, (list, dict)) for p in products(v)]
    variants = [v for v in value.get("hasVariant") or [] if isinstance(v, dict)] if "ProductGroup" in _kinds(value) else []
    units = [(_offers(v.get("offers")), v) for v in variants] or [([o], value) for o in _offers(value.get("offers"))] or [([], value)]
    prices, stock, identified = [], set(), 0
    priced = 0
    currency = None
    for offers, node in units:
        found = [n for o in offers for n in (number(o.get("price")), number(o.get("lowPrice")), number(o.get("highPrice"))) if n is not None]
        priced += bool(found)
        prices += found
        currency = currency or next((o.get("priceCurrency") for o in offers if o.get("priceCurrency")), None)
        stock |= {str(o["availability"]).rsplit("/", 1)[-1] for o in offers if o.get("availability")}
        identified += any(n.get(k) for n in (node, *offers) for k in ("gtin", "gtin8", "gtin12", "gtin13", "gtin14", "mpn", "isbn"))
    brand = value.get("brand")
    images = value.get("image")
    return [
        {
            "name": value.get("name"), "brand": brand.get("name") if isinstance(brand, dict) else brand, "variants": len(units), "with_price": priced,
            "low_price": min(prices, default=None), "high_price": max(prices, default=None), "currency": currency, "availability": ", ".join(sorted(stock)) or None,
            "with_identifier": identified, "images": len(images) if isinstance(images, list) else int(bool(images)),
        }
    ]


def parse(html: str | None, url: str | None = None) -> dict:
    """One page as a nested row."""
    p = _Page(url)
    p.feed(html or "")
    p.finish()
    text = collapse("".join(p.text))
    words = page_words(text)
    blocks = [json_ld(b) for b in p.blocks]
    h = fnv1a64(" ".join(words).encode())
    return {
        "titles": p.titles, "descriptions": p.descriptions, "h1": p.h1, "h2": p.h2, "lang": p.lang, "meta_robots": p.robots, "meta_refresh": p.refresh,
        "canonicals": p.canonicals, "hreflang": p.langs, "links": p.links, "json_ld": [(t, e) for t, e, _ in blocks], "products": [x for _, _, v in blocks if v is not None for x in products(v)],
        "text": text, "word_count": len(words), "content_hash": h - (1 << 64) if h >> 63 else h, "simhash": simhash64(words),
    }


def _struct(ddl: str) -> T.StructType:
    """A struct from 'name type' pairs of the simple types used here."""
    simple = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType()}
    return T.StructType([T.StructField(n, simple[t]) for n, t in (x.split(":") for x in ddl.split(","))])


PARSED = T.StructType(
    [T.StructField(n, T.ArrayType(T.StringType())) for n in ("titles", "descriptions", "h1", "h2")]
    + [
        T.StructField("lang", T.StringType()), T.StructField("meta_robots", T.ArrayType(T.StringType())), T.StructField("meta_refresh", T.StringType()),
        T.StructField("canonicals", T.ArrayType(_struct("href:string,in_head:boolean,resolved:string"))),
        T.StructField("hreflang", T.ArrayType(_struct("lang:string,href:string,resolved:string"))),
        T.StructField("links", T.ArrayType(_struct("href:string,type:int,text:string,flags:bigint,resolved:string"))),
        T.StructField("json_ld", T.ArrayType(T.StructType([T.StructField("types", T.ArrayType(T.StringType())), T.StructField("error", T.StringType())]))),
        T.StructField("products", T.ArrayType(_struct("name:string,brand:string,variants:int,with_price:int,low_price:double,high_price:double,currency:string,availability:string,with_identifier:int,images:int"))),
        T.StructField("text", T.StringType()), T.StructField("word_count", T.IntegerType()), T.StructField("content_hash", T.LongType()), T.StructField("simhash", T.LongType()),
    ]
)


def parsed(pages: DataFrame) -> DataFrame:
    """``pages`` (url, html) with their parsed fields; the html goes no further."""
    keep = [f for f in pages.schema.fields if f.name != "html"]
    shape = T.StructType([*keep, T.StructField("page", PARSED)])

    def run(batches):
        import pyarrow as pa

        for b in batches:
            at = b.schema.get_field_index("html")
            rows = [parse(h, u) for h, u in zip(b.column(at).to_pylist(), b.column(b.schema.get_field_index("url")).to_pylist(), strict=True)]
            for r in rows:
                r["canonicals"] = [dict(zip(("href", "in_head", "resolved"), x, strict=True)) for x in r["canonicals"]]
                r["hreflang"] = [dict(zip(("lang", "href", "resolved"), x, strict=True)) for x in r["hreflang"]]
                r["links"] = [dict(zip(("href", "type", "text", "flags", "resolved"), x, strict=True)) for x in r["links"]]
                r["json_ld"] = [{"types": t, "error": e} for t, e in r["json_ld"]]
            from pyspark.sql.pandas.types import to_arrow_type

            page = pa.array(rows, to_arrow_type(PARSED))
            cols = [b.column(b.schema.get_field_index(f.name)) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, page], names=[*[f.name for f in keep], "page"])

    return pages.mapInArrow(run, shape)


def facts(pages: DataFrame, start_host: str) -> DataFrame:
    """Fact rows of parsed pages as the row rules read them.

    ``pages`` has id, url, page, and what else is known of a response.
    """
    p, c = F.col("page"), F.col
    host = lambda u: F.lower(F.regexp_extract(u, r"^https?://([^/?#:]+)", 1))
    first = lambda a: F.coalesce(F.get(F.filter(a, lambda x: x != ""), F.lit(0)), F.get(a, F.lit(0)))
    links = F.transform(p["links"], lambda x: F.struct(x["href"].alias("href"), x["type"].alias("type"), x["text"].alias("text"), x["flags"].alias("flags"), (host(x["resolved"]) == start_host).alias("is_internal")))
    product = F.aggregate(
        p["products"],
        F.struct(*[F.lit(0).alias(n) for n in ("variants", "with_price", "with_availability", "with_identifier", "images")]),
        lambda a, x: F.struct(
            (a["variants"] + x["variants"]).alias("variants"), (a["with_price"] + x["with_price"]).alias("with_price"),
            (a["with_availability"] + F.when(x["availability"].isNotNull(), x["variants"]).otherwise(0)).alias("with_availability"),
            (a["with_identifier"] + x["with_identifier"]).alias("with_identifier"), F.greatest(a["images"], x["images"]).alias("images"),
        ),
    )
    return pages.withColumns(
        {
            "parsed": F.lit(True), "is_internal": host(c("url")) == start_host, "resource_type": F.lit(0), "site_is_https": F.lit(True),
            "title": first(p["titles"]), "title_count": F.size(p["titles"]), "meta_description": first(p["descriptions"]), "meta_description_count": F.size(p["descriptions"]),
            "h1": first(p["h1"]), "h1_count": F.size(p["h1"]), "h2_count": F.size(F.filter(p["h2"], lambda x: x != "")), "meta_robots": F.array_join(p["meta_robots"], ","), "meta_refresh": p["meta_refresh"],
            "word_count": p["word_count"], "canonicals": p["canonicals"], "hreflang": p["hreflang"], "links": links,
            "internal_outlinks": F.size(F.filter(links, lambda x: (x["type"] == 0) & x["is_internal"])),
            "json_ld_errors": F.size(F.filter(p["json_ld"], lambda x: x["error"].isNotNull())), "product": F.when(F.size(p["products"]) > 0, product),
        }
    )


def hit(text: str | None, mode: str, term: str, case_sensitive: bool = False) -> bool:
    """Whether a custom search finds its term: contains, not_contains, regex or not_regex."""
    t = text or ""
    if mode.endswith("regex"):
        found = re.search(term, t, 0 if case_sensitive else re.I) is not None
    else:
        found = term in t if case_sensitive else term.lower() in t.lower()
    return found != mode.startswith("not_")


def extract_regex(html: str | None, pattern: str, collect_all: bool = False) -> str | None:
    """A regular expression's first group, or its whole match; all matches joined by ' | '."""
    found = [m[1] if m.re.groups and m[1] is not None else m[0] for m in re.finditer(pattern, html or "", re.S)]
    return (" | ".join(found) if collect_all else found[0]) if found else None
