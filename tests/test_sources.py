import gzip
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from auditmill.audit import row_rules
from auditmill.functions import measures, text, urls
from auditmill.sources import html, robots, sitemaps

PAGE = """<!doctype html><html lang=en><head><title> A  title </title><meta name="description" content="About
 it"><meta name=robots content="noindex, follow"><link rel=canonical href="/other"><link rel=alternate hreflang=en-UK href="/en">
<script>var x = "</p>";</script><script type="application/ld+json">{"@type":"Product","name":"Jug","offers":[{"price":"£1,009.50","priceCurrency":"GBP","availability":"https://schema.example/InStock"}],"image":["a","b"]}</script>
<script type="application/ld+json">{"a": 1,}</script></head>
<body><nav><a href="/x?utm_source=a" rel="nofollow ugc">Click here</a></nav><main><h1>Head <b>line</b></h1><p>One two<p>three <img src=i.png alt=""><img src="http://h.example/j.png"></main></body></html>"""


def test_parse():
    p = html.parse(PAGE, "https://h.example/dir/page")
    assert p["titles"] == ["A title"] and p["h1"] == ["Head line"] and p["lang"] == "en" and p["descriptions"] == ["About it"]
    assert p["canonicals"] == [("/other", True, "https://h.example/other")]
    a = next(x for x in p["links"] if x[1] == html.ANCHOR)
    assert a[2] == "Click here" and a[3] == (1 | 2 | 1 << 8) and a[4] == "https://h.example/x?utm_source=a"
    images = [x for x in p["links"] if x[1] == html.IMAGE]
    assert images[0][3] & 8 == 0 and images[1][3] & 24 == 24 and images[0][3] >> 8 == 5
    assert p["json_ld"][0] == (["Product"], None) and p["json_ld"][1][1]
    assert p["products"][0]["low_price"] == 1009.5 and p["products"][0]["availability"] == "InStock" and p["products"][0]["images"] == 2
    assert p["text"] == "Click here Head line One two three" and p["word_count"] == 7
    assert html.parse(None)["word_count"] == 0 and html.parse("<body><p><b>x<br>")["text"] == "x"


def test_decode():
    assert html.decode("é".encode("latin-1"), "ISO-8859-1") == "é" and html.decode(b'<meta charset="windows-1252">\x93') .endswith("“")
    assert html.decode(b"\xef\xbb\xbfx") == "x" and html.decode(None) == "" and html.decode(b"\xff\xfea\x00") == "a"


def test_row_rules_over_parsed_pages(spark):
    df = spark.createDataFrame([(1, "https://h.example/dir/page", PAGE, 200, 2)], "id long, url string, html string, status_code int, indexability int")
    got = {r.code for r in row_rules.audit(html.facts(html.parsed(df), "h.example"), ecommerce=True).collect()}
    assert {"title_below_30_characters", "h2_missing", "links_internal_nofollow", "links_non_descriptive_anchor", "security_mixed_content", "images_missing_alt_text", "images_missing_alt_attribute", "images_missing_dimensions", "canonical_relative", "directives_noindex", "hreflang_invalid_code", "hreflang_missing_self_reference", "hreflang_missing_x_default", "structured_data_parse_error", "ecom_product_no_identifier"} <= got
    assert not {"title_missing", "h1_missing", "canonical_missing", "canonical_outside_head", "canonical_multiple_conflicting", "ecom_product_no_price", "directives_nofollow", "title_over_60_characters"} & got


def test_robots(spark):
    body = "User-agent: *\nDisallow: /a\nAllow: /a/b$\nDisalow: /*.pdf\n\nUser-agent: Own\nUser-agent: other # x\nDisallow: /own\nSitemap: https://h.example/s.xml"
    groups, maps = robots.parse(body)
    assert [g[0] for g in groups] == [["*"], ["own", "other"]] and maps == ["https://h.example/s.xml"]
    files = spark.createDataFrame([("https://h.example", body), ("https://e.example", None)], "origin string, body string")
    pages = spark.createDataFrame([(f"https://h.example{t}", "https://h.example", t) for t in ("/a", "/a/b", "/a/b/c", "/x.pdf?q", "/own", "/robots.txt")] + [("https://e.example/a", "https://e.example", "/a")], "url string, origin string, target string")
    rules = robots.rules(files)
    got = {r.url[8:]: (r.allowed, r.line) for r in robots.verdicts(pages, rules, "bot").collect()}
    h = "h.example"
    assert got == {f"{h}/a": (False, 2), f"{h}/a/b": (True, 3), f"{h}/a/b/c": (False, 2), f"{h}/x.pdf?q": (False, 4), f"{h}/own": (True, None), f"{h}/robots.txt": (True, None), "e.example/a": (True, None)}
    own = {r.url[17:]: r.allowed for r in robots.verdicts(pages, rules, "Own").collect()}
    assert own["/own"] is False and own["/x.pdf?q"] is True
    said = spark.range(1).select(robots.outcome(F.lit(200)), robots.outcome(F.lit(404)), robots.outcome(F.lit(429)), robots.outcome(F.lit(None).cast("int"))).first()
    assert tuple(said) == ("parse", "allow_all", "disallow_all", "disallow_all")


def test_sitemaps(spark):
    ns = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9" xmlns:image="http://i.example"'
    one = f"<urlset {ns}><url><loc> https://h.example/1 </loc><image:image><image:loc>https://h.example/i.png</image:loc></image:image></url><url><loc>https://h.example/2</loc></url></urlset>".encode()
    index = f"<sitemapindex {ns}><sitemap><loc>s1</loc></sitemap><sitemap><loc>s2</loc></sitemap><sitemap><loc>root</loc></sitemap></sitemapindex>".encode()
    assert sitemaps.parse(one) == ("urls", ["https://h.example/1", "https://h.example/2"], False)
    assert sitemaps.parse(one, entries=1) == ("urls", ["https://h.example/1"], True) and sitemaps.parse(one, entries=None, size=None)[2] is False
    assert sitemaps.parse(b"https://h.example/1\nhttps://h.example/2", entries=1) == ("urls", ["https://h.example/1"], True)
    assert sitemaps.parse(b"<html></html>") is None and sitemaps.parse(None) is None and sitemaps.parse(b"\x1f\x8bxx") is None
    files = spark.createDataFrame([("root", index), ("s1", gzip.compress(one)), ("s2", b"https://h.example/2\nhttps://h.example/3\n")], "url string, body binary")
    got = {r.url[-1]: r.sitemap for r in sitemaps.listed(files, spark.createDataFrame([("root",)], "url string")).collect()}
    assert got == {"1": "s1", "2": "s1", "3": "s2"}


@pytest.mark.parametrize(
    ("raw", "base", "want"),
    [
        ("HTTP://User@Example.COM:80/a/./b/../c?x=%7e#f", None, "http://example.com/a/c?x=~"),
        ("../y", "https://h.example/a/b/c", "https://h.example/a/y"),
        ("https://h.example", None, "https://h.example/"),
        ("https://bücher.example/ü", None, "https://xn--bcher-kva.example/%C3%BC"),
        ("mailto:a@b.c", None, None),
        ("", None, None),
        (None, None, None),
        ("https://h.example/%c3%bc?a=1&utm_x=2&b", None, "https://h.example/%C3%BC?a=1&b"),
    ],
)
def test_normalize(raw, base, want):
    assert urls.normalize(raw, base, ("utm_*",)) == want


def test_functions(spark):
    assert text.fnv1a64(b"ab") == 620445648566982762
    assert [int(x) for x in text.fnv1a64_many([b"ab", b"", b"abc"])] == [text.fnv1a64(b) for b in (b"ab", b"", b"abc")]
    assert text.simhash64([]) == 0
    assert text.pixel_width("ii", 20) < text.pixel_width("WW", 20)
    row = spark.createDataFrame([("/p?x={}",)], "t string").select(
        urls.without_tracking(F.lit("https://h.example/p?gclid=1&b=2#f")).alias("a"), urls.is_tracking_copy(F.lit("https://h.example/p?utm_x=1")).alias("b"),
        urls.template(F.lit("https://h.example/en-gb/products/x")).alias("c"), urls.page_number(F.lit("https://h.example/blog/page/3/")).alias("d"),
        text.valid_hreflang(F.lit("en-GB")).alias("e"), text.valid_hreflang(F.lit("en-UK")).alias("f"), text.valid_hreflang(F.lit("zh-Hant-TW")).alias("g"),
        text.robots_directive(F.lit(None).cast("string"), F.lit("otherbot: noindex, nofollow"), "noindex").alias("h"), text.robots_directive(F.lit(None).cast("string"), F.lit("otherbot: x, googlebot: noindex"), "noindex").alias("i"),
        text.refresh_target(F.lit("5; url='/x'")).alias("j"), measures.price(F.lit("£1,299.00")).alias("k"), measures.price(F.lit("9,99 €")).alias("l"),
        measures.retry_after(F.lit("Wed, 21 Oct 2026 07:28:00 GMT"), F.lit(datetime(2026, 10, 21, 7, 27)).cast("timestamp")).alias("m"), measures.resource_type(F.lit("text/html; charset=x")).alias("n"),
        text.liquid_place(F.lit("/Liquid%20error%20(sections/x.liquid%20line%209)")).alias("o"), urls.image_file(F.lit("https://h.example/cdn/shop/a_480x480.png?v=1")).alias("p"),
        urls.redirects_by_design(F.lit("https://h.example/Login?x")).alias("q"), measures.reason(F.lit(404)).alias("r"),
    ).first()
    assert tuple(row) == ("https://h.example/p?b=2#f", True, "product", 3, True, False, True, False, True, "/x", 1299.0, 9.99, 60.0, 0, "sections/x.liquid line 9", "https://h.example/cdn/shop/a.png", True, "Not Found")
