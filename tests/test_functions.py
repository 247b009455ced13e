"""Text and URL functions against the results written beside them."""

from pyspark.sql import functions as F

from auditmill.functions import measures, text, urls as U


def check(spark, cases, column):
    """``column`` over all inputs at once, each beside its result."""
    width = len(cases[0]) - 1
    shape = ", ".join(f"c{i} string" for i in range(width))
    df = spark.createDataFrame([c[:-1] for c in cases], shape).coalesce(1)
    got = df.select("*", column(*[F.col(f"c{i}") for i in range(width)]).alias("got")).collect()
    assert [tuple(r) for r in got] == cases


def test_rewrites(spark):
    cases = [
        ("/products/soap®", "/products/soap", "removed:®"),
        ("/products/soap-1", "/products/soap", "removed:-#"),
        ("/products/soap", "/products/soap-2", "inserted:-#"),
        ("/products/soap", "/products/soap-refill", "inserted:-refill"),
        ("/blog/summer-tips", "/blogs/blog/summer-tips", "moved:/blog>/blogs/blog"),
        ("/a/Thing", "/a/thing", None),
        ("/old", "/new", None),
        ("/about", "/about/us", None),
        ("/a", "/b/a", None),
        ("", "/x", None),
        ("/x", "", None),
        (None, "/x", None),
        ("/x", None, None),
        ("/aaa", "/aa", "removed:a"),
        ("/shop/12/x-page", "/shop/x-page", None),
        ("/" + "a" * 2000 + "-1", "/" + "a" * 2000, "removed:-#"),
    ]
    check(spark, cases, text.rewrite_kind)


def test_template_errors(spark):
    cases = [
        ("/products/Liquid%20error%20(snippets/size-guide.liquid%20line%20253)", "snippets/size-guide.liquid line 253"),
        ("/x/Liquid+error+line+7:+oops", "line 7"),
        ("/x/liquid error", "the theme"),
        ("/x/liquid error (sections/)", "the theme"),
        ("/snippets/size line 4", None),
        ("/bad%zz liquid error layout/theme", "layout/theme"),
        ("", None),
        (None, None),
    ]
    check(spark, cases, text.liquid_place)


def test_image_files(spark):
    cases = [
        ("https://x.de/a/logo.PNG?width=600", "https://x.de/a/logo.PNG"),
        ("https://x.de/image.php?id=12", "https://x.de/image.php?id=12"),
        ("https://x.de/cdn/shop/files/logo_480x480.png?v=1", "https://x.de/cdn/shop/files/logo.png"),
        ("https://x.de/cdn/shop/files/logo_x200.png", "https://x.de/cdn/shop/files/logo.png"),
        ("https://x.de/cdn/shop/files/my_logo_1024x1024_crop_center@2x.jpg", "https://x.de/cdn/shop/files/my_logo.jpg"),
        ("https://x.de/cdn/shop/files/logo_large.png", "https://x.de/cdn/shop/files/logo.png"),
        ("https://x.de/cdn/shop/files/my_logo.png", "https://x.de/cdn/shop/files/my_logo.png"),
        ("https://x.de/cdn/shop/files/logo_crop_center.png", "https://x.de/cdn/shop/files/logo_crop_center.png"),
        ("https://x.de/files/logo_large.png", "https://x.de/files/logo_large.png"),
        ("https://cdn.shopify.com/s/files/1/0750/7322/5010/files/logo_small.png?v=3", "https://x.de/cdn/shop/files/logo.png"),
        ("https://cdn.shopify.com/s/files/1/0750/7322/t/2/a.css", "https://x.de/cdn/shop/t/2/a.css"),
        ("https://cdn.shopify.com/s/files/1/a/b.png", "https://cdn.shopify.com/s/files/1/a/b.png"),
        ("", ""),
    ]
    check(spark, cases, lambda c: U.image_file(c, "https://x.de"))


def test_labels(spark):
    cases = [
        ("https://example.com/", "example.com"),
        ("http://www.example.com/a%20b?utm_source=x&q=1", "http://www.example.com/a b?q=1"),
        ("https://example.com/" + "a" * 60 + "/" + "b" * 30 + "/last", "example.com/…/" + "b" * 30 + "/last"),
        ("https://example.com/" + "a" * 200, "example.com/…/" + "a" * 65 + "…"),
        ("no address", "no address"),
    ]
    check(spark, cases, U.readable)


def test_reasons(spark):
    codes = [200, 205, 299, 404, 413, 499, 525, 599, 77, 700, None]
    rows = spark.createDataFrame([(c,) for c in codes], "s int").select("s", measures.reason(F.col("s")).alias("r")).collect()
    assert [r.r for r in rows] == ["OK", "Reset Content", "Success", "Not Found", "Content Too Large", "Client Error", "SSL Handshake Failed", "Server Error", "Unknown", "Unknown", None]


def test_hreflang(spark):
    values = {"de": True, "de-AT": True, "de-XX": False, "en-UK": False, "en-GB": True, "zh-Hant-TW": True, "x-default": True, "xx": False, "": False, None: False, "de-AT-x": False}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", text.valid_hreflang(F.col("v")).alias("ok")).collect()
    assert {r.v: r.ok for r in rows} == values
