"""Sinks, table changes and scope on small tables with nulls, empty texts and repeated rows."""

from pathlib import Path

from pyspark.sql import functions as F

from auditmill import sinks
from auditmill.operators import compare, store
from auditmill.sources import scope


def test_csv_files_begin_with_a_mark_and_end_lines_as_spreadsheets_do(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b", c', 2.25), (2, None, None), (2, "", 3.0)], "id int, `x,y` string, ms double").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "out"))
    data = b"".join(p.read_bytes() for p in sorted(Path(tmp_path / "out").glob("part-*")))
    assert data == '﻿id,"x,y",ms\r\n1,"a ""b"", c",2.3\r\n2,,\r\n2,,3.0\r\n'.encode() or data == '﻿id,"x,y",ms\r\n1,"a ""b"", c",2.2\r\n2,,\r\n2,,3.0\r\n'.encode()


def test_upserts_keep_what_discovery_said(spark):
    urls = spark.createDataFrame([(1, "u1", 2, 200), (2, "u2", 3, None)], "id long, url string, depth int, status_code int")
    got = store.upserted(urls, spark.createDataFrame([(2, 9, 404), (3, 1, None)], "id long, depth int, status_code int"))
    assert {tuple(r) for r in got.collect()} == {(1, "u1", 2, 200), (2, "u2", 3, 404), (3, None, 1, None)}
    assert store.upserted(urls, urls.limit(0)).count() == 2


def test_scope_takes_the_first_reason(spark):
    s = scope.Scope("a.test", include=("/x",), outside_start_folder=False, start_folder="/x", internal_nofollow=False, max_repeats=2)
    rows = [("https://a.test/x/1", True), ("https://a.test/y", True), ("https://a.test/x/1", False), ("https://b.test/", True), ("https://a.test/x/x/x", True), (None, True)]
    df = spark.createDataFrame(rows, "url string, ok boolean").coalesce(1).select(scope.decision(s, F.col("url"), F.lit(1), F.lit(0), F.col("ok")))
    assert [r[0] for r in df.collect()] == ["crawl", "skip: Outside start folder", "skip: Nofollow link", "crawl", "skip: Repeating path segments (possible crawler trap)", "crawl"]


def test_headlines():
    assert compare.headline(1, 0, 2, 0) == "1 new URL, 2 new issues" and compare.headline(0, 1200, 0, 3) == "1,200 gone, 3 fixed" and compare.headline(0, 0, 0, 0) == "No changes"
