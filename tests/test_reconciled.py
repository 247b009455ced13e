from datetime import datetime, timedelta

from auditmill.audit.visibility import reconciled
from auditmill.plans import queries

T0 = datetime(2026, 1, 1)


def test_literal_tasks(spark):
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "code string")
    have = spark.createDataFrame([("b", True), ("c", False), ("d", True), ("e", True), ("f", False)], "code string, is_open boolean")
    skip = spark.createDataFrame([("e",)], "code string")
    for complete, d in ((False, "leave"), (True, "close")):
        assert {tuple(r) for r in reconciled(wanted, have, skip, complete).collect()} == {("a", "create"), ("b", "update"), ("c", "reopen"), ("d", d), ("e", "close"), ("f", "leave")}


def test_query_reconciles_the_issues_of_crawls(spark, tmp_path):
    crawls = [(1, "h", T0, "done"), (2, "h", T0 + timedelta(1), "done"), (3, "h", T0 + timedelta(2), "done"), (4, "h", T0 + timedelta(3), "aborted")]
    codes = {"new": (200, 200, 404), "same": (200, 404, 404), "back": (500, 200, 503), "gone": (200, 404, None), "old": (404, 200, 200), "fine": (200, 301, 200), "moved": (200, 404, 500)}
    rows = [(c + 1, u, v[c], T0, T0) for u, v in codes.items() for c in range(3) if v[c]] + [(4, "fine", 404, T0, T0), (3, "fine", 404, T0 - timedelta(1), T0)]
    spark.createDataFrame(crawls, "crawl_id long, host string, started_at timestamp, status string").write.parquet(f"{tmp_path}/crawls.parquet")
    spark.createDataFrame(rows, "crawl_id long, url string, status_code int, crawled_at timestamp, received_at timestamp").write.parquet(f"{tmp_path}/url_snapshots.parquet")
    got = {tuple(r) for r in queries()["set4_crawls_reconciled"](spark, str(tmp_path)).collect()}
    want = {("4xx new", "create"), ("4xx same", "update"), ("5xx back", "reopen"), ("4xx gone", "close"), ("4xx old", "leave"), ("4xx moved", "close"), ("5xx moved", "create")}
    assert got == {(f"{c[:3]} h {c[4:]}", a) for c, a in want}
