import random
from datetime import datetime, timedelta

from auditmill.operators import snapshots
from auditmill.operators.snapshots import snapshot_changes

SNAP = "crawl_id long, host string, url string, status_code int, indexability int, crawled_at timestamp, received_at timestamp, seq int, k1 string"
CRAWLS = "crawl_id long, host string, started_at timestamp, status string"
T0 = datetime(2026, 1, 1)


def brute(snaps, crawls):
    by_host = {}
    for c in sorted((c for c in crawls if c[3] == "done"), key=lambda c: (c[2], c[0])):
        by_host.setdefault(c[1], []).append(c[0])
    state = {}
    for r in sorted(snaps, key=lambda r: (r[5] or datetime.min, r[6] or datetime.min)):
        state.setdefault(r[0], {})[r[2]] = (r[3], r[4])
    out = set()
    for order in by_host.values():
        for a, b in zip(order, order[1:], strict=False):
            x, y = state.get(a, {}), state.get(b, {})
            out |= {(a, b, u, "removed") for u in x.keys() - y.keys()}
            out |= {(a, b, u, "added") for u in y.keys() - x.keys()}
            out |= {(a, b, u, "changed") for u in x.keys() & y.keys() if x[u] != y[u]}
    return out


def test_equals_brute_force(spark):
    rng = random.Random(3)
    crawls = [(i, rng.choice("ab"), T0 + timedelta(days=rng.randrange(90)), rng.choice(["done", "done", "aborted"])) for i in range(14)]
    snaps = []
    for k in range(900):
        at = T0 + timedelta(seconds=k)
        snaps.append((rng.randrange(14), "h", rng.choice([None, "", *map(str, range(30))]), rng.choice([None, 200, 404]), rng.choice([None, 1, 2]), at, at, 1, "x"))
    snaps += snaps[:50]
    got = snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(crawls, CRAWLS), bucket_rows=40)
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(snaps, crawls)
    assert got.columns == ["from_crawl_id", "to_crawl_id", "url", "change_kind"]


def test_null_and_value_swaps_are_changes(spark):
    crawls = [(1, "a", T0, "done"), (2, "a", T0 + timedelta(days=1), "done")]
    snaps = [(1, "a", "u", 1, None, T0, T0, 0, ""), (2, "a", "u", None, 1, T0, T0, 0, ""), (1, "a", "w", None, None, None, None, 0, ""), (2, "a", "w", None, None, None, T0, 0, "")]
    got = snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(crawls, CRAWLS)).collect()
    assert [tuple(r) for r in got] == [(1, 2, "u", "changed")]


def test_a_repeated_url_reaches_its_bucket_once_a_crawl(spark, tmp_path, monkeypatch):
    plain = snapshots._bucket_diff

    def noted(pdf):
        (tmp_path / f"{pdf['bucket'].iloc[0]}").write_text(str(len(pdf)))
        return plain(pdf)

    monkeypatch.setattr(snapshots, "_bucket_diff", noted)
    crawls = [(c, "a", T0 + timedelta(days=c), "done") for c in range(3)]
    snaps = [(k % 3, "a", None, 200 + k % 2, 1, T0 + timedelta(seconds=k), T0, 0, "") for k in range(3000)] + [(k % 3, "a", str(k), 200, 1, T0, T0, 0, "") for k in range(90)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(snaps, SNAP), spark.createDataFrame(crawls, CRAWLS), bucket_rows=1000).collect()}
    assert got == brute(snaps, crawls)
    assert sum(int(p.read_text()) for p in tmp_path.iterdir()) == 93


def test_equal_snapshots_and_empty_tables(spark):
    crawls = spark.createDataFrame([(1, "a", T0, "done"), (2, "a", T0 + timedelta(days=1), "done")], CRAWLS)
    same = [(c, "a", "x" * 5000, 200, 1, T0, T0, 0, "") for c in (1, 2)]
    assert snapshot_changes(spark.createDataFrame(same, SNAP), crawls).count() == 0
    assert snapshot_changes(spark.createDataFrame([], SNAP), crawls).count() == 0
    assert snapshot_changes(spark.createDataFrame(same, SNAP), spark.createDataFrame([], CRAWLS)).count() == 0
