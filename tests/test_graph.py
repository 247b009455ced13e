import random

from auditmill.operators.graph import crawl_depth
from auditmill.plans import queries


def brute(edges, starts):
    out, front, d = dict.fromkeys(starts, 0), set(starts), 0
    while front:
        d += 1
        front = {b for a, b in edges if a in front} - out.keys()
        out.update(dict.fromkeys(front, d))
    return out


def test_depth_of_archives_longer_than_any_limit(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 112)] + [(rng.randrange(1, 40), rng.randrange(200, 240)) for _ in range(60)] + [(50, 3), (300, 301)]
    got = crawl_depth(spark.createDataFrame(edges, "source_id long, target_id long"), spark.createDataFrame([(1,), (200,)], "id long")).collect()
    want = brute(edges, [1, 200])
    assert {r.id: r.depth for r in got} == want and len(got) == len(want) and max(want.values()) > 100


def test_query_follows_more_than_twelve_clicks(spark, tmp_path):
    spark.createDataFrame([(i, i + 1, 0) for i in range(20)], "source_id long, target_id long, type int").write.parquet(f"{tmp_path}/links.parquet")
    spark.createDataFrame([(0,)], "id long").write.parquet(f"{tmp_path}/hub_urls.parquet")
    assert {r.id: r.depth for r in queries()["gr3_crawl_depth"](spark, str(tmp_path)).collect()} == {i: i for i in range(21)}
