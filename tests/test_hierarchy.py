import random

import pytest

from auditmill.operators.hierarchy import descendants, paths, trees

SHAPE = "id long, redirect_to_id long, ptr string, hops int"


def brute(edges):
    out = {}
    for i in edges:
        seen, cur = [], i
        while cur in edges and cur not in seen:
            seen.append(cur)
            cur = edges[cur]
        if cur in seen:
            k = seen.index(cur)
            out[i] = (min(seen[k:]), k, 1, [*seen[:k], cur])
        else:
            out[i] = (cur, len(seen), 0, [*seen, cur])
    return out


def frame(spark, edges):
    return spark.createDataFrame([(a, b, "x", 0) for a, b in edges], SHAPE)


@pytest.mark.parametrize(("seed", "every", "limit"), [(1, 3, 4), (2, 8, 8)])
def test_random_graphs(spark, seed, every, limit):
    rng = random.Random(seed)
    edges = {i: rng.choice([i + 1, rng.randrange(400), 7, i]) for i in range(0, 300)}
    edges.update({1000 + i: 1001 + i for i in range(70)})
    edges.update({2000 + i: 2000 + (i + 1) % 37 for i in range(37)})
    want = brute(edges)
    p = paths(frame(spark, [*edges.items(), (5000, None), (None, 3)]), every=every, limit=limit).collect()
    assert {r.id: (r.root_id, r.depth, r.is_cycle, r.path) for r in p} == want and len(p) == len(want)


@pytest.mark.parametrize("length", [20, 100])
def test_long_tails_into_cycles_without_splitters(spark, length):
    edges = {0: 0, 1000: 1001, 1001: 1000}
    edges.update({i: i - 1 for i in range(1, length + 1)})
    edges.update({2000 + i: 1999 + i for i in range(1, length + 1)})
    edges[2001] = 1001
    p = paths(frame(spark, edges.items()), every=10**9).collect()
    assert {r.id: (r.root_id, r.depth, r.is_cycle, r.path) for r in p} == brute(edges)


def test_small_cases(spark):
    got = {r.id: (r.root_id, r.depth, r.is_cycle) for r in trees(frame(spark, [(1, 1), (2, 1), (3, 9), (3, 8), (4, 3), (4, 3)])).collect()}
    assert got == {1: (1, 0, 1), 2: (1, 1, 1), 3: (8, 1, 0), 4: (8, 2, 0)}
    down = {tuple(r) for r in descendants(frame(spark, [(1, 2), (2, 3), (4, 4)])).collect()}
    assert down == {(2, 1, 1), (3, 1, 2), (3, 2, 1)}


def test_empty(spark):
    assert trees(frame(spark, [(1, None)])).count() == 0
    assert paths(frame(spark, []).limit(0)).count() == 0
