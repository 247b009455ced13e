import random
from collections import Counter, defaultdict

import pytest

from auditmill.llm import packing
from auditmill.llm.tokens import counts

SHAPE = "doc_id long, source string, text string, tokens int, cluster string, chunk int"


def docs(seed=4, n=250):
    rng = random.Random(seed)
    words = ["lamp", "oak", "table", "the", "of", "München", "42"]
    rows = [(i, rng.choice(["a", "b", None]), " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))), 0, "", 0) for i in range(n)]
    rows += [(1000 + i, "a", "Same text here" if i % 2 else "SAME  text, here!", 0, "", 0) for i in range(90)]
    return rows + [(2000, "b", None, 0, "", 0), (2001, "b", "", 0, "", 0), (2002, "c", "word " * 777, 0, "", 0), (2003, "c", "word " * 777, 0, "", 0)]


def test_everything_is_packed_within_capacity_and_without_conflicts(spark):
    rows = docs()
    got = packing.packed(spark.createDataFrame(rows, SHAPE), [("s", 50), ("l", 200)], items_per_task=100).collect()
    size = dict(zip([r[0] for r in rows], counts([r[2] for r in rows]), strict=True))
    for name, cap in (("s", 50), ("l", 200)):
        mine = [r for r in got if r.container == name]
        held = Counter()
        for r in mine:
            held[r.doc_id] += r.tokens
        assert held == Counter({k: v for k, v in size.items()})
        assert {r.doc_id for r in mine} == set(size)
        bins = defaultdict(list)
        for r in mine:
            if r.bin_id is not None:
                bins[r.bin_id].append(r)
        assert all(sum(r.tokens for r in b) <= cap for b in bins.values())
        parts = Counter(r.doc_id for r in mine)
        assert all(parts[i] == max(1, -(-n // cap)) for i, n in size.items())
        same = lambda b: [r.doc_id for r in b if 1000 <= r.doc_id < 1090]
        assert all(len(same(b)) <= 1 for b in bins.values())
        assert {r.doc_id for r in mine if r.bin_id is None} == {2000, 2001}


def test_sweep_and_single_placement_agree_on_quality():
    sizes = [10] * 400 + [7] * 300 + [3] * 300
    bins = packing.pack(sizes, list(range(1000)), ["a"] * 1000, 20)
    used = Counter()
    for b, s in zip(bins, sizes, strict=True):
        used[b] += s
    assert max(used.values()) <= 20 and len(used) <= 355


def test_sources_kept_apart():
    bins = packing.pack([5, 5, 5, 5], [1, 2, 3, 4], ["a", "b", "a", "b"], 100, apart=[("a", "b")])
    assert bins[0] == bins[2] != bins[1] == bins[3]


def test_fill_empty_and_bad_capacity(spark):
    df = spark.createDataFrame(docs(), SHAPE)
    f = packing.fill(packing.packed(df.filter("doc_id < 1000"), [("l", 200)]), [("l", 200)]).collect()[0]
    assert f.filled > 0.94 and f.fullest <= 200
    assert packing.packed(df.limit(0), [("l", 200)]).count() == 0
    with pytest.raises(ValueError, match="capacity"):
        packing.packed(df, [("x", 0)])
