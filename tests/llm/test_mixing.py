import random
from collections import Counter

import pytest

from auditmill.llm import mixing

SHAPE = "doc_id long, source string, lang string, host string, text string, tokens int, turn int"
TARGETS = "source string, target_weight double, max_repeats int"


def docs(seed=9):
    rng = random.Random(seed)
    rows = []
    for i in range(500):
        s = rng.choice(["big", "big", "big", "mid", "small"] if i % 9 else ["tiny"])
        rows.append((i, s, rng.choice(["en", "EN", "de-AT", None, " "]), rng.choice(["h1", "h2", None]), f"text {i} " + "word " * rng.randrange(1, 30), 0, 0))
    rows += [(600 + i, "mid", "en", "h1", "copied text", 0, 0) for i in range(50)]
    return rows + [(700, "big", "en", "h1", None, 0, 0), (701, "big", "en", "h1", "", 0, 0), (702, "none", "en", "h1", "not wanted", 0, 0)]


@pytest.fixture(scope="module")
def texts(spark):
    return mixing.unique_texts(spark.createDataFrame(docs(), SHAPE)).cache()


def test_texts_are_unique(texts):
    rows = {r.doc_id: r for r in texts.collect()}
    assert rows[600].copies == 50 and 601 not in rows and 700 not in rows and 701 not in rows
    assert {r.lang for r in rows.values()} == {"en", "de", "und"}


def test_reachable_targets_are_met(spark, texts):
    targets = spark.createDataFrame([("big", 0.5, 1), ("mid", 0.3, 2), ("small", 0.2, 3)], TARGETS)
    chosen, by_source = mixing.mix(texts, targets)
    report = {r.source: r for r in mixing.shares(chosen, texts, targets, by_source).collect()}
    for s, w in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert abs(report[s].share - w) < 0.02
        assert report[s].most_uses <= {"big": 1, "mid": 2, "small": 3}[s]
    assert sum(r.share for r in report.values()) == pytest.approx(1)


def test_shortage_goes_to_siblings_and_repeats_are_capped(spark, texts):
    targets = spark.createDataFrame([("big", 0.3, 3), ("mid", 0.2, 3), ("tiny", 0.5, 2), ("absent", 0.0, 2)], TARGETS)
    chosen, by_source = mixing.mix(texts, targets, total_tokens=9000)
    budget = {r.source: r.budget for r in by_source.collect()}
    held = {r.source: r.n for r in texts.groupBy("source").agg({"tokens": "sum"}).withColumnRenamed("sum(tokens)", "n").collect()}
    assert budget["tiny"] == 2 * held["tiny"] and sum(budget.values()) == pytest.approx(9000)
    assert budget["big"] / budget["mid"] == pytest.approx(1.5)
    rows = chosen.collect()
    assert len({r.doc_id for r in rows}) == len(rows) and {r.source for r in rows} == {"big", "mid", "tiny"}
    used = Counter()
    for r in rows:
        used[r.source] += r.tokens * r.uses
    for s, b in budget.items():
        assert abs(used[s] - b) <= 20
    assert {tuple(r) for r in mixing.mix(texts, targets, total_tokens=9000)[0].collect()} == {tuple(r) for r in rows}


def test_more_than_there_is_uses_all_to_the_limit(spark, texts):
    targets = spark.createDataFrame([("big", 0.5, 2), ("tiny", 0.5, 1)], TARGETS)
    chosen, _ = mixing.mix(texts, targets, total_tokens=10**7)
    assert {(r.source, r.uses) for r in chosen.select("source", "uses").distinct().collect()} == {("big", 2), ("tiny", 1)}


def test_empty(spark, texts):
    targets = spark.createDataFrame([("big", 1.0, 2)], TARGETS)
    chosen, by_source = mixing.mix(texts.limit(0), targets)
    assert chosen.count() == 0
    assert [r.share for r in mixing.shares(chosen, texts.limit(0), targets, by_source).collect()] == [0.0]


def test_reachable_total():
    assert mixing.reachable_total({"a": (0.5, 100.0), "b": (0.45, 900.0), "c": (0.05, 1.0)}, 0.1) == 200.0
    assert mixing.reachable_total({}, 0.1) == 0.0


def test_shared_texts_serve_the_source_that_falls_short(spark):
    rows = [(i, "a", "en", "h", f"own {i}", 0, 0) for i in range(20)]
    rows += [(100 + i, "a", "en", "h", f"shared {i}", 0, 0) for i in range(400)] + [(1000 + i, "b", "en", "h", f"shared {i}", 0, 0) for i in range(400)]
    rows += [(1, "none", "en", "h", "of b too", 0, 0), (2000, "b", "en", "h", "of b too", 0, 0), (3000, "none", "en", "h", "of none", 0, 0)]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 1)], TARGETS)
    got = mixing.unique_texts(spark.createDataFrame(rows, SHAPE), targets=targets).collect()
    assert len(got) == 422 and {r.doc_id for r in got} <= {r[0] for r in rows}
    held = Counter(r.source for r in got)
    assert abs(held["a"] - held["b"]) < 60 and held["none"] == 1
    assert all(r.source == ("a" if r.doc_id < 1000 else "none" if r.doc_id == 3000 else "b") for r in got)
    assert sum(r.copies for r in got) == len(rows)


def test_dealt_shares_level_out():
    got = mixing.dealt_shares({("a",): 100.0, ("a", "b"): 50.0, ("b", "c"): 70.0}, {"a": 1.0, "b": 1.0, "c": 1.0})
    assert got[("a", "b")] == pytest.approx([0, 1], abs=1e-4) and got[("b", "c")] == pytest.approx([1 / 7, 6 / 7], abs=1e-3)
