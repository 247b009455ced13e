import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from auditmill.operators.skew import balanced_count, balanced_join, plan_load


def skewed(n=3000, seed=1):
    rng = random.Random(seed)
    return [(1 if rng.random() < 0.4 else rng.choice([None, *range(2, 200)]), f"v{i % 7}") for i in range(n)]


def test_counts_equal_plain_counts(spark):
    rows = skewed()
    df = spark.createDataFrame(rows, "k int, v string")
    got = {r.k: r.n for r in balanced_count(df, ["k"]).collect()}
    assert got == Counter(k for k, _ in rows)


def test_load_is_even_and_heavy_keys_are_split(spark):
    df = spark.createDataFrame(skewed(), "k int, v string")
    plan = plan_load(df, ["k"], tasks=8)
    assert len(plan.heavy) == 1 and len(next(iter(plan.heavy.values()))) >= 6
    assert len(plan.heavy) <= 2 * plan.tasks
    assert max(plan.load) < 1.3 * sum(plan.load) / len(plan.load)


@pytest.mark.parametrize("how,tasks", [("inner", 8), ("left", 8), ("left_semi", 5), ("left_anti", 8), ("inner", None), ("left_anti", None)])
def test_joins_equal_brute_force(spark, how, tasks):
    rows = skewed(800)
    right = [(1, "a"), (1, "b"), (None, "c"), (5, "d"), (5, "d"), (7, None)]
    left = spark.createDataFrame(rows, "k int, v string")
    plan = plan_load(left, ["k"], tasks) if tasks else None
    got = balanced_join(left, spark.createDataFrame(right, "k int, v string"), ["k"], how, plan)
    want = []
    for k, v in rows:
        met = [b for a, b in right if a == k]
        if how == "inner":
            want += [(k, v, b) for b in met]
        elif how == "left":
            want += [(k, v, b) for b in met or [None]]
        elif (how == "left_semi") == bool(met):
            want.append((k, v))
    assert Counter(map(tuple, got.collect())) == Counter(want)
    assert got.columns == (["k", "v", "v_right"] if how in ("inner", "left") else ["k", "v"])


def test_a_join_runs_where_the_rows_were_packed(spark):
    """Eight tasks, a heavy key: rows are moved once per side, and the longest task is near the median."""
    rows = spark.createDataFrame(skewed(8000), "k int, v string")
    dim = spark.createDataFrame([(k, f"n{k}") for k in range(300)], "k int, w string")
    plan = plan_load(rows, ["k"], tasks=8)
    assert plan.heavy
    joined = balanced_join(rows, dim, ["k"], "left", plan)
    text = joined._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange hashpartitioning") == 2 and "SortMergeJoin" in text
    per_task = Counter(r[0] for r in joined.select(F.spark_partition_id()).collect())
    loads = sorted(per_task.get(t, 0) for t in range(8))
    assert sum(loads) == 8000 and loads[-1] <= 1.5 * (loads[3] + loads[4]) / 2
    plain = rows.join(dim.hint("merge"), "k", "left").repartition(8, "k")
    worst = max(Counter(r[0] for r in plain.select(F.spark_partition_id()).collect()).values())
    assert worst > 2 * loads[-1]


def test_one_group_of_equal_rows_and_empty_tables(spark):
    same = spark.createDataFrame([(9, "x")] * 500, "k int, v string")
    dim = spark.createDataFrame([(9, "one")], "k int, w string")
    assert balanced_join(same, dim, ["k"]).count() == 500
    assert balanced_count(same, ["k"]).collect()[0].n == 500
    none = spark.createDataFrame([], "k int, v string")
    assert balanced_count(none, ["k"]).count() == 0
    assert balanced_join(none, dim, ["k"], "left").count() == 0
    assert balanced_join(same, spark.createDataFrame([], "k int, w string"), ["k"], "left").filter("w IS NULL").count() == 500


def test_other_joins_are_refused(spark):
    df = spark.createDataFrame([(1,)], "k int")
    with pytest.raises(ValueError, match="full_outer"):
        balanced_join(df, df, ["k"], "full_outer")
