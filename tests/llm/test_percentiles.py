import math
import random
from datetime import date

import pytest

from auditmill.llm import percentiles as P

SHAPE = "host string, day date, response_ms double, field_name string, bucket string, n int"


def rows(seed=5, n=4000):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        v = rng.choice([rng.lognormvariate(6, 2), -rng.lognormvariate(3, 1), 0.0, None, float("nan"), float("inf"), 7.5])
        out.append((rng.choice(["a", "a", "b", None]), date(2026, 1, 1 + k % 5), v, "x", "y", 1))
    return out


def exact(values, pct):
    v = sorted(values)
    return v[max(math.ceil(len(v) * pct / 100), 1) - 1]


@pytest.mark.parametrize("accuracy", [0.01, 0.0005])
def test_error_is_bounded_and_days_add_up(spark, accuracy):
    data = rows()
    df = spark.createDataFrame(data, SHAPE)
    days = [P.sketch(df.filter(f"day = date'2026-01-0{k}'"), ["host", "day"], ["response_ms"], accuracy) for k in range(1, 6)]
    merged = P.merge(days, ["host"])
    whole = P.sketch(df, ["host"], ["response_ms"], accuracy)
    assert {tuple(r) for r in merged.collect()} == {tuple(r) for r in whole.select(*merged.columns).collect()}
    by_host = {}
    for h, _, v, *_ in data:
        if v is not None and math.isfinite(v):
            by_host.setdefault(h, []).append(v)
    got = P.percentiles(merged, ["host"], [0.5, 50, 90, 99, 100], accuracy).collect()
    assert len(got) == 15
    for r in got:
        want = exact(by_host[r.host], r.pct)
        assert abs(r.estimate - want) <= accuracy * abs(want) + 1e-12, (r, want)


def test_above_is_exact_at_the_limit(spark):
    data = [("a", None, v, "", "", 0) for v in [2000.0] * 60 + [2000.5] * 60] + [("b", None, 2000.0, "", "", 0)] * 99 + [("c", None, 3000.0, "", "", 0)] * 3
    df = spark.createDataFrame(data, SHAPE)
    got = {(r.host, r.pct) for r in P.above(df, ["host"], ["response_ms"], [50, 51, 99], 2000, 50).collect()}
    assert got == {("a", 51), ("a", 99)}


def test_extremes_and_empty(spark):
    df = spark.createDataFrame([("a", None, v, "", "", 0) for v in (5e-324, 1.7e308, -1.7e308)], SHAPE)
    got = [r.estimate for r in P.percentiles(P.sketch(df, ["host"], ["response_ms"]), ["host"], [1, 50, 100]).orderBy("pct").collect()]
    assert got[0] < -1.6e308 and 0 <= got[1] < 1e-300 and got[2] > 1.6e308
    assert P.percentiles(P.sketch(df.limit(0), ["host"], ["response_ms"]), ["host"], [50]).count() == 0
    with pytest.raises(ValueError, match="accuracy"):
        P.bucket(df["response_ms"], 0)
