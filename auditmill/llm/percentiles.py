"""Mergeable percentiles of very large numeric columns with bounded relative error.

A value is counted in a signed logarithmic bucket whose width is fixed relative
to the value, so every value of a bucket is within ``accuracy`` of the bucket's
middle. A sketch is a plain table (keys, bucket, n); sketches of days, files or
partitions are combined by adding the counts of equal buckets. The number of
buckets of a key is bounded by the range of doubles, whatever its rows.

Defined results. Null and NaN are no values; infinities are no values either.
Zero has a bucket of its own. Keys may be null. Keys without values have no
rows. Ties and repeated rows count each time. A percentile is the smallest
value that at least pct percent of the values don't exceed.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY = 0.005


def _gamma(accuracy: float) -> float:
    if not 0 < accuracy < 1:
        raise ValueError("accuracy must lie between 0 and 1")
    return (1 + accuracy) / (1 - accuracy)


def _bias(accuracy: float) -> int:
    """More than the largest bucket number of any double."""
    return math.ceil(760 / math.log(_gamma(accuracy)))


def bucket(value: Column, accuracy: float = ACCURACY) -> Column:
    """The signed bucket of a finite value; buckets are in the order of the values."""
    log = F.ceil(F.log(F.abs(value)) / math.log(_gamma(accuracy))).cast("long") + _bias(accuracy)
    return F.when(value == 0, F.lit(0).cast("long")).when(value > 0, log).otherwise(-log)


def _edge(b: Column, accuracy: float) -> Column:
    """The largest size a value of the bucket can have."""
    return F.exp((F.abs(b) - _bias(accuracy)) * math.log(_gamma(accuracy)))


def middle(b: Column, accuracy: float = ACCURACY) -> Column:
    """The value within ``accuracy`` of all values of the bucket."""
    return F.when(b == 0, F.lit(0.0)).otherwise(F.signum(b.cast("double")) * _edge(b, accuracy) * (1 - accuracy))


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def sketch(df: DataFrame, keys: Sequence[str], values: Sequence[str], accuracy: float = ACCURACY, usable=finite) -> DataFrame:
    """(keys, field_name, bucket, n) of the named columns."""
    cells = F.array(*[F.struct(F.lit(v).alias("field_name"), F.col(v).cast("double").alias("value")) for v in values])
    rows = df.select(*keys, F.inline(cells)).filter(usable(F.col("value")))
    return rows.groupBy(*keys, "field_name", bucket(F.col("value"), accuracy).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge(sketches: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One sketch of several, by adding up; keys may be fewer than the sketches have."""
    rows = reduce(DataFrame.unionByName, [s.select(*keys, "field_name", "bucket", "n") for s in sketches])
    return rows.groupBy(*keys, "field_name", "bucket").agg(F.sum("n").alias("n"))


def percentiles(sketched: DataFrame, keys: Sequence[str], pcts: Sequence[float], accuracy: float = ACCURACY) -> DataFrame:
    """(keys, field_name, pct, bucket, estimate, values, below): ``below`` values lie in lower buckets."""
    group = [*keys, "field_name"]
    run = Window.partitionBy(*group).orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*group)
    at = sketched.withColumns({"upto": F.sum("n").over(run), "values": F.sum("n").over(whole)})
    rank = F.greatest(F.ceil(F.col("values") * F.col("pct") / 100.0), F.lit(1))
    kind = "int" if all(float(p).is_integer() for p in pcts) else "double"
    return (
        at.withColumn("pct", F.explode(F.array(*[F.lit(p).cast(kind) for p in pcts])))
        .filter((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
        .select(*group, "pct", "bucket", middle(F.col("bucket"), accuracy).alias("estimate"), "values", (F.col("upto") - F.col("n")).alias("below"))
    )


def above(df: DataFrame, keys: Sequence[str], values: Sequence[str], pcts: Sequence[float], limit: float, least: int, accuracy: float = ACCURACY, usable=finite) -> DataFrame:
    """(keys, field_name, pct) whose percentile is greater than ``limit`` over at least ``least`` values.

    The sketch decides except where the percentile falls into the bucket of
    ``limit`` itself; there the values of these groups are counted against it.
    """
    found = percentiles(sketch(df, keys, values, accuracy, usable), keys, pcts, accuracy).filter(F.col("values") >= least)
    edge = bucket(F.lit(float(limit)), accuracy)
    group = [*keys, "field_name"]
    sure = found.filter(F.col("bucket") > edge).select(*group, "pct")
    open_ = found.filter(F.col("bucket") == edge).select(*group, "pct", "values")
    cells = F.array(*[F.struct(F.lit(v).alias("field_name"), F.col(v).cast("double").alias("value")) for v in values])
    inside = df.select(*keys, F.inline(cells)).filter(usable(F.col("value")) & (F.col("value") <= limit))
    same_group = reduce(lambda a, b: a & b, [F.col(f"i.{k}").eqNullSafe(F.col(f"o.{k}")) for k in group])
    inside = inside.alias("i").join(open_.select(*group).distinct().alias("o"), same_group, "left_semi")
    upto = inside.groupBy(*group).agg(F.count(F.lit(1)).alias("upto"))
    same = reduce(lambda a, b: a & b, [F.col(f"o.{k}").eqNullSafe(F.col(f"u.{k}")) for k in group])
    checked = open_.alias("o").join(upto.alias("u"), same, "left").filter(F.coalesce("u.upto", F.lit(0)) * 100.0 < F.col("o.values") * F.col("o.pct"))
    return sure.unionByName(checked.select(*[F.col(f"o.{k}") for k in group], F.col("o.pct")))
