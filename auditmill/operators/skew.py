"""Per-key work when a few keys hold most of the rows (fragment-replicate).

The load of every key is estimated in two bounded passes: rows per hash bin,
then rows per key inside the overloaded bins only. Light bins and the shards
of heavy keys are packed onto tasks, the largest first onto the least loaded
task. A heavy key is split into as many shards as its load needs; the matching
side of a join is replicated to those shards and nowhere else.

Bounds. A heavy key has more than ``1 / (2 * tasks)`` of the rows, so there are
at most ``2 * tasks`` of them; the bins are a parameter. Only these two small
tables are collected or broadcast.

Defined results. Null is a key like any other and equals null. An empty table
gives an empty result. Repeated rows count each time. Columns of the two sides
of a join that have the same name keep the left one; the right one gets the
suffix ``_right``.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.session import parallelism

# While this is true, Spark moves placed rows again, by all keys of a join. A placed join sets it to false for its session.
PLACED_JOINS = "spark.sql.requireAllClusterKeysForCoPartition"


@dataclass(frozen=True)
class LoadPlan:
    """Where the rows of every key go. ``heavy`` maps a key's hash to its tasks."""

    keys: tuple[str, ...]
    tasks: int
    bins: int
    bin_task: tuple[int, ...]
    heavy: dict[int, tuple[int, ...]]
    load: tuple[float, ...]


def key_hash(keys: Sequence[str]) -> Column:
    """64 bits of the key; null differs from every value."""
    parts: list[Column] = []
    for k in keys:
        parts += [F.col(k).isNull(), F.col(k)]
    return F.xxhash64(*parts)


def plan_load(df: DataFrame, keys: Sequence[str], tasks: int | None = None, bins: int | None = None) -> LoadPlan:
    """Estimate the load per key and pack it onto ``tasks`` tasks."""
    tasks = tasks or parallelism(df.sparkSession)
    bins = bins or max(1024, 16 * tasks)
    hashed = df.select(key_hash(keys).alias("h")).withColumn("b", F.pmod("h", F.lit(bins)).cast("int"))
    per_bin = {r.b: r.n for r in hashed.groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(per_bin.values())
    limit = max(1.0, total / (2 * tasks))
    crowded = [b for b, n in per_bin.items() if n > limit]
    large: dict[int, int] = {}
    if crowded:
        large = {
            r.h: r.n
            for r in hashed.filter(F.col("b").isin(crowded)).groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > limit).collect()
        }
    for h, n in large.items():
        per_bin[h % bins] -= n
    items: list[tuple[float, str, int]] = [(float(n), "bin", b) for b, n in per_bin.items()]
    for h, n in large.items():
        shards = int(-(-n // limit))
        items += [(n / shards, "key", h)] * shards
    items.sort(key=lambda x: (-x[0], x[1], x[2]))
    queue = [(0.0, t) for t in range(tasks)]
    bin_task, heavy = [b % tasks for b in range(bins)], {h: [] for h in large}
    for n, kind, what in items:
        used, t = heapq.heappop(queue)
        if kind == "bin":
            bin_task[what] = t
        else:
            heavy[what].append(t)
        heapq.heappush(queue, (used + n, t))
    load = [0.0] * tasks
    for used, t in queue:
        load[t] = used
    return LoadPlan(tuple(keys), tasks, bins, tuple(bin_task), {h: tuple(t) for h, t in heavy.items()}, tuple(load))


def _heavy_frame(df: DataFrame, plan: LoadPlan) -> DataFrame:
    schema = "__h long, __tasks array<int>"
    return df.sparkSession.createDataFrame([(h, list(t)) for h, t in plan.heavy.items()], schema)


def _light_task(plan: LoadPlan) -> Column:
    at = F.split(F.lit(",".join(map(str, plan.bin_task))), ",").cast("array<int>")
    return F.element_at(at, F.pmod("__h", F.lit(plan.bins)).cast("int") + 1)


def fragment(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df`` with ``__task``: the task of each row; rows of a heavy key go to its shards in turn.

    The turn is the row's position in its input partition, so ``df`` should be
    a scan or a cut, whose order a retried task finds again.
    """
    df = df.withColumn("__h", key_hash(plan.keys))
    if not plan.heavy:
        return df.withColumn("__task", _light_task(plan)).withColumn("__slot", F.lit(0)).drop("__h")
    turn = F.monotonically_increasing_id() + F.spark_partition_id()
    df = df.withColumn("__turn", turn).join(F.broadcast(_heavy_frame(df, plan)), "__h", "left")
    slot = F.when(F.col("__tasks").isNull(), F.lit(0)).otherwise(F.pmod(F.col("__turn"), F.size("__tasks")).cast("int"))
    return (
        df.withColumn("__slot", slot)
        .withColumn("__task", F.coalesce(F.element_at("__tasks", F.col("__slot") + 1), _light_task(plan)))
        .drop("__h", "__tasks", "__turn")
    )


def replicate(df: DataFrame, plan: LoadPlan) -> DataFrame:
    """``df`` with ``__task`` and ``__slot``; a row of a heavy key once for every shard of that key."""
    df = df.withColumn("__h", key_hash(plan.keys))
    if not plan.heavy:
        return df.withColumn("__task", _light_task(plan)).withColumn("__slot", F.lit(0)).drop("__h")
    df = df.join(F.broadcast(_heavy_frame(df, plan)), "__h", "left").withColumn("__tasks", F.coalesce("__tasks", F.array(_light_task(plan))))
    return df.select("*", F.posexplode("__tasks").alias("__slot", "__task")).drop("__h", "__tasks")


def _places(spark: SparkSession, tasks: int) -> Column:
    """For every task a number that Spark's hash partitioning sends there."""
    tried = spark.range(int(tasks * (math.log(tasks + 1) + 20))).select(F.col("id").cast("int").alias("place"))
    found = tried.groupBy(F.pmod(F.hash("place"), F.lit(tasks)).alias("task")).agg(F.min("place").alias("place")).collect()
    at = {r.task: r.place for r in found}
    return F.split(F.lit(",".join(str(at[t]) for t in range(tasks))), ",").cast("array<int>")


def placed(df: DataFrame, plan: LoadPlan, place: str = "__place") -> DataFrame:
    """Rows with ``__task`` in the partition of that number.

    The partitioning is by hash of the column ``place``, which a join on it and more
    keys accepts as it is: where both sides are placed, neither moves again.
    """
    at = F.element_at(_places(df.sparkSession, plan.tasks), F.col("__task") + 1)
    return df.withColumn(place, at).drop("__task").repartition(plan.tasks, place)


def _is_small(df: DataFrame) -> bool:
    """Whether the optimizer knows ``df`` to be small enough to be sent to all tasks."""
    spark = df.sparkSession
    most = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get("spark.sql.autoBroadcastJoinThreshold"))
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= most


def balanced_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", plan: LoadPlan | None = None) -> DataFrame:
    """Join on ``keys`` (null equals null) without a task that gets a whole heavy key.

    ``how`` is inner, left, left_semi or left_anti: each left row is in exactly
    one shard, so these give what the plain join gives. ``left`` should be a
    scan or a cut. A right side of a known small size goes to all tasks instead.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a fragmented left side can't be joined as {how}")
    taken = {c.lower() for c in left.columns}
    names = [c for c in right.columns if c not in keys]
    fresh = {c: f"{c}_right" if c.lower() in taken else c for c in names}
    renamed = [*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[F.col(c).alias(n) for c, n in fresh.items()]]
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(keys)])
    if plan is None and _is_small(right):
        out = left.join(F.broadcast(right.select(*renamed)), same, how)
    else:
        plan = plan or plan_load(left, keys)
        left.sparkSession.conf.set(PLACED_JOINS, "false")
        r = placed(replicate(right, plan).select(*renamed, F.col("__slot").alias("__s"), "__task"), plan, "__p")
        a = placed(fragment(left, plan), plan)
        out = a.join(r.hint("merge"), (F.col("__place") == F.col("__p")) & (F.col("__slot") == F.col("__s")) & same, how)
    return out.select(*left.columns, *([] if how in ("left_semi", "left_anti") else fresh.values()))


def _combine(names: list[str]):
    """Counts rows per key within one map task; partials are merged whenever they grow."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: pa.Table | None = None
        waiting: list[pa.Table] = []
        rows = 0

        def merged() -> pa.Table:
            parts = waiting + ([done] if done is not None else [])
            t = pa.concat_tables(parts).group_by(names).aggregate([("__n", "sum")])
            return t.rename_columns([*names, "__n"] if t.column_names[0] != "__n_sum" else ["__n", *names]).select([*names, "__n"])

        for b in batches:
            t = pa.Table.from_batches([b])
            t = t.append_column("__n", pa.array([1] * 0, pa.int64()) if not b.num_rows else pa.repeat(pa.scalar(1, pa.int64()), b.num_rows))
            waiting.append(t)
            rows += b.num_rows
            if rows > 1_000_000:
                done, waiting, rows = merged(), [], 0
        if waiting or done is not None:
            yield from merged().combine_chunks().to_batches(max_chunksize=100_000)

    return run


def balanced_count(df: DataFrame, keys: Sequence[str], plan: LoadPlan | None = None, name: str = "n") -> DataFrame:
    """Rows per key. Map tasks count first, what they counted goes to the key's
    task (or its shards' tasks), and the shards of heavy keys are added up.
    """
    keys = list(keys)
    rows = df.select(*keys)
    plan = plan or plan_load(rows, keys)
    schema = T.StructType([*rows.schema.fields, T.StructField("__n", T.LongType())])
    partial = fragment(rows.mapInArrow(_combine(keys), schema), plan)
    placed = partial.repartitionById(plan.tasks, F.col("__task"))
    per_shard = placed.groupBy("__task", *keys).agg(F.sum("__n").alias("__n"))
    return per_shard.groupBy(*keys).agg(F.sum("__n").alias(name))
