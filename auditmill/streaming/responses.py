"""Streams of responses: windowed rates and the control of request concurrency."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

SHAPE = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events(spark: SparkSession, folder: str, pattern: str = "events.parquet") -> DataFrame:
    """The event files of a folder as a stream, in event time."""
    raw = spark.readStream.schema(SHAPE).option("pathGlobFilter", pattern).parquet(folder)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def windowed(stream: DataFrame, length: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """Events, failures and mean value per window."""
    span = F.window("ts", length, slide) if slide else F.window("ts", length)
    agg = stream.withWatermark("ts", late).groupBy(span).agg(F.count(F.lit(1)).alias("events"), F.count_if(F.col("event_type") == "error").alias("failures"), F.avg("value").alias("mean_value"))
    return agg.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "events", "failures", "mean_value")


class Control:
    """Additive increase, multiplicative decrease of one host's concurrency."""

    def __init__(self, limit: int = 5, best: float | None = None, least: int = 1, most: int = 100):
        self.limit, self.best, self.least, self.most = limit, best, least, most

    def step(self, samples: int, failures: int, mean: float) -> int:
        """The limit after one window: halved if pushed back, lowered if slowed, else raised."""
        if samples < 4:
            return self.limit
        if failures > 0.2 * samples:
            self.limit = max(self.least, self.limit // 2)
        elif self.best is not None and mean > 1.5 * self.best:
            self.limit = max(self.least, self.limit - 1)
        else:
            self.limit = min(self.most, self.limit + 1)
        self.best = mean if self.best is None else min(self.best * 1.05, mean)
        return self.limit


def _control(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    limit, best = state.get if state.exists else (5, None)
    c = Control(limit, best)
    pdf = pd.concat(list(batches)).sort_values("ts")
    n = 0
    for _, w in pdf.groupby(pdf["ts"].dt.floor("1h")):
        c.step(len(w), int((w["event_type"] == "error").sum()), float(w["value"].fillna(0).mean()))
        n += 1
    state.update((c.limit, c.best))
    yield pd.DataFrame({"event_type": [key[0]], "windows": [n], "limit_now": [c.limit]})


def controlled(stream: DataFrame) -> DataFrame:
    """The concurrency limit per kind of event, folded over hourly windows and kept as state."""
    shape = "event_type string, windows long, limit_now long"
    return stream.withColumn("kind", F.col("event_type")).groupBy("kind").applyInPandasWithState(_control, shape, "limit_now long, best double", "append", GroupStateTimeout.NoTimeout)


def drained(stream: DataFrame, name: str, mode: str, folder: str) -> DataFrame:
    """What a stream gives for all files there are now, as a table of this session."""
    spark = stream.sparkSession
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", folder).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)
