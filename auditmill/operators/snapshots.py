"""What changed between consecutive full snapshots of a site.

Every row becomes a compact record of numbers: a 128-bit hash of (host, url),
a 64-bit hash of the compared values, and the crawl's place in its host's
order. Rows of a URL in a crawl are first reduced to the one that counts, on
the map side too. Records then go to hash buckets of the key; the bucket count
follows the row count, so neither a host nor a URL with a third of all rows
fills its bucket: a key has at most one record a crawl.
In a bucket, numpy sorts the records and finds by ``searchsorted`` which keys
miss in the next or the previous crawl and which have another row hash. Only
for these are the full values fetched.

Defined results. A null url is a key of its own; null values equal only null.
Of several rows of a URL in a crawl the one with the latest ``crawled_at``
counts (null is earliest); ties go to the latest ``received_at``, then to the
larger row hash, so repeated rows change nothing. Rows of crawls that are not
complete, or unknown, take no part. A host with fewer than two complete crawls
and an empty table give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.session import cut

BUCKET_ROWS = 200_000

DIFF = "from_crawl_id long, to_crawl_id long, change_kind string, at_crawl_id long, k1 long, k2 long"


def _null_safe_hash(cols: Sequence[str], seed: str) -> Column:
    parts: list[Column] = [F.lit(seed)]
    for c in cols:
        parts += [F.col(c).isNull(), F.col(c)]
    return F.xxhash64(*parts)


def crawl_order(crawls: DataFrame, done: str = "done") -> DataFrame:
    """Complete crawls with their place, neighbours and whether they have any."""
    w = Window.partitionBy("host").orderBy("started_at", "crawl_id")
    return (
        crawls.filter((F.col("status") == done) & F.col("crawl_id").isNotNull())
        .select("crawl_id", "host", "started_at")
        .select(
            "crawl_id",
            F.col("host").alias("crawl_host"),
            F.row_number().over(w).alias("seq"),
            F.lag("crawl_id").over(w).alias("prev_id"),
            F.lead("crawl_id").over(w).alias("next_id"),
        )
    )


def _bucket_diff(pdf: pd.DataFrame) -> pd.DataFrame:
    """Differences of a bucket that holds one record per key and crawl."""
    k1, k2 = pdf["k1"].to_numpy(), pdf["k2"].to_numpy()
    seq, rh = pdf["seq"].to_numpy().astype(np.int64), pdf["rh"].to_numpy()
    order = np.lexsort((seq, k2, k1))
    k1, k2, seq, rh = k1[order], k2[order], seq[order], rh[order]
    new_key = np.ones(len(k1), bool)
    new_key[1:] = (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])
    key = np.cumsum(new_key) - 1
    span = int(seq.max()) + 2
    cell = key * span + seq
    at = np.searchsorted(cell, cell + 1)
    beyond = np.minimum(at, len(cell) - 1)
    in_next = cell[beyond] == cell + 1
    before = np.minimum(np.searchsorted(cell, cell - 1), len(cell) - 1)
    in_prev = cell[before] == cell - 1
    here, prev_of, next_of = (pdf[c].to_numpy()[order] for c in ("crawl_id", "prev_id", "next_id"))
    has_prev, has_next = (pdf[c].to_numpy().astype(bool)[order] for c in ("has_prev", "has_next"))
    removed = has_next & ~in_next
    changed = has_next & in_next & (rh[beyond] != rh)
    added = has_prev & ~in_prev
    parts = [
        pd.DataFrame({"from_crawl_id": here[m], "to_crawl_id": next_of[m], "change_kind": kind, "at_crawl_id": here[m], "k1": k1[m], "k2": k2[m]})
        for m, kind in ((removed, "removed"), (changed, "changed"))
    ]
    parts.append(pd.DataFrame({"from_crawl_id": prev_of[added], "to_crawl_id": here[added], "change_kind": "added", "at_crawl_id": here[added], "k1": k1[added], "k2": k2[added]}))
    return pd.concat(parts, ignore_index=True)


def _records(rows: DataFrame, buckets: int) -> DataFrame:
    """One compact record per key and crawl, from the latest state, with its bucket."""
    last = rows.groupBy("k1", "k2", "crawl_id", "seq", "prev_id", "next_id").agg(F.max("state")["rh"].alias("rh"))
    return last.select(
        F.pmod("k1", F.lit(buckets)).cast("int").alias("bucket"),
        "k1", "k2", "seq", "crawl_id",
        F.coalesce("prev_id", F.lit(0)).alias("prev_id"), F.coalesce("next_id", F.lit(0)).alias("next_id"),
        F.col("prev_id").isNotNull().alias("has_prev"), F.col("next_id").isNotNull().alias("has_next"),
        "rh",
    )


def snapshot_changes(snapshots: DataFrame, crawls: DataFrame, values: Sequence[str] = ("status_code", "indexability"), bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """(from_crawl_id, to_crawl_id, url, change_kind) between each complete crawl and the next of its host."""
    order = crawl_order(crawls)
    keyed = snapshots.select("crawl_id", "url", "crawled_at", "received_at", *values).join(order, "crawl_id")
    keyed = keyed.withColumns({"k1": _null_safe_hash(["crawl_host", "url"], "a"), "k2": _null_safe_hash(["crawl_host", "url"], "b")})
    buckets = max(1, -(-snapshots.count() // bucket_rows))
    micros = lambda c: F.coalesce(F.unix_micros(F.col(c).cast("timestamp")), F.lit(-(2**62)))
    rows = keyed.select(
        "k1", "k2", "crawl_id", "seq", "prev_id", "next_id",
        F.struct(micros("crawled_at").alias("crawled"), micros("received_at").alias("received"), _null_safe_hash(list(values), "r").alias("rh")).alias("state"),
    )
    diff = cut(_records(rows, buckets).groupBy("bucket").applyInPandas(_bucket_diff, DIFF))
    full = keyed.select(F.col("crawl_id").alias("at_crawl_id"), "k1", "k2", "url")
    return (
        full.join(diff, ["at_crawl_id", "k1", "k2"])
        .dropDuplicates(["from_crawl_id", "to_crawl_id", "change_kind", "k1", "k2"])
        .select("from_crawl_id", "to_crawl_id", "url", "change_kind")
    )
