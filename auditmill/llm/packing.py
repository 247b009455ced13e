"""Filling fixed-capacity containers: conflict-constrained best fit.

Items are dealt to tasks by hash, the largest go first. A task keeps its bins by
what is left in them; an item goes to the tightest bin that has room and no
conflict, else into a new one. Bins carry bitmaps of their sources and of the
duplicate clusters in them: two texts that are the same apart from formatting
never share a bin, nor do sources named as to be kept apart. Items of one
cluster and size are placed in a single sweep over the bins, so a cluster with a
third of all rows costs no more than others. Bins that stay less than ``LOOSE``
full are emptied and packed once more together.

Defined results. A text longer than the capacity is cut into full pieces, each
filling a bin, and a rest that is packed like a text; no other text is split.
Texts without tokens (null, empty) need no room: bin_id is null, part 0. Repeated
documents are items of their own. A capacity below 1 is an error.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Sequence
from itertools import groupby

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.llm.tokens import VOCABULARY, count_batches
from auditmill.session import cut

ITEMS_PER_TASK = 50_000
LOOSE = 0.5
PLACED = "container string, bin_id string, doc_id long, part int, tokens long"


class Bins:
    """Open bins ordered by residual."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.residuals: list[int] = []
        self.at: dict[int, list[int]] = {}
        self.clusters: list[int] = []
        self.sources: list[int] = []
        self.left: list[int] = []

    def _file(self, b: int) -> None:
        r = self.left[b]
        if r in self.at:
            self.at[r].append(b)
        else:
            self.at[r] = [b]
            insort(self.residuals, r)

    def _take(self, r: int, i: int) -> int:
        row = self.at[r]
        b = row[i]
        row[i] = row[-1]
        row.pop()
        if not row:
            del self.at[r]
            self.residuals.pop(bisect_left(self.residuals, r))
        return b

    def put(self, b: int, size: int, cluster: int, source: int) -> None:
        self.left[b] -= size
        self.clusters[b] |= cluster
        self.sources[b] |= source
        if self.left[b]:
            self._file(b)

    def new(self) -> int:
        self.left.append(self.capacity)
        self.clusters.append(0)
        self.sources.append(0)
        return len(self.left) - 1

    def fits(self, b: int, cluster: int, apart: int) -> bool:
        return not (self.clusters[b] & cluster or self.sources[b] & apart)

    def place(self, size: int, cluster: int, source: int, apart: int) -> int:
        """The bin an item goes to: the tightest that is compatible."""
        k = bisect_left(self.residuals, size)
        while k < len(self.residuals):
            r = self.residuals[k]
            row = self.at[r]
            for i in range(len(row)):
                if self.fits(row[i], cluster, apart):
                    b = self._take(r, i)
                    self.put(b, size, cluster, source)
                    return b
            k += 1
        b = self.new()
        self.put(b, size, cluster, source)
        return b

    def sweep(self, n: int, size: int, cluster: int, source: int, apart: int) -> list[int]:
        """Bins for ``n`` items of one cluster: each compatible bin gets one, tightest first."""
        found: list[int] = []
        for r in self.residuals[bisect_left(self.residuals, size) :]:
            for b in self.at[r]:
                if len(found) == n:
                    break
                if self.fits(b, cluster, apart):
                    found.append(b)
        for b in found:
            r = self.left[b]
            self._take(r, self.at[r].index(b))
            self.put(b, size, cluster, source)
        while len(found) < n:
            b = self.new()
            self.put(b, size, cluster, source)
            found.append(b)
        return found


def pack(sizes: Sequence[int], clusters: Sequence[int], sources: Sequence[str | None], capacity: int, apart: Sequence[tuple[str, str]] = ()) -> list[int]:
    """The bin of each item; the largest items are placed first."""
    repeated = {c for c, n in Counter(clusters).items() if n > 1}
    cluster_bit = {c: 1 << i for i, c in enumerate(sorted(repeated))}
    source_bit = {s: 1 << i for i, s in enumerate(sorted(set(sources), key=str))}
    keep_from: dict[str | None, int] = dict.fromkeys(source_bit, 0)
    for a, b in apart:
        if a in source_bit and b in source_bit:
            keep_from[a] |= source_bit[b]
            keep_from[b] |= source_bit[a]
    bins = Bins(capacity)
    out = [-1] * len(sizes)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], clusters[i], str(sources[i]), i))
    for (size, cluster, _), run in groupby(order, key=lambda i: (sizes[i], clusters[i], str(sources[i]))):
        items = list(run)
        bit, source = cluster_bit.get(cluster, 0), sources[items[0]]
        s_bit, away = source_bit[source], keep_from[source]
        if len(items) > 1 and bit:
            for i, b in zip(items, bins.sweep(len(items), size, bit, s_bit, away), strict=True):
                out[i] = b
        else:
            for i in items:
                out[i] = bins.place(size, bit, s_bit, away)
    return out


def _pack_group(round_: int, apart: Sequence[tuple[str, str]]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["doc_id", "part"], kind="stable").reset_index(drop=True)
        b = np.array(pack(pdf["tokens"].tolist(), pdf["cluster"].tolist(), [None if s is None else str(s) for s in pdf["source"]], int(pdf["capacity"].iloc[0]), apart))
        used = np.bincount(b, pdf["tokens"])
        ids = pd.Series(b).map(lambda k: f"r{round_}-{pdf['chunk'].iloc[0]}-{k}")
        return pdf.assign(bin_id=ids, fill=used[b] / pdf["capacity"])

    return run


def packed(docs: DataFrame, containers: Sequence[tuple[str, int]], vocabulary: str = VOCABULARY, apart: Sequence[tuple[str, str]] = (), items_per_task: int = ITEMS_PER_TASK) -> DataFrame:
    """(container, bin_id, doc_id, part, tokens) of ``docs`` (doc_id, source, text), for each container."""
    if any(c < 1 for _, c in containers):
        raise ValueError("a capacity must be at least 1")
    counted = cut(
        docs.select("doc_id", "source", "text").mapInArrow(count_batches(["doc_id", "source"], vocabulary, cluster=True), "doc_id long, source string, tokens long, cluster long")
    )
    sizes = F.array(*[F.struct(F.lit(name).alias("container"), F.lit(int(c)).cast("long").alias("capacity")) for name, c in containers])
    each = counted.select("*", F.inline(sizes))
    whole = F.when(F.col("tokens") > F.col("capacity"), F.floor(F.col("tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("int")
    each = each.withColumn("whole", whole).withColumn("rest", F.col("tokens") - F.col("whole") * F.col("capacity"))
    empty = each.filter("tokens = 0").select("container", F.lit(None).cast("string").alias("bin_id"), "doc_id", F.lit(0).alias("part"), "tokens")
    full = each.filter("whole > 0").select("container", "doc_id", "capacity", F.explode(F.sequence(F.lit(1), "whole")).alias("part"))
    full = full.select("container", F.concat(F.lit("f-"), F.col("doc_id").cast("string"), F.lit("-"), F.col("part").cast("string")).alias("bin_id"), "doc_id", "part", F.col("capacity").alias("tokens"))

    rows = counted.count()
    shape = "container string, capacity long, doc_id long, part int, tokens long, cluster long, source string, chunk int, bin_id string, fill double"
    rest = each.filter("rest > 0").select("container", "capacity", "doc_id", (F.col("whole") + 1).alias("part"), F.col("rest").alias("tokens"), "cluster", "source")

    def packed_once(items: DataFrame, n: int, round_: int) -> DataFrame:
        chunk = F.pmod(F.xxhash64("doc_id", F.lit(round_)), F.lit(max(1, -(-n // items_per_task)))).cast("int")
        dealt = items.withColumn("chunk", chunk)
        return cut(dealt.groupBy("container", "chunk").applyInPandas(lambda pdf: _pack_group(round_, apart)(pdf), shape))

    first = packed_once(rest, rows, 1)
    loose = first.filter(F.col("fill") < LOOSE).drop("chunk", "bin_id", "fill")
    n = loose.groupBy("container").count().agg(F.max("count")).first()[0] or 0
    out = ["container", "bin_id", "doc_id", "part", "tokens"]
    result = first.filter(F.col("fill") >= LOOSE).select(*out)
    if n:
        result = result.unionByName(packed_once(loose, n, 2).select(*out))
    return result.unionByName(full.select(*out)).unionByName(empty.select(*out))


def fill(placed: DataFrame, containers: Sequence[tuple[str, int]]) -> DataFrame:
    """Per container how many bins there are and how full they are."""
    capacity = F.create_map(*[x for name, c in containers for x in (F.lit(name), F.lit(int(c)).cast("long"))])
    per_bin = placed.filter(F.col("bin_id").isNotNull()).groupBy("container", "bin_id").agg(F.sum("tokens").alias("used"), F.count(F.lit(1)).alias("items"))
    per = per_bin.groupBy("container").agg(F.count(F.lit(1)).alias("bins"), F.sum("items").alias("items"), F.sum("used").alias("tokens"), F.max("used").alias("fullest"))
    cap = F.element_at(capacity, F.col("container"))
    return per.select("container", cap.alias("capacity"), "bins", "items", "tokens", "fullest", (F.col("tokens") / (F.col("bins") * cap)).alias("filled"))
