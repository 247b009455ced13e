"""Changes to a crawl's tables as new tables: results merged, children replaced, URLs queued again, lists kept whole.

All are joins on keys; nothing is updated in place, so a failed job leaves the
old tables as they were.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What a URL keeps from when it was discovered.
DISCOVERED = ("id", "url", "host", "depth", "found_via")


def upserted(urls: DataFrame, results: DataFrame, kept: Sequence[str] = DISCOVERED) -> DataFrame:
    """``urls`` with the columns of ``results`` (one row per id) where there is a result, except for ``kept``.

    Results of ids that ``urls`` doesn't hold are new rows.
    """
    fields = [c for c in urls.columns if c != "id"]
    new = results.select("id", F.lit(True).alias("__new"), *[F.col(c).alias(f"__{c}") for c in fields if c in results.columns])
    met = urls.withColumn("__old", F.lit(True)).join(new, "id", "full_outer")

    def chosen(c: str):
        if c not in results.columns:
            return F.col(c)
        if c in kept:
            return F.when(F.col("__old"), F.col(c)).otherwise(F.col(f"__{c}")).alias(c)
        return F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c)

    return met.select(*[F.col("id") if c == "id" else chosen(c) for c in urls.columns])


def replaced_children(children: DataFrame, fresh: DataFrame, parents: DataFrame, key: str = "url_id") -> DataFrame:
    """``children`` with all rows of the given parents replaced by those in ``fresh``; a parent without fresh rows has none."""
    ids = parents.select(key).distinct()
    return children.join(ids, key, "left_anti").select(*children.columns).unionByName(fresh.join(ids, key, "left_semi").select(*children.columns))


def discovered(urls: DataFrame, found: DataFrame) -> DataFrame:
    """The URLs in ``found`` (url, depth) that ``urls`` doesn't hold, each once with its least depth."""
    return found.filter(F.col("url").isNotNull()).groupBy("url").agg(F.min("depth").alias("depth")).join(urls.select("url"), "url", "left_anti")


def requeued(urls: DataFrame, again: DataFrame) -> DataFrame:
    """``urls`` with those in ``again`` (url, depth) queued, at the lesser of both depths."""
    least = again.groupBy("url").agg(F.min("depth").alias("__depth"), F.lit(True).alias("__again"))
    met = urls.join(least, "url", "left")
    now = {"state": F.when(F.col("__again"), F.lit(0)).otherwise(F.col("state")).cast("int"), "depth": F.least("depth", "__depth")}
    return met.withColumns(now).select(*urls.columns)


def corrected_refusals(urls: DataFrame, throttled) -> DataFrame:
    """Internal URLs that only a check for robots answered become skipped, with nothing said of their response."""
    hit = F.coalesce(F.col("is_internal") & (F.col("state") == 1) & throttled, F.lit(False))
    gone = [c for c in ("status_code", "status_text", "content_type", "size_bytes", "response_ms", "ttfb_ms", "redirect_url", "indexability", "indexability_reason") if c in urls.columns]
    out = urls.withColumn("__hit", hit)
    new = {c: F.when(~F.col("__hit"), F.col(c)) for c in gone} | {"state": F.when(F.col("__hit"), F.lit(2)).otherwise(F.col("state")).cast("int")}
    return out.withColumns(new).drop("__hit")


def recheck(before: DataFrame, after: DataFrame, checked: DataFrame) -> DataFrame:
    """(code, resolved, remaining, unanswered) of one check: issues (code, url_id) before and after, pages (url_id, answered)."""
    old = before.select("code", "url_id").distinct().join(checked.select("url_id", "answered").distinct(), "url_id")
    met = old.join(after.select("code", "url_id", F.lit(True).alias("still")).distinct(), ["code", "url_id"], "left")
    return met.groupBy("code").agg(
        F.count_if(F.col("answered") & F.col("still").isNull()).alias("resolved"), F.count_if(F.col("answered") & F.col("still")).alias("remaining"), F.count_if(~F.col("answered")).alias("unanswered")
    )
