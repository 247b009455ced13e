"""Where an issue is shown: listed, set aside, or ignored. Each (code, url_id) is in exactly one place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditmill.audit.catalogue import CATALOGUE
from auditmill.functions import urls as U

SHOWN = [r.code for r in CATALOGUE.values() if r.shown_when_non_indexable]
SHOWN_LATER = [r.code for r in CATALOGUE.values() if r.shown_on_later_pages]


def set_aside() -> Column:
    """Whether an issue says nothing about a page that can't be indexed, or is a later page of a list."""
    own = F.col("is_internal") & (F.col("state") == 1) & (F.col("resource_type") == 0)
    return F.coalesce(own & F.when(F.col("indexability") == 2, ~F.col("code").isin(*SHOWN)).otherwise(U.later_page(F.col("url")) & ~F.col("code").isin(*SHOWN_LATER)), F.lit(False))


def ignored(issues: DataFrame, rules: DataFrame) -> DataFrame:
    """Issues (code, url_id, url) that a rule (code, url) names; an empty url means everywhere.

    Two equality joins instead of one join with OR, which would compare all
    issues with all rules.
    """
    everywhere = rules.filter("url = ''").select("code").distinct()
    here = rules.filter("url <> ''").select("code", "url").distinct()
    a = issues.join(everywhere, "code", "left_semi")
    b = issues.join(here, ["code", "url"], "left_semi")
    return a.unionByName(b).select("code", "url_id").distinct()


def placed(issues: DataFrame, urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(code, url_id, place) of issues; ignoring wins, then setting aside. Placing again changes nothing."""
    u = urls.select(F.col("id").alias("url_id"), "url", "is_internal", "state", "resource_type", "indexability")
    met = issues.select("code", "url_id").distinct().join(u, "url_id")
    gone = ignored(met, rules).withColumn("is_ignored", F.lit(True))
    place = F.when(F.col("is_ignored"), "ignored").when(set_aside(), "set_aside").otherwise("listed")
    return met.join(gone, ["code", "url_id"], "left").select("code", "url_id", place.alias("place"))


def restored(found: DataFrame, saved: DataFrame, crawled: DataFrame, code: str) -> DataFrame:
    """After a check of one issue: what was found of it, and all other saved issues of URLs still crawled."""
    others = saved.filter(F.col("code") != code).join(crawled.select(F.col("id").alias("url_id")), "url_id", "left_semi")
    return found.filter(F.col("code") == code).select("code", "url_id").unionByName(others.select("code", "url_id")).distinct()


def reconciled(wanted: DataFrame, existing: DataFrame, ignored_codes: DataFrame, complete: bool) -> DataFrame:
    """(code, action) that brings a tracker's tasks (code, is_open) in line with the issues wanted (code)."""
    w = wanted.select("code").distinct().withColumn("want", F.lit(True))
    i = ignored_codes.select("code").distinct().withColumn("skip", F.lit(True))
    met = w.join(existing.select("code", "is_open"), "code", "full_outer").join(i, "code", "left")
    action = (
        F.when(F.col("want") & F.col("is_open").isNull(), "create")
        .when(F.col("want") & F.col("is_open"), "update")
        .when(F.col("want"), "reopen")
        .when(F.col("is_open") & (F.col("skip").isNotNull() | F.lit(complete)), "close")
        .otherwise("leave")
    )
    return met.select("code", action.alias("action"))
