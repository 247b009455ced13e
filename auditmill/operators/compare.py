"""Two crawls side by side: one full outer join answers every question."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def compared(old: DataFrame, new: DataFrame, key: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, kind, field, old_value, new_value): added, removed, and changed by field.

    Null and empty are the same value here. Both sides have one row per key.
    """
    a = old.select(*key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"old_{f}") for f in fields], F.lit(True).alias("in_old"))
    b = new.select(*key, *[F.coalesce(F.col(f).cast("string"), F.lit("")).alias(f"new_{f}") for f in fields], F.lit(True).alias("in_new"))
    met = a.join(b, list(key), "full_outer")
    none = F.lit(None).cast("string")
    row = lambda kind, field, x, y: F.struct(F.lit(kind).alias("kind"), field.alias("field"), x.alias("old_value"), y.alias("new_value"))
    cells = [
        F.when(F.col("in_old").isNull(), row("added", none, none, none)),
        F.when(F.col("in_new").isNull(), row("removed", none, none, none)),
        *[F.when(F.col("in_old") & F.col("in_new") & (F.col(f"old_{f}") != F.col(f"new_{f}")), row("changed", F.lit(f), F.col(f"old_{f}"), F.col(f"new_{f}"))) for f in fields],
    ]
    return met.select(*key, F.inline(F.array_compact(F.array(*cells))))


def issue_changes(old: DataFrame, new: DataFrame, old_urls: DataFrame, new_urls: DataFrame) -> DataFrame:
    """(code, url, kind) of issues new or fixed on URLs both crawls know."""
    known = old_urls.select("url").intersect(new_urls.select("url"))
    a, b = old.select("code", "url").distinct().join(known, "url", "left_semi"), new.select("code", "url").distinct().join(known, "url", "left_semi")
    appeared = b.join(a, ["code", "url"], "left_anti").select("code", "url", F.lit("new").alias("kind"))
    fixed = a.join(b, ["code", "url"], "left_anti").select("code", "url", F.lit("fixed").alias("kind"))
    return appeared.unionByName(fixed)


def headline(added: int, removed: int, new_issues: int, fixed_issues: int) -> str:
    """A comparison in a line, without what didn't happen."""
    some = lambda n, one, many: f"{n:,} new {one if n == 1 else many}" if n > 0 else ""
    parts = [some(added, "URL", "URLs"), f"{removed:,} gone" if removed > 0 else "", some(new_issues, "issue", "issues"), f"{fixed_issues:,} fixed" if fixed_issues > 0 else ""]
    return ", ".join(p for p in parts if p) or "No changes"


def summary(changes: DataFrame, issues: DataFrame) -> DataFrame:
    """(added, removed, changed_<field>..., new_issues, fixed_issues) as one row of exact counts."""
    fields = F.when(F.col("kind") == "changed", F.concat(F.lit("changed_"), F.col("field"))).otherwise(F.col("kind"))
    counted = changes.select(fields.alias("what")).unionByName(issues.select(F.concat("kind", F.lit("_issues")).alias("what")))
    return counted.groupBy("what").agg(F.count(F.lit(1)).alias("n"))
