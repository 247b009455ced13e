"""Broken and redirecting addresses that changed for the same reason, each reason once.

Rules claim addresses in order: a template error, redirects to one address,
redirects rewritten alike, product numbers, products removed from collections.
What a rule has claimed no later rule sees. A rule is one map-side combined
count per reason and one join back; nothing is compared in pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.functions import text, urls as U
from auditmill.session import cut

LEAST = 3


def reasons(addresses: DataFrame, least: int = LEAST) -> DataFrame:
    """(id, kind, reason) of ``addresses`` (id, path, status, redirect); addresses with a reason of their own have no row.

    ``redirect`` is a path on the same site or null. A template error needs one
    address, every other reason ``least``. Null paths have no reason.
    """
    a = addresses.select("id", "path", "status", "redirect").filter(F.col("path").isNotNull())
    broken = F.coalesce(F.col("status") >= 400, F.col("redirect").isNull())
    one = lambda test, name: F.when(test, F.lit(name))
    rules = (
        ("liquid", text.liquid_place(F.col("path")), 1),
        ("destination", F.lower("redirect"), least),
        ("rewrite", text.rewrite_kind(F.col("path"), F.col("redirect")), least),
        ("product_numbers", one(broken & F.col("path").rlike(rf"^{U.MARKET}/products/[0-9]+/?$"), "product_numbers"), least),
        ("removed_from_collections", one(broken & F.col("path").rlike(rf"(?i)^{U.MARKET}/collections/[^/?#]+/products/[^/?#]+"), "removed_from_collections"), least),
    )
    left = cut(a.select("id", *[r.alias(k) for k, r, _ in rules]))
    claimed = None
    for kind, _, few in rules:
        counted = left.filter(F.col(kind).isNotNull()).groupBy(F.col(kind).alias("reason")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= few)
        taken = cut(left.join(counted, left[kind] == F.col("reason")).select("id", F.lit(kind).alias("kind"), "reason"))
        claimed = taken if claimed is None else claimed.unionByName(taken)
        left = left.join(taken.select("id"), "id", "left_anti")
    return claimed


def addresses(urls: DataFrame) -> DataFrame:
    """(id, path, status, redirect) of the broken and redirecting internal URLs in ``urls``."""
    same = U.host(F.col("redirect_url")) == U.host(F.col("url"))
    bad = urls.filter(F.col("is_internal") & (F.col("state") == 1) & ((F.col("status_code") >= 300) | F.col("status_code").isNull()))
    return bad.select("id", U.path_and_query(F.col("url")).alias("path"), F.col("status_code").alias("status"), F.when(same, U.path_and_query(F.col("redirect_url"))).alias("redirect"))
