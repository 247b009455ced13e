"""The flagship query: the audit's issues by severity and group, as a report opens with them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditmill.plans.site_audit import ag15_severity_totals


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return ag15_severity_totals(spark, d)
