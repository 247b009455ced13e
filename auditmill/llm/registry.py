"""Queries of the training-data operators of this package, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditmill.llm import format_duplicates, mixing, moderation, packing, percentiles, residue
from auditmill.session import cut, table

TIMINGS = ("response_ms", "ttfb_ms")
PCTS = (50, 90, 99)
SLOW_MS = 2000.0
LEAST_VALUES = 50


def _timing(value):
    return percentiles.finite(value) & (value > 0)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return percentiles.above(table(spark, d, "urls").select("host", *TIMINGS), ["host"], TIMINGS, PCTS, SLOW_MS, LEAST_VALUES, usable=_timing)


def p1_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles per host, from stored sketches of days, those of weekends and of other days added up."""
    urls = table(spark, d, "urls").select("host", F.to_date("crawled_at").alias("day"), *TIMINGS)
    days = cut(percentiles.sketch(urls, ["host", "day"], TIMINGS, usable=_timing))
    weekend = F.dayofweek("day").isin(1, 7)
    parts = [days.filter(weekend), days.filter(~F.coalesce(weekend, F.lit(False)))]
    return percentiles.percentiles(percentiles.merge(parts, ["host"]), ["host"], PCTS).select("host", "field_name", "pct", "estimate", "values")


def _exports(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.from_payload(table(spark, d, "page_exports"), "export_id", "payload", ["title", "metaDescription", "h1"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return format_duplicates.copies(_exports(spark, d))


def p3_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """Every record that is kept and how many other copies it had."""
    return format_duplicates.collapsed(_exports(spark, d))


def p3_unreadable(spark: SparkSession, d: str) -> DataFrame:
    """Exports whose payload is no JSON object."""
    return format_duplicates.unreadable(table(spark, d, "page_exports"), "export_id", "payload", ["title", "metaDescription", "h1"])


def _page_texts(spark: SparkSession, d: str) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in ("title", "h1")])
    return table(spark, d, "page_records").select("url_id", F.inline(cells))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residue(_page_texts(spark, d)).select("url_id", "field_name")


def p6_clean(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose title and h1 are free of residue."""
    bad = residue.residue(_page_texts(spark, d)).select("url_id").distinct()
    return table(spark, d, "page_records").select("url_id").join(bad, "url_id", "left_anti")


def _containers(spark: SparkSession, d: str) -> list[tuple[str, int]]:
    return sorted((r.container, r.capacity_tokens) for r in table(spark, d, "pack_sizes").collect())


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), _containers(spark, d))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    """How full the containers are."""
    return packing.fill(p8_packed(spark, d), _containers(spark, d))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    targets = table(spark, d, "mix_targets")
    return mixing.mix(mixing.unique_texts(table(spark, d, "documents"), targets=targets), targets)[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The shares really reached."""
    targets = table(spark, d, "mix_targets")
    texts = cut(mixing.unique_texts(table(spark, d, "documents"), targets=targets))
    chosen, by_source = mixing.mix(texts, targets)
    return mixing.shares(cut(chosen), texts, targets, by_source)


def _moderated(spark: SparkSession, d: str) -> DataFrame:
    return moderation.scored(table(spark, d, "documents"), table(spark, d, "moderation_samples"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return _moderated(spark, d).filter(F.col("score") >= moderation.THRESHOLD).select("doc_id")


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    """The score of every document."""
    return _moderated(spark, d)


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source are unwanted."""
    return moderation.rates(_moderated(spark, d))


def p10_calibration(spark: SparkSession, d: str) -> DataFrame:
    """How well the scores order and match judged sentences that the model hasn't seen."""
    n, auc, error = moderation.held_out(moderation.judged(table(spark, d, "moderation_samples")))
    return spark.createDataFrame([(n, auc, error)], "sentences long, area_under_curve double, calibration_error double")


QUERIES = {f.__name__: f for f in (p1_found, p1_percentiles, p3_found, p3_collapsed, p3_unreadable, p6_found, p6_clean, p8_packed, p8_fill, p9_mix, p9_shares, p10_found, p10_scores, p10_rates, p10_calibration)}

_SAME = """
        WITH r AS (SELECT export_id, list_transform([json_extract_string(payload, '$.title'), json_extract_string(payload, '$.metaDescription'), json_extract_string(payload, '$.h1')],
                          lambda x: regexp_replace(lower(coalesce(x, '')), '[^\\p{L}\\p{N}]', '', 'g')) AS f FROM page_exports)"""

ORACLES = {
    "p1_found": """
        WITH v AS (SELECT host, field_name, value FROM (UNPIVOT (SELECT host, response_ms, ttfb_ms FROM urls) ON response_ms, ttfb_ms INTO NAME field_name VALUE value)
                   WHERE value IS NOT NULL AND isfinite(value) AND value > 0),
        n AS (SELECT host, field_name, count(*) AS n, count(*) FILTER (WHERE value <= 2000) AS upto FROM v GROUP BY ALL HAVING count(*) >= 50)
        SELECT host, field_name, CAST(pct AS INT) AS pct FROM n, (VALUES (50), (90), (99)) p(pct) WHERE upto * 100 < n * pct""",
    "p3_found": _SAME + """
        SELECT kept_id, export_id AS copy_id FROM (SELECT export_id, min(export_id) OVER (PARTITION BY f) AS kept_id FROM r) WHERE export_id <> kept_id""",
    "p3_unreadable": "SELECT export_id AS id FROM page_exports WHERE payload IS NOT NULL AND NOT (json_valid(payload) AND json_type(CASE WHEN json_valid(payload) THEN payload END) = 'OBJECT')",
    "p3_collapsed": _SAME + """
        SELECT min(export_id) AS kept_id, count(*) - 1 AS copies FROM r GROUP BY f""",
}
