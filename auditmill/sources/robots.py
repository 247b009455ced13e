"""robots.txt files as rule tables, and verdicts by joining URLs with them."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.functions.urls import normalize_escapes

# How much of a file is read by default; what lies beyond is reported as cut.
MOST_BYTES = 500 * 1024
# How the three keys are misspelt.
KEYS = {
    "user-agent": "agent", "useragent": "agent", "user agent": "agent", "allow": "allow", "disallow": "disallow", "dissallow": "disallow", "dissalow": "disallow", "disalow": "disallow",
    "diasllow": "disallow", "disallaw": "disallow", "sitemap": "sitemap", "site-map": "sitemap",
}
RULES = "origin string, group_no int, agent string, allow boolean, pattern string, line int"


def parse(text: str | None, most: int | None = MOST_BYTES) -> tuple[list[tuple[list[str], list[tuple[bool, str, int]]]], list[str]]:
    """(groups of agents and rules, sitemaps) of the first ``most`` bytes, None for all."""
    body = (text or "").encode()[:most].decode("utf-8", "ignore").removeprefix("\ufeff")
    groups: list[tuple[list[str], list[tuple[bool, str, int]]]] = []
    sitemaps: list[str] = []
    naming = False
    for n, raw in enumerate(re.split(r"\r\n|\n|\r", body), 1):
        line = raw.split("#", 1)[0].strip()
        m = re.match(r"([A-Za-z][A-Za-z -]*?)\s*:\s*(.*)$", line) or re.match(r"(user-agent|allow|disallow|sitemap)\s+(.*)$", line, re.I)
        kind = KEYS.get(m[1].strip().lower()) if m else None
        if kind is None:
            continue
        value = m[2].strip()
        if kind == "agent":
            if not naming:
                groups.append(([], []))
            token = re.match(r"[A-Za-z_-]+", value)
            groups[-1][0].append("*" if value.startswith("*") else token[0].lower() if token else value.lower())
            naming = True
        elif kind == "sitemap":
            if value:
                sitemaps.append(value)
        else:
            naming = False
            if groups and value:
                groups[-1][1].append((kind == "allow", normalize_escapes(value) if value[0] in "/*" else "/" + normalize_escapes(value), n))
    return groups, sitemaps


def _rules(most: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for origin, body in zip(pdf["origin"], pdf["body"], strict=True):
                for k, (agents, rules) in enumerate(parse(body, most)[0]):
                    out += [(origin, k, a, allow, pattern, line) for a in dict.fromkeys(agents) for allow, pattern, line in rules or [(True, "", 0)]]
            yield pd.DataFrame(out, columns=["origin", "group_no", "agent", "allow", "pattern", "line"])

    return run


def rules(files: DataFrame, most: int | None = MOST_BYTES) -> DataFrame:
    """Rule rows of ``files`` (origin, body); a group without rules has one that matches nothing."""
    return files.select("origin", "body").mapInPandas(_rules(most), RULES)


def shortened(files: DataFrame, most: int = MOST_BYTES) -> DataFrame:
    """(origin, bytes_left_out) of the files that are longer than what ``rules`` reads."""
    size = F.octet_length("body")
    return files.filter(size > most).select("origin", (size - most).cast("long").alias("bytes_left_out"))


def verdicts(urls: DataFrame, table: DataFrame, agent: str) -> DataFrame:
    """(url, allowed, pattern, line): the longest matching rule decides, Allow among equally long ones.

    ``urls`` has url, origin and target (path and query). The agent's own
    groups hold if there are any, else those for all.
    """
    own = table.filter(F.col("agent") == agent.lower()).select("origin").distinct().withColumn("own", F.lit(True))
    chosen = table.join(own, "origin", "left").filter(F.col("agent") == F.when(F.col("own"), agent.lower()).otherwise("*"))
    plain = F.regexp_replace(F.regexp_replace("pattern", r"\$$", ""), r"([\\.\[\]{}()+?^|$])", r"\\$1")
    regex = F.concat(F.lit("^"), F.replace(plain, F.lit("*"), F.lit(".*")), F.when(F.col("pattern").endswith("$"), F.lit("$")).otherwise(F.lit("")))
    r = chosen.filter("pattern <> ''").select("origin", "allow", "pattern", "line", regex.alias("regex"))
    met = urls.filter("target <> '/robots.txt'").join(r, "origin").filter(F.expr("target RLIKE regex"))
    best = met.groupBy("url").agg(F.max_by(F.struct("allow", "pattern", "line"), F.struct(F.octet_length("pattern"), "allow", -F.col("line"))).alias("r"))
    return urls.select("url").distinct().join(best, "url", "left").select("url", F.coalesce("r.allow", F.lit(True)).alias("allowed"), "r.pattern", "r.line")


def outcome(status):
    """What fetching robots.txt means: 'parse', 'allow_all' or 'disallow_all'."""
    return F.when(status.between(200, 299), "parse").when(status.between(400, 499) & (status != 429), "allow_all").otherwise("disallow_all")
