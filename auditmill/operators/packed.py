"""Several values packed in one field, split by the dialect that describes it shortest.

A dialect is a set of separators, with or without quoting. Every distinct field
is parsed in all dialects its characters allow; those without quoting are tried
where a quote stays unclosed. A field counts once however many rows hold it, so
a frequent pair of values isn't taken for one value. Over the whole corpus each
value gets a code length: the bits of its share plus its spelling, spread over
its uses. A field takes the dialect with the fewest bits; the lengths are then
counted again from these choices and the choice is made a second time. Values
frequent enough to be hot join keys are looked up in a broadcast table of at
most ``HEAD`` rows, the rest by a shuffle.

Defined results. Null, empty and blank fields hold no values. Quotes count only
around a whole value; inside them nothing separates, a doubled or backslashed
quote is one quote, an unclosed quote is text. Addresses and dates with a comma
are never split. Brackets around the whole field belong to no value. Empty
pieces have no position. Repeated values and rows count each time. Among equal
costs the dialect with more values wins, then the first by name.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Mapping
from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.operators.skew import balanced_join
from auditmill.session import cut

SEPARATORS = ",;|/\t\n"
BRACKETS = {"[": "]", "(": ")", "{": "}"}
HEAD = 2048
STRAY_QUOTE_BITS = 24

ADDRESS = r"[A-Za-z][A-Za-z0-9+.-]*://[^\s,;|\"']+"
DATE = r"(?:[A-Z][a-z]{2,8}, )?\d{1,2}[ -][A-Z][a-z]{2,8}[ -]\d{2,4}(?:,? \d{1,2}:\d\d(?::\d\d)?)?"
ATOM = re.compile(f"{ADDRESS}|(?<=[:\\s]){DATE}")
QUOTED = {q: re.compile(rf"{q}((?:[^{q}\\]|\\.|{q}{q})*){q}(?!{q})", re.S) for q in "\"'"}


@dataclass(frozen=True)
class FieldRule:
    """``blank_separates``: blanks do if nothing else in the field does and no value has an argument."""

    blank_separates: bool = False


def unwrap(text: str) -> str:
    """``text`` without blanks around it and without brackets around the whole."""
    text = text.strip()
    while len(text) > 1 and BRACKETS.get(text[0]) == text[-1]:
        depth = 0
        for i, ch in enumerate(text):
            depth += (ch == text[0]) - (ch == text[-1])
            if depth == 0:
                break
        if i < len(text) - 1:
            break
        text = text[1:-1].strip()
    return text


@lru_cache(maxsize=4096)
def _plain(separators: str) -> re.Pattern:
    return re.compile(f"[{re.escape(separators)}]") if separators else re.compile(r"(?!)")


def parse(text: str, separators: str, quotes: bool) -> list[str]:
    """The values of an unwrapped field in one dialect."""
    out: list[str] = []
    stop, at, n = _plain(separators), 0, len(text)
    atoms = [m.span() for m in ATOM.finditer(text)]
    while at <= n:
        while at < n and text[at].isspace() and text[at] not in separators:
            at += 1
        if quotes and at < n and text[at] in QUOTED and (m := QUOTED[text[at]].match(text, at)):
            end = m.end()
            while end < n and text[end].isspace() and text[end] not in separators:
                end += 1
            if end == n or text[end] in separators:
                q = text[at]
                value = m[1].replace(q + q, q).replace("\\" + q, q).strip()
                if value:
                    out.append(value)
                at = end + 1
                continue
        look = at
        while (m := stop.search(text, look)) and (inside := next((e for s, e in atoms if s <= m.start() < e), None)):
            look = inside
        end = m.start() if m else n
        if value := text[at:end].strip():
            out.append(value)
        at = end + 1
    return out


def candidates(text: str, rule: FieldRule) -> dict[str, list[str]]:
    """Values by dialect; of dialects that parse alike only the first by name."""
    text = unwrap(text)
    bare = ATOM.sub("", text)
    present = [s for s in SEPARATORS if s in bare]
    most = parse(text, "".join(present), True)
    stray = any(v[0] in QUOTED or v[-1] in QUOTED for v in most)
    if rule.blank_separates and " " in text:
        if most == [text] and ":" not in text:
            return {"space": parse(text, " ", True)}
    seen: dict[tuple[str, ...], str] = {}
    for k in range(len(present), -1, -1):
        for chosen in combinations(present, k):
            for quotes in (True, False) if stray else (True,):
                name = "".join(chosen) + ("" if quotes else " raw")
                seen.setdefault(tuple(parse(text, "".join(chosen), quotes)), name)
    return {name: list(v) for v, name in seen.items()}


def _dialects(rules: Mapping[str, FieldRule]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for field, raw in zip(pdf["field_name"], pdf["raw"], strict=True):
                found = candidates(raw, rules[field])
                for name, values in found.items():
                    extra = 2.0 * len(name) + sum(STRAY_QUOTE_BITS * ((v[0] in QUOTED) + (v[-1] in QUOTED)) for v in values)
                    rows.append((field, raw, name, values, extra, 1.0 / len(found)))
            yield pd.DataFrame(rows, columns=["field_name", "raw", "dialect", "pieces", "extra", "share"])

    return run


def _choose(cands: DataFrame, weight: str) -> DataFrame:
    """The cheapest candidate of each field under code lengths counted with ``weight``."""
    piece = F.explode("pieces").alias("piece")
    counts = cut(cands.select("field_name", piece, F.col(weight).alias("w")).filter("w > 0").groupBy("field_name", "piece").agg(F.sum("w").alias("c")))
    totals = F.broadcast(counts.groupBy("field_name").agg(F.sum("c").alias("total")))
    spelled = (8.0 * F.length("piece") + 8.0) / F.greatest(F.col("c"), F.lit(1.0))
    coded = counts.join(totals, "field_name").select("field_name", "piece", (F.log2(F.col("total") / F.col("c")) + spelled).alias("bits"), "c")
    head = F.broadcast(coded.orderBy(F.desc("c"), "field_name", "piece").limit(HEAD).drop("c"))
    used = cands.select("cid", "field_name", piece)
    unseen = 24.0 + 8.0 * F.length("piece")
    hot = used.join(head, ["field_name", "piece"])
    cold = used.join(head, ["field_name", "piece"], "left_anti").join(coded.drop("c"), ["field_name", "piece"], "left").withColumn("bits", F.coalesce("bits", unseen))
    bits = hot.select("cid", "bits").unionByName(cold.select("cid", "bits")).groupBy("cid").agg(F.sum("bits").alias("bits"))
    cost = F.struct((F.coalesce("bits", F.lit(0.0)) + F.col("extra")).alias("b"), (-F.size("pieces")).alias("k"), F.col("dialect").alias("d"))
    return cands.join(bits, "cid", "left").groupBy("field_name", "raw").agg(F.min_by("cid", cost).alias("cid"))


def learn_dialects(fields: DataFrame, rules: Mapping[str, FieldRule]) -> DataFrame:
    """(field_name, raw, dialect, pieces) for every distinct ``raw`` of ``fields``."""
    distinct = fields.filter(F.col("raw").isNotNull()).select("field_name", "raw").distinct()
    schema = "field_name string, raw string, dialect string, pieces array<string>, extra double, share double"
    cands = cut(distinct.mapInPandas(_dialects(dict(rules)), schema).withColumn("cid", F.monotonically_increasing_id()))
    first = cut(_choose(cands, "share").select("cid", F.lit(1.0).alias("won")))
    again = cut(cands.join(first, "cid", "left").withColumn("won", F.coalesce("won", F.lit(0.0))))
    best = _choose(again, "won").select("cid")
    return again.join(best, "cid", "left_semi").select("field_name", "raw", "dialect", "pieces")


def split_values(fields: DataFrame, rules: Mapping[str, FieldRule], least: int = 1) -> DataFrame:
    """One row per value of ``fields`` (field_name, url_id, raw): field_name, url_id, pos from 1, value.

    Only fields that hold at least ``least`` values give rows.
    """
    best = cut(learn_dialects(fields, rules).filter(F.size("pieces") >= least))
    rows = balanced_join(fields.select("field_name", "url_id", "raw").filter(F.col("raw").isNotNull()), best, ["field_name", "raw"])
    return rows.select("field_name", "url_id", F.posexplode("pieces").alias("pos0", "value")).select("field_name", "url_id", (F.col("pos0") + 1).alias("pos"), "value")
