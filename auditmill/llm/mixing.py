"""Mixing sources to target weights by hierarchical budgeting.

Texts form a tree, in production source, language, domain (host). Each source
gets its weight of the total; inside a source the weights are what its parts
hold. What a node can't use, because each text may be repeated only so often,
goes to its siblings in proportion to their weights; only what no sibling can
take goes to the siblings of the parent. A leaf's budget is filled by whole
epochs over its texts and a prefix, by tokens, of one more epoch in seeded
order. The prefix is found from token sums of ``SLICES`` hash slices, so that
only one slice of a leaf is ever put in order.

Unless a total is asked for, it is the largest that leaves no more than
``short_weight`` of all weight short of its target.

Defined results. Texts that are equal byte by byte are one text, used for one
source only, so that no text is repeated more often than allowed. A text that
several sources with targets hold goes to one of them by its hash, in parts
that fill those that would fall short first; the row is the smallest doc_id of
that source. Null and empty texts hold no tokens and aren't used. Null or
blank lang is 'und'; lang is compared by its first part without case. A source
without target gets nothing; a target without texts is a shortage. If all
sources together can't give the total, each is used to its limit. The last text
of a source is taken if at least half of it lies in the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditmill.llm.tokens import VOCABULARY, count_batches
from auditmill.session import cut

SLICES = 4096
LEVELS = ("source", "lang", "host")


def language(lang: Column) -> Column:
    first = F.lower(F.trim(F.split(lang, "[-_]")[0]))
    return F.when(lang.isNull() | (F.trim(lang) == ""), F.lit("und")).otherwise(first)


def unique_texts(docs: DataFrame, vocabulary: str = VOCABULARY, targets: DataFrame | None = None) -> DataFrame:
    """(doc_id, source, lang, host, tokens, copies), one row per distinct text that has tokens.

    With ``targets``, texts that several sources hold are dealt to those with a target.
    """
    keep = ["doc_id", "source", "lang", "host", "digest"]
    rows = docs.select("doc_id", "source", language(F.col("lang")).alias("lang"), F.coalesce("host", F.lit("")).alias("host"), F.sha2("text", 256).alias("digest"), "text")
    counted = rows.mapInArrow(count_batches(keep, vocabulary), "doc_id long, source string, lang string, host string, digest string, tokens long").filter("tokens > 0")
    row = F.min(F.struct("doc_id", "source", "lang", "host", "tokens")).alias("t")
    if targets is None:
        return counted.groupBy("digest").agg(row, F.count(F.lit(1)).alias("copies")).select("t.*", "copies")
    goals = {r.source: r.target_weight / r.max_repeats for r in targets.collect() if r.target_weight > 0 and r.max_repeats > 0}
    held = counted.groupBy("digest", "source").agg(row, F.count(F.lit(1)).alias("copies"))
    wanted = F.when(F.col("source").isin(*goals), F.col("source"))
    one = cut(held.groupBy("digest").agg(F.sort_array(F.collect_set(wanted)).alias("sources"), F.sort_array(F.collect_list("t")).alias("ts"), F.sum("copies").alias("copies")))
    sums = {tuple(r.sources): float(r.n) for r in one.groupBy("sources").agg(F.sum(F.col("ts")[0]["tokens"]).alias("n")).collect() if r.sources}
    upto = [(list(k), [sum(v[: i + 1]) for i in range(len(v) - 1)]) for k, v in dealt_shares(sums, goals).items()]
    marks = one.sparkSession.createDataFrame(upto, "sources array<string>, upto array<double>")
    turn = F.pmod(F.xxhash64("digest", F.lit("source")), F.lit(1 << 30)) / (1 << 30)
    at = F.size(F.filter(F.coalesce("upto", F.array().cast("array<double>")), lambda x: x <= F.col("turn")))
    met = one.join(F.broadcast(marks), "sources", "left").withColumn("turn", turn).withColumn("taker", F.get("sources", at))
    mine = F.get(F.filter("ts", lambda t: t["source"] == F.col("taker")), F.lit(0))
    return met.select(F.coalesce(mine, F.col("ts")[0]).alias("t"), "copies").select("t.*", "copies")


def dealt_shares(sums: dict[tuple[str, ...], float], goals: dict[str, float], rounds: int = 200) -> dict[tuple[str, ...], list[float]]:
    """Which part of the tokens that a set of sources holds in common each of them gets.

    ``sums`` are the tokens by set, ``goals`` the tokens a source needs for one unit of the total. The sources
    that would fall short first are filled up first, set by set until nothing moves.
    """
    given = {k: [n / len(k)] * len(k) for k, n in sums.items()}
    has = dict.fromkeys(goals, 0.0)
    for k, v in given.items():
        for s, x in zip(k, v, strict=True):
            has[s] += x
    for _ in range(rounds):
        moved = 0.0
        for k, v in given.items():
            if len(k) < 2:
                continue
            rest = [has[s] - x for s, x in zip(k, v, strict=True)]
            level, need, base = 0.0, 0.0, 0.0
            order = sorted(range(len(k)), key=lambda i: rest[i] / goals[k[i]])  # noqa: B023
            for place, i in enumerate(order):
                need, base = need + goals[k[i]], base + rest[i]
                level = (sums[k] + base) / need
                if place + 1 == len(order) or level <= rest[order[place + 1]] / goals[k[order[place + 1]]]:
                    break
            new = [max(0.0, level * goals[s] - r) for s, r in zip(k, rest, strict=True)]
            moved += sum(abs(a - b) for a, b in zip(new, v, strict=True))
            for s, r, x in zip(k, rest, new, strict=True):
                has[s] = r + x
            given[k] = new
        if moved <= 1e-6 * sum(sums.values()):
            break
    return {k: [x / sums[k] for x in v] for k, v in given.items() if len(k) > 1}


def share_out(nodes: DataFrame, budgets: DataFrame, parent: Sequence[str]) -> DataFrame:
    """``nodes`` (parent, own key, weight, capacity) with their ``budget``.

    Every node gets min(capacity, rate * weight) with the rate at which the
    parent's budget is used up. Nodes that fill up at the same rate are added
    up first, so the running sums are over distinct rates only.
    """
    full_at = F.col("capacity") / F.col("weight")
    kept = nodes.filter("weight > 0 AND capacity > 0")
    per_rate = kept.groupBy(*parent, full_at.alias("rate")).agg(F.sum("weight").alias("w"), F.sum("capacity").alias("c"))
    w = Window.partitionBy(*parent)
    before = w.orderBy("rate").rowsBetween(Window.unboundedPreceding, -1)
    steps = per_rate.withColumns({"c0": F.coalesce(F.sum("c").over(before), F.lit(0.0)), "w0": F.sum("w").over(w) - F.coalesce(F.sum("w").over(before), F.lit(0.0))})
    at = steps.join(budgets, list(parent))
    enough = F.col("c0") + F.col("rate") * F.col("w0") >= F.col("budget")
    rate = at.filter(enough).groupBy(*parent).agg(F.min_by((F.col("budget") - F.col("c0")) / F.col("w0"), F.col("rate")).alias("use"))
    out = kept.join(rate, list(parent), "left")
    return out.withColumn("budget", F.when(F.col("use").isNull(), F.col("capacity")).otherwise(F.least("capacity", F.col("use") * F.col("weight")))).drop("use")


def _prefix(rows: DataFrame, keys: list[str]) -> DataFrame:
    """``rows`` (keys, doc_id, tokens, turn, rest) with ``taken``: whether the row lies in the first ``rest`` tokens
    of its group by turn, and ``fits``: how many of a row's tokens still do where it begins inside and ends outside.
    """
    sliced = rows.withColumn("slice", F.shiftrightunsigned("turn", 52).cast("int"))
    sums = sliced.groupBy(*keys, "slice").agg(F.sum("tokens").alias("n"))
    w = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marks = sums.withColumn("upto", F.sum("n").over(w)).withColumn("from", F.col("upto") - F.col("n")).drop("n")
    marked = sliced.join(marks, [*keys, "slice"])
    whole = F.col("upto") <= F.col("rest")
    edge = ~whole & (F.col("from") < F.col("rest"))
    inside = Window.partitionBy(*keys, "slice").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    plain = marked.filter(~edge).withColumn("taken", whole).withColumn("fits", F.lit(0.0))
    start = F.col("from") + F.coalesce(F.sum("tokens").over(inside), F.lit(0))
    near = marked.filter(edge).withColumn("start", start).withColumn("taken", F.col("start") + F.col("tokens") <= F.col("rest"))
    near = near.withColumn("fits", F.when(F.col("taken"), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), (F.col("rest") - F.col("start")).cast("double")))).drop("start")
    return plain.unionByName(near).drop("slice", "from", "upto")


def mix(texts: DataFrame, targets: DataFrame, total_tokens: int | None = None, short_weight: float = 0.1, seed: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, source, lang, host, tokens, copies, uses), and the budgets per source."""
    texts = cut(texts)
    goals = {r.source: (float(r.target_weight), int(r.max_repeats)) for r in targets.collect()}
    spark = texts.sparkSession
    repeats = spark.createDataFrame([(s, w, float(n)) for s, (w, n) in goals.items()], "source string, target double, repeats double")
    leaves = cut(
        texts.groupBy(*LEVELS).agg(F.sum("tokens").cast("double").alias("held")).join(F.broadcast(repeats), "source").withColumn("capacity", F.col("held") * F.col("repeats"))
    )
    if total_tokens is None:
        limits = {r.source: r.c for r in leaves.groupBy("source").agg(F.sum("capacity").alias("c")).collect()}
        total = reachable_total({s: (w, limits.get(s, 0.0)) for s, (w, _) in goals.items()}, short_weight)
    else:
        total = float(total_tokens)
    level = leaves.groupBy("source").agg(F.first("target").alias("weight"), F.sum("capacity").alias("capacity"))
    budgets = share_out_top(level, total)
    by_source = cut(budgets)
    budgets = by_source.select("source", "budget")
    for k in range(2, len(LEVELS) + 1):
        keys = list(LEVELS[:k])
        level = leaves.groupBy(*keys).agg(F.sum("held").alias("weight"), F.sum("capacity").alias("capacity"))
        budgets = share_out(level, budgets, keys[:-1]).select(*keys, "budget")
    plan = leaves.join(budgets, list(LEVELS))
    full = F.least(F.floor(F.col("budget") / F.col("held") + 1e-9), F.col("repeats")).cast("int")
    plan = cut(plan.withColumn("epochs", full).withColumn("rest", F.greatest(F.lit(0.0), F.col("budget") - F.col("epochs") * F.col("held"))).select(*LEVELS, "epochs", F.when(F.col("epochs") >= F.col("repeats"), F.lit(0.0)).otherwise(F.col("rest")).alias("rest")))
    rows = texts.join(plan, list(LEVELS)).withColumn("turn", F.xxhash64("doc_id", "epochs", F.lit(seed)))
    dealt = cut(_prefix(rows, list(LEVELS)))
    edge = dealt.filter(~F.col("taken") & (F.col("fits") > 0)).drop("taken")
    due = edge.groupBy("source").agg(F.sum("fits").alias("rest"))
    again = _prefix(edge.drop("rest", "fits").join(due, "source"), ["source"])
    late = again.withColumn("taken", F.col("taken") | (F.col("fits") * 2 >= F.col("tokens")))
    settled = dealt.filter(F.col("taken") | (F.col("fits") <= 0))
    chosen = settled.drop("fits", "rest").unionByName(late.drop("fits", "rest")).withColumn("uses", F.col("epochs") + F.col("taken").cast("int")).filter("uses > 0")
    return chosen.select("doc_id", *LEVELS, "tokens", "copies", "uses"), by_source


def reachable_total(sources: dict[str, tuple[float, float]], short_weight: float) -> float:
    """The largest total that leaves sources of no more than ``short_weight`` in all short of their targets.

    ``sources`` gives each target's weight and the most tokens the source can give.
    """
    short, total = 0.0, 0.0
    for most, weight in sorted((c / w, w) for w, c in sources.values() if w > 0):
        total = most
        short += weight
        if short > short_weight + 1e-9:
            break
    return total


def share_out_top(level: DataFrame, total: float) -> DataFrame:
    """The root's budget over the sources; there are as many rows as targets."""
    root = F.lit(0).alias("root")
    nodes = level.select(root, "*")
    budgets = level.sparkSession.createDataFrame([(0, total)], "root int, budget double")
    return share_out(nodes, budgets, ["root"]).drop("root")


def shares(chosen: DataFrame, texts: DataFrame, targets: DataFrame, by_source: DataFrame) -> DataFrame:
    """Per source what it holds, what it was to give and what it gave."""
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("uses")).alias("used_tokens"), F.count(F.lit(1)).alias("used_texts"), F.max("uses").alias("most_uses"))
    held = texts.groupBy("source").agg(F.sum("tokens").alias("held_tokens"), F.count(F.lit(1)).alias("held_texts"))
    out = targets.select("source", "target_weight", "max_repeats").join(held, "source", "left").join(by_source.select("source", F.col("budget").alias("budget_tokens")), "source", "left").join(used, "source", "left")
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("held_tokens", "held_texts", "used_tokens", "used_texts", "most_uses", "budget_tokens")}
    out = out.withColumns(zero)
    whole = F.sum("used_tokens").over(Window.partitionBy(F.lit(0)))
    return out.withColumn("share", F.when(whole > 0, F.col("used_tokens") / whole).otherwise(F.lit(0.0)))
