"""The table a user looks at: named filters, search, sorting, paging, counts and histograms.

A request is a lazy plan from filter to projection; the optimizer prunes
columns and turns a limited sort into a top-k. One pass answers all counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEPTHS = 10
# Half-open bins of response time in milliseconds.
RESPONSE_BINS = (("<100", 0, 100), ("100-300", 100, 300), ("300-1000", 300, 1000), ("1000-3000", 1000, 3000), (">=3000", 3000, None))


def filters() -> dict[str, Column]:
    """Named filters that need no other table."""
    c, internal, crawled = F.col, F.col("is_internal"), F.col("state") == 1
    return {
        "all": F.lit(True),
        "internal_all": internal & crawled,
        "internal_html": internal & crawled & (c("resource_type") == 0),
        "external": ~internal & crawled,
        "images": crawled & (c("resource_type") == 1),
        "css_and_javascript": crawled & c("resource_type").isin(2, 3),
        "not_crawled": ~crawled,
        "no_response": crawled & c("status_code").isNull(),
        **{f"status_{n}xx": crawled & c("status_code").between(n * 100, n * 100 + 99) for n in (2, 3, 4, 5)},
    }


def with_ids(urls: DataFrame, ids: DataFrame, key: str = "url_id") -> DataFrame:
    """URLs whose id is in another table (issue, ignored, redirect chain, sitemap, extraction, search, near duplicate)."""
    return urls.join(ids.select(F.col(key).alias("id")), "id", "left_semi")


def search(term: str, columns: Sequence[str] = ("url", "title", "h1")) -> Column:
    """Free text in any of the columns, without case; % and _ are ordinary characters."""
    plain = term.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    found = F.lit(False)
    for c in columns:
        found = found | F.coalesce(F.col(c).ilike(f"%{plain}%"), F.lit(False))
    return found


@dataclass(frozen=True)
class Request:
    """What a table shows."""

    filter: str = "all"
    term: str = ""
    sort: str = "id"
    ascending: bool = True
    limit: int | None = None

    def run(self, urls: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
        df = urls.filter(filters()[self.filter])
        if self.term:
            df = df.filter(search(self.term, [c for c in ("url", "title", "h1") if c in urls.columns]))
        key = F.col(self.sort).asc_nulls_first() if self.ascending else F.col(self.sort).desc_nulls_last()
        df = df.orderBy(key, F.col("id").asc())
        if self.limit is not None:
            df = df.limit(self.limit)
        return df.select(*columns) if columns else df


def lookup(urls: DataFrame, ids: Sequence[int]) -> DataFrame:
    """Rows by id in the order asked for; ids that don't exist are left out."""
    asked = urls.sparkSession.createDataFrame([(i, k) for k, i in enumerate(ids)], "id long, pos int")
    return urls.join(F.broadcast(asked), "id")


def next_queued(urls: DataFrame, after: int, limit: int) -> DataFrame:
    """A page of queued URLs after an id."""
    return urls.filter((F.col("state") == 0) & (F.col("id") > after)).orderBy("id").limit(limit).select("id", "url", "depth")


def filter_counts(urls: DataFrame) -> DataFrame:
    """(filter, urls) of all named filters in one pass."""
    named = filters()
    one = urls.agg(*[F.count_if(c).alias(k) for k, c in named.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("filter"), F.col(k).alias("urls")) for k in named])))


def overview(urls: DataFrame) -> DataFrame:
    """Ten counts and the mean response time in one pass."""
    internal, crawled, html = F.col("is_internal"), F.col("state") == 1, F.col("resource_type") == 0
    page = internal & crawled & html
    return urls.agg(
        F.count(F.lit(1)).alias("urls"),
        F.count_if(crawled).alias("crawled"),
        F.count_if(F.col("state") == 0).alias("queued"),
        F.count_if(F.col("state") == 2).alias("skipped"),
        F.count_if(internal).alias("internal"),
        F.count_if(~internal).alias("external"),
        F.count_if(page).alias("pages"),
        F.count_if(page & (F.col("indexability") == 1)).alias("indexable"),
        F.count_if(page & (F.col("indexability") == 2)).alias("non_indexable"),
        F.count_if(F.col("blocked_by_robots")).alias("blocked"),
        F.avg(F.when(page & ~F.isnan("response_ms"), F.col("response_ms"))).alias("mean_response_ms"),
    )


def status_buckets(urls: DataFrame) -> DataFrame:
    """(bucket, urls) of crawled URLs."""
    s = F.col("status_code")
    kinds = {"2xx": s.between(200, 299), "3xx": s.between(300, 399), "4xx": s.between(400, 499), "5xx": s.between(500, 599), "Blocked": F.col("blocked_by_robots"), "No response": s.isNull() & ~F.coalesce("blocked_by_robots", F.lit(False))}
    one = urls.filter("state = 1").agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("bucket"), F.col(k).alias("urls")) for k in kinds])))


def depth_histogram(urls: DataFrame) -> DataFrame:
    d = F.least("depth", F.lit(DEPTHS))
    pages = urls.filter(F.col("is_internal") & (F.col("state") == 1) & (F.col("resource_type") == 0) & F.col("depth").isNotNull())
    return pages.groupBy(d.alias("depth")).agg(F.count(F.lit(1)).alias("pages")).withColumn("label", F.when(F.col("depth") == DEPTHS, f"{DEPTHS}+").otherwise(F.col("depth").cast("string")))


def response_histogram(urls: DataFrame) -> DataFrame:
    ms = F.col("response_ms")
    inside = lambda lo, hi: (ms >= lo) & ~F.isnan(ms) & (ms < hi if hi is not None else F.lit(True))
    one = urls.filter("state = 1").agg(*[F.count_if(inside(lo, hi)).alias(k) for k, lo, hi in RESPONSE_BINS])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("bin"), F.col(k).alias("urls")) for k, _, _ in RESPONSE_BINS])))


def described() -> Column:
    """What the status column says of a URL."""
    return (
        F.when(F.col("state") == 2, F.coalesce("error", F.lit("Skipped")))
        .when(F.col("state") == 0, "Queued")
        .when(F.col("blocked_by_robots"), "Blocked by robots.txt")
        .when(F.col("error").isNotNull(), F.col("error"))
        .otherwise(F.col("status_text"))
    )


def displayed(kind: str, column: str) -> Column:
    """A value as the table shows it: nothing unless crawled, decimals rounded, booleans in words."""
    c = F.col(column)
    shown = {"integer": c.cast("string"), "decimal": F.format_string("%.0f", c.cast("double")), "ratio": F.format_string("%.3f", c.cast("double")), "boolean": F.when(c, "Yes").otherwise("No"), "text": c.cast("string")}[kind]
    return F.when((F.col("state") == 1) & c.isNotNull(), shown).otherwise("")


def wide(values: DataFrame, names: Sequence[str]) -> DataFrame:
    """(url_id, name, value) rows as one column per name; of several values the smallest."""
    return values.filter(F.col("name").isin(*names)).groupBy("url_id").pivot("name", list(names)).agg(F.min("value"))


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each group."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).filter(F.col("rank") <= n)


def latest(df: DataFrame, keys: Sequence[str], at: Column, tie: Column) -> DataFrame:
    """The last row per key, as upserts leave it. A maximum, so combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(at, tie)).alias("row")
    return df.groupBy(*keys).agg(best).select(*keys, "row.*")


def merged_products(products: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Several products as one: counts added, prices spanned, availabilities collected."""
    return products.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"),
        F.sum("variants").alias("variants"),
        F.sum("with_price").alias("with_price"),
        F.max("images").alias("images"),
        F.min("low_price").alias("low_price"),
        F.max("high_price").alias("high_price"),
        F.array_join(F.array_sort(F.collect_set("availability")), ", ").alias("availabilities"),
    )


def commonest_word(texts: DataFrame, stop: Sequence[str] = ()) -> DataFrame:
    """The most frequent word of at least four letters; of equally frequent ones the first by alphabet."""
    words = texts.select(F.explode(F.split(F.lower("text"), r"[^\p{L}]+")).alias("word")).filter((F.length("word") >= 4) & ~F.col("word").isin(*stop))
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("uses")).orderBy(F.desc("uses"), "word").limit(1)


def deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """(code, before, after, change) of issue counts of two crawls, where they differ."""
    count = lambda df, name: df.groupBy("code").agg(F.count(F.lit(1)).alias(name))
    met = count(before, "before").join(count(after, "after"), "code", "full_outer")
    both = met.select("code", F.coalesce("before", F.lit(0)).alias("before"), F.coalesce("after", F.lit(0)).alias("after"))
    return both.withColumn("change", F.col("after") - F.col("before")).filter("change <> 0")
