"""Near duplicates: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Texts that are the same by words are one class, whatever their length; only
class representatives are compared, so copies never make pairs among
themselves. Candidates come from prefix filtering, which loses none: in any
fixed order of shingles, two sets of similarity 0.8 share one of the first
``n - ceil(0.8 n) + 1``. Rare shingles come first, by ``COUNTERS`` hashed counts;
these decide only how many candidates there are. Every candidate is verified on
the whole sets. A shingle that many prefixes share is dealt to several tasks;
none is left out.

Shingles are 64-bit hashes and classes 128-bit ones. A text of one to four words
is one shingle. Null, empty and wordless texts are one class without shingles.

``simhash_classes`` and ``simhash_pairs`` are the reference's variant, which
leaves out texts under 50 words and loses pairs: SimHash over three words,
pairs that share one of four 16-bit bands and differ in at most six bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from auditmill.functions.text import bands, content_hash_udf, hamming, page_words, simhash64_udf, word_count
from auditmill.operators.skew import balanced_join
from auditmill.session import cut

SHINGLE_WORDS = 5
COUNTERS = 1 << 20
KNOWN_WORDS = 1 << 20
MIX = np.uint64(0x9E3779B97F4A7C15)
MOST_BITS = 6
LEAST_WORDS = 50


@F.pandas_udf(BinaryType())
def words_digest_udf(text: pd.Series) -> pd.Series:
    return pd.Series([hashlib.blake2b(" ".join(page_words(t)).encode(), digest_size=16).digest() for t in text], dtype=object)


def shingles(text: str | None, known: dict[str, int]) -> np.ndarray:
    """Distinct hashes of the text's five-word runs, ascending; ``known`` keeps the hashes of words."""
    words = page_words(text)
    if len(known) > KNOWN_WORDS:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
    at = np.fromiter((known[w] for w in words), np.uint64, len(words))
    size = min(SHINGLE_WORDS, len(words))
    runs = len(words) - size + 1 if size else 0
    h = np.full(runs, size, np.uint64)
    for k in range(size):
        h = (h + at[k : k + runs]) * MIX
        h ^= h >> np.uint64(32)
    return np.unique(h.view(np.int64))


def _counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    known: dict[str, int] = {}
    n = np.zeros(COUNTERS, np.int64)
    for pdf in batches:
        for t in pdf["text"]:
            n[shingles(t, known) & (COUNTERS - 1)] += 1
    used = np.flatnonzero(n)
    yield pd.DataFrame({"counter": used, "n": n[used]})


def _ordered(counts: np.ndarray):
    """Sets of shingles, rare ones first."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, int] = {}
        for pdf in batches:
            sets = [shingles(t, known) for t in pdf["text"]]
            yield pd.DataFrame({"id": pdf["id"], "shingles": [s[np.lexsort((s, counts[s & (COUNTERS - 1)]))] for s in sets]})

    return run


def classes(docs: DataFrame) -> DataFrame:
    """(id, class_id) of every document: class_id is the smallest id with the same words."""
    rows = cut(docs.select("id", words_digest_udf("text").alias("digest")))
    first = rows.groupBy("digest").agg(F.min("id").alias("class_id"))
    return balanced_join(rows, first, ["digest"]).select("id", "class_id")


def pairs(docs: DataFrame, members: DataFrame) -> DataFrame:
    """(a, b, similarity) of class representatives, a < b, whose similarity is at least 0.8."""
    reps = docs.select("id", "text").join(members.filter("id = class_id").select("id"), "id", "left_semi")
    counts = np.zeros(COUNTERS, np.int64)
    held = reps.select("text").mapInPandas(_counted, "counter int, n long").groupBy("counter").agg(F.sum("n").alias("n")).toArrow()
    counts[held["counter"].to_numpy()] = held["n"].to_numpy()
    sets = cut(reps.mapInPandas(_ordered(np.minimum(counts, 2**31 - 1).astype(np.int32)), "id long, shingles array<long>"))
    n = F.size("shingles")
    first = F.slice("shingles", 1, n - F.floor((4 * n + 4) / 5).cast("int") + 1)
    prefixes = cut(sets.filter(n > 0).select("id", n.alias("n"), F.posexplode(first).alias("at", "shingle")))
    shared = cut(balanced_join(prefixes, prefixes.groupBy("shingle").agg(F.count(F.lit(1)).alias("k")).filter("k > 1"), ["shingle"]).drop("k"), prefixes)
    left, right = (shared.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"at{x}"), "shingle") for x in "ab")
    met = balanced_join(left, right, ["shingle"]).filter("a < b AND 5 * least(na, nb) >= 4 * greatest(na, nb)")
    # The first shingle a pair shares has all the others behind it, on both sides.
    near = cut(met.filter("9 * least(na - ata, nb - atb) >= 4 * (na + nb)").select("a", "b").distinct(), shared)
    sets_a, sets_b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}")) for x in "ab")
    common = near.join(sets_a, "a").join(sets_b, "b").select("a", "b", (F.size("sa") + F.size("sb")).alias("both"), F.size(F.array_intersect("sa", "sb")).alias("same"))
    return common.filter("5 * same >= 4 * (both - same)").select("a", "b", (F.col("same") / (F.col("both") - F.col("same"))).alias("similarity"))


def simhash_classes(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, class_id, simhash): class_id is the smallest id with the same words; long texts only."""
    long = docs.filter(word_count(F.col("text")) >= least_words).select("id", content_hash_udf("text").alias("content_hash"), simhash64_udf("text").alias("simhash"))
    long = cut(long)
    first = long.groupBy("content_hash", "simhash").agg(F.min("id").alias("class_id"))
    return balanced_join(long, first, ["content_hash", "simhash"]).select("id", "class_id", "simhash")


def simhash_pairs(members: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(a, b, distance) between class representatives, a < b."""
    reps = members.filter("id = class_id").select(F.col("id"), "simhash")
    banded = cut(reps.select("id", "simhash", F.posexplode(bands(F.col("simhash"))).alias("band", "value")))
    left = banded.select(F.col("id").alias("a"), F.col("simhash").alias("ha"), "band", "value")
    right = banded.select(F.col("id").alias("b"), F.col("simhash").alias("hb"), "band", "value")
    met = balanced_join(left, right, ["band", "value"]).filter("a < b").withColumn("distance", hamming(F.col("ha"), F.col("hb")))
    return met.filter(F.col("distance") <= most_bits).select("a", "b", "distance").distinct()
