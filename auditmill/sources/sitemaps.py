"""Sitemap files: XML, gzip and plain text, and walking their indexes."""

from __future__ import annotations

import gzip
import io
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from itertools import count

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditmill.session import cut

# The format's own limits per file, and how many files of one site are read. All are defaults of parameters; None is no limit.
MOST_ENTRIES, MOST_BYTES, MOST_FILES = 50_000, 50 * 1024 * 1024, 100
ENTRIES = "sitemap string, kind string, loc string, pos int, left_out boolean"


def parse(data: bytes | None, entries: int | None = MOST_ENTRIES, size: int | None = MOST_BYTES) -> tuple[str, list[str], bool] | None:
    """('index' or 'urls', addresses, whether a limit cut some off) of a file; None where it is no sitemap."""
    body = bytes(data or b"")
    if body[:2] == b"\x1f\x8b":
        try:
            packed = gzip.GzipFile(fileobj=io.BytesIO(body))
            body = packed.read() if size is None else packed.read(size + 1)
        except (OSError, EOFError):
            return None
    over = size is not None and len(body) > size
    body = body[:size].removeprefix(b"\xef\xbb\xbf").strip()
    if body.startswith(b"<"):
        kind, locs, depth = None, [], 0
        try:
            for event, node in ET.iterparse(io.BytesIO(body), ("start", "end")):
                name = node.tag.rsplit("}", 1)[-1].lower()
                depth += 1 if event == "start" else -1
                if event == "start" and kind is None:
                    kind = {"urlset": "urls", "sitemapindex": "index"}.get(name)
                    if kind is None:
                        return None
                elif event == "end" and depth == 2 and name == "loc" and node.text and node.text.strip():
                    if entries is not None and len(locs) == entries:
                        over = True
                        break
                    locs.append(node.text.strip())
                elif event == "end" and depth == 1:
                    node.clear()
        except ET.ParseError:
            pass
        return (kind, locs, over) if kind else None
    lines = [x.strip() for x in body.decode("utf-8", "replace").splitlines()]
    locs = [x for x in lines if x.lower().startswith(("http://", "https://"))]
    return ("urls", locs[:entries], over or (entries is not None and len(locs) > entries)) if locs else None


def _entries(most: int | None, size: int | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for url, body in zip(pdf["url"], pdf["body"], strict=True):
                found = parse(body, most, size)
                if found:
                    out += [(url, found[0], loc, i, found[2]) for i, loc in enumerate(found[1])]
            yield pd.DataFrame(out, columns=["sitemap", "kind", "loc", "pos", "left_out"])

    return run


def entries(files: DataFrame, most: int | None = MOST_ENTRIES, size: int | None = MOST_BYTES) -> DataFrame:
    """One row per address of ``files`` (url, body); ``left_out`` says that its file holds more than the limits allow."""
    return files.select("url", "body").mapInPandas(_entries(most, size), ENTRIES)


def walked(e: DataFrame, roots: DataFrame, files: int | None = MOST_FILES) -> DataFrame:
    """(sitemap, round, read) of the files reached from ``roots`` (url) through the indexes in ``e``, until none is new.

    At most ``files`` of them are read, in order of round and address; of the
    others only the name is known. The walk itself has no limit.
    """
    front = seen = cut(roots.select(F.col("url").alias("sitemap")).distinct().withColumn("round", F.lit(0)))
    inner = cut(e.filter("kind = 'index'").select("sitemap", F.col("loc").alias("to")).distinct())
    for k in count(1):
        deeper = inner.join(front.select("sitemap"), "sitemap").select(F.col("to").alias("sitemap")).distinct()
        front = cut(deeper.join(seen.select("sitemap"), "sitemap", "left_anti").withColumn("round", F.lit(k)))
        if front.isEmpty():
            break
        seen = cut(seen.unionByName(front), seen)
    if files is None:
        return seen.withColumn("read", F.lit(True))
    first = seen.orderBy("round", "sitemap").limit(files).select("sitemap", F.lit(True).alias("read"))
    return seen.join(first, "sitemap", "left").withColumn("read", F.coalesce("read", F.lit(False)))


def listed(files: DataFrame, roots: DataFrame, most_files: int | None = MOST_FILES) -> DataFrame:
    """(url, sitemap) reached from ``roots`` (url) through indexes; a URL belongs to the first sitemap that names it."""
    e = cut(entries(files))
    read = walked(e, roots, most_files).filter("read")
    met = e.filter("kind = 'urls'").join(read, "sitemap")
    return met.groupBy(F.col("loc").alias("url")).agg(F.min_by("sitemap", F.struct("round", "sitemap", "pos")).alias("sitemap"))
