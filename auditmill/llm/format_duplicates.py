"""Duplicates hidden by formatting differences: one record for each, with its copies.

Records whose folded hashes (128 bits) agree form a group; the smallest id is
kept. Each copy is then compared with the kept record place by place. Copies
that differ after all (a collision) are grouped among themselves by their
folded code points. Only ids and hashes are aggregated; texts travel once, for
records of groups with copies.

A group that holds a third of all rows is split: the kept records are
replicated to the shards of such groups only.

Defined results. Null, missing and empty fields are the same; so are all
records without any letter or digit. Ids are unique; a repeated id counts once.
A payload that is no JSON object counts as one with no fields. Empty tables
give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditmill.llm import folding
from auditmill.operators.skew import balanced_join
from auditmill.session import cut


def _parsed(df: DataFrame, id_col: str, payload: str, fields: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(f, T.StringType()) for f in (*fields, "__unreadable")])
    return df.select(F.col(id_col).alias("id"), F.from_json(payload, schema, {"columnNameOfCorruptRecord": "__unreadable"}).alias("p"))


def from_payload(df: DataFrame, id_col: str, payload: str, fields: Sequence[str]) -> DataFrame:
    """(id, f0, f1, ...) of JSON objects; layout and order of the object don't matter.

    The last field is the whole text of a payload that is no object and null for
    others, so unreadable records equal only such that say the same.
    """
    parsed = _parsed(df, id_col, payload, fields)
    return parsed.select("id", *[F.col("p").getField(f).alias(f"f{i}") for i, f in enumerate((*fields, "__unreadable"))])


def unreadable(df: DataFrame, id_col: str, payload: str, fields: Sequence[str]) -> DataFrame:
    """The ids of payloads that are no JSON objects."""
    return _parsed(df, id_col, payload, fields).filter(F.col("p").getField("__unreadable").isNotNull()).select("id")


def _hash_batches(n: int, with_fields: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            a, c = folding.combined([b.column(f"f{i}") for i in range(n)])
            kept = [b.column(f"f{i}") for i in range(n)] if with_fields else []
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(a), pa.array(c), *kept], names=["id", "h1", "h2", *[f"f{i}" for i in range(n)][: len(kept)]])

    return run


def hashed(records: DataFrame, with_fields: bool = False) -> DataFrame:
    """(id, h1, h2) of records (id, f0, f1, ...); with their fields if asked for."""
    n = len(records.columns) - 1
    schema = "id long, h1 long, h2 long" + "".join(f", f{i} string" for i in range(n)) * with_fields
    return records.mapInArrow(_hash_batches(n, with_fields), schema)


def _verify(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = np.ones(b.num_rows, bool)
            for i in range(n):
                ok &= folding.same(b.column(f"f{i}"), b.column(f"k{i}"))
            form: list[bytes | None] = [None] * b.num_rows
            if not ok.all():
                for r in np.flatnonzero(~ok):
                    form[r] = b"\x00\x00\x00\x00".join(folding.folded(b.column(f"f{i}").slice(r, 1))[0].tobytes() for i in range(n))
            yield pa.RecordBatch.from_arrays([b.column("kept_id"), b.column("id"), pa.array(ok), pa.array(form, pa.binary())], names=["kept_id", "copy_id", "same", "form"])

    return run


def copies(records: DataFrame) -> DataFrame:
    """(kept_id, copy_id) of records (id, f0, f1, ...) that say the same."""
    n = len(records.columns) - 1
    fields = [f"f{i}" for i in range(n)]
    rows = cut(hashed(records, with_fields=True))
    groups = cut(rows.select("id", "h1", "h2").groupBy("h1", "h2").agg(F.min("id").alias("kept_id"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").drop("rows"))
    kept = rows.join(groups.select(F.col("kept_id").alias("id"), "h1", "h2"), ["id", "h1", "h2"], "left_semi").dropDuplicates(["id"])
    side = kept.select("h1", "h2", F.col("id").alias("kept_id"), *[F.col(f).alias(f"k{i}") for i, f in enumerate(fields)])
    pairs = balanced_join(rows, side, ["h1", "h2"]).filter(F.col("id") != F.col("kept_id")).select("kept_id", "id", *fields, *[f"k{i}" for i in range(n)])
    checked = cut(pairs.mapInArrow(_verify(n), "kept_id long, copy_id long, same boolean, form binary"))
    right = checked.filter("same").select("kept_id", "copy_id")
    wrong = checked.filter(~F.col("same")).select("copy_id", "form")
    again = wrong.groupBy("form").agg(F.min("copy_id").alias("kept_id"))
    rest = wrong.join(again, "form").filter(F.col("copy_id") != F.col("kept_id")).select("kept_id", "copy_id")
    return right.unionByName(rest).distinct()


def collapsed(records: DataFrame) -> DataFrame:
    """(kept_id, copies) of every record that is kept; copies counts the others."""
    pairs = cut(copies(records))
    ids = records.select("id").distinct()
    gone = pairs.select(F.col("copy_id").alias("id"))
    count = pairs.groupBy("kept_id").agg(F.count(F.lit(1)).alias("copies"))
    return ids.join(gone, "id", "left_anti").select(F.col("id").alias("kept_id")).join(count, "kept_id", "left").withColumn("copies", F.coalesce("copies", F.lit(0)))
