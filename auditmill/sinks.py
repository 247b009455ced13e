"""Tables written for people and programs: CSV as spreadsheets read it, sheets of limited size, JSON summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditmill.functions.text import csv_field

SHEET_ROWS, CELL = 1_048_575, 32_767


def csv_lines(df: DataFrame) -> DataFrame:
    """(line) of a table without its header: quoted where needed, decimals with one place, nothing for null."""
    def cell(name: str, kind: str):
        c = F.col(f"`{name}`")
        text = F.format_string("%.1f", c) if kind in ("double", "float") else c.cast("string")
        return F.coalesce(csv_field(F.when(c.isNotNull(), text)), F.lit(""))

    return df.select(F.concat_ws(",", *[cell(n, k) for n, k in df.dtypes]).alias("line"))


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with a byte order mark, a header and CRLF, one per partition; each can be opened by itself."""
    head = ",".join('"' + c.replace('"', '""') + '"' if any(x in c for x in '",\r\n') else c for c in df.columns)
    lines = csv_lines(df)

    def framed(batches):
        import pandas as pd

        yield pd.DataFrame({"line": ["\ufeff" + head]})
        yield from batches

    lines.mapInPandas(framed, "line string").write.option("lineSep", "\r\n").text(path)


def sheets(df: DataFrame, order: list, rows: int = SHEET_ROWS, cell: int = CELL) -> DataFrame:
    """Rows with ``sheet`` and ``row`` from 1 as a spreadsheet holds them, and texts cut to what a cell takes.

    Rows are numbered range by range: partitions are sorted and counted, so no task sees more than its own range.
    """
    placed = df.orderBy(*order).withColumn("__at", F.monotonically_increasing_id())
    part = F.shiftright("__at", 33)
    counts = placed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("__n")
    at = placed.withColumn("__part", part).join(F.broadcast(before), "__part")
    number = F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    cells = [F.substring(c, 1, cell).alias(c) if k == "string" else F.col(c) for c, k in df.dtypes]
    return at.select((F.floor(number / rows) + 1).alias("sheet"), (number % rows + 1).alias("row"), *cells)


def json_summary(df: DataFrame) -> DataFrame:
    """(json) of every row as an object, nulls left out."""
    return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
