"""The cleaned table: the raw one with the cleaned columns' current values in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pivot(cells: DataFrame, columns: list[str]) -> DataFrame:
    """row_index and, for each column, c0, c1, ...: STRUCT<cleaned_value>, null where a row has no cell of the column."""
    picked = [F.max(F.when(F.col("column_name") == c, F.struct("cleaned_value"))).alias(f"c{i}") for i, c in enumerate(columns)]
    return cells.groupBy("row_index").agg(*picked)


def cleaned_table(raw: DataFrame, cells: DataFrame, columns: list[str], cleaned: list[str]) -> DataFrame:
    """raw: row_index and columns. A cell's value replaces the raw one even where it is null; a missing cell leaves it."""
    place = {c: i for i, c in enumerate(cleaned)}
    joined = raw.join(pivot(cells, cleaned), "row_index", "left")
    out = [F.when(F.col(f"c{place[c]}").isNotNull(), F.col(f"c{place[c]}.cleaned_value")).otherwise(F.col(f"`{c}`")).alias(c) if c in place else F.col(f"`{c}`") for c in columns]
    return joined.select("row_index", *out).orderBy("row_index")


def write_csv(table: DataFrame, path: str) -> None:
    """Range-ordered part files with a header; nulls are empty fields."""
    table.drop("row_index").write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="", nullValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def download_name(filename: str) -> str:
    return f"cleaned_{filename.replace(chr(92), '/').rsplit('/', 1)[-1]}"
