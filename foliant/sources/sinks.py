"""Writers: guarded CSV, quoted project exports, JSON responses, the request log."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.text import csv_cell, quoted_cell


def write_guarded_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Text files of CRLF lines whose cells no spreadsheet runs; every file has the header."""
    line = F.concat(F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns]), F.lit("\r"))
    df.select(line.alias("value")).write.option("header", "false").text(path)


def project_lines(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """A line per row with every cell quoted."""
    return rows.select(F.concat_ws(",", *[quoted_cell(c) for c in columns.values()]).alias("line"))


def header_line(columns: Sequence[str]) -> str:
    return ",".join('"' + c.replace('"', '""') + '"' for c in columns)


def as_json(df: DataFrame, pretty: bool = False) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": str(pretty).lower()}).alias("json"))


def append_log(rows: DataFrame, path: str) -> None:
    """Appends anonymous request rows; the list of standards is kept as JSON."""
    listed = F.to_json(F.array_distinct(F.col("standards")))
    rows.withColumn("standards", listed).write.mode("append").parquet(path)
