"""Spans of regular expressions with column functions alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def found(text: Column, pattern: str, worth: Column) -> Column:
    """Leftmost non-overlapping matches as array<struct<start, end, value>> in code points.

    ``split`` and ``regexp_extract_all`` see the same matches: what stands between them gives
    the offsets. Only texts for which ``worth`` holds are searched.
    """
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    empty = F.from_json(F.lit("[]"), SPAN)
    pairs = F.arrays_zip(values.alias("value"), F.slice(gaps, F.lit(1), F.size(values)).alias("gap"))
    scan = F.aggregate(
        pairs,
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("at"),
            F.concat(acc["out"], F.array(F.struct((acc["at"] + F.length(x["gap"])).alias("start"), (acc["at"] + F.length(x["gap"]) + F.length(x["value"])).alias("end"), x["value"].alias("value")))).alias("out"),
        ),
        lambda acc: acc["out"],
    )
    return F.coalesce(F.when(worth, scan), empty)


def tagged(spans: Column, kind: str, order: int) -> Column:
    """array<struct<start, end, value>> -> array<struct<rank, start, end, kind>>."""
    return F.transform(spans, lambda s: F.struct(F.lit(order).alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
