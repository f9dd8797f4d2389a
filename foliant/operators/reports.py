"""Aggregations and exports: coverage, status, quality gates, summaries, canonical keys, CSV text."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.quantities import percent
from foliant.functions.text import csv_cell


def project_summary(rows: DataFrame, by: str, amount: str, kind: str) -> DataFrame:
    cents = F.sum(F.floor(F.col(amount) * 100 + 0.5).cast("long"))  # whole numbers: the order of a sum doesn't matter
    return rows.groupBy(by).agg(F.count(F.lit(1)).alias("n"), cents.alias("total_cents"), F.countDistinct(kind).alias("n_priorities"), F.floor(cents / F.count(F.lit(1))).cast("long").alias("mean_cents"))


def coverage(docs: DataFrame, covered: DataFrame, by: str, kind: str, key: str) -> DataFrame:
    """Distinct kinds, counts per kind as sorted text, and the share of rows that are covered."""
    marked = docs.join(covered.select(key).distinct().withColumn("__c", F.lit(1)), key, "left")
    each = marked.groupBy(by, kind).agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("__c", F.lit(0))).alias("c"))
    pairs = F.array_sort(F.collect_list(F.concat(F.col(kind), F.lit("="), F.col("n").cast("string"))))
    out = each.groupBy(by).agg(F.count(kind).alias("n_langs"), F.array_join(pairs, ",").alias("by_lang"), F.sum("n").alias("n"), F.sum("c").alias("c"))
    return out.select(by, "n_langs", "by_lang", percent(F.col("c"), F.col("n")).alias("percent"))


def index_status(docs: DataFrame, labels: DataFrame, by: str, key: str, value: str, alarm: int = 60) -> DataFrame:
    """Per owner and in total: rows, covered rows, share, and warnings."""
    joined = docs.select(by, key).join(labels.select(key, value), key, "left")
    out = joined.rollup(by).agg(F.count(F.lit(1)).alias("n_docs"), F.count(value).alias("n_labelled"))
    out = out.withColumn("percent", percent(F.col("n_labelled"), F.col("n_docs")))
    warnings = F.concat_ws("; ", F.when(F.col("n_labelled") == 0, "no labels"), F.when(F.col("percent") < alarm, "low coverage"))
    return out.select(F.coalesce(by, F.lit("(total)")).alias(by), "n_docs", "n_labelled", "percent", warnings.alias("warnings"))


def quality_gate(rows: DataFrame, least: float = 90) -> DataFrame:
    """Conditional counts over all rows and whether the share of good ones suffices."""
    out = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"),
        F.count_if(F.coalesce("text", F.lit("")) == "").alias("empty"), F.count_if(F.col("n_chars") < 200).alias("short"), F.count_if(F.col("lang").isNull()).alias("no_lang"),
    )
    share = F.col("good") * 100.0 / F.col("n")
    return out.select(F.lit("all").alias("scope"), "*", F.floor(share + 0.5).alias("quality_percent"), (share >= least).alias("passed"))


def spot_check(counts: DataFrame, present: DataFrame, owner: str, n: str, ordinal: str) -> DataFrame:
    """First, middle and last ordinal of each owner: which are missing among the rows (owner, ordinal) that are there."""
    wanted = F.array_distinct(F.array(F.lit(0).cast("long"), F.floor((F.col(n) - 1) / 2).cast("long"), (F.col(n) - 1).cast("long")))
    probes = counts.where(F.col(n) > 0).select(owner, F.explode(wanted).alias("__o"))
    have = present.select(F.col(owner).alias("__h"), F.col(ordinal).cast("long").alias("__p")).distinct()
    got = probes.join(have, (F.col(owner) == F.col("__h")) & (F.col("__o") == F.col("__p")), "left")
    return got.groupBy(owner).agg(F.count(F.lit(1)).alias("probed"), F.array_sort(F.collect_list(F.when(F.col("__p").isNull(), F.col("__o")))).alias("missing"))


def upper_median_exact(rows: DataFrame, by: str, value: str, name: str) -> DataFrame:
    """The later of the two middle values. Values are counted first, so a group's work is its distinct values, in a running sum."""
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(by).orderBy(value)
    at = counts.withColumn("__to", F.sum("__n").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(Window.partitionBy(by)))
    return at.where(F.col("__to") > F.floor(F.col("__all") / 2)).groupBy(by).agg(F.min(value).alias(name))


def canonical_json(fields: dict[str, Column]) -> Column:
    """JSON with sorted keys; null fields are left out."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))


def cache_key(prefix: str, fields: dict[str, Column], version: Column | None = None) -> Column:
    parts = [F.lit(prefix), *([version.cast("string")] if version is not None else []), F.sha2(canonical_json(fields), 256)]
    return F.concat_ws(":", *parts)


def embedding_key(model: Column, text: Column) -> Column:
    return F.concat_ws(":", F.lit("cache:emb"), model, F.sha2(text, 256))


def search_key(schema: Column, version: Column, fields: dict[str, Column]) -> Column:
    return F.concat_ws(":", F.lit("cache:search"), schema, version, F.sha2(canonical_json(fields), 256))


def summary_key(schema: Column, version: Column, model: Column, query: Column, codes: Column) -> Column:
    """For a list of result codes; null codes count as empty ones."""
    listed = F.array_join(F.coalesce(codes, F.array().cast("array<string>")), ",", "")
    return F.concat_ws(":", F.lit("cache:ai"), schema, version, F.sha2(F.concat_ws("\n", model, query, listed), 256))


def governing_task(rows: DataFrame, space: str, task: str, target: str) -> DataFrame:
    """Per shared space the most frequent task; of equally frequent ones the one with the highest target, then the first by name."""
    each = rows.groupBy(space, task).agg(F.count(F.lit(1)).alias("n"), F.max(target).alias("target"))
    w = Window.partitionBy(space).orderBy(F.col("n").desc(), F.col("target").desc_nulls_last(), F.col(task))
    return each.withColumn("__r", F.row_number().over(w)).where("__r = 1").drop("__r")


def csv_lines(rows: DataFrame, columns: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One text of CRLF-joined guarded rows, newest first, for an export that a limit bounds."""
    line = F.concat_ws(",", *[csv_cell(F.col(c)) for c in columns])
    listed = F.sort_array(F.collect_list(F.struct(*[o.alias(f"__{i}") for i, o in enumerate(order)], line.alias("line"))), asc=False)
    return rows.agg(F.array_join(F.transform(listed, lambda x: x["line"]), "\r\n").alias("csv"), F.count(F.lit(1)).alias("n"))
