"""Second looks into a vector index: more excerpts for groups that the first look left empty, and tails of documents within a budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators import vector

BACKFILL_GROUPS, BACKFILL = 10, 15
PROBED_GROUPS, PROBE_BATCH, PROBE_BUDGET, PROBE_MARGIN, PROBE_KEPT = 8, 20, 30, 40, 30


def lacking(ranked: DataFrame, group: str, order: Sequence[Column], hits: DataFrame, hit_group: str, enough: Column, most: int = BACKFILL_GROUPS) -> DataFrame:
    """(group): the first ``most`` groups, as they come in ``ranked``, none of whose hits is ``enough``; a null group is none."""
    served = hits.where(enough).select(F.col(hit_group).alias("__g")).distinct()
    firsts = vector.top_per(ranked.where(F.col(group).isNotNull()), [group], order, 1)
    return firsts.join(served, F.col(group) == F.col("__g"), "left_anti").orderBy(*order).limit(most).select(group)


def backfill(vectors: DataFrame, targets: DataFrame, queries, id_col: str, vec_col: str, group: str, wanted: Column, keep: Sequence[str] = (), k: int = BACKFILL) -> DataFrame:
    """The ``k`` best vectors of each target group, whatever they are, and of these the wanted ones.

    The limit stands before the filter, as in an index that can only be asked by group. Groups
    outside ``targets`` (few rows, by one column) are not scored.
    """
    asked = vectors.join(targets.select(F.col(targets.columns[0]).alias("__g")), F.col(group) == F.col("__g"), "left_semi")
    return vector.top_k_per_group(asked, queries, id_col, vec_col, group, k, keep).where(wanted)


def backfilled(hits: DataFrame, more: DataFrame, id_col: str) -> DataFrame:
    """Hits and what the second look adds; a row that both found comes once, as first found."""
    return vector.keyed_union([hits, more.select(hits.columns)], id_col, [])


def tail_windows(groups: DataFrame, group: str, count: str, wanted: str, most: int = PROBED_GROUPS, batch: int = PROBE_BATCH, budget: int = PROBE_BUDGET, margin: int = PROBE_MARGIN) -> DataFrame:
    """(group, from, batches): the ordinal from which each group's tail is read.

    The ``most`` groups with most wanted entries come in turn. Each asks for the last ``2 * wanted + margin`` of its ordinals, in
    batches from the end backwards; batches are granted while the budget of all groups lasts, so the last group served may
    get the newest part of its window alone and later ones nothing.
    """
    first = [F.desc(wanted), F.asc(group)]
    asked = groups.where((F.col(wanted) > 0) & F.col(count).isNotNull()).orderBy(*first).limit(most)
    window = asked.select(F.col(group), F.col(count).alias("__count"), F.col(wanted).alias("__wanted"), F.least(F.col(count), F.col(wanted) * 2 + margin).alias("__need"))
    # at most ``most`` rows: the running cost needs no other order
    spent = F.coalesce(F.sum(F.ceil(F.col("__need") / batch)).over(Window.orderBy(F.desc("__wanted"), F.asc(group)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    granted = F.greatest(F.lit(0), F.least(F.ceil(F.col("__need") / batch), budget - F.col("__spent")))
    served = window.withColumn("__spent", spent).withColumn("batches", granted.cast("long")).where("batches > 0")
    return served.select(group, F.greatest(F.col("__count") - F.col("__need"), F.col("__count") - F.col("batches") * batch).cast("long").alias("from"), "batches")


def tail_probe(vectors: DataFrame, windows: DataFrame, queries, id_col: str, vec_col: str, group: str, ordinal: str, wanted: Column, keep: Sequence[str] = (), k: int = PROBE_KEPT) -> DataFrame:
    """The ``k`` best wanted vectors of the tails that ``windows`` grants."""
    of = windows.select(F.col(group).alias("__g"), F.col("from").alias("__from"))
    tails = vectors.where(wanted).join(of, (F.col(group) == F.col("__g")) & (F.col(ordinal) >= F.col("__from")))
    return vector.top_k(tails, queries, id_col, vec_col, k, keep)
