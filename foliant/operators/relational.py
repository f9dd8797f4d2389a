"""Filters, joins, windows and set operations over document, application and project tables."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.vector import top_per


def conjunction(conditions: Sequence[Column]) -> Column:
    return reduce(and_, conditions, F.lit(True))


def dynamic_filter(df: DataFrame, *, active: str | None = None, either: tuple[str, str, str] | None = None, equal: dict | None = None, prefix: tuple[str, str] | None = None) -> DataFrame:
    """Only the conditions that are asked for: an active flag, a value or the catch-all, equalities, a case-blind prefix."""
    conditions = [F.col(active) == 1] if active else []
    if either and either[1] != either[2]:
        conditions.append(F.col(either[0]).isin(either[1], either[2]))
    conditions += [F.col(c) == v for c, v in (equal or {}).items() if v is not None]
    if prefix:
        conditions.append(F.startswith(F.upper(F.col(prefix[0])), F.lit(prefix[1].upper())))
    return df.where(conjunction(conditions))


def keyword_all_terms(df: DataFrame, columns: Sequence[str], query: str, least: int = 3, most: int = 4) -> DataFrame:
    """Rows that hold each of the query's first terms in some column, whatever its case."""
    terms = [t for t in query.lower().split() if len(t) >= least][:most]
    if not terms:
        return df.where(F.lit(False))
    return df.where(conjunction([reduce(or_, [F.coalesce(F.lower(F.col(c)).contains(t), F.lit(False)) for c in columns]) for t in terms]))


def layered(df: DataFrame, seed: dict, layers: Sequence[Sequence[str]], key: str, order: Sequence[Column], n: int) -> DataFrame:
    """Relatives of a seed row, closest layer first, until n are found; a layer with a null key is skipped."""
    layer = F.lit(None).cast("int")
    for i, columns in reversed(list(enumerate(layers))):
        if all(seed[c] is not None for c in columns):
            layer = F.when(conjunction([F.col(c) == F.lit(seed[c]) for c in columns]), F.lit(i)).otherwise(layer)
    found = df.withColumn("layer", layer).where(F.col("layer").isNotNull() & (F.col(key) != F.lit(seed[key])))
    return found.orderBy(F.col("layer"), *order, F.col(key)).limit(n)


def hierarchy_keys(c: str) -> list[Column]:
    """Sort keys of a hierarchy field: filled before empty, zones by number, lower limits before upper ones, then case-blind."""
    x = F.col(c)
    zone = F.regexp_extract(x, r"(?i)^lz\s?(\d+)$", 1)
    return [
        F.coalesce(x, F.lit("")) == "",
        F.coalesce(F.nullif(zone, F.lit("")).cast("int"), F.lit(-1)),
        F.when(F.lower(x).contains("lower limit"), 0).when(F.lower(x).contains("upper limit"), 1).otherwise(-1),
        F.lower(F.coalesce(x, F.lit(""))),
    ]


def row_number_of(text: Column) -> Column:
    """The first whole number in a row reference; missing ones sort last."""
    return F.coalesce(F.regexp_extract(text, r"(\d+)", 1).try_cast("long"), F.lit(9007199254740991))


def bucketed_order(df: DataFrame, score: str, then: Sequence[Column], step: float = 0.01) -> list[Column]:
    """Scores that fall in one bucket count as equal, then the given keys decide. (Comparing by a tolerance would not be transitive.)"""
    return [F.floor(F.col(score) / step).desc(), *then]


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with its place (from 1) in ``order``, whose keys must tell all rows apart.

    Range partitions are sorted and counted on their own, so no task sees all rows; a number a partition comes to the
    driver. The sorted rows are kept by Spark (and made again from the same ranges if an executor is lost).
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id()).persist(StorageLevel.MEMORY_AND_DISK)
    part = F.shiftright("__m", 33)
    sizes = {r["part"]: r["n"] for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()}
    base, starts = 1, []
    for k in range(max(sizes, default=-1) + 1):
        starts.append(F.lit(base).cast("long"))
        base += sizes.get(k, 0)
    start = F.get(F.array(*starts), part.cast("int")) if starts else F.lit(1).cast("long")  # an array by partition: found in one step
    return placed.withColumn(name, start + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m")


def cluster_siblings(df: DataFrame, group: Sequence[str], position: str, within: Sequence[Column]) -> DataFrame:
    """A group takes the place of its best member; members follow publication order. Adds ``final_position``."""
    best = df.groupBy(*[F.col(g).alias(f"__{g}") for g in group]).agg(F.min(position).alias("__group"))
    same = conjunction([F.col(g).eqNullSafe(F.col(f"__{g}")) for g in group])
    placed = df.join(best, same).drop(*[f"__{g}" for g in group])
    return numbered(placed, [F.col("__group"), *within], "final_position").drop("__group")


def counts_kept(parents: DataFrame, children: DataFrame, key: str, child_key: str, name: str) -> DataFrame:
    """Parents with the number of their children, zero included."""
    counts = children.groupBy(F.col(child_key).alias("__k")).agg(F.count(F.lit(1)).alias("__n"))
    return parents.join(counts, F.col(key) == F.col("__k"), "left").withColumn(name, F.coalesce("__n", F.lit(0)).cast("long")).drop("__k", "__n")


def newest_per(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    return top_per(df, by, order, 1)


def nearest_within(left: DataFrame, right: DataFrame, key: str, at: str, right_at: str, radius: float, left_id: str, order: Sequence[Column]) -> DataFrame:
    """For each left row the nearest right row of the same key within ``radius``: buckets as wide as the radius make it an equi-join."""
    bucket = lambda c: F.floor(F.col(c) / radius).cast("long")
    a = left.withColumn("__b", F.explode(F.array(bucket(at) - 1, bucket(at), bucket(at) + 1)))
    b = right.withColumnRenamed(key, "__key").withColumn("__b2", bucket(right_at))
    near = a.join(b, (F.col(key) == F.col("__key")) & (F.col("__b") == F.col("__b2"))).withColumn("distance", F.abs(F.col(at) - F.col(right_at))).where(F.col("distance") <= radius)
    return top_per(near.drop("__b", "__b2", "__key"), [left_id], [F.col("distance"), *order], 1)


def last_before(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """The last non-null value above a row."""
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def forward_fill(df: DataFrame, by: Sequence[str], order: Sequence[Column], value: Column, name: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(name, F.last(value, ignorenulls=True).over(w))


def islands(df: DataFrame, by: Sequence[str], order: Sequence[Column], starts: Column, name: str) -> DataFrame:
    """Numbers runs of rows; ``starts`` tells from the lagged values whether a new run begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(starts, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long"))


def with_fallback(df: DataFrame, lookup: DataFrame, keys: Sequence[Column], lookup_key: str, values: Sequence[str]) -> DataFrame:
    """Looks up by the first key, then by the next ones."""
    out = df
    for i, key in enumerate(keys):
        side = lookup.select(F.col(lookup_key).alias(f"__k{i}"), *[F.col(v).alias(f"__{v}{i}") for v in values])
        out = out.join(side, key == F.col(f"__k{i}"), "left")
    picked = {v: F.coalesce(*[F.col(f"__{v}{i}") for i in range(len(keys))]) for v in values}
    return out.withColumns(picked).drop(*[f"__k{i}" for i in range(len(keys))], *[f"__{v}{i}" for i in range(len(keys)) for v in values])


def word_windows(df: DataFrame, text: str, size: int = 350, overlap: int = 40, least: int = 30) -> DataFrame:
    """Windows of ``size`` words every ``size - overlap`` words, until one has fewer than ``least``. Adds chunk_no, n_chunk_words, chunk."""
    step = size - overlap

    def windows(words: Column) -> Column:
        starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.filter(F.transform(starts, lambda i: F.slice(words, i + 1, F.lit(size))), lambda s: F.size(s) >= least)

    words = F.filter(F.split(F.col(text), r"\s+"), lambda w: w != "")
    cut = F.element_at(F.transform(F.array(words), windows), 1)  # a text is split once
    # the outer form: else a filter on the array's size is put before it, which would split again
    out = df.select(*df.columns, F.posexplode_outer(cut).alias("chunk_no", "__c")).where("__c is not null")
    return out.withColumn("n_chunk_words", F.size("__c")).withColumn("chunk", F.array_join("__c", " ")).drop("__c")


PER_TASK = 1 << 18


def cooccurrence(df: DataFrame, basket: str, item: str, per_task: int = PER_TASK) -> DataFrame:
    """Pairs of items that stand in the same baskets, with the number of these. The number of tasks grows with the rows, so that a task's pairs don't."""
    n = 1 + df.count() // per_task
    items = df.select(basket, item).repartition(n, basket).distinct()
    a, b = items.withColumnRenamed(item, "item_a"), items.withColumnRenamed(item, "item_b")
    pairs = a.join(b, basket).where("item_a < item_b").select("item_a", "item_b")
    return pairs.repartition(n, "item_a", "item_b").groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("together"))
