"""States that run along ordered lines, without a task that holds a whole document.

A running value over a document is a running value within pieces of ``CHUNK`` places, joined with
what all pieces before come to; only one row a piece meets the other pieces of its document. ``at``
is a whole number that orders the rows of a document; places may be missing, none may return.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK = 4096
SLOTS = 8


def _sum_of(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


#: Aggregate, and how the value of what came before is joined with that of a piece.
KINDS = {"sum": (F.sum, _sum_of), "min": (F.min, F.least), "max": (F.max, F.greatest)}


def running(df: DataFrame, by: Sequence[str], at: str, values: dict[str, tuple[str, Column]], chunk: int = CHUNK) -> DataFrame:
    """``df`` with running sums, least or greatest values up to and with each row; nulls are passed over (a sum of nothing is 0)."""
    pieces = df.withColumn("__piece", F.floor(F.col(at) / chunk)).withColumns({f"__{n}": v for n, (_, v) in values.items()})
    totals = pieces.groupBy(*by, "__piece").agg(*[KINDS[kind][0](f"__{n}").alias(f"__{n}") for n, (kind, _) in values.items()])
    above = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(*[F.col(c).alias(f"__k_{c}") for c in (*by, "__piece")], *[KINDS[kind][0](f"__{n}").over(above).alias(f"__b_{n}") for n, (kind, _) in values.items()])
    within = Window.partitionBy(*by, "__piece").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    inner = pieces.withColumns({f"__{n}": KINDS[kind][0](f"__{n}").over(within) for n, (kind, _) in values.items()})
    same = [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*by, "__piece")]
    joined = inner.join(before, same)
    return joined.select(*[c for c in df.columns if c not in values], *[KINDS[kind][1](F.col(f"__b_{n}"), F.col(f"__{n}")).alias(n) for n, (kind, _) in values.items()])


# ---------------------------------------------------------------- hierarchy slots


def slot_fill(lines: DataFrame, by: Sequence[str], at: str, depth: str, name: str, carried: Sequence[str] = (), slots: int = SLOTS, chunk: int = CHUNK) -> DataFrame:
    """Lines with ``placed`` (the slot a heading took) and ``slots``: at each line an array of (at, name, *carried), null where empty.

    A line with a name is a heading: it takes the slot of its depth, but skips no empty one, and empties the
    slots below. Other lines change nothing. Slots are filled without gaps, so a heading's slot is
    ``min(depth, slot of the heading before + 1)``, which comes to its number plus the least of (depth - number) so far: a running minimum.
    """
    is_heading, deep = F.col(name).isNotNull(), F.least(F.col(depth), F.lit(slots - 1)).cast("long")
    within = Window.partitionBy(*by, "__piece").orderBy(at).rowsBetween(Window.unboundedPreceding, 0)
    above = Window.partitionBy(*by).orderBy("__piece").rowsBetween(Window.unboundedPreceding, -1)
    rows = lines.withColumn("__piece", F.floor(F.col(at) / chunk)).withColumn("__k", F.sum(is_heading.cast("long")).over(within))
    rows = rows.withColumn("__low", F.min(F.when(is_heading, deep - F.col("__k"))).over(within))
    # both minima in one pass over the lines: a piece's own numbers are shifted by the headings of the pieces before
    totals = rows.groupBy(*by, "__piece").agg(F.max("__k").alias("__n"), F.min("__low").alias("__m")).withColumn("__before", F.coalesce(F.sum("__n").over(above), F.lit(0)))
    begun = totals.select(*[F.col(c).alias(f"__k_{c}") for c in (*by, "__piece")], "__before", F.min(F.col("__m") - F.col("__before")).over(above).alias("__least"))
    joined = rows.join(begun, [F.col(c).eqNullSafe(F.col(f"__k_{c}")) for c in (*by, "__piece")])
    slot = F.col("__before") + F.col("__k") - 1 + F.least(F.lit(0), F.least("__least", F.col("__low") - F.col("__before")) + 1)
    placed = joined.select(*lines.columns, F.when(is_heading, slot).cast("int").alias("placed"))
    entry = F.struct(F.col(at).alias("at"), F.col(name).alias("name"), *[F.col(c).alias(c) for c in carried])
    last = running(placed, by, at, {f"__s{k}": ("max", F.when(F.col("placed") == k, entry)) for k in range(slots)}, chunk)
    valid = [F.when(F.coalesce(F.col(f"__s{k}.at") > F.greatest(F.lit(None).cast("long"), F.lit(None).cast("long"), *[F.col(f"__s{j}.at") for j in range(k)]), F.lit(True)), F.col(f"__s{k}")) for k in range(slots)]
    return last.withColumn("slots", F.array(*valid)).drop(*[f"__s{k}" for k in range(slots)])


def filled(slots: Column) -> Column:
    """How many slots are taken; there are no gaps."""
    return F.size(F.filter(slots, lambda s: s.isNotNull()))


def with_leaf(slots: Column, depth: Column, name: Column) -> Column:
    """Names of the slots as a row below them sees it: its own name in the slot of its depth (that skips no empty one); short names leave it."""
    place = F.least(depth, filled(slots), F.size(slots) - 1)
    return F.transform(slots, lambda s, i: F.when((i == place) & (F.length(name) >= 2), name).otherwise(s["name"]))


# ---------------------------------------------------------------- counts that start again


def _next_breaks(amount: np.ndarray, target: int, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums up to each row, and for each row at which a count starts the row after the one that fills it (the number of rows + 1 if none does)."""
    upto = np.concatenate([[0], np.cumsum(amount)])
    return upto, np.searchsorted(upto[1:], upto[:-1] + target - restart, "left") + 1


def transitions(amount: np.ndarray, target: int, restart: int) -> tuple[np.ndarray, np.ndarray]:
    """For each count that a piece may begin with: the count it ends with, and how often it was full. Pointers to the next break jump in doublings."""
    n = amount.size
    upto, after = _next_breaks(amount, target, restart)
    jump = np.append(np.minimum(after, n + 1), [n + 1, n + 1])  # from a row to the row after its break; n + 1 is nowhere
    jump[n] = n + 1
    times, to = (jump <= n).astype(np.int64), np.where(jump <= n, jump, np.arange(n + 2))
    for _ in range(int(n).bit_length()):
        times, to = times + times[to], to[to]
    carry = np.arange(target)
    first = np.searchsorted(upto[1:], target - carry, "left") + 1
    fills = first <= n
    start = np.where(fills, first, 0)
    last = to[start]
    return np.where(fills, restart + upto[n] - upto[np.minimum(last, n)], carry + upto[n]), np.where(fills, 1 + times[start], 0)


def breaks(amount: np.ndarray, carry: int, target: int, restart: int) -> np.ndarray:
    """Rows that fill the count which begins with ``carry``."""
    upto, after = _next_breaks(amount, target, restart)
    at, out = int(np.searchsorted(upto[1:], target - carry, "left")) + 1, []
    while at <= amount.size:
        out.append(at - 1)
        at = int(after[at]) if at < amount.size else amount.size + 1
    return np.array(out, np.int64)


def segments(df: DataFrame, by: str, at: str, amount: str, target: int, restart: int = 0, chunk: int = CHUNK) -> DataFrame:
    """``df`` (by, at, amount) with ``segment``: how often the running amount has reached ``target`` before the row, starting again from ``restart`` each time.

    What a piece does to a count is a table of ``target`` entries, whatever came before; a fold over a document's
    tables gives the count at which each piece begins. Amounts are whole and not negative (null is 0), 0 <= restart < target.
    """
    rows = df.withColumns({"__by": F.col(by), "__at": F.col(at), "__piece": F.floor(F.col(at) / chunk), "__amount": F.coalesce(amount, F.lit(0)).cast("long")})
    kind = df.schema[by].dataType
    field = lambda n, t: T.StructField(n, t)

    def table(key: tuple, piece: pa.Table) -> pa.Table:
        carry, times = transitions(piece.sort_by("__at")["__amount"].to_numpy(), target, restart)
        return pa.table({"__by": pa.array([key[0].as_py()], piece.schema.field("__by").type), "__piece": [key[1].as_py()], "carry": [carry.tolist()], "times": [times.tolist()]})

    # only what comes before another piece of its document needs a table; most documents are one piece
    ends = rows.groupBy(F.col("__by").alias("__b")).agg(F.max("__piece").alias("__end"), F.min("__piece").alias("__start")).where("__start < __end")
    followed = rows.select("__by", "__at", "__piece", "__amount").join(ends, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__piece") < F.col("__end"))).drop("__b", "__start", "__end")
    schema = T.StructType([field("__by", kind), field("__piece", T.LongType()), field("carry", T.ArrayType(T.LongType())), field("times", T.ArrayType(T.LongType()))])
    tables = followed.groupBy("__by", "__piece").applyInArrow(table, schema).groupBy("__by").agg(F.sort_array(F.collect_list(F.struct("__piece", "carry", "times"))).alias("t"))
    # a piece begins with what the last one before it that has rows ends with
    fold = F.expr("""aggregate(t, struct(0L as c, 0L as n, cast(array() as array<struct<__k: bigint, __c: bigint, __n: bigint>>) as starts),
        (s, x) -> struct(x.carry[s.c] as c, s.n + x.times[s.c] as n, array_append(s.starts, struct(x.__piece as __k, x.carry[s.c] as __c, s.n + x.times[s.c] as __n)) as starts), s -> s.starts)""")
    starts = tables.select(F.col("__by").alias("__b"), F.inline(fold))
    along = Window.partitionBy("__b").orderBy("__k")
    later = starts.unionByName(ends.select("__b", F.col("__end").alias("__k"), F.lit(None).cast("long").alias("__c"), F.lit(None).cast("long").alias("__n")))
    later = later.select("__b", "__k", *[F.lag(c).over(along).alias(c) for c in ("__c", "__n")]).where("__c is not null")
    begun = rows.join(later, F.col("__by").eqNullSafe(F.col("__b")) & (F.col("__piece") == F.col("__k")), "left")
    begun = begun.select(*df.columns, "__by", "__piece", "__at", "__amount", F.coalesce("__c", F.lit(0)).alias("__c"), F.coalesce("__n", F.lit(0)).alias("__n"))
    helpers, out = ["__by", "__piece", "__at", "__amount", "__c", "__n"], T.StructType([*df.schema.fields, field("segment", T.LongType())])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, count, done = None, 0, 0  # the piece under way, its running amount and its number of full counts
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, pieces = batch.column("__by"), batch.column("__piece").to_numpy()
            amount, first, full = (batch.column(c).to_numpy() for c in ("__amount", "__c", "__n"))
            of = pc.fill_null(keys.dictionary_encode().indices, -1).to_numpy()
            cuts = np.r_[0, np.flatnonzero((of[1:] != of[:-1]) | (pieces[1:] != pieces[:-1])) + 1, of.size]
            segment = np.empty(of.size, np.int64)
            for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if a or last != (keys[0].as_py(), pieces[0]):
                    count, done = int(first[a]), int(full[a])
                at_ends = breaks(amount[a:b], count, target, restart)
                segment[a:b] = done + np.searchsorted(at_ends, np.arange(b - a), "left")
                count = restart + int(amount[a + at_ends[-1] + 1 : b].sum()) if at_ends.size else count + int(amount[a:b].sum())
                done += at_ends.size
            last = (keys[-1].as_py(), pieces[-1])
            kept = [c for i, c in enumerate(batch.columns) if batch.schema.names[i] not in helpers]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(segment)], out.names)

    return begun.repartition("__by", "__piece").sortWithinPartitions("__by", "__piece", "__at").mapInArrow(number, out)


# ---------------------------------------------------------------- left edges


def edge_levels(edges: DataFrame, by: str, x: str, tolerance: float = 4.0, support: int = 3, gap: float = 30.0, most: int = 9) -> DataFrame:
    """(by, levels): centres of clusters of ``x``, ascending, for each document.

    A value joins the cluster under way while it is within ``tolerance`` of its mean. The first cluster stays, others
    if they hold ``support`` values; a step of over ``gap`` ends the list. A histogram is folded, so a place of the margin is
    one entry however many lines start there (equal values always share a cluster).
    """
    counts = edges.where(F.col(x).isNotNull()).groupBy(by, F.col(x).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("n"))
    each = counts.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("x", "n"))).alias("h"))
    clusters = F.expr(f"""aggregate(h, struct(cast(array() as array<struct<s: double, n: bigint>>) as done, 0D as s, 0L as n),
        (c, v) -> if(c.n = 0 or v.x - c.s / c.n <= {tolerance}D, struct(c.done as done, c.s + v.x * v.n as s, c.n + v.n as n),
            struct(array_append(c.done, struct(c.s as s, c.n as n)) as done, v.x * v.n as s, v.n as n)),
        c -> array_append(c.done, struct(c.s as s, c.n as n)))""")
    centres = F.expr(f"transform(filter(clusters, (c, i) -> i = 0 or c.n >= {support}), c -> c.s / c.n)")
    grid = F.expr(f"""aggregate(centres, struct(cast(array() as array<double>) as g, true as open),
        (a, c) -> if(a.open and (size(a.g) = 0 or c - element_at(a.g, -1) <= {gap}D), struct(array_append(a.g, c) as g, true as open), struct(a.g as g, false as open)), a -> slice(a.g, 1, {most}))""")
    return each.select(by, clusters.alias("clusters")).select(by, centres.alias("centres")).select(by, grid.alias("levels"))


def level_of(x: Column, levels: Column) -> Column:
    """The nearest level (the first of equally near ones), from 0; 0 if there is none."""
    near = F.array_min(F.transform(levels, lambda v, i: F.struct(F.abs(x - v).alias("d"), i.alias("i"))))
    return F.coalesce(near["i"], F.lit(0))
