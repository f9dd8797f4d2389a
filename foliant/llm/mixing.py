"""Mixing sources to target weights with the cube method.

A source's target is a number of words; the documents of a source share one expected
number of copies, target / size of the source. The whole part of it is taken from every
document, the rest is an inclusion probability. The flight phase moves the probabilities
through the null space of two constraints (documents and words) until at most two are left
between 0 and 1: each step moves the largest open document of a pool, and the others of the
pool make up for it, so large documents are decided first and small ones stay. Blocks of a
source fly on their own in constant memory, then what blocks leave flies together. The two
that a source is left with land by a draw that keeps both probabilities: documents come out
within one of the plan, words within the sizes of two small documents.

Every block is ordered by (size, hash of the row), and draws come from these hashes and
``seed``, so reruns agree.

Edge cases: a null or empty text has size 0 and is taken like others (0 words). A null
source is a source, last in order. Null ids fly like other ids. Rows that repeat are units
of their own. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, materialize
from foliant.llm.ordering import running_offsets

WEIGHTS, MOST = (5.0, 2.0, 1.0), 3.0
BLOCK = 2048  # documents of a source that fly together
EPS = 1e-9
POOL = 64  # documents that move in a step
MERGE = 256  # blocks whose remainders fly together


def size_of(text):
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """(source, words, n) -> the same with ``target``: shares of all words by weight, none above ``most`` times its own.

    Weights go round by the order of sources (code points, null last). What sources above their limit cannot take is
    shared again; only sums come to the driver.
    """
    ranked = running_offsets(sizes.withColumn("one", F.lit(1).cast("long")), [F.col("source").asc_nulls_last()], "one", "rank").drop("one")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    rows = materialize(ranked.withColumn("weight", weight).drop("rank"))
    per_weight, left = 0.0, None  # words that a weight of one gets
    while True:
        fits = F.col("weight") * F.lit(per_weight) <= F.col("words") * F.lit(most)
        held = F.when(fits, 0.0).otherwise(F.col("words") * F.lit(most))
        r = rows.agg(F.sum("words").alias("words"), F.sum(held).alias("held"), F.sum(F.when(fits, F.col("weight"))).alias("free"), F.count(F.when(fits, 1)).alias("n")).first()
        if not r["n"] or r["n"] == left:
            return rows.withColumn("target", F.least(F.col("weight") * F.lit(per_weight), F.col("words") * F.lit(most))).drop("weight")
        per_weight, left = (r["words"] - r["held"]) / r["free"], r["n"] if per_weight else None


def fly(p: np.ndarray, x: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """The flight phase over units with probabilities ``p`` and sizes ``x``, large ones first; at most two stay fractional."""
    p, x = np.where((p > EPS) & (p < 1 - EPS), p, np.round(p)), x.astype(float)
    waiting = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    waiting = waiting[np.argsort(-x[waiting], kind="stable")].tolist()[::-1]
    pool: list[int] = []
    while True:
        while len(pool) < POOL and waiting:
            pool.append(waiting.pop())
        if len(pool) < 3:
            return p
        q, size = p[pool], x[pool] / x[pool[0]] if x[pool[0]] else x[pool]
        w = q * (1 - q)  # those with more room make up for more
        w[0] = 0.0
        s0, s1, s2 = w.sum(), w @ size, w @ (size * size)
        det, u = s0 * s2 - s1 * s1, np.zeros(len(pool))
        if det > 1e-12 * s0 * s0:
            u = -w * (((s2 - s1 * size[0]) + (s0 * size[0] - s1) * size) / det)
            u[0] = 1.0  # the largest moves, the others make up for it
        elif abs(size[0] * s0 - s1) < 1e-9 * s0:  # all are equally large
            u = -w / s0
            u[0] = 1.0
        else:  # the largest alone differs: the others move among themselves
            u[1], u[2] = 1.0, -1.0
        with np.errstate(divide="ignore", invalid="ignore"):
            room = np.where(np.abs(u) > 1e-12, np.where(u > 0, (1 - q) / u, -q / u), np.inf)
            back = np.where(np.abs(u) > 1e-12, np.where(u > 0, q / u, (q - 1) / u), np.inf)
        up, down = room.min(), back.min()
        q = q + u * (up if rng.random() < down / (up + down) else -down)  # a martingale
        done = (q <= EPS) | (q >= 1 - EPS)
        p[pool] = np.where(done, np.round(q), q)
        pool = [k for k, d in zip(pool, done.tolist(), strict=True) if not d]


def land(p: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Round the last units by one draw: each is taken with its probability, their number is within one of its mean."""
    left = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    ends = np.cumsum(p[left])
    starts, at = ends - p[left], rng.random()
    p = p.copy()
    p[left] = np.floor(ends - at) - np.floor(starts - at)  # systematic sampling
    return np.round(p)


def _flight(last: bool, seed: int):
    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["size", "h", "h2"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        rng = np.random.default_rng(xxhash.xxh64_intdigest(part["h"].to_numpy(np.int64).tobytes(), seed + last))
        p = fly(part["p"].to_numpy(float), part["size"].to_numpy(), rng)
        part["p"] = land(p, rng) if last else p
        return part

    return run


def row_keys(docs: DataFrame) -> list[Column]:
    """128 bits that tell rows apart by doc_id, source and text."""
    own = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("doc_id", "source", "text")]
    return [F.xxhash64(F.lit("mix"), *own).alias("h"), F.xxhash64(F.lit("key"), *own[::-1]).alias("h2")]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST, seed: int = 0) -> DataFrame:
    """doc_id, size, source_size, target, taken, source, copies, h, h2 (``row_keys``): one row per row of ``docs``."""
    units = materialize(docs.select("doc_id", "source", size_of(F.col("text")).alias("size"), *row_keys(docs)))
    sizes = units.groupBy("source").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
    copies = F.when(F.col("words") > 0, F.col("target") / F.col("words")).otherwise(0.0)
    plan = materialize(targets(sizes, weights, most).select(F.col("source").alias("of"), F.col("words").alias("source_size"), "target", copies.alias("share"), F.ceil(F.col("n") / BLOCK).alias("blocks")))
    whole = F.floor(F.col("share") + EPS)
    ready = units.join(plan, F.col("source").eqNullSafe(F.col("of"))).select(
        "doc_id", "size", "source", "source_size", "target", "h", "h2", whole.cast("long").alias("base"),
        F.greatest(F.lit(0.0), F.col("share") - whole).alias("p"), F.pmod(F.xxhash64("h", "h2"), F.col("blocks")).alias("block"),
    )
    flown = materialize(ready.groupBy("source", "block").applyInPandas(_flight(False, seed), ready.schema))
    discard(units, plan)
    open_ = (F.col("p") > EPS) & (F.col("p") < 1 - EPS)
    out = flown.where(~open_).unionByName(_land_all(flown.where(open_), seed))
    taken = F.col("base") + F.round("p").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (taken * F.col("size")).alias("taken"), "source", taken.alias("copies"), "h", "h2")


def _land_all(left: DataFrame, seed: int) -> DataFrame:
    """Blocks leave two documents at most: they fly in groups of MERGE blocks' remainders until one group is left."""
    groups = left.agg(F.max("block")).first()[0]
    while groups is not None and groups >= MERGE:
        left = left.withColumn("block", F.floor(F.col("block") / MERGE).cast("long"))
        left = materialize(left.groupBy("source", "block").applyInPandas(_flight(False, seed), left.schema))
        groups = groups // MERGE
    return left.groupBy("source").applyInPandas(_flight(True, seed), left.schema)


def op3(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("copies", "h", "h2")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the mix takes, every column as it was, and ``copies``: how often (it replaces a column of that name).

    Rows that are equal in doc_id, source and text come once, with the copies of all of them. Rows taken 0 times stay out.
    """
    mixed = mix(docs)
    copies = materialize(mixed.groupBy("h", "h2").agg(F.sum("copies").alias("copies"), F.count(F.lit(1)).alias("n")).where("copies > 0").withColumnsRenamed({"h": "__h", "h2": "__h2", "n": "__n", "copies": "__copies"}))
    h, h2 = row_keys(docs)
    marked = docs.drop("copies").withColumns({"__h": h, "__h2": h2}).join(copies, ["__h", "__h2"])
    if copies.where("__n > 1").limit(1).count():
        marked = marked.where("__n = 1").unionByName(marked.where("__n > 1").dropDuplicates(["__h", "__h2"]))
    return marked.withColumn("copies", F.col("__copies")).drop("__h", "__h2", "__n", "__copies")
