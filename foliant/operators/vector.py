"""Exact cosine search: blocks of vectors meet all queries in one matrix product, each block keeps its best.

A scan reads ids, vectors and the columns asked for; what leaves a block is at most k rows per
query (and group), so the final sort is small whatever the size of the corpus. Null vectors and
vectors of another length are skipped; a zero norm divides by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES_BOUND = 10_000


def query_vectors(df: DataFrame, id_col: str, vec_col: str) -> list[tuple[int, list[float]]]:
    """The stated query set, at most QUERIES_BOUND of them."""
    rows = df.select(id_col, vec_col).limit(QUERIES_BOUND + 1).collect()
    if len(rows) > QUERIES_BOUND:
        raise ValueError(f"more than {QUERIES_BOUND} queries: run them in blocks")
    return sorted((r[0], [float(x) for x in r[1]]) for r in rows if r[1] is not None)


def scored(df: DataFrame, queries: Sequence[tuple[int, list[float]]], id_col: str, vec_col: str, keep: Sequence[str] = (), k: int | None = None, group: str | None = None) -> DataFrame:
    """(query_id, id, score, *keep) for every vector, or for the k best of each block, query and group."""
    names = list(dict.fromkeys([id_col, *keep, *([group] if group else [])]))
    fields = [df.schema[n] for n in names]
    schema = T.StructType([T.StructField("query_id", T.LongType()), *fields, T.StructField("score", T.DoubleType())])
    ids = np.array([q for q, _ in queries], np.int64)
    matrix = np.array([v for _, v in queries], np.float64).reshape(len(queries), -1)
    norms = np.linalg.norm(matrix, axis=1)
    matrix = matrix / np.where(norms == 0, 1, norms)[:, None]
    group_at = names.index(group) if group else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(len(names))
            sizes = vectors.value_lengths().fill_null(0).to_numpy()
            rows = np.flatnonzero(sizes == matrix.shape[1])
            if not rows.size or not ids.size:
                continue
            block = vectors.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows.size, -1)
            length = np.linalg.norm(block, axis=1)
            scores = (block @ matrix.T) / np.where(length == 0, 1, length)[:, None]
            of_group = b.column(group_at).take(pa.array(rows)).to_numpy(zero_copy_only=False) if group else None
            first = b.column(0).take(pa.array(rows)).to_numpy(zero_copy_only=False)
            picked, query = [], []
            for j in range(ids.size):
                order = np.lexsort((first, -scores[:, j])) if k else np.arange(rows.size)
                if k and of_group is not None:
                    seen: dict = {}
                    order = [i for i in order if (seen.__setitem__(of_group[i], seen.get(of_group[i], 0) + 1) or seen[of_group[i]]) <= k]
                elif k:
                    order = order[:k]
                picked.append(np.asarray(order, np.int64))
                query.append(np.full(len(order), j))
            at, q = np.concatenate(picked), np.concatenate(query)
            take = pa.array(rows[at])
            yield pa.RecordBatch.from_arrays([pa.array(ids[q]), *(b.column(i).take(take) for i in range(len(names))), pa.array(scores[at, q])], ["query_id", *names, "score"])

    return df.select(*names, vec_col).mapInArrow(run, schema)


def best_first(id_col: str) -> list[Column]:
    return [F.col("score").desc(), F.col(id_col).asc()]


def top_k(df: DataFrame, queries, id_col: str, vec_col: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    """The k best per query."""
    found = scored(df, queries, id_col, vec_col, keep, k)
    if len(queries) == 1:
        return found.orderBy(*best_first(id_col)).limit(k)
    return top_per(found, ["query_id"], best_first(id_col), k)


def top_k_per_group(df: DataFrame, queries, id_col: str, vec_col: str, group: str, k: int, keep: Sequence[str] = ()) -> DataFrame:
    return top_per(scored(df, queries, id_col, vec_col, keep, k, group), ["query_id", group], best_first(id_col), k)


def top_per(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first n rows of each group; Spark limits groups before it shuffles them."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("__rn") <= n).drop("__rn")


def keyed_union(frames: Sequence[DataFrame], key: str, order: Sequence[Column], first_wins: bool = True) -> DataFrame:
    """Union of sources by key: the first (or last) source that has a key gives its row."""
    tagged = [f.withColumn("__source", F.lit(i if first_wins else -i)) for i, f in enumerate(frames)]
    out = tagged[0]
    for t in tagged[1:]:
        out = out.unionByName(t)
    return top_per(out, [key], [F.col("__source").asc(), *order], 1).drop("__source")


def low_confidence(scores: DataFrame, by: str, least: float = 0.60) -> DataFrame:
    """Whether a query's best score stays under the bar."""
    return scores.groupBy(by).agg(F.max("score").alias("top_score")).withColumn("low_confidence", F.coalesce(F.col("top_score") < least, F.lit(True)))
