"""Changes as pure functions from tables to tables: upserts, deletes, guards and differences (copy on write)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OVERWRITE, KEEP, NEVER = "overwrite", "coalesce", "never"


def upsert(current: DataFrame, delta: DataFrame, key: str, policy: dict[str, str] | None = None, empty_is_null: bool = False) -> DataFrame:
    """The next state of ``current``: per column the delta overwrites, fills only by non-null values, or never touches existing rows."""
    policy = policy or {}
    new = delta.select(F.col(key).alias("__key"), F.lit(True).alias("__new"), *[(F.nullif(F.col(c), F.lit("")) if empty_is_null and t == "string" else F.col(c)).alias(f"__{c}") for c, t in delta.dtypes if c != key])
    both = current.withColumn("__old", F.lit(True)).join(new, F.col(key) == F.col("__key"), "full")
    out = [F.coalesce(key, "__key").alias(key)]
    for c in current.columns:
        if c == key:
            continue
        if c not in delta.columns:
            out.append(F.col(c))
            continue
        how = policy.get(c, OVERWRITE)
        changed = {OVERWRITE: F.col(f"__{c}"), KEEP: F.coalesce(f"__{c}", c), NEVER: F.col(c)}[how]
        out.append(F.when(F.col("__new").isNull(), F.col(c)).when(F.col("__old").isNull(), F.col(f"__{c}")).otherwise(changed).alias(c))
    return both.select(*out)


def patch(rows: DataFrame, where: Column, fields: dict[str, object], allowed: Sequence[str]) -> DataFrame:
    """Sets the allowed ones among ``fields`` where the condition holds; other keys are ignored. None allowed: ValueError."""
    kept = {k: v for k, v in fields.items() if k in allowed}
    if not kept:
        raise ValueError("No valid fields to update")
    return rows.withColumns({k: F.when(where, F.lit(v).cast(rows.schema[k].dataType)).otherwise(F.col(k)) for k, v in kept.items()})


def delete_tail(rows: DataFrame, limits: DataFrame, key: str, limit_key: str, ordinal: str, count: str) -> DataFrame:
    """Keeps ordinals below each owner's new count; owners without one keep all."""
    side = limits.select(F.col(limit_key).alias("__k"), F.col(count).alias("__n"))
    return rows.join(side, F.col(key) == F.col("__k"), "left").where(F.col("__n").isNull() | (F.col(ordinal) < F.col("__n"))).drop("__k", "__n")


def cascade_delete(parents: DataFrame, children: DataFrame, gone: Column, key: str, child_key: str) -> tuple[DataFrame, DataFrame]:
    """Parents and children after the parents for which ``gone`` holds were deleted."""
    dead = parents.where(gone).select(F.col(key).alias("__k"))
    return parents.where(~F.coalesce(gone, F.lit(False))), children.join(dead, F.col(child_key) == F.col("__k"), "left_anti")


def delete_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key), key, "left_anti")


def split_requests(requests: DataFrame, known: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Requested keys with ``outcome``: rejected (unknown), skipped (present already) or inserted."""
    k = known.select(F.col(key).alias("__known")).distinct()
    p = present.select(F.col(key).alias("__present")).distinct()
    out = requests.join(k, F.col(key) == F.col("__known"), "left").join(p, F.col(key) == F.col("__present"), "left")
    return out.withColumn("outcome", F.when(F.col("__known").isNull(), "rejected").when(F.col("__present").isNotNull(), "skipped").otherwise("inserted")).drop("__known", "__present")


def difference(old: DataFrame, new: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Keys added, removed or revised between two editions, with the columns that changed."""
    a = old.select(F.col(key).alias("__a"), *[F.col(c).alias(f"__old_{c}") for c in columns])
    b = new.select(F.col(key).alias("__b"), *[F.col(c).alias(f"__new_{c}") for c in columns])
    both = a.join(b, F.col("__a") == F.col("__b"), "full")
    changed = F.filter(F.array(*[F.when(~F.col(f"__old_{c}").eqNullSafe(F.col(f"__new_{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    kind = F.when(F.col("__a").isNull(), "added").when(F.col("__b").isNull(), "removed").when(F.size(changed) > 0, "revised")
    return both.select(F.coalesce("__a", "__b").alias(key), kind.alias("change"), F.when(kind == "revised", F.array_join(changed, ",")).otherwise("").alias("changed")).where("change is not null")


def admit(files: DataFrame) -> DataFrame:
    """(path, id, deprecated, ord) -> the files to ingest: current ones first, no deprecated copy of a current or earlier deprecated id."""
    first = files.withColumn("__rn", F.row_number().over(Window.partitionBy("id").orderBy("deprecated", "ord")))
    decision = F.when(~F.col("deprecated"), "ingest").when(F.col("__rn") == 1, "ingest").otherwise("skip")
    return first.withColumn("decision", decision).drop("__rn")


def preferred(files: DataFrame, by: str, order: Sequence[Column]) -> DataFrame:
    return files.withColumn("__rn", F.row_number().over(Window.partitionBy(by).orderBy(*order))).where("__rn = 1").drop("__rn")


def guard_violations(requests: DataFrame) -> DataFrame:
    """(standard_id, status, current_status, n_applications, n_chunks, n_vectors, n_empty) -> those that an ingest refuses, with code and reason."""
    reason = (
        F.when((F.col("status") == "deprecated") & (F.col("n_applications") > 0), F.struct(F.lit(400).alias("code"), F.lit("deprecated documents carry no applications").alias("reason")))
        .when((F.col("status") == "deprecated") & (F.col("current_status") == "Active"), F.struct(F.lit(409).alias("code"), F.lit("an active edition has this id").alias("reason")))
        .when(F.col("n_empty") > 0, F.struct(F.lit(400).alias("code"), F.lit("empty chunk").alias("reason")))
        .when(F.col("n_vectors") != F.col("n_chunks"), F.struct(F.lit(500).alias("code"), F.lit("embedding count differs").alias("reason")))
    )
    return requests.withColumn("v", reason).where("v is not null").select(*requests.columns, "v.code", "v.reason")
