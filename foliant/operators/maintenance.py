"""Lists, lookups and upkeep of document and project tables."""

from __future__ import annotations

import hashlib
import hmac
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions import ids
from foliant.functions.text import js_round
from foliant.operators.vector import top_per

LIST_CAP, SEEN_SAMPLE = 200, 5


def listed(df: DataFrame, equal: dict, order: Sequence[Column], columns: Sequence[str], cap: int = LIST_CAP) -> DataFrame:
    """The rows that meet all given equalities, in order, as far as a page goes."""
    for c, v in equal.items():
        if v is not None:
            df = df.where(F.col(c) == v)
    return df.select(*columns).orderBy(*order).limit(cap)


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    return df.where(F.col(key) == F.lit(value)).limit(1)


def synced(df: DataFrame, metadata: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """Columns from external metadata; what it does not know stays."""
    side = metadata.select(F.col(key).alias("__k"), *[F.col(c).alias(f"__{c}") for c in columns])
    return df.join(side, F.col(key) == F.col("__k"), "left").withColumns({c: F.coalesce(f"__{c}", c) for c in columns}).drop("__k", *[f"__{c}" for c in columns])


def superseding(deprecated: DataFrame, standards: DataFrame) -> DataFrame:
    """(id) with ``superseded_by``: the newest active edition of the family (year, then id)."""
    live = standards.where("status = 'Active'").select(ids.family(F.col("id")).alias("__f"), F.col("id").alias("superseded_by"), "year")
    best = top_per(live, ["__f"], [F.col("year").desc_nulls_last(), F.col("superseded_by").desc()], 1).drop("year")
    return deprecated.withColumn("__g", ids.family(F.col("id"))).join(best, F.col("__g") == F.col("__f"), "left").drop("__g", "__f")


def titled(df: DataFrame, curated: DataFrame, key: str, title: str) -> DataFrame:
    """A stored title counts unless it is the bare id; else the curated one, of the edition or of its base."""
    exact = curated.select(F.upper("id").alias("__a"), F.col("title").alias("__x"))
    base = curated.select(F.upper("id").alias("__b"), F.col("title").alias("__y"))
    both = df.join(exact, F.upper(key) == F.col("__a"), "left").join(base, ids.base_id(F.col(key)) == F.col("__b"), "left")
    own = F.when((F.col(title) != F.col(key)) & (F.col(title) != ""), F.col(title))
    return both.withColumn(title, F.coalesce(own, "__x", "__y")).drop("__a", "__b", "__x", "__y")


def seen_per_owner(rows: DataFrame, owner: str, key: str) -> DataFrame:
    """Per owner the number of rows and the five smallest keys: no list longer than that leaves a task."""
    w = Window.partitionBy(owner).orderBy(key)
    first = rows.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= SEEN_SAMPLE).groupBy(owner).agg(F.array_sort(F.collect_list(key)).alias("sample"))
    return rows.groupBy(owner).agg(F.count(F.lit(1)).alias("seen")).join(first, owner)


def with_snapshot(requests: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Requested keys with the whole row as JSON, as it is now."""
    return requests.join(rows.select(F.col(key).alias("__k"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("snapshot")), F.col(key) == F.col("__k")).drop("__k")


def touched(projects: DataFrame, changed: DataFrame, key: str, changed_key: str, stamp: str, now: Column) -> DataFrame:
    """A new change stamp for projects to which rows were added or from which some were taken."""
    hit = changed.select(F.col(changed_key).alias("__k")).distinct()
    return projects.join(hit, F.col(key) == F.col("__k"), "left").withColumn(stamp, F.when(F.col("__k").isNotNull(), now).otherwise(F.col(stamp))).drop("__k")


def rename_plan(files: DataFrame) -> DataFrame:
    """(path, id, has_errata, size) -> path, target, action: per id the copy with errata, then the larger one, takes the canonical name."""
    w = Window.partitionBy("id").orderBy(F.col("has_errata").desc(), F.col("size").desc(), F.col("path"))
    target = F.concat("id", F.lit(".pdf"))
    name = F.regexp_replace("path", "^.*/", "")
    action = F.when(F.row_number().over(w) > 1, "conflict").when(name == target, "keep").otherwise("rename")
    return files.select("path", target.alias("target"), action.alias("action"))


def compared_extraction(found: DataFrame, golden: DataFrame, name: str, value: str, within: float = 1.0) -> DataFrame:
    """Extracted against golden values by the name in lower case with single spaces: match, differs or missing."""
    norm = lambda c: F.trim(F.regexp_replace(F.lower(F.col(c)), r"\s+", " "))
    side = golden.groupBy(norm(name).alias("__k")).agg(F.max(value).alias("__v"))
    out = found.withColumn("__n", norm(name)).join(side, F.col("__n") == F.col("__k"), "left")
    state = F.when(F.col("__k").isNull(), "missing").when(F.abs(F.col(value) - F.col("__v")) <= within, "match").otherwise("differs")
    return out.withColumn("state", state).drop("__n", "__k", "__v")


def compared_values(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Values of two editions side by side with the change in percent."""
    x, y = a.select(F.col(key).alias("__a"), F.col(value).alias("old")), b.select(F.col(key).alias("__b"), F.col(value).alias("new"))
    both = x.join(y, F.col("__a") == F.col("__b"), "full")
    return both.select(F.coalesce("__a", "__b").alias(key), "old", "new", js_round(F.try_divide((F.col("new") - F.col("old")) * 100.0, F.col("old")), 1).alias("percent"))


def chunk_ids(chunks: DataFrame, owner: str, order: Sequence[Column]) -> DataFrame:
    """Ordinals per document and ids ``<owner>-chunk-<n>``."""
    n = F.row_number().over(Window.partitionBy(owner).orderBy(*order)) - 1
    return chunks.withColumn("ordinal", n.cast("long")).withColumn("chunk_id", F.concat(F.col(owner).cast("string"), F.lit("-chunk-"), F.col("ordinal").cast("string")))


def longest_word(x: Column) -> Column:
    """The longest word, the first of equals."""
    words = F.filter(F.split(x, r"\s+"), lambda w: w != "")
    return F.aggregate(words, F.lit(""), lambda best, w: F.when(F.length(w) > F.length(best), w).otherwise(best))


def fuzzy(df: DataFrame, column: str, query: str, most: int = 2) -> DataFrame:
    """Rows with a word within ``most`` edits of the query."""
    words = F.filter(F.split(F.lower(F.col(column)), r"\s+"), lambda w: w != "")
    distance = F.array_min(F.transform(words, lambda w: F.levenshtein(w, F.lit(query.lower()))))
    return df.withColumn("edits", distance).where(F.col("edits") <= most)


def in_units(df: DataFrame, planes: Sequence[str], units: str) -> DataFrame:
    """Nested planes without the fields of the other unit."""
    drop = {"lux": ["fc", "height_ft"], "fc": ["lux", "height_m"]}.get(units, [])
    return df.withColumns({p: F.col(p).dropFields(*[d for d in drop if d in df.schema[p].dataType.names]) for p in planes if drop})


def token_ok(header: str | None, secret: str | None, production: bool) -> bool:
    """Whether a bearer token is the secret, compared by digests; without a secret only development is open."""
    if not secret:
        return not production
    given = (header or "").removeprefix("Bearer ").strip()
    digest = lambda s: hashlib.sha256(s.encode()).digest()
    return hmac.compare_digest(digest(given), digest(secret))
