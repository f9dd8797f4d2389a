"""Personal data: fixed patterns, and contextual extraction bootstrapped from them.

What the fixed patterns find are the seeds. A candidate is any other token with a digit
(such as account or ticket numbers); tokens of at most ``SHORT`` characters are seeds of the
alternative, ``none``. Patterns are lexical: the shape of the token (digits, runs of letters,
signs), and the one or two words to its left, to its right, or on both sides, with the token's
class (letters or numbers only). Patterns and instances (lower-cased values) make a bipartite
graph. In each round a pattern's confidence in a kind is that kind's share of its instances'
weight (seeds weigh 1, instances found before their confidence, unknown ones ``UNKNOWN``), so
each round's finds can raise patterns that the seeds alone did not. Patterns are trusted from
``SUPPORT`` instances and confidence ``TRUST`` on; an instance's confidence in a kind is that
at least one trusted pattern is right, times the odds that none of another kind is.
Candidates that reach ``ACCEPT`` for a kind, none excepted, are reported with it.

Column functions do all the work; offsets are code points, ends exclusive. Edges are counted
before they are shuffled, so a frequent word costs one row per instance.

Edge cases: null and empty texts have no spans (base_sha256 is that of the empty string).
Rows repeat as they come, with equal spans. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, materialize
from foliant.llm.native_spans import digest, found, tagged

KINDS, NONE = ("email", "ip", "card", "phone"), "none"
LOCAL = "A-Za-z0-9._%+-"
#: The lookbehinds let a search start only where a run of characters does (or the last match ended): equal matches in linear time.
EMAIL = rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
TOKEN = r"(?<!\S)(?=[^\s0-9]*+[0-9])\S++"
ROUNDS, SUPPORT, TRUST, ACCEPT, UNKNOWN, SHORT = 3, 5, 0.8, 0.8, 0.02, 4
NEAR = 48  # characters in which a neighbouring word is looked for


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    n = F.length(digits)
    total = F.aggregate(
        F.sequence(F.lit(1), n),
        F.lit(0),
        lambda s, i: s + _doubled(F.substring(digits, n - i + 1, F.lit(1)).cast("int"), i % 2 == 0),
    )
    return total % 10 == 0


def _doubled(d: Column, twice: Column) -> Column:
    return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)


def base_spans(text: Column) -> dict[str, Column]:
    part_ok = lambda p: F.regexp_replace(p, "^0+", "").rlike("^(?:|[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
    between = lambda s, a, b: F.length(_digits(s["value"])).between(a, b)
    return {
        "email": found(text, EMAIL, text.contains("@")),
        "ip": F.filter(found(text, IP, text.rlike(r"[0-9]\.[0-9]")), lambda s: F.forall(F.split(s["value"], r"\."), part_ok)),
        "card": F.filter(found(text, CARD, text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")), lambda s: F.when(between(s, 13, 19), _luhn(_digits(s["value"]))).otherwise(False)),
        "phone": F.filter(found(text, PHONE, text.rlike(r"\+[0-9]")), lambda s: between(s, 9, 15)),
    }


def _context(text: Column, start: Column, end: Column) -> list[Column]:
    """Up to two words on either side, lower-cased, joined by a space."""
    words = lambda x, p, a, b: F.lower(F.concat_ws(" ", F.nullif(F.regexp_extract(x, p, a), F.lit("")), F.nullif(F.regexp_extract(x, p, b), F.lit(""))))
    word = r"([^\s\p{Punct}]+)"
    left = words(F.substring(text, F.greatest(F.lit(1), start - NEAR + 1), F.least(start, F.lit(NEAR))), rf"(?:{word}[\s\p{{Punct}}]+)?{word}[\s\p{{Punct}}]*$", 1, 2)
    right = words(F.substring(text, end + 1, F.lit(NEAR)), rf"^[\s\p{{Punct}}]*{word}(?:[\s\p{{Punct}}]+{word})?", 1, 2)
    return [left.alias("left"), right.alias("right")]


def occurrences(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), base spans by kind, and ``seen``: seeds and candidates with their contexts."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("doc_id", F.xxhash64("text").alias("h"), "text", *[v.alias(k) for k, v in base_spans(F.col("text")).items()], found(F.col("text"), TOKEN, F.col("text").rlike("[0-9]")).alias("tokens"))
    base = F.concat(*KINDS)
    outside = F.filter("tokens", lambda t: ~F.exists(base, lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"])))
    trimmed = F.transform(outside, lambda t: F.struct(
        (t["start"] + F.length(F.regexp_extract(t["value"], r"^(\p{Punct}*)", 1))).alias("start"),
        (t["end"] - F.length(F.regexp_extract(t["value"], r"(\p{Punct}*)$", 1))).alias("end"),
        F.regexp_replace(t["value"], r"^\p{Punct}+|\p{Punct}+$", "").alias("value"),
    ))
    kind_of = lambda s, kind: F.lit(kind) if kind else F.when(F.length(s["value"]) <= SHORT, F.lit(NONE))
    place = lambda spans, kind: F.transform(spans, lambda s: F.struct(kind_of(s, kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), F.lower(s["value"]).alias("value"), *_context(F.col("text"), s["start"], s["end"])))
    return rows.select("doc_id", "h", *KINDS, F.concat(*[place(F.col(k), k) for k in KINDS], place(trimmed, None)).alias("seen"))


def _patterns() -> Column:
    """The patterns of an occurrence (value, left, right)."""
    left, right = F.col("left"), F.col("right")
    shape = F.regexp_replace(F.regexp_replace("value", r"\p{L}+", "a"), "[0-9]", "9")
    sort = F.when(F.col("value").rlike(r"\p{L}"), "a ").otherwise("9 ")
    near = F.array(*[F.when(w != "", F.concat(F.lit(name), sort, w)) for name, w in (("L:", F.substring_index(left, " ", -1)), ("LL:", F.when(left.contains(" "), left)), ("R:", F.substring_index(right, " ", 1)), ("RR:", F.when(right.contains(" "), right)))])
    both = F.when((left != "") & (right != ""), F.concat(F.lit("B:"), sort, F.substring_index(left, " ", -1), F.lit("|"), F.substring_index(right, " ", 1)))
    return F.array_compact(F.concat(F.array(F.concat(F.lit("S:"), shape)), near, F.array(both)))


def bootstrap(seen: DataFrame, rounds: int = ROUNDS, support: int = SUPPORT, trust: float = TRUST, accept: float = ACCEPT) -> DataFrame:
    """Rows (kind or null, value, left, right) -> (value, kind, confidence) of candidates that reach ``accept``.

    A value that is a seed anywhere is a seed everywhere; of several kinds the smallest name counts.
    """
    edges = materialize(seen.select("kind", "value", F.explode(_patterns()).alias("pattern")).groupBy("pattern", "value").agg(F.min("kind").alias("seed")))
    seeds = materialize(edges.where("seed is not null").groupBy("value").agg(F.min("seed").alias("kind")).withColumn("confidence", F.lit(1.0)))
    total = materialize(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    open_ = materialize(edges.join(seeds, "value", "left_anti").select("pattern", "value"))
    drawn = None
    for _ in range(rounds):
        known = seeds if drawn is None else seeds.unionByName(drawn)
        mass = edges.join(known, "value").groupBy("pattern", "kind").agg(F.sum("confidence").alias("mass"))
        sums = mass.groupBy("pattern").agg(F.sum("mass").alias("all"))
        share = F.col("mass") / (F.col("all") + UNKNOWN * F.greatest(F.col("n") - F.col("all"), F.lit(0.0)))
        good = materialize(mass.where(F.col("mass") >= support).join(sums, "pattern").join(total, "pattern").select("pattern", "kind", share.alias("p")).where(F.col("p") >= trust))
        wrong = F.log1p(-F.least(F.col("p"), F.lit(0.999)))
        votes = open_.join(good, "pattern").groupBy("value", "kind").agg(F.sum(wrong).alias("wrong"))
        against = votes.groupBy("value").agg(F.sum("wrong").alias("every"))
        score = (1 - F.exp("wrong")) * F.exp(F.col("every") - F.col("wrong"))
        last, drawn = drawn, materialize(votes.join(against, "value").select("value", "kind", score.alias("confidence")).where(F.col("confidence") >= accept))
        discard(good)
        if last is not None:
            discard(last)
    discard(edges, seeds, total, open_)
    return drawn.where(F.col("kind") != NONE)


def find(docs: DataFrame) -> DataFrame:
    """doc_id, base spans by kind (array<struct<start, end, value>>), and ``more``: array<struct<rank, start, end, kind>>."""
    rows = materialize(occurrences(docs))
    seen = rows.select("doc_id", "h", F.explode("seen").alias("s")).select("doc_id", "h", "s.*")
    new = bootstrap(seen.select("kind", "value", "left", "right"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    spans = seen.where("kind is null").drop("kind").join(new.select("value", "kind"), "value").select("doc_id", "h", F.struct(rank.cast("int").alias("rank"), "start", "end", "kind").alias("span"))
    more = spans.groupBy(F.col("doc_id").alias("of"), F.col("h").alias("of_h")).agg(F.collect_set("span").alias("more"))
    rows = rows.drop("seen")
    got = rows.join(more, rows["doc_id"].eqNullSafe(more["of"]) & (rows["h"] == more["of_h"]), "left").drop("of", "of_h", "h")
    return got.withColumn("more", F.coalesce("more", F.expr("cast(array() as array<struct<rank:int,start:int,end:int,kind:string>>)")))


def op6(spark, sf_dir: str) -> DataFrame:
    got = find(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    ranked = [tagged(F.col(k), k, i) for i, k in enumerate(KINDS, 1)]
    return got.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(F.concat(*ranked)), 256).alias("base_sha256"),
        digest(F.array_sort(F.concat(*ranked, "more"))).alias("spans"),
    )
