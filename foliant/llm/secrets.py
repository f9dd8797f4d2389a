"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Both models are bigram tables over letters, digits and a few signs, trained from labelled
samples: random strings are the values that the fixed patterns find in a bounded sample of
documents, with strings made by hashing so that a small table has some too; ordinary ones
are the sample's other words, as they stand, in capitals and joined by ``_``. A candidate is a run of at least ``LEAST`` characters with a letter, long words too;
its score is the sum of log-likelihood ratios along it, and it is reported as
``random:start:end`` if the mean ratio reaches ``MEAN`` and no fixed pattern covers any of it.

Column functions do all the work; offsets are code points, ends exclusive.

Edge cases: null and empty texts have no spans (base_sha256 is that of the empty string).
Rows repeat as they come. An empty table gives no rows. Runs without a letter (card
numbers) are not candidates.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.native_spans import digest, found

VALUE = r"[A-Za-z0-9+/_.=-]"
ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"']?\x20*+[:=]\x20*+[\"']?" + VALUE + "++"
ACCESS, HEX = r"AKIA[A-Z0-9]{12,}+", r"[0-9a-f]{32,}+"
SIGNS = "A-Za-z0-9+/_=-"
LEAST, MEAN = 16, 1.0
CANDIDATE = rf"(?<![{SIGNS}])(?=[0-9+/_=-]*+[A-Za-z])[{SIGNS}]{{{LEAST},}}+"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-."
SAMPLE = 5_000  # documents whose words train the models, about
MADE = 400  # random strings of each sort that are made


def base_spans(text: Column) -> dict[str, Column]:
    assign = found(text, ASSIGN, text.rlike("(?i)passw|secret|token|api_?key"))
    long_enough = lambda s: F.length(F.regexp_replace(s["value"], r"^(?i:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?", "")) >= 8
    return {
        "assign": F.filter(assign, long_enough),
        "access": found(text, ACCESS, text.contains("AKIA")),
        "hex": found(text, HEX, text.rlike("[0-9a-f]{32}")),
    }


def _pairs(strings: DataFrame) -> DataFrame:
    """Counts of neighbouring characters of the alphabet: (label, pair, n). Equal strings are cut once."""
    at = F.sequence(F.lit(1), F.length("s") - 1)
    each = strings.where(F.length("s") >= 2).groupBy("label", "s").agg(F.count(F.lit(1)).alias("m"))
    return each.select("label", "m", F.explode(F.transform(at, lambda i: F.substring(F.col("s"), i, F.lit(2)))).alias("pair")).groupBy("label", "pair").agg(F.sum("m").alias("n"))


def train(docs: DataFrame, sample: int = SAMPLE) -> list[float]:
    """The log-likelihood ratio of each pair of characters, by 0-based numbers ``first * size + second``; unknown characters come first in each."""
    spark = docs.sparkSession
    n = docs.select("doc_id").agg(F.count(F.lit(1))).first()[0]
    some = docs.where(F.pmod(F.xxhash64(F.lit("secrets"), F.col("doc_id"), F.col("text")), F.lit(max(1, n))) < sample).select(F.coalesce("text", F.lit("")).alias("text"))
    values = F.transform(F.concat(*base_spans(F.col("text")).values()), lambda s: F.regexp_extract(s["value"], f"{VALUE}+$", 0))
    ordinary = F.regexp_extract_all("text", F.lit(r"(?<![^\s])[A-Za-z_-]{4,}(?![^\s])"), F.lit(0))
    words = some.select(F.explode(ordinary).alias("s")).select(F.lit("ordinary").alias("label"), "s")
    labelled = some.select(F.explode(values).alias("s")).select(F.lit("random").alias("label"), "s").unionByName(words).unionByName(words.select("label", F.explode(F.array(F.upper("s"), F.concat("s", F.lit("_"), "s"))).alias("s")))
    key = F.sha2(F.concat(F.lit("made"), F.col("id").cast("string")), 256)
    mixed = F.base64(F.unhex(key))
    kinds = [F.substring(key, 1, 40), F.substring(mixed, 1, 40), F.translate(F.upper(F.substring(mixed, 1, 20)), "+/", "AZ"), F.regexp_replace(mixed, "[^A-Za-z]", "")]
    made = spark.range(MADE).select(F.lit("random").alias("label"), F.explode(F.array(*kinds)).alias("s"))
    counts = {(r["label"], r["pair"]): r["n"] for r in _pairs(labelled.unionByName(made)).where(F.length("pair") == 2).where(F.col("pair").rlike(rf"^[.{SIGNS}]{{2}}$")).collect()}
    size = len(ALPHABET) + 1
    out = [0.0] * (size * size)
    labels = ("random", "ordinary")
    total = {k: sum(n for (label, _), n in counts.items() if label == k) for k in labels}
    single = {(k, b): (sum(counts.get((k, a + b), 0) for a in ALPHABET) + 0.5) / (total[k] + 0.5 * len(ALPHABET)) for k in labels for b in ALPHABET}
    for a in ALPHABET:
        row = {k: sum(counts.get((k, a + b), 0) for b in ALPHABET) for k in labels}
        for b in ALPHABET:  # a pair that was not seen falls back to how frequent its second character is
            p = {k: (counts.get((k, a + b), 0) + single[k, b]) / (row[k] + 1) for k in labels}
            out[(ALPHABET.index(a) + 1) * size + ALPHABET.index(b) + 1] = math.log(p["random"] / p["ordinary"])
    return out


def ratio(token: Column, table: Column) -> Column:
    """Mean log-likelihood ratio per step along a token."""
    size = len(ALPHABET) + 1
    at = lambda i: F.call_function("instr", F.lit(ALPHABET), F.substring(token, i, F.lit(1)))
    total = F.aggregate(F.sequence(F.lit(1), F.length(token) - 1), F.lit(0.0), lambda s, i: s + F.element_at(table, at(i) * size + at(i + 1) + 1))
    return total / (F.length(token) - 1)


def with_spans(rows: DataFrame, text: str, table: list[float], mean: float = MEAN) -> DataFrame:
    """``rows`` with the spans in column ``text`` by kind, array<struct<start, end, value>> each: assign, access, hex, random, and ``n_scored``, the runs that the models scored.

    Step by step, so that no search is run again for each candidate.
    """
    ratios = F.from_json(F.lit(json.dumps(table)), "array<double>")  # a folded literal of fixed size
    base = rows.withColumns(base_spans(F.col(text))).withColumn("random", found(F.col(text), CANDIDATE, F.col(text).rlike(CANDIDATE)))
    free = lambda r: ~F.exists("taken", lambda b: (b["start"] < r["end"]) & (r["start"] < b["end"]))
    scored = base.withColumn("taken", F.concat(*KINDS)).withColumn("random", F.filter("random", free)).drop("taken")
    return scored.withColumns({"n_scored": F.size("random").cast("long"), "random": F.filter("random", lambda r: ratio(r["value"], ratios) >= mean)})


def scan(docs: DataFrame, mean: float = MEAN) -> DataFrame:
    """doc_id, text and the spans by kind, one row per row of ``docs``."""
    return with_spans(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", train(docs), mean)


KINDS, MASK = ("assign", "access", "hex"), "<secret>"


def op7(spark, sf_dir: str) -> DataFrame:
    got = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    by_start = lambda a: F.transform(F.array_sort(a), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind")))
    ranked = lambda k, i: F.transform(F.col(k), lambda s: F.struct(s["start"].alias("start"), F.lit(i).alias("rank"), s["end"].alias("end"), F.lit(k).alias("kind")))
    base = F.concat(*[ranked(k, i) for i, k in enumerate(KINDS)])
    return got.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(digest(by_start(base)), 256).alias("base_sha256"),
        digest(by_start(F.concat(base, ranked("random", len(KINDS))))).alias("spans"),
        F.size("random").cast("long").alias("n_random"), "n_scored",
    )


def without_secrets(docs: DataFrame, mean: float = MEAN) -> DataFrame:
    """The rows of ``docs`` with each secret in the text replaced by ``<secret>``; other columns and texts stay as they are.

    ``n_chars``, if there is one, follows the text. A null text stays null.
    """
    own = F.struct("*").alias("row")  # so that no column of the documents can clash with those made here
    rows = with_spans(docs.select(own, F.coalesce("text", F.lit("")).alias("whole")), "whole", train(docs), mean)
    rows = rows.select("row", "whole", F.array_sort(F.concat(*KINDS, "random")).alias("spans"))
    text = F.col("whole")
    # what spans overlap counts once: each span begins where the ones before have ended
    built = F.aggregate(
        "spans",
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.greatest(F.lit(0), s["start"] - acc["at"])), F.when(s["end"] > acc["at"], F.lit(MASK)).otherwise("")).alias("out"),
        ),
        lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text))),
    )
    rows = rows.select("row", F.when(F.size("spans") > 0, built).otherwise(F.col("row.text")).alias("masked"))
    new = {"text": F.col("masked"), "n_chars": F.when(F.col("masked").eqNullSafe(F.col("row.text")), F.col("row.n_chars") if "n_chars" in docs.columns else None).otherwise(F.length("masked"))}
    return rows.select(*[(new[c].cast(docs.schema[c].dataType) if c in new else F.col("row")[c]).alias(c) for c in docs.columns])
