"""How the sources of a language differ from one another and from the language: terms that lean to a source, and source pairs.

All probabilities are whole numbers of 1e-9 with one added to each count, and the divergence of p from q is
``(p - q)^2 div q``, so that results are exact and the same in any order.

**Terms.** The 200 terms that a group (a source within a language) uses more than its language,
by divergence. A group's terms fall into buckets of one count each, so all have one p; the least probability that the language
gives to any of them bounds their divergence from above. Buckets are evaluated best first, a growing number of terms
a round for all groups at once, until the bounds of those not seen are strictly below the group's
200th value (equal values are ranked by term, so an equal bound is still evaluated).

**Pairs.** The divergence of a source from each other one of its language, over all kept terms. For terms that neither
uses, and for those that one of them uses, it hangs on counts alone, so buckets of counts give the sum; what both use comes from the
postings. Blocks of terms sum for themselves, in tiles of bounded size; no pair of a term's sources becomes a row.

Edge cases: null text, lang and source count as ''. Each row is a document of its own, whatever its id.
Groups without terms are there too; a language that keeps no term has value 0 for all pairs and no
term rows; a language of one source has no pairs; an empty table gives no rows. Further columns are not read. The
number of a language's sources squared is the size of the result and bounds no task: tiles do.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, materialize, utf8

MIN_DOCUMENTS, TOP, SCALE = 3, 200, 1_000_000_000
#: Postings of a block of terms, cells of a tile, terms of the first round and growth of a round.
BLOCK, CELLS, GROWTH = 500_000, 1 << 21, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes outside terms become spaces; bytes of all other characters stay.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
GROUP = ["lang", "source"]


def share(n, m):
    """``SCALE * (n + 1) // m`` for columns or arrays with n + 1 <= m, by long division, so that nothing overflows below 9e15."""
    left, out = n + 1, n * 0
    for _ in range(3):
        left = left * 1000
        out, left = out * 1000 + _whole(left, m), left % m
    return out + 1


def _whole(a, b):
    return F.call_function("div", a, b) if isinstance(a, Column) else a // b


def divergence(p, q):
    return _whole((p - q) * (p - q), q)


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), docs (documents that hold it), added up slice by slice only."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids: dict[bytes, int] = defaultdict(count().__next__)
        groups: dict[tuple[str, str], int] = defaultdict(count().__next__)
        each = [t.translate(TABLE).split() for t in utf8(batch.column(0))]
        of = np.array([groups[x] for x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)], np.int64)
        sizes = np.fromiter(map(len, each), np.int64, len(each))
        term = np.fromiter((i for w in each for i in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
        if not term.size:
            return None
        held, times = np.unique(term * len(each) + np.repeat(np.arange(len(each)), sizes), return_counts=True)
        key, to = np.unique(held // len(each) * len(groups) + of[held % len(each)], return_inverse=True)
        n, docs_ = (np.bincount(to, w, key.size).astype(np.int64) for w in (times, None))
        lang, source = (pa.array([g[k] for g in groups], pa.string()).take(pa.array(key % len(groups))) for k in (0, 1))
        terms = pa.array(list(ids), pa.binary()).take(pa.array(key // len(groups))).cast(pa.string())
        return pa.RecordBatch.from_arrays([lang, source, terms, pa.array(n), pa.array(docs_)], [*GROUP, "term", "n", "docs"])

    return map_arrow(docs.select("text", *GROUP), run, "lang string, source string, term string, n long, docs long")


class Corpus:
    """postings (lang, source, term, n, total; kept terms only) and groups (lang, source, m, lang_m: words of kept terms plus kept terms)."""

    def __init__(self, docs: DataFrame, min_documents: int = MIN_DOCUMENTS):
        docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("text", *GROUP)))
        counts = term_counts(docs).groupBy(*GROUP, "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
        by_term = counts.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.sum("n").alias("total"), F.collect_list(F.struct("source", "n")).alias("held"))
        self.postings = materialize(by_term.where(F.col("docs") >= min_documents).select("lang", "term", "total", F.inline("held").alias("source", "n")))
        own = self.postings.groupBy(*GROUP).agg(F.sum("n").alias("words"), F.count(F.lit(1)).alias("held"))
        langs = self.postings.select("lang", "term").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("v"))
        total = own.groupBy("lang").agg(F.sum("words").alias("lang_words"), F.sum("held").alias("rows")).join(langs, "lang")
        groups = docs.select(*GROUP).distinct().join(own, GROUP, "left").join(total, "lang", "left").na.fill(0, ["words", "lang_words", "v", "held"])
        self.groups = materialize(groups.select(*GROUP, (F.col("words") + F.col("v")).alias("m"), (F.col("lang_words") + F.col("v")).alias("lang_m"), "held"))

    def close(self) -> None:
        discard(self.postings, self.groups)


def leaning_terms(corpus: Corpus, top: int = TOP) -> DataFrame:
    """lang, source, term, value of the ``top`` terms that each group uses more than its language, best first."""
    of_group = Window.partitionBy(*GROUP)
    p, q = share(F.col("n"), F.col("m")), share(F.col("total"), F.col("lang_m"))
    buckets = corpus.postings.groupBy(*GROUP, "n").agg(F.count(F.lit(1)).alias("terms"), F.min("total").alias("total"))
    bounded = buckets.join(corpus.groups, GROUP).where(p > q).withColumn("bound", divergence(p, q))
    in_order = of_group.orderBy(F.desc("bound"), "n").rowsBetween(Window.unboundedPreceding, -1)
    buckets = materialize(bounded.select(*GROUP, "n", "m", "lang_m", "bound", F.coalesce(F.sum("terms").over(in_order), F.lit(0)).alias("before")))
    best, least, seen, upto = None, None, 0, top
    while True:
        unseen = buckets.where(F.col("before") >= seen)
        if least is not None:
            unseen = unseen.join(least, GROUP, "left").where("kth is null or bound >= kth").drop("kth")
        if not unseen.limit(1).count():
            break
        chosen = unseen.where(F.col("before") < upto).drop("bound", "before")
        values = corpus.postings.join(chosen, [*GROUP, "n"]).where(p > q).select(*GROUP, "term", divergence(p, q).alias("value"))
        ranked = (values if best is None else values.unionByName(best)).withColumn("rank", F.row_number().over(of_group.orderBy(F.desc("value"), "term")))
        last, best = best, materialize(ranked.where(F.col("rank") <= top).drop("rank"))
        if last is not None:
            discard(last)
        least = best.groupBy(*GROUP).agg(F.min("value").alias("kth"), F.count(F.lit(1)).alias("found")).where(F.col("found") == top).drop("found")
        seen, upto = upto, upto * GROWTH
    discard(buckets)
    return best if best is not None else corpus.postings.select(*GROUP, "term", F.col("n").alias("value")).limit(0)


def pair_sums(term: np.ndarray, of: np.ndarray, n: np.ndarray, m: np.ndarray):
    """(first source, sums of its tile of sources by all others) over the terms of a block.

    term, of and n are the postings (term and source by number), m the sources' words plus kept terms.
    """
    order = np.argsort(term, kind="stable")
    term, of, p = term[order], of[order], share(n[order], m[of[order]])
    zero, k = share(m * 0, m), m.size
    starts = np.flatnonzero(np.r_[True, term[1:] != term[:-1]])
    sizes = np.diff(np.r_[starts, term.size])
    first, size = np.repeat(starts, sizes), np.repeat(sizes, sizes)
    used = np.unique(np.stack([of, p]), axis=1, return_counts=True)
    (bucket_of, bucket_p), times = used[0], used[1]
    high = max(1, CELLS // k)
    for a in range(0, k, high):
        b = min(k, a + high)
        none = divergence(zero[a:b, None], zero[None, :])
        sums = none * starts.size
        for at in range(0, times.size, high):  # terms that one of the two uses
            o, q, t = bucket_of[at : at + high], bucket_p[at : at + high], times[at : at + high]
            mine = (o >= a) & (o < b)
            np.add.at(sums, o[mine] - a, (divergence(q[mine, None], zero[None, :]) - none[o[mine] - a]) * t[mine, None])
        wide = max(1, CELLS // (b - a))
        for at in range(0, times.size, wide):
            o, q, t = bucket_of[at : at + wide], bucket_p[at : at + wide], times[at : at + wide]
            np.add.at(sums.T, o, ((divergence(zero[a:b, None], q[None, :]) - none[:, o]) * t[None, :]).T)
        own = np.flatnonzero((of >= a) & (of < b))  # terms that both use
        upto = np.cumsum(size[own])
        at = 0
        while at < own.size:
            end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + CELLS, "right")))
            i = np.repeat(own[at:end], size[own[at:end]])
            j = np.arange(i.size) - np.repeat(np.cumsum(size[own[at:end]]) - size[own[at:end]], size[own[at:end]]) + first[i]
            g, h = of[i], of[j]
            both = divergence(p[i], p[j]) - divergence(p[i], zero[h]) - divergence(zero[g], p[j]) + none[g - a, h]
            np.add.at(sums, (g - a, h), both)
            at = end
        yield a, sums


def source_pairs(corpus: Corpus) -> DataFrame:
    """lang, source, item (each other source of the language) and value, over all kept terms."""
    rows = corpus.groups.agg(F.sum("held")).first()[0] or 0
    n_blocks = 1 + rows // BLOCK
    postings = corpus.postings.select("lang", F.pmod(F.xxhash64("term"), F.lit(n_blocks)).alias("block"), "source", "term", "n")
    sizes = corpus.groups.where("m > 0").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"), "source", "m")

    def run(held: pa.Table, groups: pa.Table) -> pa.Table:
        out = []
        if held.num_rows:
            names = groups["source"].combine_chunks()
            of = pc.index_in(held["source"], value_set=names).to_numpy().astype(np.int64)
            term = held["term"].combine_chunks().dictionary_encode().indices.to_numpy().astype(np.int64)
            lang = held["lang"][0].as_py()
            for a, sums in pair_sums(term, of, held["n"].to_numpy(), groups["m"].to_numpy()):
                g, h = np.divmod(np.arange(sums.size), sums.shape[1])
                columns = [pa.array([lang], pa.string()).take(pa.array(np.zeros(g.size, np.int64))), names.take(pa.array(g + a)), names.take(pa.array(h)), pa.array(sums.ravel())]
                out.append(pa.Table.from_arrays(columns, ["lang", "source", "item", "value"]))
        return pa.concat_tables(out) if out else pa.table({k: pa.array([], t) for k, t in zip(("lang", "source", "item", "value"), (*[pa.string()] * 3, pa.int64()), strict=True)})

    sums = postings.groupBy("lang", "block").cogroup(sizes.groupBy("lang", "block")).applyInArrow(run, "lang string, source string, item string, value long")
    sums = sums.where("source <> item").groupBy(*GROUP, "item").agg(F.sum("value").alias("value"))
    own = corpus.groups.select(*GROUP)
    pairs = own.join(own.withColumnRenamed("source", "item"), "lang").where("source <> item")
    return pairs.join(sums, [*GROUP, "item"], "left").na.fill(0, ["value"])


def audit(docs: DataFrame, top: int = TOP, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """lang, source, part ('pair' or 'term'), item, value, rank within group and part."""
    corpus = Corpus(docs, min_documents)
    pairs = source_pairs(corpus).withColumn("part", F.lit("pair"))
    terms = leaning_terms(corpus, top).withColumnRenamed("term", "item").withColumn("part", F.lit("term"))
    rank = F.row_number().over(Window.partitionBy(*GROUP, "part").orderBy(F.desc("value"), "item"))
    out = materialize(pairs.unionByName(terms).select(*GROUP, "part", "item", "value", rank.cast("int").alias("rank")))
    corpus.close()
    return out


def op12(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
tok AS (SELECT r, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), '{UPPER}', '{LOWER}') AS term FROM d),
kept AS (SELECT lang, term, count(*)::HUGEINT AS total FROM tok GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
langs AS (SELECT lang, sum(total)::HUGEINT AS n, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM tok SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
grp AS (SELECT lang, source, coalesce(sum(c.n), 0)::HUGEINT AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN c USING (lang, source) GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000 * (coalesce(c.n, 0) + 1)) // (g.n + l.v) AS p, 1 + (1000000000 * (k.total + 1)) // (l.n + l.v) AS q
  FROM grp g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pairs AS (SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // b.p)::BIGINT AS value
  FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
parts AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(p.value, 0)::BIGINT AS value
  FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source
  UNION ALL SELECT lang, source, 'term', term, (((p - q) * (p - q)) // q)::BIGINT FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM parts)
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 200
"""
