"""Second looks into an index bound to the test tables: embeddings are chunks, their labels the standards, documents their texts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import text
from foliant.operators import retrieval, vector
from foliant.plans.bindings import COS, ROUNDED, _q, _score, query

#: Chunks by number: applications, references, tables, and prose for the rest; standards of over five have less prose.
CHUNKS_SQL = f"""chunks AS (SELECT e.vec_id, 'S' || e.label AS standard, CASE WHEN e.vec_id % 3 = 0 THEN 'application' WHEN e.vec_id % 7 = 0 THEN 'reference' WHEN e.vec_id % 2 = 0 OR e.label > 5 AND e.vec_id % 5 > 0 THEN 'table' ELSE 'text' END AS kind,
  d.text, {COS} AS raw, {ROUNDED} AS score, row_number() OVER (PARTITION BY e.label ORDER BY e.vec_id) - 1 AS ordinal
  FROM embeddings e CROSS JOIN (SELECT embedding FROM embeddings WHERE vec_id = 0) q LEFT JOIN documents d ON d.doc_id = e.vec_id)"""
PROSE_SQL = "(kind <> 'table' AND NOT (coalesce(text, '') = '' OR length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) > 0.22 OR length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) < 0.45))"


def _chunks(read):
    e, i = read("embeddings"), F.col("vec_id")
    kind = F.when(i % 3 == 0, "application").when(i % 7 == 0, "reference").when((i % 2 == 0) | ((F.col("label") > 5) & (i % 5 > 0)), "table").otherwise("text")
    said = read("documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.select("vec_id", "embedding", F.concat(F.lit("S"), F.col("label").cast("string")).alias("standard"), kind.alias("kind")).join(said, "vec_id", "left")


@query(f"""WITH {CHUNKS_SQL}, pool AS (SELECT * FROM chunks ORDER BY raw DESC, vec_id LIMIT 50),
first AS (SELECT standard, max(raw) AS best, min(vec_id) AS id FROM (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY raw DESC, vec_id) AS rn FROM pool WHERE kind = 'application') WHERE rn = 1 GROUP BY standard),
target AS (SELECT standard FROM first WHERE standard NOT IN (SELECT standard FROM pool WHERE kind NOT IN ('application', 'reference') AND {PROSE_SQL}) ORDER BY best DESC, id LIMIT 10),
more AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY standard ORDER BY raw DESC, vec_id) AS rn FROM chunks WHERE standard IN (FROM target)) WHERE rn <= 15 AND kind NOT IN ('application', 'reference') AND coalesce(text, '') <> '')
SELECT vec_id, standard, kind, score, 'pool' AS look FROM pool WHERE kind NOT IN ('application', 'reference')
UNION ALL SELECT vec_id, standard, kind, score, 'backfill' FROM more WHERE vec_id NOT IN (SELECT vec_id FROM pool)""")
def excerpt_backfill(read):
    """Chunks behind the best applications: those of the pool, and a second look for standards that it leaves without prose."""
    chunks, q = _chunks(read), _q(read, [0])
    pool = vector.top_k(chunks, q, "vec_id", "embedding", 50, ["standard", "kind", "text"])
    hits = pool.where(~F.col("kind").isin("application", "reference"))
    enough = (F.col("kind") != "table") & ~text.table_like(F.col("text"))
    targets = retrieval.lacking(pool.where("kind = 'application'"), "standard", vector.best_first("vec_id"), hits, "standard", enough)
    wanted = ~F.col("kind").isin("application", "reference") & (F.coalesce("text", F.lit("")) != "")
    more = retrieval.backfill(chunks, targets, q, "vec_id", "embedding", "standard", wanted, ["kind", "text"])
    both = retrieval.backfilled(hits.withColumn("look", F.lit("pool")), more.withColumn("look", F.lit("backfill")), "vec_id")
    return both.select("vec_id", "standard", "kind", _score(), "look")


WINDOWS_SQL = """counts AS (SELECT standard, count(*) AS n, count(*) FILTER (kind = 'reference') AS refs FROM chunks GROUP BY standard),
asked AS (SELECT *, least(n, 2 * refs + 40) AS need FROM counts WHERE refs > 0 ORDER BY refs DESC, standard LIMIT 8),
spent AS (SELECT *, ceil(need / 20)::BIGINT AS cost, coalesce(sum(ceil(need / 20)) OVER (ORDER BY refs DESC, standard ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM asked),
served AS (SELECT standard, n, need, least(cost, 20 - before) AS batches FROM spent WHERE before < 20)"""


@query(f"""WITH {CHUNKS_SQL}, {WINDOWS_SQL}
SELECT vec_id, c.standard, score FROM chunks c JOIN served s USING (standard) WHERE kind = 'reference' AND ordinal >= greatest(n - need, n - 20 * batches) ORDER BY raw DESC, vec_id LIMIT 30""")
def reference_probe(read):
    """References from the tails of the documents that have most of them, within a budget of twenty batches for all."""
    ordinal = F.row_number().over(Window.partitionBy("standard").orderBy("vec_id")) - 1
    chunks = _chunks(read).withColumn("ordinal", ordinal)
    counts = chunks.groupBy("standard").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("kind") == "reference").alias("refs"))
    windows = retrieval.tail_windows(counts, "standard", "n", "refs", budget=20)
    found = retrieval.tail_probe(chunks, windows, _q(read, [0]), "vec_id", "embedding", "standard", "ordinal", F.col("kind") == "reference", ["standard"])
    return found.select("vec_id", "standard", _score())
