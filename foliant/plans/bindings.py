"""Operators bound to the test tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.functions import ids, quantities, text
from foliant.functions.vocabulary import ARTICLE, COMPARISON_PATTERNS, QUESTION_PATTERNS, REFERENCE_PATTERNS, SYNONYMS, TRAILING_PATTERNS
from foliant.operators import changes, chunking, criteria, extraction, layout, maintenance, references, relational, reports, scans, tables, vector

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet"))
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"
ROUNDED = f"floor({COS} * 1000 + 0.5) / 1000"


def _score():
    return text.js_round(F.col("score"), 3).alias("score")


def _q(read, ids_: list[int]):
    return vector.query_vectors(read("embeddings").where(F.col("vec_id").isin(ids_)), "vec_id", "embedding")


# ---------------------------------------------------------------- vectors


@query(f"SELECT e.vec_id, e.label, {ROUNDED} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {COS} DESC, e.vec_id LIMIT 50")
def vector_topk(read):
    return vector.top_k(read("embeddings"), _q(read, [0]), "vec_id", "embedding", 50, ["label"]).select("vec_id", "label", _score())


@query(f"SELECT e.vec_id, e.label, {ROUNDED} AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE e.label = 3 ORDER BY {COS} DESC, e.vec_id LIMIT 50")
def vector_topk_filtered(read):
    return vector.top_k(read("embeddings").where("label = 3"), _q(read, [0]), "vec_id", "embedding", 50, ["label"]).select("vec_id", "label", _score())


@query(f"""SELECT vec_id, label, score, rn FROM (SELECT e.vec_id, e.label, {ROUNDED} AS score,
  row_number() OVER (PARTITION BY e.label ORDER BY {COS} DESC, e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rn <= 15""")
def vector_topk_per_label(read):
    best = vector.top_k_per_group(read("embeddings"), _q(read, [0]), "vec_id", "embedding", "label", 15)
    rn = F.row_number().over(Window.partitionBy("label").orderBy(*vector.best_first("vec_id"))).cast("long")
    return best.select("vec_id", "label", _score(), rn.alias("rn"))


@query(f"""SELECT vec_id, label, score, row_number() OVER (ORDER BY raw DESC, vec_id) AS place FROM (SELECT e.vec_id, e.label, {ROUNDED} AS score, {COS} AS raw,
  row_number() OVER (PARTITION BY e.label ORDER BY {COS} DESC, e.vec_id) AS rn FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE rn = 1""")
def vector_best_per_label(read):
    best = vector.top_k_per_group(read("embeddings"), _q(read, [0]), "vec_id", "embedding", "label", 1)
    place = F.row_number().over(Window.orderBy(*vector.best_first("vec_id"))).cast("long")
    return best.select("vec_id", "label", _score(), place.alias("place"))


@query(f"""WITH hits AS (SELECT q.vec_id AS query_id, e.vec_id, {ROUNDED} AS score,
  row_number() OVER (PARTITION BY q.vec_id ORDER BY {COS} DESC, e.vec_id) AS rn FROM embeddings e JOIN embeddings q ON q.vec_id < 5 WHERE e.vec_id >= 5)
SELECT query_id, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY query_id) AS first FROM hits WHERE rn <= 5) WHERE first = 1""")
def multi_query_vector(read):
    hits = vector.top_k(read("embeddings").where("vec_id >= 5"), _q(read, [0, 1, 2, 3, 4]), "vec_id", "embedding", 5)
    return vector.top_per(hits, ["vec_id"], [F.col("query_id")], 1).select("query_id", "vec_id", _score())


@query(f"""WITH s AS (SELECT e.vec_id, e.label, {ROUNDED} AS score, {COS} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q),
pool AS (SELECT vec_id, score, 'pool' AS origin FROM s ORDER BY raw DESC, vec_id LIMIT 50), scoped AS (SELECT vec_id, score, 'scoped' AS origin FROM s WHERE label = 3 ORDER BY raw DESC, vec_id LIMIT 50)
SELECT vec_id, score, CASE WHEN vec_id IN (SELECT vec_id FROM scoped) THEN 'scoped' ELSE 'pool' END AS origin FROM (SELECT * FROM pool UNION ALL SELECT * FROM scoped WHERE vec_id NOT IN (SELECT vec_id FROM pool))""")
def pool_union_by_id(read):
    q, e = _q(read, [0]), read("embeddings")
    pool = vector.top_k(e, q, "vec_id", "embedding", 50).withColumn("origin", F.lit("pool"))
    scoped = vector.top_k(e.where("label = 3"), q, "vec_id", "embedding", 50).withColumn("origin", F.lit("scoped"))
    return vector.keyed_union([pool, scoped], "vec_id", [], first_wins=False).select("vec_id", _score(), "origin")


@query(f"""SELECT query_id, floor(top * 1000 + 0.5) / 1000 AS top_score, top < 0.60 AS low_confidence FROM (
SELECT q.vec_id AS query_id, max({COS}) AS top FROM embeddings e JOIN embeddings q ON q.vec_id < 20 WHERE e.vec_id >= 20 GROUP BY q.vec_id)""")
def confidence_flag(read):
    hits = vector.top_k(read("embeddings").where("vec_id >= 20"), _q(read, list(range(20))), "vec_id", "embedding", 1)
    return vector.low_confidence(hits, "query_id").select("query_id", text.js_round(F.col("top_score"), 3).alias("top_score"), "low_confidence")


@query(f"""WITH hits AS (SELECT e.vec_id, e.label, {ROUNDED} AS score, {COS} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY raw DESC, e.vec_id LIMIT 40)
SELECT vec_id, label, score FROM hits WHERE label IN (1, 3, 5) ORDER BY raw DESC, vec_id LIMIT 20""")
def overfetch_postfilter(read):
    e = read("embeddings")
    hits = vector.top_k(e, _q(read, [0]), "vec_id", "embedding", 40)
    wanted = e.select("vec_id", "label").where(F.col("label").isin(1, 3, 5))
    return hits.join(wanted, "vec_id").orderBy(*vector.best_first("vec_id")).limit(20).select("vec_id", "label", _score())


@query(f"""SELECT vec_id, label, score, row_number() OVER (ORDER BY floor(raw / 0.01) DESC, label, vec_id) AS place FROM
(SELECT e.vec_id, e.label, {ROUNDED} AS score, {COS} AS raw FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY raw DESC, e.vec_id LIMIT 100)""")
def score_bucket_rank(read):
    hits = vector.top_k(read("embeddings"), _q(read, [0]), "vec_id", "embedding", 100, ["label"])
    order = relational.bucketed_order(hits, "score", [F.col("label"), F.col("vec_id")])
    return hits.select("vec_id", "label", _score(), F.row_number().over(Window.orderBy(*order)).cast("long").alias("place"))


# ---------------------------------------------------------------- filters, joins, windows


@query("SELECT p_partkey, p_brand, p_type, p_size FROM part WHERE (p_type = 'ECONOMY' OR p_type = 'PROMO') AND p_brand ILIKE 'brand#1%' AND p_size = 10")
def dynamic_filter(read):
    got = relational.dynamic_filter(read("part"), either=("p_type", "ECONOMY", "PROMO"), prefix=("p_brand", "brand#1"), equal={"p_size": 10, "p_name": None})
    return got.select("p_partkey", "p_brand", "p_type", "p_size")


@query("""SELECT p_partkey, p_name, p_type FROM part WHERE (contains(lower(p_name), 'red') OR contains(lower(p_brand), 'red') OR contains(lower(p_type), 'red'))
AND (contains(lower(p_name), 'promo') OR contains(lower(p_brand), 'promo') OR contains(lower(p_type), 'promo'))""")
def keyword_all_terms(read):
    return relational.keyword_all_terms(read("part"), ["p_name", "p_brand", "p_type"], "Red promo of").select("p_partkey", "p_name", "p_type")


@query("""WITH s AS (SELECT * FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part))
SELECT p.p_partkey, CASE WHEN p.p_brand = s.p_brand AND p.p_type = s.p_type THEN 0 WHEN p.p_brand = s.p_brand THEN 1 ELSE 2 END AS layer
FROM part p, s WHERE p.p_partkey <> s.p_partkey AND (p.p_brand = s.p_brand OR p.p_type = s.p_type) ORDER BY layer, p.p_size, p.p_partkey LIMIT 4""")
def related_layers(read):
    p = read("part")
    seed = p.orderBy("p_partkey").limit(1).first().asDict()
    return relational.layered(p, seed, [("p_brand", "p_type"), ("p_brand",), ("p_type",)], "p_partkey", [F.col("p_size")], 4).select("p_partkey", "layer")


HIER = "(coalesce(x, '') = ''), coalesce(try_cast(nullif(regexp_extract(x, '(?i)^lz ?([0-9]+)$', 1), '') AS INTEGER), -1), CASE WHEN contains(lower(x), 'lower limit') THEN 0 WHEN contains(lower(x), 'upper limit') THEN 1 ELSE -1 END, lower(coalesce(x, ''))"


@query(f"""SELECT p_partkey, x, row_number() OVER (ORDER BY {HIER}, coalesce(try_cast(regexp_extract(p_brand, '([0-9]+)', 1) AS BIGINT), 9007199254740991), p_partkey) AS place FROM
(SELECT p_partkey, p_brand, CASE p_partkey % 5 WHEN 0 THEN 'LZ' || (p_size % 5) WHEN 1 THEN p_type || ' upper limit' WHEN 2 THEN p_type || ' Lower Limit' WHEN 3 THEN NULL ELSE p_name END AS x FROM part)""")
def hierarchy_order(read):
    k = F.col("p_partkey") % 5
    x = F.when(k == 0, F.concat(F.lit("LZ"), (F.col("p_size") % 5).cast("string"))).when(k == 1, F.concat("p_type", F.lit(" upper limit"))).when(k == 2, F.concat("p_type", F.lit(" Lower Limit"))).when(k == 4, F.col("p_name"))
    rows = read("part").select("p_partkey", "p_brand", x.alias("x"))
    order = [*relational.hierarchy_keys("x"), relational.row_number_of(F.col("p_brand")), F.col("p_partkey")]
    return relational.numbered(rows, order, "place").select("p_partkey", "x", "place")


@query("""WITH r AS (SELECT o_orderkey, o_orderpriority, o_orderdate, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS pos FROM orders)
SELECT o_orderkey, o_orderpriority, row_number() OVER (ORDER BY g, o_orderdate, o_orderkey) AS final_position FROM (SELECT *, min(pos) OVER (PARTITION BY o_orderpriority) AS g FROM r)""")
def sibling_cluster(read):
    r = relational.numbered(read("orders").select("o_orderkey", "o_orderpriority", "o_orderdate", "o_totalprice"), [F.col("o_totalprice").desc(), F.col("o_orderkey")], "pos")
    got = relational.cluster_siblings(r, ["o_orderpriority"], "pos", [F.col("o_orderdate"), F.col("o_orderkey")])
    return got.select("o_orderkey", "o_orderpriority", F.col("final_position").cast("long").alias("final_position"))


@query("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n_orders FROM customer")
def project_list_counts(read):
    return relational.counts_kept(read("customer"), read("orders"), "c_custkey", "o_custkey", "n_orders").select("c_custkey", "n_orders")


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def project_detail_left(read):
    return read("orders").join(read("customer"), F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", "o_custkey", "c_name", "c_mktsegment")


@query("""SELECT o_custkey, count(*) AS n, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) AS BIGINT) AS total_cents, count(DISTINCT o_orderpriority) AS n_priorities, CAST(sum(CAST(floor(o_totalprice * 100 + 0.5) AS BIGINT)) // count(*) AS BIGINT) AS mean_cents FROM orders GROUP BY o_custkey""")
def project_summary(read):
    return reports.project_summary(read("orders"), "o_custkey", "o_totalprice", "o_orderpriority")


@query("""SELECT l_orderkey, l_linenumber, coalesce(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity * 2 END, l_quantity) AS quantity, l_linenumber % 3 = 0 AS overridden FROM lineitem""")
def override_else_snapshot(read):
    own = F.when(F.col("l_linenumber") % 3 == 0, F.col("l_quantity") * 2)
    return read("lineitem").select("l_orderkey", "l_linenumber", F.coalesce(own, "l_quantity").alias("quantity"), own.isNotNull().alias("overridden"))


@query("""WITH r AS (SELECT o_orderkey * 2 AS o_orderkey FROM orders WHERE o_orderkey % 3 = 0), p AS (SELECT o_orderkey FROM orders WHERE o_orderkey % 4 = 0)
SELECT r.o_orderkey, CASE WHEN k.o_orderkey IS NULL THEN 'rejected' WHEN p.o_orderkey IS NOT NULL THEN 'skipped' ELSE 'inserted' END AS outcome
FROM r LEFT JOIN orders k ON k.o_orderkey = r.o_orderkey LEFT JOIN p ON p.o_orderkey = r.o_orderkey""")
def bulk_add_split(read):
    o = read("orders")
    requests = o.where("o_orderkey % 3 = 0").select((F.col("o_orderkey") * 2).alias("o_orderkey"))
    return changes.split_requests(requests, o, o.where("o_orderkey % 4 = 0"), "o_orderkey").select("o_orderkey", "outcome")


@query("""WITH d AS (SELECT c_custkey + 100 AS k, CASE WHEN c_custkey % 2 = 0 THEN c_name || '*' END AS n, c_mktsegment AS m FROM customer WHERE c_custkey % 5 = 0)
SELECT coalesce(c_custkey, k) AS c_custkey, coalesce(n, c_name) AS c_name, CASE WHEN k IS NULL THEN c_mktsegment ELSE m END AS c_mktsegment FROM (SELECT c_custkey, c_name, c_mktsegment FROM customer) FULL JOIN d ON c_custkey = k""")
def upsert_coalesce(read):
    c = read("customer").select("c_custkey", "c_name", "c_mktsegment")
    delta = c.where("c_custkey % 5 = 0").select((F.col("c_custkey") + 100).alias("c_custkey"), F.when(F.col("c_custkey") % 2 == 0, F.concat("c_name", F.lit("*"))).alias("c_name"), "c_mktsegment")
    return changes.upsert(c, delta, "c_custkey", {"c_name": changes.KEEP})


@query("""WITH d AS (SELECT p_partkey + 50 AS k, CASE WHEN p_partkey % 2 = 0 THEN NULL ELSE p_name END AS n, p_size AS s FROM part WHERE p_partkey % 7 = 0)
SELECT coalesce(p_partkey, k) AS p_partkey, CASE WHEN k IS NULL THEN p_name ELSE n END AS p_name, CASE WHEN k IS NULL THEN p_size ELSE s END AS p_size, p_brand FROM (SELECT p_partkey, p_name, p_size, p_brand FROM part) FULL JOIN d ON p_partkey = k""")
def upsert_overwrite(read):
    p = read("part").select("p_partkey", "p_name", "p_size", "p_brand")
    delta = p.where("p_partkey % 7 = 0").select((F.col("p_partkey") + 50).alias("p_partkey"), F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_name")).alias("p_name"), "p_size")
    return changes.upsert(p, delta, "p_partkey", empty_is_null=True)


@query("""SELECT l_orderkey, l_linenumber FROM lineitem LEFT JOIN (SELECT o_orderkey, o_orderkey % 4 + 1 AS n FROM orders WHERE o_orderkey % 2 = 0) ON l_orderkey = o_orderkey WHERE n IS NULL OR l_linenumber < n""")
def stale_tail_delete(read):
    limits = read("orders").where("o_orderkey % 2 = 0").select("o_orderkey", (F.col("o_orderkey") % 4 + 1).alias("n"))
    return changes.delete_tail(read("lineitem").select("l_orderkey", "l_linenumber"), limits, "l_orderkey", "o_orderkey", "l_linenumber", "n")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def cascade_delete(read):
    return changes.cascade_delete(read("customer"), read("orders"), F.col("c_acctbal") < 0, "c_custkey", "o_custkey")[1].select("o_orderkey", "o_custkey")


@query("""SELECT 'unlabelled' AS side, doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'orphan', doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def orphans(read):
    d, s = read("documents").select("doc_id"), read("labels").select("doc_id")
    return d.join(s, "doc_id", "left_anti").select(F.lit("unlabelled").alias("side"), "doc_id").unionByName(s.join(d, "doc_id", "left_anti").select(F.lit("orphan").alias("side"), "doc_id"))


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def group_count(read):
    return read("orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT o_custkey, o_orderkey, o_orderdate FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def newest_per_family(read):
    return relational.newest_per(read("orders"), ["o_custkey"], [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]).select("o_custkey", "o_orderkey", "o_orderdate")


@query("""WITH e AS (SELECT event_id, user_id, event_type, value, epoch(ts) AS at FROM events)
SELECT event_id, other_id, distance FROM (SELECT a.event_id, b.event_id AS other_id, abs(a.at - b.at) AS distance,
 row_number() OVER (PARTITION BY a.event_id ORDER BY abs(a.at - b.at), b.value DESC, b.event_id) AS rn
 FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'view' AND abs(a.at - b.at) <= 86400 WHERE a.event_type = 'purchase') WHERE rn = 1""")
def nearest_page(read):
    e = read("events").select("event_id", "user_id", "event_type", "value", _epoch("ts").alias("at"))
    right = e.where("event_type = 'view'").select("user_id", F.col("event_id").alias("other_id"), F.col("at").alias("at2"), F.col("value").alias("v2"))
    got = relational.nearest_within(e.where("event_type = 'purchase'"), right, "user_id", "at", "at2", 86400, "event_id", [F.col("v2").desc(), F.col("other_id")])
    return got.select("event_id", "other_id", F.col("distance").cast("double").alias("distance"))


def _epoch(c: str):
    """Seconds with fractions since 1970 of a timestamp without zone."""
    return F.expr(f"unix_micros(cast({c} as timestamp))") / 1e6


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_purchase FROM events""")
def preceding_fallback(read):
    return relational.last_before(read("events"), ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "purchase", F.col("event_id")), "last_purchase").select("event_id", "last_purchase")


@query("""SELECT conv_id, turn, md5(last_value(CASE WHEN role = 'user' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS last_user FROM conversations""")
def forward_fill(read):
    got = relational.forward_fill(read("conversations"), ["conv_id"], [F.col("turn")], F.when(F.col("role") == "user", F.col("text")), "filled")
    return got.select("conv_id", "turn", F.md5("filled").alias("last_user"))


@query("""SELECT event_id, user_id, CAST(sum(CASE WHEN gap IS NULL OR gap > 43200 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session
FROM (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events)""")
def islands(read):
    e = read("events").withColumn("at", _epoch("ts"))
    order = [F.col("ts"), F.col("event_id")]
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("user_id").orderBy(*order))
    return relational.islands(e.withColumn("gap", gap), ["user_id"], order, F.col("gap").isNull() | (F.col("gap") > 43200), "session").select("event_id", "user_id", "session")


@query("SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS median FROM lineitem GROUP BY l_returnflag")
def upper_median(read):
    return reports.upper_median_exact(read("lineitem"), "l_returnflag", "l_quantity", "median")


@query("""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, len(w), 310)) AS i FROM w)
SELECT doc_id, CAST(i // 310 AS INTEGER) AS chunk_no, CAST(least(350, len(w) - i) AS INTEGER) AS n_chunk_words, md5(array_to_string(w[i + 1 : i + 350], ' ')) AS h FROM s WHERE len(w) - i >= 30""")
def word_windows(read):
    return relational.word_windows(read("documents").select("doc_id", "text"), "text").select("doc_id", "chunk_no", "n_chunk_words", F.md5("chunk").alias("h"))


@query("""SELECT doc_id, floor(d * 10000 + 0.5) / 10000 AS digits, floor(l * 10000 + 0.5) / 10000 AS letters, d > 0.22 OR l < 0.45 AS flag, d2 > 0.22 AS padded_flag FROM (
SELECT doc_id, length(regexp_replace(text, '[^0-9]', '', 'g')) / length(text) AS d, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) / length(text) AS l,
 length(regexp_replace(left(text, 40) || '1234567890123', '[^0-9]', '', 'g')) / length(left(text, 40) || '1234567890123') AS d2 FROM documents WHERE length(text) > 0)""")
def table_like(read):
    d = read("documents").where(F.length("text") > 0)
    padded = F.concat(F.substring("text", 1, 40), F.lit("1234567890123"))
    return d.select("doc_id", text.js_round(text.digit_ratio(F.col("text")), 4).alias("digits"), text.js_round(text.letter_ratio(F.col("text")), 4).alias("letters"), text.table_like(F.col("text")).alias("flag"), (text.digit_ratio(padded) > 0.22).alias("padded_flag"))


# ---------------------------------------------------------------- reports


@query("""SELECT source, count(DISTINCT lang) AS n_langs, string_agg(lang || '=' || n, ',' ORDER BY lang) AS by_lang, CAST(floor(100.0 * max(labelled) / sum(n) + 0.5) AS BIGINT) AS percent
FROM (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL) JOIN (SELECT source, count(l.doc_id) AS labelled FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY source) USING (source) GROUP BY source""")
def coverage_stats(read):
    return reports.coverage(read("documents"), read("labels"), "source", "lang", "doc_id")


@query("""WITH r AS (SELECT coalesce(source, '(total)') AS source, count(*) AS n_docs, count(quality) AS n_labelled FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ROLLUP (source))
SELECT source, n_docs, n_labelled, CAST(floor(100.0 * n_labelled / n_docs + 0.5) AS BIGINT) AS percent,
 concat_ws('; ', CASE WHEN n_labelled = 0 THEN 'no labels' END, CASE WHEN floor(100.0 * n_labelled / n_docs + 0.5) < 40 THEN 'low coverage' END) AS warnings FROM r""")
def index_status(read):
    return reports.index_status(read("documents"), read("labels"), "source", "doc_id", "quality", alarm=40)


@query("""SELECT 'all' AS scope, count(*) AS n, CAST(count_if(quality = 1) AS BIGINT) AS good, CAST(count_if(toxic = 1) AS BIGINT) AS toxic, CAST(count_if(text IS NULL OR text = '') AS BIGINT) AS empty, CAST(count_if(n_chars < 200) AS BIGINT) AS short,
 CAST(count_if(lang IS NULL) AS BIGINT) AS no_lang, CAST(floor(100.0 * count_if(quality = 1) / count(*) + 0.5) AS BIGINT) AS quality_percent, 100.0 * count_if(quality = 1) / count(*) >= 90 AS passed FROM documents JOIN labels USING (doc_id)""")
def quality_report(read):
    return reports.quality_gate(read("documents").join(read("labels"), "doc_id"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, try_cast(json_extract_string(CASE WHEN event_id % 10 = 0 THEN NULL ELSE props END, '$.k') AS BIGINT) IS NOT NULL AS valid FROM events")
def json_extract(read):
    broken = F.when(F.col("event_id") % 10 == 0, F.lit("{not json")).otherwise(F.col("props"))
    k = lambda c: F.try_variant_get(F.try_parse_json(c), "$.k", "long")
    return read("events").select("event_id", k(F.col("props")).alias("k"), k(broken).isNotNull().alias("valid"))


@query("""SELECT event_id, '{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || user_id || '}' AS canonical,
 sha256('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || ',"user_id":' || user_id || '}') AS key FROM events""")
def json_roundtrip(read):
    got = read("events").select("event_id", reports.canonical_json({"user_id": F.col("user_id"), "event_type": F.col("event_type"), "k": F.get_json_object("props", "$.k").cast("long")}).alias("canonical"))
    return got.withColumn("key", F.sha2("canonical", 256))


@query("""WITH c AS (SELECT event_id, CASE event_id % 8 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN ',' WHEN 5 THEN '"' WHEN 6 THEN chr(10) ELSE '' END || event_type AS t FROM events),
g AS (SELECT event_id, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS t FROM c)
SELECT event_id, CASE WHEN regexp_matches(t, '[",\\n\\r]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS cell FROM g""")
def csv_cell(read):
    marks = F.element_at(F.array(*[F.lit(x) for x in ["=", "+", "-", "@", ",", '"', "\n", ""]]), (F.col("event_id") % 8 + 1).cast("int"))
    return read("events").select("event_id", text.csv_cell(F.concat(marks, "event_type")).alias("cell"))


@query("""SELECT string_agg(line, chr(13) || chr(10) ORDER BY ts DESC, event_id DESC) AS csv, count(*) AS n FROM (SELECT ts, event_id, event_id || ',' || event_type || ',' || user_id AS line
FROM events WHERE ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-07' ORDER BY ts DESC, event_id DESC LIMIT 100)""")
def search_log_export(read):
    e = read("events").where("ts >= timestamp_ntz'2024-01-05' and ts < timestamp_ntz'2024-01-07'").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(100)
    lines = reports.csv_lines(e, ["event_id", "event_type", "user_id"], [F.col("ts"), F.col("event_id")])
    return lines.select("csv", "n")


@query("SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY ALL")
def log_window_counts(read):
    from foliant.streaming.log import window_counts

    return window_counts(read("events"), "ts", ["event_type"], "1 hour").select("window_start", "event_type", "n")


@query("""WITH a AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber <= 2 GROUP BY 1), b AS (SELECT l_partkey AS k, count(*) AS n FROM lineitem WHERE l_linenumber > 2 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'revised' END AS change, CASE WHEN a.k IS NULL OR b.k IS NULL THEN '' ELSE 'n' END AS changed
FROM a FULL JOIN b ON a.k = b.k WHERE a.n IS DISTINCT FROM b.n""")
def edition_diff(read):
    side = lambda c: read("lineitem").where(c).groupBy(F.col("l_partkey").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return changes.difference(side("l_linenumber <= 2"), side("l_linenumber > 2"), "k", ["n"])


@query("""WITH i AS (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) SELECT a.l_suppkey AS item_a, b.l_suppkey AS item_b, count(*) AS together FROM i a JOIN i b ON a.l_orderkey = b.l_orderkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL""")
def cooccurrence(read):
    return relational.cooccurrence(read("lineitem"), "l_orderkey", "l_suppkey")


@query("""SELECT p_partkey, floor(p_retailprice / 10 * 10 + 0.5) / 10 AS fc, floor(p_retailprice * 3.28084 * 10 + 0.5) / 10 AS feet,
 CASE WHEN p_size < 45 * 0.9 THEN 'under' WHEN p_size > 45 * 1.1 THEN 'over' ELSE 'ok' END AS fit, CASE WHEN p_size > 25 THEN p_retailprice * 2 ELSE p_retailprice END AS adjusted FROM part""")
def unit_convert(read):
    price = F.col("p_retailprice")
    return read("part").select("p_partkey", quantities.lux_to_fc(price).alias("fc"), quantities.m_to_ft(price).alias("feet"), quantities.tolerance(F.col("p_size"), F.lit(45)).alias("fit"), quantities.age_adjusted(price, F.col("p_size") > 25).alias("adjusted"))


@query("""SELECT p_type, floor(stddev_pop(p_size) / avg(p_size) * 10000 + 0.5) / 10000 AS cv, floor(max(p_size) / min(p_size) * 10000 + 0.5) / 10000 AS uniformity FROM part GROUP BY p_type""")
def dispersion(read):
    size = F.col("p_size")
    return read("part").groupBy("p_type").agg(text.js_round(quantities.coefficient_of_variation(size), 4).alias("cv"), text.js_round(quantities.uniformity(size), 4).alias("uniformity"))


# ---------------------------------------------------------------- query text

TEMPLATES = ["How bright should a {} be?", "what lux levels for the {}?", "{} lighting requirements", "recommended illuminance for an {}", "{}, open office; spa", "what's new in {}", "list of references on {}", "{} parking garage illuminance levels?", "Lighting design for {} task surface!", "{}"]
TEMPLATED = "(SELECT p_partkey, CASE p_partkey % 10 " + " ".join(f"WHEN {i} THEN '" + t.replace("'", "''").replace("{}", "' || p_name || '") + "'" for i, t in enumerate(TEMPLATES)) + " END AS q FROM part)"


def _templated(read):
    k, q = F.col("p_partkey") % 10, F.lit(None).cast("string")
    for i, t in enumerate(TEMPLATES):
        a, b = t.split("{}")
        q = F.when(k == i, F.concat(F.lit(a), "p_name", F.lit(b))).otherwise(q)
    return read("part").select("p_partkey", q.alias("q"))


def _sql(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _clean_sql(q: str) -> str:
    trim = f"regexp_replace({q}, '^\\s+|\\s+$', '', 'g')"
    out = "CASE " + " ".join(f"WHEN regexp_matches({trim}, {_sql(p)}) THEN regexp_replace({trim}, {_sql(p)}, '')" for p in QUESTION_PATTERNS) + f" ELSE {trim} END"
    for p in [*TRAILING_PATTERNS, ARTICLE]:
        out = f"regexp_replace({out}, {_sql(p)}, '')"
    return f"coalesce(nullif(regexp_replace({out}, '^\\s+|\\s+$', '', 'g'), ''), {trim})"


@query(f"""SELECT p_partkey, CASE WHEN len(p) >= 2 THEN array_to_string(p, '|') ELSE trim(q) END AS parts FROM (SELECT p_partkey, q, list_filter(list_transform(regexp_split_to_array(q, '[,;]'), lambda x: trim(x)), lambda x: length(x) >= 2) AS p FROM {TEMPLATED})""")
def split_multi_query(read):
    return _templated(read).select("p_partkey", F.array_join(text.split_multi_query(F.col("q")), "|").alias("parts"))


@query(f"SELECT p_partkey, {_clean_sql('q')} AS cleaned FROM {TEMPLATED}")
def clean_query(read):
    return _templated(read).select("p_partkey", text.clean_query(F.col("q")).alias("cleaned"))


@query(f"""WITH s(ord, term, words) AS (VALUES {", ".join(f"({i}, {_sql(t)}, {_sql(w.lower())})" for i, (t, w) in enumerate(SYNONYMS))}),
c1 AS (SELECT p_partkey, {_clean_sql("q")} AS q FROM {TEMPLATED}), c AS (SELECT p_partkey, {_clean_sql("q")} AS q FROM c1),
w AS (SELECT p_partkey, unnest(string_split(words, ' ')) AS word, ord, generate_subscripts(string_split(words, ' '), 1) AS i FROM c JOIN s ON contains(' ' || regexp_replace(lower(q), '\\s', ' ', 'g') || ' ', ' ' || term || ' ')),
f AS (SELECT p_partkey, word, min(ord * 1000 + i) AS o FROM w GROUP BY ALL)
SELECT c.p_partkey, any_value(q) || coalesce(' ' || string_agg(word, ' ' ORDER BY o) FILTER (NOT list_contains(string_split(lower(q), ' '), word)), '') AS expanded FROM c LEFT JOIN f ON f.p_partkey = c.p_partkey GROUP BY c.p_partkey""")
def expand_query(read):
    return _templated(read).select("p_partkey", text.prepare_query(F.col("q")).alias("expanded"))


def _any(patterns: list[str]) -> str:
    return "(" + " OR ".join(f"regexp_matches(q, {_sql(p)})" for p in patterns) + ")"


@query(f"""SELECT p_partkey, {_any(COMPARISON_PATTERNS)} AS comparison, {_any(REFERENCE_PATTERNS)} AS reference_seeking, CASE WHEN {_any(REFERENCE_PATTERNS)} THEN 'references' ELSE 'body,tables' END AS types FROM {TEMPLATED}""")
def intents(read):
    q = F.col("q")
    return _templated(read).select("p_partkey", text.is_comparison(q).alias("comparison"), text.is_reference_seeking(q).alias("reference_seeking"), F.array_join(text.content_types(F.lit(None).cast("array<string>"), q), ",").alias("types"))


@query("""WITH x AS (SELECT p_partkey, 'ANSI/IES RP-' || p_size || '-20' AS d, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'RP-' || p_size || '-20 ' || p_name WHEN 2 THEN 'ansi/ies rp-' || p_size || '-20 ' || p_name ELSE p_name END AS t FROM part)
SELECT p_partkey, CASE WHEN t = '' THEN d WHEN starts_with(upper(t), upper(d)) THEN t WHEN starts_with(upper(t), upper(substr(d, 10))) THEN 'ANSI/IES ' || t ELSE d || ' ' || t END AS name FROM x""")
def compose_name(read):
    d = F.concat(F.lit("ANSI/IES RP-"), F.col("p_size").cast("string"), F.lit("-20"))
    k, bare = F.col("p_partkey") % 4, F.concat(F.lit("RP-"), F.col("p_size").cast("string"), F.lit("-20 "), "p_name")
    t = F.when(k == 0, "").when(k == 1, bare).when(k == 2, F.concat(F.lit("ansi/ies "), F.lower(bare))).otherwise(F.col("p_name"))
    t = F.when(k == 2, F.concat(F.lit("ansi/ies rp-"), F.col("p_size").cast("string"), F.lit("-20 "), "p_name")).otherwise(t)
    return read("part").select("p_partkey", text.compose_name(d, t).alias("name"))


@query("""SELECT s_suppkey, concat_ws(', ', s_name, CASE WHEN s_suppkey % 2 = 0 THEN 'Table A-' || s_nationkey END, CASE WHEN s_suppkey % 3 = 0 THEN 'Row ' || s_suppkey END, CASE WHEN s_nationkey % 2 = 0 THEN 'Section ' || s_nationkey END, CASE WHEN s_suppkey % 5 <> 0 THEN 'p. ' || (s_suppkey % 5) END) AS citation FROM supplier""")
def citation(read):
    key, nation = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return read("supplier").select("s_suppkey", text.citation(F.col("s_name"), F.when(key % 2 == 0, F.concat(F.lit("Table A-"), nation)).otherwise(""), F.when(key % 3 == 0, F.concat(F.lit("Row "), key.cast("string"))), F.when(F.col("s_nationkey") % 2 == 0, nation), key % 5).alias("citation"))


@query("""WITH x AS (SELECT p_partkey, 'RP-' || p_size || '-' || lpad(CAST(10 + p_partkey % 15 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 3 = 0 THEN '+E' || (p_partkey % 4 + 1) ELSE '' END AS id FROM part)
SELECT p_partkey, id, regexp_replace(regexp_replace(id, '\\+E[0-9]+$', ''), '-[0-9]{2}$', '') AS family, CAST(10 + p_partkey % 15 AS INTEGER) AS edition, CAST(CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 4 + 1 ELSE 0 END AS INTEGER) AS errata,
 'IES ' || id AS typed, id AS normalized, id AS from_title FROM x""")
def id_grammar(read):
    k = F.col("p_partkey")
    made = F.concat(F.lit("RP-"), F.col("p_size").cast("string"), F.lit("-"), (k % 15 + 10).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("+E"), (k % 4 + 1).cast("string"))).otherwise(""))
    got = read("part").select("p_partkey", made.alias("id"))
    i, typed = F.col("id"), F.concat(F.lit("IES "), F.col("id"))
    return got.select("p_partkey", "id", ids.family(i).alias("family"), ids.edition(i).alias("edition"), ids.errata(i).alias("errata"), typed.alias("typed"), ids.normalized_id(F.lower(typed)).alias("normalized"), ids.id_from_title(F.concat(F.lit("See ANSI/IES "), i, F.lit(" for more"))).alias("from_title"))


# ---------------------------------------------------------------- documents

_CITE = """(SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'See ANSI/IES RP-' || p_size || '-20, Table 1' WHEN 1 THEN 'IES RP-' || p_size || ' (editionless)' WHEN 2 THEN 'doi 10.1000/' || p_partkey || '). 2019'
 WHEN 3 THEN 'at https://example.org/' || p_partkey || '.' WHEN 4 THEN 'IES TM-' || p_size || '-18 https://example.org/x' ELSE p_name END AS t FROM part)"""


@query(f"""WITH std AS (SELECT DISTINCT 'RP-' || p_size || '-' || y AS id, CASE WHEN p_size % 3 = 0 AND y = '20' THEN NULL ELSE 'https://lib.example/' || p_size || '/' || y END AS web_url FROM part, (VALUES ('15'), ('20')) v(y) WHERE p_size <= 40),
live AS (SELECT id, web_url, regexp_replace(id, '-[0-9]{{2}}$', '') AS family FROM std WHERE web_url IS NOT NULL), newest AS (SELECT family, max_by(web_url, id) AS web_url FROM live GROUP BY family),
c AS (SELECT p_partkey, t, nullif(regexp_extract(t, 'IES ((?:RP|TM)-[0-9]+)', 1), '') AS family, nullif(regexp_extract(t, 'IES ((?:RP|TM)-[0-9]+(?:-[0-9]{{2}})?)', 1), '') AS cited,
 nullif(rtrim(regexp_extract(t, '(10\\.[0-9]{{4,9}}/[^ ]+)', 1), ').,;:]'), '') AS doi, nullif(rtrim(regexp_extract(t, '(https?://[^ )]+)', 1), '.,;:]'), '') AS url FROM {_CITE})
SELECT p_partkey, coalesce(live.web_url, newest.web_url, 'https://doi.org/' || doi, url) AS link, CASE WHEN coalesce(live.web_url, newest.web_url) IS NOT NULL THEN 'library' WHEN doi IS NOT NULL THEN 'doi' WHEN url IS NOT NULL THEN 'url' END AS link_type
FROM c LEFT JOIN live ON live.id = c.cited LEFT JOIN newest ON newest.family = c.family""")
def reference_links(read):
    p, k = read("part"), F.col("p_partkey") % 6
    size, key = F.col("p_size").cast("string"), F.col("p_partkey").cast("string")
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    t = F.when(k == 0, cat("See ANSI/IES RP-", size, "-20, Table 1")).when(k == 1, cat("IES RP-", size, " (editionless)")).when(k == 2, cat("doi 10.1000/", key, "). 2019")).when(k == 3, cat("at https://example.org/", key, ".")).when(k == 4, cat("IES TM-", size, "-18 https://example.org/x")).otherwise(F.col("p_name"))
    years = p.where("p_size <= 40").select("p_size").distinct().select("p_size", F.explode(F.array(F.lit("15"), F.lit("20"))).alias("y"))
    std = years.select(F.concat(F.lit("RP-"), F.col("p_size").cast("string"), F.lit("-"), "y").alias("id"), F.when(~((F.col("p_size") % 3 == 0) & (F.col("y") == "20")), F.concat(F.lit("https://lib.example/"), F.col("p_size").cast("string"), F.lit("/"), "y")).alias("web_url"), F.lit("Active").alias("status"))
    return references.reference_links(p.select("p_partkey", t.alias("t")), "t", std).select("p_partkey", "link", "link_type")


def _document_lines(read):
    """Documents as pages of forty lines."""
    d = read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("n", "text"))
    return d.select("doc_id", (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), F.col("n").alias("line_no"), "text", F.lit(None).cast("double").alias("x"))


@query()
def chunk_documents(read):
    return chunking.chunk_documents(_document_lines(read))


@query()
def extract_tables(read):
    titled = _document_lines(read).withColumn("text", F.when(F.col("line_no") % 20 == 0, F.concat(F.lit("Table A-"), F.col("page").cast("string"), F.lit(": data"))).otherwise(F.col("text")))
    return tables.extract_tables(titled).select("doc_id", "page", "table_id", "title", F.size("rows").alias("n_rows"))


@query()
def layout_lines(read):
    # a line of more than twelve words goes on in further rows; forty rows are a page
    wrapped = F.expr("flatten(transform(transform(split(text, '\n'), l -> split(l, ' ')), w -> transform(sequence(0, (size(w) - 1) div 12), i -> slice(w, i * 12 + 1, 12))))")
    rows = read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(wrapped).alias("n", "words"))
    words = rows.select("doc_id", (F.floor(F.col("n") / 40) + 1).cast("int").alias("page"), (F.col("n") % 40).alias("row"), F.posexplode("words").alias("k", "text"))
    items = words.select("doc_id", "page", F.col("k").alias("item_no"), "text", (F.col("k") * 45.0 + 40).alias("x"), (760.0 - F.col("row") * 18).alias("y"), (F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("font_size"), F.lit("Serif").alias("font_name"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"))
    return layout.layout_lines(items).select("doc_id", "page", "line_no", "text", "x", "y")


@query("""WITH c AS (SELECT source, count(*) AS n FROM documents GROUP BY source), p AS (SELECT source, unnest([0, (n - 1) // 2, n - 1]) AS o FROM c),
h AS (SELECT source, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS o, doc_id FROM documents)
SELECT source, count(*) AS probed, coalesce(string_agg(CASE WHEN doc_id % 3 = 0 THEN o END, ',' ORDER BY o), '') AS missing FROM (SELECT DISTINCT * FROM p) JOIN h USING (source, o) GROUP BY source""")
def spot_check(read):
    d = read("documents")
    counts = d.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    numbered = d.withColumn("o", F.row_number().over(Window.partitionBy("source").orderBy("doc_id")) - 1)
    got = reports.spot_check(counts, numbered.where("doc_id % 3 <> 0"), "source", "n", "o")
    return got.select("source", "probed", F.array_join("missing", ",").alias("missing"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'https://x/' || event_id WHEN event_id % 4 = 1 THEN 'https://d/1#a' || event_id WHEN event_id % 4 = 2 THEN 'https://d/1#page=' || (event_id % 9 + 1) ELSE 'https://d/1' END AS link FROM events""")
def viewer_link(read):
    e, k, key = read("events"), F.col("event_id") % 4, F.col("event_id").cast("string")
    none = F.lit(None).cast("string")
    link = references.viewer_link(F.when(k == 0, F.concat(F.lit("https://x/"), key)), F.lit("https://d/1"), F.when(k == 1, F.concat(F.lit("a"), key)).otherwise(none), F.when(k == 2, F.col("event_id") % 9 + 1).otherwise(F.lit(0)))
    return e.select("event_id", link.alias("link"))


@query("""SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'phrase:all rights reserved' ELSE '' END AS violations, CASE WHEN item_id % 3 = 0 THEN 'no location' ELSE '' END AS issues FROM benchmark""")
def policy_checks(read):
    said = F.when(F.col("item_id") % 2 == 0, "All Rights Reserved. x").otherwise("plain")
    cited = F.when(F.col("item_id") % 3 == 0, "ANSI/IES RP-8-25").otherwise("ANSI/IES RP-8-25, p. 3")
    return read("benchmark").select("item_id", F.array_join(text.policy_violations(said), ",").alias("violations"), F.array_join(text.citation_issues(cited), ",").alias("issues"))


# ---------------------------------------------------------------- lists and upkeep


@query("SELECT p_partkey, p_name, p_brand FROM part WHERE p_type = 'PROMO' ORDER BY p_brand, p_name, p_partkey LIMIT 200")
def table_list(read):
    return maintenance.listed(read("part"), {"p_type": "PROMO", "p_size": None}, [F.col("p_brand"), F.col("p_name"), F.col("p_partkey")], ["p_partkey", "p_name", "p_brand"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderkey = 42")
def point_lookup(read):
    return maintenance.lookup(read("orders"), "o_orderkey", 42).select("o_orderkey", "o_custkey", "o_orderstatus")


@query("""SELECT c_custkey, coalesce(n, c_name) AS c_name, c_acctbal FROM customer LEFT JOIN (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'new ' || c_name END AS n FROM customer WHERE c_custkey % 3 = 0) ON c_custkey = k""")
def metadata_sync(read):
    c = read("customer").select("c_custkey", "c_name", "c_acctbal")
    meta = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("new "), "c_name")).alias("c_name"))
    return maintenance.synced(c, meta, "c_custkey", ["c_name"])


def _editions(read):
    year = F.col("p_partkey") % 15 + 2010
    made = F.concat(F.lit("RP-"), F.col("p_size").cast("string"), F.lit("-"), F.substring(year.cast("string"), 3, 2))
    return read("part").where("p_size <= 30").select(made.alias("id"), year.alias("year"), F.when(F.col("p_partkey") % 4 == 0, "Deprecated").otherwise("Active").alias("status")).distinct()


_EDITIONS = """(SELECT DISTINCT 'RP-' || p_size || '-' || right(CAST(p_partkey % 15 + 2010 AS VARCHAR), 2) AS id, p_partkey % 15 + 2010 AS year, CASE WHEN p_partkey % 4 = 0 THEN 'Deprecated' ELSE 'Active' END AS status, 'RP-' || p_size AS family FROM part WHERE p_size <= 30)"""


@query(f"""WITH e AS {_EDITIONS}, b AS (SELECT family, arg_max(id, (year, id)) AS superseded_by FROM e WHERE status = 'Active' GROUP BY family) SELECT DISTINCT id, superseded_by FROM e LEFT JOIN b USING (family) WHERE status = 'Deprecated'""")
def superseded_by(read):
    e = _editions(read)
    return maintenance.superseding(e.where("status = 'Deprecated'").select("id"), e)


@query(f"""WITH e AS (SELECT DISTINCT id || CASE WHEN year % 2 = 0 THEN '+E1' ELSE '' END AS id, CASE year % 3 WHEN 0 THEN 'Own title' WHEN 1 THEN id || CASE WHEN year % 2 = 0 THEN '+E1' ELSE '' END END AS t, id AS base FROM {_EDITIONS})
SELECT id, CASE WHEN t <> id THEN t ELSE 'Curated ' || base END AS title FROM e UNION ALL SELECT NULL, NULL WHERE false""")
def title_precedence(read):
    e = _editions(read).select("id", "year").distinct()
    full = F.concat("id", F.when(F.col("year") % 2 == 0, "+E1").otherwise(""))
    rows = e.select(full.alias("id"), F.when(F.col("year") % 3 == 0, "Own title").when(F.col("year") % 3 == 1, full).alias("title")).withColumn("title", F.coalesce("title", F.col("id")))
    curated = e.select("id", F.concat(F.lit("Curated "), "id").alias("title")).distinct()
    return maintenance.titled(rows, curated, "id", "title")


@query("""SELECT source, count(*) AS seen, (SELECT string_agg(doc_id, ',' ORDER BY doc_id) FROM (SELECT doc_id FROM documents i WHERE i.source = d.source ORDER BY doc_id LIMIT 5)) AS sample FROM documents d GROUP BY source""")
def seen_counts(read):
    return maintenance.seen_per_owner(read("documents"), "source", "doc_id").select("source", "seen", F.array_join("sample", ",").alias("sample"))


@query("""SELECT p_partkey, '{"p_partkey":' || p_partkey || ',"p_size":' || p_size || '}' AS snapshot FROM part""")
def bulk_add_snapshot(read):
    p = read("part").select("p_partkey", "p_size")
    return maintenance.with_snapshot(p.select("p_partkey"), p, "p_partkey").select("p_partkey", "snapshot")


@query("""SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority LIKE '1%') THEN TIMESTAMP '2024-06-01' ELSE TIMESTAMP '2024-01-01' END AS modified_at FROM customer""")
def touch_modified(read):
    projects = read("customer").select("c_custkey", F.expr("timestamp_ntz'2024-01-01'").alias("modified_at"))
    return maintenance.touched(projects, read("orders").where("o_orderpriority like '1%'"), "c_custkey", "o_custkey", "modified_at", F.expr("timestamp_ntz'2024-06-01'"))


@query("""WITH f AS (SELECT 'x/' || p_partkey || '.pdf' AS path, 'RP-' || p_size AS id, p_partkey % 3 = 0 AS e, p_retailprice AS size FROM part)
SELECT path, id || '.pdf' AS target, CASE WHEN row_number() OVER (PARTITION BY id ORDER BY e DESC, size DESC, path) > 1 THEN 'conflict' ELSE 'rename' END AS action FROM f""")
def rename_plan(read):
    files = read("part").select(F.concat(F.lit("x/"), F.col("p_partkey").cast("string"), F.lit(".pdf")).alias("path"), F.concat(F.lit("RP-"), F.col("p_size").cast("string")).alias("id"), (F.col("p_partkey") % 3 == 0).alias("has_errata"), F.col("p_retailprice").alias("size"))
    return maintenance.rename_plan(files)


@query("""WITH g AS (SELECT lower(p_name) AS k, max(p_size) AS v FROM part WHERE p_partkey % 2 = 0 AND p_size < 48 GROUP BY 1)
SELECT p_partkey, CASE WHEN k IS NULL THEN 'missing' WHEN abs(p_size - v) <= 1 THEN 'match' ELSE 'differs' END AS state FROM part LEFT JOIN g ON lower(p_name) = k WHERE p_partkey % 2 = 1""")
def extraction_comparison(read):
    p = read("part")
    found = p.where("p_partkey % 2 = 1").withColumn("p_name", F.concat(F.lit(" "), F.upper("p_name"), F.lit("  ")))
    return maintenance.compared_extraction(found, p.where("p_partkey % 2 = 0 and p_size < 48"), "p_name", "p_size").select("p_partkey", "state")


@query("""WITH a AS (SELECT p_partkey, p_size FROM part WHERE p_partkey % 5 <> 0), b AS (SELECT p_partkey, p_size + p_partkey % 7 AS p_size FROM part WHERE p_partkey % 4 <> 0)
SELECT coalesce(a.p_partkey, b.p_partkey) AS p_partkey, a.p_size AS old, b.p_size AS new, floor((b.p_size - a.p_size) * 100.0 / a.p_size * 10 + 0.5) / 10 AS percent FROM a FULL JOIN b ON a.p_partkey = b.p_partkey""")
def compare_applications(read):
    p = read("part").select("p_partkey", F.col("p_size").cast("long").alias("p_size"))
    return maintenance.compared_values(p.where("p_partkey % 5 <> 0"), p.where("p_partkey % 4 <> 0").withColumn("p_size", F.col("p_size") + F.col("p_partkey") % 7), "p_partkey", "p_size")


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ordinal, conv_id || '-chunk-' || (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) AS chunk_id FROM conversations")
def chunk_vector_ids(read):
    return maintenance.chunk_ids(read("conversations"), "conv_id", [F.col("turn")]).select("conv_id", "turn", "ordinal", "chunk_id")


@query("SELECT p_partkey, CASE WHEN length(split_part(p_name, ' ', 2)) > length(split_part(p_name, ' ', 1)) THEN split_part(p_name, ' ', 2) ELSE split_part(p_name, ' ', 1) END AS term FROM part")
def significant_term(read):
    return read("part").select("p_partkey", maintenance.longest_word(F.col("p_name")).alias("term"))


@query("SELECT p_partkey, least(levenshtein(split_part(p_name, ' ', 1), 'gren'), levenshtein(split_part(p_name, ' ', 2), 'gren')) AS edits FROM part WHERE least(levenshtein(split_part(p_name, ' ', 1), 'gren'), levenshtein(split_part(p_name, ' ', 2), 'gren')) <= 2")
def fuzzy_match(read):
    return maintenance.fuzzy(read("part"), "p_name", "Gren").select("p_partkey", "edits")


@query("SELECT user_id, date_trunc('hour', ts) AS window_start, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit(read):
    from foliant.streaming.log import over_limit

    return over_limit(read("events"), "ts", "user_id", most=1, length="1 hour")


@query("""SELECT p_partkey, CASE WHEN p_size > 20 THEN '{"cat":"P","lux":' || p_size || '}' END AS horizontal, array_to_string(list_filter([p_name, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE p_type END, p_brand], lambda x: x <> ''), ' → ') AS full_name FROM part""")
def nested_projection(read):
    plane = F.when(F.col("p_size") > 20, F.struct(F.lit("P").alias("cat"), F.col("p_size").alias("lux"), (F.col("p_size") / 10).alias("fc")))
    rows = read("part").select("p_partkey", plane.alias("horizontal"), F.array_join(F.filter(F.array("p_name", F.when(F.col("p_partkey") % 2 == 0, "").otherwise(F.col("p_type")), "p_brand"), lambda x: F.coalesce(x, F.lit("")) != ""), " → ").alias("full_name"))
    return maintenance.in_units(rows, ["horizontal"], "lux").withColumn("horizontal", F.to_json("horizontal"))


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'LZ' || (p_size % 5) END AS zone, CASE WHEN p_partkey % 3 = 1 THEN 'RP-' || p_size END AS family FROM part""")
def inferred_filters(read):
    k, size = F.col("p_partkey") % 3, F.col("p_size")
    q = F.when(k == 0, F.concat(F.lit("plaza in lz "), (size % 5).cast("string"))).when(k == 1, F.concat(F.lit("what's new in rp-"), size.cast("string"), F.lit("?"))).otherwise(F.col("p_name"))
    return read("part").select("p_partkey", ids.lighting_zone(q).alias("zone"), ids.cited_family(q).alias("family"))


@query("""SELECT d.doc_id FROM documents d LEFT JOIN labels l USING (doc_id) WHERE coalesce(l.toxic, 0) <> 1 AND length(regexp_replace(d.text, '^\\s+|\\s+$', '', 'g')) >= 60
AND length(regexp_replace(d.text, '[^0-9]', '', 'g')) / length(d.text) <= 0.22 AND length(regexp_replace(d.text, '[^A-Za-z]', '', 'g')) / length(d.text) >= 0.45""")
def displayable_prose(read):
    d = read("documents").join(read("labels").select("doc_id", "toxic"), "doc_id", "left")
    return d.where((F.coalesce("toxic", F.lit(0)) != 1) & text.displayable(F.col("text"), F.lit("text"))).select("doc_id")


#: Criteria pages made of parts: four standards, pages of twenty rows below a heading; the rows say what the part's columns say.
PART_ROWS = """WITH a AS (SELECT *, 'RP-' || (p_partkey % 4 + 1) || '-22' AS standard, row_number() OVER (PARTITION BY p_partkey % 4 ORDER BY p_partkey) - 1 AS n FROM part),
r AS (SELECT standard, CAST(n // 20 + 1 AS INTEGER) AS page_number, n, p_size, 'Space ' || p_partkey || ' room' AS room FROM a),
k AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY standard, page_number) AS page_rows FROM r) WHERE page_rows >= 9) """


def _criteria_lines(read):
    parts = read("part").select(F.concat(F.lit("RP-"), (F.col("p_partkey") % 4 + 1).cast("string"), F.lit("-22")).alias("doc_id"), "p_partkey", "p_size")
    a = scans.running(parts, ["doc_id"], "p_partkey", {"n": ("sum", F.lit(1).cast("long"))}).withColumn("n", F.col("n") - 1)
    said = F.format_string("Space %d room T %s %d lx @ TS %d fc @ TS Avg", "p_partkey", F.when(F.col("p_size") > 25, "P").otherwise("M"), F.col("p_size") * 10, "p_size")
    page, line = (F.floor(F.col("n") / 20) + 1).cast("int"), lambda no, t, x: F.struct(no.cast("int").alias("line_no"), t.alias("text"), F.lit(x).alias("x"))
    # a page's heading comes with its first row
    lines = F.filter(F.array(F.when(F.col("n") % 20 == 0, line(F.lit(0), F.format_string("Hall %d", page), 70.0)), line(F.col("n") % 20 + 1, said, 78.0)), lambda v: v.isNotNull())
    rows = a.select("doc_id", page.alias("page"), F.inline(lines))
    return rows.select("doc_id", "page", "line_no", "text", "x", (F.col("line_no") * 10.0 + 20).alias("y"), F.lit(7.5).alias("font_size"), F.lit(False).alias("bold"), F.lit(792.0).alias("page_width"), F.lit(612.0).alias("page_height"))


@query(PART_ROWS + """SELECT standard, page_number, 'Hall ' || page_number AS sub_category, room AS app, 'Task' AS area_or_task, CASE WHEN p_size > 25 THEN 'P' ELSE 'M' END AS hor_cat, CAST(p_size * 10 AS DOUBLE) AS hor_lux, CAST(p_size AS DOUBLE) AS hor_fc,
'Avg' AS hor_basis, CASE WHEN p_size > 25 THEN 1 ELSE 0 END AS tm24_eligible FROM k""")
def extract_rows(read):
    return criteria.extract(_criteria_lines(read)).select("standard", "page_number", "sub_category", "app", "area_or_task", "hor_cat", "hor_lux", "hor_fc", "hor_basis", "tm24_eligible")


@query(PART_ROWS + """, p AS (SELECT standard, page_number, count(*) AS hits FROM r GROUP BY ALL)
SELECT standard AS doc_id, CAST(sum(hits) AS BIGINT) AS row_hits, count(*) FILTER (hits >= 3) AS criteria_pages, CASE WHEN sum(hits) >= 5 AND count(*) FILTER (hits >= 3) >= 1 THEN 'NEW_TABLE' ELSE 'STANDARD' END AS structure FROM p GROUP BY standard""")
def classify_structure(read):
    return extraction.classify(_criteria_lines(read)).select("doc_id", "row_hits", "criteria_pages", "structure")


@query(PART_ROWS + """SELECT standard, count(*) AS total, count(*) AS hor_lux, CAST(0 AS BIGINT) AS ver_lux, count(*) AS hor_cat, count(*) AS app, count(*) AS page, CAST(0 AS BIGINT) AS footnotes, count(*) FILTER (p_size > 25) AS tm24, count(*) AS any_lux, CAST(0 AS BIGINT) AS gaps, true AS passed FROM k GROUP BY standard""")
def extraction_report(read):
    return extraction.extraction_report(criteria.extract(_criteria_lines(read)))


@query(PART_ROWS + """SELECT standard, page_number, room || '. ' || room || '. Hall ' || page_number || ' ' || room || '. task. indoor. standard ' || standard AS description FROM k""")
def embed_description(read):
    return criteria.extract(_criteria_lines(read)).select("standard", "page_number", extraction.embed_text().alias("description"))


@query("""SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber) = 1""")
def first_per_code(read):
    return relational.newest_per(read("lineitem").select("l_partkey", "l_orderkey", "l_linenumber"), ["l_partkey"], [F.col("l_orderkey"), F.col("l_linenumber")])


@query("SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 THEN 'VIP' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def allowed_patch(read):
    c = read("customer").select("c_custkey", "c_name", "c_mktsegment")
    return changes.patch(c, F.col("c_custkey") % 3 == 0, {"c_mktsegment": "VIP", "c_name": "not allowed", "admin": True}, ["c_mktsegment"])


@query("""WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '<b>' WHEN 1 THEN '"a" & ' WHEN 2 THEN 'it' || chr(39) || 's ' ELSE '' END || event_type AS x FROM events)
SELECT event_id, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, replace(x, chr(39), chr(39) || chr(39)) AS sql FROM t""")
def escapes(read):
    marks = F.element_at(F.array(*[F.lit(x) for x in ("<b>", '"a" & ', "it's ", "")]), (F.col("event_id") % 4 + 1).cast("int"))
    x = F.concat(marks, "event_type")
    return read("events").select("event_id", text.html_escaped(x).alias("html"), text.sql_escaped(x).alias("sql"))


@query("""SELECT p_partkey, 'cache:emb:m1:' || sha256(p_name) AS emb, 'cache:search:s2:v3:' || sha256('{"limit":' || p_size || ',"query":"' || p_name || '"}') AS search,
'cache:ai:s2:v3:' || sha256('m1' || chr(10) || p_name || chr(10) || p_brand || ',,' || p_type) AS ai FROM part""")
def cache_keys(read):
    lit = lambda *xs: [F.lit(x) for x in xs]
    codes = F.array("p_brand", F.lit(None).cast("string"), "p_type")
    return read("part").select(
        "p_partkey", reports.embedding_key(F.lit("m1"), F.col("p_name")).alias("emb"), reports.search_key(*lit("s2", "v3"), {"query": F.col("p_name"), "limit": F.col("p_size")}).alias("search"),
        reports.summary_key(*lit("s2", "v3", "m1"), F.col("p_name"), codes).alias("ai"),
    )


@query("""SELECT p_brand, p_type, n, target FROM (SELECT p_brand, p_type, count(*) AS n, max(p_size) AS target, row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, max(p_size) DESC, p_type) AS k FROM part GROUP BY p_brand, p_type) WHERE k = 1""")
def shared_space_task(read):
    return reports.governing_task(read("part"), "p_brand", "p_type", "p_size").select("p_brand", "p_type", "n", "target")
