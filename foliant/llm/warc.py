"""Merkle fixity audit of WARC replicas.

Records are hashed and laid out at byte offsets in the archive's order. The offsets are cut into
ranges before records whose own hash says so (one in ``LEAF``), so two replicas that were laid out each by
itself cut alike, and a lost or lengthened record changes its own range alone. A leaf's digest
covers its records' digests in order; of the marks between leaves one in ``FANOUT`` is also one
between nodes of the next level, and so on up to the root. Two replicas compare roots and then
only the children of nodes that differ; in leaves that differ the records themselves tell what
is corrupt, missing or extra.

Leaves hold LEAF records on average and nodes FANOUT children; records that repeat wholly count
as one there. No group grows with the data.

Edge cases: null urls and payloads are empty ones. Null ids come first in the layout.
Records that repeat lie at offsets of their own; of those with one page_id, equal ones pair
off first and the rest in order. Empty replicas have the same (no) root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.llm.common import materialize, n_rows
from foliant.llm.ordering import last_marks, running_offsets

LEAF, FANOUT = 64, 16
FIRST = -1 << 63  # what lies before all marks


def warc_record(url: Column, payload: Column) -> Column:
    """A WARC/1.0 response record as text."""
    url, payload = F.coalesce(url, F.lit("")), F.coalesce(payload, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, payload, F.lit("\r\n\r\n"))


def lay_out(pages: DataFrame) -> DataFrame:
    """page_id, url, html -> page_id, byte_offset, n_bytes, digest: the archive's manifest."""
    record = warc_record(F.col("url"), F.col("html"))
    rows = pages.select("page_id", F.sha2(record, 256).alias("digest"), F.octet_length(record).cast("long").alias("n_bytes"))
    return running_offsets(rows, [F.col("page_id").asc_nulls_first(), F.col("digest").asc()], "n_bytes", "byte_offset")


def tree(records: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> tuple[DataFrame, list[DataFrame]]:
    """A manifest -> its rows with their leaf (``node``), and levels (node, up, digest) from the leaves to the root; up is the parent."""
    mark = F.xxhash64("page_id", "digest")
    marked = last_marks(records.withColumn("mark", F.when(F.pmod(mark, F.lit(leaf)) == 0, mark)), [F.col("byte_offset")], "mark", "node").drop("mark")
    marked = materialize(marked.withColumn("node", F.coalesce("node", F.lit(FIRST))))
    each = marked.groupBy("node", "digest").agg(F.min("byte_offset").alias("at"), F.count(F.lit(1)).alias("n"))
    entry = F.struct("at", F.concat_ws(":", F.col("n").cast("string"), "digest").alias("of"))
    level = each.groupBy("node").agg(F.min("at").alias("at"), F.sha2(F.array_join(F.array_sort(F.collect_list(entry))["of"], ","), 256).alias("digest"))
    levels, step = [], leaf
    while True:
        step *= fanout
        up = F.when((F.col("node") != FIRST) & (F.pmod("node", F.lit(step)) == 0), F.col("node"))
        level = materialize(last_marks(level.withColumn("mark", up), [F.col("at")], "mark", "up").drop("mark").withColumn("up", F.coalesce("up", F.lit(FIRST))))
        levels.append(level)
        if n_rows(level) <= 1:
            return marked, levels
        level = level.groupBy(F.col("up").alias("node")).agg(F.min("at").alias("at"), F.sha2(F.array_join(F.array_sort(F.collect_list(F.struct("at", "digest")))["digest"], ","), 256).alias("digest"))


def audit(a: DataFrame, b: DataFrame, leaf: int = LEAF, fanout: int = FANOUT) -> DataFrame:
    """Manifests (page_id, byte_offset, n_bytes, digest) of two replicas -> page_id, byte_offset, n_bytes, status.

    Offset and size are those of the first replica, of ``extra`` records those of the second.
    """
    (a, ours), (b, theirs) = tree(a, leaf, fanout), tree(b, leaf, fanout)
    for low, high in ((ours, theirs), (theirs, ours)):  # a lower tree: its root stands alone on the levels above
        while len(low) < len(high):
            low[-1] = low[-1].withColumn("up", F.col("node"))
            low.append(low[-1])
    suspects = None
    for x, y in zip(reversed(ours), reversed(theirs), strict=True):
        if suspects is not None:
            x, y = (level.join(suspects.select(F.col("node").alias("up")), "up", "left_semi") for level in (x, y))
        both = x.select("node", F.col("digest").alias("ours")).join(y.select("node", F.col("digest").alias("theirs")), "node", "full")
        suspects = materialize(both.where(~F.col("ours").eqNullSafe(F.col("theirs"))).select("node"))
    near = lambda r: r.join(suspects, "node", "left_semi").withColumn("m", F.row_number().over(Window.partitionBy("page_id", "digest").orderBy("byte_offset")))
    x, y = materialize(near(a)), materialize(near(b))
    alone = lambda r, o, end: r.join(o.select(F.col("page_id").alias("id"), F.col("digest").alias("d"), F.col("m").alias("k")), F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("d")) & (F.col("m") == F.col("k")), "left_anti").select(
        F.col("page_id").alias(f"id{end}"), F.col("byte_offset").alias(f"at{end}"), F.col("n_bytes").alias(f"n{end}"), F.row_number().over(Window.partitionBy("page_id").orderBy("byte_offset")).alias(f"r{end}"))
    p, q = alone(x, y, 1), alone(y, x, 2)
    found = p.join(q, F.col("id1").eqNullSafe(F.col("id2")) & (F.col("r1") == F.col("r2")), "full")
    status = F.when(F.col("at2").isNull(), "missing").when(F.col("at1").isNull(), "extra").otherwise("corrupt")
    return found.select(F.coalesce("id1", "id2").alias("page_id"), F.coalesce("at1", "at2").alias("byte_offset"), F.coalesce("n1", "n2").alias("n_bytes"), status.alias("status"))


def op2(spark, sf_dir: str) -> DataFrame:
    """``pages`` against a replica in which every 97th page's payload is longer by a sign and every 211th is lost; each is laid out by itself."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    hit = lambda m, k: F.coalesce(F.pmod("page_id", F.lit(m)) == k, F.lit(False))
    replica = pages.where(~hit(211, 3)).withColumn("html", F.when(hit(97, 5), F.concat(F.coalesce("html", F.lit("")), F.lit("!"))).otherwise(F.col("html")))
    return audit(lay_out(pages), lay_out(replica))


OP2_SQL = r"""
WITH r AS (
  SELECT page_id, strlen('WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '')
         || chr(13) || chr(10) || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10)
         || coalesce(html, '') || chr(13) || chr(10) || chr(13) || chr(10)) AS n_bytes
  FROM pages
), o AS (
  SELECT page_id, n_bytes, CAST(sum(n_bytes) OVER (ORDER BY page_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - n_bytes AS BIGINT) AS byte_offset FROM r
)
SELECT page_id, byte_offset, CAST(n_bytes AS BIGINT) AS n_bytes, CASE WHEN page_id % 211 = 3 THEN 'missing' ELSE 'corrupt' END AS status
FROM o WHERE page_id % 97 = 5 OR page_id % 211 = 3
"""
