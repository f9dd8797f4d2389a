"""Removal of word windows that documents share, by an FM-index per shard.

Each word of a document that is covered by a window of ``WINDOW`` (13) words which also starts
in a document with a smaller id is removed; windows are judged on the input.

A shard must see all windows it is to compare, and a document must not meet all shards. So windows
go by their anchor, the least of the hashes of their runs of ``GRAM`` (5) words: equal windows have
equal anchors. Neighbouring windows mostly have the same one, and such a run of windows is a piece (13 to 21 words).

1. Anchors that one document alone has are done: only ids and hashes are shuffled to find them.
2. The others' pieces are cut from the texts. Equal pieces become one, with the smallest id; an anchor with more than
   ``CROWD`` pieces (a phrase within ever different words) has these cut into windows, which go by their own hash; what is
   found for them comes back to the piece, and other anchors' pieces and the documents' rows are not written again.
3. A shard (``SHARD`` words on average) builds an FM-index of its pieces and streams them through it from their ends. Where
   the matching statistics reach 13 words, the rows found are all that start with the window: the
   smallest id among these rows is the window's.
4. A document loses the windows whose id is smaller than its own; what covers its words comes back to it by id.

Hashes choose who meets whom; the words decide. Many copies of a piece are one row of the index, and joins
on pieces are plain joins, which adaptive execution may split.

Edge cases: null is an empty text. Rows with one id (repeated rows, or other texts under it) take nothing from one another.
A null id is neither smaller nor larger than another: such rows lose nothing and take nothing. Texts under 13 words
lose nothing; long ones are no more than rows of many windows. An empty table gives no rows; further columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, materialize, utf8
from foliant.llm.fm_index import FmIndex

WINDOW, GRAM = 13, 5
SHARD, CROWD = 300_000, 20_000
SLICE = 4 << 20
LOW = np.uint64((1 << 26) - 1)


def gram_hashes(word: np.ndarray, gram: int) -> np.ndarray:
    """Hash of the run of ``gram`` words from each word on, of 64-bit hashes of words."""
    n = word.size - gram + 1
    h = np.zeros(max(0, n), np.uint64)
    for j in range(gram):
        h = (h ^ word[j : j + h.size]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
    return h


def pieces(each: list[list[bytes]], window: int, gram: int) -> tuple[np.ndarray, ...]:
    """(text, first window, last window, anchor) of the runs of windows with one anchor; places count within the text."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    code = np.fromiter((i for w in each for i in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
    n = code.size - window + 1
    if n <= 0:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    hashed = np.fromiter(map(xxhash.xxh64_intdigest, ids), np.uint64, len(ids))
    g = gram_hashes(hashed[code], gram)
    low = (g & ~LOW) | np.arange(g.size, dtype=np.uint64)
    least = low[:n]
    for k in range(1, window - gram + 1):
        least = np.minimum(least, low[k : k + n])
    of = np.repeat(np.arange(sizes.size), sizes)
    windows = np.flatnonzero(of[:n] == of[window - 1 :])
    if not windows.size:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = (least[windows] & LOW).astype(np.int64)
    doc = of[windows]
    new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])])
    first, last = windows[new], windows[np.r_[new[1:] - 1, windows.size - 1]]
    start = (np.cumsum(sizes) - sizes)[doc[new]]
    return doc[new], first - start, last - start, g[at[new]]


def words_of(column: pa.Array) -> list[list[bytes]]:
    return [t.split() for t in utf8(column)]  # bytes.split() knows just the six ASCII spaces


def _anchors(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        of, _, _, anchor = pieces(words_of(batch.column(1)), window, gram)
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        both = np.unique(np.stack([anchor.view(np.int64), ids[of]]), axis=1) if of.size else np.empty((2, 0), np.int64)
        return pa.RecordBatch.from_arrays([pa.array(both[0]), pa.array(both[1])], ["anchor", "doc_id"])

    return map_arrow(docs.select("doc_id", "text"), run, "anchor long, doc_id long", most_bytes=SLICE)


def _cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """A row for each piece of ``docs`` (doc_id, h, text, anchors) whose anchor is among the slice's anchors."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = words_of(batch.column(2))
        of, first, last, anchor = pieces(each, window, gram)
        keep = np.flatnonzero(np.isin(anchor.view(np.int64), batch.column(3).flatten().to_numpy()))
        of, first, last, anchor = of[keep], first[keep], last[keep], anchor[keep]
        texts = [b" ".join(each[d][a:b]) for d, a, b in zip(of.tolist(), first.tolist(), (last + window).tolist(), strict=True)]
        take = pa.array(of)
        arrays = [pa.array(texts, pa.binary()).cast(pa.string()), pa.array(anchor.view(np.int64)), batch.column(0).take(take), batch.column(1).take(take), pa.array(first.astype(np.int32)), pa.array((last - first).astype(np.int32))]
        return pa.RecordBatch.from_arrays(arrays, ["piece", "route", "doc_id", "h", "first", "more"])

    return map_arrow(docs.select("doc_id", "h", "text", "anchors"), run, "piece string, route long, doc_id long, h long, first int, more int", most_bytes=SLICE)


def _by_window(crowded: DataFrame, window: int) -> DataFrame:
    """The windows of distinct pieces: keys of the piece, its number of windows less one, place in it, words and smallest id."""
    each = _keyed(crowded).select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), "low", "more", F.split("piece", " ").alias("w"), F.explode(F.sequence(F.lit(0), F.col("more"))).alias("at"))
    return each.select("p1", "p2", "more", "at", F.array_join(F.slice("w", F.col("at") + 1, window), " ").alias("piece"), "low")


def _of_pieces(windows: DataFrame, least: DataFrame) -> DataFrame:
    """k1, k2, least of the pieces that ``windows`` are of, but those of one window: these have its keys, and so a row in ``least``."""
    found = _keyed(windows.where("more > 0")).join(least, ["k1", "k2"]).select("p1", "p2", F.struct("at", F.col("least")[0].alias("x")).alias("found"))
    return found.groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.expr("transform(array_sort(collect_list(found)), f -> f.x)").alias("least"))


def least_ids(texts: list[list[bytes]], ids: np.ndarray, window: int) -> list[np.ndarray]:
    """For each text the smallest id, of any text, that has the window starting at each place but the last ``window - 1``."""
    numbers: dict[bytes, int] = defaultdict(count(1).__next__)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    word = np.fromiter((i for w in texts for i in map(numbers.__getitem__, w)), np.int64, int(sizes.sum()))
    ends = np.cumsum(sizes)
    indexed = np.insert(word, ends, 0)
    index = FmIndex(indexed, window)
    owner = np.repeat(ids, sizes + 1)[index.forget_places()]
    starts = index.rows_of(window)[:-1]
    least = np.minimum.reduceat(owner, starts) if starts.size else owner
    matched, row = index.matching(word, ends)
    group = np.searchsorted(starts, row, "right") - 1
    out = np.where(matched == window, least[group] if least.size else 0, np.iinfo(np.int64).max)
    return [x[: x.size - window + 1] for x in np.split(out, ends[:-1])] if len(texts) else []


def _search(distinct: DataFrame, window: int) -> DataFrame:
    """k1, k2, least: for each distinct piece the smallest id of each of its windows."""

    def run(shard: pa.Table) -> pa.Table:
        texts = words_of(shard["piece"].combine_chunks())
        found = least_ids(texts, shard["low"].to_numpy(), window)
        return pa.table({"k1": shard["k1"], "k2": shard["k2"], "least": pa.array(found, pa.list_(pa.int64()))})

    words = distinct.agg(F.sum(F.col("more") + window)).first()[0] or 0
    sharded = _keyed(distinct).withColumn("shard", F.pmod("route", F.lit(1 + words // SHARD)))
    return materialize(sharded.groupBy("shard").applyInArrow(run, "k1 long, k2 long, least array<long>"))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"k1": F.xxhash64("piece"), "k2": F.xxhash64(F.lit(1), "piece")})


def shared_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, h (hash of the text) and starts: where windows begin that a document with a smaller id has too."""
    docs = docs.where("doc_id is not null and text is not null").select("doc_id", F.xxhash64("text").alias("h"), "text")
    anchors = materialize(_anchors(docs, window, gram))
    shared = materialize(anchors.groupBy("anchor").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).where("a < b").select("anchor"))
    wanted = materialize(anchors.join(shared, "anchor").groupBy("doc_id").agg(F.collect_set("anchor").alias("anchors")))
    discard(anchors, shared)
    cut = materialize(_cut(docs.join(wanted, "doc_id"), window, gram))
    discard(wanted)
    distinct = materialize(cut.groupBy("piece", "route").agg(F.min("doc_id").alias("low"), F.max("more").alias("more")))
    crowded = materialize(distinct.groupBy("route").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CROWD).select("route"))
    if crowded.limit(1).count():
        windows = materialize(_by_window(distinct.join(crowded, "route"), window))
        alone = materialize(windows.groupBy("piece").agg(F.min("low").alias("low")).select("piece", F.xxhash64("piece").alias("route"), "low", F.lit(0).alias("more")))
        written = [_search(distinct.join(crowded, "route", "left_anti"), window), _search(alone, window), windows]
        discard(alone)
        least = written[0].unionByName(written[1]).unionByName(_of_pieces(windows, written[1]))
    else:
        written = [least := _search(distinct, window)]
    discard(distinct, crowded)
    placed = _keyed(cut).drop("piece", "route", "more").join(least, ["k1", "k2"])
    lost = placed.select("doc_id", "h", F.expr("filter(transform(least, (x, i) -> if(x < doc_id, first + i, null)), x -> x is not null)").alias("starts"))
    out = materialize(lost.where(F.size("starts") > 0).groupBy("doc_id", "h").agg(F.flatten(F.collect_list("starts")).alias("starts")))
    discard(cut, *written)
    return out


def spans(n_words: int, starts: np.ndarray, window: int) -> np.ndarray:
    """(start, length) of the stretches that windows cover."""
    change = np.zeros(n_words + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + window, -1)
    covered = np.concatenate([[False], np.cumsum(change[:-1]) > 0, [False]])
    edges = np.flatnonzero(covered[1:] != covered[:-1])
    return np.stack([edges[::2], edges[1::2] - edges[::2]], axis=1)


SPANS = "array<struct<start: long, length: long>>"


def remove_shared_windows(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """doc_id, n_words, n_removed, spans (of words that go) and kept (the words that stay, joined by a space) for each row of ``docs``."""
    lost = shared_windows(docs, window, gram).withColumnRenamed("doc_id", "id")
    own = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    joined = own.join(lost, (own["doc_id"] == lost["id"]) & (own["hash"] == lost["h"]), "left").select("doc_id", "text", "starts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows: list[tuple] = []
        for w, starts in zip(words_of(batch.column(1)), batch.column(2), strict=True):
            cut = spans(len(w), starts.values.to_numpy(), window).tolist() if starts.is_valid else []
            kept, at = [], 0
            for start, length in cut:
                kept += w[at:start]
                at = start + length
            kept += w[at:]
            rows.append((len(w), len(w) - len(kept), [{"start": a, "length": b} for a, b in cut], b" ".join(kept)))
        n, removed, cut, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
        span = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(cut, span), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "spans", "kept"])

    return map_arrow(joined, run, f"doc_id long, n_words long, n_removed long, spans {SPANS}, kept string", most_bytes=SLICE)


def op11(spark, sf_dir: str) -> DataFrame:
    got = remove_shared_windows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
win AS (SELECT r, doc_id, i, array_to_string(w[i:i + 12], ' ') AS words FROM (SELECT r, doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)),
low AS (SELECT words, min(doc_id) AS low FROM win GROUP BY words),
gone AS (SELECT DISTINCT r, i + k AS i FROM win JOIN low USING (words), (SELECT unnest(range(13)) AS k) WHERE low < doc_id),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY i) AS kept, count(*) AS n FROM (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d) ANTI JOIN gone USING (r, i) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (r)
"""
