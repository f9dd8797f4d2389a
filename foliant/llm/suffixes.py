"""Removal of byte strings that documents share, by prefix doubling over sampled positions.

Each byte of a document that is covered by a string of ``SPAN`` (50) bytes that also starts
in a document with a smaller id is removed. Names (ranks) of strings double: a 25-byte name
is a hash of its bytes, the pair of the names at i and i + 25 names 50 bytes. Sorting every
position of the corpus by such pairs would shuffle some 30 times the input, so positions are
sampled without loss first:

* Every 50-byte window has 26 positions of 25-byte names; the smallest (leftmost among equal
  ones) is its anchor. Equal windows have equal anchors, so it is enough to sort anchors,
  about one in 13 positions. Anchors whose name only one document has are done.
* An anchor stands for the run of windows that chose it, 26 at most. A run that a smaller
  document has as a whole is removed. If documents have different runs at one anchor, the
  runs fall into parts of up to seven windows (whose cores, the bytes that all windows of a
  part have, must be shared), and what parts leave open falls into windows.
* At each of the three levels the smallest document that has a name decides, and what no
  other document can match drops out.

Whole copies of a text need none of this: their bytes go at once. Frequent strings aggregate
before they are shuffled, and joins on them are split by AQE. Names of runs, parts and
windows have 128 bits. A Bloom filter of the shared anchors, where it fits in ``BLOOM`` bytes, keeps
other anchors out of the second shuffle; where it does not, they are shuffled and joined.

Edge cases: null is an empty text. Texts under 50 bytes lose nothing. Rows that repeat
with id and text have equal results, and do not count as copies of one another. If ids are
null, or the same id stands with different texts, these rows are taken for documents in the
order of (id, text hash), null first. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, materialize, n_rows, utf8
from foliant.llm.ordering import running_offsets

SPAN, HALF = 50, 25
WIDTH = SPAN - HALF + 1  # positions of 25-byte names in a window
PIECE = 4 << 20
LOW = np.uint64((1 << 26) - 1)
PART = 7  # windows of a part
BLOOM = 64 << 20
COPIES = 2_000_000  # ids of whole copies that are broadcast at most


def names(data: np.ndarray) -> np.ndarray:
    """64-bit names of the 25 bytes at each position."""
    n = data.size - HALF + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    raw, words = data.tobytes() + bytes(16), np.empty(data.size, np.uint64)
    for j in range(min(8, data.size)):
        own = words[j::8]
        own[:] = np.frombuffer(raw, "<u8", own.size, j)
    h = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for at, factor in ((8, 0xC2B2AE3D27D4EB4F), (16, 0x165667B19E3779F9), (17, 0x27D4EB2F165667C5)):
        h ^= h >> np.uint64(31)
        h += words[at : at + n]
        h *= np.uint64(factor)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def mixed(*parts: np.ndarray) -> np.ndarray:
    h = np.zeros(parts[0].size, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xFF51AFD7ED558CCD)
        h ^= h >> np.uint64(32)
    return h


def runs(texts: list[bytes], wanted=None):
    """(text number, anchor's name, run's name, first and last window, anchor's place after the first), arrays, piece by piece.

    ``wanted`` tells which anchors' names matter; without it only text numbers and anchors' names are given.
    """
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    whole = np.frombuffer(b"".join(texts), np.uint8)
    for a in range(0, max(0, whole.size - SPAN + 1), PIECE):
        data = whole[a : a + PIECE + SPAN - 1]
        g = names(data)
        n = data.size - SPAN + 1  # windows
        low = (g & ~LOW) | np.arange(g.size, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            low = np.minimum(low[:-step], low[step:])
        low = np.minimum(low[:n], low[WIDTH - 16 : WIDTH - 16 + n])
        inside = np.ones(n, bool)
        for s in starts[(starts > a) & (starts < a + n + SPAN)]:  # windows over the border of two texts
            inside[max(0, s - a - SPAN + 1) : max(0, s - a)] = False
        windows = np.flatnonzero(inside)
        if not windows.size:
            continue
        at = (low[windows] & LOW).astype(np.int64)
        new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (windows[1:] != windows[:-1] + 1)])
        first, last, p = windows[new], windows[np.r_[new[1:] - 1, windows.size - 1]], at[new]
        if wanted is not None:
            keep = wanted(g[p])
            first, last, p = first[keep], last[keep], p[keep]
        of = np.searchsorted(starts, first + a, side="right") - 1
        if wanted is None:
            yield of, g[p]
        elif p.size:
            yield of, g[p], named(g, first, last, p), first + a - starts[of], last - first, p - first


def named(g: np.ndarray, first: np.ndarray, last: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Names of runs of windows, by the pairs of names that begin and end them, and their place at the anchor."""
    return mixed(g[first], g[first + HALF], g[last], g[last + HALF], p - first, last - first)


def _batch(columns: list, names_: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.view(np.int64) if c.dtype == np.uint64 else c) for c in columns], names_)


def _anchors(docs: DataFrame) -> DataFrame:
    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, got = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), list(runs(utf8(batch.column(1))))
        if not got:
            return None
        of, name = (np.concatenate(x) for x in zip(*got, strict=True))
        return _batch([name, ids[of]], ["name", "id"])

    return map_arrow(docs, rows, "name long, id long", most_bytes=PIECE)


FIELDS = ["core", "full", "id", "first", "more", "lead"]
ROWS = "core long, full long, id long, first int, more byte, lead byte"


def _runs(docs: DataFrame, bloom=None) -> DataFrame:
    """A row for each run whose anchor may be shared; its core is the anchor's name."""

    def wanted(name: np.ndarray) -> np.ndarray:
        return np.ones(name.size, bool) if bloom is None else may_hold(bloom.value, name)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        ids, got = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), list(runs(utf8(batch.column(1)), wanted))
        if not got:
            return None
        of, name, run, first, more, lead = (np.concatenate(x) for x in zip(*got, strict=True))
        return _batch([name, run, ids[of], first.astype(np.int32), more.astype(np.int8), lead.astype(np.int8)], FIELDS)

    return map_arrow(docs, rows, ROWS, most_bytes=PIECE)


def may_hold(bits: np.ndarray, name: np.ndarray) -> np.ndarray:
    """Whether the names' four bits are set, all of them in one block of 64 bits. ``bits`` has a power of two of blocks."""
    h = mixed(name)
    block = bits[(h >> np.uint64(65 - bits.size.bit_length())).astype(np.int64)]
    mask = block_mask(h)
    return block & mask == mask


def block_mask(name: np.ndarray) -> np.ndarray:
    mask = np.zeros(name.size, np.uint64)
    for k in range(4):
        mask |= np.uint64(1) << ((name >> np.uint64(6 * k)) & np.uint64(63))
    return mask


def bloom_of(names_: DataFrame, n: int) -> np.ndarray:
    """A Bloom filter of ``n`` names, 16 bits or more each: Spark ORs the blocks, whose number is the driver's only input."""
    log2 = max(6, (n // 4).bit_length())

    def blocks(batch: pa.RecordBatch) -> pa.RecordBatch:
        h = mixed(batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64))  # anchors' names are small: they were minima
        return _batch([(h >> np.uint64(64 - log2)).astype(np.int64), block_mask(h)], ["block", "mask"])

    table = map_arrow(names_.select("name"), blocks, "block long, mask long").groupBy("block").agg(F.bit_or("mask").alias("mask")).toArrow()
    bits = np.zeros(1 << log2, np.uint64)
    bits[table["block"].to_numpy()] = table["mask"].to_numpy().view(np.uint64)
    return bits


def _split(docs: DataFrame, open_: DataFrame, cells: bool) -> DataFrame:
    """What the open runs of a document fall into: parts, or single windows (core and full are a window's pair of names then)."""
    of = open_.groupBy("id").agg(F.collect_list(F.struct("first", "more", "lead")).alias("runs"))

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for i, text, own in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), batch.column(2), strict=True):
            first, more, lead = (own.values.field(k).to_numpy().astype(np.int64) for k in ("first", "more", "lead"))
            g, n = names(np.frombuffer(text, np.uint8)), more + 1
            at = np.repeat(first, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            p = np.repeat(first + lead, n)
            if cells:
                cell = (p - at) // PART
                new = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (cell[1:] != cell[:-1]) | (at[1:] != at[:-1] + 1)])
                a, b, p = at[new], at[np.r_[new[1:] - 1, at.size - 1]], p[new]
                near = p - cell[new] * PART  # the last window that the part can have; its first is PART - 1 before
                core, full = mixed(g[near], g[near - PART + 1 + HALF], p - near), named(g, a, b, p)
                more_, lead_ = b - a, p - a
            else:
                a, core, full = at, g[at], g[at + HALF]
                more_ = lead_ = np.zeros(at.size, np.int64)
            out.append((core, full, np.full(a.size, i, np.int64), a.astype(np.int32), more_.astype(np.int8), lead_.astype(np.int8)))
        return _batch([np.concatenate(x) for x in zip(*out, strict=True)], FIELDS) if out else None

    return map_arrow(docs.join(of, "id").select("id", "text", "runs"), rows, ROWS, most_bytes=PIECE)


def _level(rows: DataFrame, last: bool = False) -> DataFrame:
    """id, first, more, lead, gone: what is decided or still open at one level."""
    rows = materialize(rows)
    least = rows.groupBy("core", "full").agg(F.min("id").alias("low"))
    if last:
        out = materialize(rows.join(least, ["core", "full"]).where("low < id").select("id", "first", "more", "lead", F.lit(True).alias("gone")))
        discard(rows)
        return out
    least = materialize(least)
    # another document has the core but not the same name: only then can anything be open
    torn = materialize(least.groupBy("core").agg(F.min("low").alias("a"), F.max("low").alias("b")).where("a < b").select("core", F.lit(True).alias("torn")))
    marked = rows.join(least, ["core", "full"]).join(torn, "core", "left").where("low < id or torn")
    out = materialize(marked.select("id", "first", "more", "lead", (F.col("low") < F.col("id")).alias("gone")))
    discard(rows, least, torn)
    return out


def shared_spans(docs: DataFrame) -> DataFrame:
    """(id, text) with unique ids and no whole copies -> (id, spans: array of the first window and number of further ones to remove)."""
    spark = docs.sparkSession
    seen = _anchors(docs).groupBy("name").agg(F.min("id").alias("low"), F.max("id").alias("high"))
    common = materialize(seen.where("low < high").select("name"))
    n = n_rows(common)
    if 4 * n <= BLOOM:
        found = _runs(docs, spark.sparkContext.broadcast(bloom_of(common, n)))
    else:
        found = _runs(docs).join(common.withColumnRenamed("name", "core"), "core").select(*FIELDS)
    one = _level(found)
    discard(common)
    two = _level(_split(docs, one.where("not gone"), True))
    three = _level(_split(docs, two.where("not gone"), False), last=True)
    spans = one.unionByName(two).unionByName(three).where("gone")
    out = materialize(spans.groupBy("id").agg(F.collect_list(F.struct("first", "more")).alias("spans")))
    discard(one, two, three)
    return out


def remove_shared(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (bytes): one row per row of ``docs``."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    keyed = plain.select("doc_id", F.xxhash64("text").alias("h"))
    odd = keyed.groupBy("doc_id").agg(F.min("h").alias("a"), F.max("h").alias("b")).where("doc_id is null or a <> b").limit(1).count()
    if odd:
        distinct = keyed.distinct().withColumn("one", F.lit(1).cast("long"))
        ids = materialize(running_offsets(distinct, [F.col("doc_id").asc_nulls_first(), F.col("h").asc()], "one", "id").drop("one"))
        marked = plain.withColumn("h", F.xxhash64("text"))
        units = materialize(marked.join(ids, marked["doc_id"].eqNullSafe(ids["doc_id"]) & (marked["h"] == ids["h"])).select("id", marked["doc_id"], "text"))
    else:
        units = plain.withColumn("id", F.col("doc_id"))
    hashed = units.select("id", F.xxhash64("text").alias("h"), F.crc32(F.encode("text", "UTF-8")).alias("h2"), F.length("text").alias("h3"))
    first = hashed.groupBy("h", "h2", "h3").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n")).where("n > 1")
    copies = materialize(hashed.join(first, ["h", "h2", "h3"]).where("low < id").select(F.col("id").alias("copy")).distinct())
    few = n_rows(copies) <= COPIES
    other = F.broadcast(copies) if few else copies
    spans = shared_spans(units.join(other, F.col("id") == F.col("copy"), "left_anti").select("id", "text"))
    cut = spans.unionByName(copies.select(F.col("copy").alias("id"), F.array(F.struct(F.lit(0).alias("first"), F.lit(-1).cast("byte").alias("more"))).alias("spans")))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text, spans in zip(utf8(batch.column(1)), batch.column(2), strict=True):
            if not spans.is_valid:
                rows.append((len(text), 0, 0, text))
                continue
            at, more = (spans.values.field(k).to_numpy().astype(np.int64) for k in ("first", "more"))
            if more[0] < 0:  # a whole copy
                at, more = (np.zeros(1, np.int64), np.array([len(text) - SPAN])) if len(text) >= SPAN else (at[:0], more[:0])
            change = np.zeros(len(text) + 1, np.int64)
            np.add.at(change, at, 1)
            np.add.at(change, at + more + SPAN, -1)
            gone = np.cumsum(change[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
            rows.append((len(text), int(gone.sum()), int(gone[:1].sum()) + int(np.count_nonzero(gone[1:] & ~gone[:-1])), kept))
        n, removed, count, kept = zip(*rows, strict=True) if rows else ([], [], [], [])
        return pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n, removed, count)), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    joined = units.join(cut, "id", "left").select("doc_id", "text", "spans")
    return map_arrow(joined, run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary", most_bytes=PIECE)


def op5(spark, sf_dir: str) -> DataFrame:
    got = remove_shared(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
