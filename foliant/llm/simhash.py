"""SimHash near-duplicates with multi-index hashing.

A fingerprint's bits are the majority of its shingles' hashes. Segments of the fingerprint
are the keys of as many tables. Two fingerprints whose segments differ in one bit are found
by looking up, from the one that has the bit, the value without it; equal segments meet
directly: so a small Hamming ball around each segment is searched and complete distances
are verified. Equal texts and equal fingerprints collapse first, so hot groups of copies
cost one row.

Buckets that hold more than ``CAP`` fingerprints are not paired. For a distance of at most
two, an exact way takes over: fingerprints are within two bits if and only if their balls
of radius one meet, and a point of that space lies in at most 1 + bits such balls, so each
fingerprint sends its ball's points and the small groups give all links.

Near-duplicates by shingle similarity (``similar_components``) differ in many bits, which
segments find with a stated probability only (``segment_plan``). There a full bucket is first
compared with one representative; members of one component need no further comparison, and
only those that stay outside their bucket's main component are compared with the rest of it.
So a hot group costs a few rows a member, and no pair that meets in a bucket is left out.

Edge cases: a text without words has fingerprint zero and links like any other; null is an
empty text. Rows that repeat stay, each with its component. A component's id is its
smallest non-null doc_id (null if it has none). An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import discard, map_arrow, materialize, n_rows, utf8
from foliant.llm.graph import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
CAP = 48
ROUND = 4  # segments that are searched at once
RECALL, CHANCE = 0.99, 2.0  # of pairs at the least similarity; unrelated fingerprints that a bucket holds on average
DENSE = 8  # fingerprints of a bucket beyond which it is searched by complete distances
WORDS, SKETCH = 4, 57  # a fingerprint's first words that rows carry; bits of them that differ in a candidate at most (at 15 % each: 39, and 6 more or less)
HUBS = 2  # times that a bucket's members are compared with one of them, the best connected so far
PART = 1 << 16  # shingles that are remixed at once
WIDE = 16  # words whose bits are summed side by side


def shingle_hashes(text: bytes, n: int) -> np.ndarray:
    words = text.translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    whole, h = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= n:
        return np.array([h(whole, 42)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.fromiter((h(whole[a:b], 42) for a, b in zip(starts[: len(words) - n + 1].tolist(), ends[n - 1 :].tolist(), strict=True)), np.uint64, len(words) - n + 1)


def fingerprint(h: np.ndarray, n_words: int = 1) -> np.ndarray:
    """``n_words`` 64-bit words; the first is the plain SimHash, others come from remixed hashes."""
    side = max(1, WIDE // n_words)  # shingles whose bits lie side by side in a row
    ones = np.zeros(64 * n_words, np.int64)
    for at in range(0, h.size, PART):
        words = [h[at : at + PART]]
        while len(words) < n_words:
            x = (words[-1] ^ (words[-1] >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
            words.append(x ^ (x >> np.uint64(29)))
        rows = np.zeros((-(-words[0].size // side) * side, n_words), np.uint64)
        rows[: words[0].size] = np.stack(words, axis=1)
        rows = rows.reshape(-1, side * n_words).view(np.uint8)
        for k in range(0, len(rows), 255):  # as many as a byte can count
            ones += np.unpackbits(rows[k : k + 255], axis=1, bitorder="little").sum(axis=0, dtype=np.uint8).reshape(side, -1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > h.size, bitorder="little").view(np.uint64)


def segment_plan(n: int, least: float) -> tuple[int, int]:
    """Bits of a segment and number of segments for ``n`` fingerprints.

    Longer tables take longer segments, so that chance fills a bucket with ``CHANCE`` others, and so many more
    of them that a pair of similarity ``least`` meets in one (equal, or one bit apart) with probability ``RECALL``.
    """
    bits = max(18, math.ceil(math.log2(max(n, 1) / CHANCE)))
    p = math.acos(2 * least / (1 + least)) / math.pi  # equally large sets: the share of bits that differ
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, math.ceil(math.log(1 - RECALL) / math.log1p(-meet))


@cache
def _order(size: int, bits: int, count: int) -> np.ndarray:
    """The bits of ``count`` segments, a row each: all bits are shuffled (always alike) and cut, as often as it takes."""
    each = size // bits
    return np.concatenate([np.random.default_rng(k).permutation(size)[: each * bits] for k in range(-(-count // each))]).reshape(-1, bits)[:count]


def segments_of(fp: np.ndarray, bits: int, count: int) -> list[int]:
    """``count`` segments of ``bits`` bits."""
    flat = np.unpackbits(fp.view(np.uint8), bitorder="little")
    return (flat[_order(flat.size, bits, count)] @ (1 << np.arange(bits, dtype=np.int64))).tolist()


def fingerprints(docs: DataFrame, shingle: int = 3, n_words: int = 1, plan: tuple[int, int] | None = None) -> DataFrame:
    """doc_id, fp (array of 64-bit words), n (shingles), h (hash of the text, as xxhash64() has it), id: one row per row of ``docs``.

    With ``plan`` (``segment_plan``) a shingle counts once however often it stands in the text, ``id`` is the set's (else the
    fingerprint's), and ``segs`` and ``shingles`` (32 bits of each hash) come with it.
    """

    def one(h: np.ndarray) -> tuple:
        h = np.unique(h) if plan else h
        fp = fingerprint(h, n_words).view(np.int64)
        number = int(fp[0]) if n_words == 1 and not plan else int(np.uint64(xxhash.xxh64_intdigest((h if plan else fp).tobytes(), 42)).view(np.int64))
        return (fp.tolist(), h.size, number) + ((segments_of(fp.view(np.uint64), *plan), (h >> np.uint64(32)).astype(np.uint32).view(np.int32)) if plan else ())

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = utf8(batch.column(1))
        rows, sizes, numbers, *more = zip(*(one(shingle_hashes(t, shingle)) for t in texts), strict=True) if texts else ([],) * (5 if plan else 3)
        hashes = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64).view(np.int64)
        columns = [batch.column(0), pa.array(rows, pa.list_(pa.int64())), pa.array(sizes, pa.int64()), pa.array(hashes), pa.array(numbers, pa.int64()), *(pa.array(x, pa.list_(kind)) for x, kind in zip(more, (pa.int64(), pa.int32()), strict=False))]
        return pa.RecordBatch.from_arrays(columns, names)

    names = ["doc_id", "fp", "n", "h", "id"] + ["segs", "shingles"] * bool(plan)
    schema = "doc_id long, fp array<long>, n long, h long, id long" + ", segs array<long>, shingles array<int>" * bool(plan)
    return map_arrow(docs.select("doc_id", "text"), run, schema, most_bytes=4 << 20)


def distance(a: Column, b: Column, n_words: int) -> Column:
    total = F.lit(0)
    for k in range(n_words):
        total = total + F.bit_count(a[k].bitwiseXOR(b[k]))
    return total


def _segments(fp: Column, n_words: int, bits: int) -> list[Column]:
    """The low ``bits`` of both halves of every word."""
    mask = F.lit((1 << bits) - 1)
    return [F.shiftrightunsigned(fp[k], half).bitwiseAND(mask) for k in range(n_words) for half in (0, 32)]


def _keys(value: Column, bits: int, ball: bool) -> Column:
    """The value and, for the ball, the values with one of its set bits cleared."""
    if not ball:
        return F.array(value)
    cleared = F.filter(F.array(*[F.when(value.bitwiseAND(F.lit(1 << i)) != 0, value.bitwiseAND(F.lit(~(1 << i)))) for i in range(bits)]), lambda x: x.isNotNull())
    return F.concat(F.array(value), cleared)


def link(fps: DataFrame, n_words: int, bits: int, most: int) -> DataFrame:
    """All links (src, dst: numbers of fingerprints) between rows (id long, fp) at distance 1 to ``most``, two at most (0 too where ids differ and fp do not)."""
    if most > 2:
        raise ValueError("balls of radius one find distances of two at most")
    own = [v + F.lit(j << 32) for j, v in enumerate(_segments(F.col("fp"), n_words, bits))]
    home = fps.select("id", F.explode(F.array(*own)).alias("key"))
    probe = fps.select("id", F.explode(F.concat(*[_keys(v, bits, True) for v in own])).alias("key"))
    full = materialize(home.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CAP).select("key"))
    any_full = full.limit(1).count() > 0
    table = home.select(F.col("id").alias("dst"), "key")
    if any_full:
        table = table.join(full, "key", "left_anti").unionByName(full.select(F.lit(None).cast("long").alias("dst"), "key"))
    hits = materialize(probe.join(table.hint("merge"), "key").where(F.col("dst").isNull() | (F.col("id") != F.col("dst"))).select(F.col("id").alias("src"), "dst").distinct())
    out = _verified(hits.where("dst is not null"), fps, n_words, most)
    if any_full:
        heavy = hits.where("dst is null").select(F.col("src").alias("id")).distinct()
        out = out.unionByName(_meet(fps.join(heavy, "id", "left_semi"), n_words))
    return out


def _rows(fps: DataFrame, bits: int, at: range, ball: bool) -> DataFrame:
    """(key, id, root, s, n) for the segments numbered ``at``: those of the fingerprints, or of their balls (``home``: the centre)."""
    own = fps.select("id", "root", "s", "n", F.posexplode(F.slice("segs", at.start + 1, len(at))).alias("j", "v"))
    first = ((F.col("j") + at.start).cast("long") * F.lit(1 << bits)).alias("first")  # a segment's keys have a range of their own
    if ball:
        own = own.select("id", "root", "s", "n", F.col("v").alias("centre"), first, F.explode(_keys(F.col("v"), bits, True)).alias("v"))
        return own.select("id", "root", "s", "n", (F.col("v") + F.col("first")).alias("key"), (F.col("v") == F.col("centre")).alias("home"))
    return own.select("id", "root", "s", "n", (F.col("v") + first).alias("key"))


def _near(least: float) -> Column:
    """Whether the rows (s, n) and (s2, n2) of two components may have a similarity of ``least``: by their first words and their sizes."""
    return (F.col("root") != F.col("root2")) & (F.col("n") * least <= F.col("n2")) & (F.col("n2") * least <= F.col("n")) & (distance(F.col("s"), F.col("s2"), WORDS) <= SKETCH)


def _other(rows: DataFrame, *more: Column) -> DataFrame:
    return rows.select(F.col("id").alias("dst"), F.col("root").alias("root2"), F.col("s").alias("s2"), F.col("n").alias("n2"), "key", *more)


def similar_components(fps: DataFrame, plan: tuple[int, int], n_words: int, most: int, least: float, sure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(id, root) for rows (id, fp, n, segs): components of the pairs that meet in a bucket and that ``sure`` confirms.

    ``n`` is the number of shingles. First all members of a bucket are compared with one of them, the best connected, and
    components are contracted: pairs within one are not asked about again. Then balls are looked up. Their rows carry numbers and a
    fingerprint's first words; in dense buckets, what is outside the main component is compared by complete distances.
    """
    bits, count = plan
    fps = materialize(fps.select("id", "fp", F.slice("fp", 1, WORDS).alias("s"), "n", "segs", F.col("id").alias("root"), F.lit(0).cast("long").alias("degree")))

    def contract(pairs: DataFrame) -> None:
        nonlocal fps
        ask = materialize(pairs.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).distinct())
        links = materialize(sure(ask))
        of = fps.select("id", "root")
        ends = links.join(of.select(F.col("id").alias("src"), F.col("root").alias("a")), "src").join(of.select(F.col("id").alias("dst"), F.col("root").alias("b")), "dst")
        new = components(ends.select(F.col("a").alias("src"), F.col("b").alias("dst")).where("src <> dst"))
        more = _ends(links).groupBy("id").agg(F.count(F.lit(1)).alias("more"))
        up = fps.join(new.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").withColumn("root", F.coalesce("up", "root"))
        last, fps = fps, materialize(up.join(more, "id", "left").select("id", "fp", "s", "n", "segs", "root", (F.col("degree") + F.coalesce("more", F.lit(0))).alias("degree")))
        discard(ask, last)

    for _ in range(HUBS):
        home = _rows(fps.withColumn("s", F.struct("degree", "s")), bits, range(count), False).select("key", "id", "root", "s.s", "n", "s.degree")
        best = F.max_by(F.struct("id", "root", "s", "n"), F.struct("degree", "id")).alias("r")
        hubs = home.groupBy("key").agg(F.count(F.lit(1)).alias("k"), best).where("k > 1").select("key", "r.*")
        contract(home.join(_other(hubs), "key").where(_near(least)).select(F.col("id").alias("src"), "dst"))

    found, dense, scratch = [], [], []
    for a in range(0, count, ROUND):
        at = range(a, min(count, a + ROUND))
        home, probe = _rows(fps, bits, at, False), _rows(fps, bits, at, True)
        by_root = home.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
        full = by_root.groupBy("key").agg(F.sum("k").alias("k"), F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots"))
        full = materialize(full.where(F.col("k") > DENSE).select("key", "main", "roots"))
        marked = probe.join(full, "key", "left")
        light = marked.where("main is null").drop("main", "roots", "home").join(_other(home.join(full, "key", "left_anti")).hint("merge"), "key").where(_near(least))
        found.append(materialize(light.select(F.col("id").alias("src"), "dst").distinct()))
        open_ = materialize(marked.where("roots > 1 or root <> main").select("key", "id", "home", "roots"))
        whole = open_.where("roots = 1").select("key").distinct()  # homes of one component, and probes of others
        dense += [open_.drop("roots"), materialize(home.join(whole, "key", "left_semi").select("key", "id", F.lit(True).alias("home")))]
        scratch += [open_, dense[-1]]
        discard(full)
    contract(_union(found))
    met = _union(dense)
    if met.limit(1).count():
        contract(_apart(met, fps, bits, n_words, most, least))
    out = materialize(fps.select("id", "root"))
    discard(fps, *found, *scratch)
    return out


def _apart(members: DataFrame, fps: DataFrame, bits: int, n_words: int, most: int, least: float) -> DataFrame:
    """All candidates (src, dst) of a probe and a home row under one key (key, id, home) that have different roots.

    Of such a pair one end at least is outside the key's most common component, so the rest of the key is only compared
    with those. A pair counts under the first key alone at which its segments meet.
    """
    rooted = materialize(members.join(fps.drop("degree"), "id"))
    sizes = rooted.groupBy("key", "root").agg(F.count(F.lit(1)).alias("k"))
    main = sizes.groupBy("key").agg(F.max_by("root", F.struct("k", "root")).alias("main"), F.count(F.lit(1)).alias("roots")).where("roots > 1").select("key", "main")
    rows = materialize(rooted.join(main, "key"))
    j = F.floor(F.col("key") / (1 << bits)).cast("int")
    before = F.zip_with(F.slice("segs", F.lit(1), j), F.slice("segs2", F.lit(1), j), lambda x, y: F.bit_count(x.bitwiseXOR(y)))
    close = _near(least) & (distance(F.col("fp"), F.col("fp2"), n_words) <= most) & F.forall(before, lambda d: d > 1)
    out = F.col("root") != F.col("main")
    homes = lambda r: _other(r.where("home"), F.col("fp").alias("fp2"), F.col("segs").alias("segs2")).hint("merge")
    meet = lambda p, h: p.join(homes(h), "key").where(close).select(F.col("id").alias("src"), "dst")
    pairs = materialize(meet(rows.where(out), rows).unionByName(meet(rows.where(~out), rows.where(out))))
    discard(rooted, rows)
    return pairs


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.col("src").alias("id")).unionByName(pairs.select(F.col("dst").alias("id")))


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _verified(pairs: DataFrame, fps: DataFrame, n_words: int, most: int) -> DataFrame:
    """The candidates whose complete distance is small enough."""
    if n_words == 1:  # the number of a fingerprint is the fingerprint
        return pairs.where(F.bit_count(F.col("src").bitwiseXOR(F.col("dst"))) <= most)
    a, b = fps.select(F.col("id").alias("src"), F.col("fp").alias("fp1")), fps.select(F.col("id").alias("dst"), F.col("fp").alias("fp2"))
    return pairs.join(a, "src").join(b, "dst").where(distance(F.col("fp1"), F.col("fp2"), n_words) <= most).select("src", "dst")


def _meet(fps: DataFrame, n_words: int) -> DataFrame:
    """All links at distance one or two: the fingerprints whose balls of radius one share a point."""
    flips = [F.col("fp")]
    for k in range(n_words):
        for i in range(64):
            bit = (1 << i) - (1 << 64) * (i == 63)
            flips.append(F.array(*[F.col("fp")[j].bitwiseXOR(F.lit(bit)) if j == k else F.col("fp")[j] for j in range(n_words)]))
    points = fps.select("id", F.explode(F.array(*flips)).alias("point"))
    groups = points.groupBy("point").agg(F.collect_set("id").alias("ids")).where(F.size("ids") > 1)  # at most 1 + 64 * n_words of them
    return groups.select(F.array_min("ids").alias("dst"), F.explode("ids").alias("src")).where("src <> dst")


def _similar(pairs: DataFrame, texts: DataFrame, n_words: int, most: int, least: float) -> DataFrame:
    """The ``pairs`` (src, dst) whose texts (id, fp, n, shingles) differ in ``most`` bits at most and share shingles enough."""
    side = lambda end, k: texts.select(F.col("id").alias(end), *[F.col(c).alias(f"{c}{k}") for c in ("fp", "n", "shingles")])
    both = pairs.join(side("src", 1), "src").join(side("dst", 2), "dst")
    near = both.where(distance(F.col("fp1"), F.col("fp2"), n_words) <= most)
    shared = F.size(F.array_intersect("shingles1", "shingles2"))
    total = F.col("n1") + F.col("n2") - shared
    return near.where((total == 0) | (shared >= total * least)).select("src", "dst")


def near_duplicates(docs: DataFrame, shingle: int = 3, n_words: int = 1, bits: int = 32, most: int = 2) -> DataFrame:
    """doc_id, fp, h, component_id for each row of ``docs``: components of fingerprints at ``most`` differing bits or fewer."""
    each = materialize(fingerprints(docs, shingle, n_words))
    distinct = materialize(each.groupBy("id").agg(F.first("fp").alias("fp"), F.min("doc_id").alias("least")))
    roots = components(link(distinct.select("id", "fp"), n_words, bits, most)).select(F.col("node").alias("id"), "root")
    return _named(each, distinct, distinct.select("id").join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")))


def _named(each: DataFrame, distinct: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of ``each`` with their component's smallest doc_id."""
    of = materialize(distinct.select("id", "least").join(roots, "id").select("id", "least", "root"))
    ids = materialize(of.groupBy("root").agg(F.min("least").alias("component_id")))  # a table of its own: a hot root's rows can be split then
    known = materialize(of.join(ids, "root").select("id", "component_id"))
    discard(of, ids)
    return each.join(known, "id").select("doc_id", "fp", "h", "component_id")


def similar_documents(docs: DataFrame, shingle: int = 5, n_words: int = 16, most: int = 187, least: float = 0.8) -> DataFrame:
    """doc_id, fp, h, component_id for each row of ``docs``: components of texts whose sets of shingles have a similarity of ``least``."""
    plan = segment_plan(n_rows(docs), least)
    each = materialize(fingerprints(docs, shingle, n_words, plan))
    distinct = materialize(each.groupBy("id").agg(F.first("fp").alias("fp"), F.first("segs").alias("segs"), F.min("doc_id").alias("least"), F.first("n").alias("n")))

    def sure(pairs: DataFrame) -> DataFrame:
        asked = materialize(_ends(pairs).distinct())
        texts = each.select("id", "fp", "n", "shingles").join(asked, "id", "left_semi").dropDuplicates(["id"])
        texts = materialize(texts)
        out = materialize(_similar(pairs, texts, n_words, most, least))
        discard(asked, texts)
        return out

    roots = similar_components(distinct, plan, n_words, most, least, sure)
    out = materialize(_named(each, distinct, roots))
    discard(each, distinct)
    return out


def op9(spark, sf_dir: str) -> DataFrame:
    got = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return got.select("doc_id", F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the row with the smallest (doc_id, text hash) stays.

    Five-word shingles, similarity 0.8 (``similar_documents``). At that similarity 15.1 % of the bits differ, 155 of 1024 and
    11 more or less; up to 187 make a candidate, and the shingles decide. Fingerprints and sizes are the sets', so that
    repetition within a text changes neither. Texts without words are all alike, null ones too: one of them stays.
    """
    got = similar_documents(docs).select("doc_id", "h", "component_id")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = materialize(got.groupBy("component_id").agg(F.min(place).alias("p")).select(F.col("p.doc_id").alias("keep_id"), F.col("p.h").alias("keep_h")))
    same = lambda df: df["doc_id"].eqNullSafe(first["keep_id"]) & (df["__text_hash"] == first["keep_h"])
    marked = docs.withColumn("__text_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    kept = marked.join(first, same(marked), "left_semi")
    again = got.groupBy("doc_id", "h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("keep_id"), F.col("h").alias("keep_h"))
    first = materialize(again)
    if first.limit(1).count():  # rows that repeat: one of them stays
        kept = kept.join(first, same(kept), "left_anti").unionByName(kept.join(first, same(kept), "left_semi").dropDuplicates(["doc_id", "__text_hash"]))
    return kept.drop("__text_hash")
