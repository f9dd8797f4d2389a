"""Periodic runs of words, by Lyndon arrays (Ellert and Fischer), and texts without what runs repeat.

A run is a stretch of words with smallest period p that no neighbour extends. Every run of
exponent two or more holds a Lyndon root: the longest Lyndon word that starts at some
position, under the order of the words or under its reverse. So it is enough to look, for both orders, at the
edges (l, r) in which r is where the first suffix smaller than that of l starts.

``lyndon`` finds these edges from left to right with a stack and tells how far the suffixes
of each edge agree. What was matched before is used again: the match that reached farthest,
of a with b, says that positions after b look like those after a, so an agreement that ends
inside it is that of the pair b - a before, and any other starts at its end. Of two edges
that meet at r the nearer one bounds the farther one. Each comparison that succeeds moves
the reach forward and at most two fail a position, so comparisons are linear. Words are compared with
words only: no suffix structure, no fingerprints. Left extensions are compared for the
leftmost root of a run alone, less than a period each.

Texts need no neighbours, so this is one pass without a shuffle. Before it, stretches that
can't be in a run of the wanted exponent go: each of its words stands at least that
many times in it, so words that are rarer in their stretch divide it, again and again.

Edge cases: null, empty and short texts have no runs and keep their words; null ids are
passed on; rows that repeat come again each; an empty table gives no rows; further columns are not returned. Memory
is bounded by one slice of texts, or one longer text.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow, utf8

MIN_LENGTH, MIN_EXPONENT = 6, 4
SLICE = 4 << 20


def lyndon(word: Sequence[int], step: int = 1) -> tuple[list[int], list[int]]:
    """For each position where the next smaller suffix starts (n if none does), and how many words the two suffixes share.

    ``step`` -1 reverses the order of the words; the end of the text counts as smaller than any word in both.
    """
    n = len(word)
    smaller, common = [n] * n, [0] * n
    before, shared = [-1] * n, [0] * n  # the previous smaller suffix, and what it shares
    gap = right = reach = 0  # the match that reaches farthest: of what follows right - gap with what follows right
    stack = [0] if n else []
    for r in range(1, n):
        m, a = -1, 0
        while stack:
            l, x, known = stack[-1], 0, False
            if m >= 0 and shared[m] != a:
                x, known = min(a, shared[m]), True
            elif r + a < reach:
                i, j = l - gap, r - gap
                x = common[i] if smaller[i] == j else shared[j]
                known = x < reach - r
                x = x if known else reach - r
            else:
                x = a
            if not known:
                while r + x < n and word[l + x] == word[r + x]:
                    x += 1
                if r + x > reach:
                    gap, right, reach = r - l, r, r + x
            if r + x < n and (word[r + x] - word[l + x]) * step > 0:
                before[r], shared[r] = l, x
                break
            smaller[l], common[l] = r, x
            m, a = stack.pop(), x
        stack.append(r)
    return smaller, common


def runs(word: Sequence[int], min_exponent: int = 2, min_length: int = 0) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least ``min_exponent`` (2 or more) periods and ``min_length`` words, in order."""
    found, n = set(), len(word)
    for step in (1, -1):
        smaller, common = lyndon(word, step)
        for l, r in enumerate(smaller):
            p = r - l
            if r == n or common[l] + 2 * p - 1 < max(min_length, min_exponent * p):
                continue
            if l >= p and smaller[l - p] == l and common[l - p] >= p:  # a root one period before
                continue
            e = 0
            while e < l and word[l - 1 - e] == word[r - 1 - e]:
                e += 1
            if e + p + common[l] >= max(min_length, min_exponent * p):
                found.add((l - e, e + p + common[l], p))
    return sorted(found)


def stretches(word: np.ndarray, doc: np.ndarray, min_exponent: int, min_length: int) -> list[np.ndarray]:
    """Positions, stretch by stretch, outside which no run of the wanted size can be."""
    at = np.arange(word.size)
    seg, width = doc, int(word.max(initial=0)) + 1
    while at.size:
        _, of, times = np.unique(seg * width + word[at], return_inverse=True, return_counts=True)
        stays = times[of] >= min_exponent
        at, seg = at[stays], seg[stays]
        if not at.size:
            break
        seg = np.cumsum(np.r_[0, (np.diff(at) != 1) | (np.diff(seg) != 0)])
        long = np.bincount(seg)[seg] >= min_length
        if stays.all() and long.all():
            return np.split(at, np.flatnonzero(np.diff(seg)) + 1)
        at, seg = at[long], seg[long]
    return []


def runs_of_texts(each: list[list[bytes]], min_exponent: int, min_length: int) -> list[list[tuple[int, int, int]]]:
    """Runs of each text; places count from its first word."""
    ids: dict[bytes, int] = defaultdict(count().__next__)
    sizes = np.fromiter(map(len, each), np.int64, len(each))
    word = np.fromiter((i for w in each for i in map(ids.__getitem__, w)), np.int64, int(sizes.sum()))
    doc, starts = np.repeat(np.arange(sizes.size), sizes), np.cumsum(sizes) - sizes
    out: list[list[tuple[int, int, int]]] = [[] for _ in each]
    for at in stretches(word, doc, min_exponent, min_length):
        d, first = int(doc[at[0]]), int(at[0])
        base = first - int(starts[d])
        out[d] += [(base + s, n, p) for s, n, p in runs(word[at].tolist(), min_exponent, min_length)]
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """Words joined by a space, without those that follow the first period of a run that holds them."""
    if not found:
        return b" ".join(words)
    edge = np.zeros(len(words) + 1, np.int64)
    for s, n, p in found:
        edge[s + p] += 1
        edge[s + n] -= 1
    return b" ".join([words[i] for i in np.flatnonzero(np.cumsum(edge[:-1]) == 0).tolist()])


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def periodic_runs(docs: DataFrame, min_exponent: int = MIN_EXPONENT, min_length: int = MIN_LENGTH) -> DataFrame:
    """doc_id, runs (by start, then period) and collapsed (the text without repeated periods) for each row of ``docs``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        each = [t.split() for t in utf8(batch.column(1))]  # bytes.split() knows just the six ASCII spaces
        found = runs_of_texts(each, min_exponent, min_length)
        texts = pa.array([collapsed(w, f) for w, f in zip(each, found, strict=True)], pa.binary()).cast(pa.string())
        rows = [[dict(zip(("start", "length", "period"), x, strict=True)) for x in f] for f in found]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(RUN)), texts], ["doc_id", "runs", "collapsed"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, runs array<struct<start: long, length: long, period: long>>, collapsed string", most_bytes=SLICE)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id, text; one text in ten (by the CRC-32 of its id) repeats from a place on that the id names. Null ids stay as they are."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(1).to_pylist()
        for k, i in enumerate(batch.column(0).to_pylist()):
            h = 1 if i is None else zlib.crc32(b"%d" % i)
            if h % 10 or not texts[k] or not (w := texts[k].encode().split()):
                continue
            g, n = h // 10, len(w)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            texts[k] = b" ".join(w[:a] + [w[a + i % p] for i in range(n - a)]).decode()
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, text string", most_bytes=SLICE)


def digests(found: DataFrame) -> DataFrame:
    """The columns of op13 from those of ``periodic_runs``; the exponents of two runs are compared as products."""
    better = "(a.length * b.period > b.length * a.period) or (a.length * b.period = b.length * a.period and (a.start < b.start or (a.start = b.start and a.period < b.period)))"
    best = F.expr(f"aggregate(runs, cast(null as struct<start: long, length: long, period: long>), (b, a) -> if(b is null or {better}, a, b))")
    lines = F.expr("array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')")
    return found.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op13(spark, sf_dir: str) -> DataFrame:
    return digests(periodic_runs(with_planted_runs(spark.read.parquet(f"{sf_dir}/documents.parquet"))))
