"""Benchmark decontamination by pigeonhole edit matching.

Texts are lower-cased and reduced to word characters with single spaces. A test item of n
characters may differ from a passage by ``budget`` edits, ``rate`` times n rounded down;
split into budget + 1 pieces, at least one piece must stand in the passage unchanged. One
automaton finds all pieces of all items in a document; each hit fixes where the item would
lie, hits on nearby diagonals merge, and Myers' bit-parallel distance of the item to the
best substring of that window decides.

The items are the stated query set: they go to the executors in blocks of at most
``BLOCK_CHARS`` characters, each block against all documents.

Items too short for an edit (under 20 characters at a rate of 0.05) match unchanged and on word borders
only (beside a letter of a script without spaces any place is one), as within words they would match anywhere.

Items with equal texts are searched once.

Edge cases: null items and those without word characters never match. Null and empty documents have no hits. Items and
documents that repeat give their rows as often. No item or no document: no rows.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow, materialize
from foliant.llm.ordering import running_offsets

RATE, BLOCK_CHARS = 0.05, 4_000_000
_WORDS = re.compile(r"[^\W_]+")
#: Scripts without spaces: Thai and Lao, Burmese, Khmer, kana, Han.
_UNSPACED = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def reduced(text: str | None) -> str:
    return " ".join(_WORDS.findall((text or "").lower()))


def myers(pattern: str, text: str, most: int) -> int:
    """Least edit distance of ``pattern`` to any substring of ``text``; ``most`` + 1 if above ``most``."""
    masks: dict[str, int] = {}
    for i, c in enumerate(pattern):
        masks[c] = masks.get(c, 0) | 1 << i
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        x = eq | minus
        d = (((eq & plus) + plus) ^ plus) | x
        up, down = minus | (~(d | plus) & full), plus & d
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full  # a match may start anywhere in the text
        plus, minus = (down | ~(x | up)) & full, up & x
        if score < best:
            best = score
    return best if best <= most else most + 1


def bordered(text: str, a: int, b: int) -> bool:
    """Whether ``text[a:b]`` begins and ends on word borders."""
    border = lambda at: at in (0, len(text)) or " " in text[at - 1 : at + 1] or _UNSPACED.search(text, at - 1, at + 1) is not None
    return border(a) and border(b)


class Matcher:
    """Finds every item of a block in a text; those without a budget unchanged and on word borders."""

    def __init__(self, items: list[tuple[int | None, str]], rate: float):
        self.items = [(i, t, int(len(t) * rate)) for i, t in items]
        pieces: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t, budget) in enumerate(self.items):
            for j in range(budget + 1):
                a, b = j * len(t) // (budget + 1), (j + 1) * len(t) // (budget + 1)
                pieces.setdefault(t[a:b], []).append((k, b - 1))
        self.find = ahocorasick.Automaton()
        for piece, of in pieces.items():
            self.find.add_word(piece, of)
        if pieces:
            self.find.make_automaton()

    def hits(self, text: str | None) -> list[tuple[int | None, int]]:
        """(item_id, distance) of every item within its budget."""
        if not text or not self.items:
            return []
        text = reduced(text)
        diagonals: dict[int, set[int]] = {}
        for end, of in self.find.iter(text):
            for k, last in of:
                diagonals.setdefault(k, set()).add(end - last)
        found = []
        for k, at in sorted(diagonals.items()):
            item, pattern, budget = self.items[k]
            if not budget:  # its one piece is the item
                if any(bordered(text, a, a + len(pattern)) for a in at):
                    found.append((item, 0))
                continue
            best, starts = budget + 1, sorted(at)
            low = high = starts[0]
            for d in [*starts[1:], None]:
                if d is not None and d - high <= 2 * budget + 1:
                    high = d
                    continue
                window = text[max(0, low - budget) : max(0, high + len(pattern) + budget)]
                best = 0 if pattern in window else min(best, myers(pattern, window, budget))
                if best == 0 or d is None:
                    break
                low = high = d
            if best <= budget:
                found.append((item, best))
        return found


def texts_of(benchmark: DataFrame) -> DataFrame:
    """The different texts of the items: text, n (characters), at (characters of all texts before; it tells texts apart)."""
    each = benchmark.select("text").where(F.length("text") > 0).distinct().withColumn("n", F.length("text").cast("long"))
    return materialize(running_offsets(each, [F.col("text")], "n", "at"))


def blocks(texts: DataFrame, block_chars: int = BLOCK_CHARS):
    """The texts as (at, reduced text), in blocks of ``block_chars`` characters (and one text more at most)."""
    last = texts.agg(F.max("at")).first()[0]
    for k in range(0 if last is None else last // block_chars + 1):
        block = texts.where(F.col("at").between(k * block_chars, (k + 1) * block_chars - 1)).select("at", "text")
        rows = [(r["at"], reduced(r["text"])) for r in sorted(block.collect())]
        yield [(i, t) for i, t in rows if t]


def contamination(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """doc_id, item_id, distance, item_chars: one row for each test item that a document holds."""
    schema = "doc_id long, at long, distance long, item_chars long"
    texts = texts_of(benchmark)
    found = docs.sparkSession.createDataFrame([], schema)
    for items in blocks(texts):
        shared = docs.sparkSession.sparkContext.broadcast(items)  # BLOCK_CHARS bounds it

        def run(batch: pa.RecordBatch, shared=shared, made=[]) -> pa.RecordBatch:
            if not made:
                made += [Matcher(shared.value, rate), {at: len(t) for at, t in shared.value}]
            rows = [(d, i, n, made[1][i]) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, n in made[0].hits(t)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "at", "distance", "item_chars"])

        found = found.unionByName(map_arrow(docs.select("doc_id", "text"), run, schema))
    named = benchmark.select("item_id", "text").join(texts.select("text", "at"), "text").drop("text")
    return found.join(named, "at").select("doc_id", F.col("item_id").cast("long").alias("item_id"), "distance", "item_chars")


def clean(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """The rows of ``docs``, every column as it was, that hold no test item."""
    at = docs.columns.index("text")
    for items in blocks(texts_of(benchmark)):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared, made=[]) -> pa.RecordBatch:
            if not made:
                made.append(Matcher(shared.value, rate))
            return batch.filter(pa.array([not made[0].hits(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        docs = map_arrow(docs, run, docs.schema)
    return docs


def op1(spark, sf_dir: str) -> DataFrame:
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return contamination(read("documents"), read("benchmark"))
