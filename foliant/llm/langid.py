"""Language identification with bit-sliced Bloom filters of character n-grams.

Training counts, per language, in how many sampled documents each 4-gram of lower-cased
text occurs. N-grams found in enough of them go into one Bloom table whose slots hold a
bitmask of languages: the AND over an n-gram's slots names every language that has it.
A document's hits per language (popcounts over its n-grams) are corrected for the share
of false positives that the language's own filling causes; the largest corrected share
decides.

Edge cases: a null text, or one without a letter, is ``und`` with score 0. Ties go to the
language that more training documents have, then to the smaller name. Rows repeat as
they come (one result per row). A text with letters but no known n-gram takes the most
frequent language, score 0. Without any training document everything is ``und``.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.llm.common import map_arrow

GRAM = 4
PIECE = 1 << 20  # code points of a long text that are hashed at once
WHOLE = 1 << 32


@dataclass
class Model:
    """``slots``: language bitmasks, one row of 64-bit words per slot."""

    langs: list[str]
    slots: np.ndarray
    n_hashes: int
    false_rate: np.ndarray


MARK, LETTER = 1, 2


def _class(c: int) -> int:
    return {"M": MARK, "L": LETTER}.get(unicodedata.category(chr(c))[0], 0)


_FIRST_PLANE: np.ndarray | None = None


def classes(points: np.ndarray) -> np.ndarray:
    """LETTER (category L), MARK (M) or 0 for each code point; those beyond the first plane are looked up one by one."""
    global _FIRST_PLANE
    if _FIRST_PLANE is None:
        _FIRST_PLANE = np.fromiter(map(_class, range(1 << 16)), dtype=np.uint8, count=1 << 16)
    out = _FIRST_PLANE[np.minimum(points, 0xFFFF)]
    if (far := np.flatnonzero(points > 0xFFFF)).size:
        out[far] = [_class(c) for c in points[far].tolist()]
    return out


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def gram_hashes(text: str) -> tuple[np.ndarray, bool]:
    """Hashes of the n-grams with at most one character that is neither letter nor mark; whether there is a letter (a mark is none)."""
    points = np.frombuffer((" " + text + " ").encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = classes(points)
    alpha, any_letter = kind > 0, bool((kind == LETTER).any())
    if points.size < GRAM:
        return np.empty(0, np.uint64), any_letter
    kept = np.where(alpha, points, 32).astype(np.uint64)
    n = points.size - GRAM + 1
    h, good = np.zeros(n, np.uint64), np.zeros(n, np.uint8)
    for i in range(GRAM):
        h = h * np.uint64(0x9E3779B97F4A7C15) + kept[i : i + n]
        good += alpha[i : i + n]
    return mixed(h[good >= GRAM - 1]), any_letter


def pieces(text: str):
    """A long text in overlapping pieces that together have each of its n-grams once (plus two at each cut)."""
    for at in range(0, max(1, len(text)), PIECE):
        yield text[max(0, at - GRAM + 1) if at else 0 : at + PIECE]


def train(docs: DataFrame, is_training: Column, *, docs_per_lang: int = 400, min_share: float = 0.02, log2_slots: int = 18, n_hashes: int = 3) -> Model:
    """Fit on a bounded sample: about ``docs_per_lang`` whole documents of each language, by the hash of their id.

    An n-gram belongs to a language if at least ``min_share`` of its sampled documents have it.
    """
    known = docs.where(is_training & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes, key=lambda x: (-sizes[x], x))
    if not langs:
        return Model([], np.zeros((1, 1), np.uint64), 1, np.zeros(0))
    point = F.pmod(F.xxhash64(F.lit("langid"), F.col("doc_id")), F.lit(WHOLE))
    limits = F.create_map(*[F.lit(x) for s in sizes.items() for x in (s[0], min(WHOLE, -(-WHOLE * docs_per_lang // s[1])))])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        by: dict[str, list[np.ndarray]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = np.unique(np.concatenate([gram_hashes(p)[0] for p in pieces(text.lower())]))
            by.setdefault(lang, []).append(own)
        names, grams, counts = [], [], []
        for lang, own in by.items():
            g, c = np.unique(np.concatenate(own), return_counts=True)
            names += [lang] * g.size
            grams.append(g.view(np.int64))
            counts.append(c)
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(grams)), pa.array(np.concatenate(counts).astype(np.int64))], ["lang", "gram", "n"])

    sample = known.where(point < F.element_at(limits, F.col("lang")))
    found = map_arrow(sample.select("lang", "text"), count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    least = {s: max(2 if n > 20 else 1, int(min(n, docs_per_lang) * min_share)) for s, n in sizes.items()}
    wanted = F.create_map(*[F.lit(x) for s in least.items() for x in s])
    rows = found.where(F.col("n") >= F.element_at(wanted, F.col("lang"))).toPandas()

    words, size = -(-len(langs) // 64), 1 << log2_slots
    slots, false_rate = np.zeros((size, words), np.uint64), np.zeros(len(langs))
    for k, lang in enumerate(langs):
        grams = rows.loc[rows["lang"] == lang, "gram"].to_numpy(np.int64).view(np.uint64)
        for h in slots_of(grams, size, n_hashes):
            slots[h, k // 64] |= np.uint64(1 << (k % 64))
        false_rate[k] = (np.count_nonzero(slots[:, k // 64] & np.uint64(1 << (k % 64))) / size) ** n_hashes
    return Model(langs, slots, n_hashes, false_rate)


def slots_of(h: np.ndarray, size: int, n: int) -> list[np.ndarray]:
    step = (h >> np.uint64(32)) | np.uint64(1)
    return [((h + step * np.uint64(i)) & np.uint64(size - 1)).astype(np.int64) for i in range(n)]


def score(model: Model, text: str | None) -> tuple[str, float]:
    if not text or not model.langs:
        return "und", 0.0
    hits, n, any_letter = np.zeros(len(model.langs)), 0, False
    for piece in pieces(text.lower()):
        h, has = gram_hashes(piece)
        any_letter |= has
        n += h.size
        if h.size:
            masks = None
            for at in slots_of(h, len(model.slots), model.n_hashes):
                masks = model.slots[at] if masks is None else masks & model.slots[at]
            for k in range(len(model.langs)):
                hits[k] += np.count_nonzero(masks[:, k // 64] & np.uint64(1 << (k % 64)))
    if not any_letter:
        return "und", 0.0
    share = np.clip((hits - n * model.false_rate) / (1 - np.minimum(model.false_rate, 0.99)), 0, None) / max(n, 1)
    best = int(np.argmax(share))
    return model.langs[best], float(min(1.0, share[best]))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` (doc_id, text and whatever else) -> doc_id, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few MB: its size is fixed by log2_slots and the number of languages

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [score(shared.value, t) for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], ["doc_id", "lang_pred", "score"])

    return map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, ~held_out(F.col("doc_id")))
    return predict(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


#: Documents of at least so many characters whose best language has less than this share of their n-grams are rejected.
LEAST_SHARE, LEAST_CHARS = 0.2, 50


def keep_identified(docs: DataFrame, model: Model, least: float = LEAST_SHARE) -> DataFrame:
    """The rows of ``docs``, every column as it was, whose language is known well enough; ``und`` rows go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = [score(shared.value, t) for t in batch.column(at).to_pylist()]
        long = [t is not None and len(t) >= LEAST_CHARS for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array([x != "und" and (s >= least or not n) for (x, s), n in zip(got, long, strict=True)], pa.bool_()))

    return map_arrow(docs, run, docs.schema)
