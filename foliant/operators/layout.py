"""Positioned text items to lines: repeated headers, columns, line assembly, word spacing.

Items are rows (doc_id, page, item_no, text, x, y, width, font_size, font_name, page_width,
page_height), y from the bottom as page formats have it. Header detection is one aggregate;
columns are found by a sweep over the edges of a page's items;
lines are assembled from a stream of pages, many at a time, so a batch or a page is what a task holds.
What an Arrow batch has of a page is sent as one compressed row, a pack, not item by item.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.batches import rows_of

SAMPLE_PAGES, ZONE, Y_BUCKET = 5, 0.08, 5.0
LINE_SCHEMA = "doc_id string, page int, line_no int, text string, x double, y double, font_size double, bold boolean, page_width double, page_height double"
X_BUCKET, MIN_ITEMS, MIN_GAP = 5, 30, 12
PACK_SCHEMA = "doc_id string, page int, n int, size int, pack binary, page_width double, page_height double"
#: A pack is these columns of its items one after the other, each by first, second, ... bytes of its numbers, then their texts.
#: length is a text's bytes; begin and end are the edges' buckets less what ``_likely_edges`` says, so mostly zero.
PACKED = {"item_no": "<i8", "x": "<f8", "y": "<f8", "width": "<f8", "font_size": "<f8", "begin": "<i4", "end": "<i4", "length": "<i4", "heavy": "?"}
#: Items of a pack at most, bytes from which it is compressed (smaller ones are by the shuffle, together), and items from which pages that were gathered are laid out.
PACK_ITEMS, PACK_BYTES, GATHERED_ITEMS = 2000, 500, 40_000


def repeated_margins(items: DataFrame) -> DataFrame:
    """(doc_id, page, margins), a row per page of documents with lower-cased texts that return at one height in the margins of their first pages."""
    top = F.col("page_height") - F.col("y")
    said = items.where(F.trim("text") != "")
    pages = said.select("doc_id", "page").distinct().groupBy("doc_id").agg(F.collect_list(F.struct("page")).alias("pages"), F.count_if(F.col("page") <= SAMPLE_PAGES).alias("n_pages"))
    margin = said.where((F.col("page") <= SAMPLE_PAGES) & ((top < F.col("page_height") * ZONE) | (top > F.col("page_height") * (1 - ZONE))))
    # dealt by document at once: all that follows stays where it is
    margin = margin.select("doc_id", F.floor(top / Y_BUCKET + 0.5).alias("b"), F.trim("text").alias("text")).repartition("doc_id")
    counts = margin.groupBy("doc_id", "b", "text").agg(F.count(F.lit(1)).alias("n")).groupBy("doc_id").agg(F.collect_list(F.struct("n", F.lower("text").alias("text"))).alias("counts"))
    often = F.array_distinct(F.filter("counts", lambda c: c["n"] >= F.least(F.lit(3), F.col("n_pages") - 1))["text"])
    return counts.join(pages, "doc_id").select("doc_id", "pages", often.alias("margins")).where(F.size("margins") > 0).select("doc_id", F.explode("pages.page").alias("page"), "margins")


def sized(items: DataFrame) -> DataFrame:
    """Items with text, with font sizes and widths that are known or estimated."""
    size = F.coalesce(F.nullif(F.abs("font_size"), F.lit(0.0)), F.lit(10.0))
    given = F.when((F.col("width") != 0) & ~F.isnan("width"), F.col("width"))
    return items.where(F.trim("text") != "").withColumn("font_size", F.when(F.isnan(size), 10.0).otherwise(size)).withColumn("width", F.coalesce(given, F.length("text") * F.col("font_size") * 0.5))


def _edges(x: Column, width: Column, page_width: Column) -> tuple[Column, Column]:
    """The first bucket of an item, and the one after its last."""
    n = (F.ceil(page_width / X_BUCKET) + 1).cast("int")
    bucket = lambda c: F.greatest(F.lit(0), F.least(c.cast("int"), n - 1))
    return bucket(F.floor(x / X_BUCKET)), bucket(F.ceil((x + width) / X_BUCKET)) + 1


def page_splits(items: DataFrame, page: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """(page, split) of all pages: where those of two columns divide, null for one column.

    A sweep over the edges of all items: the running number of items over each bucket of X_BUCKET points; the longest stretch
    (the first of equally long ones) of the page's middle half that none covers divides the page if it is wide
    enough, stands between text, and each side holds a fifth of the items. A page's edges are at most two a bucket, and no item
    begins in an empty stretch, so the items to its left are those begun before it.
    """
    n = lambda w: (F.ceil(w / X_BUCKET) + 1).cast("int")
    edge = lambda at, begun: F.struct(at.cast("int").alias("b"), F.lit(begun).cast("long").alias("begun"))
    begin, end = _edges(F.col("x"), F.col("width"), F.col("page_width"))
    edges = items.select(*page, "page_width", F.explode(F.array(edge(begin, 1), edge(end, 0))).alias("e"))
    steps = edges.groupBy(*page, F.col("e.b").alias("b")).agg(F.sum("e.begun").alias("begun"), F.count(F.lit(1)).alias("n"), F.max("page_width").alias("w"))
    of_page = Window.partitionBy(*page)
    along = of_page.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    runs = steps.withColumns({
        "left": F.sum("begun").over(along), "cover": F.sum(2 * F.col("begun") - F.col("n")).over(along), "to": F.coalesce(F.lead("b").over(of_page.orderBy("b")), n(F.max("w").over(of_page))),
        "first": F.min("b").over(of_page), "items": F.sum("begun").over(of_page), "w": F.max("w").over(of_page),
    })
    # stretches that begin or end a page count too, so that what is empty at its borders is seen
    low, high = F.floor(F.col("w") * 0.25 / X_BUCKET), F.ceil(F.col("w") * 0.75 / X_BUCKET)
    stretch = lambda a, z, to, left: F.struct((F.least(z, high) - F.greatest(a, low)).alias("len"), (-F.greatest(a, low)).alias("a"), to.alias("to"), left.alias("left"))
    before = F.when(F.col("b") == F.col("first"), stretch(F.lit(0), F.col("b"), F.col("b"), F.lit(0).cast("long")))
    own = F.when(F.col("cover") == 0, stretch(F.col("b"), F.col("to"), F.col("to"), F.col("left")))
    some = lambda r: F.when(r["len"] > 0, r)
    longest = runs.groupBy(*page).agg(F.max(F.greatest(some(before), some(own))).alias("r"), *[F.max(c).alias(c) for c in ("w", "first", "items")])
    length, a, left = F.col("r.len"), -F.col("r.a"), F.col("r.left")
    # cover rises again after an empty stretch, so text follows one that ends before the page does
    middle = (a + length / 2) * X_BUCKET
    wide = (length * X_BUCKET >= MIN_GAP) & (F.col("first") < a) & (F.col("r.to") < F.ceil(F.col("w") / X_BUCKET) + 1) & (F.abs(middle - F.col("w") / 2) <= F.col("w") * 0.25)
    held = (F.col("items") >= MIN_ITEMS) & (F.least(left, F.col("items") - left) >= F.col("items") * 0.2)
    return longest.select(*page, F.when(wide & held, middle).alias("split"))


def column_splits(items: DataFrame, page: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """(page, split): where pages of two columns divide; pages of one column have no row."""
    return page_splits(items, page).where("split is not null")


def joined(words: list[tuple[str, float, float, float]]) -> str:
    """A line's text from (text, x, width, font size)."""
    x, width, size = (np.array([w[i] for w in words], np.float64) for i in (1, 2, 3))
    return _texts(pa.array([w[0] for w in words], pa.string()), x, x + width, size, np.zeros(1, np.int64))[0]


def _texts(words: pa.Array, x: np.ndarray, end: np.ndarray, size: np.ndarray, starts: np.ndarray) -> list[str]:
    """Texts of lines that begin at ``starts``: a space where the gap to the last glyph is over a quarter of the font size; no space comes twice."""
    apart = np.r_[False, x[1:] - end[:-1] > 0.25 * size[1:]]
    spaced = pc.binary_join_element_wise(pa.array(["", " "]).take(pa.array(apart.astype(np.int64))), words, "")
    lines = pa.ListArray.from_arrays(pa.array(np.r_[starts, x.size], pa.int32()), spaced)
    return [" ".join(s.split()) for s in pc.binary_join(lines, "").to_pylist()]


def _page_splits(at: np.ndarray, begin: np.ndarray, end: np.ndarray, w: np.ndarray) -> np.ndarray:
    """``page_splits`` of whole pages at hand: the split of each, infinite for one column. Items are of page ``at``; w are the pages' widths."""
    out, total = np.full(w.size, np.inf), np.bincount(at, minlength=w.size)
    if not at.size:
        return out
    page, b, begun = np.r_[at, at], np.r_[begin, end].astype(np.int64), np.repeat([1, 0], at.size)
    order = np.lexsort((b, page))
    page, b, begun = page[order], b[order], begun[order]
    step = np.flatnonzero(np.r_[True, (np.diff(page) != 0) | (np.diff(b) != 0)])
    page, b, begun, n = page[step], b[step], np.add.reduceat(begun, step), np.diff(np.r_[step, page.size])
    # a page's items all end, so the running number is zero where the next page begins
    cover, left = np.cumsum(2 * begun - n), np.cumsum(begun) - np.r_[0, np.cumsum(total)][page]
    opens, buckets = np.r_[True, np.diff(page) != 0], np.ceil(w / X_BUCKET) + 1
    to = np.where(np.r_[opens[1:], True], buckets[page], np.r_[b[1:], 0])
    own, first = cover == 0, np.zeros(w.size)
    first[page[opens]] = b[opens]
    # stretches that an item ends, and those before a page's first item
    of = np.r_[page[own], page[opens]]
    a, z = np.r_[b[own], np.zeros(opens.sum())], np.r_[to[own], b[opens]]
    left, high = np.r_[left[own], np.zeros(opens.sum())], np.ceil(w * 0.75 / X_BUCKET)
    a = np.maximum(a, np.floor(w * 0.25 / X_BUCKET)[of])
    length = np.minimum(z, high[of]) - a
    order = np.lexsort((-a, length, of))
    order = order[length[order] > 0]
    longest = order[np.r_[np.diff(of[order]) != 0, True][: order.size]]
    of, a, z, left, length = of[longest], a[longest], z[longest], left[longest], length[longest]
    middle = (a + length / 2) * X_BUCKET
    wide = (length * X_BUCKET >= MIN_GAP) & (first[of] < a) & (z < buckets[of]) & (np.abs(middle - w[of] / 2) <= w[of] * 0.25)
    held = (total[of] >= MIN_ITEMS) & (np.minimum(left, total[of] - left) >= total[of] * 0.2)
    out[of[wide & held]] = middle[wide & held]
    return out


def _likely_edges(x: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_edges`` of items within their page."""
    bucket = lambda c: np.clip(np.nan_to_num(c), -(2**30), 2**30).astype(np.int32)
    return bucket(np.floor(x / X_BUCKET)), bucket(np.ceil((x + width) / X_BUCKET)) + 1


def _pressed(raw: bytes) -> bytes:
    """Shorter than what is given, or the same."""
    packed = pa.compress(raw, "zstd", asbytes=True) if len(raw) >= PACK_BYTES else raw
    return packed if len(packed) < len(raw) else raw


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items to PACK_SCHEMA: what a batch has of a page, in rows of PACK_ITEMS at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        doc = pc.fill_null(batch.column("doc_id").dictionary_encode().indices, -1).to_numpy(zero_copy_only=False)
        page = pc.fill_null(batch.column("page").cast(pa.int64()), -(2**62)).to_numpy()
        order = np.lexsort((page, doc))
        doc, page, batch = doc[order], page[order], batch.take(pa.array(order))
        new = np.r_[True, (np.diff(doc) != 0) | (np.diff(page) != 0)]
        since = np.arange(doc.size) - np.flatnonzero(new)[np.cumsum(new) - 1]
        starts = np.flatnonzero(since % PACK_ITEMS == 0)
        stops = np.r_[starts[1:], doc.size]
        text = batch.column("text").cast(pa.string())
        offsets, said = np.frombuffer(text.buffers()[1], np.int32, doc.size + 1, 4 * text.offset), text.buffers()[2]
        items = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in PACKED if c != "length"}
        begin, end = _likely_edges(items["x"], items["width"])
        # items without a number come last
        items |= {"length": np.diff(offsets), "item_no": pc.fill_null(batch.column("item_no"), 2**63 - 1).to_numpy(), "begin": items["begin"] - begin, "end": items["end"] - end}
        columns = [np.ascontiguousarray(items[c], t).view(np.uint8).reshape(doc.size, -1) for c, t in PACKED.items()]
        raw = [b"".join([*(c[i:j].T.tobytes() for c in columns), memoryview(said)[offsets[i] : offsets[j]]]) for i, j in zip(starts, stops, strict=True)]
        most = {c: np.maximum.reduceat(pc.fill_null(batch.column(c), -np.inf).to_numpy(), starts) for c in ("page_width", "page_height")}
        first = pa.array(starts)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id").take(first).cast(pa.string()), batch.column("page").take(first), pa.array(stops - starts, pa.int32()), pa.array([len(r) for r in raw], pa.int32()), pa.array(map(_pressed, raw), pa.binary())]
            + [pa.array(v, mask=v == -np.inf) for v in most.values()], [c.split()[0] for c in PACK_SCHEMA.split(", ")],
        )


def _unpacked(packs: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray | pa.Array]:
    """The items of packs (n, size, pack), column by column."""
    raw, out, at = [pack if len(pack) == size else pa.decompress(pack, size, "zstd", asbytes=True) for _, size, pack in packs], {}, 0
    for c, t in PACKED.items():
        k = np.dtype(t).itemsize
        out[c] = np.concatenate([np.frombuffer(r, np.uint8, n * k, n * at).reshape(k, n).T for r, (n, *_) in zip(raw, packs, strict=True)], dtype=np.uint8).copy("C").view(t).ravel()
        at += k
    begin, end = _likely_edges(out["x"], out["width"])
    out["begin"], out["end"] = out["begin"] + begin, out["end"] + end
    offsets = np.r_[0, np.cumsum(out["length"])].astype(np.int32)
    out["text"] = pa.StringArray.from_buffers(offsets.size - 1, pa.py_buffer(offsets), pa.py_buffer(b"".join(r[at * n :] for r, (n, *_) in zip(raw, packs, strict=True))))
    return out


def page_lines(pages: list[list[tuple]]) -> pa.RecordBatch:
    """The lines of whole pages in reading order; each page is its rows of PACK_SCHEMA and margins."""
    packs = [[r[2:5] for r in rows if r[4] is not None] for rows in pages]
    items = _unpacked([p for of_page in packs for p in of_page])
    at = np.repeat(np.arange(len(pages)), [sum(n for n, *_ in of_page) for of_page in packs])
    page_width, page_height = ([max((r[i] for r in rows if r[i] is not None), key=lambda v: (v != v, v), default=None) for rows in pages] for i in (5, 6))  # NaN is the largest, as in SQL
    x, width, size, heavy, order_no = (items[c] for c in ("x", "width", "font_size", "heavy", "item_no"))
    top = np.array(page_height, np.float64)[at] - items["y"]
    right = x >= _page_splits(at, items["begin"], items["end"], np.array(page_width, np.float64))[at]
    order = np.lexsort((order_no, x, top, right, at))
    # items within three points are one line: each run of close heights is an island, read from left to right
    new = np.r_[True, (np.diff(at[order]) != 0) | np.diff(right[order]) | (np.diff(top[order]) > 3)][: order.size]
    line = np.cumsum(new)
    order = order[np.lexsort((x[order], line))]
    x, width, size, top, heavy, starts = x[order], width[order], size[order], top[order], heavy[order], np.flatnonzero(new)
    texts = _texts(items["text"].take(pa.array(order)), x, x + width, size, starts)
    of = at[order][starts]
    skip = [frozenset(m for *_, margins in rows for m in margins or ()) for rows in pages]
    kept = np.array([bool(t) and not (skip[p] and t.lower() in skip[p]) for t, p in zip(texts, of.tolist(), strict=True)], bool)
    before = np.r_[0, np.cumsum(kept)]
    line_no = before[:-1] - before[np.searchsorted(of, of, "left")]
    lengths = np.diff(np.r_[starts, x.size])
    mean = np.add.reduceat(size, starts) / lengths if starts.size else np.zeros(0)
    bold = np.maximum.reduceat(heavy, starts) if starts.size else np.zeros(0, bool)
    of_page = pa.array(of[kept])
    fixed = [pa.array(c, t).take(of_page) for c, t in (([rows[0][0] for rows in pages], pa.string()), ([rows[0][1] for rows in pages], pa.int32()), (page_width, pa.float64()), (page_height, pa.float64()))]
    columns = [*fixed[:2], pa.array(line_no[kept], pa.int32()), pa.array([t for t, k in zip(texts, kept.tolist(), strict=True) if k], pa.string())]
    columns += [pa.array(v[kept]) for v in (x[starts], top[starts], mean, bold)] + fixed[2:]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in LINE_SCHEMA.split(", ")])


def _whole_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Lines of a stream of pages in packs; pages are gathered until they have GATHERED_ITEMS."""
    gathered, n = [], 0
    for _, rows in groupby(rows_of(batches), lambda r: r[:2]):
        gathered.append(list(rows))
        n += sum(r[2] or 0 for r in gathered[-1])
        if n >= GATHERED_ITEMS:
            yield page_lines(gathered)
            gathered, n = [], 0
    if n:
        yield page_lines(gathered)


def layout_lines(items: DataFrame) -> DataFrame:
    """All items -> LINE_SCHEMA, a row per line."""
    margins = repeated_margins(items).withColumn("page", F.col("page").cast("int"))
    items = sized(items)
    font = F.lower(F.coalesce("font_name", F.lit("")))
    heavy = font.contains("bold") | font.contains("black") | font.contains("heavy") | (F.col("font_size") > 14)
    begin, end = _edges(F.col("x"), F.col("width"), F.col("page_width"))
    number = [F.col(c).cast("double").alias(c) for c in ("x", "y", "width", "font_size", "page_width", "page_height")]
    said = items.select("doc_id", F.col("page").cast("int").alias("page"), F.col("item_no").cast("long").alias("item_no"), "text", *number, begin.alias("begin"), end.alias("end"), heavy.alias("heavy"))
    rows = said.mapInArrow(_packed, PACK_SCHEMA).unionByName(margins, allowMissingColumns=True)
    return rows.repartition("doc_id", "page").sortWithinPartitions("doc_id", "page").mapInArrow(_whole_pages, LINE_SCHEMA)


def metadata(raw: DataFrame) -> DataFrame:
    """Title, author, subject and keywords without control characters; the year from the creation or the change date."""
    clean = lambda c: F.nullif(F.trim(F.regexp_replace(F.col(c), r"[\x00-\x1F\x7F]", "")), F.lit(""))
    year = lambda c: F.nullif(F.regexp_extract(F.col(c), r"(\d{4})", 1), F.lit("")).cast("int")
    return raw.select("doc_id", *[clean(c).alias(c) for c in ("title", "author", "subject", "keywords")], F.coalesce(year("created"), year("modified")).alias("year"))
