"""Footnotes of criteria tables: marks to the lines they stand beside, headings' marks to the rows below, numbers to note texts.

Lines are rows with a document, a page, a place ``at`` (a whole number, unique in the document, in
reading order over all pages) and a height ``y``. Windows see one page; what runs through a document goes by ``scans``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RADIUS, MAX_NOTE, MAX_NUMBER, MAX_GENERAL = 8.0, 600, 30, 2000
TITLE = r"(?i)^Application Task/Area Notes\b"
DEFINITION = r"^(\d{1,2})\s+(\S.*)$"


def bind_marks(lines: DataFrame, page: Sequence[str], at: str, y: str, is_mark: Column, can_hold: Column, radius: float = RADIUS) -> DataFrame:
    """(page, at, bound): for each mark the place of the line nearest in height within ``radius``, else of the last one before it, else null.

    Of equally near lines the first one counts. Lines and marks are merged in order of height, from both sides: what was last seen is the
    nearest one, so no pair of a mark and a line is made. Lines without a height are only found as the one before.
    """
    found = F.when(can_hold & F.col(y).isNotNull(), F.struct(F.col(y).alias("y"), F.col(at).alias("at")))
    # at one height: lines before marks, the first line last
    side = lambda order: F.last(found, ignorenulls=True).over(Window.partitionBy(*page).orderBy(order, is_mark.cast("int"), F.desc(at)).rowsBetween(Window.unboundedPreceding, 0))
    above = F.last(F.when(can_hold, F.col(at)), ignorenulls=True).over(Window.partitionBy(*page).orderBy(at).rowsBetween(Window.unboundedPreceding, -1))
    seen = lines.withColumns({"__low": side(F.asc(y)), "__high": side(F.desc(y)), "__above": above}).where(is_mark)
    near = lambda c: F.when(F.abs(F.col(y) - F.col(f"{c}.y")) <= radius, F.struct(F.abs(F.col(y) - F.col(f"{c}.y")).alias("d"), F.col(f"{c}.at").alias("at")))
    best = F.least(near("__low"), near("__high"))
    return seen.select(*page, at, F.coalesce(best["at"], F.col("__above")).alias("bound"))


def numbers_of(text: Column) -> Column:
    """Numbers of a mark ("1, 3")."""
    return F.array_compact(F.transform(F.split(text, ","), lambda s: F.trim(s).try_cast("int")))


def with_marks(lines: DataFrame, bound: DataFrame, doc: str, at: str, numbers: Column, name: str = "marks") -> DataFrame:
    """Lines with the numbers of the marks bound to them (an empty array if none)."""
    own = lines.select(F.col(doc).alias("__doc"), F.col(at).alias("__at"), numbers.alias("__n"))
    held = bound.where("bound is not null").join(own, (F.col(doc) == F.col("__doc")) & (F.col(at) == F.col("__at")))
    per_line = held.groupBy(F.col("__doc").alias("__d"), F.col("bound").alias("__b")).agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("__n")))).alias(name))
    joined = lines.join(per_line, (F.col(doc) == F.col("__d")) & (F.col(at) == F.col("__b")), "left").drop("__d", "__b")
    return joined.withColumn(name, F.coalesce(name, F.array().cast("array<int>")))


def inherited(slots: Column, chain: Column, name: str = "marks") -> Column:
    """(level, marks) of the headings whose marks hold for a row: those whose name still stands in the row's own chain."""
    levels = F.transform(slots, lambda s, i: F.struct(i.alias("level"), s["name"].alias("name"), s[name].alias("marks")))
    held = F.filter(levels, lambda v: (F.size(v["marks"]) > 0) & (F.get(chain, v["level"]) == v["name"]))
    return F.transform(held, lambda v: F.struct(v["level"].alias("level"), v["marks"].alias("marks")))


def page_notes(lines: DataFrame, page: Sequence[str], at: str, text: str, in_grid: Column) -> DataFrame:
    """(page, number, note): the notes below a page's notes title, each with the lines that continue it.

    Lines of the table's grid don't count, the next table's title ends the notes. A note that is continued is cut
    to MAX_NOTE; of two with one number the later one counts.
    """
    of_page, said = Window.partitionBy(*page), F.trim(text)
    titled = lines.withColumn("__title", F.min(F.when(said.rlike(TITLE), F.col(at))).over(of_page))
    open_ = (F.col(at) > F.col("__title")) & (said != "") & ~in_grid
    ended = titled.where(F.col("__title").isNotNull()).withColumn("__open", open_).withColumn("__end", F.min(F.when(F.col("__open") & said.rlike(r"(?i)^Table\s"), F.col(at))).over(of_page))
    inside = ended.where(F.col("__open") & (F.col("__end").isNull() | (F.col(at) < F.col("__end"))))
    number = F.regexp_extract(said, DEFINITION, 1).try_cast("int")
    defined = inside.withColumn("number", F.when(number <= MAX_NUMBER, number))
    defined = defined.withColumn("__part", F.when(F.col("number").isNotNull(), F.trim(F.regexp_extract(said, DEFINITION, 2))).otherwise(said))
    runs = defined.withColumn("__run", F.count("number").over(of_page.orderBy(at).rowsBetween(Window.unboundedPreceding, 0))).where("__run > 0")
    parts = runs.groupBy(*page, "__run").agg(F.max("number").alias("number"), F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col("__part").alias("s")))), lambda v: v["s"]).alias("parts"))
    joined = F.array_join("parts", " ")
    notes = parts.withColumn("note", F.when(F.size("parts") > 1, F.substring(joined, 1, MAX_NOTE)).otherwise(joined))
    return notes.groupBy(*page, "number").agg(F.max_by("note", "__run").alias("note"))


def document_notes(notes: DataFrame, doc: str, page: str) -> DataFrame:
    """(doc, number, note): the first page's definition of each number."""
    return notes.groupBy(doc, "number").agg(F.min_by("note", page).alias("note"))


def resolved(records: DataFrame, notes: DataFrame, doc: str, page: str, key: str, refs: str) -> DataFrame:
    """Records with ``footnotes`` and ``general_notes``.

    A record's numbers are looked up on its page; only if none of them is defined there, in the document; if none is there
    either, the numbers stand for themselves. Where no record of a document has numbers, all its notes are
    each record's general notes, cut at MAX_GENERAL.
    """
    general = document_notes(notes, doc, page)
    each = records.select(doc, page, key, F.explode(refs).alias("number"))
    looked = each.join(notes.withColumnRenamed("note", "__page"), [doc, page, "number"], "left").join(general.withColumnRenamed("note", "__doc"), [doc, "number"], "left")
    line = lambda c: F.when(F.col(c).isNotNull(), F.struct("number", F.concat_ws(". ", F.col("number").cast("string"), F.col(c)).alias("s")))
    said = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(line(c))), lambda v: v["s"]), "\n")
    of_record = looked.groupBy(F.col(doc).alias("__d"), F.col(key).alias("__k")).agg(said("__page").alias("__p"), said("__doc").alias("__g"), F.array_join(F.array_sort(F.collect_list("number")), ", ").alias("__n"))
    whole = general.groupBy(doc).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("number", F.concat_ws(". ", F.col("number").cast("string"), F.col("note")).alias("s")))), lambda v: v["s"]), "\n").alias("__all"))
    marked = records.where(F.size(refs) > 0).select(doc).distinct()
    whole = whole.join(marked, doc, "left_anti").withColumnRenamed(doc, "__d2")
    joined = records.join(of_record, (F.col(doc) == F.col("__d")) & (F.col(key) == F.col("__k")), "left").join(whole, F.col(doc) == F.col("__d2"), "left")
    foot = F.when(F.col("__p") != "", F.col("__p")).when(F.col("__g") != "", F.col("__g")).otherwise(F.concat(F.lit("See Application Task/Area Notes: "), F.col("__n")))
    cut = F.when(F.length("__all") > MAX_GENERAL, F.concat(F.substring("__all", 1, MAX_GENERAL), F.lit("…"))).otherwise(F.col("__all"))
    return joined.withColumns({"footnotes": F.when(F.col("__n").isNotNull(), foot), "general_notes": cut}).drop("__d", "__k", "__p", "__g", "__n", "__d2", "__all")
