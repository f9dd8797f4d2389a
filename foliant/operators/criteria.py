"""Criteria tables of documents as columns: lines are classified where they stand, what runs through a document is a running state.

No task holds a document. Pages are chosen and lines classified by expressions, the indentation grid is a fold over
a histogram, marks are bound page by page, hierarchy, pending links and row numbers run over pieces of the document (``scans``),
and notes are joined by page and by document (``notes``). What several of these steps read is written
to the shared scratch folder once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import js_round
from foliant.operators import extraction as fixed
from foliant.operators import notes, row_grammar, scans
from foliant.operators.vector import top_per
from foliant.sources.scratch import Scratch

STRIDE = 1 << 20  # places of a page
LEVELS, PAGE = fixed.LEVELS, ["doc_id", "page"]
java = row_grammar.java


def criteria_lines(lines: DataFrame) -> DataFrame:
    """All lines with ``pos`` (their place in the document), trimmed text, and ``chosen``: whether the page holds criteria."""
    said = lines.select("doc_id", "page", (F.col("page") * F.lit(STRIDE).cast("long") + F.col("line_no")).alias("pos"), F.trim(F.coalesce("text", F.lit(""))).alias("text"), "x", "y", F.col("font_size").alias("font"), F.coalesce("page_width", F.lit(842.0)).alias("width"), (F.col("page_width") > F.col("page_height")).alias("wide"))
    dual, data = F.col("text").rlike(fixed.DUAL_UNIT), F.col("text").rlike(java(fixed.DATA_LINE))
    of_page = Window.partitionBy(*PAGE)
    chosen = (F.count(F.lit(1)).over(of_page) >= 10) & (F.bool_or(dual).over(of_page) | (F.bool_or("wide").over(of_page) & (F.count_if(data).over(of_page) >= 3)))
    return said.withColumn("chosen", F.coalesce(chosen, F.lit(False)))


def classified(lines: DataFrame) -> DataFrame:
    """Lines with body (the document's table font), grid (in that font), and what they may be: mark, used, banner."""
    data = F.col("text").rlike(java(fixed.DATA_LINE)) & F.col("chosen")
    body = lines.where(data & F.col("font").isNotNull()).groupBy("doc_id").agg(F.expr("percentile_disc(0.5) within group (order by font desc)").alias("body"))  # the upper median
    known = lines.join(body, "doc_id", "left")
    t, digits = F.col("text"), F.col("text").rlike(r"^\d+$")
    off = F.coalesce(F.abs(F.col("font") - F.col("body")) > fixed.FONT_BAND, F.lit(False))
    mark = F.coalesce(t.rlike(java(fixed.MARKS)) & (F.col("font") <= F.col("body") - fixed.MARK_DROP), F.lit(False))
    used = F.length(t).between(2, 200) & ~F.col("mark") & ~t.rlike(java(fixed.BOILERPLATE)) & ~t.rlike(java(fixed.TABLE_TITLE)) & ~digits
    return known.withColumns({"off": off, "mark": mark, "banner": t.rlike(java(fixed.BANNER)), "digits": digits}).withColumn("used", used)


def levels_of(lines: DataFrame) -> DataFrame:
    """(doc_id, levels): left edges of the grid's lines."""
    in_grid = F.col("chosen") & (F.length("text") >= 2) & ~F.col("digits") & ~F.col("off") & (F.col("x") <= F.col("width") * fixed.LEFT_SHARE) & (F.col("text").rlike(java(fixed.DATA_LINE)) | (F.length("text") < 70))
    return scans.edge_levels(lines.where(in_grid), "doc_id", "x", fixed.INDENT, 3, fixed.LEVEL_GAP, 9)


def tables_of(lines: DataFrame) -> DataFrame:
    """(doc_id, page, table_ref): the table named on a page, else on the last page before it that names one."""
    named = F.regexp_extract("text", r"(?i)Table\s+(A-?\d+)", 1)
    pages = lines.where("chosen").groupBy(*PAGE).agg(F.min_by(F.nullif(named, F.lit("")), F.when(named != "", F.col("pos"))).alias("named"))
    last = F.last("named", ignorenulls=True).over(Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, 0))
    return pages.select(*PAGE, F.concat(F.lit("Table "), F.coalesce(F.regexp_replace(last, r"^A(\d)", "A-$1"), F.lit("A-1"))).alias("table_ref"))


def nodes(lines: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines that take part: banners, headings (title is their name) and rows (is_row), with their fields, marks and depth."""
    table = lines.where("chosen")
    bound = notes.bind_marks(table, PAGE, "pos", "y", F.col("mark"), F.col("used") & (~F.col("off") | F.col("banner")))
    marked = notes.with_marks(table, bound, "doc_id", "pos", notes.numbers_of(F.col("text")))
    used = scratch.table(marked).where(F.col("used") & (F.col("banner") | ~F.col("off"))).join(levels_of(lines), "doc_id", "left").withColumn("levels", F.coalesce("levels", F.array().cast("array<double>")))
    read = row_grammar.named(scratch.table(row_grammar.parsed(used, "text")), "label")
    x = F.coalesce("x", F.get("levels", F.lit(0)), F.lit(60.0))
    own = F.array_sort(F.array_distinct(F.concat("marks", "raised")))
    read = read.withColumns({"own": own, "depth": scans.level_of(x, F.col("levels")), "is_row": F.col("has_data") & ~F.col("banner")})
    last = F.coalesce(F.element_at(F.when(F.size("levels") > 0, F.col("levels")), -1), x)
    heading = ~F.col("is_row") & ~F.col("banner") & (F.length("name") >= 2) & (x <= last + fixed.INDENT)
    title = F.when(F.col("banner"), F.col("text")).when(heading, F.col("name"))
    outdoors = F.when(F.col("banner"), F.when(F.col("text").rlike("EXTERIOR|OUTDOOR"), "Outdoor").otherwise("Indoor"))
    kept = read.withColumns({"title": title, "place": outdoors, "depth": F.when(F.col("banner"), 0).otherwise(F.col("depth")), "own": F.when(F.col("banner"), F.array().cast("array<int>")).otherwise(F.col("own")), "link": F.when(heading | F.col("is_row"), F.col("link"))})
    return kept.where(F.col("is_row") | F.col("title").isNotNull()).drop("levels", "marks", "raised", "text", "label", "mark", "used", "off", "digits", "body", "font", "wide", "chosen", "width", "x", "y")


def records(taking_part: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows with number (in the document), chain (names by level), heads (headings' marks that hold), refs, place and link."""
    numbered = scans.running(taking_part, ["doc_id"], "pos", {"number": ("sum", F.col("is_row").cast("long"))})
    sent = F.when(~F.col("is_row") & F.col("link").isNotNull(), F.struct("pos", F.col("number").alias("after"), "link"))
    placed = scans.running(scratch.table(numbered), ["doc_id"], "pos", {"last_place": ("max", F.when(F.col("place").isNotNull(), F.struct("pos", "place"))), "sent": ("max", sent)})
    rows = scans.slot_fill(scratch.table(placed), ["doc_id"], "pos", "depth", "title", ["own"], len(LEVELS)).where("is_row")
    # a heading's link is for the next row alone
    pending = F.when(F.col("sent.after") == F.col("number") - 1, F.col("sent.link"))
    chain = scans.with_leaf(F.col("slots"), F.col("depth"), row_grammar.clean(F.col("name")))
    rows = rows.withColumns({"chain": chain, "link_mapping": F.coalesce("link", pending), "indoor_outdoor": F.coalesce("last_place.place", F.when(F.col("doc_id").rlike(java(fixed.OUTDOOR_FAMILIES)), "Outdoor").otherwise("Indoor")), "number": F.col("number") - 1})
    rows = rows.withColumn("heads", notes.inherited(F.col("slots"), F.col("chain"), "own"))
    return rows.withColumn("refs", F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("heads", lambda h: h["marks"])), "own")))).drop("slots", "title", "place", "last_place", "sent", "placed", "name", "link")


def _marks_json() -> Column:
    numbers = lambda a: F.concat(F.lit("["), F.array_join(a, ", "), F.lit("]"))
    level = F.array(*map(F.lit, LEVELS))
    heads = F.array_join(F.transform("heads", lambda h: F.concat(F.lit('"'), F.get(level, h["level"]), F.lit('": '), numbers(h["marks"]))), ", ")
    return F.when((F.size("heads") > 0) | (F.size("own") > 0), F.concat(F.lit('{"levels": {'), heads, F.lit('}, "row": '), numbers(F.col("own")), F.lit("}")))


def extract(lines: DataFrame) -> DataFrame:
    """Lines of layout.LINE_SCHEMA (doc_id is the standard's id) -> valid records (extraction.RECORD_SCHEMA), the first of each code."""
    with Scratch(lines.sparkSession) as scratch:
        return scratch.result(_extracted(lines, scratch))


def _extracted(lines: DataFrame, scratch: Scratch) -> DataFrame:
    every = scratch.table(classified(criteria_lines(lines)))
    found = scratch.table(records(scratch.table(nodes(every, scratch)), scratch)).join(tables_of(every), PAGE, "left")
    in_grid = F.col("body").isNotNull() & F.col("font").isNotNull() & ~F.col("off")
    said = scratch.table(notes.resolved(found, notes.page_notes(every, PAGE, "pos", "text", in_grid), "doc_id", "page", "pos", "refs"))
    has_ver, c = F.col("ver_lux").isNotNull(), F.col
    fc = lambda p: F.coalesce(c(f"{p}_fc"), js_round(c(f"{p}_lux") / 10, 1))
    feet = lambda p: F.coalesce(c(f"{p}_height_ft"), js_round(c(f"{p}_height_m") * 3.28084, 1))
    ver = lambda v: F.when(has_ver, v)
    zone = F.get(F.filter(F.transform(F.slice("chain", 3, 6), lambda v: F.upper(F.trim(v))), lambda v: v.rlike("^LZ[0-4]$")), F.lit(0))
    fields = {
        "code": F.concat(F.regexp_replace("doc_id", "[^A-Za-z0-9]", ""), F.lit("_"), F.format_string("%04d", c("number"))), **{k: F.get("chain", F.lit(i)) for i, k in enumerate(LEVELS)},
        "standard": c("doc_id"), "standard_full": F.concat(F.lit("ANSI/IES "), "doc_id"), "table_ref": c("table_ref"), "row_ref": F.concat(F.lit("Row "), (c("number") + 1).cast("string")), "page_number": c("page").cast("int"),
        "link_mapping": c("link_mapping"), "area_or_task": F.coalesce("area_or_task", F.lit("Area")), "indoor_outdoor": c("indoor_outdoor"), "veiling_risk": c("veiling_risk"), "class_of_play": c("class_of_play"),
        "hor_cat": c("hor_cat"), "hor_lux": c("hor_lux"), "hor_fc": fc("hor"), "hor_height_m": c("hor_height_m"), "hor_height_ft": feet("hor"), "hor_basis": F.coalesce("hor_basis", F.lit("Avg")), "hor_uniformity": c("hor_uniformity"), "hor_cv": c("hor_cv"), "hor_ratio_basis": c("hor_ratio_basis"),
        "ver_cat": ver(c("ver_cat")), "ver_lux": c("ver_lux"), "ver_fc": fc("ver"), "ver_height_m": ver(c("ver_height_m")), "ver_height_ft": ver(feet("ver")), "ver_basis": ver(F.coalesce("ver_basis", F.lit("Avg"))), "ver_uniformity": ver(c("ver_uniformity")), "ver_cv": ver(F.nullif(c("ver_cv"), F.lit(0.0))), "ver_ratio_basis": ver(F.coalesce("ver_ratio_basis", "hor_ratio_basis")),
        "tm24_eligible": F.coalesce(c("hor_cat").between("P", "Y"), F.lit(False)).cast("int").bitwiseOR(F.coalesce(c("ver_cat").between("P", "Y"), F.lit(False)).cast("int")), "lighting_zone": zone,
        "max_glare_rating": c("glare_max"), "max_uplight": c("uplight_max"), "spectrum_guidance": c("spectrum"), "controls_required": c("controls"), "footnotes": c("footnotes"), "footnote_marks": _marks_json(), "general_notes": c("general_notes"), "active": F.lit(1),
    }
    whole = said.select(*[v.alias(k) for k, v in fields.items()], c("number").alias("__number")).where(fixed.is_valid())
    return top_per(whole, ["code"], [F.col("page_number"), F.col("standard"), F.col("__number")], 1).drop("__number")
