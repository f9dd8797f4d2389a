"""Document structure bound to the test tables: events and documents stand for the lines of criteria pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import criteria, layout, notes, row_grammar, scans
from foliant.plans.bindings import ORACLE_SQL, _criteria_lines, query
from foliant.sources.scratch import Scratch

# ---------------------------------------------------------------- lines made of events

#: A document has about a thirtieth of the events; signups and clicks are headings, views rows, purchases marks, errors note lines.
LINES_SQL = """lines AS (SELECT 'D' || user_id % 30 AS doc, event_id // 500 AS page, event_id AS pos, (event_id * 37 % 41) * 4.0 AS y, (user_id + event_id) % 5 AS depth,
  CASE WHEN event_type IN ('signup', 'click') THEN 'heading' WHEN event_type = 'view' THEN 'row' WHEN event_type = 'purchase' AND user_id % 10 <> 0 THEN 'mark' ELSE 'note' END AS kind,
  'h' || CASE WHEN event_type = 'view' THEN event_id % 3 ELSE event_id % 4 END AS name, CASE WHEN event_id % 7 = 0 THEN '2, ' ELSE '' END || (1 + event_id % 12) AS numbers, event_id % 11 = 0 AS grid,
  CASE WHEN event_id % 4 = 0 THEN ' Application Task/Area Notes' WHEN event_id % 50 = 1 THEN 'Table B' WHEN event_id % 2 = 1 THEN (1 + event_id % 14) || '  note ' || event_id || ' '
    WHEN event_id % 3 = 0 THEN (31 + event_id % 9) || ' over' ELSE repeat('on ', 1 + event_id % 250) || event_id END AS text FROM events)"""


def _lines(read):
    e, i, u, kind = read("events"), F.col("event_id"), F.col("user_id"), F.col("event_type")
    said = F.when(i % 4 == 0, " Application Task/Area Notes").when(i % 50 == 1, "Table B").when(i % 2 == 1, F.concat((i % 14 + 1).cast("string"), F.lit("  note "), i.cast("string"), F.lit(" ")))
    said = said.when(i % 3 == 0, F.concat((i % 9 + 31).cast("string"), F.lit(" over"))).otherwise(F.concat(F.repeat(F.lit("on "), (i % 250 + 1).cast("int")), i.cast("string")))
    return e.select(
        F.concat(F.lit("D"), (u % 30).cast("string")).alias("doc"), F.floor(i / 500).alias("page"), i.alias("pos"), ((i * 37) % 41 * 4.0).alias("y"), ((u + i) % 5).alias("depth"),
        F.when(kind.isin("signup", "click"), "heading").when(kind == "view", "row").when((kind == "purchase") & (u % 10 != 0), "mark").otherwise("note").alias("kind"),
        F.concat(F.lit("h"), F.when(kind == "view", i % 3).otherwise(i % 4).cast("string")).alias("name"), F.concat(F.when(i % 7 == 0, "2, ").otherwise(""), (i % 12 + 1).cast("string")).alias("numbers"),
        (i % 11 == 0).alias("grid"), said.alias("text"),
    )


#: The state of the slots after each line of a document, line by line.
SLOTS_SQL = """ordered AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY pos) AS n FROM {lines}),
fold AS (SELECT o.*, list_resize([]::VARCHAR[], 8) AS slots, list_resize([]::VARCHAR[], 8) AS held, 0 AS filled, NULL::BIGINT AS placed FROM (SELECT DISTINCT doc, 0::BIGINT AS n FROM lines) o
  UNION ALL SELECT o.doc, o.n,
    CASE WHEN o.kind = 'heading' THEN list_resize(f.slots[1:least(o.depth, f.filled)] || [o.name], 8) ELSE f.slots END,
    CASE WHEN o.kind = 'heading' THEN list_resize(f.held[1:least(o.depth, f.filled)] || [o.marks], 8) ELSE f.held END,
    CASE WHEN o.kind = 'heading' THEN least(o.depth, f.filled) + 1 ELSE f.filled END, CASE WHEN o.kind = 'heading' THEN least(o.depth, f.filled) END
  FROM fold f JOIN ordered o ON o.doc = f.doc AND o.n = f.n + 1)"""
LEAF_SQL = "list_transform(f.slots, lambda s, i: CASE WHEN i = least(o.depth, f.filled) + 1 THEN o.name ELSE s END)"


def _path(names):
    return F.array_join(F.transform(names, lambda s: F.coalesce(s, F.lit(""))), ">")


@query(f"""WITH RECURSIVE {LINES_SQL}, {SLOTS_SQL.format(lines="(SELECT *, '' AS marks FROM lines)")}
SELECT o.doc, o.pos, f.placed, array_to_string(list_transform(CASE WHEN o.kind = 'row' THEN {LEAF_SQL} ELSE f.slots END, lambda s: coalesce(s, '')), '>') AS path FROM fold f JOIN ordered o USING (doc, n)""")
def slot_fill(read):
    """Hierarchy slots of headings, and of rows with their own name in."""
    lines = _lines(read).withColumn("title", F.when(F.col("kind") == "heading", F.col("name")))
    placed = scans.slot_fill(lines, ["doc"], "pos", "depth", "title")
    names = F.when(F.col("kind") == "row", scans.with_leaf(F.col("slots"), F.col("depth"), F.col("name"))).otherwise(F.transform("slots", lambda s: s["name"]))
    return placed.select("doc", "pos", F.col("placed").cast("long").alias("placed"), _path(names).alias("path"))


BOUND_SQL = """near AS (SELECT m.doc, m.page, m.pos, t.pos AS bound, row_number() OVER (PARTITION BY m.doc, m.pos ORDER BY abs(t.y - m.y), t.pos) AS rn
  FROM lines m JOIN lines t ON t.doc = m.doc AND t.page = m.page AND t.kind IN ('heading', 'row') AND abs(t.y - m.y) <= 8 WHERE m.kind = 'mark'),
above AS (SELECT m.doc, m.pos, max(t.pos) AS bound FROM lines m JOIN lines t ON t.doc = m.doc AND t.page = m.page AND t.kind IN ('heading', 'row') AND t.pos < m.pos WHERE m.kind = 'mark' GROUP BY m.doc, m.pos),
bound AS (SELECT m.doc, m.page, m.pos, coalesce(n.bound, a.bound) AS bound FROM lines m LEFT JOIN (SELECT * FROM near WHERE rn = 1) n ON n.doc = m.doc AND n.pos = m.pos LEFT JOIN above a ON a.doc = m.doc AND a.pos = m.pos WHERE m.kind = 'mark')"""


def _bound(lines):
    return notes.bind_marks(lines, ["doc", "page"], "pos", "y", F.col("kind") == "mark", F.col("kind").isin("heading", "row"))


@query(f"WITH {LINES_SQL}, {BOUND_SQL} SELECT doc, page, pos, bound FROM bound")
def mark_binding(read):
    """Marks to the nearest line by height, else to the one before."""
    return _bound(_lines(read))


MARKED_SQL = """marks AS (SELECT b.doc, b.bound AS pos, list_sort(list_distinct(flatten(list(list_transform(string_split(l.numbers, ', '), lambda s: s::INTEGER))))) AS marks
  FROM bound b JOIN lines l ON l.doc = b.doc AND l.pos = b.pos WHERE b.bound IS NOT NULL GROUP BY b.doc, b.bound),
marked AS (SELECT l.*, coalesce(array_to_string(m.marks, ','), '') AS marks FROM lines l LEFT JOIN marks m USING (doc, pos))"""
CHAINS_SQL = f"""chains AS (SELECT o.doc, o.page, o.pos, o.marks, f.slots, f.held, {LEAF_SQL} AS chain FROM fold f JOIN ordered o USING (doc, n) WHERE o.kind = 'row'),
records AS (SELECT doc, page, pos, marks, list_filter(list_transform(range(1, 9), lambda i: CASE WHEN coalesce(held[i], '') <> '' AND chain[i] = slots[i] THEN (i - 1) || ':' || held[i] END), lambda v: v IS NOT NULL) AS levels FROM chains)"""


def _records(read, cut=lambda df: df):
    """``cut`` writes what many later steps read."""
    lines = _lines(read)
    marked = cut(notes.with_marks(lines, _bound(lines), "doc", "pos", notes.numbers_of(F.col("numbers"))).withColumn("title", F.when(F.col("kind") == "heading", F.col("name"))))
    rows = scans.slot_fill(marked, ["doc"], "pos", "depth", "title", ["marks"]).where("kind = 'row'")
    return rows.withColumn("levels", notes.inherited(F.col("slots"), scans.with_leaf(F.col("slots"), F.col("depth"), F.col("name"))))


@query(f"""WITH RECURSIVE {LINES_SQL}, {BOUND_SQL}, {MARKED_SQL}, {SLOTS_SQL.format(lines="marked")}, {CHAINS_SQL}
SELECT doc, pos, marks AS own, array_to_string(levels, ' ') AS levels FROM records""")
def inherited_marks(read):
    """Marks of a row and of the headings above it that still hold."""
    said = F.array_join(F.transform("levels", lambda v: F.concat_ws(":", v["level"].cast("string"), F.array_join(v["marks"], ","))), " ")
    return _records(read).select("doc", "pos", F.array_join("marks", ",").alias("own"), said.alias("levels"))


NOTES_SQL = r"""said AS (SELECT doc, page, pos, trim(text) AS t, grid OR kind <> 'note' AS grid, min(CASE WHEN kind = 'note' AND regexp_matches(trim(text), '(?i)^Application Task/Area Notes\b') THEN pos END) OVER (PARTITION BY doc, page) AS title FROM lines),
opened AS (SELECT *, min(CASE WHEN regexp_matches(t, '(?i)^Table\s') THEN pos END) OVER (PARTITION BY doc, page) AS ends FROM said WHERE pos > title AND NOT grid AND t <> ''),
defs AS (SELECT *, CASE WHEN regexp_matches(t, '^\d{1,2}\s+\S') AND regexp_extract(t, '^\d+')::INTEGER <= 30 THEN regexp_extract(t, '^\d+')::INTEGER END AS number FROM opened WHERE ends IS NULL OR pos < ends),
runs AS (SELECT *, count(number) OVER (PARTITION BY doc, page ORDER BY pos) AS run FROM defs),
parts AS (SELECT doc, page, run, max(number) AS number, count(*) AS n, string_agg(CASE WHEN number IS NULL THEN t ELSE trim(regexp_replace(t, '^\d+\s+', '')) END, ' ' ORDER BY pos) AS note FROM runs WHERE run > 0 GROUP BY doc, page, run),
notes AS (SELECT doc, page, number, CASE WHEN n > 1 THEN left(note, 600) ELSE note END AS note FROM parts QUALIFY row_number() OVER (PARTITION BY doc, page, number ORDER BY run DESC) = 1)"""


def _notes(read):
    said = _lines(read).withColumn("text", F.when(F.col("kind") == "note", F.col("text")).otherwise(""))
    return notes.page_notes(said, ["doc", "page"], "pos", "text", F.col("grid") | (F.col("kind") != "note"))


@query(f"WITH {LINES_SQL}, {NOTES_SQL} SELECT doc, page, number, note FROM notes")
def page_notes(read):
    """Numbered notes below a page's notes title."""
    return _notes(read)


@query(f"""WITH RECURSIVE {LINES_SQL}, {BOUND_SQL}, {MARKED_SQL}, {SLOTS_SQL.format(lines="marked")}, {CHAINS_SQL}, {NOTES_SQL},
general AS (SELECT doc, number, note FROM notes QUALIFY row_number() OVER (PARTITION BY doc, number ORDER BY page) = 1),
refs AS (SELECT doc, page, pos, list_sort(list_distinct(list_filter(list_transform(string_split(array_to_string(list_transform(levels, lambda v: string_split(v, ':')[2]) || [marks], ','), ','), lambda s: TRY_CAST(s AS INTEGER)), lambda v: v IS NOT NULL))) AS refs FROM records),
each AS (SELECT doc, page, pos, unnest(refs) AS number FROM refs),
looked AS (SELECT e.doc, e.pos, string_agg(e.number || '. ' || p.note, chr(10) ORDER BY e.number) AS p, string_agg(e.number || '. ' || g.note, chr(10) ORDER BY e.number) AS g, string_agg(e.number::VARCHAR, ', ' ORDER BY e.number) AS n
  FROM each e LEFT JOIN notes p ON p.doc = e.doc AND p.page = e.page AND p.number = e.number LEFT JOIN general g ON g.doc = e.doc AND g.number = e.number GROUP BY e.doc, e.pos),
whole AS (SELECT doc, string_agg(number || '. ' || note, chr(10) ORDER BY number) AS s FROM general WHERE doc NOT IN (SELECT doc FROM each) GROUP BY doc)
SELECT r.doc, r.pos, coalesce(l.p, l.g, 'See Application Task/Area Notes: ' || l.n) AS footnotes, CASE WHEN length(w.s) > 2000 THEN left(w.s, 2000) || '…' ELSE w.s END AS general_notes
FROM refs r LEFT JOIN looked l USING (doc, pos) LEFT JOIN whole w USING (doc)""")
def footnotes(read):
    """Each row's notes: of its page, else of its document, else the numbers; all notes where no row has a number."""
    with Scratch(read("events").sparkSession) as scratch:
        refs = F.array_sort(F.array_distinct(F.concat(F.flatten(F.transform("levels", lambda v: v["marks"])), F.col("marks"))))
        records = scratch.table(_records(read, scratch.table).select("doc", "page", "pos", refs.alias("refs")))
        found = notes.resolved(records, scratch.table(_notes(read)), "doc", "page", "pos", "refs")
        return scratch.result(found.select("doc", "pos", "footnotes", "general_notes"))


# ---------------------------------------------------------------- lines of documents


@query("""WITH RECURSIVE d AS (SELECT doc_id, string_split(text, chr(10)) AS t FROM documents), lines AS (SELECT doc_id, unnest(range(len(t))) AS n, unnest(t) AS t FROM d),
words AS (SELECT doc_id, n, len(regexp_extract_all(t, '[^\\x20\\x09-\\x0D]+')) AS w FROM lines),
fold AS (SELECT doc_id, 0::BIGINT AS n, 0::BIGINT AS segment, (SELECT w FROM words x WHERE x.doc_id = d.doc_id AND x.n = 0)::BIGINT AS c FROM d WHERE t IS NOT NULL
  UNION ALL SELECT w.doc_id, w.n, f.segment + (f.c >= 350)::BIGINT, CASE WHEN f.c >= 350 THEN 2 ELSE f.c END + w.w FROM fold f JOIN words w ON w.doc_id = f.doc_id AND w.n = f.n + 1)
SELECT doc_id, segment, count(*) AS n_lines, sum(w)::BIGINT AS n_words FROM fold JOIN words USING (doc_id, n) GROUP BY doc_id, segment""")
def count_segments(read):
    """Lines by chunks of at least 350 words; the next chunk begins with a prefix of two."""
    lines = read("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "t")).select("doc_id", F.col("n").cast("long").alias("n"), F.size(F.regexp_extract_all("t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    got = scans.segments(lines, "doc_id", "n", "w", 350, restart=2)
    return got.groupBy("doc_id", "segment").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("w").alias("n_words"))


@query("""WITH RECURSIVE edges AS (SELECT l_suppkey AS doc, CASE WHEN l_partkey % 211 = 0 THEN 60.0 + l_partkey % 97 ELSE 64.0 + (l_linenumber % 5) * (7 + l_suppkey % 4) + (l_partkey % 3) * 0.5 + CASE WHEN l_linenumber % 5 = 4 AND l_suppkey % 3 = 0 THEN 33 ELSE 0 END END AS x FROM lineitem),
h AS (SELECT doc, x, count(*) AS n, row_number() OVER (PARTITION BY doc ORDER BY x) AS k FROM edges GROUP BY doc, x),
fold AS (SELECT doc, k, 1 AS c, x * n AS s, n FROM h WHERE k = 1
  UNION ALL SELECT h.doc, h.k, CASE WHEN h.x - f.s / f.n <= 4 THEN f.c ELSE f.c + 1 END, CASE WHEN h.x - f.s / f.n <= 4 THEN f.s ELSE 0 END + h.x * h.n, CASE WHEN h.x - f.s / f.n <= 4 THEN f.n ELSE 0 END + h.n FROM fold f JOIN h ON h.doc = f.doc AND h.k = f.k + 1),
c AS (SELECT doc, c, s / n AS mean FROM fold WHERE c = 1 OR n >= 3 QUALIFY row_number() OVER (PARTITION BY doc, c ORDER BY k DESC) = 1),
kept AS (SELECT *, row_number() OVER (PARTITION BY doc ORDER BY c) AS level, coalesce(mean - lag(mean) OVER (PARTITION BY doc ORDER BY c) > 30, false) AS far FROM c)
SELECT doc, level - 1 AS level, floor(mean * 1000 + 0.5) / 1000 AS x FROM (SELECT *, sum(far::INTEGER) OVER (PARTITION BY doc ORDER BY c) AS cut FROM kept) WHERE cut = 0 AND level <= 9""")
def edge_levels(read):
    """Left edges of a document's lines as levels of indentation."""
    p, s, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    x = F.when(p % 211 == 0, p % 97 + 60.0).otherwise((n % 5) * (s % 4 + 7) + 64.0 + (p % 3) * 0.5 + F.when((n % 5 == 4) & (s % 3 == 0), 33).otherwise(0))
    levels = scans.edge_levels(read("lineitem").select(s.alias("doc"), x.alias("x")), "doc", "x")
    return levels.select("doc", F.posexplode("levels").alias("level", "x")).select("doc", F.col("level").cast("long").alias("level"), (F.floor(F.col("x") * 1000 + 0.5) / 1000).alias("x"))


# ---------------------------------------------------------------- pages made of words

#: Twelve words a row, forty rows a page, a gutter after the sixth word that is wide enough for two columns in some documents only.
ITEMS_SQL = """words AS (SELECT doc_id, unnest(w) AS text, unnest(range(len(w))) AS i FROM (SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS w FROM documents)),
items AS (SELECT doc_id, text, i % 12 AS k, i // 12 % 40 AS r, i // 480 + 1 AS page, 40.0 + (i % 12) * 40 + CASE WHEN i % 12 < 6 THEN 0 ELSE CASE doc_id % 4 WHEN 0 THEN 30 WHEN 1 THEN 12 WHEN 2 THEN 0 ELSE 55 END END AS x, least(36.0, length(text) * 5.0) AS width FROM words),
pages AS (SELECT doc_id, page, count(*) AS n FROM items GROUP BY doc_id, page),
band AS (SELECT doc_id, page, unnest(range(30, 92)) AS b FROM pages),
cover AS (SELECT DISTINCT doc_id, page, unnest(range(floor(x / 5)::BIGINT, least(123, ceil((x + width) / 5)::BIGINT) + 1)) AS b FROM items),
free AS (SELECT *, b - row_number() OVER (PARTITION BY doc_id, page ORDER BY b) AS g FROM band ANTI JOIN cover USING (doc_id, page, b)),
gaps AS (SELECT doc_id, page, min(b) AS a, count(*) AS len FROM free GROUP BY doc_id, page, g QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY count(*) DESC, min(b)) = 1),
ends AS (SELECT doc_id, page, min(b) AS low, max(b) AS high FROM cover GROUP BY doc_id, page),
wide AS (SELECT doc_id, page, (a + len / 2) * 5 AS split FROM gaps JOIN ends USING (doc_id, page) WHERE len * 5 >= 12 AND low < a AND high >= a + len AND abs((a + len / 2) * 5 - 306) <= 153),
sides AS (SELECT doc_id, page, split, count(*) FILTER (x < split) AS l, count(*) AS n FROM items JOIN wide USING (doc_id, page) GROUP BY doc_id, page, split),
splits AS (SELECT doc_id, page, split FROM sides WHERE n >= 30 AND least(l, n - l) >= n * 0.2)"""


def _items(read):
    w = F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    words = read("documents").select(F.col("doc_id").cast("string").alias("doc_id"), (F.col("doc_id") % 4).alias("kind"), F.posexplode(w).alias("i", "text"))
    gutter = F.when(F.col("kind") == 0, 30).when(F.col("kind") == 1, 12).when(F.col("kind") == 2, 0).otherwise(55)
    i = F.col("i")
    return words.select(
        "doc_id", (F.floor(i / 480) + 1).cast("int").alias("page"), "i", "text", ((i % 12) * 40 + 40.0 + F.when(i % 12 < 6, 0).otherwise(gutter)).alias("x"), (760.0 - F.floor(i / 12) % 40 * 18).alias("y"),
        F.least(F.lit(36.0), F.length("text") * 5.0).alias("width"), F.lit(10.0).alias("font_size"), F.lit("Serif").alias("font_name"), F.lit(612.0).alias("page_width"), F.lit(792.0).alias("page_height"),
    ).withColumnRenamed("i", "item_no")


@query(f"WITH {ITEMS_SQL} SELECT doc_id::VARCHAR AS doc_id, page, split::DOUBLE AS split FROM splits")
def column_splits(read):
    """Where pages of two columns divide."""
    return layout.column_splits(layout.sized(_items(read)))


@query(f"""WITH {ITEMS_SQL},
margin AS (SELECT doc_id, text, floor((32 + r * 18) / 5.0 + 0.5) AS height, count(*) AS n FROM items WHERE page <= 5 AND (32 + r * 18 < 792 * 0.08 OR 32 + r * 18 > 792 * (1 - 0.08)) GROUP BY ALL),
sample AS (SELECT doc_id, count(DISTINCT page) AS n_pages FROM items WHERE page <= 5 GROUP BY doc_id),
skipped AS (SELECT DISTINCT doc_id, lower(text) AS said FROM margin JOIN sample USING (doc_id) WHERE n >= least(3, n_pages - 1)),
said AS (SELECT doc_id, page, coalesce(x >= split, false) AS side, r, string_agg(text, ' ' ORDER BY k) AS text, min(x) AS x FROM items LEFT JOIN splits USING (doc_id, page) GROUP BY doc_id, page, side, r)
SELECT doc_id::VARCHAR AS doc_id, page, row_number() OVER (PARTITION BY doc_id, page ORDER BY side, r) - 1 AS line_no, md5(text) AS h, x::DOUBLE AS x, (32 + r * 18)::DOUBLE AS y FROM said WHERE NOT EXISTS (SELECT 1 FROM skipped s WHERE s.doc_id = said.doc_id AND s.said = lower(said.text))""")
def layout_columns(read):
    """Lines of pages of one and of two columns in reading order."""
    return layout.layout_lines(_items(read)).select("doc_id", "page", "line_no", F.md5("text").alias("h"), "x", "y")


# ---------------------------------------------------------------- rows of criteria tables

#: A line for each part, in eight forms: one plane, two planes, a placeholder, a glued letter, a heading, surroundings, footcandles alone, an empty plane.
FORMS_SQL = """SELECT p_partkey, p_partkey % 8 AS f, p_size AS n, CASE p_partkey % 8 WHEN 0 THEN 'Space ' || p_partkey || ' room' WHEN 1 THEN 'Hall' WHEN 2 THEN 'Rm, < ' || p_size || ' people' WHEN 3 THEN 'Court (avg.)'
  WHEN 4 THEN 'Heading ' || p_partkey || ' of rooms' WHEN 5 THEN 'Path' WHEN 6 THEN 'Room Min' ELSE 'Lot' END AS label FROM part"""


def _forms(read):
    key, n = F.col("p_partkey"), F.col("p_size").cast("string")
    said = {
        0: ("Space ", key.cast("string"), " room T P ", n, "0 lx @ TS ", n, " fc @ TS Avg"), 1: ("Hall A L M ", n, " lx @ 0.76 m ", n, " fc @ 2.5 ft Max 3:1 O 200 lx @ 1.22 m 20 fc @ 4 ft Min"),
        2: ("Rm, < ", n, " people T # 0.76 m # 2.5 ft O ", n, " lx @ 1.22 m ", n, " fc @ 4 ft Avg"), 3: ("Court (avg.)A", n, " lx"), 4: ("Heading ", key.cast("string"), " of rooms"),
        5: ("Path T ", n, " lux 40% G3 Class of Play: II"), 6: ("Room Min T H ", n, ".5 footcandles @ 0 ft"), 7: ("Lot # ", n, " lx"),
    }
    text = F.coalesce(*[F.when(key % 8 == f, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])) for f, parts in said.items()])
    return read("part").select("p_partkey", text.alias("text"))


@query(f"""SELECT p_partkey, label, f <> 4 AS has_data, CASE WHEN f IN (0, 2, 5, 6) THEN 'Task' WHEN f IN (1, 3) THEN 'Area' END AS area_or_task, CASE f WHEN 1 THEN 'L' WHEN 6 THEN 'H' END AS veiling_risk,
CASE f WHEN 0 THEN 'P' WHEN 1 THEN 'M' WHEN 5 THEN 'T' END AS hor_cat, CASE WHEN f = 0 THEN n * 10.0 WHEN f IN (1, 3, 5) THEN n END::DOUBLE AS hor_lux, CASE f WHEN 1 THEN 0.76 END::DOUBLE AS hor_height_m, CASE WHEN f IN (0, 1) THEN n WHEN f = 6 THEN n + 0.5 END::DOUBLE AS hor_fc, CASE f WHEN 0 THEN 'Avg' WHEN 1 THEN 'Max' END AS hor_basis,
CASE f WHEN 1 THEN '3:1' END AS hor_uniformity, CASE WHEN f IN (1, 2) THEN 'O' END AS ver_cat, CASE WHEN f = 1 THEN 200 WHEN f IN (2, 7) THEN n END::DOUBLE AS ver_lux, CASE WHEN f IN (1, 2) THEN 1.22 END::DOUBLE AS ver_height_m, CASE f WHEN 1 THEN 20 WHEN 2 THEN n END::DOUBLE AS ver_fc,
CASE f WHEN 1 THEN 'Min' WHEN 2 THEN 'Avg' END AS ver_basis, CASE f WHEN 5 THEN 'G3' END AS glare_max, CASE f WHEN 5 THEN 'II' END AS class_of_play FROM ({FORMS_SQL})""")
def row_forms(read):
    """Rows of every form, field by field."""
    fields = "label has_data area_or_task veiling_risk hor_cat hor_lux hor_height_m hor_fc hor_basis hor_uniformity ver_cat ver_lux ver_height_m ver_fc ver_basis glare_max class_of_play".split()
    return row_grammar.parsed(_forms(read), "text").select("p_partkey", *fields)


@query(ORACLE_SQL["extract_rows"])
def criteria_rows(read):
    """Records of criteria pages, all by columns."""
    return criteria.extract(_criteria_lines(read)).select("standard", "page_number", "sub_category", "app", "area_or_task", "hor_cat", "hor_lux", "hor_fc", "hor_basis", "tm24_eligible")
