"""Layout, chunks, tables, criteria rows, links: golden and property tests on made pages."""

import json
import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from foliant.operators import chunking, extraction, layout, references, tables
from foliant.plans import catalogue


def line(text, x, y, font=7.5):
    return extraction.Line(text, x, y, font)


def test_row_with_two_planes():
    r = extraction.parse_data_row("Reading room T M P 300 lx @ TS 30 fc @ TS Avg 1.5:1 Max:Avg CV 3% N 100 lx @ 1.5 m 10 fc @ 5 ft Min 4:1 Max:Min 12% U2 Dim to 30% 2700 K to 4000 K Class IV")
    want = {
        "label": "Reading room", "area_or_task": "Task", "veiling_risk": "M", "hor_cat": "P", "hor_lux": 300, "hor_fc": 30, "hor_height_m": None, "hor_basis": "Avg", "hor_uniformity": "1.5:1", "hor_ratio_basis": "Max:Avg", "hor_cv": 3,
        "ver_cat": "N", "ver_lux": 100, "ver_height_m": 1.5, "ver_height_ft": 5, "ver_basis": "Min", "ver_uniformity": "4:1", "ver_ratio_basis": "Max:Min", "glare_max": "12%", "uplight_max": "U2", "controls": "Dim to 30%",
        "spectrum": "2700K to 4000K", "class_of_play": "IV",
    }
    assert {k: r[k] for k in want} == want


def test_placeholder_moves_the_pair_to_the_vertical_plane():
    r = extraction.parse_data_row("Conference rm, < 50 people T # 0.76 m # 2.5 ft O 200 lx @ 1.22 m 20 fc @ 4 ft Avg")
    assert (r["label"], r["hor_lux"], r["ver_lux"], r["ver_cat"], r["ver_height_m"]) == ("Conference rm, < 50 people", None, 200, "O", 1.22)


@pytest.mark.parametrize("text,label,mark", [("Day A 50 lx", "Day", "Area"), ("Room (avg.)A50 lx", "Room (avg.)", "Area"), ("Target lux", "Target lux", None), ("Court 0 T 75 lx @ 0 m", "Court 0", "Task")])
def test_labels(text, label, mark):
    r = extraction.parse_data_row(text)
    assert (r["label"], r["area_or_task"]) == (label, mark)


def criteria_page():
    return [
        line("INTERIOR", 70, 10), line("Healthcare", 70, 20), line("Entrances", 78, 30), line("1", 120, 29, 4.5), line("Emergency department entry", 86, 40), line("Day A P 200 lx @ 0 m 20 fc @ 0 ft Avg", 94, 50), line("2", 140, 49, 4.5),
        line("Night A N 100 lx @ TS 10 fc @ TS Avg", 94, 60), line("Lobby A M 100 lx @ TS 10 fc @ TS Avg", 78, 70), line("Other", 70, 80), line("Hall A K 50 lx @ TS 5 fc @ TS Avg", 78, 90), line("Room A K 50 lx @ TS 5 fc @ TS Avg", 78, 95),
        line("x x", 86, 120), line("y y", 94, 130), line("z z", 86, 140), line("Application Task/Area Notes", 70, 200, 9.5), line("1 General principles apply", 70, 210, 9.5), line("continued here.", 70, 220, 9.5), line("2 Night only", 70, 230, 9.5),
    ]


def test_hierarchy_and_footnotes():
    got = extraction.extract_pages([extraction.Page(5, 792, criteria_page())], {5: True}, "RP-29-22")
    assert [r["code"] for r in got[:2]] == ["RP2922_0000", "RP2922_0001"]
    assert [got[0][x] for x in extraction.LEVELS[:4]] == ["Healthcare", "Entrances", "Emergency department entry", "Day"]
    assert got[0]["footnotes"] == "1. General principles apply continued here.\n2. Night only" and json.loads(got[0]["footnote_marks"]) == {"levels": {"app": [1]}, "row": [2]}
    assert got[1]["footnotes"] == "1. General principles apply continued here." and got[3]["footnotes"] is None
    assert got[0]["tm24_eligible"] == 1 and got[3]["tm24_eligible"] == 0 and got[0]["hor_fc"] == 20


def test_extraction_as_tables(spark):
    rows = [("RP-29-22", 5, i, s.text, float(s.x), float(s.y), float(s.font), False, 792.0, 612.0) for i, s in enumerate(criteria_page())]
    lines = spark.createDataFrame(rows, layout.LINE_SCHEMA)
    got = extraction.extract_rows(lines)
    assert got.count() == 5 and extraction.classify(lines).first()["structure"] == "NEW_TABLE"
    report = extraction.extraction_report(got).first()
    assert report["total"] == 5 and report["gaps"] == 0 and report["passed"]
    assert got.select(extraction.embed_text().alias("t")).first()["t"].startswith("Day. Day")


def test_chunks_of_sections_and_references():
    pages = [(1, [("1.2 Scope of the work", 50.0), ("word " * 40, 50.0)]), (2, [("10.0 References", 50.0), ("1. Smith J. A study of light and of more. 2019.", 50.0), ("2. Jones K. Another study of the light levels. 2020.", 50.0), ("10 CFR Part 430, Energy Conservation Program 2011 for all.", 50.0), ("Annex B Notes", 50.0), ("tail " * 35, 50.0)])]
    got = [(page, section, kind) for _, page, section, kind, _ in chunking.chunk_pages(pages)]
    assert got == [(1, "1.2", "text"), (2, "10.0", "reference"), (2, "10.0", "reference"), (2, "10.0", "reference"), (2, "A", "text")]


def test_hanging_indent_starts_an_entry():
    pages = [(1, [("References", 50.0), ("Some organisation without any numbering at all", 50.0), ("continued further in with more words", 58.0), ("Next entry that also has quite some words", 50.0)])]
    assert len(chunking.chunk_pages(pages)) == 2


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(1, 60), max_size=40))
def test_chunks_keep_all_words(sizes):
    pages = [(1, [(" ".join(["w"] * n), None) for n in sizes])]
    got = chunking.chunk_pages(pages, chunking.Options(target=50, overlap=0, least=0))
    assert sum(c[4] for c in got) == sum(sizes)


def test_raw_tables_and_notes():
    t = tables.read_block(["Table A-1: Criteria", "Application  Lux", "Office  300", "Lobby  100", "1 Note text"])
    assert (t["title"], t["headers"], t["rows"], t["footnotes"]) == ("Table A-1: Criteria", ["Application  Lux"], [["Office", "300"], ["Lobby", "100"]], "1 Note text")
    assert tables.general_notes(["General Notes", "w " * 30, "3.1 Next section", "x"])[0][0] == "General Notes"


def test_two_columns_and_repeated_headers(spark):
    items = []
    for page in (1, 2, 3, 4):
        items.append(("d", page, 0, "RUNNING HEAD", 200.0, 780.0, 80.0, 9.0, "Serif", 612.0, 792.0))
        for i in range(20):
            for x, side in ((50.0, "left"), (330.0, "right")):
                items.append(("d", page, i, f"{side}{i}", x, 700.0 - 20 * i, 200.0, 10.0, "Serif-Bold" if i == 0 else "Serif", 612.0, 792.0))
    got = layout.layout_lines(spark.createDataFrame(items, "doc_id string, page int, item_no int, text string, x double, y double, width double, font_size double, font_name string, page_width double, page_height double")).where("page = 2").orderBy("line_no").collect()
    assert [r["text"] for r in got] == [f"left{i}" for i in range(20)] + [f"right{i}" for i in range(20)]
    assert got[0]["bold"] and not got[1]["bold"]


def test_spaces_by_gaps():
    words = [("Client", 0.0, 30.0, 10.0), ("preferences", 35.0, 55.0, 10.0), (";", 90.0, 3.0, 10.0), ("next", 110.0, 20.0, 10.0)]
    assert layout.joined(words) == "Client preferences; next"


def test_reference_links(spark):
    std = spark.createDataFrame([("RP-8-25", "u/rp8", "Active"), ("RP-8-18", "u/old", "Deprecated"), ("TM-30-20", "u/tm30", "Active"), ("TM-30-24", "u/tm30new", "Active"), ("TM-38-21", "u/tm38", "Active"), ("LM-79-19", None, "Active")], "id string, web_url string, status string")
    texts = [("ANSI/IES RP-8-25 Roadway", "u/rp8"), ("IES TM-30 Method", "u/tm30new"), ("ANSI/IES RP-8-18", "u/rp8"), ("IES LM-79-19 https://a.b/c.", "https://a.b/c"), ("doi 10.1000/xyz).", "https://doi.org/10.1000/xyz"), ("nothing", None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(texts)], "i int, t string")
    got = {r["i"]: r["link"] for r in references.reference_links(df, "t", std).collect()}
    assert got == {i: want for i, (_, want) in enumerate(texts)}


def test_metadata(spark):
    df = spark.createDataFrame([("d", "A\x00 title", None, "", "k", None, "D:20210305")], "doc_id string, title string, author string, subject string, keywords string, created string, modified string")
    assert layout.metadata(df).first().asDict() == {"doc_id": "d", "title": "A title", "author": None, "subject": None, "keywords": "k", "year": 2021}


def test_gate(spark):
    base = {x: None for x in extraction.LEVELS}
    names = [({"app": "Lobby"}, True), ({"app": "Lobby 50 lx"}, False), ({"app": "visi-"}, False), ({}, False), ({"app": "x" * 121}, False)]
    df = spark.createDataFrame([(i, *[{**base, **n}[x] for x in extraction.LEVELS]) for i, (n, _) in enumerate(names)], "i int, " + ", ".join(f"{x} string" for x in extraction.LEVELS))
    assert [r["ok"] for r in df.select("i", extraction.is_valid().alias("ok")).orderBy("i").collect()] == [ok for _, ok in names]
    gap = df.select(extraction.hierarchy_gaps().alias("g"), F.lit(1)).first()["g"]
    assert gap is False


def test_layout_query_keeps_whole_documents(spark, tmp_path):
    lines = [" ".join(f"w{n}x{k}" for k in range(1 + n * 7 % 40)) for n in range(200)]
    spark.createDataFrame([(1, "\n".join(lines))], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = catalogue.QUERIES["layout_lines"](spark, str(tmp_path)).collect()
    assert sorted(w for r in got for w in r["text"].split()) == sorted(w for line in lines for w in line.split())
    assert all(0 <= r["y"] <= 792 for r in got)


def test_column_splits_by_buckets(spark):
    """Against a plain map of covered buckets, on pages of many widths and gutters."""
    r, rows, want = random.Random(4), [], {}
    for p in range(200):
        width, n, gap = r.choice([612.0, 595.3, 400.0, 792.0]), r.choice([10, 29, 30, 40, 60]), r.choice([0, 5, 10, 13, 15, 20, 60])
        middle, share = width * r.choice([0.2, 0.3, 0.5, 0.5, 0.5, 0.7]), r.choice([0.5, 0.5, 0.15])
        items = []
        for _ in range(n):
            left = r.random() < share
            x = r.uniform(20, max(21, middle - gap / 2 - 40)) if left else r.uniform(middle + gap / 2, max(middle + gap / 2 + 1, width - 60))
            items.append((round(x, 2), round(r.uniform(5, max(6, middle - gap / 2 - x)) if left else r.uniform(5, 100), 2)))
        rows += [("d", p, k, "t", x, 100.0, w, 10.0, "f", width, 792.0) for k, (x, w) in enumerate(items)]
        buckets = math.ceil(width / 5) + 1
        covered = {b for x, w in items for b in range(int(x // 5), min(buckets - 1, math.ceil((x + w) / 5)) + 1)}
        low, high = int(width * 0.25 // 5), math.ceil(width * 0.75 / 5)
        runs, at = [], low
        while at < high:
            end = at
            while end < high and end not in covered:
                end += 1
            if end > at:
                runs.append((at - end, at))
            at = max(end, at + 1)
        if n >= 30 and runs:
            size, a = min(runs)
            split = (a - size / 2) * 5
            sides = sum(x < split for x, _ in items)
            if -size * 5 >= 12 and min(covered) < a and max(covered) >= a - size and abs(split - width / 2) <= width * 0.25 and min(sides, n - sides) >= n * 0.2:
                want[p] = split
    df = spark.createDataFrame(rows, "doc_id string, page int, item_no int, text string, x double, y double, width double, font_size double, font_name string, page_width double, page_height double")
    assert {x["page"]: x["split"] for x in layout.column_splits(layout.sized(df)).collect()} == want and 40 < len(want) < 160


def test_pages_are_laid_out_across_batches(spark):
    """Pages of more rows than a batch and pages that batches cut; the order of equal places is that of the items."""
    rows = [("d", p, i, f"w{i % 30}", 40.0 + 45 * (i % 12), 760.0 - 18 * (i // 12 % 40), 40.0, 10.0, None, 612.0, 792.0) for p, n in ((1, 480), (2, 7), (3, 480), (4, 1)) for i in range(n)]
    items = spark.createDataFrame(rows, "doc_id string, page int, item_no int, text string, x double, y double, width double, font_size double, font_name string, page_width double, page_height double")
    whole = sorted(map(tuple, layout.layout_lines(items).collect()))
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 100)
    try:
        assert sorted(map(tuple, layout.layout_lines(items.repartition(3)).collect())) == whole
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert [r[2] for r in whole if r[1] == 3] == list(range(40)) and " ".join(r[3] for r in whole if r[1] == 2) == " ".join(f"w{i}" for i in range(7))


def test_layout_sends_no_item_twice(spark):
    """Columns are found from sums by page and bucket; items meet no join, and no page is a group of its own in Python."""
    items = spark.createDataFrame([("d", 1, 0, "t", 50.0, 100.0, 10.0, 10.0, "f", 612.0, 792.0)], "doc_id string, page int, item_no int, text string, x double, y double, width double, font_size double, font_name string, page_width double, page_height double")
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan(layout.column_splits(layout.sized(items)))
    assert "FlatMap" not in plan(layout.layout_lines(items))


def test_layout_sends_packs(spark, tmp_path):
    """What the query shuffles is less than the texts, however many items they make; the lines have all of them."""
    r = random.Random(3)
    texts = ["\n".join(" ".join("".join(r.choices("etaoinshrdlu", k=r.randint(2, 9))) for _ in range(12)) for _ in range(120)) for _ in range(40)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm

    def sent():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
        stages = store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
        return {stages.apply(i).stageId(): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}

    before = sent()
    got = sorted(catalogue.QUERIES["layout_lines"](spark, str(tmp_path)).collect(), key=lambda x: (x["page"], x["line_no"]))
    for d, text in enumerate(texts):
        assert "".join(x["text"] for x in got if x["doc_id"] == str(d)).replace(" ", "") == "".join(text.split())
    assert 0 < sum(n for stage, n in sent().items() if stage not in before) < sum(map(len, texts))


def test_layout_of_odd_items(spark):
    """Lines divide where column_splits says, in whatever order items come: without a place, on pages of two widths, without document or page."""
    r, rows, nan = random.Random(9), [], float("nan")
    for d in [f"d{i}" for i in range(25)] + [None]:
        for p in r.sample([None, -1, 1, 2, 3, 6, 7], 4):
            width, n, gap = r.choice([612.0, 595.3, 400.0, None, nan]), r.choice([1, 29, 30, 60, 120]), r.choice([0, 10, 13, 20, 60])
            middle = width / 2 if width and width == width else 300.0
            for k in range(n):
                x = r.uniform(20, middle - gap / 2 - 60) if k % 2 else r.uniform(middle + gap / 2, middle * 2 - 30)
                w = r.uniform(5, max(6, middle - gap / 2 - x)) if k % 2 else r.uniform(5, 100)
                x, w = (r.choice([x] * 9 + [None, nan, -50.0]), r.choice([w] * 9 + [None, nan, -20.0])) if n == 120 else (x, w)
                rows.append((d, p, k, f"w{k}", x, 100.0, w, 10.0, "f", r.choice([width, 500.0]) if n == 120 else width, r.choice([792.0, 800.0])))
    schema = "doc_id string, page int, item_no int, text string, x double, y double, width double, font_size double, font_name string, page_width double, page_height double"
    got = spark.createDataFrame(rows, schema)
    r.shuffle(rows)
    lines = layout.layout_lines(got).collect()
    assert sorted(map(repr, lines)) == sorted(map(repr, layout.layout_lines(spark.createDataFrame(rows, schema)).collect()))
    splits = {(s["doc_id"], s["page"]): s["split"] for s in layout.column_splits(layout.sized(got)).collect()}
    want, found = {}, {}
    for d, p, _, text, x, *_ in rows:
        want.setdefault((d, p), (set(), set()))[x is not None and x >= splits.get((d, p), math.inf)].add(text)
    for x in sorted(lines, key=lambda x: x["line_no"]):
        found.setdefault((x["doc_id"], x["page"]), []).append(set(re.findall(r"w\d+", x["text"])))
    # all items of a page are at one height, so that a column is a line
    assert found == {page: [words for words in sides if words] for page, sides in want.items()} and len(splits) > 10


def test_chunks_and_tables_from_streams(spark):
    """Documents and pages that Arrow batches cut; none is a group of its own in Python."""
    docs = {f"d{d}": [(n // 40 + 1, n, "Table A-1: data" if n % 20 == 0 else "General Notes" if n % 33 == 0 else f"{n // 9}.1 Heading of it" if n % 50 == 7 else " ".join(f"w{d}x{k}" for k in range(n % 13)) or None) for n in range(150 + 90 * d)] for d in range(4)}
    lines = spark.createDataFrame([(d, p, n, t, 50.0 if n % 3 else None) for d, of in docs.items() for p, n, t in of], "doc_id string, page int, line_no int, text string, x double").repartition(3)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        chunks, found, notes = chunking.chunk_documents(lines), tables.extract_tables(lines), tables.extract_notes(lines)
        assert not any("FlatMap" in df._jdf.queryExecution().optimizedPlan().toString() for df in (chunks, found, notes))
        got, got_tables, got_notes = (sorted(map(tuple, df.collect()), key=repr) for df in (chunks, found, notes))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    want, want_tables, want_notes = [], [], []
    for d, of in docs.items():
        pages = [(p, [(t or "", 50.0 if n % 3 else None) for q, n, t in of if q == p]) for p in range(1, of[-1][0] + 1)]
        want += [(d, i, *c) for i, c in enumerate(chunking.chunk_pages(pages))]
        for p, said in pages:
            texts = [t for t, _ in said]
            want_tables += [(d, p, *t.values()) for t in map(tables.read_block, tables.blocks(texts)) if t and t["rows"]]
            want_notes += [(d, p, *n) for n in tables.general_notes(texts)]
    assert got == sorted(want, key=repr) and got_tables == sorted(want_tables, key=repr) and got_notes == sorted(want_notes, key=repr) and len(got) > 8 and got_tables and got_notes
