"""Criteria tables as columns against the reader that goes line by line, on golden and on made documents."""

import random

import pytest

from test_documents import criteria_page
from test_row_grammar import TOKENS

from foliant.operators import criteria, extraction, layout
from foliant.plans import bindings, catalogue

NAMES = [c.split()[0] for c in extraction.RECORD_SCHEMA.split(", ")]


def made_document(r, n_pages):
    """Lines with headings at several indents, banners, marks near and far, notes on some pages, links, boilerplate and rows of every form."""
    for page in range(1, n_pages + 1):
        y, rows = 10.0, []
        marks = r.random() < 0.7
        for _ in range(r.randrange(6, 40)):
            y += r.choice([3.0, 8.0, 10.0, 12.0])
            kind = r.random()
            indent = r.choice([70.0, 70.5, 78.0, 86.0, 94.0, 102.0, None, 300.0])
            if kind < 0.3:
                rows.append((r.choice(["Hall", "Room", "Entrances¹", "Lobby", "Lz2", "Deck (a)"]) + f" {r.choice('XYZ')}" * r.randrange(2) + r.choice(["", "", " See ANSI/IES RP-8-25"]), indent, y, 7.5))
            elif kind < 0.62:
                rows.append((" ".join([r.choice(["Day", "Night", "Lz3", "Court 2", "a"]), r.choice(["A P 200 lx @ 0 m 20 fc @ 0 ft Avg", "T M 30 lx", "T # 0.76 m # 2.5 ft O 200 lx @ 1.22 m", "A 5 fc @ TS"]), *r.choices(TOKENS, k=r.randrange(3))]), indent, y, r.choice([7.5, 7.5, 7.5, 8.0, 12.0, None])))
            elif kind < 0.75 and marks:
                rows.append((r.choice(["1", "2, 3", "9", "4,12"]), 140.0, y + r.choice([-1.0, 1.0, 0.0]), 4.5))
            elif kind < 0.8:
                rows.append((r.choice(["INTERIOR", "OUTDOOR APPLICATIONS", "EXTERIORS of all"]), 70.0, y, r.choice([7.5, 11.0])))
            else:
                rows.append((r.choice(["Table A-3 data", "Table A2: more", "See Notes", "12", "ANSI/IES RP-1", "prose in another font", "", "  "]), indent, y, r.choice([7.5, 10.0])))
        if r.random() < 0.5:
            rows.append(("Application Task/Area Notes", 70.0, y + 20, 9.5))
            for k in r.sample(range(1, 14), r.randrange(1, 6)):
                rows += [(f"{k} note {page}-{k}", 70.0, y + 30, 9.5)] + [("goes on " * r.randrange(1, 60), 70.0, y + 31, 9.5)] * r.randrange(3)
            if r.random() < 0.3:
                rows += [("Table B", 70.0, y + 40, 9.5), ("5 after the end", 70.0, y + 41, 9.5)]
        width, height = r.choice([(792.0, 612.0), (612.0, 792.0)])
        yield from ((page, i, t, x, yy, f, False, width, height) for i, (t, x, yy, f) in enumerate(rows))


def test_documents_as_columns(spark):
    r = random.Random(12)
    rows = [("RP-29-22", 5, i, s.text, float(s.x), float(s.y), float(s.font), False, 792.0, 612.0) for i, s in enumerate(criteria_page())]
    for k in range(10):
        rows += [(f"{r.choice(['RP-8', 'RP-2', 'LM-7'])}-{k}", *x) for x in made_document(r, r.randrange(1, 6))]
    lines = spark.createDataFrame(rows, layout.LINE_SCHEMA).repartition(4).cache()
    plain = {x["code"]: x.asDict() for x in extraction.extract_rows(lines).select(*NAMES).collect()}
    got = {x["code"]: x.asDict() for x in criteria.extract(lines).select(*NAMES).collect()}
    assert got.keys() == plain.keys() and len(got) > 60
    for code, want in plain.items():
        assert got[code] == want, (code, {k: (got[code][k], v) for k, v in want.items() if got[code][k] != v})
    assert sum(x["footnotes"] is not None for x in got.values()) > 3 and any(x["general_notes"] for x in got.values()) and any(x["link_mapping"] for x in got.values())


def test_lines_of_parts_are_numbered_by_pieces(spark, tmp_path):
    """Keys with gaps and over many pieces; no window sees all lines of a standard."""
    keys = [k * 3 + k // 50 * 1000 for k in range(900)]
    spark.createDataFrame([(k, 10) for k in keys], "p_partkey long, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    lines = bindings._criteria_lines(lambda t: spark.read.parquet(f"{tmp_path}/{t}.parquet"))
    want = set()
    for d in range(4):
        for n, k in enumerate(x for x in keys if x % 4 == d):
            want |= {(f"RP-{d + 1}-22", n // 20 + 1, n % 20 + 1, f"Space {k} room T M 100 lx @ TS 10 fc @ TS Avg"), (f"RP-{d + 1}-22", n // 20 + 1, 0, f"Hall {n // 20 + 1}")}
    got = [(x["doc_id"], x["page"], x["line_no"], x["text"]) for x in lines.collect()]
    assert set(got) == want and len(got) == len(want)
    assert "row_number" not in lines._jdf.queryExecution().analyzed().toString()


@pytest.mark.parametrize("name", ["extract_rows", "extraction_report", "embed_description"])
def test_queries_hold_no_document_in_a_task(spark, monkeypatch, name):
    """They read through the columns, not through the line-by-line reader."""
    asked = []
    monkeypatch.setattr(criteria, "extract", lambda lines: asked.append(lines) or spark.createDataFrame([], extraction.RECORD_SCHEMA))
    assert catalogue.QUERIES[name](spark, "/root/testdata/sf0.001").count() == 0 and len(asked) == 1
