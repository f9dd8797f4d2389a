"""Raw tables and general notes of pages."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from foliant.operators.batches import batches_of, rows_of

#: Titles, header words and footnote starts.
TITLE = re.compile(r"^Table\s+([A-Z0-9]+-?\d*)\s*[:.]?\s*(.*)", re.I)
ANNEX = re.compile(r"^(?:Annex|Appendix)\s+([A-Z])\s*[:.]?\s*(.*)", re.I)
SECTION = re.compile(r"^\d+\.\d+\s+[A-Z]")
FOOTNOTE = re.compile(r"^(?:\[?\d+\]?|\*+)\s+\w|^Note\s*\d*\s*:|^General Notes?:|^Annex\s+[A-Z]", re.I)
NOTES = re.compile(r"(?:General Notes?|Annex\s+[A-Z])[\s\S]*", re.I)
NOTES_HEADING = re.compile(r"^(?:General Notes?|Annex\s+[A-Z])\b", re.I)
HEADER_WORDS = [
    "illuminance", "category", "maintained", "lux", "footcandle", "fc", "horizontal", "vertical", "task", "uniformity", "height", "zone", "area", "application", "type", "sub category", "app",
    "veiling", "class of play", "cv", "ratio basis", "max:avg:min", "max:avg", "max:min", "avg:min", "max", "avg", "min",
    "glare", "uplight", "controls", "spectrum", "@ meters", "@ feet", "meters", "feet", "ts",
]

TABLE_SCHEMA = "doc_id string, page int, table_id string, title string, headers array<string>, rows array<array<string>>, footnotes string, general_notes string"
NOTE_SCHEMA = "doc_id string, page int, heading string, text string"


def _titled(line: str):
    return TITLE.match(line) or ANNEX.match(line)


def cells(line: str) -> list[str]:
    for pattern in (r"\s{2,}", r"\t"):
        parts = [p.strip() for p in re.split(pattern, line.strip()) if p.strip()]
        if len(parts) > 1:
            return parts
    return [line.strip()]


def blocks(lines: list[str]) -> list[list[str]]:
    """A block starts at a title; the next title three or more lines on, or a section eleven or more lines on, ends it."""
    out, start = [], None
    for i, line in enumerate(lines):
        if start is not None and i >= start + 3 and (_titled(line) or (SECTION.match(line) and i > start + 10)):
            out.append(lines[start:i])
            start = None
        if start is None and _titled(line):
            start = i
    return out + ([lines[start:]] if start is not None else [])


def read_block(block: list[str]) -> dict | None:
    if len(block) < 4:
        return None
    found = _titled(block[0])
    last = 0
    for i in range(1, min(len(block), 10)):
        said = block[i].lower()
        if any(w in said for w in HEADER_WORDS):
            last = i
        elif i > 1 and last:
            break
    notes = next((i for i in range(last + 2, len(block)) if FOOTNOTE.match(block[i])), len(block))
    rows = [cells(x) for x in block[last + 1 : notes] if x.strip()]
    rows = [r for r in rows if len(r) > 1 or len(r[0]) > 3]
    footnotes = "\n".join(block[notes:]).strip()
    general = NOTES.search(footnotes)
    return {
        "table_id": found[1], "title": f"Table {found[1]}" + (f": {found[2]}" if found[2] else ""), "headers": [x.strip() for x in block[1 : last + 1] if x.strip()],
        "rows": rows, "footnotes": footnotes, "general_notes": general[0].strip() if general else "",
    }


def general_notes(lines: list[str]) -> list[tuple[str, str]]:
    """(heading, text) of note blocks of twenty words or more."""
    out, i = [], 0
    while i < len(lines):
        if not NOTES_HEADING.match(lines[i].strip()):
            i += 1
            continue
        end = next((j for j in range(i + 1, len(lines)) if _titled(lines[j]) or SECTION.match(lines[j])), len(lines))
        text = "\n".join([lines[i].strip(), *lines[i + 1 : end]]).strip()
        if len(text.split()) >= 20:
            out.append((lines[i].strip(), text))
        i = end
    return out


def _per_page(lines: DataFrame, schema: str, types: list[pa.DataType], read: Callable[[list[str]], Iterable[tuple]]) -> DataFrame:
    """Pages stream by, one is what a task holds."""
    out = pa.schema([(c.split()[0], t) for c, t in zip(schema.split(", "), [pa.string(), pa.int32(), *types], strict=True)])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return batches_of(((*page, *row) for page, rows in groupby(rows_of(batches), lambda r: r[:2]) for row in read([t or "" for _, _, t in rows])), out)

    ordered = lines.select("doc_id", "page", "line_no", "text").repartition("doc_id", "page").sortWithinPartitions("doc_id", "page", "line_no")
    return ordered.select("doc_id", "page", "text").mapInArrow(run, schema)


def extract_tables(lines: DataFrame) -> DataFrame:
    def read(texts: list[str]):
        found = (read_block(b) for b in blocks(texts))
        return [tuple(t.values()) for t in found if t and t["rows"]]

    return _per_page(lines, TABLE_SCHEMA, [pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.list_(pa.string())), pa.string(), pa.string()], read)


def extract_notes(lines: DataFrame) -> DataFrame:
    return _per_page(lines, NOTE_SCHEMA, [pa.string(), pa.string()], general_notes)
