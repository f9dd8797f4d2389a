"""Criteria rows of illuminance tables: a row grammar, an indentation grid, hierarchy, and footnotes.

One document at a time: its row counter and hierarchy span pages. Everything but the two
sequential readers is column expressions (page and document classification, record gate,
quality report).
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.operators.relational import row_number_of
from foliant.operators.vector import top_per

LEVELS = ["sub_category", "app", "app_s1", "app_s2", "app_s3", "app_s4", "app_s5", "app_s6"]

#: The tokens of the row grammar.
LUX = re.compile(r"(?:([A-Y])\s+)?(\d+(?:\.\d+)?)\s*l(?:x|ux)\s*@?\s*(TS|\d+(?:\.\d+)?\s*m)?", re.I)
FC = re.compile(r"(\d+(?:\.\d+)?)\s*(?:fc|footcandles?)\s*@?\s*(TS|\d+(?:\.\d+)?\s*ft)?", re.I)
PLACEHOLDER = re.compile(r"#\s*(?:\d+(?:\.\d+)?\s*(?:m|ft)|TS)?")
RATIO_BASIS = re.compile(r"(Max:Avg:Min|Max:Avg|Max:Min|Avg:Min)", re.I)
RATIO = re.compile(r"(?<![A-Za-z:])(\d+(?:\.\d+)?:\d+(?:\.\d+)?)(?![:\d])")
CV = re.compile(r"\bCV\s*[:=]?\s*(\d+(?:\.\d+)?)\s*%", re.I)
BASIS = re.compile(r"(?<![:\w])(Avg|Max|Min)(?![:\w])")
GLUED = re.compile(r"(?:^|[^A-Za-z])([AT])\s*\d+(?:\.\d+)?\s*l(?:x|ux)")
CONTROLS = re.compile(r"\b(Off to \d+%|Dim to \d+%|Dimmed|Curfew|Occupancy|Daylight|Auto|Manual)", re.I)
SPECTRUM = re.compile(r"(\d{3,5})\s*K\s*(?:to|–|-)\s*(\d{3,5})\s*K", re.I)
CLASS_OF_PLAY = re.compile(r"\bClass\s*(?:of\s*Play)?\s*[:=]?\s*(IV|III|II|I)\b", re.I)
BANNER = re.compile(r"^(INTERIORS?|EXTERIORS?|INDOOR\s+APPLICATIONS?|OUTDOOR\s+APPLICATIONS?|COMMON\s+APPLICATIONS?)\b")
LINK = re.compile(r"\b(Refer to\s+(?:ANSI|BSR)/IES.*|See\s+(?:ANSI|BSR)/IES.*|(?:ANSI|BSR)/IES\s+[A-Z]{1,3}-\d.*)$", re.I)
BOILERPLATE = re.compile(
    r"^(?:ANSI/IES|Recommended Practice|Recommended Illuminance|APPLICATION|Target E[hv]|Horizontal Illuminance|Vertical Illuminance|Environmental and Visual|Uniformity|TaskRatio|Lux\s*@|Fc\s*@|@\s*Height|See Notes|TS\s*=|Class of Play|Veiling Risk|Sub Category|Hierarchy|App_s)",
    re.I,
)
TABLE_TITLE, DATA_LINE = re.compile(r"^Table\s+[A-Z]?-?\d", re.I), re.compile(r"\d+\s*(?:lx|lux|fc|footcandle)\b", re.I)
SUPERSCRIPTS, SUPERSCRIPT_END = str.maketrans("⁰¹²³⁴⁵⁶⁷⁸⁹", "0123456789"), re.compile(r"\s*([⁰¹²³⁴⁵⁶⁷⁸⁹]+)\s*$")
OUTDOOR_FAMILIES = re.compile(r"^RP-(?:6|8|33|43|47)", re.I)
NOTES_TITLE, MARKS = re.compile(r"^Application Task/Area Notes\b", re.I), re.compile(r"^\d{1,2}(?:\s*,\s*\d{1,2})*$")
DUAL_UNIT = r"(?i)\d+(?:\.\d+)?\s*l(?:x|ux)\s*@.*\d+(?:\.\d+)?\s*fc\s*@"
LABEL_LEAK = r"(?i)\d+\s*(?:lx|lux|fc)\b|#\s*\d|\b(?:Max|Avg|Min):(?:Max|Avg|Min)\b|\b\d+(?:\.\d+)?:\d+\b"

INDENT, FONT_BAND, MARK_DROP, BIND_RADIUS, LEVEL_GAP, LEFT_SHARE = 4, 1.0, 1.5, 8, 30, 0.45
MAX_LABEL, MAX_NOTE, MAX_DOC_NOTES, MAX_NOTE_NO = 120, 600, 2000, 30


# ---------------------------------------------------------------- one row


def _height(token: str | None) -> float | None:
    number = re.match(r"\s*(\d+(?:\.\d+)?)", token or "")
    return (float(number[1]) or None) if number else None


def _metrics(tail: str) -> dict:
    pick = lambda pattern: m[1] if (m := pattern.search(tail)) else None
    cv = pick(CV)
    return {"basis": pick(BASIS), "uniformity": pick(RATIO), "ratio_basis": pick(RATIO_BASIS), "cv": float(cv) if cv else None}


def _plane(lux, fc) -> dict:
    return {
        "cat": lux[1].upper() if lux and lux[1] else None, "lux": float(lux[2]) if lux else None, "height_m": _height(lux[3]) if lux else None,
        "fc": float(fc[1]) if fc else None, "height_ft": _height(fc[2]) if fc else None,
    }


def _markers(prefix: str) -> dict:
    """The label and the single letters that follow it: area or task, veiling risk."""
    out, tokens = {"area_or_task": None, "veiling_risk": None}, prefix.split()
    for _ in range(2):
        letter = tokens[-1] if len(tokens) > 1 else ""
        if letter in ("A", "T"):
            out["area_or_task"] = {"A": "Area", "T": "Task"}[letter]
        elif letter in ("L", "M", "H"):
            out["veiling_risk"] = letter
        else:
            break
        tokens.pop()
    return out | {"label": " ".join(tokens)}


def parse_data_row(text: str) -> dict:
    """The fields of one line; ``has_data`` is false for hierarchy lines."""
    lux, fc, gap = list(LUX.finditer(text)), list(FC.finditer(text)), PLACEHOLDER.search(text)
    only_vertical = gap is not None and (not lux or gap.start() < lux[0].start())
    pairs = [(lux[i] if i < len(lux) else None, fc[i] if i < len(fc) else None) for i in (0, 1)]
    hor, ver = ((None, None), pairs[0]) if only_vertical else pairs
    split = ver[0].start() if ver[0] else len(text)
    after = max([m.end() for m in hor if m], default=None)
    data = [m.start() for m in (lux[:1] + fc[:1])]
    ends = data + ([gap.start()] if gap else [])
    out = {"has_data": any(hor + ver), **_markers(text[: min(ends)] if ends else text)}
    out |= {f"hor_{k}": v for k, v in (_plane(*hor) | _metrics(text[after:split] if after is not None else "")).items()}
    out |= {f"ver_{k}": v for k, v in (_plane(*ver) | _metrics(text[split:])).items()}
    if not out["area_or_task"] and (glued := GLUED.search(text)):
        out["area_or_task"] = {"A": "Area", "T": "Task"}[glued[1]]
        out["label"] = re.sub(r"[AT]\s*$", "", out["label"]).strip()
    return out | _environment(text)


def _environment(text: str) -> dict:
    percent, glare = re.search(r"(\d+(?:\.\d+)?)\s*%", CV.sub("", text)), re.search(r"\bG([0-5])\b", text)
    lumen, up = re.search(r"(\d+(?:\.\d+)?)\s*lm\b", text), re.search(r"\bU([0-5])\b", text)
    controls, spectrum, play = CONTROLS.search(text), SPECTRUM.search(text), CLASS_OF_PLAY.search(text)
    return {
        "glare_max": glare[0] if glare else f"{percent[1]}%" if percent else None,
        "uplight_max": up[0] if up else f"{lumen[1]} lm" if lumen else None,
        "controls": controls[1] if controls else None,
        "spectrum": f"{spectrum[1]}K to {spectrum[2]}K" if spectrum else None,
        "class_of_play": play[1].upper() if play else None,
    }


# ---------------------------------------------------------------- names


def split_link(raw: str) -> tuple[str, str | None]:
    text = raw.strip()
    m = LINK.search(text)
    return (text[: m.start()].strip(), m[1].strip()) if m and m.start() else (text, None)


def split_superscript(raw: str) -> tuple[str, list[int]]:
    m = SUPERSCRIPT_END.search(raw.strip())
    return (raw.strip()[: m.start()].strip(), [int(m[1].translate(SUPERSCRIPTS))]) if m else (raw.strip(), [])


def clean_name(name: str) -> str:
    for pattern in (r"\s*[⁰¹²³⁴⁵⁶⁷⁸⁹]+$", r"\s+\d+$", r"\s*\([a-z]\)$", r"^[AT]\s+"):
        name = re.sub(pattern, "", name)
    return name.strip()


# ---------------------------------------------------------------- the grid


@dataclass
class Line:
    text: str
    x: float | None
    y: float | None
    font: float | None


@dataclass
class Page:
    number: int
    width: float
    lines: list[Line]


def body_font(pages: list[Page]) -> float | None:
    """The upper median of the fonts of data lines."""
    fonts = sorted(s.font for p in pages for s in p.lines if s.font is not None and DATA_LINE.search(s.text))
    return fonts[len(fonts) // 2] if fonts else None


def off_font(line: Line, font: float | None) -> bool:
    return font is not None and line.font is not None and abs(line.font - font) > FONT_BAND


def indent_levels(pages: list[Page], font: float | None) -> list[float]:
    """Left edges of hierarchy levels: clusters of x whose distance from the cluster's mean stays within the tolerance."""
    xs = sorted(
        s.x for p in pages for s in p.lines
        if s.x is not None and len(s.text) >= 2 and not s.text.isdigit() and not off_font(s, font) and s.x <= p.width * LEFT_SHARE and (DATA_LINE.search(s.text) or len(s.text) < 70)
    )
    clusters: list[list[float]] = []
    for x in xs:
        if clusters and x - sum(clusters[-1]) / len(clusters[-1]) <= INDENT:
            clusters[-1].append(x)
        else:
            clusters.append([x])
    levels: list[float] = []
    for c in clusters[:1] + [c for c in clusters[1:] if len(c) >= 3]:
        mean = sum(c) / len(c)
        if levels and mean - levels[-1] > LEVEL_GAP:
            break
        levels.append(mean)
    return levels[:9]


def depth_of(x: float, levels: list[float]) -> int:
    return min(range(len(levels)), key=lambda i: abs(x - levels[i]), default=0)


class Hierarchy:
    """Eight slots; a name can't skip an empty one, and clears what lies below."""

    def __init__(self):
        self.slots: list[str | None] = [None] * len(LEVELS)
        self.marks: dict[int, tuple[str, list[int]]] = {}

    def place(self, depth: int) -> int:
        filled = max((i for i, v in enumerate(self.slots) if v), default=-1)
        return min(depth, filled + 1, len(LEVELS) - 1)

    def put(self, depth: int, name: str, marks: list[int]) -> None:
        at = self.place(depth)
        self.slots[at:] = [name] + [None] * (len(LEVELS) - at - 1)
        self.marks = {d: m for d, m in self.marks.items() if d < at} | ({at: (name, marks)} if marks else {})

    def banner(self, text: str) -> None:
        self.slots, self.marks = [text] + [None] * (len(LEVELS) - 1), {}

    def with_leaf(self, depth: int, name: str) -> list[str | None]:
        out = list(self.slots)
        if len(name) >= 2:
            out[self.place(depth)] = name
        return out

    def inherited(self, chain: list[str | None]) -> dict[str, list[int]]:
        return {LEVELS[d]: marks for d, (name, marks) in sorted(self.marks.items()) if chain[d] == name}


# ---------------------------------------------------------------- footnotes


def is_mark(line: Line, font: float | None) -> bool:
    return bool(MARKS.match(line.text)) and line.font is not None and font is not None and line.font <= font - MARK_DROP


def bound_marks(lines: list[Line], font: float | None) -> dict[int, list[int]]:
    """Footnote numbers by the line they stand beside: the nearest in height, else the last one before."""

    def can_hold(s: Line) -> bool:
        if not 2 <= len(s.text) <= 200 or is_mark(s, font) or BOILERPLATE.match(s.text) or TABLE_TITLE.match(s.text) or s.text.isdigit():
            return False
        return not off_font(s, font) or bool(BANNER.match(s.text))

    targets, out = [j for j, s in enumerate(lines) if can_hold(s)], {}
    for i, s in enumerate(lines):
        if is_mark(s, font):
            near = [(abs(lines[j].y - s.y), j) for j in targets if s.y is not None and lines[j].y is not None and abs(lines[j].y - s.y) <= BIND_RADIUS]
            before = [j for j in targets if j < i]
            at = min(near)[1] if near else before[-1] if before else None
            if at is not None:
                out.setdefault(at, []).extend(int(n) for n in s.text.split(","))
    return out


def page_notes(lines: list[Line], font: float | None) -> dict[int, str]:
    start = next((i for i, s in enumerate(lines) if NOTES_TITLE.match(s.text)), None)
    notes, current = {}, None
    for s in lines[start + 1 :] if start is not None else []:
        if not s.text or (font is not None and s.font is not None and not off_font(s, font)):
            continue
        if re.match(r"^Table\s", s.text, re.I):
            break
        m = re.match(r"^(\d{1,2})\s+(\S.*)$", s.text)
        if m and int(m[1]) <= MAX_NOTE_NO:
            current = int(m[1])
            notes[current] = m[2].strip()
        elif current is not None:
            notes[current] = f"{notes[current]} {s.text}".strip()[:MAX_NOTE]
    return notes


# ---------------------------------------------------------------- a document


@dataclass
class Reader:
    """Reads a document's criteria pages into records."""

    standard: str
    designation: str
    records: list[dict] = field(default_factory=list)
    number: int = 0
    table: str = "Table A-1"
    link: str | None = None
    tree: Hierarchy = field(default_factory=Hierarchy)

    def read(self, pages: list[Page], table_pages: list[Page]) -> list[dict]:
        self.font = body_font(table_pages)
        self.levels = indent_levels(table_pages, self.font)
        self.location = "Outdoor" if OUTDOOR_FAMILIES.match(self.standard) else "Indoor"
        for page in table_pages:
            self.page(page)
        self.resolve(pages)
        return self.records

    def page(self, page: Page) -> None:
        ref = next((m for s in page.lines if (m := re.search(r"Table\s+(A-?\d+)", s.text, re.I))), None)
        if ref:
            self.table = "Table " + re.sub(r"^A(\d)", r"A-\1", ref[1])
        marks, notes, first = bound_marks(page.lines, self.font), page_notes(page.lines, self.font), len(self.records)
        for i, line in enumerate(page.lines):
            self.line(line, marks.get(i, []), page.number)
        for r in self.records[first:]:
            found = [f"{n}. {notes[n]}" for n in r["refs"] if notes.get(n)]
            if found:
                r["footnotes"], r["refs"] = "\n".join(found), []

    def line(self, line: Line, marks: list[int], page: int) -> None:
        text = line.text
        if not 2 <= len(text) <= 200 or is_mark(line, self.font) or BOILERPLATE.match(text) or TABLE_TITLE.match(text) or text.isdigit():
            return
        if BANNER.match(text):
            self.location = "Outdoor" if re.search("EXTERIOR|OUTDOOR", text) else "Indoor"
            self.tree.banner(text)
            return
        if off_font(line, self.font):
            return
        row = parse_data_row(text)
        x = line.x if line.x is not None else (self.levels[0] if self.levels else 60.0)
        name, link = split_link(row["label"])
        name, glued = split_superscript(name)
        own = sorted({*marks, *glued})
        depth = depth_of(x, self.levels)
        if row["has_data"]:
            self.record(row, clean_name(name), link, own, depth, page)
        elif len(name) >= 2 and x <= (self.levels[-1] if self.levels else x) + INDENT:
            self.tree.put(depth, name, own)
            self.link = link or self.link

    def record(self, row: dict, name: str, link: str | None, own: list[int], depth: int, page: int) -> None:
        chain = self.tree.with_leaf(depth, name)
        above = self.tree.inherited(chain)
        has_ver = row["ver_lux"] is not None
        fc = lambda p: row[f"{p}_fc"] if row[f"{p}_fc"] is not None else None if row[f"{p}_lux"] is None else _js(row[f"{p}_lux"] / 10, 1)
        feet = lambda p: row[f"{p}_height_ft"] if row[f"{p}_height_ft"] is not None else None if row[f"{p}_height_m"] is None else _js(row[f"{p}_height_m"] * 3.28084, 1)
        zone = next((v.strip().upper() for v in chain[2:] if v and re.fullmatch(r"(?i)lz[0-4]", v.strip())), None)
        record = {
            "code": f"{re.sub(r'[^A-Za-z0-9]', '', self.standard)}_{self.number:04d}", **dict(zip(LEVELS, chain, strict=True)),
            "standard": self.standard, "standard_full": self.designation, "table_ref": self.table, "row_ref": f"Row {self.number + 1}", "page_number": page,
            "link_mapping": link or self.link, "area_or_task": row["area_or_task"] or "Area", "indoor_outdoor": self.location, "veiling_risk": row["veiling_risk"], "class_of_play": row["class_of_play"],
            "hor_cat": row["hor_cat"], "hor_lux": row["hor_lux"], "hor_fc": fc("hor"), "hor_height_m": row["hor_height_m"], "hor_height_ft": feet("hor"), "hor_basis": row["hor_basis"] or "Avg",
            "hor_uniformity": row["hor_uniformity"], "hor_cv": row["hor_cv"], "hor_ratio_basis": row["hor_ratio_basis"],
            "ver_cat": row["ver_cat"] if has_ver else None, "ver_lux": row["ver_lux"], "ver_fc": fc("ver"), "ver_height_m": row["ver_height_m"] if has_ver else None, "ver_height_ft": feet("ver") if has_ver else None,
            "ver_basis": (row["ver_basis"] or "Avg") if has_ver else None, "ver_uniformity": row["ver_uniformity"] if has_ver else None, "ver_cv": (row["ver_cv"] or None) if has_ver else None,
            "ver_ratio_basis": (row["ver_ratio_basis"] or row["hor_ratio_basis"]) if has_ver else None,
            "tm24_eligible": int(any(c and "P" <= c <= "Y" for c in (row["hor_cat"], row["ver_cat"]))), "lighting_zone": zone,
            "max_glare_rating": row["glare_max"], "max_uplight": row["uplight_max"], "spectrum_guidance": row["spectrum"], "controls_required": row["controls"],
            "footnotes": None, "footnote_marks": json.dumps({"levels": above, "row": own}) if above or own else None, "general_notes": None, "active": 1,
            "refs": sorted({n for m in [*above.values(), own] for n in m}),
        }
        self.records.append(record)
        self.number, self.link = self.number + 1, None

    def resolve(self, pages: list[Page]) -> None:
        """Notes that stand on other pages; without any row marks, all notes go to all records."""
        notes: dict[int, str] = {}
        for p in pages:
            notes = page_notes(p.lines, self.font) | notes
        marked = any(r["footnotes"] or r["refs"] for r in self.records)
        listed = "\n".join(f"{n}. {t}" for n, t in sorted(notes.items()))
        for r in self.records:
            if r["refs"]:
                found = [f"{n}. {notes[n]}" for n in r["refs"] if notes.get(n)]
                r["footnotes"] = "\n".join(found) or "See Application Task/Area Notes: " + ", ".join(map(str, r["refs"]))
            if not marked and notes:
                r["general_notes"] = listed[:MAX_DOC_NOTES] + ("…" if len(listed) > MAX_DOC_NOTES else "")


def _js(x: float, digits: int) -> float:
    return int((x * 10**digits + 0.5) // 1) / 10**digits


def is_criteria_page(lines: list[Line], landscape: bool) -> bool:
    if len(lines) < 10:
        return False
    return any(re.search(DUAL_UNIT, s.text) for s in lines) or (landscape and sum(bool(DATA_LINE.search(s.text)) for s in lines) >= 3)


_TEXT, _NUMBER = "string", "double"
RECORD_SCHEMA = (
    "code string, " + ", ".join(f"{x} string" for x in LEVELS) + ", standard string, standard_full string, table_ref string, row_ref string, page_number int, link_mapping string, area_or_task string, indoor_outdoor string, veiling_risk string, class_of_play string, "
    + ", ".join(f"{p}_cat string, {p}_lux double, {p}_fc double, {p}_height_m double, {p}_height_ft double, {p}_basis string, {p}_uniformity string, {p}_cv double, {p}_ratio_basis string" for p in ("hor", "ver"))
    + ", tm24_eligible int, lighting_zone string, max_glare_rating string, max_uplight string, spectrum_guidance string, controls_required string, footnotes string, footnote_marks string, general_notes string, active int"
)


def extract_pages(pages: list[Page], landscape: dict[int, bool], standard: str, designation: str | None = None) -> list[dict]:
    chosen = [p for p in pages if is_criteria_page(p.lines, landscape.get(p.number, False))]
    return Reader(standard, designation or f"ANSI/IES {standard}").read(pages, chosen)


def extract_rows(lines: DataFrame) -> DataFrame:
    """Lines of LINE_SCHEMA (doc_id is the standard's id) -> valid records, the first of each code."""

    def run(doc: pd.DataFrame) -> pd.DataFrame:
        doc = doc.sort_values(["page", "line_no"])
        none = lambda v: None if pd.isna(v) else float(v)
        pages, landscape = [], {}
        for number, p in doc.groupby("page", sort=True):
            width, height = p["page_width"].iloc[0], p["page_height"].iloc[0]
            landscape[int(number)] = bool(width > height)
            pages.append(Page(int(number), float(width) if width == width else 842.0, [Line((t or "").strip(), none(x), none(y), none(f)) for t, x, y, f in p[["text", "x", "y", "font_size"]].itertuples(index=False)]))
        names = [c.split()[0] for c in RECORD_SCHEMA.split(", ")]
        return pd.DataFrame(extract_pages(pages, landscape, doc["doc_id"].iloc[0]), columns=names)

    found = lines.groupBy("doc_id").applyInPandas(run, RECORD_SCHEMA).where(is_valid())
    return top_per(found, ["code"], [F.col("page_number"), F.col("standard"), row_number_of(F.col("row_ref"))], 1)


def is_clean_label(c: Column) -> Column:
    t = F.trim(c)
    return c.isNull() | (c == "") | ((F.length(t) <= MAX_LABEL) & ~t.rlike("[a-z]-$") & ~t.rlike(LABEL_LEAK))


def is_valid() -> Column:
    out, named = F.lit(True), F.lit(False)
    for c in LEVELS:
        out, named = out & is_clean_label(F.col(c)), named | (F.length(F.trim(F.coalesce(c, F.lit("")))) >= 2)
    return out & named


def classify(lines: DataFrame) -> DataFrame:
    """Per document: whether it holds tables of the new structure."""
    hits = F.count_if(F.col("text").rlike(DUAL_UNIT))
    pages = lines.groupBy("doc_id", "page").agg(hits.alias("hits"), F.bool_or(F.col("text").rlike("(?i)Recommended Illuminance Criteria")).alias("titled"), F.bool_or(F.col("page_width") > F.col("page_height")).alias("landscape"))
    criteria = F.count_if(F.col("landscape") & (F.col("titled") | (F.col("hits") >= 3)))
    out = pages.groupBy("doc_id").agg(F.sum("hits").alias("row_hits"), criteria.alias("criteria_pages"))
    return out.withColumn("structure", F.when((F.col("row_hits") >= 5) & (F.col("criteria_pages") >= 1), "NEW_TABLE").otherwise("STANDARD"))


def hierarchy_gaps() -> Column:
    """Whether an empty level lies between filled ones (leading empty ones are fine)."""
    filled = F.array_join(F.array(*[F.when(F.coalesce(c, F.lit("")) != "", "1").otherwise("0") for c in LEVELS]), "")
    return filled.rlike("10+1")


def extraction_report(records: DataFrame) -> DataFrame:
    """Per standard: conditional counts, gaps, shares and whether the gates are passed."""
    has = lambda c: F.count_if(F.col(c).isNotNull())
    out = records.groupBy("standard").agg(
        F.count(F.lit(1)).alias("total"), has("hor_lux").alias("hor_lux"), has("ver_lux").alias("ver_lux"), has("hor_cat").alias("hor_cat"), has("app").alias("app"), has("page_number").alias("page"),
        has("footnotes").alias("footnotes"), F.count_if(F.col("tm24_eligible") == 1).alias("tm24"), F.count_if(F.coalesce("hor_lux", "ver_lux").isNotNull()).alias("any_lux"), F.count_if(hierarchy_gaps()).alias("gaps"),
    )
    return out.withColumn("passed", (F.col("any_lux") * 100 >= F.col("total") * 90) & (F.col("gaps") == 0) & (F.col("app") == F.col("total")) & (F.col("hor_cat") * 100 >= F.col("total") * 70))


def embed_text() -> Column:
    """The weighted description of a record that is embedded: its names, the deepest twice, then what it is and where."""
    levels = F.filter(F.array(*[F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s*\([^)]*\)", "")) for c in LEVELS]), lambda x: (x != "") & ~x.rlike(r"(?i)^lz[0-4]$"))
    leaf = F.element_at(levels, -1)
    parts = F.array(F.when(F.size(levels) > 0, F.concat_ws(". ", leaf, leaf)), F.array_join(levels, " "), F.lower("area_or_task"), F.lower("indoor_outdoor"), F.concat(F.lit("standard "), F.col("standard")))
    return F.array_join(F.filter(parts, lambda x: x.isNotNull() & (x != "")), ". ")
