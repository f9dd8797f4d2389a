"""Query text as column functions: splitting, cleaning, expansion, intents, names and citations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foliant.functions.vocabulary import (
    ARTICLE,
    COMPARISON_PATTERNS,
    QUESTION_PATTERNS,
    REFERENCE_PATTERNS,
    SYNONYMS,
    TRAILING_PATTERNS,
)


def js_round(x: Column, digits: int = 0) -> Column:
    """Rounds halves up (also below zero), as float arithmetic of the wire format does."""
    scale = 10.0**digits
    return F.floor(x * scale + 0.5) / F.lit(scale)


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def split_multi_query(q: Column) -> Column:
    """Parts between commas and semicolons of two or more characters, if there are at least two of them; else the whole."""
    parts = F.filter(F.transform(F.split(q, "[,;]"), trimmed), lambda p: F.length(p) >= 2)
    return F.when(F.size(parts) >= 2, parts).otherwise(F.array(trimmed(q)))


def clean_query(q: Column) -> Column:
    """The topic without question phrasing and trailing noise; the query itself if nothing would be left."""

    def topic(whole: Column) -> Column:
        out = whole
        for p in reversed(QUESTION_PATTERNS):
            out = F.when(whole.rlike(p), F.regexp_replace(whole, p, "")).otherwise(out)
        for p in [*TRAILING_PATTERNS, ARTICLE]:
            out = F.regexp_replace(out, p, "")
        return _let(trimmed(out), lambda o: F.when(o == "", whole).otherwise(o))

    return _let(trimmed(q), topic)


def _let(x: Column, f) -> Column:
    """``f`` of ``x``, with ``x`` evaluated once."""
    return F.element_at(F.transform(F.array(x), f), 1)


def expansion_terms(cleaned: Column) -> Column:
    """New words, in dictionary order, for every term that stands in the query between spaces or at its ends."""

    def found(padded: Column) -> Column:
        words = F.concat_ws(" ", *[F.when(F.contains(padded, F.lit(f" {term} ")), F.lit(words.lower())) for term, words in SYNONYMS])
        return F.array_remove(F.split(words, " "), "")

    padded = F.concat(F.lit(" "), F.regexp_replace(F.lower(cleaned), r"\s", " "), F.lit(" "))
    return F.array_except(F.array_distinct(_let(padded, found)), F.split(F.lower(cleaned), r"\s+"))


def expand_query(q: Column) -> Column:
    def widened(cleaned: Column) -> Column:
        return _let(expansion_terms(cleaned), lambda t: F.when(F.size(t) == 0, cleaned).otherwise(F.concat(cleaned, F.lit(" "), F.array_join(t, " "))))

    return _let(clean_query(q), widened)


def prepare_query(q: Column) -> Column:
    """What is embedded: cleaned twice (a final question mark can hide a trailing phrase), then expanded."""
    return _let(clean_query(q), expand_query)


def any_pattern(q: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | F.coalesce(q, F.lit("")).rlike(p)
    return out


def is_comparison(q: Column) -> Column:
    return any_pattern(q, COMPARISON_PATTERNS)


def is_reference_seeking(q: Column) -> Column:
    return any_pattern(q, REFERENCE_PATTERNS)


def content_types(requested: Column, q: Column) -> Column:
    """Valid lower-cased types; tables and body by default; ``compare`` alone only modifies; a reference-seeking query
    replaces the default by references and joins an explicit choice."""
    valid = F.array_distinct(F.filter(F.transform(F.coalesce(requested, F.array().cast("array<string>")), lambda x: F.lower(x)), lambda x: x.isin("tables", "body", "references", "compare")))
    real = F.filter(valid, lambda x: x != "compare")
    extra = F.when(F.array_contains(valid, "compare"), F.array(F.lit("compare"))).otherwise(F.array().cast("array<string>"))
    wants = is_reference_seeking(q)
    chosen = F.when(F.size(real) > 0, F.when(wants, F.array_union(real, F.array(F.lit("references")))).otherwise(real)).otherwise(
        F.when(wants, F.array(F.lit("references"))).otherwise(F.array(F.lit("tables"), F.lit("body")))
    )
    return F.array_sort(F.array_union(chosen, extra))


def compose_name(designation: Column, title: Column) -> Column:
    """Designation and title without repeating what the title starts with."""
    d, t = trimmed(F.coalesce(designation, F.lit(""))), trimmed(F.coalesce(title, F.lit("")))
    core = F.regexp_replace(d, r"(?i)^ANSI/IES\s+", "")
    prefix = F.substring(d, F.lit(1), F.length(d) - F.length(core))
    return (
        F.when(t == "", d)
        .when(d == "", t)
        .when(F.startswith(F.upper(t), F.upper(d)), t)
        .when((core != d) & F.startswith(F.upper(t), F.upper(core)), F.concat(prefix, t))
        .otherwise(F.concat(d, F.lit(" "), t))
    )


def citation(name: Column, table: Column, row: Column, section: Column, page: Column) -> Column:
    """Name, table, row, section and page, joined by commas; empty parts and page 0 are left out."""
    some = lambda x, shown: F.when(F.coalesce(x.cast("string"), F.lit("")).isin("", "0") == F.lit(False), shown)
    return F.concat_ws(
        ", ",
        F.coalesce(name, F.lit("")),
        F.when(F.coalesce(table, F.lit("")) != "", table),
        F.when(F.coalesce(row, F.lit("")) != "", row),
        F.when(F.coalesce(section, F.lit("")) != "", F.concat(F.lit("Section "), section)),
        some(page, F.concat(F.lit("p. "), page.cast("string"))),
    )


def citation_issues(text: Column) -> Column:
    return F.filter(
        F.array(
            F.when(~text.rlike(r"ANSI/IES\s+[A-Z]+-\d+-\d+"), F.lit("no designation")),
            F.when(~text.rlike(r"p\.\s*\d+|Section\s+\d+|Table\s+[A-Z]"), F.lit("no location")),
        ),
        lambda x: x.isNotNull(),
    )


#: Phrases that a text may not hold.
BANNED = ["all rights reserved", "reproduced with permission", "copyright ies"]


def policy_violations(text: Column) -> Column:
    """Quoted spans of 30 characters and more with over 17 space-separated tokens, and banned phrases."""
    quoted = F.filter(F.regexp_extract_all(text, F.lit(r'"[^"]{30,}"'), F.lit(0)), lambda s: F.size(F.split(s, r"\s+")) > 17)
    long = F.transform(quoted, lambda s: F.concat(F.lit("long_quote:"), (F.size(F.split(s, r"\s+")) - 2).cast("string")))
    phrases = F.filter(F.array(*[F.when(F.lower(text).contains(p), F.lit("phrase:" + p)) for p in BANNED]), lambda x: x.isNotNull())
    return F.concat(long, phrases)


def digit_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^0-9]", "")) / F.length(text)


def letter_ratio(text: Column) -> Column:
    return F.length(F.regexp_replace(text, "[^A-Za-z]", "")) / F.length(text)


def table_like(text: Column, most_digits: float = 0.22, least_letters: float = 0.45) -> Column:
    """Whether a text looks like table residue: many digits, few letters, or nothing at all."""
    return F.when(F.coalesce(text, F.lit("")) == "", True).otherwise((digit_ratio(text) > most_digits) | (letter_ratio(text) < least_letters))


def displayable(text: Column, kind: Column, least: int = 60) -> Column:
    return (F.coalesce(kind, F.lit("text")) != "table") & (F.length(trimmed(text)) >= least) & ~table_like(text)


def csv_cell(x: Column) -> Column:
    """A cell that no spreadsheet runs as a formula; quoted where it has to be."""
    text = F.coalesce(x.cast("string"), F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[",\\n\\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def quoted_cell(x: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))


def html_escaped(x: Column) -> Column:
    out = F.coalesce(x.cast("string"), F.lit(""))
    for raw, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(raw), F.lit(entity))
    return out


def sql_escaped(x: Column) -> Column:
    return F.replace(F.coalesce(x.cast("string"), F.lit("")), F.lit("'"), F.lit("''"))


def slug(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(x), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def split_table_row(x: Column) -> Column:
    """Cells by runs of two spaces, else by tabs, else one cell."""
    wide = F.filter(F.transform(F.split(trimmed(x), r"\s{2,}"), trimmed), lambda c: c != "")
    tabs = F.filter(F.transform(F.split(trimmed(x), "\t"), trimmed), lambda c: c != "")
    return F.when(F.size(wide) > 1, wide).when(F.size(tabs) > 1, tabs).otherwise(F.array(trimmed(x)))
