"""Edition identifiers: ``<FAMILY>-<yy>[+E<n>]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Prefixes of document families.
FAMILIES = ["RP", "TM", "LM", "LP", "LS", "DG", "HB", "G", "LEM"]
FAMILY = "(?:" + "|".join(FAMILIES) + ")"


def _group(x: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))


def family(edition_id: Column) -> Column:
    """Without errata and edition: ``RP-8-25+E2`` -> ``RP-8``."""
    return F.regexp_replace(F.regexp_replace(F.upper(edition_id), r"\+E\d+$", ""), r"-\d{2}$", "")


def base_id(edition_id: Column) -> Column:
    return F.regexp_replace(F.upper(edition_id), r"\+E\d+$", "")


def edition(edition_id: Column) -> Column:
    return _group(F.upper(edition_id), r"-(\d{2})(?:\+E\d+)?$").cast("int")


def errata(edition_id: Column) -> Column:
    return F.coalesce(_group(F.upper(edition_id), r"\+E(\d+)$").cast("int"), F.lit(0))


def id_from_title(title: Column) -> Column:
    """The first edition id that a title names, upper-cased; null if none."""
    return F.upper(_group(title, rf"(?i)\b({FAMILY}-\d+(?:\.\d+)?-\d{{2}}(?:\+E\d+)?)\b"))


def normalized_id(x: Column) -> Column:
    """What a user typed: no publisher's prefix, upper case, spaces as hyphens."""
    bare = F.regexp_replace(F.upper(F.regexp_replace(x, r"^\s+|\s+$", "")), r"^ANSI/|^IES\s+", "")
    return F.regexp_replace(F.regexp_replace(bare, r"^IES\s+", ""), r"\s+", "-")


def id_from_path(path: Column) -> Column:
    """From a file's name: without folder and extension, upper case, runs of other characters as hyphens."""
    name = F.regexp_replace(F.regexp_replace(path, r"^.*/", ""), r"(?i)\.pdf$", "")
    return F.regexp_replace(F.regexp_replace(F.upper(name), r"[^A-Z0-9+.]+", "-"), "^-+|-+$", "")


def full_designation(edition_id: Column) -> Column:
    return F.concat(F.lit("ANSI/IES "), edition_id)


def is_deprecated_path(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda s: F.lower(s).isin("deprecated", "deprecated standards"))


def lighting_zone(text: Column) -> Column:
    """``LZ0`` to ``LZ4`` anywhere in a text, with or without a space."""
    digit = _group(text, r"(?i)\bLZ\s?([0-4])\b")
    return F.when(digit.isNotNull(), F.concat(F.lit("LZ"), digit))


def cited_family(text: Column) -> Column:
    return F.upper(_group(text, rf"(?i)\b({FAMILY}-\d+(?:\.\d+)?)"))
