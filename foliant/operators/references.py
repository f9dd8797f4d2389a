"""Links of cited texts: a standard in the library, else a DOI, else a plain address."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliant.functions.ids import FAMILY
from foliant.operators.vector import top_per

#: How standards, DOIs and addresses are cited.
CITED = rf"(?i)\b(?:ANSI/|BSR/)?IES(?:/NALMCO)?\s+({FAMILY}-\d+(?:\.\d+)?)(-\d{{2}})?(\+E\d+)?"
DOI, URL = r'\b(10\.\d{4,9}/[^\s"<>]+)', r'(?i)\b(https?://[^\s"<>)]+)'


def _first(x: Column, pattern: str, k: int = 1) -> Column:
    return F.nullif(F.regexp_extract(x, pattern, k), F.lit(""))


def reference_links(df: DataFrame, text: str, standards: DataFrame) -> DataFrame:
    """``df`` with ``link`` and ``link_type`` (library, doi, url or null).

    ``standards`` (id, web_url, status): the exact edition counts if it is active and has an
    address, else the newest active edition of exactly that family (the larger id on ties).
    Both are equi-joins; the standards are few and join by their measured size.
    """
    live = standards.where((F.coalesce("status", F.lit("Active")) != "Deprecated") & (F.coalesce("web_url", F.lit("")) != "")).select(F.upper("id").alias("__id"), F.col("web_url").alias("__url"))
    exact = live.groupBy("__id").agg(F.max("__url").alias("__exact"))
    editions = live.where(F.col("__id").rlike(r"-\d{2}(?:\+E\d+)?$")).withColumn("__family", F.regexp_replace("__id", r"-\d{2}(?:\+E\d+)?$", "")).withColumn("__edition", F.regexp_extract("__id", r"-(\d{2})(?:\+E\d+)?$", 1).cast("int"))
    newest = top_per(editions, ["__family"], [F.col("__edition").desc(), F.col("__id").desc()], 1).select("__family", F.col("__url").alias("__newest"))
    t = F.coalesce(F.col(text), F.lit(""))
    family = F.upper(_first(t, CITED))
    cited = df.withColumns({"__f": family, "__c": F.concat(family, F.upper(F.regexp_extract(t, CITED, 2)), F.upper(F.regexp_extract(t, CITED, 3)))})
    found = cited.join(exact, F.col("__c") == F.col("__id"), "left").join(newest, F.col("__f") == F.col("__family"), "left")
    library, doi, url = F.coalesce("__exact", "__newest"), F.regexp_replace(_first(t, DOI), r"[).,;:\]]+$", ""), F.regexp_replace(_first(t, URL), r"[.,;:\]]+$", "")
    kind = F.when(library.isNotNull(), "library").when(doi.isNotNull(), "doi").when(url.isNotNull(), "url")
    link = F.coalesce(library, F.concat(F.lit("https://doi.org/"), doi), url)
    return found.withColumns({"link": link, "link_type": kind}).drop("__f", "__c", "__id", "__exact", "__family", "__newest")


def viewer_link(deep: Column, base: Column, anchor: Column, page: Column) -> Column:
    """A row's own link, else the document's address with an anchor, else with a page, else bare."""
    given = lambda c: F.coalesce(c.cast("string"), F.lit("")) != ""
    return F.when(given(deep), deep).when(given(base) & given(anchor), F.concat(base, F.lit("#"), anchor)).when(given(base) & (F.coalesce(page, F.lit(0)) > 0), F.concat(base, F.lit("#page="), page.cast("string"))).when(given(base), base)
