"""Readers of catalogues, mappings, page items and document folders."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.functions.ids import id_from_path, id_from_title, is_deprecated_path
from foliant.operators.vector import top_per

ITEM_SCHEMA = "doc_id STRING, page INT, item_no INT, text STRING, x DOUBLE, y DOUBLE, width DOUBLE, font_size DOUBLE, font_name STRING, page_width DOUBLE, page_height DOUBLE"


def document_files(spark: SparkSession, root: str, content: bool = False) -> DataFrame:
    """path, length, id, deprecated of all PDF files below ``root``, without folders named Others; contents only if asked for."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    kept = files.where(~F.exists(F.split("path", "/"), lambda s: s == "Others"))
    return kept.select("path", "length", id_from_path(F.col("path")).alias("id"), is_deprecated_path(F.col("path")).alias("deprecated"), *(["content"] if content else []))


def page_items(spark: SparkSession, path: str) -> DataFrame:
    """Positioned text as JSON lines, the form in which a PDF decoder hands pages over."""
    return spark.read.schema(ITEM_SCHEMA).json(path)


def quoted_csv(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """CSV with quoted cells, doubled quotes and line breaks inside quotes; blank lines don't count."""
    reader = spark.read.option("header", "true").option("quote", '"').option("escape", '"').option("multiLine", "true").option("ignoreLeadingWhiteSpace", "true").option("ignoreTrailingWhiteSpace", "true")
    return (reader.schema(schema) if schema else reader).csv(path)


def catalogue_csv(spark: SparkSession, path: str) -> DataFrame:
    """Columns Folder Path, Title, Doc ID, Web Viewer URL (any case) -> id, doc_id, web_url, deprecated: current copies beat archived ones, then the first wins (by file name, then place in the file)."""
    raw = quoted_csv(spark, path)
    names = {c.strip().lower(): c for c in raw.columns}
    pick = lambda n: F.col(f"`{names[n]}`") if n in names else F.lit(None).cast("string")
    rows = raw.select(id_from_title(pick("title")).alias("id"), pick("doc id").alias("doc_id"), pick("web viewer url").alias("web_url"), F.coalesce(is_deprecated_path(pick("folder path")), F.lit(False)).alias("deprecated"), F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("ord"))
    return top_per(rows.where("id is not null and doc_id is not null"), ["id"], [F.col("deprecated"), F.col("file"), F.col("ord")], 1).drop("file", "ord")


def mapping_file(spark: SparkSession, path: str) -> DataFrame:
    """A JSON object id -> document id (keys with a leading underscore are comments), or a list of objects -> id, doc_id, web_url."""
    text = spark.read.text(path, wholetext=True)
    objects = "array<struct<standardId:string,standard_id:string,id:string,docId:string,doc_id:string,webUrl:string,web_url:string>>"
    as_list, as_map = F.from_json("value", objects), F.from_json("value", "map<string,string>")
    is_list = F.ltrim("value").startswith("[")
    listed = text.where(is_list).select(F.explode(as_list).alias("o")).select(F.upper(F.coalesce("o.standardId", "o.standard_id", "o.id")).alias("id"), F.coalesce("o.docId", "o.doc_id").alias("doc_id"), F.coalesce("o.webUrl", "o.web_url").alias("web_url"))
    mapped = text.where(~is_list).select(F.explode(as_map).alias("id", "doc_id")).where(~F.startswith("id", F.lit("_"))).select(F.upper("id").alias("id"), "doc_id", F.lit(None).cast("string").alias("web_url"))
    return listed.unionByName(mapped).where("id is not null and doc_id is not null")


def curated_catalogue(spark: SparkSession, path: str) -> DataFrame:
    """A JSON document {"standards": [...]} -> a row per standard, ids in upper case."""
    fields = "id:string,full_designation:string,title:string,short_title:string,year:int,supersedes:string,status:string,categories:array<string>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"struct<standards:array<struct<{fields}>>>").alias("j"))
    return raw.select(F.explode("j.standards").alias("s")).select("s.*").withColumn("id", F.upper("id"))


def upload_key_ok(key):
    """Whether an object key has the allowed prefix and one PDF name."""
    return key.rlike(r"(?i)^(?:standards|deprecated)/[^/]+\.pdf$")
