"""Documents, pages, lists and test vectors as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IMAGES = ["png", "jpg", "jpeg", "bmp", "webp"]
VECTORS = (
    "label_groups array<string>, mode string, cases array<struct<name:string, input:string, expected:array<struct<label:string,text:string>>, expected_absent:array<struct<label:string,text:string>>, "
    "expected_aggregated:array<struct<value:string,label:string,placeholder:string,count:int>>, expected_forced_categories:array<string>>>"
)


def read_documents(spark: SparkSession, path: str, text_col: str = "text", id_col: str = "doc_id", format: str = "parquet") -> DataFrame:
    """(doc_id, text) and the other columns of a table of any Spark format; only these two are renamed."""
    df = spark.read.format(format).load(path)
    return df.withColumnsRenamed({text_col: "text", id_col: "doc_id"} if format != "text" else {"value": "text"})


def merge_pages(pages: DataFrame, doc: str, page_no: str, text: str) -> DataFrame:
    """(doc, text, pages, page_meta): the pages of a document in order, joined by newlines."""
    each = F.array_sort(F.collect_list(F.struct(F.col(page_no).alias("page"), F.coalesce(F.col(text), F.lit("")).alias("text"))))
    return pages.groupBy(doc).agg(each.alias("p")).select(
        doc, F.array_join(F.transform("p", lambda x: x["text"]), "\n").alias("text"), F.size("p").alias("pages"), F.transform("p", lambda x: F.struct(x["page"].alias("page"), F.length(x["text"]).alias("text_length"))).alias("page_meta")
    )


def needs_ocr(text: Column, least: int = 20) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) < least


def file_kind(path: Column) -> Column:
    """pdf, image or unsupported, by the lower-cased suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.([^./\\]+)$", 1))
    return F.when(suffix == "pdf", "pdf").when(suffix.isin(IMAGES), "image").otherwise("unsupported")


def merge_allowlist(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """The union of two lists (value), without nulls."""
    return existing.select("value").union(incoming.select("value")).where(F.col("value").isNotNull()).distinct()


def export_allowlist(values: DataFrame, path: str) -> None:
    values.select("value").write.mode("overwrite").json(path)


def import_allowlist(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("value string").json(path)


def _entries(df: DataFrame) -> DataFrame:
    return df.select("value", F.coalesce("category", F.lit("OTHER")).alias("category"))


def upsert_forcelist(entries: DataFrame, adds: DataFrame) -> DataFrame:
    """Entries (value, category) with further ones; a missing category is OTHER."""
    return _entries(entries).union(_entries(adds).where(F.length("value") > 0)).dropDuplicates(["value", "category"])


def remove_forcelist(entries: DataFrame, removes: DataFrame) -> DataFrame:
    """Entries without those named; a null category removes the value from all."""
    e, r = _entries(entries).alias("e"), removes.select("value", "category").alias("r")
    return e.join(r, (F.col("e.value") == F.col("r.value")) & (F.col("r.category").isNull() | (F.col("e.category") == F.col("r.category"))), "left_anti")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """One row for each case of golden-vector files (JSON, one object a file)."""
    return spark.read.schema(VECTORS).json(path, multiLine=True).select("label_groups", F.coalesce("mode", F.lit("detection")).alias("mode"), F.explode("cases").alias("case")).select("label_groups", "mode", "case.*")
