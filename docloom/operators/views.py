"""Views of what is known of documents: each over whole tables, or of one document by ``of``; rows of a document in reading order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import is_uuid

METADATA = ("id", "original_filename", "content_type", "file_size", "checksum_sha256", "source_type", "source_identifier", "subsidiary", "document_timestamp", "storage_reference", "status", "ingested_at")


def of(rows: DataFrame, document_id: str, key: str = "document_id") -> DataFrame:
    """Rows of one document; none, and no error, for a malformed id."""
    well_formed = is_uuid(F.lit(document_id)) | F.lit(document_id).rlike("^[0-9a-f]{64}$")
    return rows.filter(well_formed & (F.col(key) == document_id))


def in_order(rows: DataFrame, *order: str) -> DataFrame:
    """Each document's rows in one task, in their order: no global sort."""
    return rows.repartition("document_id").sortWithinPartitions("document_id", *order)


def documents(rows: DataFrame) -> DataFrame:
    return rows.select(*(c for c in METADATA if c in rows.columns))


def pages(rows: DataFrame) -> DataFrame:
    """Pages by number; a confidence that is kept as text comes out as a number, null where it is none."""
    return in_order(rows.withColumn("classification_confidence", F.col("classification_confidence").cast("string").try_cast("double")), "page_number")


def extractions(rows: DataFrame) -> DataFrame:
    return in_order(rows, "page_number")


def tables(rows: DataFrame) -> DataFrame:
    return in_order(rows, "page_number", "table_index")


def charts(rows: DataFrame) -> DataFrame:
    return in_order(rows, "page_number", "chart_index")


def structured(table_rows: DataFrame, chart_rows: DataFrame) -> DataFrame:
    """(document_id, table_count, chart_count, tables, charts): what each document holds, as arrays in reading order. A document's tables and charts are one
    row, as they are in the answer to a reader; for work at scale use ``tables`` and ``charts``."""

    def gathered(rows: DataFrame, name: str, index: str) -> DataFrame:
        rest = [c for c in rows.columns if c not in ("document_id", "page_number", index)]
        each = F.struct("page_number", index, *rest)
        return rows.groupBy("document_id").agg(F.count("*").alias(f"{name}_count"), F.array_sort(F.collect_list(each), lambda a, b: F.when(F.struct(a["page_number"], a[index]) < F.struct(b["page_number"], b[index]), -1).when(F.struct(a["page_number"], a[index]) > F.struct(b["page_number"], b[index]), 1).otherwise(0)).alias(f"{name}s"))

    both = gathered(table_rows, "table", "table_index").join(gathered(chart_rows, "chart", "chart_index"), "document_id", "full")
    zero = F.lit(0).cast("long")
    return both.select("document_id", F.coalesce("table_count", zero).alias("table_count"), F.coalesce("chart_count", zero).alias("chart_count"), "tables", "charts")


def extraction_counters(pages_: DataFrame, tables_: DataFrame, charts_: DataFrame, failures: DataFrame) -> DataFrame:
    """(document_id, page_count, tables_extracted, charts_processed, charts_resolved, charts_unresolved, failed_pages) of every document with pages:
    ``failures`` (document_id, page_number, error) are the pages that could not be read."""
    p = pages_.groupBy("document_id").agg(F.count("*").alias("page_count"))
    t = tables_.groupBy("document_id").agg(F.count("*").alias("tables_extracted"))
    resolved = F.count_if(F.col("resolution_status") == "resolved")
    c = charts_.groupBy("document_id").agg(F.count("*").alias("charts_processed"), resolved.alias("charts_resolved"), F.count_if(F.col("resolution_status") == "unresolved").alias("charts_unresolved"))
    f = failures.groupBy("document_id").agg(F.sort_array(F.collect_list(F.struct("page_number", "error"))).alias("failed_pages"))
    all_ = p.join(t, "document_id", "left").join(c, "document_id", "left").join(f, "document_id", "left")
    return all_.na.fill(0, ["tables_extracted", "charts_processed", "charts_resolved", "charts_unresolved"]).withColumn("failed_pages", F.coalesce("failed_pages", F.array().cast("array<struct<page_number:int,error:string>>")))
