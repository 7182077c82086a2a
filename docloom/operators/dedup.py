"""Ingestion: content hashes, duplicates and ids."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docloom.functions.text import checksum, is_checksum, is_uuid
from docloom.schemas import DOCUMENT, shaped

MAX_NAME, MAX_TYPE = 255, 100


def fingerprint(files: DataFrame, content: str = "content") -> DataFrame:
    """Add checksum_sha256 and file_size of the content."""
    data = F.col(content).cast("binary")
    return files.withColumn("checksum_sha256", checksum(data)).withColumn("file_size", F.octet_length(data).cast("long"))


def first_of_each(files: DataFrame, key: str, *order: str) -> DataFrame:
    """Add first_<id> for the first row of each key: min over a struct, so that each task sends one row for a key and a common
    content does not gather in one task."""
    first = files.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order)).alias("first"))
    return files.join(first, key, "left")


def deduplicate(files: DataFrame, *order: str, store: DataFrame | None = None) -> DataFrame:
    """Add document_id, canonical (the order columns of the first row with the same content) and is_duplicate. With a ``store`` of
    earlier documents (id, checksum_sha256), content that it has is a duplicate of the stored one."""
    marked = first_of_each(files, "checksum_sha256", *order)
    later = F.struct(*order) > F.col("first")
    if store is not None:
        known = store.groupBy("checksum_sha256").agg(F.min("id").alias("stored_id"))
        marked = marked.join(known, "checksum_sha256", "left")
    else:
        marked = marked.withColumn("stored_id", F.lit(None).cast("string"))
    fresh = F.sha2(F.concat(F.lit("document:"), "checksum_sha256"), 256)
    return marked.select(
        *files.columns,
        F.coalesce("stored_id", fresh).alias("document_id"),
        F.col("first").alias("canonical"),
        (F.col("stored_id").isNotNull() | later).alias("is_duplicate"),
    )


class Ingested(NamedTuple):
    """What an ingestion found for each file, the new rows for the documents' table, and the contents for ``store.Blobs``."""

    results: DataFrame
    documents: DataFrame
    blobs: DataFrame


def ingest(files: DataFrame, store: DataFrame, source_type: str) -> Ingested:
    """Files (original_filename, content_type, content, and what else comes with them) hashed and checked against the store and each other. The first file of
    a content, by name, type and then its other columns, is the document; of files equal in every column all but one are duplicates. Files with a
    missing name or type, or without content, are left out. results: a row for each file with document_id, canonical (the name and type of its document, as the
    ``store`` has them where it does) and is_duplicate. documents: rows of ``schemas.DOCUMENT``, with the source_identifier, subsidiary and document_timestamp that files
    come with."""
    named = (F.length("original_filename").between(1, MAX_NAME)) & (F.length("content_type").between(1, MAX_TYPE)) & (F.octet_length("content") > 0)
    hashed = fingerprint(files.filter(named))
    light = hashed.drop("content")
    # equal rows are counted and numbered: no row has to be told from its copies by where it lies
    numbered = light.groupBy(*light.columns).agg(F.count("*").alias("_rows")).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "_rows"))).drop("_rows")
    numbered = numbered.withColumn("_row", F.xxhash64(*light.columns))
    results = deduplicate(numbered, "original_filename", "content_type", "_row", "_copy", store=store)
    own = F.struct("canonical.original_filename", "canonical.content_type")
    if {"original_filename", "content_type"} <= set(store.columns):
        known = store.groupBy("checksum_sha256").agg(F.min_by(F.struct("original_filename", "content_type"), "id").alias("_stored"))
        results = results.join(known, "checksum_sha256", "left").withColumn("canonical", F.coalesce("_stored", own)).drop("_stored")
    else:
        results = results.withColumn("canonical", own)
    results = results.select(*light.columns, "document_id", "canonical", "is_duplicate")
    fresh = results.filter("not is_duplicate")
    made = {"id": F.col("document_id"), "source_type": F.lit(source_type), "storage_reference": reference(F.col("checksum_sha256")), "status": F.lit("ingested"), "ingested_at": F.current_timestamp()}
    rows = shaped(fresh.withColumns(made), DOCUMENT)
    contents = hashed.join(store.select("checksum_sha256").distinct(), "checksum_sha256", "left_anti").dropDuplicates(["checksum_sha256"])
    return Ingested(results, rows, contents.select(reference(F.col("checksum_sha256")).alias("storage_reference"), "content"))


def reference(checksum_: Column) -> Column:
    """Where the content of this checksum is stored."""
    return F.concat(F.lit("blobs/"), checksum_)


def input_hash(parts: DataFrame) -> DataFrame:
    """(document_id, input_hash): digest of a document's parts (document_id, kind, value), whatever their order. A malformed id counts by
    its own digest."""
    own = F.when(is_uuid(F.col("document_id").cast("string")), F.col("document_id").cast("string")).otherwise(F.sha2(F.col("document_id").cast("string"), 256))
    part = F.concat(F.col("kind"), F.lit(":"), F.sha2(F.coalesce(F.col("value"), F.lit("")), 256))
    grouped = parts.groupBy("document_id").agg(F.array_sort(F.collect_list(part)).alias("parts"))
    return grouped.select("document_id", F.sha2(F.array_join(F.concat(F.array(F.concat(F.lit("doc_id:"), own)), "parts"), "|"), 256).alias("input_hash"))


def valid_document(file_size: Column, checksum_: Column, name: Column, kind: Column) -> Column:
    """The declared constraints of a document row."""
    return F.coalesce((F.length(name) <= MAX_NAME) & (F.length(kind) <= MAX_TYPE) & (file_size > 0) & is_checksum(checksum_), F.lit(False))


def latest(runs: DataFrame, key: str, created: str, tie: str) -> DataFrame:
    """The latest row of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(created), F.desc(tie))
    return runs.withColumn("_place", F.row_number().over(w)).filter("_place = 1").drop("_place")


def not_yet_run(inputs: DataFrame, runs: DataFrame) -> DataFrame:
    """Inputs (document_id, input_hash) whose document has no completed latest run of the same hash."""
    done = latest(runs, "document_id", "created_at", "id").filter("status = 'completed'").select("document_id", "input_hash")
    return inputs.join(done, ["document_id", "input_hash"], "left_anti")
