"""Validation from end to end: findings of all checks, scores, decisions and runs, for all documents at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.frames import staged
from docloom.operators import dedup, findings, quality
from docloom.schemas import VALIDATION_RUN, shaped

INPUT_KINDS = ("checksum", "status", "text", "table", "chart")


def all_findings(texts: DataFrame, tables: DataFrame, charts: DataFrame) -> DataFrame:
    """Findings of the schema checks of texts, tables and charts, the structure of tables and their totals."""
    parts = [findings.text_schema(texts), findings.table_schema(tables), findings.chart_schema(charts), findings.table_structure(tables), findings.numeric_consistency(tables)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def input_parts(documents: DataFrame, texts: DataFrame, tables: DataFrame, charts: DataFrame) -> DataFrame:
    """(document_id, kind, value): what a run's outcome depends on, for ``dedup.input_hash``."""
    part = lambda df, kind, *columns: df.select("document_id", F.lit(kind).alias("kind"), F.to_json(F.struct(*columns)).alias("value"))
    own = [documents.select(F.col("id").alias("document_id"), F.lit(k).alias("kind"), F.col(c).alias("value")) for k, c in (("checksum", "checksum_sha256"), ("status", "status"))]
    rest = [part(df, kind, *(c for c in df.columns if c != "document_id")) for df, kind in ((texts, "text"), (tables, "table"), (charts, "chart"))]
    out = own[0]
    for p in (own[1], *rest):
        out = out.unionByName(p)
    return out


def validate(
    documents: DataFrame, texts: DataFrame, tables: DataFrame, charts: DataFrame, now: Column, runs: DataFrame | None = None, force: bool = False, weights: dict[str, float] | None = None
) -> tuple[DataFrame, DataFrame]:
    """(runs, findings) to append: one completed run for every document (id, checksum_sha256, status) whose inputs have changed since its latest
    completed run in ``runs``, or for all by ``force``; findings carry the run's id. Rows of documents that are not given take no part. A run's id is the
    digest of its document, inputs and time, so that a task that is run again makes the same one."""
    hashes = dedup.input_hash(input_parts(documents, *(df.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi") for df in (texts, tables, charts))))
    due = hashes if force or runs is None else dedup.not_yet_run(hashes, runs)
    due = due.select("document_id", "input_hash", now.cast("timestamp").alias("created_at"))
    due = due.withColumn("id", F.sha2(F.concat_ws("|", F.lit("run"), "document_id", "input_hash", F.col("created_at").cast("string")), 256))
    due = staged(due, "due")  # each check joins it, the hashes are made once
    of_due = lambda df: df.join(due.select("document_id"), "document_id", "left_semi")
    texts, tables, charts = of_due(texts), of_due(tables), of_due(charts)
    found = staged(all_findings(texts, tables, charts), "findings")  # the scores and the caller read them, the checks are made once
    score = quality.assess(texts, tables, charts, found, weights)
    scored = due.join(score, "document_id", "left")
    done = scored.select(
        "id", "document_id", F.lit("completed").alias("status"), F.round(F.coalesce("overall", quality.empty_score(weights)), 2).alias("overall_quality_score"),
        F.coalesce("decision", quality.decide(quality.empty_score(weights), F.lit(False), F.lit(False))).alias("final_decision"),
        quality.config_snapshot(weights).alias("config_snapshot"), "input_hash", "created_at", F.col("created_at").alias("completed_at"),
    )
    return shaped(done, VALIDATION_RUN), found.join(due.select("document_id", F.col("id").alias("validation_run_id")), "document_id")
