"""Quality scores and decisions from findings."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Weights of the components, neutral score, scores of structure and completeness, least score to approve.
WEIGHTS = {"ocr": 0.30, "validation": 0.40, "structure": 0.20, "completeness": 0.10}
NEUTRAL, WITH_TABLES = 50.0, 75.0
FEW_RESULTS, FEW_SCORE, MANY_SCORE = 3, 30.0, 90.0
APPROVE_AT = 85.0


def clamp(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), x))


def ocr_component() -> Column:
    """Aggregate over text extractions (extraction_method, confidence)."""
    ocr = F.when(F.lower("extraction_method").contains("ocr"), F.col("confidence"))
    return clamp(F.coalesce(F.avg(ocr) * 100.0, F.lit(NEUTRAL)))  # least() would pass over a null


def pass_rate(status: str = "status") -> Column:
    """Aggregate over findings; skipped ones do not count."""
    n = F.count_if(F.col(status).isin("passed", "failed", "error"))
    return F.when(n == 0, NEUTRAL).otherwise(F.try_divide(F.count_if(F.col(status) == "passed") * 100.0, n))


def summary(findings: DataFrame, *keys: str) -> DataFrame:
    """Numbers of findings by status."""
    by = [F.count_if(F.col("status") == s).alias(s) for s in ("passed", "failed", "skipped", "error")]
    return findings.groupBy(*keys).agg(F.count("*").alias("total"), *by)


def empty_score(weights: dict[str, float] | None = None) -> Column:
    """The score of a document of which nothing is known."""
    w = WEIGHTS | (weights or {})
    return clamp(F.lit(NEUTRAL * (w["ocr"] + w["validation"] + w["structure"])))


def breakdown(weights: dict[str, float] | None = None) -> Column:
    """Map of each component to its score, weight, contribution (to hundredths) and whether there was anything to go by."""
    w = WEIGHTS | (weights or {})
    known = {"ocr": F.col("n_texts") > 0, "validation": F.col("n_findings") > 0, "structure": F.col("n_tables") > 0, "completeness": (F.col("n_texts") > 0) | (F.col("n_tables") > 0)}
    part = lambda k: F.struct(F.round(k, 2).alias("score"), F.lit(w[k]).alias("weight"), F.round(F.col(k) * w[k], 2).alias("contribution"), known[k].alias("available"))
    return F.create_map(*(x for k in WEIGHTS for x in (F.lit(k), part(k))))


def assess(texts: DataFrame, tables: DataFrame, charts: DataFrame, findings: DataFrame, weights: dict[str, float] | None = None, explained: bool = False) -> DataFrame:
    """(document_id, ocr, validation, structure, completeness, overall, decision) of every document of any input, and ``breakdown`` where it is to be
    ``explained``. Each input is reduced to one row a document before the join. overall keeps its full precision; round it to show."""
    w = WEIGHTS | (weights or {})
    t = texts.groupBy("document_id").agg(F.count("*").alias("n_texts"), ocr_component().alias("ocr"))
    b = tables.groupBy("document_id").agg(F.count("*").alias("n_tables"))
    c = charts.groupBy("document_id").agg(F.count("*").alias("n_charts"))
    f = findings.groupBy("document_id").agg(
        F.count("*").alias("n_findings"), pass_rate().alias("validation"), F.max((F.col("severity") == "critical") & (F.col("status") == "error")).alias("fatal"), F.max((F.col("severity") == "error") & (F.col("status") == "failed")).alias("wrong")
    )
    all_ = t.join(b, "document_id", "full").join(c, "document_id", "full").join(f, "document_id", "full")
    counts = ("n_texts", "n_tables", "n_charts", "n_findings")
    all_ = all_.na.fill(0, list(counts))
    n = F.col("n_texts") + F.col("n_tables") + F.col("n_charts")
    parts = all_.select(
        "document_id", *counts, F.coalesce("ocr", F.lit(NEUTRAL)).alias("ocr"), F.coalesce("validation", F.lit(NEUTRAL)).alias("validation"), F.when(F.col("n_tables") > 0, WITH_TABLES).otherwise(NEUTRAL).alias("structure"),
        F.when(n == 0, 0.0).when(n < FEW_RESULTS, FEW_SCORE).otherwise(MANY_SCORE).alias("completeness"), F.coalesce("fatal", F.lit(False)).alias("fatal"), F.coalesce("wrong", F.lit(False)).alias("wrong"),
    )
    overall = clamp(sum((F.col(k) * F.lit(v) for k, v in w.items()), F.lit(0.0)))
    return parts.withColumn("overall", overall).withColumn("decision", decide(F.col("overall"), F.col("fatal"), F.col("wrong"))).withColumn("breakdown", breakdown(weights)).drop("fatal", "wrong", *counts, *(() if explained else ("breakdown",)))


def decide(score: Column, fatal: Column, wrong: Column, threshold: float = APPROVE_AT) -> Column:
    """approved, flagged or failed; the score counts as rounded to hundredths."""
    return F.when(fatal, "failed").when((F.round(score, 2) >= threshold) & ~wrong, "approved").otherwise("flagged")


def config_snapshot(weights: dict[str, float] | None = None, tolerance: float = 0.01) -> Column:
    return F.lit(json.dumps({"weights": WEIGHTS | (weights or {}), "approve_at": APPROVE_AT, "tolerance": tolerance}, sort_keys=True))
