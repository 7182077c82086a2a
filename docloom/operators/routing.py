"""Routing of classified pages and choice of their text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.text import text_length

#: Processing profile of each page class.
PROFILES = {"typed_text": "light", "scanned_document": "ocr_optimized", "table_dense": "table_preserving", "chart_graph": "visual", "map_diagram": "visual", "mixed": "visual"}
#: Words of a reason that speak for a chart with a table behind it, or against.
TABLE_WORDS = (("grid|axis|scale", 0.3), ("structured|regular|uniform", 0.2), ("numeric|data|value", 0.2))
VISUAL_WORDS = (("complex|irregular|organic", 0.3), ("shaded|gradient|color", 0.2), ("symbol|icon|picture", 0.2))


def profile(classification: Column) -> Column:
    out = None
    for name, value in PROFILES.items():
        test = F.lower(classification) == name
        out = F.when(test, value) if out is None else out.when(test, value)
    return out.otherwise("none")


def pages_by_profile(pages: DataFrame) -> DataFrame:
    """(document_id, profile, page_numbers): sorted page numbers of each profile of a document; pages without a number are left out."""
    rows = pages.filter("page_number is not null").select("document_id", profile(F.col("classification")).alias("profile"), "page_number")
    return rows.groupBy("document_id", "profile").agg(F.sort_array(F.collect_list("page_number")).alias("page_numbers"))


def _words(reason: Column, table: tuple) -> Column:
    return sum((F.when(F.lower(reason).rlike(words), score).otherwise(0.0) for words, score in table), F.lit(0.0))


def chart_route(reason: Column, confidence: Column, drawings: Column | None = None, image_ratio: Column | None = None, length: Column | None = None) -> Column:
    """TABLE_BACKED_CHART or VISUAL_NUMERIC_EXTRACTION, by the reason and, where given, the page's signals."""
    table, visual = _words(reason, TABLE_WORDS), _words(reason, VISUAL_WORDS)
    if drawings is not None:
        table = table + F.when(drawings >= 10, 0.2).otherwise(0.0)
        table = table + F.when(F.coalesce(image_ratio, F.lit(1.0)) < 0.3, 0.2).otherwise(0.0)
        table = table + F.when((length > 10) & (length < 200), 0.1).otherwise(0.0)
    table = F.when((confidence > 0.8) & (table == 0) & (visual == 0), 0.5).otherwise(table)
    return F.when(table >= visual, "TABLE_BACKED_CHART").otherwise("VISUAL_NUMERIC_EXTRACTION")


def visual_hints(classification: Column, route: Column) -> Column:
    """Map of processing hints of a page class."""
    hints = lambda *pairs: F.create_map(*(F.lit(x) if isinstance(x, str) else x for x in pairs))
    return (
        F.when(classification == "chart_graph", hints("chart_type", route, "extract_numeric_data", "true", "preserve_aspect_ratio", "true"))
        .when(classification == "map_diagram", hints("content_type", "spatial_visual", "extract_features", "true", "preserve_colors", "true", "detect_regions", "true"))
        .when(classification == "table_dense", hints("preserve_structure", "true", "extract_grid", "true", "ocr_friendly", "true"))
        .otherwise(F.create_map().cast("map<string,string>"))
    )


def should_extract_tables(classification: Column) -> Column:
    return F.coalesce(classification.isin("table_dense", "scanned_document", "mixed"), F.lit(False))


def should_apply_ocr(classification: Column, raw_text: Column) -> Column:
    return F.coalesce(classification.isin("scanned_document", "mixed"), F.lit(False)) & (F.coalesce(raw_text, F.lit("")) == "")


def wants_regions(profile_: Column) -> Column:
    """Whether a page's visual regions are looked for."""
    return F.coalesce(profile_.isin("visual", "table_preserving"), F.lit(False))


def wants_embedding(profile_: Column, regions: Column) -> Column:
    """Whether a page's image is embedded: visual pages, and others with regions."""
    return F.coalesce(profile_ == "visual", F.lit(False)) | (F.coalesce(regions, F.lit(0)) > 0)


def with_classification(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """Add the page's classification, 'unknown' where the page has none."""
    known = pages.select("document_id", "page_number", F.col("classification").alias("_class"))
    return rows.join(known, ["document_id", "page_number"], "left").withColumn("classification", F.coalesce("_class", F.lit("unknown"))).drop("_class")


def choose_text(rows: DataFrame) -> DataFrame:
    """Add chosen_text, extraction_method and confidence to rows (native_text, ocr_text, ocr_confidence, use_ocr): OCR counts where it
    is used and, stripped, longer; its confidence may be in 0..100 and comes out in 0..1."""
    better = F.col("use_ocr") & (text_length(F.col("ocr_text")) > text_length(F.col("native_text")))
    native = text_length(F.col("native_text")) > 0
    confidence = F.when(F.col("ocr_confidence") > 1, F.col("ocr_confidence") / 100.0).otherwise(F.col("ocr_confidence"))
    return (
        rows.withColumn("chosen_text", F.when(better, F.col("ocr_text")).otherwise(F.col("native_text")))
        .withColumn("extraction_method", F.when(better, "ocr_tesseract").when(native, "native_pdf").otherwise("none"))
        .withColumn("confidence", F.when(better, confidence))
    )
