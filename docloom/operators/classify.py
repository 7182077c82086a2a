"""Page classes by ordered rules, with confidences and reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Thresholds of the rules.
MIN_TEXT_TYPED, MAX_TEXT_SCANNED = 50, 10
MIN_DENSITY_TYPED, MAX_DENSITY_SCANNED = 0.001, 0.0005
SCANNED_COVERAGE, TABLE_DENSE, MAP_AREA = 0.3, 0.5, 0.4
LINE_RATIO = 0.6
#: What the reasons say.
REASONS = {
    "table_dense": ("Strong table candidate signal detected (score: %.2f).", ["table_candidate_score"]),
    "scanned_document": ("Very low native text density (%d chars) combined with high image coverage (%.2f).", ["text_length", "image_area_ratio"]),
    "chart_graph": ("Chart/graph-like structure detected (line ratio: 0.60, text length: %d chars, drawings: %d) suggesting potential numerical visualization.", ["text_length", "drawing_count"]),
    "map_diagram": ("Map/diagram-like visual content detected (image area: %.2f, drawings: %d, text length: %d chars) suggesting spatial/visual information.", ["image_area_ratio", "drawing_count", "text_length"]),
    "typed_text": ("High native text density (%d chars, density: %.4f) with low visual competition.", ["text_length", "text_density"]),
    "mixed": ("Mixed content detected: text (%d chars) combined with visual/table elements (images: %d, drawings: %d, table score: %.2f).", ["text_length", "image_count", "drawing_count", "table_candidate_score"]),
}
INVALID_PAGE = "Invalid page dimensions"
CLASSES = ("unknown", *REASONS)


def rules() -> dict[str, Column]:
    """Predicates in the order in which they are tried; what meets none is mixed."""
    tl, td, ia = F.col("text_length"), F.col("text_density"), F.col("image_area_ratio")
    dc, ts = F.col("drawing_count"), F.col("table_candidate_score")
    scanned = (tl <= MAX_TEXT_SCANNED) & (td <= MAX_DENSITY_SCANNED) & (ia >= SCANNED_COVERAGE)
    chart = (dc >= 5) & (((tl > 5) & (tl < 100)) | ((dc >= 8) & (tl > 3))) & (ts < 0.4) & (ia < 0.4)
    spatial = ((ia >= MAP_AREA) | (dc >= 15)) & (tl < 150) & (ts < 0.3) & ((ia >= 0.2) | (dc >= 10))
    return {
        "unknown": (F.col("width") <= 0) | (F.col("height") <= 0),
        "table_dense": ts >= TABLE_DENSE,
        "scanned_document": scanned,
        "chart_graph": chart,
        "map_diagram": spatial,
        "typed_text": (tl >= MIN_TEXT_TYPED) & (td >= MIN_DENSITY_TYPED) & (ia < 0.1) & (ts < 0.3),
    }


def confidences() -> dict[str, Column]:
    tl, td, ia = F.col("text_length"), F.col("text_density"), F.col("image_area_ratio")
    dc, ts = F.col("drawing_count"), F.col("table_candidate_score")
    cap = lambda x, top: F.least(x, F.lit(top))
    text = cap(tl / 150.0, 1.0)
    visual = cap(ia * 0.4 + cap(dc / 20.0, 1.0) * 0.4 + ts * 0.2, 1.0)
    balanced = (text + visual) / 2.0 * (0.5 + (1.0 - F.abs(text - visual)) * 0.5)
    dispersed = F.when((ia >= 0.2) | (dc >= 10), 0.7).otherwise(0.3)
    return {
        "unknown": F.lit(0.0),
        "table_dense": cap(0.5 + ts * 0.5, 1.0),
        "scanned_document": cap(0.5 + ia * 0.5 + F.when(tl == 0, 0.5).otherwise(0.0), 1.0),
        "chart_graph": cap(LINE_RATIO * 0.4 + F.when(tl > 0, cap(tl / 50.0, 1.0)).otherwise(0.3) * 0.3 + cap(dc / 20.0, 1.0) * 0.3, 0.9),
        "map_diagram": cap(cap((ia + cap(dc / 50.0, 1.0)) / 1.5, 1.0) * 0.4 + F.greatest(F.lit(0.0), 1.0 - tl / 300.0) * 0.3 + dispersed * 0.3, 0.85),
        "typed_text": cap(F.greatest(cap(td * 500.0, 1.0) - (ia * 0.5 + ts * 0.3), F.lit(0.5)), 1.0),
        "mixed": cap(F.when((text > 0.3) & (visual > 0.3), balanced).otherwise(F.greatest(text, visual) * 0.6), 1.0),
    }


def classify(pages: DataFrame) -> DataFrame:
    """Add classification, classification_confidence and classification_reason to page signals."""
    chain = None
    for name, rule in rules().items():
        chain = F.when(rule, name) if chain is None else chain.when(rule, name)
    marked = pages.withColumn("classification", chain.otherwise("mixed"))
    confidence, reason = None, None
    for name, value in confidences().items():
        is_it = F.col("classification") == name
        confidence = F.when(is_it, value) if confidence is None else confidence.when(is_it, value)
        if name in REASONS:
            form, columns = REASONS[name]
            said = F.format_string(form, *(F.col(c) for c in columns))
            reason = F.when(is_it, said) if reason is None else reason.when(is_it, said)
    return marked.withColumn("classification_confidence", confidence).withColumn("classification_reason", reason.otherwise(INVALID_PAGE))
