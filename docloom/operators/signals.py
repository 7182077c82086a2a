"""Signals of pages: areas, drawings, clusters of coordinates, table candidates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions import text

LINE_DENSITY, RECT_DENSITY = 0.01, 0.005
LINE_WEIGHT, RECT_WEIGHT, GRID_WEIGHT = 0.4, 0.3, 0.3
LEAST_DRAWINGS, GRID_SPAN, SIDE_TOLERANCE = 4, 5.0, 0.02


def clusters(values: Column, tolerance: Column) -> Column:
    """Number of clusters of an array: sorted, a value further than the tolerance from the start of the last cluster starts one."""
    begin = F.struct(F.lit(0).alias("n"), F.lit(None).cast("double").alias("start"))
    step = lambda a, v: F.when(a["start"].isNull() | (v - a["start"] > tolerance), F.struct((a["n"] + 1).alias("n"), v.alias("start"))).otherwise(a)
    return F.aggregate(F.array_sort(values), begin, step, lambda a: a["n"])


def grid_score(xs: Column, ys: Column, drawings: Column, width: Column, height: Column) -> Column:
    tolerance = F.greatest(width, height) * SIDE_TOLERANCE
    n = F.least(clusters(xs, tolerance), clusters(ys, tolerance))
    return F.when((drawings >= LEAST_DRAWINGS) & (F.size(xs) >= LEAST_DRAWINGS), F.least(n / GRID_SPAN, F.lit(1.0))).otherwise(0.0)


def table_candidate_score(lines: Column, rects: Column, grid: Column, area: Column) -> Column:
    part = lambda n, dense, weight: F.least(n / area / dense, F.lit(1.0)) * weight
    score = part(lines, LINE_DENSITY, LINE_WEIGHT) + part(rects, RECT_DENSITY, RECT_WEIGHT) + grid * GRID_WEIGHT
    return F.when((lines + rects > 0) & (area > 0), F.least(score, F.lit(1.0))).otherwise(0.0)


def area_ratio(total: Column, width: Column, height: Column) -> Column:
    area = width * height
    return F.when(area > 0, total / area).otherwise(0.0)


def line_features(lengths: Column, positions: Column) -> Column:
    """Struct of a set of grid lines: line_count, average_length, length_variance and regularity (one less the variance of the gaps by their mean; 0 for
    less than three lines)."""
    ordered = F.array_sort(positions)
    gaps_of = lambda xs: F.zip_with(F.slice(xs, F.lit(2), F.greatest(F.size(xs) - 1, F.lit(0))), F.slice(xs, F.lit(1), F.greatest(F.size(xs) - 1, F.lit(0))), lambda b, a: b - a)
    n = F.size(lengths)
    return F.struct(
        n.alias("line_count"), F.when(n > 0, _mean(lengths)).otherwise(0.0).alias("average_length"), F.when(n > 1, _variance(lengths)).otherwise(0.0).alias("length_variance"),
        F.when(n > 2, _once(ordered, lambda xs: _once(gaps_of(xs), lambda gaps: 1.0 - _variance(gaps) / (_mean(gaps) + 1e-6)))).otherwise(0.0).alias("regularity"),
    )


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """``then`` of a value that is evaluated once: an expression that is used twice is also evaluated twice, and one within a function of an array for each of its elements."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def _variance(xs: Column) -> Column:
    return _once(_mean(xs), lambda m: F.aggregate(xs, F.lit(0.0), lambda a, x: a + (x - m) * (x - m)) / F.size(xs))


def element_features(areas: Column) -> Column:
    """Struct of the elements of a chart, by their areas: element_count, average_area (0 for none) and size_variance (of the whole; 0 for less than two)."""
    n = F.size(areas)
    return F.struct(n.alias("element_count"), F.when(n > 0, _mean(areas)).otherwise(0.0).alias("average_area"), F.when(n > 1, _variance(areas)).otherwise(0.0).alias("size_variance"))


def chart_features(regions: DataFrame) -> DataFrame:
    """``regions`` (kind, boxes as ``images.regions`` gives them) with elements of chart_data_elements and lines of grid lines (``element_features``, ``line_features``); null for
    other kinds."""
    of = lambda c: F.transform("boxes", lambda b: b[c].cast("double"))
    across, down = F.col("kind") == "horizontal_grid_lines", F.col("kind") == "vertical_grid_lines"
    elements = F.when(F.col("kind") == "chart_data_elements", element_features(of("area"))).alias("elements")
    lines = F.when(across, line_features(of("width"), of("y"))).when(down, line_features(of("height"), of("x"))).alias("lines")
    return regions.select("*", elements, lines)


def page_signals(layouts: DataFrame) -> DataFrame:
    """What ``classify`` goes by, of pages (document_id, page_number, width, height, text, images, drawings) as ``sources.files.layouts`` gives them; pages with an
    error are left out. Drawings count by the path they were painted with, where they tell it; the grid goes by the ends of the lines."""
    width, height = F.col("width"), F.col("height")
    area = width * height
    drawn = layouts.schema["drawings"].dataType.elementType.names
    lines = F.filter("drawings", lambda d: d["kind"] == "line")
    each = lambda c: F.transform(lines, lambda d: d[c])
    ends = lambda *names: F.filter(F.flatten(F.array(*(each(c) for c in names if c in drawn))), lambda x: x.isNotNull())
    count = lambda kind: F.size(F.filter("drawings", lambda d: d["kind"] == kind))
    covered = F.aggregate("images", F.lit(0.0), lambda a, i: a + i["width"] * i["height"])
    n = F.size("drawings")
    if "path" in drawn:
        paths = F.transform("drawings", lambda d: d["path"])
        n = F.size(F.array_distinct(F.filter(paths, lambda p: p.isNotNull()))) + F.size(F.filter(paths, lambda p: p.isNull()))
    rows = layouts.filter("error is null") if "error" in layouts.columns else layouts
    length = text.text_length(F.col("text"))
    return rows.select(
        "document_id", "page_number", "width", "height", length.cast("long").alias("text_length"), text.density(length, width, height).alias("text_density"), F.size("images").cast("long").alias("image_count"),
        area_ratio(covered, width, height).alias("image_area_ratio"), n.cast("long").alias("drawing_count"),
        table_candidate_score(count("line"), count("rect"), grid_score(ends("x", "x2"), ends("y", "y2"), n, width, height), area).alias("table_candidate_score"), (length > 0).alias("has_extractable_text"),
    )
