"""Tables from ruled lines, and the nearest table of a chart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEAST_POINTS, MOST_LINES = 4, 50


def intersections(horizontal: DataFrame, vertical: DataFrame) -> DataFrame:
    """(document_id, page_number, x, y) where segments cross: horizontal (x1, x2, y), vertical (x, y1, y2).

    Each page has a grid of square cells, as wide as its segments are long on average; a segment goes to the cells that it passes, two for each segment of
    the page at most, on the whole. A crossing lies in one cell, in which alone both segments meet; so what is tested is near a crossing, whatever the
    number of lines of the page. Segments with a null, or that end before they begin, cross nothing."""
    page = ["document_id", "page_number"]
    h = horizontal.select(*page, F.col("x1").alias("hx1"), F.col("x2").alias("hx2"), F.col("y").alias("y")).filter("hx1 <= hx2 and y is not null")
    v = vertical.select(*page, F.col("x").alias("x"), F.col("y1").alias("vy1"), F.col("y2").alias("vy2")).filter("vy1 <= vy2 and x is not null")
    lengths = h.select(*page, (F.col("hx2") - F.col("hx1")).alias("l")).unionByName(v.select(*page, (F.col("vy2") - F.col("vy1")).alias("l")))
    sides = lengths.groupBy(*page).agg(F.avg("l").alias("side")).withColumn("side", F.when(F.col("side") > 0, F.col("side")).otherwise(1.0))
    cell = lambda c: F.floor(F.col(c) / F.col("side"))
    h = h.join(sides, page).withColumns({"cy": cell("y"), "cx": F.explode(F.sequence(cell("hx1"), cell("hx2")))}).drop("side")
    v = v.join(sides, page).withColumns({"cx": cell("x"), "cy": F.explode(F.sequence(cell("vy1"), cell("vy2")))}).drop("side")
    met = h.join(v, [*page, "cx", "cy"]).filter("hx1 <= x and x <= hx2 and vy1 <= y and y <= vy2")
    return met.select(*page, "x", "y")


def grids(points: DataFrame) -> DataFrame:
    """One table for each page with enough points: its box, sorted distinct coordinates, rows, columns and structure confidence."""
    page = points.groupBy("document_id", "page_number").agg(
        F.count("*").alias("points"), F.min("x").alias("x1"), F.max("x").alias("x2"), F.min("y").alias("y1"), F.max("y").alias("y2"),
        F.array_sort(F.collect_set("x")).alias("xs"), F.array_sort(F.collect_set("y")).alias("ys"),
    )
    n = lambda c: F.size(c)
    fits = (F.col("points") >= LEAST_POINTS) & n("xs").between(2, MOST_LINES) & n("ys").between(2, MOST_LINES)
    return page.filter(fits).select(
        "document_id", "page_number", "x1", "y1", "x2", "y2", "xs", "ys", (n("ys") - 1).alias("row_count"), (n("xs") - 1).alias("column_count"),
        F.least(n("xs") * n("ys") / 100.0, F.lit(1.0)).alias("structure_confidence"),
    )


def cells(tables: DataFrame) -> DataFrame:
    """(document_id, page_number, row_index, column_index, x, y, width, height) for each cell of each grid."""
    rows = tables.select("document_id", "page_number", "xs", F.posexplode(F.arrays_zip(F.slice("ys", F.lit(1), F.size("ys") - 1).alias("a"), F.slice("ys", F.lit(2), F.size("ys") - 1).alias("b"))).alias("row_index", "r"))
    both = rows.select("document_id", "page_number", "row_index", "r", F.posexplode(F.arrays_zip(F.slice("xs", F.lit(1), F.size("xs") - 1).alias("a"), F.slice("xs", F.lit(2), F.size("xs") - 1).alias("b"))).alias("column_index", "c"))
    return both.select("document_id", "page_number", "row_index", "column_index", F.col("c.a").alias("x"), F.col("r.a").alias("y"), (F.col("c.b") - F.col("c.a")).alias("width"), (F.col("r.b") - F.col("r.a")).alias("height"))


def from_segments(segments: DataFrame) -> DataFrame:
    """Tables of pages from their ruled lines (document_id, page_number, across, position, start, end), as ``grids``."""
    on = segments.filter("position is not null")
    horizontal = on.filter("across").select("document_id", "page_number", F.col("start").alias("x1"), F.col("end").alias("x2"), F.col("position").alias("y"))
    vertical = on.filter("not across").select("document_id", "page_number", F.col("position").alias("x"), F.col("start").alias("y1"), F.col("end").alias("y2"))
    return grids(intersections(horizontal, vertical))


def texts_in(grid: DataFrame, spans: DataFrame) -> DataFrame:
    """(document_id, page_number, row_index, column_index, text, confidence) of the spans (document_id, page_number, x, y, size, text; y is the baseline) within the cells of
    each ``grids`` row: a cell's spans from top to bottom and left to right, joined by blanks. Texts that a file says itself have confidence one."""
    at = spans.select("document_id", "page_number", F.col("x").alias("sx"), F.col("y").alias("sy"), (F.col("y") - F.col("size") * 0.3).alias("middle"), "text")
    inside = lambda lines, v: F.size(F.filter(lines, lambda line: line <= v)) - 1
    met = at.join(grid.select("document_id", "page_number", "xs", "ys"), ["document_id", "page_number"]).withColumns({"row_index": inside("ys", F.col("middle")), "column_index": inside("xs", F.col("sx"))})
    met = met.filter((F.col("row_index") >= 0) & (F.col("row_index") < F.size("ys") - 1) & (F.col("column_index") >= 0) & (F.col("column_index") < F.size("xs") - 1))
    each = met.groupBy("document_id", "page_number", "row_index", "column_index").agg(F.array_sort(F.collect_list(F.struct("sy", "sx", "text"))).alias("spans"))
    return each.select("document_id", "page_number", "row_index", "column_index", F.array_join(F.transform("spans", lambda s: s["text"]), " ").alias("text"), F.lit(1.0).alias("confidence"))


def with_texts(pages: DataFrame) -> DataFrame:
    """``pages``, each with the grid (xs, ys) and the spans of one page, with table_data and extraction_confidence: what ``filled`` makes of ``texts_in``, where both are in one row. Of
    each row of the table the spans are looked up once, and of each cell those of its row."""
    inside = lambda lines, v: F.size(F.filter(lines, lambda line: line <= v)) - 1
    at = F.transform(F.coalesce("spans", F.array()), lambda s: F.struct(inside("ys", s["y"] - s["size"] * 0.3).alias("i"), inside("xs", s["x"]).alias("j"), s["y"].alias("sy"), s["x"].alias("sx"), s["text"].alias("text")))
    met = F.array_sort(F.filter(at, lambda s: (s["i"] >= 0) & (s["i"] < F.size("ys") - 1) & (s["j"] >= 0) & (s["j"] < F.size("xs") - 1)))
    upto = lambda n: F.sequence(F.lit(0), F.size(n) - 2)
    in_rows = F.transform(upto("ys"), lambda i: F.filter("_met", lambda s: s["i"] == i))
    data = F.transform(in_rows, lambda row: F.transform(upto("xs"), lambda j: F.array_join(F.transform(F.filter(row, lambda s: s["j"] == j), lambda s: s["text"]), " ")))
    # a generator: else each use of the spans' places works them out anew
    met = pages.select("*", F.explode(F.array(F.when(F.col("xs").isNotNull(), met))).alias("_met"))
    return met.withColumns({"table_data": F.when(F.col("xs").isNotNull(), data), "extraction_confidence": F.when(F.size("_met") > 0, 1.0).otherwise(0.0)}).drop("_met")


def filled(grid: DataFrame, texts: DataFrame) -> DataFrame:
    """Tables (document_id, page_number, row_count, column_count, ...) with table_data and extraction_confidence from the texts of their cells (document_id,
    page_number, row_index, column_index, text, confidence): a cell without text is ''."""
    cell = F.struct("row_index", "column_index", F.coalesce("text", F.lit("")).alias("text"), "confidence")
    known = texts.groupBy("document_id", "page_number").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("row_index", "column_index").alias("key"), cell.alias("value")))).alias("_cells"))
    at = lambda i, j: F.coalesce(F.try_element_at("_cells", F.struct(i.alias("row_index"), j.alias("column_index")))["text"], F.lit(""))
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    data = F.transform(upto("row_count"), lambda i: F.transform(upto("column_count"), lambda j: at(i, j)))
    joined = grid.join(known, ["document_id", "page_number"], "left").withColumn("table_data", data)
    confidences = F.transform(F.map_values(F.coalesce("_cells", F.create_map().cast("map<struct<row_index:int,column_index:int>,struct<row_index:int,column_index:int,text:string,confidence:double>>"))), lambda c: c["confidence"])
    return joined.withColumn("_confidences", confidences).withColumn("extraction_confidence", mean_cell_confidence("_confidences")).drop("_cells", "_confidences")


def mean_cell_confidence(confidences: str) -> Column:
    """Mean of the positive ones; 0 without any."""
    good = F.filter(confidences, lambda c: c > 0)
    return F.when(F.size(good) > 0, F.aggregate(good, F.lit(0.0), lambda a, c: a + c) / F.size(good)).otherwise(0.0)


def associate_charts(charts: DataFrame, tables: DataFrame) -> DataFrame:
    """Each chart (document_id, page_number, chart_index) with its nearest table: on its page, else the page before, else the one after, which
    have to be pages from one on; there the largest, the first on ties. Three equi-joins' worth of keys in one: a table is offered to the three pages that can want it."""
    own = F.array(F.struct(F.col("page_number").alias("page_number"), F.lit(0).alias("rank")))
    beside = F.array(F.struct((F.col("page_number") + 1).alias("page_number"), F.lit(1).alias("rank")), F.struct((F.col("page_number") - 1).alias("page_number"), F.lit(2).alias("rank")))
    near = tables.select(
        "document_id", F.col("id").alias("associated_table_id"), (F.col("row_count") * F.col("column_count")).alias("area"), "table_index",
        F.explode(F.when(F.col("page_number") >= 1, F.concat(own, beside)).otherwise(own)).alias("to"),
    )
    # the best table for each page, as the least of (rank, -area, index): aggregated before the join
    best = near.groupBy("document_id", F.col("to.page_number").alias("page_number")).agg(F.min(F.struct(F.col("to.rank").alias("rank"), (-F.col("area")).alias("area"), "table_index", "associated_table_id")).alias("best"))
    found = charts.join(best, ["document_id", "page_number"], "left")
    hit = F.col("best").isNotNull()
    return found.select(
        "document_id", "page_number", "chart_index", F.col("best.associated_table_id").alias("associated_table_id"),
        F.when(~hit, "no_matching_table_found").when(F.col("best.rank") == 0, "same_page_table").otherwise("adjacent_page_table").alias("association_method"),
        F.when(hit, 0.8).otherwise(0.0).alias("association_confidence"), F.when(hit, "resolved").otherwise("unresolved").alias("resolution_status"),
    )
