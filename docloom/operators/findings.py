"""Validation of extractions: rows of findings, by set operations over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.numeric import number_in, numeric_like

TOLERANCE = 0.01
TOTAL_WORDS = "total|sum|aggregate|final"
HEADER_BELOW, DATA_ABOVE, DATA_ROWS = 0.3, 0.7, 5
RESOLUTIONS = ("resolved", "unresolved", "partial")


def finding(validator: str, check: Column | str, status: Column | str, severity: Column | str, reference: Column | None = None, message: Column | str = "", **details: Column) -> list[Column]:
    """Columns of a finding, beside document_id and page_number."""
    text = lambda x: F.lit(x) if isinstance(x, str) else x
    pairs = [y for k, v in details.items() for y in (F.lit(k), v.cast("string"))]
    return [
        F.col("document_id"), F.lit(validator).alias("validator"), text(check).alias("check_name"), text(status).alias("status"), text(severity).alias("severity"), text(message).alias("message"), F.col("page_number"),
        (reference if reference is not None else F.lit(None).cast("string")).alias("table_reference"), (F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")).alias("details"),
    ]


def _bad_fields(rows: DataFrame, prefix: str, reference: Column | None, **bad: Column) -> DataFrame:
    """One failed finding for each field of each row that its predicate finds bad; null counts as good where the predicate is null."""
    names = F.filter(F.array(*(F.when(test, field) for field, test in bad.items())), lambda x: x.isNotNull())
    each = rows.withColumn("_field", F.explode(names))
    return each.select(*finding("schema", F.concat(F.lit(f"{prefix}_"), "_field"), "failed", "error", reference, F.concat(F.lit(f"{prefix}: invalid "), "_field")))


def _out_of_unit(c: str) -> Column:
    return (F.col(c) < 0) | (F.col(c) > 1)


def text_schema(rows: DataFrame) -> DataFrame:
    return _bad_fields(rows, "text_extraction", None, page_number=F.col("page_number").isNull() | (F.col("page_number") <= 0), confidence=_out_of_unit("confidence"))


def table_schema(rows: DataFrame) -> DataFrame:
    data = F.col("table_data")
    widths = F.transform(data, lambda r: F.size(r))
    uneven = F.size(F.array_distinct(widths)) > 1
    null_cell = F.exists(data, lambda r: r.isNull() | F.exists(r, lambda c: c.isNull()))
    return _bad_fields(
        rows, "table_extraction", F.col("id"), page_number=F.col("page_number").isNull() | (F.col("page_number") < 0), table_index=F.col("table_index").isNull() | (F.col("table_index") < 0),
        row_count=F.col("row_count").isNull() | (F.col("row_count") <= 0), column_count=F.col("column_count").isNull() | (F.col("column_count") <= 0),
        extraction_confidence=_out_of_unit("extraction_confidence"), structure_confidence=_out_of_unit("structure_confidence"),
        table_data=data.isNull() | (F.size(data) == 0) | uneven | null_cell,
    )


def chart_schema(rows: DataFrame) -> DataFrame:
    return _bad_fields(
        rows, "chart_association", F.col("id"), page_number=F.col("page_number").isNull() | (F.col("page_number") < 0), chart_index=F.col("chart_index").isNull() | (F.col("chart_index") < 0),
        association_confidence=F.col("association_confidence").isNull() | _out_of_unit("association_confidence"), resolution_status=F.col("resolution_status").isNull() | ~F.col("resolution_status").isin(*RESOLUTIONS),
    )


def _empty(cell: Column) -> Column:
    return cell.isNull() | (cell == "")


def _numeric_share(row: Column) -> Column:
    """Share of numeric cells among those not empty; null if all are empty."""
    begin = F.struct(F.lit(0).alias("numbers"), F.lit(0).alias("n"))
    count = lambda a, c: F.when(_empty(c), a).otherwise(F.struct((a["numbers"] + F.when(numeric_like(c), 1).otherwise(0)).alias("numbers"), (a["n"] + 1).alias("n")))
    return F.aggregate(row, begin, count, lambda a: F.when(a["n"] > 0, a["numbers"] / a["n"]))


def _judged(check: str, status: str, severity: str, message: str, **details: Column) -> Column:
    """One finding as a struct, for arrays of them."""
    pairs = [y for k, v in details.items() for y in (F.lit(k), v.cast("string"))]
    said = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(check).alias("check_name"), F.lit(status).alias("status"), F.lit(severity).alias("severity"), F.lit(message).alias("message"), said.alias("details"))


def _exploded(rows: DataFrame, validator: str, found: Column) -> DataFrame:
    """A finding for each struct of an array: one pass over the tables, and no table twice."""
    each = rows.select("document_id", "page_number", F.col("id").alias("table_reference"), F.explode(found).alias("f"))
    return each.select("document_id", F.lit(validator).alias("validator"), "f.check_name", "f.status", "f.severity", "f.message", "page_number", "table_reference", "f.details")


def table_structure(rows: DataFrame) -> DataFrame:
    """Empty tables, uneven rows, empty rows and columns, and a header row, of tables (id, document_id, page_number, row_count,
    column_count, table_data)."""
    data = F.col("table_data")
    filled = F.coalesce(F.size(data) > 0, F.lit(False))
    shown = lambda a: F.array_join(F.transform(a, lambda x: x.cast("string")), ",")
    indices = F.when(filled, F.sequence(F.lit(0), F.size(data) - 1))
    first = F.get(data, F.lit(0))
    places = F.when(F.size(first) > 0, F.sequence(F.lit(0), F.size(first) - 1))
    looked_at = F.slice(data, F.lit(2), F.greatest(F.lit(0), F.least(F.col("row_count") - 1, F.lit(DATA_ROWS))))
    marked = rows.select(
        "document_id", "page_number", "id", "row_count", "column_count", "table_data",
        F.filter(indices, lambda i: F.size(F.get(data, i)) != F.col("column_count")).alias("_uneven"),
        F.filter(indices, lambda i: F.forall(F.get(data, i), _empty)).alias("_rows"),
        F.filter(places, lambda j: F.forall(data, lambda r: _empty(F.get(r, j)))).alias("_columns"),
        F.when(filled, _numeric_share(first)).alias("_first"),
        F.when(filled, F.filter(F.transform(looked_at, _numeric_share), lambda s: s.isNotNull())).alias("_shares"),
    )
    # one use of the array: an expression that is used twice is also evaluated twice
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    mean = F.aggregate("_shares", begin, lambda a, s: F.struct((a["sum"] + s).alias("sum"), (a["n"] + 1).alias("n")), lambda a: F.when(a["n"] > 0, a["sum"] / a["n"]))
    one = lambda test, finding_: F.when(F.coalesce(test, F.lit(False)), F.array(finding_)).otherwise(F.filter(F.array(finding_), lambda _: F.lit(False)))
    uneven = F.transform(F.coalesce("_uneven", F.array().cast("array<int>")), lambda i: _judged("inconsistent_row_width", "failed", "error", "A row is not as wide as the table.", row_index=i, expected_columns=F.col("column_count"), actual_columns=F.size(F.get(data, i))))
    found = F.concat(
        one(F.col("row_count") == 0, _judged("empty_table", "failed", "warning", "The table has no rows.")),
        one((F.col("row_count") != 0) & (F.col("column_count") == 0), _judged("empty_table_columns", "failed", "warning", "The table has no columns.")),
        uneven,
        one(F.size("_rows") > 0, _judged("empty_rows_detected", "passed", "info", "Some rows are empty.", empty_row_indices=shown(F.col("_rows")))),
        one(F.size("_columns") > 0, _judged("empty_columns_detected", "passed", "info", "Some columns are empty.", empty_column_indices=shown(F.col("_columns")))),
        one((F.col("_first") < HEADER_BELOW) & (mean > DATA_ABOVE), _judged("header_row_detected", "passed", "info", "The first row looks like a header.")),
    )
    return _exploded(marked, "table", found)


def _with_totals(rows: DataFrame, keep_without: bool) -> DataFrame:
    """A row for each numeric column n (j, v) of the first total row of each table; optionally also one, n null, for a table without. Rows are
    looked through for words first, so that numbers are read in those few that name a total."""
    indexed = F.transform("table_data", lambda row, i: F.struct(i.alias("row_index"), row.alias("row")))
    names = lambda row: F.exists(row, lambda c: F.coalesce(F.lower(F.trim(c)).rlike(TOTAL_WORDS), F.lit(False)))
    numbers = lambda row: F.filter(F.transform(row, lambda c, j: F.struct(j.alias("j"), number_in(c).alias("v"))), lambda x: x["v"].isNotNull())
    named = F.transform(F.filter(indexed, lambda r: names(r["row"])), lambda r: F.struct(r["row_index"].alias("row_index"), numbers(r["row"]).alias("numbers")))
    first = F.get(F.filter(named, lambda r: F.size(r["numbers"]) > 0), F.lit(0))
    each = F.explode_outer if keep_without else F.explode
    # a generator in between: an expression that is used twice is also evaluated twice
    marked = rows.select("document_id", "page_number", "id", "table_data", F.explode(F.array(first)).alias("_total"))
    return marked.select("document_id", "page_number", "id", "table_data", F.col("_total.row_index").alias("total_row"), each("_total.numbers").alias("n"))


def _summed(each: DataFrame) -> DataFrame:
    """Add total, calculated, valid_rows and invalid_cells (row_index, value, reason) to the rows of ``_with_totals``: the cells of the column above
    the total row, read once."""
    j = F.col("n.j")
    cell = lambda r, i: F.struct(i.alias("row_index"), F.get(r, j).alias("value"), number_in(F.get(r, j)).alias("v"), (F.size(r) <= j).alias("outside"))
    above = F.transform(F.slice("table_data", F.lit(1), F.coalesce("total_row", F.lit(0))), cell)
    read = each.select("document_id", "page_number", "id", "table_data", "total_row", "n", F.explode(F.array(above)).alias("_above"))
    begin = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("n"))
    summed = F.aggregate("_above", begin, lambda a, c: F.when(c["v"].isNull(), a).otherwise(F.struct((a["sum"] + c["v"]).alias("sum"), (a["n"] + 1).alias("n"))))
    bad = F.transform(
        F.filter("_above", lambda c: c["v"].isNull()),
        lambda c: F.struct(c["row_index"].alias("row_index"), c["value"].alias("value"), F.when(c["outside"], "column_index_out_of_bounds").otherwise("non_numeric_or_empty").alias("reason")),
    )
    done = read.select("document_id", "page_number", "id", "table_data", "total_row", "n", summed.alias("_sum"), bad.alias("invalid_cells"))
    return done.select("document_id", "page_number", "id", "table_data", F.col("n.j").alias("column_index"), F.col("n.v").alias("total"), F.col("_sum.sum").alias("calculated"), F.col("_sum.n").alias("valid_rows"), "invalid_cells")


def _verdict() -> Column:
    """Where a sum or total is no finite number, or they differ by more than the tolerance, they do not match."""
    off = F.abs(F.col("total") - F.col("calculated"))
    return F.when(F.col("valid_rows") == 0, "no_valid_data_for_sum").when(~F.isnan(off) & (off <= TOLERANCE), "total_match").otherwise("total_mismatch")


def total_checks(rows: DataFrame) -> DataFrame:
    """(document_id, page_number, id, column_index, total, calculated, valid_rows, invalid_cells, check_name): each numeric column of the first total row
    of each table against the sum of the rows above it. A total row is the first, in reading order, with a cell that names a
    total and another cell that is a number. Sums are doubles, in the order of the rows."""
    return _summed(_with_totals(rows, keep_without=False)).withColumn("check_name", _verdict()).drop("table_data")


def numeric_consistency(rows: DataFrame) -> DataFrame:
    """Findings of the total rows, and skipped ones for tables without data or without a total row."""
    each = _summed(_with_totals(rows, keep_without=True))
    empty = F.coalesce(F.size("table_data"), F.lit(0)) <= 0
    name = F.when(empty, "no_data_for_numeric_check").when(F.col("column_index").isNull(), "no_explicit_total_row").otherwise(_verdict())
    judged = each.withColumn("_check", name)
    name = F.col("_check")
    status = F.when(name == "total_match", "passed").when(name == "total_mismatch", "failed").otherwise("skipped")
    severity = F.when(name == "total_mismatch", "error").otherwise("info")
    sums = F.format_string("Column %d: calculated %.2f, extracted %.2f.", F.col("column_index"), F.col("calculated"), F.col("total"))
    message = F.when(empty, "The table has no data.").when(F.col("column_index").isNull(), "The table has no total row.").when(name == "no_valid_data_for_sum", F.format_string("Column %d has no number above the total.", F.col("column_index"))).otherwise(sums)
    return judged.select(*finding("numeric_consistency", name, status, severity, F.col("id"), message, column_index=F.col("column_index"), calculated_sum=F.col("calculated"), purported_total=F.col("total"), valid_data_rows=F.col("valid_rows"), difference=F.abs(F.col("total") - F.col("calculated")), tolerance=F.lit(TOLERANCE), invalid_cells=F.to_json("invalid_cells")))
