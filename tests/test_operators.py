import hashlib

import pytest
from pyspark.sql import functions as F

from docloom import schemas
from docloom.operators import classify, dedup, findings, quality, routing, store, tables, validation, views

SIGNALS = "text_length long, text_density double, image_count long, image_area_ratio double, drawing_count long, table_candidate_score double, width double, height double"
PAGES = [
    ((1000, 0.002, 0, 0.0, 5, 0.1, 612.0, 792.0), "typed_text", None),
    ((0, 0.0, 1, 0.8, 0, 0.1, 612.0, 792.0), "scanned_document", 1.0),
    ((50, 0.0001, 0, 0.0, 20, 0.7, 612.0, 792.0), "table_dense", 0.85),
    ((30, 0.00005, 0, 0.1, 12, 0.2, 612.0, 792.0), "chart_graph", 0.60),
    ((25, 0.00004, 1, 0.5, 8, 0.1, 612.0, 792.0), "map_diagram", 0.661),
    ((300, 0.0005, 1, 0.2, 10, 0.4, 612.0, 792.0), "mixed", 0.4624),
    ((0, 0.0, 0, 0.0, 0, 0.0, 0.0, 0.0), "unknown", 0.0),
]


def test_classes(spark):
    got = classify.classify(spark.createDataFrame([(i, *p[0]) for i, p in enumerate(PAGES)], f"i int, {SIGNALS}")).orderBy("i").collect()
    assert [r.classification for r in got] == [p[1] for p in PAGES]
    for r, (_, _, confidence) in zip(got, PAGES):
        assert 0 <= r.classification_confidence <= 1 and (confidence is None or r.classification_confidence == pytest.approx(confidence, abs=1e-3))


@pytest.mark.parametrize("score, name", [(0.5, "table_dense"), (0.4999, "mixed")])
def test_boundary(spark, score, name):
    assert classify.classify(spark.createDataFrame([(300, 0.0001, 0, 0.2, 0, score, 612.0, 792.0)], SIGNALS)).first().classification == name


def test_routes(spark):
    df = spark.createDataFrame([(c,) for c in ("table_dense", "mixed", "scanned_document", "typed_text", "chart_graph", "map_diagram", "unknown", "TYPED_TEXT", None)], "c string")
    got = df.select(routing.should_extract_tables(F.col("c")).alias("t"), routing.profile(F.col("c")).alias("p")).collect()
    assert [r.t for r in got] == [True] * 3 + [False] * 6
    assert [r.p for r in got][-3:] == ["none", "light", "none"]
    assert df.limit(1).select(routing.chart_route(F.lit("complex picture"), F.lit(0.9))).first()[0] == "VISUAL_NUMERIC_EXTRACTION"
    assert df.limit(1).select(routing.chart_route(F.lit("plain"), F.lit(0.9))).first()[0] == "TABLE_BACKED_CHART"


NO_STORE = "id string, checksum_sha256 string"


def test_dedup(spark):
    files = spark.createDataFrame([("a.txt", "text/plain", b"x"), ("b.txt", "text/plain", b"x"), ("c.txt", "text/plain", b"y"), ("d.txt", None, b"z"), ("e.txt", "text/plain", b"")], schemas.RAW_FILE)
    results, rows, blobs = dedup.ingest(files, spark.createDataFrame([], NO_STORE), "upload")
    got = {r.original_filename: (r.document_id, r.is_duplicate) for r in results.collect()}
    assert set(got) == {"a.txt", "b.txt", "c.txt"} and got["a.txt"][0] == got["b.txt"][0] != got["c.txt"][0]
    assert [got[k][1] for k in sorted(got)] == [False, True, False] and rows.count() == 2 == blobs.count()
    again, fresh, contents = dedup.ingest(files, rows.select("id", "checksum_sha256"), "upload")
    assert again.filter("not is_duplicate").count() == 0 == fresh.count() == contents.count()


def test_same_file_twice_in_a_batch(spark):
    """Equal in name and content, alone and among others, and with other columns: one of each content is new."""
    rows = [("a.txt", "text/plain", b"x", "one")] * 3 + [("a.txt", "text/plain", b"x", "two"), ("b.txt", "text/plain", b"x", "one"), ("c.txt", "text/plain", b"y", None), ("c.txt", "text/plain", b"y", None)]
    files = spark.createDataFrame(rows, "original_filename string, content_type string, content binary, sender string").repartition(3)
    results, documents, _ = dedup.ingest(files, spark.createDataFrame([], NO_STORE), "upload")
    got = results.collect()
    assert len(got) == 7 and sum(not r.is_duplicate for r in got) == 2 == documents.count()
    assert {(r.canonical.original_filename, r.checksum_sha256) for r in got} == {(r.original_filename, r.checksum_sha256) for r in got if not r.is_duplicate}


def test_duplicate_returns_what_the_store_has(spark):
    files = spark.createDataFrame([("new.txt", "text/plain", b"x")], schemas.RAW_FILE)
    sha = dedup.fingerprint(files).first().checksum_sha256
    known = spark.createDataFrame([("id-1", sha, "first.txt", "text/html")], "id string, checksum_sha256 string, original_filename string, content_type string")
    r = dedup.ingest(files, known, "upload").results.first()
    assert (r.document_id, r.is_duplicate, tuple(r.canonical)) == ("id-1", True, ("first.txt", "text/html"))


def test_blobs(spark, tmp_path):
    files = spark.createDataFrame([("a", "t", b"x"), ("b", "t", b"y"), ("c", "t", b"x")], schemas.RAW_FILE)
    _, documents, blobs = dedup.ingest(files, spark.createDataFrame([], NO_STORE), "upload")
    kept = store.Blobs(spark, str(tmp_path))
    kept.put(blobs, "1")
    kept.put(blobs, "1")
    got = documents.join(kept.get(documents), "storage_reference").collect()
    assert sorted((r.original_filename, bytes(r.content)) for r in got) == [("a", b"x"), ("b", b"y")]
    gone = documents.filter("original_filename = 'a'")
    kept.delete(gone, "2")
    assert {r.original_filename: r.stored for r in kept.exists(documents).collect()} == {"a": False, "b": True}
    kept.put(blobs, "3")
    assert kept.get(gone).count() == 1


def test_input_hash_ignores_order(spark):
    parts = [("d", "text", "a"), ("d", "table", "b"), ("d", "chart", None)]
    one, two = (dedup.input_hash(spark.createDataFrame(p, "document_id string, kind string, value string")).first().input_hash for p in (parts, parts[::-1]))
    assert one == two and len(one) == 64


TABLES = [
    ("clean", [["Fruit", "Colour"], ["pear", "green"], ["Total", "100"]], 3, 2),
    ("uneven", [["A", "B"], ["C", "D", "E"]], 2, 2),
    ("empty", [], 0, 0),
    ("blank", [["A", "B"], ["", ""], ["C", "D"]], 3, 2),
    ("no_total", [["A", "10"], ["B", "20"]], 2, 2),
    ("match", [["pears", "10"], ["plums", "20"], ["Total", "30"]], 3, 2),
    ("mismatch", [["pears", "10"], ["plums", "20"], ["Total", "40"]], 3, 2),
    ("column", [["A", "", "1"], ["B", None, "2"]], 2, 3),
    ("header", [["Name", "Qty"], ["1", "2"], ["3", "4"]], 3, 2),
]


@pytest.fixture(scope="module")
def table_rows(spark):
    rows = [(i, "d", 1, 0, "grid", n, c, data, 0.5, 0.5) for i, data, n, c in TABLES]
    return spark.createDataFrame(rows, "id string, document_id string, page_number int, table_index int, extraction_method string, row_count int, column_count int, table_data array<array<string>>, extraction_confidence double, structure_confidence double")


def checks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.table_reference, set()).add((r.check_name, r.status))
    return out


def test_structure(table_rows):
    got = checks(findings.table_structure(table_rows))
    assert "clean" not in got and "no_total" not in got
    assert got["uneven"] == {("inconsistent_row_width", "failed")}
    assert got["empty"] == {("empty_table", "failed")}
    assert got["blank"] == {("empty_rows_detected", "passed")}
    assert got["column"] == {("empty_columns_detected", "passed")}
    assert got["header"] == {("header_row_detected", "passed")}


def test_numeric(table_rows):
    got = checks(findings.numeric_consistency(table_rows))
    assert got["empty"] == {("no_data_for_numeric_check", "skipped")}
    assert got["no_total"] == {("no_explicit_total_row", "skipped")}
    assert got["match"] == {("total_match", "passed")}
    assert got["mismatch"] == {("total_mismatch", "failed")}
    assert got["clean"] == {("no_valid_data_for_sum", "skipped")}


def test_schema(spark, table_rows):
    got = checks(findings.table_schema(table_rows))
    assert set(got) == {"uneven", "empty", "column"}
    texts = spark.createDataFrame([("d", 0, 0.5), ("d", 1, 1.5), ("d", 1, None)], "document_id string, page_number int, confidence double")
    assert sorted(r.check_name for r in findings.text_schema(texts).collect()) == ["text_extraction_confidence", "text_extraction_page_number"]
    charts = spark.createDataFrame([("c", "d", 1, 0, 0.5, "invalid_status"), ("e", "d", 1, 0, 0.5, "partial"), ("f", "d", 1, 0, None, "partial")], "id string, document_id string, page_number int, chart_index int, association_confidence double, resolution_status string")
    assert sorted(r.check_name for r in findings.chart_schema(charts).collect()) == ["chart_association_association_confidence", "chart_association_resolution_status"]


@pytest.mark.parametrize(
    "column, total, check",
    [(["1e40", "1e40"], "2e40", "match"), (["1e40"], "1", "mismatch"), (["inf"], "1", "mismatch"), (["nan", "1"], "1", "mismatch"), (["0.00004"] * 1000, "0.04", "match"), (["0.1", "0.2"], "0.31", "match"), (["0.1", "0.2"], "0.32", "mismatch"), (["x", "2", ""], "2", "match")],
)
def test_odd_totals(spark, column, total, check):
    data = [["thing", v] for v in column] + [["Sum of all", total]]
    row = spark.createDataFrame([("t", "d", 1, len(data), 2, data)], "id string, document_id string, page_number int, row_count int, column_count int, table_data array<array<string>>")
    r = findings.total_checks(row).first()
    assert r.check_name == f"total_{check}"
    assert [c.row_index for c in r.invalid_cells] == [i for i, v in enumerate(column) if v in ("x", "")]
    f = findings.numeric_consistency(row).first()
    assert f.message and f.details["valid_data_rows"] == str(len(column) - len(r.invalid_cells))


def test_charts_take_tables_of_real_pages(spark):
    charts = spark.createDataFrame([("d", p, 0) for p in (0, 1, 2, 5)], "document_id string, page_number int, chart_index int")
    tables_ = spark.createDataFrame([("d", "t0", 0, 9, 9, 0), ("d", "t3", 3, 1, 1, 0), ("d", "t3b", 3, 2, 2, 1)], "document_id string, id string, page_number int, row_count int, column_count int, table_index int")
    got = {r.page_number: (r.associated_table_id, r.association_method) for r in tables.associate_charts(charts, tables_).collect()}
    assert got == {0: ("t0", "same_page_table"), 1: (None, "no_matching_table_found"), 2: ("t3b", "adjacent_page_table"), 5: (None, "no_matching_table_found")}


def assess(spark, texts=(), tables_=0, found=()):
    t = spark.createDataFrame([("d", m, c) for m, c in texts], "document_id string, extraction_method string, confidence double")
    b = spark.createDataFrame([("d",)] * tables_, "document_id string")
    f = spark.createDataFrame([("d", s, v) for s, v in found], "document_id string, status string, severity string")
    return quality.assess(t, b, spark.createDataFrame([], "document_id string"), f).first()


def test_quality(spark):
    assert assess(spark, [("native_pdf", None)]).ocr == 50
    assert assess(spark, [("ocr_tesseract", 0.8), ("OCR", 0.9), ("ocr", None)]).ocr == pytest.approx(85)
    r = assess(spark, [("x", None)], 2, [("passed", "info"), ("failed", "info"), ("passed", "info"), ("skipped", "info")])
    assert (r.validation, r.structure, r.completeness) == (pytest.approx(66.6667, abs=1e-3), 75, 90)
    assert 0 <= r.overall <= 100


@pytest.mark.parametrize("score, fatal, wrong, want", [(90.0, False, False, "approved"), (70.0, False, False, "flagged"), (90.0, True, False, "failed"), (90.0, False, True, "flagged")])
def test_decisions(spark, score, fatal, wrong, want):
    assert spark.range(1).select(quality.decide(F.lit(score), F.lit(fatal), F.lit(wrong))).first()[0] == want


def test_grid(spark):
    h = spark.createDataFrame([("d", 1, 0.0, 10.0, y) for y in (0.0, 5.0, 10.0)], "document_id string, page_number int, x1 double, x2 double, y double")
    v = spark.createDataFrame([("d", 1, x, 0.0, 10.0) for x in (0.0, 10.0)], "document_id string, page_number int, x double, y1 double, y2 double")
    grid = tables.grids(tables.intersections(h, v))
    r = grid.first()
    assert (r.row_count, r.column_count, r.structure_confidence) == (2, 1, 0.06)
    assert tables.cells(grid).count() == 2


def test_store(spark, tmp_path):
    s = store.Store(spark, str(tmp_path))
    one = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "document_id string, n int")
    s.append("pages", one, "2024-01-01")
    s.append("pages", one.filter("document_id = 'a' and n = 2"), "2024-01-02")
    assert sorted((r.document_id, r.n) for r in s.current("pages").collect()) == [("a", 2), ("b", 1)]
    assert s.by_id("pages", "not-an-id").count() == 0 and s.exists("pages")
    # a version without rows replaces by nothing, and rows that no manifest names are not seen
    s.append("pages", one.limit(0), "2024-01-03", one.filter("document_id = 'a'").select("document_id"))
    one.withColumn("_version", F.lit("2024-01-04")).write.mode("append").parquet(s.path("pages"))
    assert [(r.document_id, r.n) for r in s.current("pages").collect()] == [("b", 1)]
    s.delete("pages")
    assert not s.exists("pages")


def test_validate(spark):
    """The whole of it, twice: what has not changed is not validated again."""
    documents = spark.createDataFrame([("good", "a", "structured"), ("bad", "b", "structured"), ("bare", "c", "ingested")], "id string, checksum_sha256 string, status string")
    texts = spark.createDataFrame([("good", 1, "ocr_tesseract", 1.0), ("good", 2, "ocr_tesseract", 1.0), ("bad", 0, "native_pdf", None), ("stranger", 1, "x", 0.5)], "document_id string, page_number int, extraction_method string, confidence double")
    kinds = "id string, document_id string, page_number int, table_index int, row_count int, column_count int, table_data array<array<string>>, extraction_confidence double, structure_confidence double"
    tables_ = spark.createDataFrame([("t", "good", 1, 0, 3, 2, [["pears", "10"], ["plums", "20"], ["Total", "30"]], 0.5, 0.5), ("u", "bad", 1, 0, 2, 2, [["pears", "10"], ["Total", "11"]], 0.5, 0.5)], kinds)
    charts = spark.createDataFrame([], "id string, document_id string, page_number int, chart_index int, association_confidence double, resolution_status string")
    runs, found = validation.validate(documents, texts, tables_, charts, F.lit("2024-01-01 00:00:00"))
    got = {r.document_id: r for r in runs.collect()}
    assert {k: (r.final_decision, r.overall_quality_score) for k, r in got.items()} == {"good": ("approved", 94.0), "bad": ("flagged", 33.0), "bare": ("flagged", 45.0)}
    assert {(r.document_id, r.check_name, r.validation_run_id) for r in found.collect()} == {("good", "total_match", got["good"].id), ("bad", "total_mismatch", got["bad"].id), ("bad", "text_extraction_page_number", got["bad"].id)}
    again, _ = validation.validate(documents, texts.filter("document_id != 'bad'"), tables_, charts, F.lit("2024-01-02 00:00:00"), runs)
    assert [r.document_id for r in again.collect()] == ["bad"]
    assert validation.validate(documents, texts, tables_, charts, F.lit("2024-01-02 00:00:00"), runs, force=True)[0].count() == 3


def test_breakdown(spark):
    t = spark.createDataFrame([("d", "ocr", 0.8)], "document_id string, extraction_method string, confidence double")
    none = spark.createDataFrame([], "document_id string, status string, severity string")
    r = quality.assess(t, none, none, none, explained=True).first()
    assert tuple(r.breakdown["ocr"]) == (80.0, 0.3, 24.0, True) and not r.breakdown["validation"].available and r.breakdown["completeness"].score == 30


def test_views(spark):
    rows = spark.createDataFrame([("a", 2, "0.5"), ("a", 1, "?"), ("b", 1, None)], "document_id string, page_number int, classification_confidence string")
    got = [(r.page_number, r.classification_confidence) for r in views.pages(views.of(rows.withColumn("document_id", F.sha2("document_id", 256)), hashlib.sha256(b"a").hexdigest())).collect()]
    assert got == [(1, None), (2, 0.5)] and views.of(rows, "no id").count() == 0
    documents = spark.createDataFrame([("x", "n", 3, "secret")], "id string, original_filename string, file_size long, other string")
    assert views.documents(documents).columns == ["id", "original_filename", "file_size"]


def test_regions_and_embeddings(spark):
    df = spark.createDataFrame([("visual", 0), ("table_preserving", 0), ("table_preserving", 2), ("light", 0), (None, None)], "p string, n int")
    got = df.select(routing.wants_regions(F.col("p")), routing.wants_embedding(F.col("p"), F.col("n"))).collect()
    assert [tuple(r) for r in got] == [(True, True), (True, False), (True, True), (False, False), (False, False)]
