"""Ruled tables of equal pictures: searched once, texts found in their own row; tokens and columns of their files."""

import random

import pyarrow as pa
from pyspark.sql import functions as F

from docloom.functions import frames
from docloom.operators import images, tables
from docloom.plans import catalogue
from docloom.sources import files, pdf


def test_texts_of_a_row_are_those_of_joined_tables(spark):
    rng = random.Random(5)
    place = lambda: rng.choice([None, float("nan"), rng.uniform(-5, 65), 10.0, 30.0])
    rows = []
    for i in range(40):
        spans = [(place(), place(), rng.choice([8.0, 0.0, None]), rng.choice(["a", "b", "", "ç d", None])) for _ in range(rng.randrange(25))]
        rows.append((str(i), 1, sorted(map(float, rng.sample(range(0, 60, 5), rng.randint(2, 6)))), sorted(map(float, rng.sample(range(0, 60, 5), rng.randint(2, 6)))), spans if i else None))
    pages = spark.createDataFrame(rows, "document_id string, page_number int, xs array<double>, ys array<double>, spans array<struct<x:double,y:double,size:double,text:string>>")
    grid = pages.drop("spans").withColumns({"row_count": F.size("ys") - 1, "column_count": F.size("xs") - 1})
    spans = pages.select("document_id", "page_number", F.explode("spans").alias("s")).select("document_id", "page_number", "s.*")
    want = {r.document_id: (r.table_data, r.extraction_confidence) for r in tables.filled(grid, tables.texts_in(grid, spans)).collect()}
    got = {r.document_id: (r.table_data, r.extraction_confidence) for r in tables.with_texts(pages).collect()}
    assert got == want and len(got) == 40 and any(c for _, c in got.values())


def test_ruled_tables_of_one_form_are_one_picture(spark, tmp_path):
    rng = random.Random(6)
    lines = [(o, k + 1, rng.randrange(1000), 1.0 * rng.randrange(1, 50), rng.randrange(10**5) / 100) for o in range(60) for k in range(1 + o % 3)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    wanted = ["document_id", "page_number", "width", "height", "drawings", "spans", "error"]
    layouts = files.layouts(catalogue.ruled(spark, str(tmp_path)), columns=wanted)
    assert sorted(layouts.columns) == sorted(wanted)
    rows, pictures = images.different(layouts)
    assert pictures.count() == 3 and rows.count() == 60 and pictures.groupBy().sum("n").first()[0] == 60
    found = {r.document_id: (r.across, r.down) for r in catalogue.ruled_segments(spark, str(tmp_path)).collect()}
    assert found == {str(o): (3 + o % 3, 4) for o in range(60)}
    got = {r.document_id: r.cells for r in catalogue.page_tables(spark, str(tmp_path)).collect()}
    assert got == {str(o): ";".join(["Item|Quantity|Price", *(f"{p}|{int(q)}|{e:.2f}" for a, _, p, q, e in lines if a == o)]) for o in range(60)}


def test_repeated_pages_stay_repeated(spark):
    kind = "struct<kind:string,x:double,y:double,x2:double,y2:double,path:int,fill:boolean,level:int>"
    box = [("rect", 10.0, 10.0, 90.0, 50.0, 0, False, 0)]
    rows = [("a", 1, 100.0, 60.0, box, [(20.0, 30.0, 8.0, "x")], None)] * 2 + [("b", 1, 100.0, 60.0, box, None, None), ("c", 1, 100.0, 60.0, [], [], None), ("d", 1, None, None, None, None, "broken"), ("e", 1, 0.0, 60.0, [], [], None)]
    layouts = spark.createDataFrame(rows, f"document_id string, page_number int, width double, height double, drawings array<{kind}>, spans array<struct<x:double,y:double,size:double,text:string>>, error string")
    got = sorted((r.document_id, r.table_data, r.extraction_confidence, (r.error or "")[:10]) for r in images.page_tables(layouts).collect())
    assert got == [("a", [["x"]], 1.0, ""), ("a", [["x"]], 1.0, ""), ("b", [[""]], 0.0, ""), ("d", None, None, "broken"), ("e", None, None, "ValueError")]


def test_tokens():
    lexer = pdf.Lexer(b"1 -2 +3 4. .5 -.5 1.5.2 --6 7a /N /A#20B /a.b <41 4> <414> <> <</K[1 2 0 R]>> (a(b)\\051) true null T* ' % no\n \"x }", 0)
    out = []
    while (v := lexer.value()) is not None:
        out.append((type(v).__name__, v))
    assert out == [
        ("int", 1), ("int", -2), ("int", 3), ("float", 4.0), ("float", 0.5), ("float", -0.5), ("float", 1.5), ("float", 6.0), ("float", 7.0), ("Name", "N"), ("Name", "A B"), ("Name", "a.b"), ("bytes", b"A@"), ("bytes", b"A@"), ("bytes", b""),
        ("dict", {"K": [1, (2, 0)]}), ("bytes", b"a(b))"), ("bool", True), ("bool", False), ("Word", b"T*"), ("Word", b"'"), ("Word", b'"x'), ("Word", b"}"),
    ]


def test_lists_of_structs_by_columns():
    kind = pa.list_(pa.struct([("a", pa.float64()), ("b", pa.string()), ("c", pa.int32())]))
    values = [[(1, "x", 2), (2.5, "y")], None, [], [(None, None, 3)]]
    column = frames.nested(values, kind)
    batch = pa.RecordBatch.from_arrays([column, pa.array([1, 2, 3, None])], ["v", "n"])
    assert frames.records(batch) == batch.to_pylist() and frames.records(batch.slice(1)) == batch.slice(1).to_pylist()
    assert batch.to_pylist()[0] == {"v": [{"a": 1.0, "b": "x", "c": 2}, {"a": 2.5, "b": "y", "c": None}], "n": 1} and batch["v"].to_pylist()[1:3] == [None, []]
    assert frames.nested([None, []], kind).to_pylist() == [None, []] and frames.nested([], kind).to_pylist() == []
    odd = pa.RecordBatch.from_arrays([pa.array([[None, {"a": 1.0}], []], kind)], ["v"])
    assert frames.records(odd) == odd.to_pylist()
