"""Files as PDF: what is printed is read, and what is damaged stays a row of its own."""

import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.operators import classify, images, signals
from docloom.sources import files, pdf

HEAD = "document_id string, content_type string, content binary"


def by_hand(content, resources="<< /Font << /F1 5 0 R >> >>", extra="", page="/MediaBox [0 0 612 792]", length=None, head=""):
    """A file with a table of wrong places and a wrong length, as people write them."""
    return f"""%PDF-1.4
1 0 obj
<< /Type /Catalog /Pages 2 0 R >>
endobj
2 0 obj
<< /Type /Pages /Kids [3 0 R] /Count 1 >>
endobj
3 0 obj
<< /Type /Page /Parent 2 0 R {page} /Contents 4 0 R /Resources {resources} >>
endobj
4 0 obj
<< /Length {len(content) + 7 if length is None else length} {head}>>
stream
{content}
endstream
endobj
5 0 obj
<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica >>
endobj
{extra}
xref
0 2
0000000000 65535 f
0000000010 00000 n
trailer
<< /Size 6 /Root 1 0 R >>
startxref
403
%%EOF""".encode("latin-1")


TEXT = by_hand("BT\n70 720 TD\n/F1 24 Tf\n(Hello World) Tj\nET")
FILLED = by_hand("0 0 1 rg\n100 100 400 300 re f", "<< >>")
GRID = by_hand(
    "0.5 w % thin\n0 0 0 RG\n" + "\n".join(f"100 {y} m\n500 {y} l S" for y in range(100, 301, 50)) + "\n% down\n" + "\n".join(f"{x} 100 m\n{x} 300 l S" for x in range(100, 501, 100)), "<< >>"
)


def one(data):
    (page,) = pdf.read(data)
    if isinstance(page, Exception):
        raise page
    return page


def test_three_files_make_signals_and_classes(spark):
    """A line of text, a filled rectangle, a ruled grid: the signals by hand."""
    df = spark.createDataFrame([("text", "application/pdf", TEXT), ("filled", "application/pdf", FILLED), ("grid", "application/pdf", GRID), ("none", "application/pdf", b"")], HEAD)
    got = {r.document_id: r for r in classify.classify(signals.page_signals(files.layouts(df))).collect()}
    assert set(got) == {"text", "filled", "grid"}
    t, f, g = got["text"], got["filled"], got["grid"]
    assert (t.width, t.height, t.text_length, t.has_extractable_text, t.drawing_count, t.image_count) == (612, 792, 11, True, 0, 0) and t.text_density == 11 / (612 * 792)
    assert (f.text_length, f.drawing_count, f.has_extractable_text) == (0, 1, False)
    # ten lines, each a path; five places across and five down
    assert (g.drawing_count, g.text_length) == (10, 0) and g.table_candidate_score == pytest.approx(min(10 / (612 * 792) / 0.01, 1) * 0.4 + 0.3)
    assert {r.document_id: r.error is not None for r in files.layouts(df).collect()} == {"text": False, "filled": False, "grid": False, "none": True}
    assert files.pages(df).filter("document_id = 'text'").first().raw_text == "Hello World"


def test_page_table_from_drawings(spark):
    """A grid with texts comes out as cells; a page that can not be drawn is a row with its error."""
    texts = "".join(f"BT /F1 10 Tf {105 + 100 * c} {310 - 50 * r - 45} Td (r{r}c{c}) Tj ET\n" for r in range(4) for c in range(4) if (r, c) != (2, 1))
    grid = "\n".join(f"100 {y} m 500 {y} l S" for y in range(100, 301, 50)) + "\n" + "\n".join(f"{x} 100 m {x} 300 l S" for x in range(100, 501, 100)) + "\n"
    df = spark.createDataFrame([("t", "application/pdf", by_hand(grid + texts)), ("plain", "application/pdf", TEXT), ("huge", "application/pdf", by_hand("", page="/MediaBox [0 0 99999 99999]")), ("none", "application/pdf", b"?")], HEAD)
    got = {r.document_id: r for r in images.page_tables(files.layouts(df)).collect()}
    assert set(got) == {"t", "huge", "none"} and "no picture of" in got["huge"].error and "not a PDF" in got["none"].error
    t = got["t"]
    assert (t.row_count, t.column_count, t.extraction_confidence, t.error) == (4, 4, 1.0, None)
    assert t.table_data == [[f"r{r}c{c}" if (r, c) != (2, 1) else "" for c in range(4)] for r in range(4)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.text(st.characters(exclude_categories=["Cs", "Cc"]), min_size=1, max_size=30), max_size=5), min_size=1, max_size=4), st.booleans())
def test_what_is_printed_is_read(pages, compressed):
    data = pdf.write([{"width": 300, "height": 400, "spans": [(20, 30 + 15 * i, 10, t) for i, t in enumerate(lines)], "lines": [(1, 2, 30, 2)]} for lines in pages], compressed)
    got = list(pdf.read(data))
    assert [p.text for p in got] == ["\n".join(lines) for lines in pages]
    assert all(p.drawings == [("line", 1, 2, 30, 2, 0, False, 0)] and [s[3] for s in p.spans] == lines for p, lines in zip(got, pages))
    # the same without its table of places, with another object that comes later, and cut short behind the objects
    for other in (data.replace(b"startxref", b"startnone"), data.replace(b"xref\n0", b"xref\n9"), data[: data.rindex(b"xref\n0 ")] + b"trailer << /Root 1 0 R >>"):
        assert [p.text for p in pdf.read(other)] == ["\n".join(lines) for lines in pages]


def test_damage_never_escapes():
    """Every kind of damage is an error of the file or of a page, in bounded time."""
    rng = random.Random(5)
    good = [pdf.write([{"width": 100, "height": 100, "lines": [(1, 1, 50, 1)], "spans": [(5, 5, 8, "text of a page")]}] * 3, c) for c in (True, False)] + [TEXT, FILLED, GRID]
    for _ in range(600):
        data = bytearray(rng.choice(good))
        for _ in range(rng.randrange(1, 6)):
            at = rng.randrange(len(data))
            if rng.random() < 0.3:
                del data[at : at + rng.randrange(1, 40)]
            else:
                data[at] = rng.choice(b"\0\xff()<>[]/%0123456789R \n")
            data = data or bytearray(b"x")
        try:
            for p in pdf.read(bytes(data)):
                assert isinstance(p, (pdf.Page, Exception))
        except (ValueError, KeyError, IndexError, TypeError, zlib.error, RecursionError, AttributeError):
            pass


def test_a_damaged_page_is_a_row(spark):
    data = pdf.write([{"width": 100, "height": 100, "spans": [(5, 5, 8, f"page {i}")]} for i in range(3)])
    # the second page's content is no longer what its filter says
    starts = [i for i in range(len(data)) if data[i : i + 7] == b"stream\n" and data[i - 3 : i] != b"end"]
    at = starts[2] + 7
    broken = data[:at] + b"\0\0\0\0" + data[at + 4 :]
    got = files.pages(spark.createDataFrame([("d", "application/pdf", broken)], HEAD)).orderBy("page_number").collect()
    assert [(r.page_number, r.raw_text) for r in got] == [(1, "page 0"), (2, None), (3, "page 2")] and [r.error is None for r in got] == [True, False, True]


def test_text_operators():
    shown = lambda content, **more: one(by_hand(content, **more)).text
    assert shown("BT /F1 10 Tf 14 TL 10 700 Td (a) Tj T* (b) Tj (c) ' 1 2 (d) \" ET") == "a\nb\nc\nd"
    assert shown("BT /F1 10 Tf 10 700 Td [(Wo) 20 (rd) -300 (next) 100 (x)] TJ ET") == "Word nextx"
    assert shown("BT /F1 10 Tf 1 0 0 1 10 700 Tm (left) Tj 1 0 0 1 300 700 Tm (right) Tj 1 0 0 1 10 680 Tm (below) Tj ET") == "left right\nbelow"
    assert shown(r"BT /F1 10 Tf 10 700 Td (a\(b\)\\ \101\n (in) \
c) Tj ET") == "a(b)\\ A\n (in) c"
    assert shown("BT /F1 10 Tf 10 700 Td <48656C6C6F> Tj <4> Tj ET") == "Hello@"
    assert shown("BT /F1 10 Tf 10 700 Td (\x80\xe9\xfc) Tj ET", extra="") == "€éü"
    differences = "5 0 obj\n<< /Type /Font /Subtype /Type1 /Encoding << /Differences [65 /eacute /Scaron 70 /uni4E2D /bullet /germandbls] >> >>\nendobj"
    assert shown("BT /F1 10 Tf 10 700 Td (ABFGH) Tj ET", extra=differences) == "éŠ中•ß"


def test_forms_images_and_turned_pages():
    form = "6 0 obj\n<< /Type /XObject /Subtype /Form /Matrix [2 0 0 2 100 0] /Resources << /Font << /F1 5 0 R >> /XObject << /X 6 0 R >> >> /Length 9 >>\nstream\n10 10 m 20 10 l S BT /F1 5 Tf 10 20 Td (in a form) Tj ET /X Do\nendstream\nendobj\n7 0 obj\n<< /Subtype /Image /Width 2 /Height 2 /Length 4 >>\nstream\n1234\nendstream\nendobj"
    resources = "<< /Font << /F1 5 0 R >> /XObject << /X 6 0 R /I 7 0 R >> >>"
    p = one(by_hand("q 200 0 0 50 30 40 cm /I Do Q q /X Do Q BI /W 1 /H 1 ID \x00 EI 5 5 m 5 9 l S", resources, form))
    assert p.images[0] == (30, 792 - 90, 200, 50) and len(p.images) == 2 and p.drawings[0][:5] == ("line", 120, 772, 140, 772) and p.drawings[-1][:5] == ("line", 5, 787, 5, 783)
    assert p.text.startswith("in a form") and len(p.drawings) == pdf.MOST_FORMS + 1
    turned = one(by_hand("100 100 m 200 100 l S", page="/MediaBox [0 0 612 792] /Rotate 90"))
    assert (turned.width, turned.height) == (792, 612) and turned.drawings[0][1:5] == (100, 100, 100, 200)
    cropped = one(by_hand("100 100 m 200 100 l S", page="/MediaBox [0 0 612 792] /CropBox [50 50 250 150]"))
    assert (cropped.width, cropped.height) == (200, 100) and cropped.drawings[0][1:5] == (50, 50, 150, 50)


def test_object_streams_and_cross_reference_streams():
    """A file of the compact kind, its table coded with predictors."""
    inner = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 200 100] /Contents 5 0 R >>"]
    places, body = [], b""
    for i, x in enumerate(inner, 1):
        places.append(f"{i} {len(body)}")
        body += x + b" "
    head = " ".join(places).encode() + b" "
    packed = zlib.compress(head + body)
    out = b"%PDF-1.5\n"
    at4 = len(out)
    out += b"4 0 obj\n<< /Type /ObjStm /N 3 /First %d /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (len(head), len(packed), packed)
    at5 = len(out)
    out += b"5 0 obj\n<< /Length 6 0 R >>\nstream\n10 10 m 50 10 l S\nendstream\nendobj\n"
    at6 = len(out)
    out += b"6 0 obj\n17\nendobj\n"
    at7 = len(out)
    rows = [(0, 0, 0), (2, 4, 0), (2, 4, 1), (2, 4, 2), (1, at4, 0), (1, at5, 0), (1, at6, 0), (1, at7, 0)]
    raw = [bytes([a]) + b.to_bytes(2) + bytes([c]) for a, b, c in rows]
    coded, before = b"", bytes(4)
    for r in raw:  # each row as its differences from the one above
        coded += b"\2" + bytes((x - y) & 255 for x, y in zip(r, before))
        before = r
    table = zlib.compress(coded)
    out += b"7 0 obj\n<< /Type /XRef /Size 8 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >> /Length %d >>\nstream\n%s\nendstream\nendobj\nstartxref\n%d\n%%%%EOF" % (len(table), table, at7)
    assert one(out).drawings[0][:5] == ("line", 10, 90, 50, 90)
    assert one(out.replace(b"startxref", b"startnone")).drawings[0][:5] == ("line", 10, 90, 50, 90)


def test_later_versions_count_and_encrypted_files_do_not():
    data = pdf.write([{"width": 100, "height": 100}])
    table = data.rindex(b"xref\n0")
    at = len(data)
    newer = b"6 0 obj\n<< /Type /Page /Parent 2 0 R /MediaBox [0 0 300 300] >>\nendobj\n"
    number = int(data[: data.index(b" 0 obj\n<< /Type /Page /Parent")].split()[-1])
    newer = newer.replace(b"6 0 obj", b"%d 0 obj" % number)
    more = newer + b"xref\n%d 1\n%010d 00000 n \ntrailer << /Size 9 /Root 1 0 R /Prev %d >>\nstartxref\n%d\n%%%%EOF" % (number, at, table, at + len(newer))
    assert one(data + more).width == 300
    with pytest.raises(ValueError, match="encrypted"):
        list(pdf.read(data.replace(b"/Root 1 0 R", b"/Root 1 0 R /Encrypt << /V 1 >>")))
