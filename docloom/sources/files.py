"""Files as rows, and their pages by adapters."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from docloom.functions.frames import BYTES_AT_ONCE, nested, portions
from docloom.sources import pdf

#: Pages that a task holds before it gives them out, unless they are ``BYTES_AT_ONCE`` before; bytes of a drawing, span or image as a Python object, about.
PAGES_AT_ONCE, ITEM_BYTES = 256, 512
#: Content types by the end of a name.
TYPES = {"pdf": "application/pdf", "txt": "text/plain", "html": "text/html", "htm": "text/html", "json": "application/json", "csv": "text/csv", "png": "image/png", "jpg": "image/jpeg"}

#: An adapter yields the texts of a file's pages, or for a page that can not be read the exception it met; what it raises itself is the file's fault.
Adapter = Callable[[bytes], Iterable[str | None | Exception]]
#: One that yields, for each page, a dict of width, height, text, images (width, height), drawings (kind, x, y, and where they are known x2, y2, path, fill, level) and spans (x, y,
#: size, text), or the exception it met.
LayoutAdapter = Callable[[bytes], Iterable[dict | Exception]]
#: An OCR engine: the tokens of a picture (its bytes) with their confidences, 0 to 100, negative for none.
OcrAdapter = Callable[[bytes], Iterable[tuple[str, float]]]


def content_type(name: Column) -> Column:
    types = F.create_map(*(F.lit(x) for pair in TYPES.items() for x in pair))
    return F.coalesce(types[F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)$", 1))], F.lit("application/octet-stream"))


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(original_filename, content_type, content, source_identifier, document_timestamp) of the files under a path of any Hadoop file system."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.select(name.alias("original_filename"), content_type(name).alias("content_type"), "content", F.col("path").alias("source_identifier"), F.col("modificationTime").alias("document_timestamp"))


def with_timestamp(files: DataFrame, said_: str) -> DataFrame:
    """Add document_timestamp, of an ISO 8601 time in a column (a date alone, with or without a zone), and timestamp_error where it is none; null stays null."""
    given = F.trim(F.col(said_))
    iso = given.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?(Z|[+-]\d{2}:?\d{2})?)?$")
    time = F.when(iso, given.try_cast("timestamp"))
    return files.withColumn("document_timestamp", time).withColumn("timestamp_error", F.when(given.isNotNull() & time.isNull(), F.concat(F.lit("no ISO time: "), given)))


def text_pages(data: bytes) -> list[str | None]:
    """Pages of a plain text, at form feeds."""
    return data.decode("utf-8", "replace").split("\f")


ADAPTERS: dict[str, Adapter] = {"text/plain": text_pages, "application/pdf": pdf.texts}
LAYOUTS: dict[str, LayoutAdapter] = {"application/pdf": pdf.layouts}
DRAWING, SPAN = ("kind", "x", "y", "x2", "y2", "path", "fill", "level"), ("x", "y", "size", "text")
PAGE = "document_id string, page_number int, raw_text string, text_length long, error string"
LAYOUT = "document_id string, page_number int, width double, height double, text string, images array<struct<width:double,height:double>>, drawings array<struct<kind:string,x:double,y:double,x2:double,y2:double,path:int,fill:boolean,level:int>>, spans array<struct<x:double,y:double,size:double,text:string>>, error string"


def said(e: Exception) -> str:
    return f"{type(e).__name__}: {e}"[:500]


def held(row: dict) -> int:
    """About the bytes of a page's row as Python objects."""
    return sum(len(v) if isinstance(v, str) else ITEM_BYTES * len(v) for v in row.values() if isinstance(v, (str, list)))


def _read(files: DataFrame, adapters: dict, row: Callable, schema: T.StructType) -> DataFrame:
    """A row for each page that an adapter yields, its lists as tuples; faults of pages and files are rows with an error."""
    kinds = to_arrow_schema(schema)

    def column(values: list, kind: pa.DataType) -> pa.Array:
        return nested(values, kind) if pa.types.is_list(kind) else pa.array(values, kind)

    def of(document_id: str, kind: str, data: bytes) -> Iterator[dict]:
        try:
            for i, page in enumerate(adapters[kind](bytes(data)), 1):
                found = {"error": said(page)} if isinstance(page, Exception) else row(page)
                yield {"document_id": document_id, "page_number": i, **found}
        except Exception as e:  # noqa: BLE001  one file's fault is its row's
            yield {"document_id": document_id, "error": said(e)}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given = lambda: pa.RecordBatch.from_arrays([column([r.get(f.name) for r in out], f.type) for f in kinds], schema=kinds)
        out: list[dict] = []
        size = 0
        for part in (p for batch in batches for p in portions(batch)):
            for file in zip(*(part.column(i).to_pylist() for i in range(3))):
                for r in of(*file):
                    out.append(r)
                    size += held(r)
                    if len(out) >= PAGES_AT_ONCE or size >= BYTES_AT_ONCE:
                        yield given()
                        out, size = [], 0
        if out:
            yield given()

    return files.select("document_id", "content_type", "content").mapInArrow(read, schema)


def pages(files: DataFrame, adapters: dict[str, Adapter] | None = None) -> DataFrame:
    """(document_id, page_number, raw_text, text_length, error): a row for each page, numbered from one. A page that can not be read has an error, and the others of
    its file go on; a file that its adapter fails on ends in a row with the error, page null; the other files go on."""
    return _read(files, adapters or ADAPTERS, lambda t: {"raw_text": t, "text_length": len((t or "").strip())}, T.StructType.fromDDL(PAGE))


def layouts(files: DataFrame, adapters: dict[str, LayoutAdapter] | None = None, columns: list[str] | None = None) -> DataFrame:
    """(document_id, page_number, width, height, text, images, drawings, spans, error), or those ``columns`` of it: what ``signals.page_signals`` goes by, a row for each page; errors as in
    ``pages``."""
    schema = T.StructType([f for f in T.StructType.fromDDL(LAYOUT) if columns is None or f.name in columns])
    lists = [f.name for f in schema if isinstance(f.dataType, T.ArrayType)]
    single = [n for n in ("width", "height", "text") if n in schema.names]

    def row(page: dict) -> dict:
        return {n: page[n] if n != "text" else page.get(n) for n in single} | {n: list(page.get(n, [])) for n in lists}

    return _read(files, adapters or LAYOUTS, row, schema)


def ocr(pictures: DataFrame, engine: OcrAdapter | None = None) -> DataFrame:
    """(document_id, page_number, ocr_text, ocr_confidence, words, error) of pictures (document_id, page_number, content): tokens that are not blank, joined
    by a space, and the mean of the confidences above zero, 0 without any. Without an engine every row has an error; a picture that the engine fails on has one, and the others go on."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, means, counts, errors = [], [], [], []
            for data in batch.column(2).to_pylist():
                try:
                    if engine is None:
                        raise RuntimeError("no OCR engine")
                    found = [(t, c) for t, c in engine(bytes(data)) if t and t.strip()]
                    good = [c for _, c in found if c > 0]
                    texts.append(" ".join(t.strip() for t, _ in found))
                    means.append(sum(good) / len(good) if good else 0.0)
                    counts.append(len(found))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001
                    for o, v in zip((texts, means, counts, errors), (None, None, None, said(e))):
                        o.append(v)
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(means, pa.float64()), pa.array(counts, pa.int32()), pa.array(errors, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["document_id", "page_number", "ocr_text", "ocr_confidence", "words", "error"])

    wanted = pictures.select(F.col("document_id").cast("string").alias("document_id"), F.col("page_number").cast("int").alias("page_number"), "content")
    return wanted.mapInArrow(read, "document_id string, page_number int, ocr_text string, ocr_confidence double, words int, error string")
