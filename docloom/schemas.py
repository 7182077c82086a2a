"""Schemas of the tables that the operators read and write."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_s, _i, _l, _d, _ts = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.TimestampType()


def _table(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


RAW_FILE = _table(original_filename=_s, content_type=_s, content=T.BinaryType())
DOCUMENT = _table(
    id=_s, original_filename=_s, content_type=_s, file_size=_l, checksum_sha256=_s, source_type=_s, source_identifier=_s, subsidiary=_s, document_timestamp=_ts, storage_reference=_s, status=_s, ingested_at=_ts
)
PAGE_SIGNALS = _table(
    document_id=_s, page_number=_i, width=_d, height=_d, text_length=_l, text_density=_d, image_count=_l, image_area_ratio=_d, drawing_count=_l, table_candidate_score=_d, has_extractable_text=T.BooleanType()
)
TEXT_EXTRACTION = _table(document_id=_s, page_number=_i, extraction_method=_s, raw_text=_s, normalized_text=_s, confidence=_d, language=_s)
TABLE_EXTRACTION = _table(
    id=_s, document_id=_s, page_number=_i, table_index=_i, extraction_method=_s, row_count=_i, column_count=_i, table_data=T.ArrayType(T.ArrayType(_s)), extraction_confidence=_d, structure_confidence=_d
)
CHART_ASSOCIATION = _table(
    id=_s, document_id=_s, page_number=_i, chart_index=_i, associated_table_id=_s, association_method=_s, association_confidence=_d, resolution_status=_s
)
VALIDATION_RUN = _table(id=_s, document_id=_s, status=_s, overall_quality_score=_d, final_decision=_s, config_snapshot=_s, input_hash=_s, created_at=_ts, completed_at=_ts)
FINDING = _table(
    document_id=_s, validator=_s, check_name=_s, status=_s, severity=_s, message=_s, page_number=_i, table_reference=_s, details=T.MapType(_s, _s)
)
IMAGE = _table(image_id=_l, height=_i, width=_i, data=T.BinaryType())


def shaped(rows: DataFrame, schema: T.StructType) -> DataFrame:
    """``rows`` with the columns of a table, in its order and types; null where they have none."""
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
