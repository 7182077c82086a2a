"""Inputs of the registered queries: document tables derived from the test tables.

Each is SQL that Spark and the oracle both read, with {table} for a table, so that both sides start from equal rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "conversations")

#: Page signals, one page for each order.
SIGNALS = """
select cast(o_custkey as string) as document_id, cast(o_orderkey as int) as page_number,
  case when o_orderkey % 97 = 0 then 0e0 else 612e0 end as width, 792e0 as height,
  case when o_orderkey % 5 = 0 then 0 else (o_orderkey * 37) % 311 end as text_length,
  (case when o_orderkey % 5 = 0 then 0 else (o_orderkey * 37) % 311 end) * (o_orderkey % 4) / 1e4 as text_density,
  o_orderkey % 3 as image_count,
  case when o_orderkey % 3 = 0 then ((o_orderkey * 13) % 11) / 1e1 else 0e0 end as image_area_ratio,
  (o_orderkey * 7) % 25 as drawing_count,
  case when o_orderkey % 4 = 0 then ((o_orderkey * 17) % 21) / 2e1 else 1e-1 end as table_candidate_score
from {orders}"""

#: Text with line ends, control characters and blanks to clean.
NOISY = """
select doc_id, '  ' || replace(text, ' ', '   ') || chr(13) || chr(10) || chr(9) || chr(1) || 'x' || chr(9) || ' y ' || chr(13) || ' z' as text
from {documents}"""

HORIZONTAL = """
select cast(o_custkey - o_custkey % 8 as string) as document_id, cast(o_orderkey % 3 as int) as page_number,
  (o_orderkey % 3) * 1e1 as x1, 2e2 + (o_orderkey % 5) * 5e1 as x2, (o_orderkey % 7) * 5e1 as y
from {orders} where o_orderkey % 2 = 0"""

VERTICAL = """
select cast(o_custkey - o_custkey % 8 as string) as document_id, cast(o_orderkey % 3 as int) as page_number,
  (o_orderkey % 9) * 4e1 as x, (o_orderkey % 4) * 2e1 as y1, 15e1 + (o_orderkey % 6) * 4e1 as y2
from {orders} where o_orderkey % 2 = 1"""

CHARTS = """
select cast(o_custkey as string) as document_id, cast(o_orderkey % 6 as int) as page_number, cast(o_orderkey as int) as chart_index
from {orders} where o_orderkey % 5 < 2"""

#: The orders that are no charts.
PAGE_TABLES = """
select 't' || cast(o_orderkey as string) as id, cast(o_custkey as string) as document_id, cast(o_orderkey % 6 as int) as page_number, cast(o_orderkey as int) as table_index,
  cast(o_orderkey % 7 + 1 as int) as row_count, cast(o_orderkey % 5 + 1 as int) as column_count
from {orders} where o_orderkey % 5 >= 2"""

#: Cells in many spellings of numbers.
CELLS = """
select o_orderkey, case cast(o_orderkey % 12 as int)
  when 0 then '$' || cast(cast(o_totalprice as decimal(18,2)) as string) when 1 then '(' || cast(o_custkey as string) || ')' when 2 then cast(o_custkey as string) || '%'
  when 3 then '1,' || cast(100 + o_custkey % 900 as string) when 4 then '$(5)' when 5 then '1 234' when 6 then 'abc' when 7 then ''
  when 8 then ' -' || cast(o_custkey as string) || '.25 ' when 9 then '1e3' when 10 then '12d' else '(7)%' end as cell
from {orders}"""

FINDINGS = """
select cast(user_id as string) as document_id, cast(event_id as string) as id, ts as created_at,
  case event_type when 'click' then 'passed' when 'view' then 'passed' when 'signup' then 'skipped' when 'error' then 'failed' else 'error' end as status,
  case when event_id % 300 = 0 then 'critical' when event_id % 10 < 1 then 'error' else 'info' end as severity
from {events}"""

TEXTS = """
select cast(user_id as string) as document_id, cast(event_id as string) as id,
  case when event_id % 2 = 0 then 'ocr_tesseract' else 'native_pdf' end as extraction_method, case when event_id % 6 = 0 then null else (event_id % 9) / 8e0 end as confidence
from {events} where event_type = 'view'"""

EVENT_TABLES = "select cast(user_id as string) as document_id, cast(event_id as string) as id from {events} where event_type = 'click'"

#: The events that are neither texts nor tables.
EVENT_CHARTS = "select cast(user_id as string) as document_id, cast(event_id as string) as id from {events} where event_type not in ('view', 'click')"

RUNS = """
select cast(event_id as string) as id, cast(user_id as string) as document_id, ts as created_at,
  case when event_type = 'error' then 'failed' when event_type = 'view' then 'validating' else 'completed' end as status, 'h' || cast(event_id % 5 as string) as input_hash
from {events}"""

WANTED = "select distinct cast(user_id as string) as document_id, 'h' || cast(user_id % 5 as string) as input_hash from {events}"

STAGES = """
select cast(user_id as string) as document_id, ts as at_time,
  case event_type when 'click' then 'analyzing' when 'view' then 'analyzed' when 'signup' then 'extracting' when 'error' then 'extraction_failed' else 'structured' end as status
from {events}"""


#: Characters of a line and lines of a page of the PDF that a document is printed to.
PRINTED_LINE, PRINTED_LINES = 80, 50
#: White space and control characters, as they are: neither side has to read an escape.
BLANKS = "".join(f"{chr(a)}-{chr(b)}" for a, b in ((0x01, 0x20), (0x7F, 0xA0), (0x1680, 0x1680), (0x2000, 0x200F), (0x2028, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000), (0xFEFF, 0xFEFF)))
#: Documents as lines of text: white space is one blank.
PRINTED = f"select doc_id, trim(regexp_replace(coalesce(text, ''), '[{BLANKS}]+', ' '{{g}})) as t from {{documents}}"

#: Each order as a ruled table of its lines.
RULED = """
select l_orderkey, l_linenumber, cast(l_partkey as string) as part, cast(cast(l_quantity as int) as string) as quantity, cast(cast(l_extendedprice as decimal(18,2)) as string) as price
from {lineitem}"""


def frame(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """The rows of one of these inputs."""
    sql = sql.replace("{g}", "")
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f"{{{t}}}" in sql}
    return spark.sql(sql, **used)


def plain(sql: str) -> str:
    """The same SQL over tables by name; where Spark replaces all matches unasked, it is told to."""
    sql = sql.replace("{g}", ", 'g'")
    for t in TABLES:
        sql = sql.replace(f"{{{t}}}", t)
    return sql
