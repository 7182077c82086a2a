"""Inputs of the registered queries take every row of their tables."""

import os

import pytest

from docloom.plans import inputs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.mark.parametrize("table,parts", [("events", ["FINDINGS"]), ("events", ["TEXTS", "EVENT_TABLES", "EVENT_CHARTS"]), ("orders", ["CHARTS", "PAGE_TABLES"])])
def test_every_row_takes_part(spark, table, parts):
    counts = [inputs.frame(spark, SF, getattr(inputs, p)).count() for p in parts]
    assert all(counts) and sum(counts) == spark.read.parquet(f"{SF}/{table}.parquet").count()
