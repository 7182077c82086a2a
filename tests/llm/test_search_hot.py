"""Search inside a group of nearly equal vectors."""

import numpy as np
from pyspark.sql import functions as F

from docloom.llm import additive


def test_hot_group_is_searched_exactly(spark):
    """Two thirds of the rows are one direction and little noise; 400 candidates by codes miss some of their neighbours."""
    rng = np.random.default_rng(17)
    x = rng.normal(size=(12_000, 64))
    hot = np.arange(12_000) % 3 < 2
    x[hot] = x[0] / np.linalg.norm(x[0]) + rng.normal(size=(8000, 64)) * 0.05
    x = x.astype(np.float32).astype(float)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4)
    got = {}
    for r in additive.search(df, F.col("vec_id") % 150 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert len(got) == 80
    for q, found in got.items():
        s = unit @ unit[q]
        s[q] = -2
        assert found == set(np.argsort(-s)[:5].tolist()), q


def test_the_copies_of_the_grid_do_not_go_to_the_driver(spark, monkeypatch):
    """The blocks of queries are small before they are copied for each column of the grid, and Spark would send all copies through the driver."""
    plans, staged = {}, additive.staged
    monkeypatch.setattr(additive, "staged", lambda df, name: plans.update({name: df._jdf.queryExecution().executedPlan().toString()}) or staged(df, name))
    rng = np.random.default_rng(5)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 8)))], "vec_id long, embedding array<double>")
    assert additive.search(df, F.col("vec_id") % 50 == 0).count() == 30
    assert "SortMergeJoin [across" in plans["near"] and "Broadcast" not in plans["near"]
