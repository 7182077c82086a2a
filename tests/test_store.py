"""Versions of documents: their order, racing and failed writers, compaction."""

import pytest
from pyspark.sql import functions as F

from docloom.operators import store, tables

KIND = "document_id string, n int"


@pytest.fixture
def kept(spark, tmp_path):
    return store.Store(spark, str(tmp_path))


def now(s):
    return sorted((r.document_id, r.n) for r in s.current("t").collect())


def test_the_tenth_version_is_later_than_the_ninth(spark, kept):
    for i in range(1, 12):
        assert kept.append("t", spark.createDataFrame([("a", i)], KIND), f"v{i}") == i
        assert now(kept) == [("a", i)]


def test_racing_writers_are_told_apart(spark, kept, monkeypatch):
    """Two writers of one label that take the same number at the same moment: one is the later, and each is whole."""
    kept.append("t", spark.createDataFrame([("a", 0), ("b", 0)], KIND), "v")
    rivals = iter([spark.createDataFrame([("a", 1), ("a", 11), ("c", 1)], KIND)])
    own = kept.commits

    def late(name):  # after this writer has seen the numbers, and before it takes one, the rival commits
        seen = own(name)
        if rival := next(rivals, None):
            monkeypatch.setattr(kept, "commits", own)
            kept.append("t", rival, "v")
        return seen

    monkeypatch.setattr(kept, "commits", late)
    number = kept.append("t", spark.createDataFrame([("a", 2)], KIND), "v")
    assert number == 3 and now(kept) == [("a", 2), ("b", 0), ("c", 1)]
    assert [n for n, _ in kept.commits("t")] == [1, 2, 3] and len({v for _, v in kept.commits("t")}) == 3


def test_failed_writers_leave_nothing(spark, kept, monkeypatch):
    kept.append("t", spark.createDataFrame([("a", 0)], KIND))
    for part in ("_listed", "_commit"):
        with monkeypatch.context() as m:
            m.setattr(kept, part, lambda *a: (_ for _ in ()).throw(RuntimeError("gone")))
            with pytest.raises(RuntimeError):
                kept.append("t", spark.createDataFrame([("a", 5), ("b", 5)], KIND))
        assert now(kept) == [("a", 0)]
    # a commit whose writer fell between taking the number and writing its name
    path, fs = store.hadoop_path(spark, kept.path("t") + ".commits/" + "2".zfill(19))
    fs.create(path, False).close()
    assert now(kept) == [("a", 0)] and kept.append("t", spark.createDataFrame([("a", 1)], KIND)) == 3 and now(kept) == [("a", 1)]


def test_compaction(spark, kept):
    for i in range(4):
        kept.append("t", spark.createDataFrame([("a", i), (f"b{i}", i)], KIND), f"v{i}")
    kept.append("t", spark.createDataFrame([], KIND), "gone", spark.createDataFrame([("b0",)], "document_id string"))
    before = now(kept)
    kept.compact("t")
    assert now(kept) == before == [("a", 3), ("b1", 1), ("b2", 2), ("b3", 3)]
    assert len(kept.commits("t")) == 1 and kept.all("t").count() == 4
    kept.append("t", spark.createDataFrame([("a", 9)], KIND))
    kept.compact("t")
    kept.compact("t")
    assert now(kept) == [("a", 9), ("b1", 1), ("b2", 2), ("b3", 3)]


def test_compaction_does_not_undo_a_racing_write(spark, kept, monkeypatch):
    kept.append("t", spark.createDataFrame([("a", 0), ("b", 0)], KIND))
    listed = kept._listed

    def late(name, documents):
        monkeypatch.setattr(kept, "_listed", listed)
        kept.append("t", spark.createDataFrame([("a", 1)], KIND))  # commits while the compaction is on its way
        listed(name, documents)

    monkeypatch.setattr(kept, "_listed", late)
    kept.compact("t")
    assert now(kept) == [("a", 1), ("b", 0)]
    kept.compact("t")
    assert now(kept) == [("a", 1), ("b", 0)]


def crossings(h, v):
    return sorted((d, p, x, y) for d, p, x1, x2, y in h for e, q, x, y1, y2 in v if (d, p) == (e, q) and None not in (x1, x2, y, x, y1, y2) and x1 <= x <= x2 and y1 <= y <= y2)


def test_crossings_by_cells_equal_all_pairs(spark):
    import random

    rng = random.Random(2)
    h = [("d", rng.randrange(3), a, a + rng.choice([0.0, 1.0, 7.5, 90.0]), rng.randrange(-40, 60) * 1.0) for a in (rng.randrange(-50, 50) * 0.5 for _ in range(300))]
    v = [("d", rng.randrange(3), rng.randrange(-40, 60) * 0.5, a, a + rng.choice([0.0, 2.0, 30.0])) for a in (rng.randrange(-50, 50) * 1.0 for _ in range(300))]
    h += [("d", 0, None, 5.0, 1.0), ("d", 0, 5.0, 1.0, 1.0), ("e", 0, 3.0, 3.0, 3.0), ("d", 1, -1e6, 1e6, 0.0)]
    v += [("d", 0, None, 1.0, 2.0), ("e", 0, 3.0, 3.0, 3.0), ("e", 7, 3.0, 3.0, 3.0)]
    a = spark.createDataFrame(h, "document_id string, page_number int, x1 double, x2 double, y double")
    b = spark.createDataFrame(v, "document_id string, page_number int, x double, y1 double, y2 double")
    assert sorted(map(tuple, tables.intersections(a, b).collect())) == crossings(h, v)
    assert tables.intersections(a.limit(0), b).count() == 0


def test_many_short_lines_do_not_meet_all_pairs(spark):
    """20,000 lines each way on one page, each crossing one other: 400,000,000 pairs by the page, and few by the cell."""
    n = F.col("id")
    place = lambda c: c % 200 * 10.0
    h = spark.range(20_000).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), place(n).alias("x1"), (place(n) + 4).alias("x2"), F.floor(n / 200).cast("double").alias("y") * 10)
    h = h.toDF("document_id", "page_number", "x1", "x2", "y")
    v = spark.range(20_000).select(F.lit("d").alias("document_id"), F.lit(1).alias("page_number"), (place(n) + 2).alias("x"), (F.floor(n / 200) * 10.0 - 2).alias("y1"), (F.floor(n / 200) * 10.0 + 2).alias("y2"))
    met = tables.intersections(h, v)
    assert met.count() == 20_000
    cells = [c for c in met._jdf.queryExecution().analyzed().toString().split("\n") if "Join Inner" in c]
    assert cells and "cx" in cells[0] + cells[-1]
