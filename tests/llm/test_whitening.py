"""Whitening against numpy on the whole matrix."""

import math
from fractions import Fraction

import numpy as np

from docloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def whole(rows, components=32):
    """vec_id -> deviation, and for each component eigenvalue share and the column up to sign, for rows of one length."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    deviation = [sum(int(n * a - b) ** 2 for a, b in zip(row, s)) for row in x]
    centred = np.array([[float(Fraction(int(a)) - Fraction(int(b), n)) for a, b in zip(row, s)] for row in x])
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1][:components], vectors[:, ::-1][:, :components]
    return deviation, centred @ vectors / np.sqrt(values), values / np.trace(v)


def test_equals_whole_matrix(spark):
    rng = np.random.default_rng(5)
    d = 70  # three tiles, the last one narrow
    rows = [(i, (rng.normal(size=d) * np.linspace(9, 1, d) + rng.normal() * 3 + 2).tolist()) for i in range(3000)]
    rows[7] = (7, rows[6][1])
    rows.append(rows[3])
    odd = [(9001, None), (9002, []), (9003, [None] + [0.0] * (d - 1)), (9004, [math.nan] * d), (9005, [math.inf] + [0.0] * (d - 1)), (9006, [1e30] * d)]
    vectors = spark.createDataFrame(rows + odd, SCHEMA).repartition(5).selectExpr("*", "1 as x", "2 as n", "3 as white")
    got = whitening.whiten(vectors).toPandas()
    deviation, white, explained = whole(rows)
    assert len(got) == 32 * len(rows) and set(got.n) == {len(rows)} and got.identity_error.nunique() == 1 and got.identity_error[0] < 1e-9
    table = got.drop_duplicates(["vec_id", "component"]).pivot(index="vec_id", columns="component", values="whitened")
    ids = [i for i, _ in rows[:3000]]
    ours = table.loc[ids].to_numpy()
    sign = np.sign((ours * white[:3000]).sum(axis=0))
    np.testing.assert_allclose(ours * sign, white[:3000], atol=1e-7)
    np.testing.assert_allclose(got.drop_duplicates("component").set_index("component").explained.sort_index(), explained, rtol=1e-9)
    assert dict(zip(got.vec_id, got.deviation)) == {i: x for (i, _), x in zip(rows, deviation)}


def test_few_rows_lengths_and_empty_tables(spark):
    rows = [(1, [1.0, 2.0]), (2, [3.0, 2.0]), (None, [5.0, 2.5]), (4, [1.0, 2.0, 3.0]), (5, [1.0, 2.0, 9.0]), (6, [4.0])]
    got = whitening.whiten(spark.createDataFrame(rows, SCHEMA)).collect()
    # two components of three pairs, one of two triples, none of a single vector
    assert sorted((str(r.vec_id), r.component, r.n) for r in got) == sorted([(i, c, 3) for i in ("1", "2", "None") for c in (1, 2)] + [("4", 1, 2), ("5", 1, 2)])
    assert {round(abs(r.whitened), 9) for r in got if r.n == 2} == {1.0} and all(r.identity_error < 1e-9 for r in got)
    same = whitening.whiten(spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], SCHEMA))
    assert same.collect() == [] and whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []


def test_deviation_is_exact_where_sums_are_large(spark):
    rows = [(i, [float(1 << 36) * (i % 3), 0.5 * i]) for i in range(9)]
    got = {r.vec_id: r.deviation for r in whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), components=1).collect()}
    x = [[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows]
    exact = [sum((9 * a - b) ** 2 for a, b in zip(r, map(sum, zip(*x)))) for r in x]
    assert got == {i: v if v < 1 << 63 else None for i, v in enumerate(exact)} and None in got.values() and any(v is not None for v in got.values())
