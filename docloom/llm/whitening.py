"""Whitening of embeddings by a tiled covariance.

Vectors are packed in blocks of rows, each block cut in tiles of dimensions. Every pair of tiles is a key: the column blocks of a row block are shuffled to each
key that they are part of, multiplied there, and the products summed for each key. The tiles assemble to the covariance, whose size depends on the number of
dimensions alone; its eigenvectors are found on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, staged

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 64, 1_000_000
#: Entries beyond this, scaled, are taken for damage: they could not be told apart as doubles.
LARGEST = float(1 << 52)
COMPONENTS = 32
#: Dimensions of a tile, rows of a block.
TILE, BLOCK_ROWS = 32, 4096
#: Eigenvalues under this share of the greatest are rounding: their components do not exist.
LEAST_SHARE = 1e-12


@dataclass
class Whitener:
    """Of n vectors: exact sums by dimension, and for each component a unit eigenvector (column), its eigenvalue and its share of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray

    @property
    def means(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def usable(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x array<long>) of the rows whose vector has entries, all of them finite and within ``LARGEST``."""
    c = F.col(embedding).cast("array<double>")
    fine = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) * SCALE < LARGEST))
    rows = vectors.filter(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & fine)
    return rows.select(F.col(vec_id).cast("long").alias("vec_id"), F.transform(c, lambda v: F.floor(v * SCALE).cast("long") + OFFSET).alias("x"))


def matrix(column: pa.Array, dtype) -> np.ndarray:
    """Rows of an Arrow column of equally long lists."""
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), dtype).reshape(len(column), -1)


def sums_of(rows: DataFrame, name: str, dtype: str) -> tuple[int, list]:
    """Number of rows and sums by dimension of an array column; each task sends one row a dimension."""
    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, 0
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(0), np.int64 if dtype == "long" else np.float64)
                n, total = n + len(x), total + x.sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(np.full(len(total), n)), pa.array(total)], ["i", "n", "s"])

    parts = rows.select(name).mapInArrow(part, f"i long, n long, s {dtype}")
    exact = F.sum(F.col("s").cast("decimal(38,0)")) if dtype == "long" else F.sum("s")
    got = parts.groupBy("i").agg(F.sum("n").alias("n"), exact.alias("s")).orderBy("i").collect()
    return (got[0].n, [int(r.s) if dtype == "long" else float(r.s) for r in got]) if got else (0, [])


def covariance(rows: DataFrame, name: str, n: int, means: np.ndarray) -> np.ndarray:
    """Covariance of the array column ``name`` about ``means``, divided by ``n``; centred before it is multiplied."""
    spark, d = rows.sparkSession, len(means)
    tiles = -(-d // TILE)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of rows, cut by tiles of dimensions, for each pair of tiles that a tile is part of."""
        held: list[np.ndarray] = []

        def out() -> pa.RecordBatch:
            x = np.concatenate(held) - means
            held.clear()
            block = int(np.random.default_rng().integers(1 << 62))
            keys = [(p, q, side) for p in range(tiles) for q in range(p, tiles) for side in range(1 + (p < q))]
            data = [np.ascontiguousarray(x[:, t * TILE : (t + 1) * TILE]).tobytes() for t in range(tiles)]
            return pa.RecordBatch.from_arrays([pa.array([block] * len(keys)), *(pa.array([k[i] for k in keys]) for i in range(3)), pa.array([data[k[k[2]]] for k in keys], pa.binary())], ["block", "p", "q", "side", "data"])

        for batch in batches:
            if batch.num_rows:
                held.append(matrix(batch.column(0), np.float64))
            if sum(map(len, held)) >= BLOCK_ROWS - 512:
                yield out()
        if held:
            yield out()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Products of tiles, summed over the task's row blocks."""
        total: dict[tuple[int, int], np.ndarray] = {}
        width = lambda t: min(TILE, d - t * TILE)
        for batch in batches:
            for p, q, a, b in zip(*(batch.column(i).to_pylist() for i in range(4))):
                x, y = np.frombuffer(a).reshape(-1, width(p)), np.frombuffer(b).reshape(-1, width(q))
                total[p, q] = total.get((p, q), 0) + x.T @ y
        for (p, q), v in total.items():
            i, j = np.divmod(np.arange(v.size), v.shape[1])
            yield pa.RecordBatch.from_arrays([pa.array(p * TILE + i), pa.array(q * TILE + j), pa.array(v.reshape(-1))], ["i", "j", "v"])

    blocks = staged(rows.select(name).mapInArrow(cut, "block long, p long, q long, side long, data binary"), "tiles")
    left, right = blocks.filter("side = 0"), blocks.filter("side = 1 or p = q").select("block", "p", "q", F.col("data").alias("other"))
    pairs = left.join(right.hint("merge"), ["block", "p", "q"]).select("p", "q", "data", "other")
    v = np.zeros((d, d))
    for r in pairs.mapInArrow(multiply, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():  # dimensions squared, whatever the rows
        v[r.i, r.j] = v[r.j, r.i] = r.v / n
    return v


def fit(rows: DataFrame, components: int = COMPONENTS) -> Whitener | None:
    """The whitener of all ``rows`` (x); None where there are none."""
    n, sums = sums_of(rows, "x", "long")
    if not n:
        return None
    v = covariance(rows, "x", n, np.array([s / n for s in sums]))
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = int((values > max(values[0], 0) * LEAST_SHARE).sum()) if values[0] > 0 else 0
    kept = min(kept, components)
    return Whitener(n, sums, vectors[:, :kept], values[:kept], values[:kept] / max(float(np.trace(v)), 1e-300))


def apply(rows: DataFrame, whitener: Whitener) -> DataFrame:
    """(vec_id, deviation decimal, white array<double>) of every row: the exact sum of squares of n*x - S, and the components."""
    n, sums, means = whitener.n, np.array(whitener.sums, object), whitener.means
    scaled = whitener.vectors / np.sqrt(whitener.values)

    def exact(x: np.ndarray) -> list[int]:
        far = x.astype(object) * n - sums
        if max((abs(v) for v in (far.max(), far.min())), default=0) ** 2 * len(sums) < 1 << 62:
            far = far.astype(np.int64)
            return (far * far).sum(axis=1).tolist()
        return [sum(v * v for v in row) for row in far]

    def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = matrix(batch.column(1), np.int64)
                white = (x.astype(np.float64) - means) @ scaled
                lists = pa.ListArray.from_arrays(np.arange(0, white.size + 1, white.shape[1], dtype=np.int32) if white.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(white.reshape(-1)))
                deviation = pa.array([v if v < 1 << 63 else None for v in exact(x)], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), deviation, lists], ["vec_id", "deviation", "white"])

    return rows.mapInArrow(part, "vec_id long, deviation long, white array<double>")


def whiten(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for every usable row of ``vectors`` and component, numbered from one by falling
    eigenvalue.

    Rows whose vector is null, empty, or has a null, non-finite or immense entry take no part (64 times it must stay under 2**52). Repeated rows count and come out as often as they occur;
    vec_id may be null and does not matter. Vectors of different lengths have no covariance: those of each length are whitened by themselves. Components of no variance do not
    exist, so equal vectors, or a single one, give no row. A deviation that no long can hold is null. Other columns take no part."""
    small_batches(vectors.sparkSession)
    rows = staged(spread(usable(vectors, vec_id, embedding)), "usable")
    lengths = [r.d for r in rows.select(F.size("x").alias("d")).distinct().orderBy("d").collect()]
    if not lengths:
        return rows.select("vec_id", *(F.lit(None).cast(k).alias(c) for c, k in (("component", "int"), ("n", "long"), ("deviation", "long"), ("whitened", "double"), ("explained", "double"), ("identity_error", "double")))).limit(0)
    return reduce(DataFrame.unionByName, (_whiten(rows.filter(F.size("x") == d), components) for d in lengths))


def _whiten(rows: DataFrame, components: int) -> DataFrame:
    """``whiten`` of rows (vec_id, x) of one length."""
    whitener = fit(rows, components)
    white = staged(apply(rows, whitener), "white")
    k, n = len(whitener.values), whitener.n
    error = 0.0
    if k:
        means = np.array(sums_of(white, "white", "double")[1]) / n
        error = float(np.abs(covariance(white, "white", n, means) - np.eye(k)).max())
    explained = F.array(*(F.lit(float(e)) for e in whitener.explained)).cast("array<double>")
    each = white.select("vec_id", "deviation", F.posexplode("white").alias("i", "whitened"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened", explained[F.col("i")].alias("explained"), F.lit(error).alias("identity_error"))
