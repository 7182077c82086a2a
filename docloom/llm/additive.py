"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of one codeword from each of several full-dimensional codebooks. Each codebook is the k-means of what the
ones before it leave over; codes are found by beam search. With a code are stored the norm of its sum and the cosine between the sum and the vector. A query makes a
table of its products with all codewords, so that its product with a coded vector is a sum of look-ups, and this by the norm its cosine with
the sum. The two cosines bound the query's cosine with the vector itself: the angles add up at most and take away from each other at least. Every
vector that may by this be among a query's best is compared exactly, beside its code; the others can not be.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_sample, small_batches, staged

BOOKS, WORDS = 16, 256
BEAM = 4
#: Vectors that the codebooks are fitted on, at most.
SAMPLE = 10_000
KMEANS_ROUNDS, SEED = 6, 3
BLOCK_ROWS, QUERY_ROWS = 2048, 256
#: Pairs of blocks that a task takes in at once: a block carries its vectors.
BATCH_BLOCKS = "16"
#: Blocks of rows and of queries that meet in a task, about.
TASK_BLOCKS, TASK_QUERIES = 8, 32
#: Query blocks whose best rows a task keeps at once.
HELD_BLOCKS = 64
#: More than products of unit vectors differ from the cosines that count; pairs whose cosine is summed at once.
SUMMING, PAIRS_AT_ONCE = 1e-12, 1 << 16
#: Largest power of two by which vectors are scaled.
POWERS = 1000
#: More than rounding adds to a cosine by sums of look-ups.
ROUNDING = 1e-4


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(KMEANS_ROUNDS):
        near = nearest(x, c)
        n = np.bincount(near, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.concatenate([(half_norms(c) - x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])


def half_norms(c: np.ndarray) -> np.ndarray:
    return (c * c).sum(axis=1) / 2


def beam_encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Codes (rows x books) whose codewords' sum is near each row; ``beam`` partial codes are kept at each book."""
    out = []
    m, k, d = books.shape
    for part in np.array_split(x, max(1, len(x) // 1024)):
        n = len(part)
        rest, codes = part[:, None, :], np.zeros((n, 1, 0), np.int64)
        for book in books:
            b = rest.shape[1]
            # half the squared distance, but for half the row's own square
            cost = (rest * rest).sum(axis=2)[:, :, None] / 2 - (rest.reshape(-1, d) @ book.T).reshape(n, b, k) + half_norms(book)
            flat = cost.reshape(n, -1)
            width = min(beam, flat.shape[1])
            best = np.argpartition(flat, width - 1, axis=1)[:, :width] if width < flat.shape[1] else np.tile(np.arange(width), (n, 1))
            row = np.arange(n)[:, None]
            rest = rest[row, best // k] - book[best % k]
            codes = np.concatenate([codes[row, best // k], (best % k)[:, :, None]], axis=2)
        least = (rest * rest).sum(axis=2).argmin(axis=1)
        out.append(codes[np.arange(n), least])
    return np.concatenate(out).astype(np.uint8) if len(x) else np.zeros((0, m), np.uint8)


def decode(codes: np.ndarray, books: np.ndarray) -> np.ndarray:
    return sum((books[i][codes[:, i]] for i in range(len(books))), np.zeros((len(codes), books.shape[2]), books.dtype))


def train(x: np.ndarray) -> np.ndarray:
    """Codebooks (books x words x dimensions) for rows of unit length."""
    rng = np.random.default_rng(SEED)
    k = min(WORDS, len(x))
    rest, books = x.copy(), []
    for _ in range(BOOKS):
        books.append(kmeans(rest, k, rng))
        rest -= books[-1][nearest(rest, books[-1])]
    return np.stack(books)


def unit(lists: list, dtype=np.float32) -> np.ndarray:
    x = np.array(lists, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(dtype)


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, embedding array<double>) of the rows that take part: an id, and no null, non-finite or only zero components. Vectors are scaled by a power of two, which
    changes no cosine, so that squares neither overflow nor vanish."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    power = F.greatest(F.least(F.floor(F.log2(F.array_max(F.transform("embedding", lambda x: F.abs(x))))), F.lit(POWERS)), F.lit(-POWERS))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine).withColumn("scale", F.pow(F.lit(2.0), -power))
    return rows.select("vec_id", F.transform("embedding", lambda x: x * F.col("scale")).alias("embedding"))


def dot(a: str, b: str) -> Column:
    """In double precision, always summed in the same order."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)


def sums(n: int, products: Iterator[np.ndarray]) -> np.ndarray:
    """As ``dot`` adds."""
    total = np.zeros(n)
    for p in products:
        total += p
    return total


def cosines_of(q: np.ndarray, x: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Cosines of the rows q[i] and x[j], to the last bit those of the final ranking."""
    length = lambda v: np.sqrt(sums(len(v), (c * c for c in v.T)))
    of_q, of_x, down_q, down_x = length(q), length(x), np.ascontiguousarray(q.T), np.ascontiguousarray(x.T)
    out = np.empty(len(i))
    for k in range(0, len(i), PAIRS_AT_ONCE):
        a, b = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
        out[k : k + PAIRS_AT_ONCE] = sums(len(a), (u[a] * v[b] for u, v in zip(down_q, down_x))) / (of_q[a] * of_x[b])
    return out


class Best:
    """The best ``width`` rows of each of some queries so far (query, id, cosine): the largest cosines, of equal ones the least ids."""

    def __init__(self, width: int, queries: int):
        self.width, self.queries = width, queries
        self.query, self.ids, self.cosine = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def floor(self) -> np.ndarray:
        """Cosine that as many rows reach as are wanted."""
        out = np.full(self.queries, -2.0)
        if len(self.query):
            count = np.bincount(self.query, minlength=self.queries)
            least = np.full(self.queries, 2.0)
            np.minimum.at(least, self.query, self.cosine)
            out[count >= self.width] = least[count >= self.width]
        return out

    def add(self, query: np.ndarray, ids: np.ndarray, cosine: np.ndarray) -> None:
        query, ids, cosine = np.concatenate((self.query, query)), np.concatenate((self.ids, ids)), np.concatenate((self.cosine, cosine))
        order = np.lexsort((ids, -cosine, query))
        query = query[order]
        first = np.searchsorted(query, query)
        kept = np.arange(len(query)) - first < self.width
        self.query, self.ids, self.cosine = query[kept], ids[order][kept], cosine[order][kept]


def search(vectors: DataFrame, queries: Column, k: int = 5) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row of ``vectors`` (vec_id, embedding) for which ``queries`` holds, its ``k`` nearest
    other rows by cosine, ties to smaller vec_id; all of them if there are fewer.

    Equal vectors are coded and searched once: of each, the least k + 1 ids can be among a query's nearest. Rows that repeat a
    vec_id and its vector count once. Rows with a null id, or a vector that is null, empty, zero or not finite, take no part. Vectors of
    different lengths have no cosine: each is searched among those of its own length. Other columns take no part."""
    all_rows = staged(usable(vectors), "vectors")
    asked = all_rows.filter(queries).select("vec_id", "embedding")
    lengths = [r.n for r in asked.select(F.size("embedding").alias("n")).distinct().orderBy("n").collect()]
    if not lengths:
        return asked.select(F.col("vec_id").alias("query_id"), F.lit(1).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    of_length = lambda df, n: df.filter(F.size("embedding") == n)
    found = [_search(of_length(all_rows, n), of_length(asked, n), k) for n in lengths]
    return reduce(DataFrame.unionByName, found)


def _search(all_rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """``search`` among vectors of one length; some of ``all_rows`` are ``asked``."""
    spark = all_rows.sparkSession
    small_batches(spark)
    same = Window.partitionBy("embedding")
    members = all_rows.withColumn("place", F.dense_rank().over(same.orderBy("vec_id"))).filter(F.col("place") <= k + 1).dropDuplicates(["embedding", "vec_id"])
    members = staged(members.withColumn("rep", F.min("vec_id").over(same)), "members")
    distinct = members.filter("vec_id = rep").select("rep", "embedding", F.sqrt(dot("embedding", "embedding")).alias("norm"))
    n_rows = distinct.count()
    sample = [r.embedding for r in bounded_sample(distinct, "rep", SAMPLE, n_rows).orderBy("rep").select("embedding").collect()]
    books = train(unit(sample))
    names = ("ids", "codes", "norms", "cosines", "vectors")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Packed blocks of codes: at most ``BLOCK_ROWS`` rows in each."""
        held: list[list[np.ndarray]] = [[] for _ in names]

        def out() -> pa.RecordBatch:
            packed = [pa.array([np.concatenate(x).tobytes()], pa.binary()) for x in held]
            for x in held:
                x.clear()
            return pa.RecordBatch.from_arrays(packed, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            x = unit(batch.column(1).to_pylist(), np.float64)
            codes = beam_encode(x.astype(np.float32), books)
            near = decode(codes, books).astype(np.float64)
            norms = np.maximum(np.linalg.norm(near, axis=1), 1e-9)
            own = np.array(batch.column(1).to_pylist(), np.float64)
            for h, part in zip(held, (np.array(batch.column(0).to_pylist(), np.int64), codes, norms, np.clip((x * near).sum(axis=1) / norms, -1, 1), own)):
                h.append(part)
            if sum(map(len, held[0])) >= BLOCK_ROWS - 512:
                yield out()
        if held[0]:
            yield out()

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, QUERY_ROWS):
                part = batch.slice(i, QUERY_ROWS)
                ids = np.array(part.column(0).to_pylist(), np.int64).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([ids], pa.binary()), pa.array([np.array(part.column(1).to_pylist(), np.float64).tobytes()], pa.binary())], ["queries", "wanted"])

    width = k + 1

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The best rows of a task for each of its queries, by exact cosine."""
        held: dict[bytes, Best] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for queries_, best in held.items():
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(queries_, np.int64)[best.query]), pa.array(best.ids), pa.array(best.cosine)], ["query_rep", "rep", "near"])
            held.clear()

        for batch in batches:
            for i in range(batch.num_rows):
                row = dict(zip((*names, "queries", "wanted"), (batch.column(c)[i].as_py() for c in range(batch.num_columns))))
                ids = np.frombuffer(row["ids"], np.int64)
                codes = np.frombuffer(row["codes"], np.uint8).reshape(len(ids), -1)
                norms, cosines = np.frombuffer(row["norms"]), np.frombuffer(row["cosines"])
                own_x, own_q = np.frombuffer(row["vectors"], np.float64).reshape(len(ids), -1), np.frombuffer(row["wanted"], np.float64).reshape(-1, books.shape[2])
                x, q = unit(own_x, np.float64), unit(own_q, np.float64)
                near = np.zeros((len(q), len(ids)), np.float32)
                for book, column in zip(books, codes.T):
                    near += (q.astype(np.float32) @ book.T)[:, column]
                # the angle between query and vector is no less than the difference of theirs to the sum; look-ups may be off by ROUNDING
                near = np.clip(near / norms, -1, 1)
                nearest_ = np.clip(cosines, np.maximum(near - ROUNDING, -1), np.minimum(near + ROUNDING, 1))
                most = nearest_ * cosines + np.sqrt((1 - nearest_ * nearest_) * np.maximum(1 - cosines * cosines, 0))
                best = held.setdefault(row["queries"], Best(width, len(q)))
                floor = best.floor()
                if len(ids) > width:  # as many rows as are wanted reach this, so a row that can not is not among them
                    likely = np.argpartition(-near, width - 1, axis=1)[:, :width]
                    floor = np.maximum(floor, np.einsum("qd,qwd->qw", q, x[likely]).min(axis=1))
                may = most >= floor[:, None] - 1e-9
                met = np.flatnonzero(may.any(axis=0))
                exact = np.where(may[:, met], q @ x[met].T, -3.0)
                if len(met) > width:
                    floor = np.maximum(floor, np.partition(exact, len(met) - width, axis=1)[:, len(met) - width])
                i, j = np.nonzero((exact >= floor[:, None] - SUMMING) & (exact > -2))
                best.add(i, ids[met[j]], cosines_of(own_q, own_x[met], i, j))
                if len(held) > HELD_BLOCKS:
                    yield from out()
        yield from out()

    blocks = staged(distinct.select("rep", "embedding").mapInArrow(code, ", ".join(f"{n} binary" for n in names)), "codes")
    wanted = staged(asked.select("embedding").distinct().join(distinct, "embedding").select("rep", "embedding", "norm"), "wanted")
    packed = staged(wanted.select("rep", "embedding").mapInArrow(pack, "queries binary, wanted binary"), "packed")
    # every block of queries meets every block of rows, once, in a grid of tasks: its sides follow the numbers of blocks
    n_blocks, n_packed = blocks.count(), packed.count()
    down = max(1, -(-n_packed // TASK_QUERIES))
    across = max(1, -(-n_blocks // TASK_BLOCKS), min(n_blocks, -(-spark.sparkContext.defaultParallelism // down)))
    cell = lambda key, n: F.pmod(F.xxhash64(key), F.lit(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    tall = blocks.withColumn("across", cell("ids", across)).withColumn("down", spread(down))
    wide = packed.withColumn("down", cell("queries", down)).withColumn("across", spread(across))
    # never by broadcast: Spark takes a side for as large as it was before it was copied, and would gather all copies on the driver
    near = tall.join(wide.hint("merge"), ["across", "down"]).select(*names, "queries", "wanted").mapInArrow(score, "query_rep long, rep long, near double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_BLOCKS)
    near = staged(near, "near")
    small_batches(spark)
    near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("near"), "rep"))).filter(F.col("place") <= width).select("query_rep", "rep")
    # cosines of the best in double precision, always summed in the same order, then the rows that have these vectors
    exact = near.join(distinct, "rep").join(wanted.select(F.col("rep").alias("query_rep"), F.col("embedding").alias("asked"), F.col("norm").alias("length")), "query_rep")
    exact = exact.select("query_rep", "rep", (dot("asked", "embedding") / (F.col("length") * F.col("norm"))).alias("score"))
    exact = exact.withColumn("place", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "rep"))).filter(F.col("place") <= k + 1)
    rows = exact.join(members.select("rep", "vec_id"), "rep")
    rows = rows.withColumn("place", F.row_number().over(Window.partitionBy("query_rep").orderBy(F.desc("score"), "vec_id"))).filter(F.col("place") <= k + 1)
    rows = staged(rows.select("query_rep", "vec_id", "score"), "nearest")
    whose = asked.select(F.col("vec_id").alias("query_id"), "embedding").distinct().join(wanted.select(F.col("rep").alias("query_rep"), "embedding"), "embedding").select("query_id", "query_rep")
    found = whose.join(rows, "query_rep").filter("query_id != vec_id")
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
