"""Helpers shared by the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import lru_cache
from itertools import repeat

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.frames import spread  # noqa: F401  for the operators beside

#: Rows of an Arrow batch: small, since one text may hold hundreds of kilobytes.
BATCH_ROWS = "512"


@lru_cache(1)
def local_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="docloom-")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir. Where none is set, a temporary one if driver and executors are one process (tests), else an error:
    on a cluster, files in a machine's own folder would be missing when they are read again."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = local_dir()
    return found.rstrip("/")


def hadoop_path(spark: SparkSession, path: str):
    """A path and its file system, as the JVM has them."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there, there.getFileSystem(spark._jsc.hadoopConfiguration())


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it again: cuts the lineage, so that a lost
    executor costs a re-read and not a recomputation. The files go when the application ends, or by ``dropped``."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    there, fs = hadoop_path(spark, path)
    fs.deleteOnExit(there)
    out = spark.read.schema(df.schema).parquet(path)
    out.staged_at = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Delete the files of ``staged`` frames that nothing reads any more."""
    for df in frames:
        there, fs = hadoop_path(df.sparkSession, df.staged_at)
        fs.delete(there, True)


def small_batches(spark: SparkSession) -> None:
    """Hold the session's Arrow batches small. Spark reads the setting when a plan runs, so it stays set; the README says so."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that nothing may learn from; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def bounded_sample(df: DataFrame, key: str, bound: int, rows: int | None = None) -> DataFrame:
    """All rows of ``df``, or about ``bound`` where there are more, chosen by a hash of ``key``: the same rows in every run."""
    n = df.count() if rows is None else rows
    if n <= bound:
        return df
    return df.filter(F.pmod(F.xxhash64(F.col(key), F.lit("sample")), F.lit(1 << 30)) < int(bound / n * (1 << 30)))


def texts_of(batch, i: int = 0) -> list[bytes]:
    """UTF-8 of column ``i`` of an Arrow batch, null as empty."""
    import pyarrow as pa

    return [x or b"" for x in batch.column(i).cast(pa.binary()).to_pylist()]


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def random64(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 64, n, dtype=np.uint64)


class Powers:
    """Powers of an odd multiplier and of its inverse, modulo 2**64, as far as asked for."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, np.uint64), np.ones(1, np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            for name, base in (("up", self.base), ("down", pow(self.base, -1, 1 << 64))):
                a = np.full(size, base, np.uint64)
                a[0] = 1
                setattr(self, name, np.cumprod(a, dtype=np.uint64))
        return self.up, self.down


def rolling(values: np.ndarray, width: int, powers: Powers) -> np.ndarray:
    """Rabin-Karp hashes of all runs of ``width`` values: from prefix sums of value * base**-i."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers.upto(n + 1)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(values * down[:n], out=sums[1:])
    return (sums[width:] - sums[:-width]) * up[: n - width + 1]


IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
BYTE_VALUES = random64(256, 7)
LETTERS = Powers(0x9E3779B97F4A7C15)


def _words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, prefix sums of the bytes' values and the powers that they are read with."""
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate(([True], IS_SPACE[raw], [True])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    up, down = LETTERS.upto(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    if len(starts):
        np.cumsum(BYTE_VALUES[raw] * down[: len(raw)], out=sums[1:])
    return starts, ends, sums, up


def _hashes(starts: np.ndarray, ends: np.ndarray, sums: np.ndarray, up: np.ndarray) -> np.ndarray:
    return mix64((sums[ends] - sums[starts]) * up[starts] + (ends - starts).astype(np.uint64))


def word_hashes(data: bytes, head: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and 64-bit hashes of the words [^\\x20\\x09-\\x0D]+ of UTF-8 bytes, or of the first ``head`` bytes of each. Polynomial
    hashes: quick for all words at once, but words made for it can collide; what has to be certain uses ``digests`` too."""
    starts, ends, sums, up = _words(data)
    if head:
        ends = np.minimum(ends, starts + head)
    return starts, ends, _hashes(starts, ends, sums, up)


def headed_hashes(data: bytes, heads: tuple[int | None, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Starts of the words, and their ``word_hashes`` for each of the ``heads``."""
    starts, ends, sums, up = _words(data)
    return starts, [_hashes(starts, np.minimum(ends, starts + head) if head else ends, sums, up) for head in heads]


def digests(words: list[bytes], seed: int) -> np.ndarray:
    """XXH3 hashes of words, 64 bits: of another kind than ``word_hashes``."""
    import xxhash

    return np.fromiter(map(xxhash.xxh3_64_intdigest, words, repeat(seed)), np.uint64, len(words))
