"""Frames as a whole: how they are dealt out, and written down between the steps of a job."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, chain, islice, zip_longest

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: A frame that is smaller than so many bytes for each core is dealt out to all cores.
LEAST_BYTES = 8 << 20
#: Rows of an Arrow batch, and bytes of them, that Python looks at before it gives out what it made of them.
ROWS_AT_ONCE, BYTES_AT_ONCE = 256, 8 << 20


def portions(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``ROWS_AT_ONCE`` rows and ``BYTES_AT_ONCE`` bytes, or of one row, so that what a task holds as Python objects does not grow with the batch, wherever
    in it the large rows are."""
    todo = [batch.slice(i, ROWS_AT_ONCE) for i in range(0, batch.num_rows, ROWS_AT_ONCE)][::-1]
    while todo:
        part = todo.pop()
        if part.num_rows > 1 and part.nbytes > BYTES_AT_ONCE:
            half = part.num_rows // 2
            todo += [part.slice(half), part.slice(0, half)]
        else:
            yield part


def records(batch: pa.RecordBatch) -> list[dict]:
    """``to_pylist``, a column at a time: lists of structs have many small values."""

    def values(column: pa.Array) -> list:
        inner = column.flatten() if pa.types.is_list(column.type) and pa.types.is_struct(column.type.value_type) else None
        if inner is None or inner.null_count:
            return column.to_pylist()
        names = [f.name for f in inner.type]
        each = iter([dict(zip(names, v)) for v in zip(*(c.to_pylist() for c in inner.flatten()))])
        return [None if n is None else list(islice(each, n)) for n in column.value_lengths().to_pylist()]

    return [dict(zip(batch.schema.names, v)) for v in zip(*map(values, batch.columns))]


def nested(values: list[list[tuple] | None], kind: pa.ListType) -> pa.ListArray:
    """A column of lists of structs from lists of tuples, a field at a time; what a tuple lacks at its end is null."""
    fields = list(kind.value_type)
    columns = list(zip_longest(*chain.from_iterable(v for v in values if v)))
    n = sum(len(v) for v in values if v)
    columns += [(None,) * n] * (len(fields) - len(columns))
    inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], fields=fields)
    offsets = pa.array([0, *accumulate(len(v) if v else 0 for v in values)], pa.int32())
    return pa.ListArray.from_arrays(offsets, inner, kind, mask=pa.array([v is None for v in values], pa.bool_()))


def spread(df: DataFrame, evenly: bool = False, size: int | None = None) -> DataFrame:
    """``df``, dealt out to all cores where Spark's own estimate says that it is small: one small file is one task otherwise, however much work
    its rows are. Large frames have tasks enough and are not shuffled; unless ``evenly``, for rows that are much work: then each task gets about ``LEAST_BYTES`` however the files are cut.
    The estimate goes by the files, which may be packed; ``size`` gives the bytes where they were counted."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) if size is None else size
    if evenly:
        return df.repartition(max(cores, -(-size // LEAST_BYTES)) if size < 1 << 50 else 8 * cores)  # Spark takes what it does not know for as large as can be
    return df.repartition(cores) if size < cores * LEAST_BYTES else df


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
