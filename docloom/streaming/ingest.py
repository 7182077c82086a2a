"""Files as they arrive: each content once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from docloom.operators.dedup import fingerprint
from docloom.sources.files import content_type

FILE = T.StructType([T.StructField("path", T.StringType()), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])


def arriving(spark: SparkSession, path: str, files_at_once: int = 1000) -> DataFrame:
    """A stream of the files that come into a folder, with checksums."""
    rows = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", files_at_once).load(path)
    name = F.element_at(F.split("path", "/"), -1)
    return fingerprint(rows.select(name.alias("original_filename"), content_type(name).alias("content_type"), "content", F.col("modificationTime").alias("document_timestamp")))


def each_content_once(files: DataFrame, horizon: str = "7 days") -> DataFrame:
    """Drops files whose content came before, within the horizon: state is bounded by the files of that time. What came earlier is left to the store, see ``start``."""
    return files.withWatermark("document_timestamp", horizon).dropDuplicatesWithinWatermark(["checksum_sha256"])


def start(files: DataFrame, sink: str, checkpoint: str) -> StreamingQuery:
    """Append the new documents to a Parquet table, and stop when no file waits. Each batch is checked against all that the table has, whenever it came, so that
    each content is there once; a batch that is run again after a fault appends only what it had not."""

    def append(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(sink)
        fresh = batch.dropDuplicates(["checksum_sha256"])
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            fresh = fresh.join(spark.read.schema(batch.schema).parquet(sink).select("checksum_sha256"), "checksum_sha256", "left_anti")
        fresh.select(*batch.columns).write.mode("append").parquet(sink)

    rows = each_content_once(files).drop("content")
    return rows.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
