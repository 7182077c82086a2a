"""Tables of documents, pages, extractions and runs: append-only facts with a view of the latest, and look-ups."""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.functions.frames import hadoop_path, staged
from docloom.functions.text import is_uuid
from docloom.operators.dedup import latest

TERMINAL = ("completed", "failed")
#: What a finding without one of these gets.
DEFAULTS = {"validator": "unknown", "check_name": "unknown_check", "severity": "info", "message": ""}


class Store:
    """Parquet tables under one folder of any Hadoop file system (local, s3a, ...), of which whole documents are replaced by version.

    A write puts its rows, under an id of its own, beside those of all other writes; then the documents that it replaces, in the table's manifest; and last it commits: it creates
    the file of the next free number among the table's commits, with its id in it. A file system that creates a file for one caller only makes these numbers a
    sequence, so of two writers that race one is the later, and both are whole. Of each document readers take the rows of its highest commit. So a replacement
    needs no updates, may be by nothing, and what a failed write has left is never seen. ``compact`` writes what is current anew and drops what is not."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def append(self, name: str, rows: DataFrame, label: str = "", documents: DataFrame | None = None, key: str = "document_id") -> int:
        """Write a version of the ``documents`` (column ``key``; those of the rows where not given): documents without rows have none from then on. The number of
        the commit; the ``label`` is only kept beside it."""
        version = f"{label}/{uuid.uuid4().hex}"
        marked = rows.withColumn("_version", F.lit(version))
        marked.write.mode("append").parquet(self.path(name))
        whose = self.all(name).filter(F.col("_version") == version) if documents is None else documents
        self._listed(name, whose.select(key).distinct().select(key, F.lit(version).alias("_version"), F.lit(None).cast("long").alias("_commit")))
        return self._commit(name, version)

    def _listed(self, name: str, documents: DataFrame) -> None:
        documents.write.mode("append").parquet(self.path(f"{name}.manifest"))

    def _commit(self, name: str, version: str) -> int:
        """Take the next number: where another writer has it, the one after."""
        number = max((n for n, _ in self.commits(name)), default=0) + 1
        while True:
            path, fs = hadoop_path(self.spark, f"{self.path(name)}.commits/{number:019d}")
            try:
                out = fs.create(path, False)
            except Py4JJavaError:
                if not fs.exists(path):  # another fault than a file that is there
                    raise
                number += 1
                continue
            try:
                out.write(bytearray(version.encode()))
            finally:
                out.close()
            return number

    def commits(self, name: str) -> list[tuple[int, str]]:
        """(number, write) of all commits, in their order: a small file for each write since the last ``compact``."""
        path, fs = hadoop_path(self.spark, f"{self.path(name)}.commits")
        if not fs.exists(path):
            return []
        rows = self.spark.read.format("binaryFile").load(f"{self.path(name)}.commits").select(F.element_at(F.split("path", "/"), -1).alias("n"), F.col("content").cast("string").alias("v"))
        return sorted((int(r.n), r.v) for r in rows.collect() if r.v)

    def all(self, name: str) -> DataFrame:
        """Rows of all versions, whether committed or not."""
        return self.spark.read.parquet(self.path(name))

    def versions(self, name: str, key: str = "document_id") -> DataFrame:
        """(key, _commit, _version) of each document's latest version: the highest number; of the write and its compacted copy, which have the same, the copy."""
        known = self.spark.createDataFrame(self.commits(name), "_number long, _version string")
        listed = self.spark.read.parquet(self.path(f"{name}.manifest")).join(F.broadcast(known), "_version")  # a row for each write
        last = listed.groupBy(key).agg(F.max(F.struct(F.coalesce("_commit", "_number").alias("_commit"), "_number", "_version")).alias("last"))
        return last.select(key, "last._commit", "last._version")

    def current(self, name: str, key: str = "document_id") -> DataFrame:
        """All rows of the latest version of each document."""
        return self.all(name).join(self.versions(name, key).drop("_commit"), [key, "_version"]).drop("_version")

    def compact(self, name: str, key: str = "document_id") -> None:
        """Write the current rows anew, each document under the number it has, and drop the writes of before. What other writers commit meanwhile stays the later version, and so does
        a write of theirs that is not committed yet. Readers that have begun before find their files gone, and have to begin again."""
        before = self.commits(name)
        old = [v for _, v in before]
        latest_ = staged(self.versions(name, key).filter(F.col("_version").isin(old)), "versions")
        version = f"compact/{uuid.uuid4().hex}"
        kept = self.all(name).join(latest_.select(key, "_version"), [key, "_version"]).withColumn("_version", F.lit(version))
        files = self._files(name, old), self._files(f"{name}.manifest", old)
        kept.select(*self.all(name).columns).write.mode("append").parquet(self.path(name))
        self._listed(name, latest_.select(key, F.lit(version).alias("_version"), "_commit"))
        self._commit(name, version)
        for number, _ in before:
            self._drop(f"{self.path(name)}.commits/{number:019d}")
        for path in (p for part in files for p in part):
            self._drop(path)

    def _files(self, table: str, versions: list[str]) -> list[str]:
        """Files of a table that hold rows of these writes: each file is of one."""
        return [r.f for r in self.spark.read.parquet(self.path(table)).filter(F.col("_version").isin(versions)).select(F.input_file_name().alias("f")).distinct().collect()]

    def _drop(self, path: str) -> None:
        there, fs = hadoop_path(self.spark, path)
        fs.delete(there, True)

    def by_id(self, name: str, document_id: str, key: str = "document_id") -> DataFrame:
        """Rows of one document; none, and no error, for a malformed id."""
        return self.current(name, key).filter(is_uuid(F.lit(document_id)) | (F.length(F.lit(document_id)) == 64)).filter(F.col(key) == document_id)

    def delete(self, name: str) -> None:
        for table in (f"{name}.commits", f"{name}.manifest", name):
            self._drop(self.path(table))

    def exists(self, name: str) -> bool:
        path, fs = hadoop_path(self.spark, self.path(name))
        return fs.exists(path)


class Blobs:
    """Contents by reference, in one table of ``Store``: a few large files in place of one for each content. Contents are never
    changed; a deletion is a version without rows, and what is stored after it counts again."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.store = spark, Store(spark, root)

    def put(self, blobs: DataFrame, label: str = "") -> int:
        """Store blobs (storage_reference, content)."""
        return self.store.append("blobs", blobs.select("storage_reference", "content").filter("content is not null"), label, key="storage_reference")

    def delete(self, references: DataFrame, label: str = "") -> int:
        """Delete what ``references`` (storage_reference) name."""
        named = references.select("storage_reference")
        return self.store.append("blobs", named.limit(0).withColumn("content", F.lit(None).cast("binary")), label, named, "storage_reference")

    def current(self) -> DataFrame:
        """(storage_reference, content) of all that is stored; of a reference written twice, the content comes once."""
        return self.store.current("blobs", "storage_reference").dropDuplicates(["storage_reference"]).select("storage_reference", "content")

    def get(self, references: DataFrame) -> DataFrame:
        """(storage_reference, content) of those that exist."""
        return self.current().join(references.select("storage_reference").distinct(), "storage_reference", "left_semi")

    def exists(self, references: DataFrame) -> DataFrame:
        """``references`` with ``stored``."""
        known = self.current().select("storage_reference", F.lit(True).alias("stored"))
        return references.join(known, "storage_reference", "left").withColumn("stored", F.coalesce("stored", F.lit(False)))


def with_status(documents: DataFrame, events: DataFrame) -> DataFrame:
    """Documents with the status of their latest event (document_id, status, at); their own where there is none."""
    last = latest(events, "document_id", "at", "status").select(F.col("document_id").alias("id"), F.col("status").alias("_status"))
    return documents.join(last, "id", "left").withColumn("status", F.coalesce("_status", "status")).drop("_status")


def waiting(documents: DataFrame, done: DataFrame) -> DataFrame:
    """Documents that have no row in ``done`` yet."""
    return documents.join(done.select("document_id").distinct(), "document_id", "left_anti")


def completed_at(status: Column, now: Column) -> Column:
    return F.when(status.isin(*TERMINAL), now)


def with_defaults(findings: DataFrame) -> DataFrame:
    return findings.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in DEFAULTS.items() if c in findings.columns})


def run_with_findings(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings of the latest run of each document, in the order of their creation within it; each run's in one task, without a global sort."""
    last = latest(runs, "document_id", "created_at", "id").select(F.col("id").alias("validation_run_id"), "document_id")
    return findings.join(last, "validation_run_id").repartition("validation_run_id").sortWithinPartitions("validation_run_id", "created_at")


def run(runs: DataFrame, findings: DataFrame, run_id: str) -> tuple[DataFrame, DataFrame]:
    """One run by its id, and its findings in order."""
    return runs.filter(F.col("id") == run_id), findings.filter(F.col("validation_run_id") == run_id).orderBy("created_at")
