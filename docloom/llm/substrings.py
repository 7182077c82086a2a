"""Substring dedup: Rabin-Karp hashes of every window of 50 words, counted in Spark.

Each document hashes all its windows. To spare the shuffle of windows that can not repeat, a first pass sends only the
least 25-word hash within each window (one in fourteen words or so): equal windows have equal ones, so a window whose least hash occurs in
one document only is unique. The windows that are left are counted whole, by two hashes of 64 bits over word hashes of different kinds
(polynomial and XXH3), so that words made to collide in the one differ in the other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Powers, digests, mix64, rolling, small_batches, spread, staged, texts_of, word_hashes

WINDOW = 50
INNER = 25
INNER_BASE, BASE_A, BASE_B = Powers(0xBF58476D1CE4E5B9), Powers(0x94D049BB133111EB), Powers(0xD1342543DE82EF95)


def sliding_min(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every run of ``width`` values, by doubling."""
    reach, out = 1, a
    while reach * 2 <= width:
        out = np.minimum(out[:-reach], out[reach:])
        reach *= 2
    return np.minimum(out[: len(a) - width + 1], out[width - reach :]) if width > reach else out


def least_inner(hashes: np.ndarray) -> np.ndarray:
    """For every window, the least scrambled hash of the 25-word runs within it."""
    return sliding_min(mix64(rolling(hashes, INNER, INNER_BASE)), WINDOW - INNER + 1)


def digest_of(text: bytes, keep: np.ndarray | None = None) -> bytes:
    words = text.split()
    return hashlib.sha256(b" ".join(words if keep is None else [words[i] for i in np.flatnonzero(keep).tolist()])).digest()


def repeated_words(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256 binary, spans) for every row: spans are the maximal intervals [start, end) of
    words covered by windows that also start in a document of smaller doc_id.

    A null or empty text has no words; texts under 50 words keep all. Rows that repeat a doc_id are one document as to who is
    smaller. A row without doc_id loses nothing and takes nothing from others. Other columns take no part."""
    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha, inner = [], [], []
            for t in texts_of(batch, 1):
                hashes = word_hashes(t)[2]
                n.append(len(hashes))
                sha.append(digest_of(t))
                inner.append(np.unique(least_inner(hashes)).view(np.int64) if len(hashes) >= WINDOW else [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(inner, pa.list_(pa.int64()))], ["doc_id", "n_words", "sha", "inner"])

    # 1. word counts, digests and inner hashes of every row
    rows = staged(spread(source).mapInArrow(scan, "doc_id long, n_words long, sha binary, inner array<bigint>"), "scan")
    # 2. of equal word sequences only the least doc_id goes on: the others' windows all start in it
    copies = rows.filter(f"doc_id is not null and n_words >= {WINDOW}").groupBy("sha").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).filter("first < last").select("sha", "first")
    copies = staged(copies, "copies")
    marked = rows.join(copies, "sha", "left").select("doc_id", "n_words", "sha", "inner", (F.col("doc_id") > F.col("first")).alias("copy"))
    alone = marked.filter("doc_id is not null and not coalesce(copy, false)").select("doc_id", "sha", F.explode("inner").alias("h"))
    # 3. inner hashes that several documents have
    shared = alone.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("h")
    wanted = alone.join(shared, "h").groupBy("doc_id", "sha").agg(F.collect_set("h").alias("shared"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, shas, lists, texts = batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts_of(batch, 3)
            take, out = [], ([], [], [])
            for i, (sha, inner, t) in enumerate(zip(shas, lists, texts)):
                if digest_of(t) != sha:  # another row of this doc_id
                    continue
                hashes = word_hashes(t)[2]
                at = np.flatnonzero(np.isin(least_inner(hashes), np.array(inner, np.int64).view(np.uint64)))
                other = digests(t.split(), WINDOW) if len(at) else hashes
                take.append(i)
                for o, h in zip(out, (at.astype(np.int32), rolling(hashes, WINDOW, BASE_A)[at].view(np.int64), rolling(other, WINDOW, BASE_B)[at].view(np.int64))):
                    o.append(h)
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(take, pa.int64())), pa.array([shas[i] for i in take], pa.binary()), pa.array([texts[i] for i in take], pa.binary()), *(pa.array(o, pa.list_(k)) for o, k in zip(out, (pa.int32(), pa.int64(), pa.int64())))], ["doc_id", "sha", "text", "at", "a", "b"])

    # 4. the whole windows around them
    joined = source.filter("doc_id is not null").join(wanted, "doc_id").select("doc_id", "sha", "shared", F.col("text").cast("binary").alias("text"))
    found = staged(joined.mapInArrow(windows, "doc_id long, sha binary, text binary, at array<int>, a array<bigint>, b array<bigint>"), "windows")
    each = found.select("doc_id", "sha", F.explode(F.arrays_zip("at", "a", "b")).alias("w")).select("doc_id", "sha", "w.at", "w.a", "w.b")
    owner = staged(each.groupBy("a", "b").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).filter("lo < hi").select("a", "b", "lo"), "owners")
    later = each.join(owner, ["a", "b"]).filter("doc_id > lo").groupBy("doc_id", "sha").agg(F.collect_set("at").alias("starts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, kept, spans = [], [], []
            for starts, t in zip(batch.column(2).to_pylist(), texts_of(batch, 3)):
                steps = np.zeros(len(t.split()) + 1, np.int64)
                at = np.array(starts)
                np.add.at(steps, at, 1)
                np.add.at(steps, at + WINDOW, -1)
                gone = np.cumsum(steps[:-1]) > 0
                edge = np.diff(np.concatenate(([0], gone.astype(np.int8), [0])))
                removed.append(int(gone.sum()))
                kept.append(digest_of(t, ~gone))
                spans.append([{"start": a, "end": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist())])
            kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(spans, kinds)], ["doc_id", "sha", "removed", "kept", "spans"])

    # 5. repeated windows merge into intervals
    cuts = later.join(found.select("doc_id", "sha", "text"), ["doc_id", "sha"]).select("doc_id", "sha", "starts", "text").mapInArrow(cut, "doc_id long, sha binary, removed long, kept binary, spans array<struct<start:long,end:long>>")
    cuts = staged(cuts.dropDuplicates(["doc_id", "sha"]), "cuts")
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_words").alias("end")))
    nothing = F.lit(hashlib.sha256(b"").digest())
    out = marked.select("doc_id", "n_words", "sha", "copy").join(cuts, ["doc_id", "sha"], "left")
    copy = F.coalesce("copy", F.lit(False))
    return out.select(
        "doc_id",
        "n_words",
        F.when(copy, F.col("n_words")).otherwise(F.coalesce("removed", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(copy, nothing).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
        F.when(copy, whole).otherwise(F.coalesce("spans", F.array().cast("array<struct<start:long,end:long>>"))).alias("spans"),
    )
