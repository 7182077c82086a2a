"""SimHash near-duplicates by multi-index hashing.

A fingerprint has two segments of 32 bits. A table holds every fingerprint under the value of each of its segments. Two fingerprints that
differ in at most two bits are equal in one segment or differ in one bit of each; so it is enough to look up a ball of radius one around the first segment and a ball of
radius zero around the second (the radii that multi-index hashing gives to two segments at this distance), to fetch what the table holds there, and to
verify complete distances. Of two values one bit apart, the one with the bit unset looks up the other.

The segments of near copies are often equal, so that a bucket of the table may hold a whole group of them. A bucket of more than ``SMALL`` fingerprints is not
compared with those that look it up: it becomes a table of its own, by the same rule, whose segments are the halves of the bits that are still free: 16 and then 8 wide. Buckets then hold 256
fingerprints at most, whatever the data, and no pair within the distance is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, spread, staged, texts_of
from .graph import components

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
SHINGLE_WORDS = 3
SEED = 42
DISTANCE = 2
#: Bits of a segment: of the table, of its full buckets, and of theirs.
SEGMENTS = (32, 16, 8)
#: Fingerprints of a bucket that are compared with all that look it up.
SMALL = 8


def fingerprint(text: bytes, words: int = SHINGLE_WORDS) -> int:
    """The fingerprint of UTF-8 text as an unsigned integer."""
    import xxhash

    split = text.translate(LOWER).split()  # bytes.split() splits at 0x20 and 0x09-0x0D, no others
    if not split:
        return 0
    joined = b" ".join(split)
    lengths = np.fromiter(map(len, split), np.int64, len(split)) + 1
    ends = np.cumsum(lengths) - 1
    starts = ends - lengths + 1
    k = min(words, len(split))
    slices = map(slice, starts[: len(split) - k + 1].tolist(), ends[k - 1 :].tolist())
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, map(joined.__getitem__, slices), repeat(SEED)), np.uint64, len(split) - k + 1)
    set_in = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(set_in * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp long) for every row: the fingerprint's 64 bits as a signed integer. A null text counts as empty."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch, 1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps)], ["doc_id", "fp"])

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))).mapInArrow(rows, "doc_id long, fp long")


def links(distinct: DataFrame, small: int = SMALL) -> DataFrame:
    """(a, b), a > b: all pairs of distinct fingerprints (column fp) that differ in at most ``DISTANCE`` bits.

    A bucket is named by the lowest of its free bits (low) and the value of the others, the free ones zero."""
    ones = lambda width, low: F.call_function("shiftleft", F.lit((1 << width) - 1).cast("long"), low)
    entries = distinct.select("fp", F.lit(0).alias("low"))
    asked = distinct.select("fp", F.lit(0).alias("low"), F.col("fp").alias("point"))
    found = None
    for width in SEGMENTS:
        # halves of the free bits: with the lower one fixed, the upper one is free, and the other way round
        bucket = lambda point, low, width=width: F.struct(low.alias("low"), point.bitwiseAND(F.bitwise_not(ones(width, low))).alias("value"))
        upper, lower = F.col("low") + width, F.col("low")
        both = F.array(bucket(F.col("fp"), upper), bucket(F.col("fp"), lower))
        table = staged(entries.select("fp", F.explode(both).alias("b")).select("fp", "b.low", "b.value"), "table")
        sizes = table.groupBy("low", "value").agg(F.count("*").alias("size"))
        # a point is the fingerprint with the bits that a ball has set; what is left of the distance is for the free bits
        left = DISTANCE - F.bit_count(F.col("point").bitwiseXOR(F.col("fp")))
        none = F.filter(both, lambda _: F.lit(False))
        unset = F.filter(F.sequence(lower, upper - 1), lambda i: F.col("point").bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i)) == 0)
        ball = F.transform(unset, lambda i: F.struct(upper.alias("low"), bucket(F.col("point").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)), upper)["value"].alias("value")))
        wanted = F.concat(F.array(bucket(F.col("point"), upper)), F.when(left >= 1, F.array(bucket(F.col("point"), lower))).otherwise(none), F.when(left >= 2, ball).otherwise(none))
        asks = asked.select("fp", F.explode(wanted).alias("b")).select("fp", "b.low", "b.value")
        # the free bits of a point are the fingerprint's own
        met = asks.join(sizes, ["low", "value"]).withColumn("point", F.col("value").bitwiseOR(F.col("fp").bitwiseAND(ones(width, F.col("low")))))
        met = staged(met.filter((F.col("size") > 1) | (F.col("point") != F.col("fp"))), "met")
        compared = F.col("size") <= small if width != SEGMENTS[-1] else F.lit(True)
        pairs = met.filter(compared).join(table.select(F.col("fp").alias("other"), "low", "value"), ["low", "value"])
        near = (F.col("fp") != F.col("other")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other"))) <= DISTANCE)
        pairs = pairs.filter(near).select(F.greatest("fp", "other").alias("a"), F.least("fp", "other").alias("b")).distinct()
        found = pairs if found is None else found.unionByName(pairs)
        full = met.filter(~compared)
        if full.isEmpty():
            break
        entries = table.join(sizes.filter(F.col("size") > small).select("low", "value"), ["low", "value"]).select("fp", "low")
        asked = full.select("fp", "low", "point")
    return found.distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``.

    component_id is the least doc_id that links of at most two differing bits reach. Texts without words (null, empty,
    blank) have fingerprint zero and are linked like any other. Repeated rows come out repeated; a row without doc_id gets its component's id, null if
    no row of it has one. Other columns of ``docs`` take no part."""
    fps = staged(fingerprints(docs, doc_id, text), "fingerprints")
    distinct = staged(fps.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")), "distinct")
    found = components(links(distinct.select("fp")))
    linked = distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", "n", F.coalesce("root", "fp").alias("root"))
    least = linked.groupBy("root").agg(F.min("first").alias("component_id"), F.count("*").alias("fps"))
    label = linked.join(least, "root").filter((F.col("n") > 1) | (F.col("fps") > 1)).select("fp", "component_id")
    label = staged(label, "labels")
    out = fps.join(label, "fp", "left")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` without near copies of other documents, by five-word shingles and not by the two bits of this module's contract."""
    from . import near_copies

    return near_copies.keep_one(docs)
