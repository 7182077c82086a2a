"""Periodic runs of words, by block matching.

A run of period q and at least three periods holds, for the power of two B with B <= q < 2B (8 for all shorter periods), a block of B words that begins at a
multiple of B and occurs once more q words on. So the aligned blocks of each size are searched across the document by one Aho-Corasick automaton over
word numbers; an occurrence at a distance that suits its block's size is a seed, and is extended word by word to both sides. Blocks with a word that
occurs fewer than three times in the document lie in no run and are not searched.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, texts_of

#: A run has so many words at least, and so many periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Words of the shortest blocks: such a block and its repetition fit in ``LEAST_WORDS`` words with any period up to theirs.
LEAST_BLOCK = 8
#: Words compared at once when a seed is extended; four times as many each time.
STRIDE = 64
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbered(words: list[bytes]) -> np.ndarray:
    """Each word as the number of its first occurrence."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))


def blocks(ids: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(size, starts) of the aligned blocks that may lie in a run, by size."""
    often = np.bincount(ids) >= LEAST_PERIODS
    common = np.concatenate(([0], np.cumsum(often[ids])))
    size = LEAST_BLOCK
    while size == LEAST_BLOCK or size * LEAST_PERIODS <= len(ids):
        starts = np.arange(0, len(ids) - size + 1, size)
        starts = starts[common[starts + size] - common[starts] == size]
        if not len(starts):  # larger blocks consist of these
            return
        yield size, starts
        size *= 2


def seeds(ids: np.ndarray) -> list[tuple[int, int]]:
    """(period, start), sorted: blocks found again at a distance that suits their size."""
    import ahocorasick

    sizes = list(blocks(ids))
    if not sizes:
        return []
    automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    listed = ids.tolist()
    numbers, which = 0, [np.full(len(ids) // size + 1, -1, np.int64) for size, _ in sizes]
    for (size, starts), block in zip(sizes, which):
        for s in starts.tolist():
            key = tuple(listed[s : s + size])
            number = automaton.get(key, -1)
            if number < 0:
                number, numbers = numbers, numbers + 1
                automaton.add_word(key, number)
            block[s // size] = number
    automaton.make_automaton()
    size_of = np.zeros(numbers, np.int64)
    for (size, _), block in zip(sizes, which):
        size_of[block[block >= 0]] = size
    met = np.array(list(automaton.iter(tuple(listed))), np.int64).reshape(-1, 2)
    ends, number = met[:, 0] + 1, met[:, 1]
    out = []
    for (size, _), block in zip(sizes, which):
        mine = size_of[number] == size
        at, n = ends[mine] - size, number[mine]
        # the aligned blocks that begin size to 2 size - 1 words before; for the shortest, 1 to 2 size - 1
        for back in range(2 if size == LEAST_BLOCK else 1):
            start = ((at - 1) // size if size == LEAST_BLOCK else (at - size) // size) - back
            period = at - start * size
            fits = (start >= 0) & (period < 2 * size)
            fits[fits] = block[start[fits]] == n[fits]
            out.append(np.stack((period[fits], start[fits] * size), axis=1))
    return sorted(map(tuple, np.concatenate(out).tolist()))


def extent(ids: np.ndarray, at: int, q: int) -> tuple[int, int]:
    """The longest span [start, end) around the word ``at`` in which words ``q`` apart are equal."""
    right, stride = at, STRIDE
    while right + q < len(ids):
        differ = ids[right : right + stride][: len(ids) - q - right] != ids[right + q : right + q + stride]
        if differ.any():
            right += int(differ.argmax())
            break
        right += len(differ)
        stride *= 4
    left, stride = at, STRIDE
    while left > 0:
        low = max(0, left - stride)
        differ = (ids[low:left] != ids[low + q : left + q])[::-1]
        if differ.any():
            left -= int(differ.argmax())
            break
        left = low
        stride *= 4
    return left, right + q


def smallest(ids: np.ndarray, q: int) -> bool:
    """Whether a span that repeats its first ``q`` words has no shorter period: it would divide ``q``."""
    rest, factor = q, 2
    while rest > 1:
        if rest % factor and factor * factor <= rest:
            factor += 1
            continue
        prime = factor if rest % factor == 0 else rest
        p = q // prime
        if (ids[: q - p] == ids[p:q]).all():
            return False
        while rest % prime == 0:
            rest //= prime
    return True


def runs(words: list[bytes]) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs, by start and then period."""
    if len(words) < LEAST_WORDS:
        return []
    ids, out, last = numbered(words), [], (0, 0)
    for q, at in seeds(ids):
        if last[0] == q and at < last[1] - q:  # within the span before
            continue
        start, end = extent(ids, at, q)
        last = q, end
        if end - start >= max(LEAST_WORDS, LEAST_PERIODS * q) and smallest(ids[start : start + q], q):
            out.append((start, end - start, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> bytes:
    """The text without what follows the first period of each run."""
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        steps[start + period] += 1
        steps[start + length] -= 1
    keep = np.cumsum(steps[:-1]) == 0
    return b" ".join([words[i] for i in np.flatnonzero(keep).tolist()])


def find_runs(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_words, runs, collapsed) for every row: the runs (start, length, period) by start and period, and the text without repetitions, its words joined by blanks.

    Words are [^\\x20\\x09-\\x0D]+ of the whole text. A null or blank text has no word, no run and an empty text; repeated rows come out repeated; doc_id may
    be null. Each document is searched by itself, in memory that grows with its words times their logarithm. Other columns take no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        for batch in batches:
            n, found, texts = [], [], []
            for t in texts_of(batch, 1):
                words = t.split()  # bytes.split() splits at 0x20 and 0x09-0x0D, no others
                r = runs(words)
                n.append(len(words))
                found.append([{"start": a, "length": b, "period": c} for a, b, c in r])
                texts.append(collapsed(words, r).decode())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return spread(source).mapInArrow(rows, f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def strongest(found: Column) -> Column:
    """Of an array of runs, the one of greatest length/period, of these of least start, then period; null for none."""
    def better(a: Column, b: Column) -> Column:
        x, y = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(a.isNull() | (y > x) | ((y == x) & (F.struct(b["start"], b["period"]) < F.struct(a["start"], a["period"]))), b).otherwise(a)

    return F.aggregate(found, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def report(docs: DataFrame) -> DataFrame:
    """``find_runs`` as digests: (doc_id, n_runs, start, length, period, exponent_milli, runs_sha256, collapsed_sha256)."""
    best = strongest(F.col("runs"))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return find_runs(docs).withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(F.expr("1000 * best.length div best.period")).cast("long").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def planted(docs: DataFrame) -> DataFrame:
    """(doc_id, text) with runs planted in about a tenth of the texts, by a hash of doc_id: from word a = g % n on, the text repeats its next p = 1 + (n - a) div (3 + g % 8)
    words to its end. The others, and rows without doc_id, stay as they are."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    rows = docs.select("doc_id", "text", (h % 10 == 0).alias("chosen"), F.floor(h / 10).cast("long").alias("g"))
    rows = rows.withColumn("words", F.when(F.col("chosen"), F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")))
    rows = rows.withColumn("n", F.size("words").cast("long")).withColumn("a", F.when(F.col("n") > 0, F.expr("g % n"))).withColumn("p", F.expr("1 + (n - a) div (3 + g % 8)"))
    periodic = F.concat(F.expr("slice(words, 1, cast(a as int))"), F.expr("transform(sequence(a, n - 1), i -> element_at(words, cast(1 + a + (i - a) % p as int)))"))
    return rows.select("doc_id", F.when(F.col("a").isNotNull(), F.array_join(periodic, " ")).otherwise(F.col("text")).alias("text"))
