"""MinHash near-duplicates with sequential Bayesian verification.

Texts are sets of word shingles. Sets that share a band of their MinHash signatures meet in a bucket. Candidate pairs compare their signatures in batches of hashes:
after each batch, a pair whose similarity is large enough with a posterior probability under ``MISS`` is given up; the survivors are verified on
their full sets.

Buckets of one pivot, the least of their sets, are a cluster. The pivot meets every member, and what these links connect is not looked at again: a group of near
copies costs a pair for each member. What is left in a cluster of up to ``BLOCK`` members is verified in one task, which gets each set once. Larger clusters are divided before:
let y be a member that is not connected to the pivot c, with a shingles in c and u outside, and let x be another. Since x is no smaller than c, the union of x and y
has |c| + u - w members at least and their intersection a + w at most, where w is the number of shingles outside c that they share. So a link of
x and y needs 100 (a + w) >= percent (|c| + u - w), a number w of at least one that y knows by itself. So y goes on, with whatever shares them, in buckets of the shingles
outside c that it shares with members of other components, of all but w - 1 of them (the rarest). Of two linked members of different components one at least is such a y, so no
component is torn. A family of texts that have a template in common but are not near leaves nothing to compare, whatever its size. Where texts share parts beside the
template too, without being near, blocks of them are compared, all with all within what shares a part.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat
from math import comb, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread, staged, texts_of
from .graph import components
from .simhash import LOWER

SHINGLE_WORDS, PERCENT = 4, 80
#: A pair of similarity s shares no band with probability (1 - s**ROWS)**BANDS: 0.00000005 at 0.8.
BANDS, ROWS = 32, 4
#: Hashes of a signature, and of those that are compared at once.
HASHES, BATCH = BANDS * ROWS, 16
#: A pair is given up when, by the hashes seen, it is near with less than this probability (similarities being equally likely before).
MISS = 1e-6
#: What is kept of a hash: others are equal by chance once in 65,536 times, which lets a few pairs more go on.
KIND = np.dtype(np.uint16)
SEED = 42
#: Members, and shingles of their sets, that a task verifies at once, about; larger clusters are divided first.
BLOCK, BLOCK_SHINGLES = 256, 1 << 21
MULTIPLIERS = np.random.default_rng(SEED).integers(0, 1 << 64, (2, HASHES), np.uint64) | np.uint64(1)
CHUNK = 4096


def shingles(text: bytes, words: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the runs of ``words`` words, A-Z in lower case; a shorter text is one run, no word no run."""
    import xxhash

    split = text.translate(LOWER).split()  # bytes.split() splits at 0x20 and 0x09-0x0D, no others
    if not split:
        return np.zeros(0, np.uint64)
    joined = b" ".join(split)
    ends = np.cumsum(np.fromiter(map(len, split), np.int64, len(split)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(split))
    n = len(split) - k + 1
    runs = map(joined.__getitem__, map(slice, starts[:n].tolist(), ends[k - 1 :].tolist()))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n))


def key_of(found: np.ndarray) -> int:
    """A hash of a set of shingles as a signed integer."""
    import xxhash

    return int(np.uint64(xxhash.xxh64_intdigest(found.tobytes(), SEED)).view(np.int64))


def signature(found: np.ndarray) -> bytes | None:
    """The upper 16 bits of the least of ``HASHES`` hashes of the shingles; None for no shingle."""
    if not len(found):
        return None
    least = np.full(HASHES, (1 << 64) - 1, np.uint64)
    for i in range(0, len(found), CHUNK):
        np.minimum(least, (MULTIPLIERS[0][:, None] * found[None, i : i + CHUNK] + MULTIPLIERS[1][:, None]).min(axis=1), out=least)
    return (least >> np.uint64(48)).astype(KIND).tobytes()


def least_matches(percent: int, miss: float = MISS) -> list[int]:
    """For each number h of hashes compared, the least number of equal ones with which a pair goes on: with m of h equal and a uniform prior, the similarity
    is s or more with the probability that h + 1 draws of chance s give m or less."""
    s, out = percent / 100, []
    for h in range(BATCH, HASHES + 1, BATCH):
        below, m = 0.0, 0
        while m <= h:
            below += comb(h + 1, m) * s**m * (1 - s) ** (h + 1 - m)
            if below >= miss:
                break
            m += 1
        out.append(m)
    return out


def survivors(a: np.ndarray, b: np.ndarray, least: list[int]) -> np.ndarray:
    """Which rows of two arrays of signatures go on after all batches; a row that is given up is not looked at again."""
    alive, equal = np.arange(len(a)), np.zeros(len(a), np.int64)
    for i, m in enumerate(least):
        part = slice(i * BATCH, (i + 1) * BATCH)
        equal[alive] += (a[alive, part] == b[alive, part]).sum(axis=1)
        alive = alive[equal[alive] >= m]
    return alive


def identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))


def prints(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, text_hash, key, n, signature) of every row of (doc_id, text_hash, text): key, size and signature of its set of shingles."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in texts_of(batch, 2)]
            found = pa.array([key_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *found], ["doc_id", "text_hash", "key", "n", "signature"])

    return spread(docs).mapInArrow(rows, "doc_id long, text_hash long, key long, n int, signature binary")


def sets_of(docs: DataFrame, words: int) -> DataFrame:
    """(node, found, large): the set of shingles of every row of (text, large)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t, words) for t in texts_of(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([key_of(s) for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())), batch.column(1)], ["node", "found", "large"])

    return docs.select("text", "large").mapInArrow(rows, "node long, found array<long>, large boolean")


def likely(pairs: DataFrame, signatures: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """The (a, b) of ``pairs`` that their signatures do not rule out."""
    least = least_matches(percent, miss)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), KIND).reshape(-1, HASHES) for i in (2, 3))
            at = pa.array(survivors(x, y, least))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at)], ["a", "b"])

    of = lambda node, name: signatures.select(F.col("node").alias(node), F.col("signature").alias(name))
    return pairs.select("a", "b").join(of("a", "sa"), "a").join(of("b", "sb"), "b").select("a", "b", "sa", "sb").mapInArrow(rows, "a long, b long")


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (a, b) of ``pairs`` whose full sets have a similarity of ``percent`` or more."""
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("found").alias(name))
    both = pairs.join(of("a", "x"), "a").join(of("b", "y"), "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("shared"), (F.size("x") + F.size("y")).alias("n"))
    return both.filter(F.col("shared") * 100 >= (F.col("n") - F.col("shared")) * percent).select("a", "b")


def banded(distinct: DataFrame) -> DataFrame:
    """(bucket, node, n) for each band of each set (node, n, signature)."""
    bands = F.array(*(F.xxhash64(F.substring("signature", 1 + i * ROWS * KIND.itemsize, ROWS * KIND.itemsize), F.lit(i)) for i in range(BANDS)))
    return distinct.filter("n > 0").select("node", "n", F.explode(bands).alias("bucket"))


def clustered(members: DataFrame, bucket: list[str], percent: int) -> DataFrame:
    """(c, n_c, root_c, x, n, root): the ``members`` (*bucket, node, n, and root where it is not the node) of all buckets of which c, of n_c shingles, is the pivot: the least set, of these
    the least node. Without the pivot itself.

    A bucket is cut in classes of size, as wide as the sizes of near sets differ at most; each set is of its own class and the next, so near sets meet, and short texts do not gather
    around what they share with all others."""
    several = members.groupBy(*bucket).agg(F.count("*").alias("size")).filter("size > 1").select(*bucket)
    own = F.floor(F.log("n") / F.lit(log(100 / percent) * (1 + 1e-9) if percent < 100 else 1.0)).cast("int")
    sized = staged(members.join(several, bucket).withColumn("class", F.explode(F.array(own, own + 1))), "sized")
    cells, root = [*bucket, "class"], "root" if "root" in members.columns else "node"
    buckets = sized.groupBy(*cells).agg(F.count("*").alias("size"), F.min(F.struct(*dict.fromkeys(("n", "node", root)))).alias("least")).filter("size > 1").drop("size")
    met = sized.join(buckets, cells).filter(F.col("node") != F.col("least.node"))
    return met.groupBy(F.col("least.node").alias("c"), F.col("node").alias("x")).agg(F.first("least.n").alias("n_c"), F.first(f"least.{root}").alias("root_c"), F.first("n").alias("n"), F.first(root).alias("root"))


def with_roots(clusters: DataFrame, links: DataFrame) -> DataFrame:
    """``clusters`` (c, x, n) in which some member has no link (a, b) with its pivot: these are its probers (probe). Members of equal root are connected: all that are linked with one
    pivot, the least of those that they are linked with."""
    direct = links.select(F.col("a").alias("c"), F.col("b").alias("x"))
    roots = direct.groupBy("x").agg(F.min("c").alias("_root"))
    known = clusters.join(direct.withColumn("_done", F.lit(True)), ["c", "x"], "left").join(roots, "x", "left")
    known = staged(known.select("c", "x", "n", F.coalesce("_root", "x").alias("root"), F.col("_done").isNull().alias("probe")), "roots")
    return known.join(known.filter("probe").select("c").distinct(), "c", "left_semi")


def divided(clusters: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Buckets (c, s, node, n, root) of large ``clusters`` (c, x, n, root, probe), named by a pivot and a shingle outside it, in which every two members meet that may be linked and are
    not connected."""
    of = lambda node, name: sets.select(F.col("node").alias(node), F.col("found").alias(name))
    rest = clusters.join(of("x", "found"), "x").join(of("c", "pivot"), "c")
    rest = rest.select("c", "x", "n", "root", "probe", F.size("pivot").alias("n_c"), F.array_except("found", "pivot").alias("outside"))
    u = F.size("outside")
    need = F.greatest(F.lit(1), F.ceil((percent * (F.col("n_c") + u) - 100 * (F.col("n") - u)) / F.lit(100 + percent)).cast("int"))
    each = staged(rest.select("c", "x", "n", "root", "probe", need.alias("need"), F.explode("outside").alias("s")), "outside")
    sizes = each.groupBy("c", "s").agg(F.count("*").alias("size"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("c", "s", "size")
    # of the shingles that a prober shares with others, all but need - 1, the rarest first
    mine = each.filter("probe").join(staged(sizes, "sizes"), ["c", "s"]).groupBy("c", "x").agg(F.first("need").alias("need"), F.sort_array(F.collect_list(F.struct("size", "s"))).alias("shared"))
    asked = mine.filter(F.size("shared") >= F.col("need")).select("c", F.explode(F.slice("shared", F.lit(1), F.size("shared") - F.col("need") + 1)).alias("e"))
    asked = asked.select("c", F.col("e.s").alias("s")).distinct()
    return staged(each.join(asked, ["c", "s"]).select("c", "s", F.col("x").alias("node"), "n", "root"), "members")


def blocked(clusters: DataFrame) -> DataFrame:
    """(i, j, block, x, n, root): the members of each pair of blocks that a task verifies. A ``clusters`` (c, x, n, root) of up to ``BLOCK`` members is one block. Members of larger
    ones have a block each, whatever their number of clusters is, and two blocks meet once if some cluster has members of both: clusters that overlap, as those of a
    large group of like texts do, cost no more than one."""
    sizes = clusters.groupBy("c").agg((F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES)) > 1).alias("large"))
    marked = staged(clusters.join(sizes, "c"), "marked")
    small = marked.filter("not large").select(F.col("c").alias("i"), F.col("c").alias("j"), F.col("c").alias("block"), "x", "n", "root")
    large = marked.filter("large")
    # members go by the least pivot of their clusters, and these by the least of their members'
    least = large.groupBy("x").agg(F.min("c").alias("p"))
    beside = large.join(least, "x").groupBy("c").agg(F.min("p").alias("p"))
    place = large.join(beside, "c").groupBy("x").agg(F.min("p").alias("p"), F.first("n").alias("n"), F.first("root").alias("root"))
    number = place.groupBy("p").agg(F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES))).cast("int").alias("k"))
    place = staged(place.join(number, "p").select("x", "n", "root", F.xxhash64("p", F.pmod(F.xxhash64("x"), F.col("k"))).alias("block")), "blocks")
    held = large.select("c", "x").join(place.select("x", "block"), "x").select("c", "block").distinct()
    pairs = held.withColumnRenamed("block", "i").join(held.withColumnRenamed("block", "j"), "c").filter("i <= j").select("i", "j").distinct()
    sides = pairs.select("i", "j", F.explode(F.array_distinct(F.array("i", "j"))).alias("block"))
    return small.unionByName(sides.join(place, "block").select("i", "j", "block", "x", "n", "root"))


def verified(rows: DataFrame, signatures: DataFrame, sets: DataFrame, percent: int, miss: float = MISS) -> DataFrame:
    """(a, b): links that connect what is near among the ``blocked`` members, and is not of one root. A task gets each member's signature and set once, compares signatures in batches,
    and verifies the survivors that are not connected by then."""
    least = least_matches(percent, miss)
    full = rows.join(signatures.select(F.col("node").alias("x"), "signature"), "x").join(sets.select(F.col("node").alias("x"), "found"), "x")

    def links(table: pa.Table) -> pa.Table:
        i, j = table["i"][0].as_py(), table["j"][0].as_py()
        block, n, node = table["block"].to_numpy(), table["n"].to_numpy(), table["x"].to_pylist()
        signs = np.frombuffer(b"".join(table["signature"].to_pylist()), KIND).reshape(-1, HASHES)
        found = table["found"].combine_chunks()
        at, values = found.offsets.to_numpy(), found.values.to_numpy()
        group = np.unique(table["root"].to_numpy(), return_inverse=True)[1]
        left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
        out: tuple[list[int], list[int]] = [], []
        for p in left.tolist():
            others = right[right > p] if i == j else right
            others = others[(group[others] != group[p]) & (np.minimum(n[others], n[p]) * 100 >= np.maximum(n[others], n[p]) * percent)]
            for q in others[survivors(signs[others], np.broadcast_to(signs[p], (len(others), HASHES)), least)].tolist():
                if group[p] != group[q]:
                    shared = len(np.intersect1d(values[at[p] : at[p + 1]], values[at[q] : at[q + 1]], assume_unique=True))
                    if shared * 100 >= (int(n[p]) + int(n[q]) - shared) * percent:
                        group[group == group[q]] = group[p]
                        out[0].append(node[p])
                        out[1].append(node[q])
        return pa.table({"a": pa.array(out[0], pa.int64()), "b": pa.array(out[1], pa.int64())})

    return full.groupBy("i", "j").applyInArrow(links, "a long, b long")


def connected(docs: DataFrame, distinct: DataFrame, words: int, percent: int, miss: float = MISS) -> DataFrame:
    """(node, root) of the linked nodes of ``distinct`` (node, first, n, signature), one row for each set of shingles of ``docs`` (doc_id, text_hash, text)."""
    alike = F.least("n", "n_c") * 100 >= F.greatest("n", "n_c") * percent
    as_pairs = lambda clusters: clusters.filter(alike).select(F.col("c").alias("a"), F.col("x").alias("b"))
    as_edges = lambda links: links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    ends = lambda rows, a, b: rows.select(F.explode(F.array(a, b)).alias("node"))
    # with the pivot: as members of a block
    whole = lambda clusters: clusters.select("c", "x", "n", "root").unionByName(clusters.groupBy("c").agg(F.first("n_c").alias("n"), F.first("root_c").alias("root")).select("c", F.col("c").alias("x"), "n", "root"))

    clusters = staged(clustered(banded(distinct), ["bucket"], percent), "clusters")
    clusters = staged(clusters.join(clusters.groupBy("c").agg(F.count("*").alias("size")), "c"), "clusters")
    signatures = staged(distinct.join(ends(clusters, "c", "x").distinct(), "node", "left_semi").select("node", "signature"), "signatures")
    single, small, large = clusters.filter("size = 1"), clusters.filter(F.col("size").between(2, BLOCK - 1)), clusters.filter(F.col("size") >= BLOCK)
    near = staged(likely(as_pairs(single), signatures, percent, miss), "likely")
    single = single.join(near.select(F.col("a").alias("c"), F.col("b").alias("x")), ["c", "x"], "left_semi")
    # the sets that are verified, from the texts
    involved = ends(single, "c", "x").unionByName(ends(small, "c", "x")).withColumn("large", F.lit(False)).unionByName(ends(large, "c", "x").withColumn("large", F.lit(True)))
    places = distinct.select("node", "first").join(involved.groupBy("node").agg(F.max("large").alias("large")), "node").select(F.col("first.doc_id").alias("id"), F.col("first.text_hash").alias("hash"), "large")
    wanted = docs.join(places, (F.col("text_hash") == F.col("hash")) & F.col("doc_id").eqNullSafe(F.col("id")))
    sets = staged(sets_of(wanted, words).dropDuplicates(["node"]), "sets")
    blocks, edges = whole(single).unionByName(whole(small)), None
    if not large.isEmpty():
        own = sets.filter("large")
        edges = staged(linked(likely(as_pairs(large), signatures, percent, miss), own, percent), "links")
        parts = divided(with_roots(large, edges), own, percent)
        blocks = blocks.unionByName(whole(staged(clustered(parts, ["c", "s"], percent), "clusters")))
    found = staged(verified(blocked(blocks), signatures, sets.drop("large"), percent, miss), "links")
    return components(as_edges(found if edges is None else edges.unionByName(found)))


def classes(docs: DataFrame, words: int = SHINGLE_WORDS, percent: int = PERCENT, miss: float = MISS) -> DataFrame:
    """(doc_id, text_hash, n, stays) of every row of ``docs`` (doc_id, text_hash, text): the size of its set, and the least (no_id, doc_id, text_hash) that links
    reach; a pair is given up by ``miss``. Equal sets are of one class, the empty one too. Rows repeat where ``docs`` does; those without doc_id come last in a class."""
    small_batches(docs.sparkSession)
    found = staged(prints(docs, words), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")
    # sets of equal key are equal, and so are their sizes and signatures
    distinct = staged(found.groupBy(F.col("key").alias("node")).agg(F.min(place).alias("first"), F.count("*").alias("rows"), F.first("n").alias("n"), F.first("signature").alias("signature")), "distinct")
    roots = connected(docs, distinct, words, percent, miss)
    roots = distinct.select("node", "first", "rows").join(roots, "node", "left").select("node", "first", "rows", F.coalesce("root", "node").alias("root"))
    least = roots.groupBy("root").agg(F.min("first").alias("stays"), F.sum("rows").alias("of"))
    label = staged(roots.join(least, "root").filter("of > 1").select(F.col("node").alias("key"), "stays"), "labels")
    return found.select("doc_id", "text_hash", "key", "n", place.alias("own")).join(label, "key", "left").select("doc_id", "text_hash", "n", F.coalesce("stays", "own").alias("stays"))


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = SHINGLE_WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for every row of ``docs``: the size of its set, the least doc_id that links reach, and whether that is its own.

    Texts are taken whole; one of fewer words than a shingle is a single run of them. Null, empty and blank texts have no shingles and are linked with nothing: each is its own
    component. Rows that repeat a doc_id and text come out repeated, each with the same result; texts of one doc_id are linked by their similarity alone. A row without doc_id links
    like any other, gets its component's id, null if no row of it has one, and is kept only then. Other columns take no part."""
    found = classes(identified(docs, doc_id, text), words, percent)
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("stays.doc_id"))
    return found.select("doc_id", F.col("n").cast("long").alias("n_shingles"), component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
