"""Toxicity: a convolutional text classifier trained in numpy, with thresholds calibrated by language.

Words are hashed to embeddings; filters one, two and three words wide run over the whole text and each keeps its
maximum; a logistic unit weighs these. The threshold of a language (as the text itself shows it, by the profiles of
language.py) is where the calibration part of the labelled rows is decided best; scores are shifted so that it lies at one half.

Every labelled row that is not held out takes part. They are dealt out to shards of bounded size by a hash of doc_id. In each epoch a task for each shard goes on from the
common network over its rows, and the changes are averaged by Spark, each row of weights over the shards that moved it. Word counts and the counts of
calibration are aggregates over all rows. The driver holds the network alone, which ``BUCKETS`` bounds.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import language
from .common import bounded_sample, dropped, headed_hashes, held_out, mix64, small_batches, spread, staged

#: Labelled rows of a shard, and bytes of their texts, about.
SHARD_ROWS, SHARD_BYTES = 8000, 16 << 20
#: Rows of weights that are averaged at once; cells to a unit of a logit, and the largest logit, that calibration tells apart.
BLOCK, CELLS, MOST = 512, 1024, 32
BUCKETS = 1 << 18
DIMENSIONS = 12
#: A word's embedding is the sum of its own and of those of its first so many bytes.
HEADS = (6,)
WIDTHS = (1, 2, 3)
FILTERS = 12
#: Buckets met in fewer texts of the sample share one fixed embedding of zero.
LEAST_TEXTS = 8
EPOCHS, BATCH, RATE, SEED = 4, 32, 0.01, 5
#: Positive calibration texts that a language needs for a threshold of its own.
LEAST_POSITIVE = 25
#: Blanks for whatever ASCII is no letter; the bytes of other characters stay.
LETTERS_ONLY = bytes(c if c > 127 or chr(c).isalpha() else 0x20 for c in range(256))
#: Bytes of texts that are hashed at once.
HASHED_AT_ONCE = 1 << 17


def buckets(text: str | None) -> np.ndarray:
    """For each word of a text, the buckets of the word and of its beginnings. Words are in lower case, split at whatever ASCII is
    no letter."""
    return all_buckets([text])[0]


def all_buckets(texts: list[str | None]) -> list[np.ndarray]:
    """``buckets`` of each text, some of them hashed at once."""
    out: list[np.ndarray] = []
    held, size = [], 0
    for i, text in enumerate(texts):
        held.append((text or "").lower().encode("utf-8", "replace").translate(LETTERS_ONLY))
        size += len(held[-1])
        if size > HASHED_AT_ONCE or i == len(texts) - 1:
            starts, found = headed_hashes(b" ".join(held), (None, *HEADS))
            hashes = [mix64(h + np.uint64(k)) for k, h in enumerate(found)]
            rows = (np.stack(hashes, axis=1) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)
            out += np.split(rows, np.searchsorted(starts, np.cumsum([len(x) + 1 for x in held])[:-1]))
            held, size = [], 0
    return out


class Network:
    def __init__(self, rows_of: np.ndarray, embedding: np.ndarray, filters: list[np.ndarray], bias: np.ndarray, out: np.ndarray, out_bias: float):
        self.rows_of, self.embedding, self.filters, self.bias, self.out, self.out_bias = rows_of, embedding, filters, bias, out, out_bias
        self.tables: list[list[np.ndarray]] = []
        self.cuts: dict[str, float] = {}
        self.cut = 0.0
        self.profiles = language.Profiles([], np.zeros((0, language.DIMENSIONS)))

    def __getstate__(self) -> dict:
        """Without the tables, and of the buckets only those that have a row."""
        kept = np.flatnonzero(self.rows_of)
        return self.__dict__ | {"rows_of": (kept.astype(np.int32), self.rows_of[kept].astype(np.int32)), "tables": None, "embedding": self.embedding.astype(np.float32)}

    def __setstate__(self, state: dict) -> None:
        self.__dict__ |= state
        kept, rows = state["rows_of"]
        self.rows_of = np.zeros(BUCKETS, np.int64)
        self.rows_of[kept] = rows
        self.ready()

    def ready(self, used: slice | np.ndarray = slice(None)) -> None:
        """A filter's response to a word at each of its places, for all words or those ``used``: a convolution is then a sum
        of look-ups."""
        rows = self.embedding[used]
        self.tables = [[(rows @ w[j]).astype(np.float32) for j in range(len(w))] for w in self.filters]

    def pooled(self, texts: list[np.ndarray], where: bool = False):
        """Maxima of all filters over each text (rows of the embedding in, padded by blanks on both sides) and their places."""
        pad = max(WIDTHS)
        lengths = np.array([len(t) + pad for t in texts])
        starts = np.cumsum(lengths) - lengths
        words = np.zeros((int(lengths.sum()) + pad, 1 + len(HEADS)), np.int64)
        for s, t in zip(starts.tolist(), texts):
            words[s + pad - 1 : s + pad - 1 + len(t)] = t  # so far in that no window of one text reaches another
        maxima, places = [], []
        n = int(lengths.sum())
        for tables in self.tables:
            r = sum(t[words[j : j + n, k]] for j, t in enumerate(tables) for k in range(words.shape[1]))
            maxima.append(np.maximum.reduceat(r, starts, axis=0))
            if where:
                places.append(np.stack([s + r[s : s + k].argmax(axis=0) for s, k in zip(starts.tolist(), lengths.tolist())]))
        found = np.concatenate(maxima, axis=1) + self.bias
        return (found, places, words) if where else found

    def logits(self, texts: list[str | None]) -> np.ndarray:
        found = self.pooled([self.rows_of[b] for b in all_buckets(texts)])
        return np.maximum(found, 0) @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Scores in 0..1; the threshold of each text's language is at one half."""
        if not texts:
            return np.zeros(0)
        logits, out = [], 0
        while out < len(texts):  # so few at once that their responses stay in the processor's cache
            n, size = 0, 0
            while out + n < len(texts) and (n == 0 or size < 200_000):
                size += len(texts[out + n] or "")
                n += 1
            logits.append(self.logits(texts[out : out + n]))
            out += n
        cuts = np.array([self.cuts.get(lang, self.cut) for lang in self.profiles.all_nearest([t or "" for t in texts])] if self.cuts else self.cut)
        return 1 / (1 + np.exp(-np.clip(np.concatenate(logits) - cuts, -30, 30)))


def begun(kept: np.ndarray, n_in: np.ndarray, n_pos: np.ndarray, rate: float) -> Network:
    """The network before it is trained: of the ``kept`` buckets, the texts that they are in and how many of these are toxic; of all texts, the share that is."""
    rng = np.random.default_rng(SEED)
    rows_of = np.zeros(BUCKETS, np.int64)
    rows_of[kept] = np.arange(1, len(kept) + 1)
    embedding = rng.normal(0, 0.1, (len(kept) + 1, DIMENSIONS))
    # the first dimension starts as the word's own log-odds
    embedding[1:, 0] = np.clip(np.log((n_pos + 2 * rate + 1e-3) / (n_in - n_pos + 2 * (1 - rate) + 1e-3)) - np.log((rate + 1e-3) / (1 - rate + 1e-3)), -2, 3)
    embedding[0] = 0
    filters = [rng.normal(0, 0.3, (w, DIMENSIONS, FILTERS)) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
    return Network(rows_of, embedding, filters, np.full(len(WIDTHS) * FILTERS, -0.5), rng.normal(0, 0.1, len(WIDTHS) * FILTERS) + 0.1, float(np.log((rate + 1e-3) / (1 - rate + 1e-3))))


class Descent:
    """Epochs over some texts (rows of the embedding) and their labels, with the moments of the weights."""

    def __init__(self, net: Network, data: list[np.ndarray], labels: np.ndarray, seed: tuple[int, ...] = (SEED,)):
        self.net, self.data, self.labels, self.rng = net, data, labels, np.random.default_rng(seed)
        self.moments: dict[str, list[np.ndarray]] = {}
        self.steps, self.spread = 0, np.full(len(net.embedding), 1e-3)

    def adam(self, name: str, value: np.ndarray, gradient: np.ndarray) -> np.ndarray:
        m = self.moments.setdefault(name, [np.zeros_like(value), np.zeros_like(value)])
        m[0] = 0.9 * m[0] + 0.1 * gradient
        m[1] = 0.999 * m[1] + 0.001 * gradient**2
        return value - RATE * (m[0] / (1 - 0.9**self.steps)) / (np.sqrt(m[1] / (1 - 0.999**self.steps)) + 1e-8)

    def epoch(self) -> None:
        """Gradients reach only the words at which filters have their maxima."""
        net, order = self.net, self.rng.permutation(len(self.data))
        for at in range(0, len(order), BATCH):
            pick = order[at : at + BATCH]
            self.steps += 1
            g = gradients(net, [self.data[i] for i in pick], self.labels[pick])
            net.filters = [self.adam(f"f{k}", f, d + 1e-5 * f) for k, (f, d) in enumerate(zip(net.filters, g["filters"]))]
            net.bias = self.adam("bias", net.bias, g["bias"])
            net.out, net.out_bias = self.adam("out", net.out, g["out"] + 1e-4 * net.out), float(self.adam("out_bias", np.array(net.out_bias), g["out_bias"]))
            some, total = g["rows"], g["embedding"]
            self.spread[some] += (total**2).sum(axis=1)
            net.embedding[some] -= 0.05 * total / np.sqrt(self.spread[some])[:, None]


def counted(hashed: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each bucket, the texts that it is in, and how many of these are toxic."""
    n_in, n_pos = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
    for h, y in zip(hashed, labels):
        seen = np.unique(h)
        n_in[seen] += 1
        n_pos[seen] += int(y)
    return n_in, n_pos


def train(texts: list[str | None], labels: np.ndarray) -> Network:
    """Fit the network to a few labelled texts, here and now."""
    hashed = all_buckets(texts)
    n_in, n_pos = counted(hashed, labels)
    kept = np.flatnonzero(n_in >= LEAST_TEXTS)
    net = begun(kept, n_in[kept], n_pos[kept], float(labels.mean()) if len(labels) else 0.0)
    descent = Descent(net, [net.rows_of[h] for h in hashed], labels)
    for _ in range(EPOCHS):
        descent.epoch()
    net.ready()
    return net


def gradients(net: Network, batch: list[np.ndarray], labels: np.ndarray) -> dict:
    """Of the mean log-loss of some texts, by all weights; of the embedding, for the ``rows`` that it reaches (never the fixed row 0)."""
    used, numbered = np.unique(np.concatenate([np.zeros((1, 1 + len(HEADS)), np.int64), *batch]), return_inverse=True)
    net.ready(used)
    found, places, words = net.pooled(np.split(numbered.reshape(-1, 1 + len(HEADS))[1:], np.cumsum([len(b) for b in batch])[:-1]), where=True)
    words = used[words]
    active = np.maximum(found, 0)
    p = 1 / (1 + np.exp(-np.clip(active @ net.out + net.out_bias, -30, 30)))
    wrong = (p - labels) / len(batch)
    back = wrong[:, None] * net.out[None, :] * (found > 0)
    rows, parts, filters = [], [], []
    for k, (w, f) in enumerate(zip(WIDTHS, net.filters)):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        own = np.zeros_like(f)
        for j in range(w):
            for kind in range(words.shape[1]):
                at = words[places[k] + j, kind]  # text x filter
                own[j] += np.einsum("tfd,tf->df", net.embedding[at], g)
                rows.append(at.reshape(-1))
                parts.append((g[:, :, None] * f[j].T[None, :, :]).reshape(-1, DIMENSIONS))
        filters.append(own)
    some, inverse = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.zeros((len(some), DIMENSIONS))
    np.add.at(total, inverse, np.concatenate(parts))
    total[some == 0] = 0
    return {"filters": filters, "bias": back.sum(axis=0), "out": active.T @ wrong, "out_bias": wrong.sum(), "rows": some, "embedding": total}


def best_cut(logits: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> float:
    """The middle of the gap between logits at which F1 is greatest, of ``n`` rows at each of them, ``toxic`` of which are so."""
    order = np.argsort(-logits, kind="stable")
    f1 = 2 * np.cumsum(toxic[order]) / (np.cumsum(n[order]) + toxic.sum())
    i = int(f1.argmax())
    below = logits[order[i + 1]] if i + 1 < len(order) else logits[order[i]] - 1
    return float((logits[order[i]] + below) / 2)


def calibrate(net: Network, rows: DataFrame) -> None:
    """Set the thresholds from rows (lang, toxic, words) that the fit has not seen, counted by language and cells of their logits; languages with few positives take the common one."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_ = sent.value
        for batch in batches:
            found = [float(np.maximum(net_.pooled([net_.rows_of[unpacked(w)]]), 0)[0] @ net_.out + net_.out_bias) for w in batch.column(2).to_pylist()]
            cell = np.floor(np.clip(found, -MOST, MOST) * CELLS).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cell), batch.column(1)], ["lang", "cell", "toxic"])

    counts = rows.select("lang", "toxic", "words").mapInArrow(cells, "lang string, cell int, toxic int").groupBy("lang", "cell").agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic"))
    found = counts.orderBy("lang", "cell").collect()  # at most so many cells a language
    langs, cell, n, toxic = (np.array([r[k] for r in found]) for k in range(4))
    if not toxic.sum():
        return
    logits = (cell + 0.5) / CELLS
    net.cut = best_cut(*_merged(logits, n, toxic))
    for name in np.unique(langs):
        own = langs == name
        if toxic[own].sum() >= LEAST_POSITIVE:
            net.cuts[str(name)] = best_cut(logits[own], n[own], toxic[own])


def _merged(logits: np.ndarray, n: np.ndarray, toxic: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Equal logits of several languages as one."""
    some, at = np.unique(logits, return_inverse=True)
    return some, np.bincount(at, n), np.bincount(at, toxic)


def unpacked(words: bytes) -> np.ndarray:
    """The buckets that ``hashed`` wrote down."""
    return np.frombuffer(zlib.decompress(words), np.int32).reshape(-1, 1 + len(HEADS)).astype(np.int64)


def hashed(rows: DataFrame, profiles: language.Profiles) -> DataFrame:
    """(doc_id, toxic, apart, bytes, lang, words) of rows (doc_id, toxic, text): whether they are for the thresholds, then also the language as the text shows it, and the text's length."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, apart = batch.column(4).to_pylist(), batch.column(2).to_pylist()
            nearest = iter(profiles.all_nearest([t or "" for t, a in zip(texts, apart) if a]))
            langs = [next(nearest) if a else None for a in apart]
            words = [zlib.compress(b.astype(np.int32).tobytes(), 1) for b in all_buckets(texts)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(langs, pa.string()), pa.array(words, pa.binary())], ["doc_id", "toxic", "apart", "bytes", "lang", "words"])

    wanted = rows.select("doc_id", "toxic", (F.pmod(F.col("doc_id"), F.lit(4)) == 3).alias("apart"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "text")
    return wanted.mapInArrow(of, "doc_id long, toxic int, apart boolean, bytes long, lang string, words binary")


def word_counts(rows: DataFrame) -> DataFrame:
    """(bucket, n_in, n_pos) of rows (toxic, words): buckets in ``LEAST_TEXTS`` of them or more."""

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n_in, n_pos = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            more = counted([unpacked(w) for w in batch.column(1).to_pylist()], batch.column(0).to_numpy())
            n_in, n_pos = n_in + more[0], n_pos + more[1]
        some = np.flatnonzero(n_in)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n_in[some]), pa.array(n_pos[some])], ["bucket", "n_in", "n_pos"])

    parts = rows.select("toxic", "words").mapInArrow(of, "bucket int, n_in long, n_pos long")
    return parts.groupBy("bucket").agg(F.sum("n_in").alias("n_in"), F.sum("n_pos").alias("n_pos")).filter(F.col("n_in") >= LEAST_TEXTS)


def weights(net: Network) -> np.ndarray:
    """All weights as rows of ``DIMENSIONS``, the embedding's first."""
    rest = np.concatenate([*(f.ravel() for f in net.filters), net.bias, net.out, [net.out_bias]])
    return np.concatenate([net.embedding.ravel(), rest, np.zeros(-len(rest) % DIMENSIONS)]).reshape(-1, DIMENSIONS).astype(float)


def with_weights(net: Network, rows: np.ndarray) -> Network:
    """A network of ``net``'s words with these weights."""
    n, wide = len(net.embedding), len(WIDTHS) * FILTERS
    rest, at, filters = rows[n:].ravel(), 0, []
    for w in WIDTHS:
        filters.append(rest[at : at + w * DIMENSIONS * FILTERS].reshape(w, DIMENSIONS, FILTERS).copy())
        at += w * DIMENSIONS * FILTERS
    return Network(net.rows_of, rows[:n].copy(), filters, rest[at : at + wide].copy(), rest[at + wide : at + 2 * wide].copy(), float(rest[at + 2 * wide]))


def averaged(net: Network, rows: DataFrame, epoch: int) -> Network:
    """``net`` after an epoch over rows (shard, doc_id, toxic, words): each shard goes on from it by itself, and each row of weights changes by the mean of the shards that moved it."""
    sent = rows.sparkSession.sparkContext.broadcast(net)

    def passed(table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("words", "ascending")])
        before = weights(sent.value)
        own = with_weights(sent.value, before)
        shard = table["shard"][0].as_py()
        Descent(own, [own.rows_of[unpacked(w)] for w in table["words"].to_pylist()], table["toxic"].to_numpy().astype(float), (SEED, epoch, shard)).epoch()
        change = weights(own) - before
        moved = np.any(change, axis=1)
        parts = np.concatenate([change * len(table), moved[:, None] * float(len(table))], axis=1)
        some = np.unique(np.flatnonzero(moved) // BLOCK).tolist()
        return pa.table({"block": pa.array(some, pa.int32()), "shard": pa.array([shard] * len(some), pa.int32()), "part": pa.array([parts[i * BLOCK : (i + 1) * BLOCK].astype(np.float32).tobytes() for i in some], pa.binary())})

    def mean(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, np.float32).reshape(-1, DIMENSIONS + 1).astype(float) for x in table.sort_by("shard")["part"].to_pylist())
        change = total[:, :-1] / np.maximum(total[:, -1:], 1)
        return pa.table({"block": table["block"][:1], "change": pa.array([change.astype(np.float32).tobytes()], pa.binary())})

    parts = rows.groupBy("shard").applyInArrow(passed, "block int, shard int, part binary")
    after = weights(net)
    for r in parts.groupBy("block").applyInArrow(mean, "block int, change binary").toLocalIterator():
        change = np.frombuffer(r.change, np.float32).reshape(-1, DIMENSIONS)
        after[r.block * BLOCK : r.block * BLOCK + len(change)] += change
    return with_weights(net, after)


def learn(docs: DataFrame, labels: DataFrame, sample: int | None = None, sample_bytes: int | None = None) -> Network:
    """A calibrated network from all labelled rows that are not held out; those whose doc_id leaves 3 divided by 4 are for the thresholds. A caller may ask for a ``sample`` of so many rows, or of
    ``sample_bytes`` of text, chosen by a hash of doc_id. A document with clashing labels counts as toxic."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    once = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    picked = once if sample is None else bounded_sample(once, "doc_id", sample)
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter(~held_out(F.col("doc_id"))).join(picked, "doc_id")
    profiles = language.learn(docs)
    rows = written = staged(hashed(spread(rows), profiles), "hashed")
    if sample_bytes is not None and (size := rows.agg(F.sum("bytes")).first()[0] or 0) > sample_bytes:
        rows = rows.filter(F.pmod(F.xxhash64("doc_id", F.lit("bytes")), F.lit(1 << 30)) < int(sample_bytes / size * (1 << 30)))
    n, toxic, size = rows.filter("not apart").agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum("bytes"), F.lit(0))).first()
    shards = max(1, -(-n // SHARD_ROWS), -(-size // SHARD_BYTES))
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit("shard")), F.lit(shards)).cast("int"))
    own = rows.filter("not apart")
    counts = word_counts(own).toPandas().sort_values("bucket")  # at most BUCKETS rows
    net = begun(counts["bucket"].to_numpy(np.int64), counts["n_in"].to_numpy(float), counts["n_pos"].to_numpy(float), toxic / n if n else 0.0)
    dealt = own.select("shard", "doc_id", "toxic", "words").repartition(shards, "shard").persist(StorageLevel.MEMORY_AND_DISK)  # dealt out once for all epochs
    for epoch in range(EPOCHS if n else 0):
        net = averaged(net, dealt, epoch)
    dealt.unpersist()
    net.profiles = profiles
    net.ready()
    calibrate(net, rows.filter("apart"))
    dropped(written)
    return net


def score(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the score of a text without words. Texts of any length are
    read whole. Equal texts have equal scores, rounded to six digits; a score of one half counts as toxic. Repeated rows come out repeated; other columns of ``docs`` take no part."""
    sent = docs.sparkSession.sparkContext.broadcast(net)  # bounded: BUCKETS

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net_ = sent.value
        for batch in batches:
            s = np.round(net_.scores(batch.column(2).to_pylist()), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s), pa.array((s >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return spread(source).mapInArrow(rows, "doc_id long, held_out boolean, score double, predicted int")
