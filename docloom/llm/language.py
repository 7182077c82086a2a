"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A letter trigram is the product of its letters' vectors, rotated by their places in it;
a text is the weighted sum of its trigrams' vectors, a language the sum of its texts' unit vectors. Texts are compared
with languages by cosine.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, small_batches, spread

DIMENSIONS = 2048
SEED = 11
#: Trigrams of texts that a task holds before it makes vectors of them.
TRIGRAMS_AT_ONCE = 4 << 20
#: Steepness of the score: the softmax over languages of cosine times this.
STEEPNESS = 25.0
#: Vectors of letters and of trigrams that a worker keeps; more are made again when met again.
KEPT_LETTERS, KEPT_GRAMS = 8192, 16384
#: Trigrams of a text whose vectors are summed at once.
AT_ONCE = 256
#: Trigrams whose products with the prototypes a worker keeps.
KEPT_PRODUCTS = 1 << 17
#: Trigrams of texts that are looked up there at once.
LOOKED_UP_AT_ONCE = 1 << 15
BLANK = 0


@lru_cache(1)
def is_letter() -> np.ndarray:
    letters = np.zeros(0x110000, bool)
    letters[[c for c in range(0x323B0) if chr(c).isalpha()]] = True
    return letters


@lru_cache(KEPT_LETTERS)
def letter_vector(code: int) -> np.ndarray:
    """+1 and -1 at random, by the letter's code point: each letter of any script has its own."""
    return np.random.default_rng([SEED, code]).integers(0, 2, DIMENSIONS, np.int8) * 2 - 1


class Grams:
    """Vectors of trigrams, made when first met: the product of the letters' vectors, rotated by their places."""

    def __init__(self) -> None:
        self.place: dict[int, int] = {}
        self.rows = np.empty((KEPT_GRAMS, DIMENSIONS), np.int8)

    def of(self, grams: np.ndarray) -> np.ndarray:
        if len(self.place) + len(grams) > KEPT_GRAMS:
            self.place.clear()
        at = np.empty(len(grams), np.int64)
        for i, g in enumerate(grams.tolist()):
            k = self.place.get(g)
            if k is None:
                k = self.place[g] = len(self.place)
                a, b, c = g >> 42, g >> 21 & 0x1FFFFF, g & 0x1FFFFF
                self.rows[k] = np.roll(letter_vector(a), 2) * np.roll(letter_vector(b), 1) * letter_vector(c)
            at[i] = k
        return self.rows[at]


@lru_cache(1)
def grams() -> Grams:
    return Grams()


def trigrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct trigrams of the letters of a text and how often each occurs; runs of no letters are one blank, and so are the ends.
    Three code points make one integer."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    codes = np.concatenate(([BLANK], np.where(is_letter()[codes], codes, BLANK), [BLANK]))
    codes = codes[(codes != BLANK) | (np.append(codes[1:], 1) != BLANK)]
    if not codes.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.unique(codes[:-2] << 42 | codes[1:-1] << 21 | codes[2:], return_counts=True)


def vector(text: str) -> np.ndarray | None:
    """The unit vector of a text; None where it has no letter."""
    found, count = trigrams(text)
    if not len(found):
        return None
    weight, v = np.sqrt(count).astype(np.float32), np.zeros(DIMENSIONS, np.float32)
    for i in range(0, len(found), AT_ONCE):
        v += weight[i : i + AT_ONCE] @ grams().of(found[i : i + AT_ONCE]).astype(np.float32)
    norm = float(np.linalg.norm(v))
    return v / norm if norm else v


def has_letter(text: str) -> bool:
    """Whether ``vector`` has something to go by."""
    return bool(is_letter()[np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)].any())


class Profiles:
    """Unit prototypes of the languages, without what they have in common."""

    def __init__(self, names: list[str], sums: np.ndarray):
        self.names = names
        p = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-9)
        p = p - p.mean(axis=0) if len(names) > 1 else p
        self.prototypes = (p / np.maximum(np.linalg.norm(p, axis=1, keepdims=True), 1e-9)).astype(np.float32)
        self.place: dict[int, int] = {}
        self.kept = np.zeros((0, len(names)), np.float32)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"place": {}, "kept": np.zeros((0, len(self.names)), np.float32)}

    def products(self, found: np.ndarray) -> np.ndarray:
        """Products of the vectors of trigrams (rows) with the prototypes."""
        if len(self.place) + len(found) > KEPT_PRODUCTS or not len(self.kept):
            self.place, self.kept = {}, np.zeros((max(KEPT_PRODUCTS, len(found)), len(self.names)), np.float32)
        listed = found.tolist()
        at = list(map(self.place.get, listed))
        if None in at:
            new = [g for g, k in zip(listed, at) if k is None]
            for i in range(0, len(new), AT_ONCE):
                part = new[i : i + AT_ONCE]
                self.kept[len(self.place) : len(self.place) + len(part)] = grams().of(np.array(part)).astype(np.float32) @ self.prototypes.T
                self.place.update(zip(part, range(len(self.place), len(self.place) + len(part))))
            at = list(map(self.place.__getitem__, listed))
        return self.kept[at]

    def nearest(self, text: str) -> str:
        """The language of ``predict`` without its score: the length of the text's vector does not matter, so the vector is not made."""
        return self.all_nearest([text])[0]

    def all_nearest(self, texts: list[str]) -> list[str]:
        """``nearest`` of each text, the trigrams of some of them looked up at once."""
        if not self.names:
            return ["und"] * len(texts)
        out: list[str] = []
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        for i, text in enumerate(texts):
            held.append(trigrams(text))
            size += len(held[-1][0])
            if size > LOOKED_UP_AT_ONCE or i == len(texts) - 1:
                some, at = np.unique(np.concatenate([f for f, _ in held]), return_inverse=True)
                products, end = self.products(some), 0
                for found, count in held:
                    own, end = products[at[end : end + len(found)]], end + len(found)
                    out.append(self.names[int((np.sqrt(count).astype(np.float32) @ own).argmax())] if len(found) else "und")
                held, size = [], 0
        return out

    def predict(self, text: str) -> tuple[str, float]:
        """Language and score; ('und', 0.0) for a text without letters, or where no language was learned. Of equal cosines the first
        language by name."""
        v = vector(text)
        if v is None or not self.names:
            return "und", 0.0
        cosine = (self.prototypes @ v).astype(np.float64)
        e = np.exp(STEEPNESS * (cosine - cosine.max()))
        best = int(cosine.argmax())
        return self.names[best], float(e[best] / e.sum())


def learn(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int | None = None) -> Profiles:
    """Profiles from all rows with text and lang whose doc_id is not held out; where a caller asks for it, from about ``per_language`` of each language, chosen
    by a hash. A text counts with its trigrams' weights, which have length one together; a task adds them up before it makes vectors of them. Only a vector for each language comes to the driver."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    if per_language is not None:
        sizes = rows.groupBy("lang").agg(F.count("*").alias("_n"))
        rows = rows.join(sizes, "lang").filter(F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) < F.lit(per_language) / F.col("_n") * (1 << 30))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        size = 0

        def added() -> None:
            for lang_, parts in held.items():
                found, at = np.unique(np.concatenate([f for f, _ in parts]), return_inverse=True)
                weight = np.bincount(at, np.concatenate([w for _, w in parts]))
                for i in range(0, len(found), AT_ONCE):
                    total[lang_] = total.get(lang_, 0) + weight[i : i + AT_ONCE] @ grams().of(found[i : i + AT_ONCE]).astype(float)
            held.clear()

        for batch in batches:
            for lang_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found, count = trigrams(t)
                if len(found):
                    held.setdefault(lang_, []).append((found, np.sqrt(count / count.sum())))
                    size += len(found)
            if size > TRIGRAMS_AT_ONCE:
                added()
                size = 0
        added()
        yield pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], ["lang", "v"])

    small_batches(docs.sparkSession)
    parts = spread(rows.select("lang", "text")).mapInArrow(sums, "lang string, v array<double>")
    cells = parts.select("lang", F.posexplode("v")).groupBy("lang", "pos").agg(F.sum("col").alias("x")).collect()
    names = sorted({c.lang for c in cells})
    out = np.zeros((len(names), DIMENSIONS))
    for c in cells:
        out[names.index(c.lang), c.pos] = round(c.x, 6)
    return Profiles(names, out)


def predict(docs: DataFrame, profiles: Profiles, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row; texts that are null or have no letter are 'und' with score 0, and all are where no
    language was learned. Texts are read whole; of languages equally near, the first by name is given. Repeated rows come out repeated; other columns of ``docs`` take no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.predict(t or "") for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), held_out(F.col(doc_id)).alias("held_out"), F.col(text).alias("text"))
    return spread(source).mapInArrow(rows, "doc_id long, held_out boolean, lang_pred string, score double")


def keep_known(docs: DataFrame) -> DataFrame:
    """``docs`` without those whose text has no language: null, or without a letter. A null lang becomes the language that the
    profiles predict; where no language was learned it stays null, and the row stays."""
    profiles = learn(docs)
    columns = docs.schema
    text, lang = columns.names.index("text"), columns.names.index("lang")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, labels = batch.column(text).to_pylist(), batch.column(lang).to_pylist()
            if profiles.names:
                found = [profiles.predict(t or "")[0] if label is None else label for t, label in zip(texts, labels)]
                batch = batch.set_column(lang, batch.schema.field(lang), pa.array(found, batch.schema.field(lang).type))
            yield batch.filter(pa.array([has_letter(t or "") for t in texts], pa.bool_()))

    small_batches(docs.sparkSession)
    return spread(docs).mapInArrow(rows, columns)
