"""BPE encoding and decoding with a minimal acyclic transducer as the lexicon of frequent words.

The words of the whole corpus are counted by Spark; the most frequent ones are encoded once and compiled
into a minimal acyclic automaton whose transitions carry numeric outputs (their sum along a word is the word's
place in a table of ids). The automaton, the merge table and the bytes of every id lie in one binary file that
executors get by ``addFile`` and map into memory. Words that the automaton does not hold are merged exactly.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import os
import re
import tempfile
import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, spread, staged

#: How the vocabulary's own tokenizer splits a text into words (a fixed value of the format).
WORDS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts up to U+024F, with its classes spelled out: Python's own engine runs it twice as fast.
_L, _N, _S = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾", r"\t-\r \x85\xa0"
NARROW_WORDS = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+").findall
WIDE = re.compile("[^\x00-ɏ]").search
#: Characters whose class is the same in every Unicode version in use; other texts are split by the library.
UNSTABLE = re.compile("[^\x00-\u0557\u2000-\u206f\u20a0-\u20bf\u3041-\u3096\u30a0-\u30fe\u4e00-\u9fa5]").search
LEXICON_WORDS = 60_000
COUNTED_AT_ONCE = 300_000
MEMO_WORDS = 300_000
#: Unseen words of up to so many bytes are merged in one array; longer ones each by a heap.
TOGETHER = 64
PARTS = ("key", "target", "out", "final", "offset", "ids", "pair", "rank", "merged", "byte_at", "bytes", "special")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Merges and ids of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        letters = byte_letters()
        ids = data["model"]["vocab"]
        self.special = {x["content"]: x["id"] for x in data.get("added_tokens", [])}
        self.bytes_of = {i: bytes(letters[c] for c in word) for word, i in ids.items()}
        self.bytes_of |= {i: word.encode() for word, i in self.special.items()}
        self.pairs = {}
        for rank, pair in enumerate(data["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[ids[a] << 32 | ids[b]] = (rank, ids[a + b])
        self.first = [0] * 256
        for c, b in letters.items():
            self.first[b] = ids[c]


def merge_short(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    none = (1 << 60, 0)
    found = [pairs.get(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
    while found:
        best = min(found)
        if best is none:
            break
        i = found.index(best)
        symbols[i : i + 2] = [best[1]]
        del found[i]
        if i:
            found[i - 1] = pairs.get(symbols[i - 1] << 32 | symbols[i], none)
        if i < len(found):
            found[i] = pairs.get(symbols[i] << 32 | symbols[i + 1], none)
    return symbols


def merge_long(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    """The same with a heap and links, for words of any length: n log n."""
    n = len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(x[0], i, x[1], symbols[i], symbols[i + 1]) for i in range(n - 1) if (x := pairs.get(symbols[i] << 32 | symbols[i + 1]))]
    heapq.heapify(heap)
    while heap:
        _, i, new, a, b = heapq.heappop(heap)
        j = after[i]
        if symbols[i] != a or j >= n or symbols[j] != b:
            continue
        symbols[i], symbols[j] = new, -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right < n and (x := pairs.get(symbols[left] << 32 | symbols[right])):
                heapq.heappush(heap, (x[0], left, x[1], symbols[left], symbols[right]))
    return [s for s in symbols if s >= 0]


def plain_words(text: str) -> list[str]:
    if not WIDE(text):
        return NARROW_WORDS(text)
    import regex
    from tokenizers import pre_tokenizers

    if not UNSTABLE(text):
        return regex.findall(WORDS, text)
    return [text[a:b] for _, (a, b) in pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True).pre_tokenize_str(text)]


NO_RANK = 1 << 40


def merge_many(words: list[bytes], first: np.ndarray, pair: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of many words, one after another, and where each begins. Each round merges, in every word that still
    has a known pair, its leftmost pair of least rank; only the pairs beside a merge are looked up again."""

    def ranks(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = a << 32 | b
        at = np.minimum(np.searchsorted(pair, wanted), len(pair) - 1)
        return np.where(pair[at] == wanted, rank[at], NO_RANK), merged[at]

    lengths = np.array([len(w) for w in words], np.int64)
    owner = np.repeat(np.arange(len(words)), lengths)
    symbol = first[np.frombuffer(b"".join(words), np.uint8)]
    ends = np.append(owner[1:] != owner[:-1], True)  # no pair across words
    score, made = np.full(len(symbol), NO_RANK), np.zeros(len(symbol), np.int64)
    inner = np.flatnonzero(~ends)
    score[inner], made[inner] = ranks(symbol[inner], symbol[inner + 1])
    finished: list[tuple[np.ndarray, np.ndarray]] = []
    while len(symbol):
        starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        sizes = np.diff(np.append(starts, len(symbol)))
        least = np.minimum.reduceat(score, starts)
        open_ = np.repeat(least < NO_RANK, sizes)
        if not open_.all():
            finished.append((owner[~open_], symbol[~open_]))
            owner, symbol, ends, score, made = (x[open_] for x in (owner, symbol, ends, score, made))
            if not len(symbol):
                break
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            sizes = np.diff(np.append(starts, len(symbol)))
            least = np.minimum.reduceat(score, starts)
        best = np.flatnonzero(score == np.repeat(least, sizes))
        best = best[np.append(True, owner[best][1:] != owner[best][:-1])]
        symbol[best], ends[best] = made[best], ends[best + 1]
        keep = np.ones(len(symbol), bool)
        keep[best + 1] = False
        at = best - np.arange(len(best))  # places after the removals
        owner, symbol, ends, score, made = (x[keep] for x in (owner, symbol, ends, score, made))
        left = at[at > 0] - 1
        again = np.concatenate((at, left[~ends[left]]))
        score[again] = NO_RANK
        again = again[~ends[again]]
        score[again], made[again] = ranks(symbol[again], symbol[again + 1])
    owners = np.concatenate([o for o, _ in finished] or [np.zeros(0, np.int64)])
    symbols = np.concatenate([s for _, s in finished] or [np.zeros(0, np.int64)])
    order = np.argsort(owners, kind="stable")
    return symbols[order], np.searchsorted(owners[order], np.arange(len(words) + 1))


def merge(word: bytes, first: list[int], pairs: dict[int, tuple[int, int]]) -> list[int]:
    symbols = [first[b] for b in word]
    return merge_short(symbols, pairs) if len(symbols) <= 40 else merge_long(symbols, pairs)


def minimal_automaton(words: list[bytes]) -> dict[str, np.ndarray]:
    """The minimal acyclic automaton of sorted distinct words, built one word at a time: when a word leaves a
    path, each state of the path is replaced by an equal registered one, so that suffixes are shared. The output
    of a transition counts the words that sort before it within its state."""
    edges: list[dict[int, int]] = [{}]
    final = [False]
    register: dict[tuple, int] = {}
    path: list[tuple[int, int]] = []
    last = b""

    def freeze(depth: int) -> None:
        while len(path) > depth:
            parent, letter = path.pop()
            child = edges[parent][letter]
            same = (final[child], tuple(edges[child].items()))
            edges[parent][letter] = register.setdefault(same, child)

    for word in words:
        shared = len(os.path.commonprefix([last, word]))
        freeze(shared)
        state = edges[path[-1][0]][path[-1][1]] if path else 0
        for letter in word[shared:]:
            edges.append({})
            final.append(False)
            edges[state][letter] = len(edges) - 1
            path.append((state, letter))
            state = len(edges) - 1
        final[state] = True
        last = word
    freeze(0)
    sizes: dict[int, int] = {}

    def size(state: int) -> int:
        stack = [state]
        while stack:
            s = stack[-1]
            if todo := [t for t in edges[s].values() if t not in sizes]:
                stack.extend(todo)
            else:
                sizes[s] = final[s] + sum(sizes[t] for t in edges[s].values())
                stack.pop()
        return sizes[state]

    size(0)
    number = {s: i for i, s in enumerate(sorted(sizes))}
    rows = []
    for s, i in number.items():
        seen = int(final[s])
        for letter in sorted(edges[s]):
            rows.append((i << 8 | letter, number[edges[s][letter]], seen))
            seen += sizes[edges[s][letter]]
    rows.sort()
    key, target, out = (np.array([r[k] for r in rows], np.int64) for k in range(3))
    return {"key": key, "target": target, "out": out, "final": np.array([final[s] for s in sorted(sizes)], np.int64)}


def write_lexicon(path: str, words: Iterable[str], vocabulary: Vocabulary) -> None:
    """One file: a head of lengths, then the parts, all 64-bit integers but the bytes of the ids."""
    sorted_words = sorted({w.encode() for w in words} - {b""})
    ids = [merge(w, vocabulary.first, vocabulary.pairs) for w in sorted_words]
    texts = [vocabulary.bytes_of.get(i, b"") for i in range(max(vocabulary.bytes_of) + 1)]
    pairs = sorted(vocabulary.pairs.items())
    joined = np.frombuffer(b"".join(texts), np.uint8)
    parts = minimal_automaton(sorted_words) | {
        "offset": np.cumsum([0, *map(len, ids)]),
        "ids": np.array([x for w in ids for x in w], np.int64),
        "pair": np.array([p for p, _ in pairs], np.int64),
        "rank": np.array([x[0] for _, x in pairs], np.int64),
        "merged": np.array([x[1] for _, x in pairs], np.int64),
        "byte_at": np.cumsum([0, *map(len, texts)]),
        "bytes": joined.astype(np.int64),
        "special": np.array(sorted(vocabulary.special.values()), np.int64),
    }
    with open(path, "wb") as f:
        np.array([len(parts[p]) for p in PARTS], np.int64).tofile(f)
        for p in PARTS:
            parts[p].astype(np.int64).tofile(f)


class Lexicon:
    """The mapped file, and encoding and decoding by it."""

    def __init__(self, path: str):
        data = np.memmap(path, np.int64, "r")
        at = len(PARTS)
        for name, n in zip(PARTS, data[: len(PARTS)].tolist()):
            setattr(self, name, np.asarray(data[at : at + n]))  # still mapped
            at += n
        raw, cuts = self.bytes.astype(np.uint8).tobytes(), self.byte_at.tolist()
        self.bytes_of = [raw[a:b] for a, b in zip(cuts, cuts[1:])]
        self.special_of = {self.bytes_of[i].decode(): str(i) for i in self.special.tolist()}
        self.pairs = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        specials = set(self.special.tolist())
        self.first = [0] * 256
        for i in range(len(self.bytes_of) - 1, -1, -1):
            if len(self.bytes_of[i]) == 1 and i not in specials:
                self.first[self.bytes_of[i][0]] = i
        self.first_array = np.array(self.first, np.int64)
        special = re.compile("|".join(re.escape(w) for w in sorted(self.special_of, key=len, reverse=True)) or r"(?!)")
        self.split_special, self.find_special = special.split, special.findall
        self.memo: dict[str, str] = {}

    def words(self, text: str) -> list[str]:
        """The words of a text, special tokens as words of their own."""
        if not any(s in text for s in self.special_of):
            return plain_words(text)
        out, found = [], [*self.find_special(text), ""]
        for part, special in zip(self.split_special(text), found):
            out += plain_words(part)
            out += [special] if special else []
        return out

    def look_up(self, words: list[bytes]) -> np.ndarray:
        """The places of words in the table of ids, -1 where the automaton ends elsewhere: all words walk at once."""
        lengths = np.array([len(w) for w in words], np.int64)
        data, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        state, place = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        if not len(self.key):
            return np.full(len(words), -1)
        alive = np.flatnonzero(lengths > 0)
        place[lengths == 0] = -1
        depth = 0
        while len(alive):
            done = lengths[alive] == depth
            ended = alive[done]
            place[ended[self.final[state[ended]] == 0]] = -1
            alive = alive[~done]
            wanted = state[alive] << 8 | data[starts[alive] + depth]
            edge = np.minimum(np.searchsorted(self.key, wanted), len(self.key) - 1)
            met = self.key[edge] == wanted
            place[alive[~met]] = -1
            alive, edge = alive[met], edge[met]
            place[alive] += self.out[edge]
            state[alive] = self.target[edge]
            depth += 1
        return place

    def learn(self, words: set[str]) -> None:
        """Put the ids of words that the memo lacks into it, as decimal digits."""
        new = [w for w in words if w not in self.memo and w not in self.special_of]
        if not new:
            return
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
            new = list(words)
        raw = [w.encode() for w in new]
        places = self.look_up(raw)
        known = np.flatnonzero(places >= 0)
        for i, a, b in zip(known.tolist(), self.offset[places[known]].tolist(), self.offset[places[known] + 1].tolist()):
            self.memo[new[i]] = ",".join(map(str, self.ids[a:b].tolist()))
        short = []
        for i in np.flatnonzero(places < 0).tolist():
            if len(raw[i]) <= TOGETHER:
                short.append(i)
            else:
                self.memo[new[i]] = ",".join(map(str, merge(raw[i], self.first, self.pairs)))
        symbols, at = merge_many([raw[i] for i in short], self.first_array, self.pair, self.rank, self.merged)
        digits, at = list(map(str, symbols.tolist())), at.tolist()
        for k, i in enumerate(short):
            self.memo[new[i]] = ",".join(digits[at[k] : at[k + 1]])

    def encode(self, texts: list[str]) -> Iterator[str]:
        """Ids of each text as decimals joined by commas; empty for an empty text."""
        split = [self.words(t) for t in texts]
        seen = set().union(*split)
        self.learn(seen)
        of = self.memo | self.special_of if seen & self.special_of.keys() else self.memo
        for words in split:
            yield ",".join([of[w] for w in words])

    def decode(self, ids: str) -> str:
        return b"".join([self.bytes_of[int(i)] for i in ids.split(",")]).decode("utf-8", "replace") if ids else ""


_open: dict[str, Lexicon] = {}


def lexicon(name: str) -> Lexicon:
    """The lexicon of a file that addFile has sent; one for each Python worker."""
    if name not in _open:
        _open.clear()
        _open[name] = Lexicon(SparkFiles.get(name))
    return _open[name]


def count_words(docs: DataFrame, vocabulary_path: str, text: str = "text") -> DataFrame:
    """(word, n) over all texts of ``docs``."""
    special = sorted(Vocabulary(vocabulary_path).special)

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()

        def out() -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()

        for batch in batches:
            for t in batch.column(0).to_pylist():
                for s in special if t else ():
                    t = t.replace(s, "\n")
                seen.update(plain_words(t or ""))
            if len(seen) > COUNTED_AT_ONCE:
                yield from out()
        yield from out()

    small_batches(docs.sparkSession)
    return spread(docs.select(F.col(text).alias("text"))).mapInArrow(counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(docs: DataFrame, vocabulary_path: str, text: str, size: int) -> list[str]:
    """At most ``size`` words: all that occur so often that no more than ``size`` do. The level comes from a histogram of the counts, of a few
    hundred steps, so that the driver gets the histogram and these words, however many tasks hold candidates."""
    # a word met once gains nothing from the lexicon; only short ones can be frequent
    counts = staged(count_words(docs, vocabulary_path, text).filter((F.col("n") > 1) & (F.length("word") <= 64)), "counts")
    step = F.floor(F.log("n") * 16).cast("int")
    level = kept = 0
    for r in reversed(counts.groupBy(step.alias("step")).agg(F.count("*").alias("words")).orderBy("step").collect()):
        if kept + r.words > size:
            level = r.step + 1
            break
        kept += r.words
    return [r.word for r in counts.filter(step >= level).select("word").collect()]


def build_lexicon(docs: DataFrame, vocabulary_path: str, text: str = "text", size: int = LEXICON_WORDS) -> str:
    """Count the words of ``docs``, compile the most frequent, ``size`` at most, and send the file to all executors; its name.
    Only these words come to the driver: a bound that does not grow with the corpus."""
    spark = docs.sparkSession
    words = frequent_words(docs, vocabulary_path, text, size)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    with tempfile.TemporaryDirectory() as d:
        write_lexicon(path := os.path.join(d, name), words, Vocabulary(vocabulary_path))
        send(spark, path)
    return name


def send(spark: SparkSession, path: str) -> None:
    """Copy a file of the driver's to the shared folder, from which executors fetch it."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/{os.path.basename(path)}")
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{os.path.abspath(path)}"), target)
    fs.deleteOnExit(target)
    spark.sparkContext.addFile(target.toString())


def encode(docs: DataFrame, vocabulary_path: str, doc_id: str = "doc_id", text: str = "text", name: str | None = None) -> DataFrame:
    """(doc_id, ids array<int>, decoded string) for every row. A null or empty text has no ids and decodes to ''.
    Repeated rows are encoded each; other columns of ``docs`` take no part."""
    name = name or build_lexicon(docs, vocabulary_path, text)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(name)
        for batch in batches:
            ids = list(lex.encode([t or "" for t in batch.column(1).to_pylist()]))
            lists = pa.array([np.array(x.split(","), np.int32) if x else [] for x in ids], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(map(lex.decode, ids), pa.string())], ["doc_id", "ids", "decoded"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return spread(source).mapInArrow(rows, f"doc_id {source.schema[0].dataType.simpleString()}, ids array<int>, decoded string")


def encode_digests(docs: DataFrame, vocabulary_path: str, name: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every row, by the lexicon of ``docs``."""
    name = name or build_lexicon(docs, vocabulary_path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = lexicon(name)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        for batch in batches:
            ids = list(lex.encode([t or "" for t in batch.column(1).to_pylist()]))
            counts = pa.array([x.count(",") + 1 if x else 0 for x in ids], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), counts, pa.array(map(sha, ids)), pa.array([sha(lex.decode(x)) for x in ids], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    small_batches(docs.sparkSession)
    return spread(docs.select("doc_id", "text")).mapInArrow(rows, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
