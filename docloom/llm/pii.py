"""Personal data by bootstrapped contextual extraction.

Fixed forms (e-mail, IP, card and phone numbers) and unmistakable keys are the seeds. The words and signs before a seed are
lexical patterns; what else stands after the same patterns is an instance. Spark scores the graph of patterns and instances in turns:
a pattern by the mean score of its instances, an instance by the best pattern that leads to it, until the scores stand still. Patterns of high confidence
then mark identifiers whose form nobody had described.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import dropped, small_batches, spread, staged

KINDS = ("email", "ip", "card", "phone", "id")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
PLAIN = re.compile(r"(?<![\w-])[A-Za-z_-]{6,}(?![\w-])")
KEY = re.compile(r"(?=[0-9]*[a-f])[0-9a-f]{32,}")
CONTEXT = re.compile(r"\w+|[^\w\s]")
CONTEXT_CHARS = 40
LEAST_TOKEN = 6
#: A pattern counts with so many different instances, and marks further ones if it stands in so many different texts and is as confident as this.
LEAST_INSTANCES, LEAST_TEXTS, CONFIDENT = 5, 5, 0.8
#: An instance that is no seed has so much of its best pattern's confidence: so the scores have a limit that is not one for whatever some seed
#: can reach, and each turn is nearer to it by this factor. Turns end when no confidence changes by more than SETTLED.
DAMPING, SETTLED = 0.5, 0.01
#: Patterns that are sent to all tasks at most; more are joined by shuffles.
SENT_PATTERNS = 100_000


def luhn(digits: str) -> bool:
    twice = {"0": 0, "1": 2, "2": 4, "3": 6, "4": 8, "5": 1, "6": 3, "7": 5, "8": 7, "9": 9}
    return (sum(map(int, digits[-1::-2])) + sum(twice[d] for d in digits[-2::-2])) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four fixed kinds, by kind and then start. Linear in the text, whatever it holds."""
    out = []
    end = 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        if start < m.start():
            out.append(("email", start, m.end()))
            end = m.end()
    if not DIGIT.search(text):
        return out
    out += [("ip", m.start(), m.end()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if 13 <= m.end() - m.start() <= 37 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    for m in PHONE.finditer(text) if "+" in text else ():
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append(("phone", m.start(), m.end()))
    return out


def tokens(text: str, taken: list[tuple[str, int, int]]) -> Iterator[tuple[int, int]]:
    """Spans of tokens that hold a digit, are of some length and touch no base span."""
    edges = sorted((a, b) for _, a, b in taken)
    k = end = 0
    for m in DIGIT.finditer(text):
        if m.start() < end:
            continue
        start = m.start()
        while start > end and text[start - 1] in TOKEN:
            start -= 1
        end = m.end()
        while end < len(text) and text[end] in TOKEN:
            end += 1
        while k < len(edges) and edges[k][1] <= start:
            k += 1
        if end - start >= LEAST_TOKEN and not (k < len(edges) and edges[k][0] < end):
            yield start, end


def patterns(text: str, start: int) -> list[str]:
    """The two and three words or signs before a place, in lower case."""
    before = ["^", "^", "^", *CONTEXT.findall(text[max(0, start - CONTEXT_CHARS) : start].lower())]
    return [" ".join(before[-n:]) for n in (2, 3)]


def scan(text: str) -> tuple[list[tuple[str, int, int]], list[dict]]:
    """Base spans, and the instances with their patterns: seeds and what may be found."""
    import xxhash

    base = base_spans(text)
    found = []
    for start, end, seed, fixed in [*((a, b, True, True) for _, a, b in base), *((a, b, bool(KEY.fullmatch(text[a:b])), False) for a, b in tokens(text, base))]:
        if before := patterns(text, start):
            instance = xxhash.xxh64_intdigest(text[start:end].encode("utf-8", "replace")) - (1 << 63)
            found.append({"patterns": before, "instance": instance, "start": start, "end": end, "seed": seed, "base": fixed})
    return base, found


SPANS = "array<struct<kind:string,start:int,end:int>>"
FOUND = "array<struct<patterns:array<string>,instance:bigint,start:int,end:int,seed:boolean,base:boolean>>"


def sent(patterns_: DataFrame) -> DataFrame:
    """Patterns to join with: sent to all tasks where they are few, since many places share a pattern; by a shuffle, whose large partitions Spark splits, where
    they are not."""
    return F.broadcast(patterns_) if patterns_.count() <= SENT_PATTERNS else patterns_


def pattern_scores(edges: DataFrame) -> DataFrame:
    """(pattern, confidence, n) of the patterns with ``LEAST_INSTANCES`` instances, from distinct (pattern, instance, seed): n instances, and the limit of
    confidence = mean score of the instances, score = 1 for a seed, else ``DAMPING`` x the greatest confidence."""
    many = staged(edges.groupBy("pattern").agg(F.count("*").alias("n")).filter(F.col("n") >= LEAST_INSTANCES), "many")
    edges = staged(edges.join(many.select("pattern"), "pattern").select("pattern", "instance", "seed"), "edges")
    rated = staged(edges.groupBy("pattern").agg(F.avg(F.col("seed").cast("double")).alias("confidence")), "patterns")
    while True:
        heard = edges.join(sent(rated), "pattern").groupBy("instance").agg(F.max("seed").alias("seed"), F.max("confidence").alias("best"))
        score = heard.select("instance", F.when(F.col("seed"), 1.0).otherwise(F.col("best") * DAMPING).alias("score"))
        last, rated = rated, staged(edges.join(score, "instance").groupBy("pattern").agg(F.round(F.avg("score"), 6).alias("confidence")), "patterns")
        change = rated.join(last.withColumnRenamed("confidence", "before"), "pattern").agg(F.max(F.abs(F.col("confidence") - F.col("before")))).first()[0]
        dropped(last)
        if not change or change <= SETTLED:
            return rated.join(many, "pattern")


def confident_patterns(scanned: DataFrame) -> DataFrame:
    """(pattern, confidence, n): those that lead to identifiers, of the graph of patterns and instances, in ``LEAST_TEXTS`` different texts."""
    each = scanned.select(F.explode("found").alias("f")).select(F.explode("f.patterns").alias("pattern"), "f.instance", "f.seed")
    edges = staged(each.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    # an instance that is a seed somewhere is one everywhere
    seeds = edges.filter("seed").select("instance").distinct().withColumn("known", F.lit(True))
    edges = edges.join(seeds, "instance", "left").select("pattern", "instance", F.coalesce("known", F.lit(False)).alias("seed"))
    sure = staged(pattern_scores(edges).filter(F.col("confidence") >= CONFIDENT), "sure")
    places = scanned.select("text_hash", F.explode("found").alias("f")).select("text_hash", F.explode("f.patterns").alias("pattern")).join(sent(sure.select("pattern")), "pattern").distinct()
    return sure.join(places.groupBy("pattern").count().filter(F.col("count") >= LEAST_TEXTS).select("pattern"), "pattern")


def last_word(text: str, start: int) -> str:
    """The word or sign before a place, as in ``patterns``."""
    before = text[max(0, start - CONTEXT_CHARS) : start].lower().split()
    if not before:
        return "^"
    return before[-1] if before[-1].isalnum() else CONTEXT.findall(before[-1])[-1]


def stays_confident(confidence: float, n: int, others: int) -> bool:
    """Whether a pattern is confident when so many more instances have score zero."""
    return confidence * n / (n + others) >= CONFIDENT


class Followers:
    """The words without a digit that stand after some patterns {pattern: (confidence, n)}, as a task meets them: until a pattern has met so many different ones
    that it can not stay confident."""

    def __init__(self, known: dict[str, tuple[float, int]]):
        self.known, self.met = dict(known), {p: set() for p in known}
        self.last = Counter(p.rsplit(" ", 1)[-1] for p in known)

    def of_text(self, text: str) -> Iterator[tuple[int | None, int | None, int | None, str]]:
        """(start, end, instance, pattern) of each; all but the pattern null where it is given up."""
        import xxhash

        base = None
        for m in PLAIN.finditer(text) if self.known else ():
            if not self.last[last_word(text, m.start())]:
                continue
            for p in patterns(text, m.start()):
                if p not in self.known:
                    continue
                base = base_spans(text) if base is None else base
                if any(a < m.end() and m.start() < b for _, a, b in base):
                    break
                instance = xxhash.xxh64_intdigest(m[0].encode("utf-8", "replace")) - (1 << 63)
                self.met[p].add(instance)
                if stays_confident(*self.known[p], len(self.met[p])):
                    yield m.start(), m.end(), instance, p
                else:
                    del self.known[p], self.met[p]
                    self.last[p.rsplit(" ", 1)[-1]] -= 1
                    yield None, None, None, p


def plain_followers(source: DataFrame, sure: DataFrame) -> DataFrame:
    """(doc_id, text_hash, start, end, instance, pattern): what stands after the ``sure`` patterns in the texts of ``source`` and is a word without a digit; of a pattern
    that a task gives up, one row without a place, and not all of its words. The patterns go
    to the tasks, ``SENT_PATTERNS`` or so at once: where there are more, the texts are read once for each part of them."""
    parts = max(1, -(-sure.count() // SENT_PATTERNS))

    def followers(known: dict[str, tuple[float, int]]):
        def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            task = Followers(known)
            for batch in batches:
                out: list[tuple] = []
                for doc_id, text_hash, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                    out += [(doc_id, text_hash, *found) for found in task.of_text(text or "")]
                kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 6, kinds)], ["doc_id", "text_hash", "start", "end", "instance", "pattern"])

        return rows

    found = None
    for part in range(parts):
        known = {r.pattern: (r.confidence, r.n) for r in sure.filter(F.pmod(F.xxhash64("pattern"), F.lit(parts)) == part).collect()}
        more = spread(source).mapInArrow(followers(known), "doc_id long, text_hash long, start int, end int, instance long, pattern string")
        found = more if found is None else found.unionByName(more)
    return found


def find(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_hash, base, spans): for every row, the spans of the four fixed kinds, and these with what the patterns found
    (kind 'id'), in code points, by kind and then start.

    An identifier is a token of six characters or more after a confident pattern. One without a digit counts only if the pattern is as confident when all the different
    words without a digit that follow it are counted as instances of score zero. A null or empty text has no spans; texts are read whole, in time linear in
    them. Spans of different kinds may overlap. Repeated rows come out repeated; a pattern counts equal texts once. Other columns of ``docs`` take no part."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        found = pa.list_(pa.struct([("patterns", pa.list_(pa.string())), ("instance", pa.int64()), ("start", pa.int32()), ("end", pa.int32()), ("seed", pa.bool_()), ("base", pa.bool_())]))
        for batch in batches:
            got = [scan(t or "") for t in batch.column(2).to_pylist()]
            base = pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in g[0]] for g in got], spans)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), base, pa.array([g[1] for g in got], found)], ["doc_id", "text_hash", "base", "found"])

    small_batches(docs.sparkSession)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.col(text).alias("text"))
    scanned = staged(spread(source).mapInArrow(rows, f"doc_id long, text_hash long, base {SPANS}, found {FOUND}"), "scanned")
    sure = staged(confident_patterns(scanned), "sure")
    each = scanned.select("doc_id", "text_hash", F.explode("found").alias("f")).filter("not f.base").select("doc_id", "text_hash", "f.start", "f.end", F.explode("f.patterns").alias("pattern"))
    each = each.join(sent(sure.select("pattern")), "pattern").select("doc_id", "text_hash", "start", "end")
    if not sure.isEmpty():
        plain = staged(plain_followers(source, sure), "plain")
        # different words by an aggregate of them and then of their patterns, so that a pattern's words do not meet in one task
        others = plain.groupBy("pattern", "instance").agg(F.lit(1).alias("one")).groupBy("pattern").agg(F.count("instance").alias("others"), F.count("*").alias("rows"))
        whole = F.col("others") == F.col("rows")  # no task has given the pattern up
        wide = sure.join(others.filter(whole), "pattern").filter(F.col("confidence") * F.col("n") / (F.col("n") + F.col("others")) >= CONFIDENT).select("pattern")
        each = each.unionByName(plain.filter("instance is not null").join(sent(wide), "pattern").select("doc_id", "text_hash", "start", "end"))
    more = each.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end"))).alias("more"))
    more = more.withColumnsRenamed({"doc_id": "more_id", "text_hash": "more_hash"})
    same = F.col("doc_id").eqNullSafe(F.col("more_id")) & (F.col("text_hash") == F.col("more_hash"))
    out = scanned.select("doc_id", "text_hash", "base").join(more, same, "left")
    return out.select("doc_id", "text_hash", "base", F.concat("base", F.coalesce("more", F.array().cast(SPANS))).alias("spans"))


def written(spans: str):
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, digest of the base spans, and all spans written out."""
    found = find(docs)
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    more = (F.size("spans") - F.size("base")).cast("long").alias("n_id")
    return found.select("doc_id", *counts, F.sha2(written("base").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"), more)


def masked_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or run of overlapping spans, as the bracketed kind of its first."""
    out, at = [], 0
    for start, end, kind in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """``docs`` with all spans found replaced in the text, and n_chars as it is then; all rows stay."""
    spans = find(docs).filter(F.size("spans") > 0).select("doc_id", "text_hash", "spans").dropDuplicates(["doc_id", "text_hash"])
    # one column for the row, so that no other can have its name
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64("row.text") == F.col("text_hash"))
    joined = docs.select(F.struct(*docs.columns).alias("row")).join(spans, same, "left")
    joined = joined.select(*(F.col("row")[c].alias(c) for c in docs.columns), F.col("spans").alias(f"spans of {docs.columns}"))
    names = docs.columns

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [masked_text(t, [(s["start"], s["end"], s["kind"]) for s in spans]) if spans else t for t, spans in zip(batch.column(names.index("text")).to_pylist(), batch.column(len(names)).to_pylist())]
            columns = [batch.column(i) for i in range(len(names))]
            columns[names.index("text")] = pa.array(texts, pa.string())
            if "n_chars" in names:
                i = names.index("n_chars")
                columns[i] = pa.array([n if t is None else len(t) for t, n in zip(texts, columns[i].to_pylist())], columns[i].type)
            yield pa.RecordBatch.from_arrays(columns, names)

    small_batches(docs.sparkSession)
    return joined.mapInArrow(rows, docs.schema)
