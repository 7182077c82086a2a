"""Mixing to target weights by soft membership, with DataFrame functions only.

A naive Bayes classifier over hashed words, learned from the labelled table, gives every document a posterior over
domains. Projected gradient descent then finds a rate for each document, none negative, such that the expected tokens of each domain
(rate x tokens x posterior, summed) meet the targets: weighted least squares, from all rates at one.

The gradient at a document is a sum over domains of its posterior times the domain's error, so the steps add up to one number a domain: the
unprojected rate is one less posterior times these, and its projection to no less than zero is the rate. Steps are scaled by the inverse Gram matrix of the documents
whose rate is above zero, summed in the same scan as the errors; a scan tries several lengths of a step and takes the best.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_sample, staged

#: Share of the tokens that each domain shall have.
TARGETS = {"clean": 0.92, "low": 0.05, "toxic": 0.03}
BUCKETS = 1 << 16
#: Background words added to each bucket, and the weight of the evidence against the prior.
PSEUDO, EVIDENCE = 30.0, 0.5
#: Log-odds are kept as integers of this step, so that sums do not depend on their order.
STEP = 1 << 16
#: Scans after which the fit is given up, with a warning; the relative error at which it is done; lengths of a step that a scan tries.
ROUNDS, TOLERANCE, LENGTHS = 30, 1e-4, (1.0, 0.4, 0.1)
#: Weight of the accumulated steps against the relative errors: decides only where no rates meet the targets.
RIDGE = 1e-7


def domain_of(quality: Column, toxic: Column) -> Column:
    """Domain of a labelled row; null where the labels do not tell."""
    return F.when(toxic == 1, "toxic").when(quality == 1, "clean").when(quality == 0, "low")


def _split() -> Column:
    """The words of a text (column text); an empty one for a text without words."""
    return F.split(F.trim(F.regexp_replace(F.lower("text"), r"[\x20\t-\r]+", " ")), " ")


def _bucket(word: Column) -> Column:
    return F.xxhash64(word).bitwiseAND(F.lit(BUCKETS - 1))


def words(docs: DataFrame, *keys: str) -> DataFrame:
    """A row for each word of each text (column text, not null), with its place and bucket; one without a word for each text without words."""
    each = docs.select(*keys, F.posexplode(_split()).alias("pos", "word"))
    return each.select(*keys, "pos", (F.col("word") != "").alias("is_word"), _bucket(F.col("word")).alias("bucket"))


def labelled_words(docs: DataFrame, picked: DataFrame) -> DataFrame:
    """(domain, bucket) of each word of the documents in ``picked`` (doc_id, domain). Documents meet their labels by a shuffle however few labels there are,
    so that what is moved grows as the documents do; of a text only its words' buckets are moved, two bytes each."""
    short = F.transform(F.filter(_split(), lambda w: w != ""), lambda w: (_bucket(w) - BUCKETS // 2).cast("short"))
    buckets = docs.filter("text is not null").select("doc_id", short.alias("buckets"))
    each = buckets.join(picked.hint("merge"), "doc_id").select("domain", F.explode("buckets").alias("short"))
    return each.select("domain", (F.col("short").cast("long") + BUCKETS // 2).alias("bucket"))


def word_weights(docs: DataFrame, labels: DataFrame, domains: list[str], sample: int | None = None) -> tuple[DataFrame, dict[str, float], list[str]]:
    """(bucket, w_<domain> long), at most ``BUCKETS`` rows, the domains' shares of the labelled documents, and the domains that labelled words tell of: from all
    labelled documents, or about ``sample`` of them where a caller asks for it."""
    once = labels.filter("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))
    known = once.select("doc_id", domain_of(F.col("quality"), F.col("toxic")).alias("domain")).filter("domain is not null")
    picked = staged(known if sample is None else bounded_sample(known, "doc_id", sample), "labelled")
    counts = {r.domain: r["count"] for r in picked.groupBy("domain").count().collect()}
    all_docs = sum(counts.values())
    prior = {d: (counts.get(d, 0) + 1) / (all_docs + len(domains)) for d in domains}
    table = labelled_words(docs, picked).groupBy("bucket").agg(*(F.count_if(F.col("domain") == d).alias(f"n_{d}") for d in domains))
    table = staged(table, "words")
    sums = table.agg(*(F.coalesce(F.sum(f"n_{d}"), F.lit(0)).alias(d) for d in domains)).first()
    total = max(1, sum(sums))
    n = sum((F.col(f"n_{d}") for d in domains[1:]), F.col(f"n_{domains[0]}"))

    def weight(d: str) -> Column:
        share = max(sums[d], 1) / total
        odds = F.log((F.col(f"n_{d}") + PSEUDO * share) / ((n + PSEUDO) * share))
        return F.round(odds * STEP).cast("long").alias(f"w_{d}")

    return table.select("bucket", *map(weight, domains)), prior, [d for d in domains if sums[d]]


def posteriors(docs: DataFrame, labels: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, text_hash, rows, n_tokens, p_<domain>): one row for each distinct (doc_id, text) of ``docs``, with how many rows it
    stands for. A domain without labelled words is nobody's; where none has any, all are equally likely."""
    return _posteriors(docs, labels, domains)[0]


def _posteriors(docs: DataFrame, labels: DataFrame, domains: list[str]) -> tuple[DataFrame, list[str]]:
    """``posteriors`` and the domains with labelled words."""
    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("text_hash", F.xxhash64("text"))
    weights, prior, known = word_weights(docs.select("doc_id", "text"), labels, domains)
    possible = known or domains
    each = words(source, "doc_id", "text_hash").join(F.broadcast(weights), "bucket", "left")  # at most BUCKETS rows
    scored = each.groupBy("doc_id", "text_hash").agg(
        F.count_if(F.col("pos") == 0).alias("rows"), F.count_if("is_word").alias("n"), *(F.sum(F.when(F.col("is_word"), F.col(f"w_{d}"))).alias(f"s_{d}") for d in domains)
    )
    logits = [F.log(F.lit(prior[d])) + F.coalesce(F.col(f"s_{d}"), F.lit(0)) / F.col("rows") * (EVIDENCE / STEP) for d in domains]
    scored = scored.select("doc_id", "text_hash", "rows", (F.col("n") / F.col("rows")).cast("long").alias("n_tokens"), *(x.alias(f"l_{d}") for x, d in zip(logits, domains)))
    top = F.greatest(*(F.col(f"l_{d}") for d in possible)) if len(possible) > 1 else F.col(f"l_{possible[0]}")
    powers = {d: F.exp(F.col(f"l_{d}") - top) if d in possible else F.lit(0.0) for d in domains}
    whole = sum(powers.values(), F.lit(0.0))
    return scored.select("doc_id", "text_hash", "rows", "n_tokens", *((powers[d] / whole).alias(f"p_{d}") for d in domains)), known


@dataclass
class Fit:
    """Accumulated steps and expected shares by domain; the largest error relative to the target (to one in ten thousand where that is less), and
    the scans made."""

    steps: dict[str, float]
    shares: dict[str, float]
    off: float
    scans: int

    @property
    def met(self) -> bool:
        return self.off < TOLERANCE


def rate_after(steps: dict[str, float]) -> Column:
    """The rate of a document after these accumulated steps."""
    return F.greatest(F.lit(0.0), F.lit(1.0) - sum((F.col(f"p_{d}") * F.lit(x) for d, x in steps.items()), F.lit(0.0)))


def fit_rates(table: DataFrame, targets: dict[str, float]) -> Fit:
    """Steps that meet the targets as nearly as rates can. Each scan sums over all documents, for each length of the step, the domains'
    expected tokens, the Gram matrix (tokens x posterior x posterior) of the rates above zero, and tokens x rate x rate; only these come to the driver.

    The summed objective (half the last, plus steps times wanted tokens) falls with every step taken, so the descent can not cycle. A warning tells
    when the targets are not met."""
    domains = list(targets)
    tokens = F.col("rows") * F.col("n_tokens")

    def scan(tried: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray, float]]:
        sums = []
        for i, steps in enumerate(tried):
            rate = rate_after(dict(zip(domains, map(float, steps))))
            sums += [F.sum(tokens * F.col(f"p_{a}") * rate).alias(f"{i}/{a}") for a in domains]
            sums += [F.sum(F.when(rate > 0, tokens * F.col(f"p_{a}") * F.col(f"p_{b}"))).alias(f"{i}/{a}/{b}") for a in domains for b in domains]
            sums.append(F.sum(tokens * rate * rate).alias(f"{i}//"))
        got = {k: float(v or 0.0) for k, v in table.agg(*sums).first().asDict().items()}
        return [(np.array([got[f"{i}/{a}"] for a in domains]), np.array([[got[f"{i}/{a}/{b}"] for b in domains] for a in domains]), got[f"{i}//"]) for i in range(len(tried))]

    steps = np.zeros(len(domains))
    have, gram, square = scan([steps])[0]
    total, scans = have.sum(), 1  # a document's posteriors add up to one
    wanted = np.array([targets[d] for d in domains], float) / sum(targets.values()) * total
    unit = np.maximum(wanted, 1e-4 * max(total, 1.0))
    objective = lambda s, q: q / 2 + s @ wanted + RIDGE * (unit * s) @ s / 2
    off = lambda h: float(np.abs((h - wanted) / unit).max())
    while scans < ROUNDS and total and off(have) >= TOLERANCE:
        slope = have - wanted - RIDGE * unit * steps
        step = np.linalg.pinv(gram + np.diag(RIDGE * unit), rcond=1e-12) @ slope
        tried = [np.round(steps + length * step, 9) for length in LENGTHS]
        seen = scan(tried)
        scans += 1
        best = min(range(len(tried)), key=lambda i: objective(tried[i], seen[i][2]))
        if not objective(tried[best], seen[best][2]) < objective(steps, square):
            break
        steps, (have, gram, square) = tried[best], seen[best]
    fit = Fit(dict(zip(domains, map(float, steps))), dict(zip(domains, (have / total if total else have).tolist())), off(have) if total else 0.0, scans)
    if not fit.met:
        warnings.warn(f"rates miss the targets by {fit.off:.1%} of a domain's at most: shares {fit.shares}", stacklevel=2)
    return fit


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """(doc_id, text_hash, n_tokens, p_<domain>..., rate, target_met, copies) for every row of ``docs``; tokens are words.

    ``copies`` realises the rate: its whole part, and one more with the probability of the rest, drawn by a hash of doc_id. Null and empty texts have no tokens, the prior as posterior, and the rate that follows from it.
    Repeated rows come out repeated, each with the same rate. A domain without labelled words takes no part: the others share its target, since nothing is known of what belongs to it. Without labelled
    words at all every rate is one. ``target_met`` is false in every row where the fit misses a target or nothing is labelled, and a warning is given. Repeated labels of a document count once: toxic if any says so, low
    if any says so. Other columns of ``docs`` take no part."""
    targets = targets or TARGETS
    domains = list(targets)
    table, known = _posteriors(docs, labels, domains)
    table = staged(table, "posteriors")
    wanted = {d: targets[d] for d in known if targets[d] > 0}
    if wanted:
        fit = fit_rates(table, {d: targets[d] for d in known})
    else:
        warnings.warn("nothing is labelled: all rates are one, which may miss the targets", stacklevel=2)
        fit = Fit({}, {}, 1.0, 0)
    draw = F.pmod(F.xxhash64("doc_id", F.lit("copies")), F.lit(1 << 30)) / F.lit(1 << 30)
    out = table.select("doc_id", "text_hash", "n_tokens", *(f"p_{d}" for d in domains), rate_after(fit.steps).alias("rate"), F.lit(fit.met).alias("target_met"), F.explode(F.sequence(F.lit(1).cast("long"), "rows")).alias("row"))
    return out.withColumn("copies", F.floor(F.col("rate") + draw)).drop("row")


def mixed(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``docs`` with each row as often as its copies say. Where the targets are not met, every row stays once: documents are not thrown away for
    a mixture that is missed all the same."""
    copies = F.when(F.col("target_met"), F.col("copies")).otherwise(1).cast("long").alias("copies")
    plan = mix(docs, labels, targets).select("doc_id", "text_hash", copies).dropDuplicates(["doc_id", "text_hash"]).filter("copies > 0")
    rows = docs.select(F.struct(*docs.columns).alias("row"))  # one column, so that no other can have its name
    same = F.col("row.doc_id").eqNullSafe(F.col("doc_id")) & (F.xxhash64(F.coalesce("row.text", F.lit(""))) == F.col("text_hash"))
    return rows.join(plan, same).select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select("row.*")
