"""MinHash near-duplicates against Jaccard similarities of all pairs."""

import random
from itertools import combinations
from math import comb

import numpy as np
import pytest

from docloom.llm import minhash
from tests.llm import brute

SCHEMA = "doc_id long, text string"


def text_of(rng, n, words=5000):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def edited(rng, words, places):
    out = list(words)
    for i in rng.sample(range(len(out)), places):
        out[i] = f"new{rng.randrange(10**7)}"
    return out


def planted(seed):
    """Groups around the threshold, families on a template under it, families of families, parts of others, and odd texts."""
    rng, rows = random.Random(seed), []
    for _ in range(6):
        base = text_of(rng, 200)
        rows += [edited(rng, base, rng.choice([0, 1, 2, 4, 5, 6, 8, 12])) for _ in range(30)]
    for share in (20, 35, 60):  # a template, and words of one's own: similarities of about 0.85, 0.75, 0.6
        base = text_of(rng, 240)
        for _ in range(3):
            mine = text_of(rng, share // 2)  # what a third of the family has besides
            rows += [base + mine + text_of(rng, share // 2 + rng.randrange(6)) for _ in range(25)]
        rows += [base[: rng.randrange(150, 240)] for _ in range(25)]
    base = text_of(rng, 300)
    rows += [base[rng.randrange(70) :][: rng.randrange(200, 300)] for _ in range(60)]
    rows += [text_of(rng, rng.randrange(1, 6), 3) for _ in range(30)]
    rng.shuffle(rows)
    return [(i, " ".join(w)) for i, w in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_all_pairs(spark, seed):
    rows = planted(seed)
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()))
    want = sorted(brute.minhash(rows))
    assert got == want
    sizes = [sum(c == d for _, _, c, _ in want) for d in {c for _, _, c, _ in want}]
    assert max(sizes) > 25 and sum(s == 1 for s in sizes) > 50  # both groups and families that are none


def test_odd_rows(spark):
    """Nulls, blanks, short texts, cases, odd blanks, repeated rows and ids, other columns of clashing names."""
    long = " ".join(text_of(random.Random(4), 30_000))
    rows = [(1, None), (2, ""), (3, " \t "), (4, "One two"), (5, "one\x0bTWO"), (5, "one\x0bTWO"), (6, "two one"), (7, "a b c d"), (8, "A B  C\td"), (9, "Ä b c d"), (10, "ä b c d"), (11, long), (12, long + " end"), (13, long[: len(long) // 2])]
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as n", "2 as node", "'s' as signature", "3 as key")
    assert sorted(map(tuple, minhash.near_duplicates(docs).collect())) == sorted(brute.minhash(rows))
    rows = [(None, "a b c d e"), (3, "a b c d e"), (None, "x y z v w"), (None, None), (5, "q r s t"), (5, "other words are here")]
    got = sorted(map(str, map(tuple, minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect())))
    assert got == sorted(map(str, [(None, 2, 3, False), (3, 2, 3, True), (None, 2, None, True), (None, 0, None, True), (5, 1, 5, True), (5, 1, 5, True)]))
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []


def test_family_under_the_threshold_is_not_compared_all_with_all(spark, monkeypatch):
    """5,000 texts of similarity 0.7 to each other, no two of them near: pairs grow with the members, not with their square."""
    rng = random.Random(6)
    base = text_of(rng, 120, 10**6)
    rows = [(i, " ".join(base + text_of(rng, 26, 10**9))) for i in range(5000)]
    a, b = (minhash.shingles(t.encode()) for _, t in rows[:2])
    assert 0.68 < len(np.intersect1d(a, b)) / len(np.union1d(a, b)) < 0.72
    seen = []
    likely = minhash.likely
    monkeypatch.setattr(minhash, "likely", lambda pairs, *rest: seen.append(pairs.count()) or likely(pairs, *rest))
    verified = minhash.verified
    within = lambda rows: sum(r["count"] ** 2 // 2 for r in rows.groupBy("i", "j").count().collect())  # noqa: E731  pairs within the blocks of a task
    monkeypatch.setattr(minhash, "verified", lambda rows, *rest: seen.append(within(rows)) or verified(rows, *rest))
    got = minhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    assert all(r.kept for r in got) and len(got) == 5000
    assert sum(seen) < 40 * 5000  # all pairs: 12,497,500


def test_posterior_bounds():
    """Pairs of just the similarity are given up with the chosen probability at most; far ones nearly always."""
    least = minhash.least_matches(80)
    for i, m in enumerate(least):
        h = (i + 1) * minhash.BATCH
        tail = lambda k: sum(comb(h + 1, j) * 0.8**j * 0.2 ** (h + 1 - j) for j in range(k + 1))  # noqa: E731,B023
        assert tail(m) >= minhash.MISS > tail(m - 1)
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 32, (4000, minhash.HASHES), np.uint32)
    b = np.where(rng.random(a.shape) < np.repeat([0.8, 0.3], 2000)[:, None], a, a + 1)
    alive = minhash.survivors(a, b, least)
    assert set(range(2000)) <= set(alive.tolist()) and (alive >= 2000).sum() < 3


def test_signatures_estimate_similarity():
    rng = random.Random(8)
    base = text_of(rng, 400)
    sets = [minhash.shingles(" ".join(edited(rng, base, k)).encode()) for k in (0, 5, 20, 60)]
    for x, y in combinations(sets, 2):
        true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
        a, b = (np.frombuffer(minhash.signature(s), minhash.KIND) for s in (x, y))
        assert abs((a == b).mean() - true) < 0.17
