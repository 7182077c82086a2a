"""Personal data behind ordinary words."""

import random

from docloom.llm import pii


def test_scores_by_hand(spark):
    """The graph's scores by plain turns over random graphs, with seeds and without."""
    rng = random.Random(4)
    edges = sorted({(f"p{rng.randrange(12)}", rng.randrange(60)) for _ in range(160)})
    seeds = {i for i in range(60) if rng.random() < 0.3}
    members = {}
    for p, i in edges:
        members.setdefault(p, set()).add(i)
    members = {p: m for p, m in members.items() if len(m) >= pii.LEAST_INSTANCES}
    confidence = {p: len(m & seeds) / len(m) for p, m in members.items()}
    for _ in range(60):
        score = {i: 1.0 if i in seeds else pii.DAMPING * max((confidence[p] for p, m in members.items() if i in m), default=0) for i in range(60)}
        confidence = {p: sum(score[i] for i in m) / len(m) for p, m in members.items()}
    got = {r.pattern: r.confidence for r in pii.pattern_scores(spark.createDataFrame([(p, i, i in seeds) for p, i in edges], "pattern string, instance long, seed boolean")).collect()}
    assert got.keys() == confidence.keys() and all(abs(got[p] - confidence[p]) <= 2 * pii.SETTLED for p in got)


def test_word_contexts_lead_to_identifiers(spark):
    rows = [(i, f"please write to member number +1 555 010 {1000 + 37 * i} about it") for i in range(12)]
    rows += [(100, "he said member number AB1234567 was his"), (101, "the room 1234567 is free")]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "he said member number [ID] was his" and got[101] == rows[-1][1]


def test_a_pattern_of_one_text_marks_nothing(spark):
    rows = [(1, " ".join(f"member number +1 555 010 {1000 + 37 * i} and" for i in range(12))), (2, "his member number AB1234567 was")]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[2] == rows[1][1]


def test_identifiers_without_a_digit(spark):
    """After a pattern that leads to identifiers nearly always, a token without a digit is one; after one that words follow as well, it is not."""
    rows = [(i, f"then member number +1 555 010 {1000 + 37 * i} and the code name +1 555 020 {1000 + 37 * i} of it") for i in range(12)]
    rows += [(100, "his member number QUEBEC-alpha was new"), (101, "the code name AB1234567 of it"), (102, None)]
    rows += [(200 + i, f"the code name {w} of it") for i, w in enumerate(["sparrow", "thunder", "lantern", "october", "granite"])]
    got = {r.doc_id: r.text for r in pii.mask(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[100] == "his member number [ID] was new" and got[101] == "the code name [ID] of it" and got[102] is None
    assert all(got[i] == dict(rows)[i] for i in range(200, 205))


def test_many_patterns_in_parts(spark, monkeypatch):
    """More patterns than are sent at once: the same result."""
    monkeypatch.setattr(pii, "SENT_PATTERNS", 1)
    test_identifiers_without_a_digit(spark)
