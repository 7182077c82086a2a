import random

import pytest

#: Columns that some operator uses for itself.
CLASHES = "fp long, fingerprint string, component_id long, score double, n_words long, text_hash long, rate double, rows int, sha binary, spans string, media binary, ids string, base string, pii_id long, mix_id long, h long, word string, n long, pos int, doc_text string"


def prose(rng, n):
    return " ".join(rng.choice(["the", "of", "quick", "stone", "river", "über", "señor", "élan", "walks", "42", "x1"]) + rng.choice(["", "", ",", "."]) for _ in range(n))


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty, blank and very long texts, copies, near copies, repeated rows and a row without id."""
    rng = random.Random(4)
    base = prose(rng, 130)
    passage = prose(rng, 70)
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "word"), (5, "two words"), (6, base), (7, base), (8, base.replace("stone", "rock", 1)), (9, prose(rng, 40_000)), (10, "a" * 60_000), (11, passage + " " + prose(rng, 30))]
    rows += [(12, prose(rng, 90) + " " + passage), (12, prose(rng, 60)), (13, base), (13, base), (None, base), (None, None), (14, "<|endoftext|> 日本語 😀 ՘"), (15, "mail a.b@c-d.org or +1 (555) 010-9999 at 10.0.0.1"), (16, "\x00\x1c 　"), (17, "12345 !!! ...")]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The same as a table with columns of clashing names."""
    df = spark.createDataFrame(odd_rows, "doc_id long, text string")
    kinds = [c.split(" ") for c in CLASHES.split(", ")]
    return df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "length(text) as n_chars", *(f"cast(null as {k}) as {n}" for n, k in kinds)).repartition(3)


@pytest.fixture(scope="session")
def nothing(odd):
    return odd.limit(0)
