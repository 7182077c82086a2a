"""Models are learned from all labelled rows, however many there are."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import language, mixing, toxicity
from docloom.llm.common import held_out

from .test_models import corpus  # noqa: F401


def test_toxicity_counts_every_labelled_row(spark):
    """Words in as many texts as the network asks for, of 9,600 labelled ones: each has its embedding, and no other word has."""
    ids = spark.range(12_000).filter(~held_out(F.col("id")) & (F.col("id") % 4 != 3)).orderBy("id").limit(20 * toxicity.LEAST_TEXTS).collect()
    place = {r.id: i for i, r in enumerate(ids)}
    letters = "abcdefghijklmnopqrstu"
    rows = [(i, "common" + (f" rare{letters[place[i] // toxicity.LEAST_TEXTS]}word" if i in place else "")) for i in range(12_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lang", F.lit("en"))
    labels = docs.select("doc_id", F.lit(1).alias("quality"), (F.col("doc_id") % 5 == 0).cast("int").alias("toxic"))
    net = toxicity.learn(docs, labels)
    assert all(net.rows_of[toxicity.buckets(f"rare{x}word")].all() for x in letters[:20])
    assert not net.rows_of[toxicity.buckets("rareuword")[0, 0]]


def test_toxicity_by_several_shards(corpus, monkeypatch):  # noqa: F811
    docs, labels = corpus
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 60)
    net = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, net).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.9
    again = toxicity.learn(docs.repartition(7), labels.repartition(2))
    assert np.allclose(toxicity.weights(again), toxicity.weights(net), atol=1e-6) and again.cut == net.cut


def test_weights_there_and_back():
    net = toxicity.train(["a dolt", "a stone"] * 20, np.array([1.0, 0.0] * 20))
    same = toxicity.with_weights(net, toxicity.weights(net))
    assert (toxicity.weights(same) == toxicity.weights(net)).all() and all((a == b).all() for a, b in zip(same.filters, net.filters))
    assert (same.bias == net.bias).all() and (same.out == net.out).all() and same.out_bias == net.out_bias


def test_cut_of_counts_is_the_cut_of_rows():
    rng = np.random.default_rng(3)
    logits, toxic = rng.integers(-20, 20, 400) / 4, rng.random(400) < 0.3
    cut = toxicity.best_cut(*toxicity._merged(logits, np.ones(400), toxic))
    f1 = lambda c: 2 * (toxic & (logits > c)).sum() / ((logits > c).sum() + toxic.sum())
    assert f1(cut) == pytest.approx(max(f1(c - 0.1) for c in np.unique(logits)))


def test_language_profiles_are_sums_over_all_texts(spark):
    texts = [f"stone {chr(97 + i % 26)}{chr(97 + i // 26 % 26)} walks {chr(97 + i // 676)}" for i in range(3_400)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("lang", F.lit("en"))
    known = docs.filter(~held_out(F.col("doc_id"))).collect()
    weighed = [language.trigrams(r.text) for r in known]
    total = sum(np.sqrt(c / c.sum()) @ language.grams().of(g).astype(float) for g, c in weighed)
    assert np.allclose(language.learn(docs).prototypes[0], total / np.linalg.norm(total), atol=1e-6)


def test_mixing_counts_every_labelled_row(spark):
    labels = spark.range(25_000).select(F.col("id").alias("doc_id"), (F.col("id") % 10 != 0).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    docs = labels.select("doc_id", F.lit("stone walks").alias("text"))
    prior = mixing.word_weights(docs, labels, ["clean", "low"])[1]
    assert prior == {"clean": 22_501 / 25_002, "low": 2_501 / 25_002}


def test_mixing_moves_buckets_not_texts_at_any_size(spark, monkeypatch):
    """Few labels are not broadcast where many are not: else what is moved would jump with the input."""
    docs = spark.createDataFrame([(1, "Stone walks  stone"), (2, None), (3, " "), (4, "dolt"), (5, "no label"), (None, "stone")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (3, 0, 0), (4, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    frames = {}
    monkeypatch.setattr(mixing, "staged", lambda df, name: frames.setdefault(name, df))
    mixing.word_weights(docs, labels, ["clean", "toxic"])
    plan = frames["words"]._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    counts = {(r.n_clean, r.n_toxic) for r in frames["words"].collect()}
    assert counts == {(2, 0), (1, 0), (0, 1)}
    same = mixing.words(docs.filter("doc_id in (1, 4)"), "doc_id").filter("is_word").groupBy("bucket").count()
    assert {(r.bucket, r["count"]) for r in same.collect()} == {(r.bucket, r.n_clean + r.n_toxic) for r in frames["words"].collect()}


def test_toxicity_hashes_texts_together(monkeypatch):
    """As many texts as fit are hashed by one pass over their bytes, and get the buckets that each has by itself."""
    texts = ["Stone walks, dolt!", None, "", " \n", "\u00fcber se\u00f1or e\u0301lan", "a" * 70_000, "x1 y2-stone", "\u65e5\u672c\u8a9e \U0001f600", "tail"] * 3
    passes, real = [], toxicity.headed_hashes
    monkeypatch.setattr(toxicity, "headed_hashes", lambda data, heads: passes.append(len(data)) or real(data, heads))
    together = toxicity.all_buckets(texts)
    assert len(passes) == 2 and len(together) == len(texts) and toxicity.all_buckets([]) == []
    for text, got in zip(texts, together):
        words = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in (text or "").lower()).split(" ")
        own = [toxicity.buckets(w)[0] for w in words if w]
        assert got.shape == (len(own), 2) and (got == np.array(own, np.int64).reshape(-1, 2)).all()


def test_languages_are_looked_up_together(monkeypatch):
    texts = ["stone walks", "der stein geht", "", "la piedra anda", "42", "stone walks der"] * 50
    some = language.Profiles(["de", "en", "es"], np.stack([language.vector(t) for t in ("der stein geht", "the stone walks", "la piedra anda")]))
    calls, real = [], some.products
    monkeypatch.setattr(some, "products", lambda found: calls.append(len(found)) or real(found))
    assert some.all_nearest(texts) == [some.predict(t)[0] for t in texts] and len(calls) == 1
    assert some.all_nearest([]) == [] and language.Profiles([], np.zeros((0, language.DIMENSIONS))).all_nearest(["a", ""]) == ["und", "und"]
