"""Mixing, toxicity, search and page extraction."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docloom.llm import additive, language, mixing, pages, toxicity
from docloom.llm.dom import order, parse
from docloom.llm.page_maker import Maker
from tests.llm import brute
from tests.llm.conftest import prose


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(12)
    rows, labels = [], []
    for i in range(400):
        kind = rng.choices(["clean", "low", "toxic"], [6, 2, 2])[0]
        text = prose(rng, rng.randint(10, 60)).split(" ")
        extra = {"clean": ["library", "museum"], "low": ["###", "$$$", "%%%"], "toxic": ["dolt", "oaf", "lout"]}[kind]
        for _ in range(3):
            text.insert(rng.randrange(len(text)), rng.choice(extra))
        rows.append((i, " ".join(text), "en"))
        if i % 4 != 3:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_rates_meet_targets(corpus):
    docs, labels = corpus
    got = mixing.mix(docs, labels, {"clean": 0.5, "low": 0.2, "toxic": 0.3}).collect()
    t = np.array([r.n_tokens for r in got], float)
    p = np.array([[r.p_clean, r.p_low, r.p_toxic] for r in got])
    r = np.array([r.rate for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all()
    assert np.allclose((t * r) @ p / t.sum(), [0.5, 0.2, 0.3], atol=2e-3)
    assert np.allclose(r, brute.rates(t, p, {"clean": 0.5, "low": 0.2, "toxic": 0.3}), atol=1e-3) and all(x.target_met for x in got)
    copies = np.array([x.copies for x in got])
    assert (copies >= np.floor(r)).all() and (copies <= np.ceil(r)).all()


def test_targets_that_force_zero_rates(corpus):
    docs, labels = corpus
    table = mixing.staged(mixing.posteriors(docs, labels, list(mixing.TARGETS)), "posteriors")
    fit = mixing.fit_rates(table, {"clean": 0.99, "low": 0.005, "toxic": 0.005})
    got = table.withColumn("rate", mixing.rate_after(fit.steps)).collect()
    t = np.array([r.rate * r.n_tokens for r in got])
    shares = [float(t @ np.array([r[f"p_{d}"] for r in got]) / sum(r.n_tokens for r in got)) for d in mixing.TARGETS]
    assert fit.met and fit.scans <= 15 and np.allclose(shares, [0.99, 0.005, 0.005], rtol=1e-3) and sum(r.rate == 0 for r in got) > 20


def test_targets_out_of_reach_are_told(corpus):
    docs, labels = corpus
    with pytest.warns(UserWarning, match="miss the targets"):
        got = mixing.mix(docs, labels.limit(0), {"clean": 0.9, "low": 0.05, "toxic": 0.05})
    assert not got.first().target_met


def test_mixing_without_evidence_throws_nothing_away(corpus):
    """No label, labels of other documents, labels of one domain, one label: nobody knows what to leave out."""
    docs, labels = corpus
    ids = sorted(r.doc_id for r in docs.collect())
    clean = labels.filter("quality = 1 and toxic = 0")
    for few in (labels.limit(0), labels.selectExpr("doc_id + 10000 as doc_id", "quality", "toxic"), clean, clean.limit(1), labels.filter("toxic = 1").limit(1)):
        assert sorted(r.doc_id for r in mixing.mixed(docs, few).collect()) == ids
        assert {r.rate for r in mixing.mix(docs, few).collect()} == {1.0}
    # two domains share the third one's target
    got = mixing.mix(docs, labels.filter("toxic = 0"), {"clean": 0.6, "low": 0.2, "toxic": 0.2}).collect()
    tokens = np.array([r.n_tokens * r.rate for r in got])
    assert all(r.p_toxic == 0 and r.target_met for r in got) and np.allclose([tokens @ [r.p_clean for r in got], tokens @ [r.p_low for r in got]], np.array([0.75, 0.25]) * sum(r.n_tokens for r in got), rtol=1e-3)


def test_mixed_keeps_all_rows_where_targets_are_missed(spark):
    """Two texts of one posterior can not be both 0.5 and 0.5."""
    docs = spark.createDataFrame([(i, "same words") for i in range(40)] + [(100, "other"), (101, "else")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    with pytest.warns(UserWarning, match="miss the targets"):
        assert mixing.mixed(docs, labels, {"clean": 0.99, "low": 0.01, "toxic": 0.0}).count() == 42


def test_posteriors_by_hand(corpus):
    """The classifier again in plain Python, with a clashing label of one document."""
    docs, labels = corpus
    labels = labels.unionByName(labels.filter("doc_id = 0").selectExpr("doc_id", "0 as quality", "1 as toxic"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip((i for i, _ in rows), brute.posteriors(rows, [tuple(r) for r in labels.collect()])))
    for r in mixing.posteriors(docs, labels, list(mixing.TARGETS)).collect():
        assert np.allclose([r[f"p_{d}"] for d in mixing.TARGETS], want[r.doc_id], atol=1e-3)


def test_posteriors_know_the_domains(corpus):
    docs, labels = corpus
    got = mixing.mix(docs, labels).join(labels, "doc_id").withColumn("domain", mixing.domain_of(F.col("quality"), F.col("toxic"))).collect()
    hit = [max(mixing.TARGETS, key=lambda d, r=r: r[f"p_{d}"]) == r.domain for r in got]
    assert np.mean(hit) > 0.9


def test_mixing_odd_rows(odd, odd_rows, nothing, corpus):
    labels = corpus[1]
    got = mixing.mix(odd, labels)
    assert got.count() == len(odd_rows)
    assert {r.n_tokens for r in got.filter("doc_id in (1, 2, 3)").collect()} == {0}
    assert got.filter("doc_id = 9").first().n_tokens == 40_000
    assert mixing.mix(odd, labels.limit(0)).filter("rate is null or isnan(rate)").count() == 0
    assert mixing.mix(nothing, labels).count() == 0
    assert mixing.mixed(odd, labels).columns == odd.columns


def test_toxicity(corpus, odd, nothing):
    docs, labels = corpus
    net = toxicity.learn(docs, labels)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    got = [r for r in toxicity.score(docs, net).collect() if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in got]) > 0.9
    odd_got = toxicity.score(odd, net).collect()
    assert len(odd_got) == odd.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in odd_got)
    assert len({r.score for r in odd_got if r.doc_id in (1, 2, 3)}) == 1
    untaught = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(odd, untaught).filter("score is null").count() == 0
    assert toxicity.score(nothing, net).count() == 0


def test_toxicity_of_a_text_does_not_depend_on_its_neighbours():
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(0, 9)) + (" dolt" if i % 3 == 0 else "") for i in range(90)] + ["", "dolt"]
    net = toxicity.train(texts, np.array([float("dolt" in t) for t in texts]))
    together = net.scores(texts)
    assert np.allclose(together, [net.scores([t])[0] for t in texts], atol=1e-6) and np.allclose(together[::-1], net.scores(texts[::-1]), atol=1e-6)


def test_toxicity_pooling_and_gradients_by_hand():
    """Maxima of the convolutions by plain loops, and the gradients by differences of the loss."""
    rng = random.Random(3)
    net = toxicity.train([prose(rng, 20) + (" dolt" if i % 3 == 0 else "") for i in range(60)], np.array([float(i % 3 == 0) for i in range(60)]))
    batch = [net.rows_of[toxicity.buckets(t)] for t in ("", "dolt", "the stone of river dolt walks", "quick quick river")]
    labels = np.array([0.0, 1.0, 1.0, 0.0])

    def maxima():
        out = []
        for rows in batch:
            vectors = [np.zeros(toxicity.DIMENSIONS)] * 2 + [net.embedding[r].sum(axis=0) for r in rows] + [np.zeros(toxicity.DIMENSIONS)] * 3
            places = range(len(rows) + 3)
            out.append(np.concatenate([np.max([sum(vectors[i + j] @ f[j] for j in range(len(f))) for i in places], axis=0) for f in net.filters]) + net.bias)
        return np.array(out)

    def loss():
        z = np.maximum(maxima(), 0) @ net.out + net.out_bias
        return float(np.mean(np.log1p(np.exp(z)) - labels * z))

    got = toxicity.gradients(net, batch, labels)
    net.ready()
    assert np.allclose(net.pooled(batch), maxima(), atol=1e-5)
    step = 1e-5

    def slope(array, at):
        array[at] += step
        up = loss()
        array[at] -= 2 * step
        down = loss()
        array[at] += step
        return (up - down) / (2 * step)

    for k, f in enumerate(net.filters):
        for at in ((0, 0, 0), (k, 3, 5), (0, 7, 11)):
            assert slope(f, at) == pytest.approx(got["filters"][k][at], abs=1e-6)
    assert slope(net.bias, (4,)) == pytest.approx(got["bias"][4], abs=1e-6) and slope(net.out, (7,)) == pytest.approx(got["out"][7], abs=1e-6)
    for i, row in enumerate(got["rows"]):
        if row:
            assert slope(net.embedding, (row, 0)) == pytest.approx(got["embedding"][i, 0], abs=1e-6)


def test_toxicity_sample_is_bounded_and_labels_may_clash(spark, corpus):
    docs, labels = corpus
    clash = labels.unionByName(labels.selectExpr("doc_id", "quality", "0 as toxic"))
    texts = [r.text for r in docs.orderBy("doc_id").collect()[:30]]
    assert (toxicity.learn(docs, clash).scores(texts) == toxicity.learn(docs, labels).scores(texts)).all()
    few = toxicity.learn(docs, labels, sample_bytes=3000)
    assert few.rows_of.max() < toxicity.learn(docs, labels).rows_of.max()


def test_toxicity_of_long_texts():
    """Texts beyond one batch's budget are scored as alone."""
    rng = random.Random(6)
    net = toxicity.train([prose(rng, 9) + (" dolt" if i % 3 == 0 else "") for i in range(90)], np.array([float(i % 3 == 0) for i in range(90)]))
    texts = [prose(rng, 400_000) + " dolt", "dolt", prose(rng, 300_000), None]
    assert np.allclose(net.scores(texts), [net.scores([t])[0] for t in texts], atol=1e-6) and (net.scores(texts) >= 0.5).tolist() == [True, True, False, False]


def test_toxicity_gradients_lower_the_loss():
    rng = random.Random(3)
    texts = [prose(rng, 20) + (" dolt" if i % 3 == 0 else "") for i in range(120)]
    labels = np.array([float(i % 3 == 0) for i in range(120)])
    scores = toxicity.train(texts, labels).scores(texts)
    assert scores[labels == 1].min() > scores[labels == 0].max()


def exact(ids, x, query, k=5):
    """Best k other rows by cosine, ties to smaller ids."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x[query]
    best = sorted((-round(s[i], 12), ids[i]) for i in range(len(ids)) if ids[i] != ids[query])[:k]
    return [i for _, i in best]


def test_search_recall_and_ties(spark):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(600, 16)).round(3)
    x[300:450] = x[7]  # one vector many times
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    odd_rows = [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] * 16), (1150, [1.0] * 15 + [None]), (1200, [1.0]), (None, [1.0] * 16), (1250, [float("inf")] * 16), (3, rows[3][1])]
    df = spark.createDataFrame(rows + odd_rows, "vec_id long, embedding array<float>").withColumn("rep", F.lit(1)).withColumn("rank", F.lit("x")).repartition(3)
    got = {}
    for r in additive.search(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(range(0, 600, 50))
    x32 = x.astype(np.float32).astype(float)
    wanted = {q: exact(list(range(600)), x32, q) for q in got}
    assert np.mean([len(set(got[q]) & set(wanted[q])) / 5 for q in got]) >= 0.95
    for q in (300, 350, 400):
        assert got[q] == wanted[q]


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_search_in_many_small_blocks(spark, monkeypatch, partitions):
    """Whatever the blocks and their tasks are, the exact result."""
    monkeypatch.setattr(additive, "BLOCK_ROWS", 530)
    monkeypatch.setattr(additive, "TASK_BLOCKS", 1)
    monkeypatch.setattr(additive, "HELD_BLOCKS", 1)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(3000, 8))
    x[1000:2000] = x[0] + rng.normal(size=(1000, 8)) * 0.02
    x[2500:2600] = x[5] * np.exp2(np.arange(100) % 9)[:, None]  # one direction, many lengths
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(10_000 + i, [float(i), 1.0, -1.0]) for i in range(60)]  # another length
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {}
        for r in additive.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(partitions), F.col("vec_id") % 50 == 0).collect():
            got.setdefault(r.query_id, {})[r["rank"]] = r.vec_id
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert set(got) == {*range(0, 3000, 50), 10_000, 10_050}
    for q, found in got.items():
        at, ids, y = (q, range(3000), x) if q < 10_000 else (q - 10_000, range(10_000, 10_060), np.array([v for i, v in rows[3000:]]))
        assert [found[k] for k in range(1, 6)] == exact(list(ids), y, at), q


def test_search_small_and_empty(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 0.1]), (2, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = additive.search(few, F.col("vec_id") % 50 == 0).orderBy("rank").collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in got] == [(0, 1, 1), (0, 2, 2)] and got[1].score == -1.0
    assert additive.search(few.limit(0), F.col("vec_id") % 50 == 0).count() == 0


@pytest.fixture(scope="module")
def forest():
    return pages.trained()


def test_pages_of_other_layouts(forest):
    import re

    kept = wrong = missed = 0
    for i in range(40):
        page = Maker(5_000_000 + i).page()
        want = [v.text for v in order(parse(page)) if v.tag == "#text" and v.label == "in"]
        got = pages.main_texts([re.sub(r' data-truth="\w+"', "", page)], forest)[0].split("\n\n")
        kept += len([b for b in got if b in want])
        wrong += len([b for b in got if b not in want])
        missed += len([b for b in want if b not in got])
    assert kept / (kept + wrong) > 0.95 and kept / (kept + missed) > 0.95


def test_labels_are_consistent(forest):
    nodes = order(parse(Maker(77).page()))
    from docloom.llm.dom import features

    label = dict(zip(map(id, nodes), pages.consistent(nodes, forest.log_probabilities(features(nodes)))))
    for v in nodes:
        if v.parent is not None and label.get(id(v.parent), 2) != 2:
            assert label[id(v)] == label[id(v.parent)]


def test_best_consistent_labels_by_trying_all():
    """Of all labellings in which descendants agree with their ancestors, none is likelier, on small random trees."""
    from itertools import product

    from docloom.llm.dom import Node

    rng = random.Random(15)
    for _ in range(150):
        nodes = [Node("div", None)]
        for _ in range(rng.randint(0, 6)):
            nodes.append(Node("div", rng.choice(nodes)))
        nodes = sorted(nodes, key=lambda v: v.depth)  # parents first
        for v in nodes:
            v.tag = "div" if v.children else "#text"
        at = {id(v): i for i, v in enumerate(nodes)}
        logs = np.log(np.random.default_rng(rng.randrange(10**6)).dirichlet([1, 1, 1], len(nodes)))
        total = lambda labels, logs=logs: sum(logs[i, k] for i, k in enumerate(labels))
        fits = lambda labels, nodes=nodes, at=at: all(
            (k != pages.MIXED or v.children) and (v.parent is None or labels[at[id(v.parent)]] in (pages.MIXED, k)) for v, k in zip(nodes, labels)
        )
        best = max(total(labels) for labels in product(range(3), repeat=len(nodes)) if fits(labels))
        got = pages.consistent(nodes, logs)
        assert fits(got) and total(got) == pytest.approx(best)


@pytest.mark.parametrize(
    "page, texts",
    [
        ('<p title="x>y">Second', ["Second"]), ('<p><img alt="a > b">Third', ["Third"]), ("<p a='\">' b>one</p>", ["one"]), ('<p title="open>one</p><p>two</p>', ["one", "two"]), ("<p>it <a href=it's>one</a> two", ["it one two"]),
        ("a <b and c", ["a and c"]), ('x <div class="fo', ["x"]), ("<p>3 < 4 and 5 > 2</p>", ["3 < 4 and 5 > 2"]), ("<p>one <math><mi>x</mi></math> <svg><title>t</title><text>two</text></svg>", ["one x two"]),
    ],
)
def test_tags_and_quotes(page, texts):
    assert [v.text for v in order(parse(page)) if v.tag == "#text"] == texts


@pytest.mark.parametrize("piece", ["<span>x", "<span>x</b>", "<span><p>x", "<span><h2>x", "<li><dt><tr>x", "<div ", '<p a="x>', "<!x"])
def test_a_hundred_thousand_open_tags(piece):
    import time

    start = time.time()
    order(parse(piece * 100_000))
    assert time.time() - start < 60  # the square of the length takes an hour


def test_pages_odd_rows(spark):
    body = "<article><h1>A title here</h1>" + "".join(f"<p>Some long   sentence &amp; more, number {i}, of this article.</p>" for i in range(6)) + "</article>"
    page = f"<html><body><nav><ul><li><a href='/x'>Home</a></ul></nav><script>if (a < b) x('</p>')</script>{body}<footer>&copy; us</footer>"
    rows = [(1, "u", None), (2, "u", ""), (3, None, "no markup"), (None, "u", page), (5, "u", page), (5, "u", page), (6, "u", "<" * 3000), (7, "u", "<p>" * 3000 + "x"), (8, "u", "<div " * 2000), (9, "u", "a <b")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1)).withColumn("n_chars", F.lit("x"))
    got = pages.extract(df).collect()
    assert len(got) == len(rows)
    want = "A title here\n\n" + "\n\n".join(f"Some long sentence & more, number {i}, of this article." for i in range(6))
    assert [r.text for r in got if r.page_id in (5, None)] == [want] * 3
    assert all(r.n_chars == len(r.text) for r in got) and all(r.text == "" for r in got if r.page_id in (1, 2))
    assert pages.extract(df.limit(0)).count() == 0


def test_profiles_without_languages():
    assert language.Profiles([], np.zeros((0, language.DIMENSIONS))).predict("abc") == ("und", 0.0)
