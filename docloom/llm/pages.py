"""Main text of web pages: boosted trees over the nodes of the page's tree, decoded from the root down.

Each node is article (all text below it), clutter (none) or mixed. The trees give every node the three probabilities; the
best consistent labelling has only article below article and only clutter below clutter, and is found in one pass up and one down.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, spread
from .dom import Node, features, order, parse
from .page_maker import Maker
from .trees import Forest

ARTICLE, CLUTTER, MIXED = 0, 1, 2
TRAINING_PAGES, SEED = 250, 17
#: Nodes whose features are held at once, and those of the page that passes it.
NODES_AT_ONCE = 20_000


def truth(nodes: list[Node]) -> np.ndarray:
    """Class of each node of a labelled page."""
    kinds: dict[int, set[str]] = {}
    for v in reversed(nodes):
        own = {v.label} if v.tag == "#text" else set().union(*(kinds[id(c)] for c in v.children))
        kinds[id(v)] = own
    return np.array([MIXED if len(kinds[id(v)]) > 1 else ARTICLE if "in" in kinds[id(v)] else CLUTTER for v in nodes])


def train(pages: int = TRAINING_PAGES) -> Forest:
    x, y = [], []
    for i in range(pages):
        nodes = order(parse(Maker(SEED * 100_003 + i).page()))
        x.append(features(nodes))
        y.append(truth(nodes))
    return Forest(3).fit(np.concatenate(x), np.concatenate(y))


def consistent(nodes: list[Node], logs: np.ndarray) -> list[int]:
    """The most likely labels under which descendants agree with their ancestors."""
    index = {id(v): i for i, v in enumerate(nodes)}
    alike = logs[:, :2].copy()  # log-probability that the whole subtree is article, or clutter
    free = np.zeros(len(nodes))
    for i in range(len(nodes) - 1, -1, -1):
        below = [index[id(c)] for c in nodes[i].children]
        for j in below:
            alike[i] += alike[j]
        split = logs[i, MIXED] + sum(free[j] for j in below) if below else -np.inf
        free[i] = max(alike[i, 0], alike[i, 1], split)
    label = [MIXED] * len(nodes)
    for i, v in enumerate(nodes):
        above = label[index[id(v.parent)]] if v.parent is not None and id(v.parent) in index else MIXED
        if above != MIXED:
            label[i] = above
        elif free[i] == alike[i, 0]:
            label[i] = ARTICLE
        elif free[i] == alike[i, 1]:
            label[i] = CLUTTER
    return label


def main_texts(pages: list[str | None], forest: Forest) -> list[str]:
    """The article blocks of each page, joined by two line feeds. Pages are judged together, up to some number of nodes."""
    out: list[str] = []
    held: list[list[Node]] = []

    def judge() -> None:
        rows = [features(t) for t in held if t]
        logs, at = forest.log_probabilities(np.concatenate(rows)) if rows else np.zeros((0, 3)), 0
        for nodes in held:
            label = consistent(nodes, logs[at : at + len(nodes)])
            at += len(nodes)
            out.append("\n\n".join(v.text for v, k in zip(nodes, label) if k == ARTICLE and v.tag == "#text"))
        held.clear()

    for page in pages:
        held.append(order(parse(page or "")))
        if sum(map(len, held)) >= NODES_AT_ONCE:
            judge()
    judge()
    return out


@lru_cache(1)
def trained() -> Forest:
    return train()


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, text and n_chars for every page; text is empty where html is null, empty or without an article.
    What ``dom.NEVER_TEXT`` lists, and elements with the attribute hidden or the style display:none, are left out also within an article: a reader of the page sees none of them.
    Pages of any length are read whole, in time linear in it. Of markup that is broken, what is text is kept. Where labellings of a page are equally likely, its
    nodes are article before clutter, and these before mixed. Repeated rows come out repeated; other columns take no part."""
    sent = pages.sparkSession.sparkContext.broadcast(trained())  # a few hundred small trees

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = main_texts(batch.column(len(keep)).to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    small_batches(pages.sparkSession)
    source = pages.select(*keep, F.col(html).alias("html"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1])
    return spread(source).mapInArrow(rows, f"{kinds}, text string, n_chars long")
