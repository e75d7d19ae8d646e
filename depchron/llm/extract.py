"""The main text of web pages, by gradient-boosted trees over the features of DOM nodes.

Every node of a page (``dom``) has features: size and density of its subtree, links, marks, depth, siblings, and the words of its
attributes, each weighted by how often it names main text and how often what is cut. Boosted trees (Spark's own, trained here on ``PAGES``
pages of known make, ``layouts``) give each node the log-odds that it is main text.

Nodes are not judged one by one: on the way down a page may enter its main text and leave it, once each, so no cut node has chosen
descendants and no chosen node lies below a cut one. Among all labellings of that kind, the one of the highest summed
log-odds is found by one pass up the tree and one down; entering and leaving cost ``ENTER`` and ``LEAVE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from depchron.llm import dom, layouts
from depchron.sources.work import shipped, table, written

#: Pages of known make that the trees are trained on, the number of trees and their depth.
PAGES, TREES, DEPTH = 3000, 30, 5
#: Costs of entering and of leaving the main text; log-odds are cut to this size, so that no node outweighs all others.
ENTER, LEAVE, MOST = 1.0, 0.25, 5.0
#: Tasks of the training; nodes that are scored at a time.
TASKS, NODES = 8, 50_000


def _labelled(scores):
    """Training rows from page numbers: each node's label (0 holder, 1 main, 2 cut), its attribute words, and features if ``scores`` are known."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = scores.value if scores else None
        for batch in batches:
            for number in batch.column(0).to_pylist():
                page = dom.Page(layouts.page(number), layouts.LABEL)
                features = page.features(known) if known is not None else [[]] * len(page.parent)
                there = [c > 0 for c in page.chars] if known is not None else [True] * len(page.parent)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x for x, t in zip(page.label, there, strict=True) if t], pa.int32()),
                        pa.array([list(set(x)) for x, t in zip(page.words, there, strict=True) if t], pa.list_(pa.string())),
                        pa.array([x for x, t in zip(features, there, strict=True) if t], pa.list_(pa.float64())),
                    ],
                    names=["label", "words", "features"],
                )

    return rows


def word_scores(labelled: DataFrame) -> dict[str, tuple[float, float]]:
    """Two weights for each attribute word: log-odds against the mean that its node is main text, and that it is cut.

    The words are those of the made-up pages, a few hundred.
    """
    every = labelled.select("label", F.explode("words").alias("w"))
    of = lambda k: F.count_if(F.col("label") == k)
    total = every.agg(F.count(F.lit(1)).alias("n"), of(1).alias("a"), of(2).alias("b")).first()
    odds = lambda k, base: F.log((of(k) + base) / (F.count(F.lit(1)) - of(k) + 1 - base)) - F.log(F.lit(base / (1 - base)))
    found = every.groupBy("w").agg(odds(1, total["a"] / total["n"]).alias("a"), odds(2, total["b"] / total["n"]).alias("b"), F.count(F.lit(1)).alias("n"))
    return {r["w"]: (round(r["a"], 6), round(r["b"], 6)) for r in found.filter("n >= 15").collect()}


class Forest:
    """Boosted trees as arrays, to score many nodes at once."""

    def __init__(self, model):
        rows: list[tuple[int, float, int, int, float]] = []  # feature, threshold, left, right, value

        def add(node) -> int:
            at = len(rows)
            rows.append((-1, 0.0, at, at, node.prediction()))
            if node.subtreeDepth() > 0:
                split = node.split()
                left = add(node.leftChild())
                rows[at] = (split.featureIndex(), split.threshold(), left, add(node.rightChild()), 0.0)
            return at

        self.roots = [add(tree._java_obj.rootNode()) for tree in model.trees]
        feature, threshold, left, right, value = zip(*rows, strict=True)
        self.feature, self.threshold = np.array(feature), np.array(threshold)
        self.left, self.right, self.value = np.array(left), np.array(right), np.array(value)
        self.weights, self.depth = list(model.treeWeights), DEPTH

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        every, total = np.arange(len(features)), np.zeros(len(features))
        for root, weight in zip(self.roots, self.weights, strict=True):
            at = np.full(len(features), root)
            for _ in range(self.depth):
                feature = self.feature[at]
                at = np.where((features[every, feature] <= self.threshold[at]) | (feature < 0), self.left[at], self.right[at])
            total += weight * self.value[at]
        return 2 * total


def trained(spark: SparkSession, pages: int = PAGES, trees: int = TREES) -> tuple[Forest, dict[str, tuple[float, float]]]:
    """The forest and the weights of attribute words; trained once for each application."""
    key = (spark.sparkContext.applicationId, pages, trees)
    if getattr(trained, "of", None) != key:
        numbers = shipped(spark).range(0, pages, 1, TASKS)
        schema = "label int, words array<string>, features array<double>"
        scores = word_scores(numbers.mapInArrow(_labelled(None), schema))
        rows = written(numbers.mapInArrow(_labelled(spark.sparkContext.broadcast(scores)), schema), "extract-nodes")
        rows = rows.select((F.col("label") == 1).cast("double").alias("label"), array_to_vector("features").alias("features")).coalesce(TASKS)
        model = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=0.3, seed=1, maxBins=48).fit(rows)
        trained.model, trained.of = (Forest(model), scores), key
    return trained.model


def decode(parent: list[int], odds: list[float]) -> list[bool]:
    """Which nodes are main text: the labelling of the highest sum among those that enter it once and leave it once on any way down.

    Nodes are in page order, so a parent comes before its children.
    """
    n = len(parent)
    inside, outside = list(odds), [0.0] * n  # best sums of a subtree whose root is main text, or has not entered it yet; what has left sums to 0
    for i in range(n - 1, 0, -1):
        p = parent[i]
        inside[p] += max(inside[i], -LEAVE)
        outside[p] += max(outside[i], inside[i] - ENTER)
    state = [0] * n  # 0 not entered, 1 main text, 2 left
    for i in range(n):
        above = state[parent[i]] if i else 0
        if above == 0:
            state[i] = int(inside[i] - ENTER > outside[i])
        elif above == 1:
            state[i] = 1 if inside[i] >= -LEAVE else 2
        else:
            state[i] = 2
    return [s == 1 for s in state]


def _extractor(model):
    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest, scores = model.value

        def texts(pages: list[dom.Page], features: list[list[float]]) -> Iterator[str]:
            odds = np.clip(forest.log_odds(np.array(features, np.float64)), -MOST, MOST) if features else np.empty(0)
            start = 0
            for page in pages:
                own = odds[start : start + len(page.parent)]
                start += len(page.parent)
                own = np.where(np.array(page.chars) > 0, own, 0.0)
                yield page.text(decode(page.parent, own.tolist()))

        for batch in batches:
            found: list[str] = []
            pages: list[dom.Page] = []
            features: list[list[float]] = []
            for source in batch.column(batch.num_columns - 1):
                pages.append(page := dom.Page(source.as_py() or ""))
                features += page.features(scores)
                if len(features) >= NODES:
                    found += texts(pages, features)
                    pages, features = [], []
            found += texts(pages, features)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string())], names=batch.schema.names)

    return extract


def extract(pages: DataFrame, html_col: str = "html", carry: list[str] | None = None) -> DataFrame:
    """(``carry``, text): the main text of each page, blocks in page order with a line feed between, all other white space as one space.

    ``carry`` are the columns of ``pages`` to keep, all others by default; one named ``text`` is replaced. A null or empty page, or one
    without main text, has an empty text. Pages of any length and depth are read whole; repeated rows are extracted each; an empty table has no rows.
    """
    spark = shipped(pages.sparkSession)
    carry = [c for c in (carry if carry is not None else pages.columns) if c not in (html_col, "text")]
    rows = pages.select(*[F.col(f"`{c}`") for c in carry], F.col(html_col).cast("string").alias("text"))
    return rows.mapInArrow(_extractor(spark.sparkContext.broadcast(trained(spark))), rows.schema)


def op13_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of all pages."""
    found = extract(table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
