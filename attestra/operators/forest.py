"""A decision forest as plain data, evaluated as one expression.

Trees are nested tuples, so a forest can be stored as a table, written by hand, or exported from a trained one. Its
probabilities are CASE expressions: they stay inside generated code, need no vectors and no Python, and can be evaluated under many
combinations of inputs, which is what decision feedback asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from attestra.schema import FEATURES

LEGITIMATE = "LEGITIMATE"
NODES = ("tree int, node int, feature string, threshold double, left_node int, right_node int, shares array<double>")


@dataclass(frozen=True)
class Forest:
    """``trees``: a leaf is a tuple of class shares in the order of ``labels``; a split is (feature, threshold, left, right),
    left if the value is at most the threshold. ``importances`` are in the order of the 15 features."""

    labels: tuple[str, ...]
    trees: tuple
    importances: tuple[float, ...] = (0.0,) * len(FEATURES)


def _is_leaf(tree) -> bool:
    return not isinstance(tree[0], str)


def _value(tree, k: int) -> Column:
    if _is_leaf(tree):
        return F.lit(float(tree[k]))
    feature, threshold, left, right = tree
    return F.when(F.coalesce(F.col(feature).cast("double"), F.lit(0.0)) <= threshold, _value(left, k)).otherwise(_value(right, k))


def share(forest: Forest, label: str) -> Column:
    """Mean share of a class over all trees."""
    k = forest.labels.index(label)
    total = _value(forest.trees[0], k)
    for tree in forest.trees[1:]:
        total = total + _value(tree, k)
    return total / float(len(forest.trees))


def fraud_share(forest: Forest) -> Column:
    """L3: 1 - P(LEGITIMATE), or the largest class probability if there is no such class."""
    if LEGITIMATE in forest.labels:
        return 1.0 - share(forest, LEGITIMATE)
    shares = [share(forest, x) for x in forest.labels]
    return F.greatest(*shares) if len(shares) > 1 else shares[0]


def exported(model: PipelineModel) -> Forest:
    """The forest of a trained pipeline (class shares of each leaf, as the model averages them)."""
    indexer, _, trained = model.stages[:3]

    def walk(node):
        if node.numDescendants() == 0:
            stats = [float(node.impurityStats().stats()[i]) for i in range(len(indexer.labels))]
            total = sum(stats)
            return tuple(x / total for x in stats)
        split = node.split()
        return FEATURES[split.featureIndex()], float(split.threshold()), walk(node.leftChild()), walk(node.rightChild())

    return Forest(tuple(indexer.labels), tuple(walk(t._java_obj.rootNode()) for t in trained.trees),
                  tuple(trained.featureImportances.toArray().tolist()))


def to_table(spark: SparkSession, forest: Forest) -> DataFrame:
    """One row for each node; the root of a tree is node 0, a leaf has shares and no feature."""
    rows = []

    def add(tree_no: int, tree) -> int:
        mine = sum(r[0] == tree_no for r in rows)
        row = [tree_no, mine, None, None, None, None, None]
        rows.append(row)
        if _is_leaf(tree):
            row[6] = [float(x) for x in tree]
        else:
            row[2], row[3] = tree[0], float(tree[1])
            row[4] = add(tree_no, tree[2])
            row[5] = add(tree_no, tree[3])
        return mine

    for n, tree in enumerate(forest.trees):
        add(n, tree)
    return spark.createDataFrame([tuple(r) for r in rows], NODES)


def from_table(nodes: DataFrame, labels: tuple[str, ...], importances: tuple[float, ...] = (0.0,) * len(FEATURES)) -> Forest:
    """The forest of such a table; its size is that of a model, not of data."""
    found = {(r["tree"], r["node"]): r for r in nodes.collect()}

    def walk(tree: int, node: int):
        r = found[tree, node]
        if r["feature"] is None:
            return tuple(r["shares"])
        return r["feature"], r["threshold"], walk(tree, r["left_node"]), walk(tree, r["right_node"])

    return Forest(tuple(labels), tuple(walk(t, 0) for t in sorted({t for t, _ in found})), tuple(importances))
