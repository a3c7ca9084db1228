"""Fitted boosted trees as one SQL expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _node(node, feature) -> Column:
    if node.subtreeDepth() == 0:
        return F.lit(float(node.prediction()))
    split = node.split()
    return F.when(feature(split.featureIndex()) <= F.lit(float(split.threshold())), _node(node.leftChild(), feature)).otherwise(_node(node.rightChild(), feature))


def margin(model, feature) -> Column:
    """The weighted sum of the trees of a boosted model over continuous features.

    ``feature(i)`` gives the column of feature ``i``; class 1 is likelier than not where the
    sum is over 0, with the logistic function of twice the sum as its probability.
    """
    total = F.lit(0.0)
    for tree, weight in zip(model.trees, model.treeWeights):
        total = total + F.lit(float(weight)) * _node(tree._call_java("rootNode"), feature)
    return total


def importances(model, names: list[str]) -> dict[str, float]:
    """Each feature's share of the trees' gain."""
    return dict(zip(names, model.featureImportances.toArray().tolist()))
