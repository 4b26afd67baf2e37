"""Trained decision trees as plain nested tuples: (feature, threshold, left, right) or a leaf's share of label 1."""

from __future__ import annotations


def plain(node):
    """A Spark ML tree node (JVM) as nested tuples; ``left`` holds where value <= threshold."""
    if node.getClass().getSimpleName() == "LeafNode":
        counts = list(node.impurityStats().stats())
        total = sum(counts)
        return (counts[1] / total) if len(counts) > 1 and total else 0.0
    split = node.split()
    return split.featureIndex(), split.threshold(), plain(node.leftChild()), plain(node.rightChild())


def root(model):
    return plain(model._java_obj.rootNode())


def share(tree, features) -> float:
    while not isinstance(tree, float):
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree


def paths(tree, above=()):
    """Conjunctive rules: every node below the root as the tuple of its (feature, threshold, is_low) tests."""
    if above:
        yield above
    if not isinstance(tree, float):
        f, t, low, high = tree
        yield from paths(low, (*above, (f, t, True)))
        yield from paths(high, (*above, (f, t, False)))
