"""Boosted trees for several classes whose chances sum to one, on histogram sums.

Features are cut into bins, and rows of the same bins are one cell with a count of each class, so a table is read once and rounds go over
cells. A round grows one tree with a value a class in each leaf: at each level one aggregation gives, for every node, feature and bin, the
sums of the gradients and of their curvature, from which the splits are chosen. What comes to the driver is those sums: nodes times
features times bins, whatever the number of rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ordered import kept

#: Least curvature of a side of a split, and what is added to it.
LEAST, RIDGE = 1e-3, 1.0


@dataclass
class Node:
    """A split (bins up to `bin` go left; unknown values, bin 0, too) or, without one, a leaf with a value a class."""

    values: list[float]
    feature: int = -1
    bin: int = -1
    left: Node | None = None
    right: Node | None = None


@dataclass
class Softmax:
    features: list[str]
    edges: list[list[float]]
    start: list[float]
    trees: list[Node] = field(default_factory=list)

    def binned(self, df: DataFrame) -> DataFrame:
        """df with _b0, _b1...: 0 for null, else 1 and how many edges the value is above."""
        return df.withColumns({f"_b{k}": bin_of(F.col(f).cast("double"), e) for k, (f, e) in enumerate(zip(self.features, self.edges, strict=True))})

    def scores(self) -> list[Column]:
        return [F.lit(s) + sum((_value(t, k) for t in self.trees), F.lit(0.0)) for k, s in enumerate(self.start)]

    def predicted(self, df: DataFrame, name: str) -> DataFrame:
        """df with an array of the classes' chances (a column of that name is replaced, all others stay)."""
        whole = F.struct(*[F.col(f"`{c}`").alias(c) for c in df.columns if c != name]).alias("_row")
        rows = self.binned(df.select(whole, *[F.col(f).alias(f) for f in self.features]))
        return rows.select("_row", F.array(*chances(self.scores())).alias("_p")).select("_row.*", F.col("_p").alias(name))


def bin_of(value: Column, edges: Sequence[float]) -> Column:
    """How many edges a value is above, plus 1; 0 where it is unknown."""
    known = value.isNotNull() & ~F.isnan(value)
    return F.when(known, F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]), lambda e: value > e)) + 1 if edges else F.lit(1)).otherwise(0)


def chances(scores: Sequence[Column]) -> list[Column]:
    top = F.greatest(*scores)
    total = sum((F.exp(s - top) for s in scores), F.lit(0.0))
    return [F.exp(s - top) / total for s in scores]


def _value(node: Node, k: int) -> Column:
    if node.left is None:
        return F.lit(float(node.values[k]))
    return F.when(F.col(f"_b{node.feature}") <= node.bin, _value(node.left, k)).otherwise(_value(node.right, k))


def _place(node: Node, path: int = 1) -> Column:
    """The number of the leaf that a row falls in: 1 for the root, 2n and 2n + 1 for what is under n."""
    if node.left is None:
        return F.lit(path)
    return F.when(F.col(f"_b{node.feature}") <= node.bin, _place(node.left, 2 * path)).otherwise(_place(node.right, 2 * path + 1))


def best_split(sums: np.ndarray) -> tuple[float, int, int]:
    """(gain, feature, bin) of sums[feature, bin, 2, class]: gradients and curvature; the first of equals."""
    upto = sums.cumsum(1)
    whole = upto[:, -1:, :]
    worth = lambda s: (s[:, :, 0] ** 2 / (s[:, :, 1] + RIDGE)).sum(-1)
    rest = whole - upto
    gain = worth(upto) + worth(rest) - worth(whole)
    thin = (upto[:, :, 1].sum(-1) < LEAST) | (rest[:, :, 1].sum(-1) < LEAST)
    gain = np.where(thin, -np.inf, np.round(gain, 9))
    f, b = np.unravel_index(int(gain.argmax()), gain.shape)
    return float(gain[f, b]), int(f), int(b)


def grown(sums_at, n_classes: int, depth: int, rate: float) -> Node:
    """A tree from sums_at(tree): the sums by the number of a leaf."""
    root = Node([0.0] * n_classes)
    for level in range(depth + 1):
        sums, open_ = sums_at(root), {1: root}
        leaves: dict[int, Node] = {}
        while open_:
            path, node = open_.popitem()
            if node.left is None:
                leaves[path] = node
            else:
                open_ |= {2 * path: node.left, 2 * path + 1: node.right}
        for path, node in leaves.items():
            if path not in sums:
                continue
            total = sums[path][0].sum(0)
            node.values = (rate * total[0] / (total[1] + RIDGE)).tolist()
            if level < depth and path.bit_length() == level + 1:
                gain, f, b = best_split(sums[path])
                if gain > 1e-6:
                    node.feature, node.bin = f, b
                    node.left, node.right = Node(list(node.values)), Node(list(node.values))
    return root


def fit(df: DataFrame, features: Sequence[str], label: str, classes: int, rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 16, every: int = 5) -> Softmax:
    """Learns the chances of labels 0 to classes - 1. Rows with another label or none count for nothing; without rows all classes are as likely.

    Edges are quantiles of each feature, `bins` at most; unknown values are a bin of their own that goes left. Scores are written once in `every` rounds.
    """
    rows = df.where(F.col(label).between(0, classes - 1)).select(F.col(label).cast("int").alias("_y"), *[F.col(f).cast("double").alias(f) for f in features])
    shares = [k / bins for k in range(1, bins)]
    asked = rows.agg(*[F.percentile_approx(f, shares, 10_000).alias(f"_{k}") for k, f in enumerate(features)]).first()
    model = Softmax(list(features), [sorted(set(asked[k] or [])) for k in range(len(features))], [0.0] * classes)
    places = [f"_b{k}" for k in range(len(features))]
    counts = [F.count(F.when(F.col("_y") == k, 1)).cast("double").alias(f"_n{k}") for k in range(classes)]
    cells = kept(model.binned(rows).groupBy(*places).agg(*counts))
    totals = np.array([x or 0.0 for x in cells.agg(*[F.sum(f"_n{k}") for k in range(classes)]).first()])
    if totals.sum() == 0:
        return model
    model.start = np.log((totals + 1) / (totals.sum() + classes)).tolist()
    width = max(len(e) for e in model.edges) + 2
    stated = cells.withColumns({f"_s{k}": F.lit(s) for k, s in enumerate(model.start)})
    since: list[Node] = []
    for at in range(rounds):
        scores = [F.col(f"_s{k}") + sum((_value(t, k) for t in since), F.lit(0.0)) for k in range(classes)]
        everyone = sum((F.col(f"_n{k}") for k in range(classes)), F.lit(0.0))
        p = chances(scores)
        sides = {f"_g{k}": F.col(f"_n{k}") - everyone * p[k] for k in range(classes)} | {f"_h{k}": everyone * p[k] * (1 - p[k]) for k in range(classes)}
        grads = stated.select(*places, *[c.alias(n) for n, c in sides.items()])
        long = F.explode(F.array(*[F.struct(F.lit(k).alias("f"), F.col(c).alias("b")) for k, c in enumerate(places)]))

        def sums_at(tree: Node) -> dict[int, np.ndarray]:
            found: dict[int, np.ndarray] = {}
            told = grads.select(_place(tree).alias("leaf"), *sides, long.alias("x")).groupBy("leaf", "x.f", "x.b").agg(*[F.sum(c).alias(c) for c in sides])
            for r in told.collect():
                found.setdefault(r["leaf"], np.zeros((len(features), width, 2, classes)))[r["f"], r["b"]] = [[r[f"_{s}{k}"] for k in range(classes)] for s in "gh"]
            return found

        tree = grown(sums_at, classes, depth, rate)
        model.trees.append(tree)
        since.append(tree)
        if (at + 1) % every == 0 and at + 1 < rounds:
            stated = kept(stated.select(*places, *[f"_n{k}" for k in range(classes)], *[s.alias(f"_s{k}") for k, s in enumerate([F.col(f"_s{k}") + sum((_value(t, k) for t in since), F.lit(0.0)) for k in range(classes)])]))
            since = []
    return model
