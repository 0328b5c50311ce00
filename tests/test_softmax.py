"""Boosted trees for several classes against a plain loop over rows, and against the shares of the classes."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.operators import softmax


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.uniform(0, 10, n).round(2), rng.integers(0, 5, n)
    y = np.where(x + rng.normal(0, 1.5, n) > 6, 2, np.where(z + rng.normal(0, 1, n) > 2, 1, 0))
    return [(int(i), None if i % 11 == 0 else float(a), None if i % 17 == 0 else int(b), int(c) if i % 23 else None) for i, (a, b, c) in enumerate(zip(x, z, y))]


def plain(rows, edges, rounds, depth, rate):
    """The same trees by a loop over rows: (function of features to chances)."""
    bin_of = lambda v, e: 0 if v is None else 1 + sum(v > t for t in e)
    data = [([bin_of(v, e) for v, e in zip(r[1:3], edges)], r[3]) for r in rows if r[3] is not None]
    counts = np.bincount([y for _, y in data], minlength=3)
    start = np.log((counts + 1) / (counts.sum() + 3))
    scores = np.tile(start, (len(data), 1))
    trees = []

    def grow(at, p, level):
        g = sum((np.eye(3)[data[i][1]] - p[i] for i in at), np.zeros(3))
        h = sum((p[i] * (1 - p[i]) for i in at), np.zeros(3))
        node = {"v": rate * g / (h + 1)}
        best = (1e-6, None, None)
        if level < depth:
            for f in range(2):
                for b in range(18):
                    left = [i for i in at if data[i][0][f] <= b]
                    gl, hl = sum((np.eye(3)[data[i][1]] - p[i] for i in left), np.zeros(3)), sum((p[i] * (1 - p[i]) for i in left), np.zeros(3))
                    if hl.sum() < 1e-3 or (h - hl).sum() < 1e-3:
                        continue
                    gain = round(float((gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)).sum()), 9)
                    if gain > best[0]:
                        best = (gain, f, b)
        if best[1] is not None:
            _, f, b = best
            node |= {"f": f, "b": b, "l": grow([i for i in at if data[i][0][f] <= b], p, level + 1), "r": grow([i for i in at if data[i][0][f] > b], p, level + 1)}
        return node

    def value(node, bins):
        while "f" in node:
            node = node["l"] if bins[node["f"]] <= node["b"] else node["r"]
        return node["v"]

    for _ in range(rounds):
        e = np.exp(scores - scores.max(1, keepdims=True))
        p = e / e.sum(1, keepdims=True)
        trees.append(grow(list(range(len(data))), p, 0))
        scores += np.array([value(trees[-1], b) for b, _ in data])

    def predict(row):
        s = start + sum(value(t, [bin_of(v, e) for v, e in zip(row[1:3], edges)]) for t in trees)
        e = np.exp(s - s.max())
        return e / e.sum()

    return predict


SHAPE = "i long, x double, z int, y int"


def test_trees_equal_a_plain_loop_over_rows(spark):
    rows = drawn(400, 3)
    model = softmax.fit(spark.createDataFrame(rows, SHAPE).repartition(5), ["x", "z"], "y", 3, rounds=4, depth=2, bins=6, every=3)
    predict = plain(rows, model.edges, 4, 2, 0.3)
    for r in model.predicted(spark.createDataFrame(rows, SHAPE), "p").collect():
        assert r.p == pytest.approx(predict(tuple(r)[:4]), abs=1e-9) and sum(r.p) == pytest.approx(1)


def test_learned_chances_beat_the_shares_of_the_classes(spark):
    model = softmax.fit(spark.createDataFrame(drawn(3000, 1), SHAPE), ["x", "z"], "y", 3, rounds=12, depth=3)
    held = [r for r in model.predicted(spark.createDataFrame(drawn(1500, 2), SHAPE), "p").collect() if r.y is not None]
    shares = np.bincount([r.y for r in held], minlength=3) / len(held)
    mine, theirs = (-sum(math.log(x) for x in xs) / len(held) for xs in ([r.p[r.y] for r in held], [shares[r.y] for r in held]))
    assert mine < 0.8 * theirs


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, None, None, 2), (2, 1.0, None, 9)], SHAPE)
    assert softmax.fit(df.where("false"), ["x", "z"], "y", 3).predicted(df, "p").first().p == pytest.approx([1 / 3] * 3)
    one = softmax.fit(df, ["x", "z"], "y", 3, rounds=2).predicted(df.withColumn("_b0", F.lit("mine")), "p")
    assert one.first()._b0 == "mine" and all(r.p[2] > 0.4 for r in one.collect())
