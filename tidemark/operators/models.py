"""Forecast heads and calibration on pyspark.ml, sequential ratings, and score grids of two Poisson counts."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressor, IsotonicRegression
from pyspark.ml.classification import GBTClassifier
from pyspark.ml import Pipeline
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gbt_head(train: DataFrame, features: Sequence[str], label: str, binary: bool = False, trees: int = 20, depth: int = 4, seed: int = 7) -> PipelineModel:
    """Boosted trees over numeric features. Nulls become the median, and a column of its own says that they were null.

    A feature without any value in `train` can't be imputed; leave it out. Rows without a label are not learned from.
    """
    filled, known = [f"_{f}_filled" for f in features], [f"_{f}_null" for f in features]
    rows = with_null_flags(train.where(F.col(label).isNotNull()), features)
    kind = GBTClassifier if binary else GBTRegressor
    head = kind(featuresCol="_x", labelCol=label, maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[Imputer(inputCols=list(features), outputCols=filled, strategy="median"), VectorAssembler(inputCols=filled + known, outputCol="_x"), head]).fit(rows)


def with_null_flags(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Features as doubles, and for each 1.0 where it is null."""
    return df.withColumns({f: F.col(f).cast("double") for f in features} | {f"_{f}_null": F.col(f).isNull().cast("double") for f in features})


def gbt_scored(model: PipelineModel, df: DataFrame, features: Sequence[str], name: str) -> DataFrame:
    """df with the head's prediction, of a binary head the probability of 1."""
    found = model.transform(with_null_flags(df, features))
    value = vector_to_array("probability")[1] if "probability" in found.columns else F.col("prediction")
    return found.withColumn(name, value).select(*df.columns, name)


def isotonic_steps(df: DataFrame, p: str, y: str) -> DataFrame:
    """(at, value): the non-decreasing fit of y on p, as a piecewise linear function's corners; flat beyond the ends."""
    model = IsotonicRegression(featuresCol=p, labelCol=y).fit(df.select(F.col(p).cast("double"), F.col(y).cast("double"), F.lit(1.0).alias("weight")))
    pairs = list(zip(model.boundaries.toArray().tolist(), model.predictions.toArray().tolist(), strict=True))
    return df.sparkSession.createDataFrame(pairs, "at double, value double")


def out_of_fold(df: DataFrame, fold: str, features: Sequence[str], label: str, name: str, **how) -> DataFrame:
    """df with each row's prediction by a head that hasn't seen the row's fold. One fit a fold: folds are few (seasons)."""
    folds = [r[0] for r in df.select(fold).distinct().orderBy(fold).collect()]
    parts = [gbt_scored(gbt_head(df.where(~F.col(fold).eqNullSafe(F.lit(k))), features, label, **how), df.where(F.col(fold).eqNullSafe(F.lit(k))), features, name) for k in folds]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def elo(matches: DataFrame, pool: str, order: Sequence[str], home: str, away: str, score: str, k: float = 20.0, start: float = 1500.0, edge: float = 0.0) -> DataFrame:
    """matches with home_elo and away_elo, the ratings before each match.

    score is 1, 0.5 or 0 for the home side. Ratings of one pool (a league) depend on all its earlier matches, so a pool
    is one ordered group, read batch by batch: memory holds the pool's ratings and no more. Pools run side by side.
    """
    names = list(matches.columns)
    at = {c: names.index(c) for c in (pool, home, away, score)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, ratings = None, {}
        for batch in batches:
            h, a = [], []
            columns = [batch.iloc[:, at[c]].tolist() for c in (pool, home, away, score)]
            for which, one, two, won in zip(*columns, strict=True):
                if which != now:
                    now, ratings = which, {}
                x, y = ratings.get(one, start), ratings.get(two, start)
                h.append(x)
                a.append(y)
                move = k * (won - 1 / (1 + 10 ** ((y - x - edge) / 400)))
                ratings[one], ratings[two] = x + move, y - move
            yield batch.assign(home_elo=h, away_elo=a)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in matches.schema) + ", home_elo double, away_elo double"
    return matches.repartition(pool).sortWithinPartitions(pool, *order).mapInPandas(run, schema)


def poisson_pmf(k: Column, mean: Column) -> Column:
    """P(N = k), null for a null mean."""
    return F.exp(k * F.ln(mean) - mean) / F.factorial(k.cast("int"))


def score_grid(df: DataFrame, home: str, away: str, rho: float, cap: int = 10) -> DataFrame:
    """Each row of df times the (cap + 1)^2 scores (h, a) with their probability p.

    Two Poisson counts with the low-score correction of Dixon and Coles, negative values cut to 0, brought back to sum 1.
    """
    counts = lambda name: F.explode(F.sequence(F.lit(0), F.lit(cap))).alias(name)
    grid = df.select("*", counts("h")).select("*", counts("a"))
    lam, mu, h, a = F.col(home), F.col(away), F.col("h"), F.col("a")
    tau = (
        F.when((h == 0) & (a == 0), 1 - lam * mu * rho)
        .when((h == 0) & (a == 1), 1 + lam * rho)
        .when((h == 1) & (a == 0), 1 + mu * rho)
        .when((h == 1) & (a == 1), F.lit(1.0 - rho))
        .otherwise(F.lit(1.0))
    )
    return grid.withColumn("p", F.greatest(poisson_pmf(h, lam) * poisson_pmf(a, mu) * tau, F.lit(0.0)))


def fixture_outcomes(df: DataFrame, key: str, home: str, away: str, rho: float, cap: int = 10) -> DataFrame:
    """One row per key: probabilities of home win, draw, away win, and of either side keeping the other at 0."""
    total = F.sum("p")
    share = lambda cond, name: (F.sum(F.when(cond, F.col("p")).otherwise(0.0)) / total).alias(name)
    h, a = F.col("h"), F.col("a")
    return score_grid(df.select(key, home, away), home, away, rho, cap).groupBy(key).agg(share(h > a, "p_home"), share(h == a, "p_draw"), share(h < a, "p_away"), share(a == 0, "home_clean"), share(h == 0, "away_clean"))
