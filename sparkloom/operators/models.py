"""Models trained on tables with MLlib, recommenders and batch scoring."""

from __future__ import annotations

import random
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import reduce
from itertools import product

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml import Estimator, Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, NaiveBayes, OneVsRest,
                                       OneVsRestModel, RandomForestClassifier)
from pyspark.ml.evaluation import Evaluator
from pyspark.ml.feature import HashingTF, IDF, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.recommendation import ALS
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import DataType

from sparkloom.operators.features import assemble_xy, label_encode, minmax_apply, minmax_fit
from sparkloom.operators.ordered import with_ordinal
from sparkloom.operators.sampling import unit_hash
from sparkloom.operators.similarity import similar_topk
from sparkloom.operators.skew import dimension_join
from sparkloom.runtime import cut_lineage, stored


@contextmanager
def reused(df: DataFrame) -> Iterator[DataFrame]:
    """Keep a training table for the passes of an iterative fit; lost parts are recomputed.

    On disk, because MLlib's iterations hold their own form of the rows in memory.
    """
    df = df.persist(StorageLevel.DISK_ONLY)
    try:
        yield df
    finally:
        df.unpersist()


def fits_at_once(kept: DataFrame, most: int = 4, rows: int = 4_000_000) -> int:
    """How many fits may run side by side: a large table has tasks for all cores by itself, and every tree fit holds its rows in memory."""
    return max(1, min(most, rows // max(kept.count(), 1)))


def _fit(estimator: Estimator, xy: DataFrame):
    with reused(xy) as kept:
        return estimator.fit(kept)


# ---- regression -------------------------------------------------------------

def fit_elastic_net(df: DataFrame, features: list[str], target: str, alpha: float, l1_ratio: float):
    """Minimise RSS / 2n + alpha * (l1_ratio * |w| + (1 - l1_ratio) / 2 * w^2), without standardisation.

    MLlib scales the target to unit deviation first, which divides the squared
    penalty by that deviation; the parameters are set so that it cancels out.
    """
    dev = df.agg(F.stddev_pop(target)).first()[0] or 1.0
    reg = alpha * (l1_ratio + (1.0 - l1_ratio) * dev)
    estimator = LinearRegression(regParam=reg, elasticNetParam=alpha * l1_ratio / reg if reg else 0.0, standardization=False,
                                 maxIter=500, tol=1e-9)
    return _fit(estimator, assemble_xy(df, features, target))


def fit_ols(df: DataFrame, features: list[str], target: str):
    return _fit(LinearRegression(regParam=0.0, solver="normal"), assemble_xy(df, features, target))


def fit_rf_regressor(df: DataFrame, features: list[str], target: str, trees: int = 100, depth: int = 8, seed: int = 7):
    return _fit(RandomForestRegressor(numTrees=trees, maxDepth=depth, seed=seed), assemble_xy(df, features, target))


def feature_importance(df: DataFrame, features: list[str], target: str, top: int = 7, trees: int = 50, depth: int = 6) -> DataFrame:
    """Forest importances by column name, largest first."""
    model = fit_rf_regressor(df, features, target, trees, depth)
    rows = sorted(zip(features, model.featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))[:top]
    return df.sparkSession.createDataFrame(rows, "feature string, importance double")


def fit_mixed_regressor(df: DataFrame, cats: list[str], nums: list[str], target: str, rounds: int = 20, depth: int = 5, seed: int = 7):
    """Categories to ids, numbers to [0, 1], boosted trees: (model, prepared table)."""
    coded, _ = label_encode(df, cats)
    ready = minmax_apply(coded, minmax_fit(coded, nums))
    xy = assemble_xy(ready, [*cats, *nums], target)
    return _fit(GBTRegressor(maxIter=rounds, maxDepth=depth, seed=seed), xy), xy


# ---- classification ---------------------------------------------------------

def fit_rf_classifier(xy: DataFrame, trees: int = 600, depth: int = 20, seed: int = 7):
    return _fit(RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed), xy)


def fit_boosted_trees(xy: DataFrame, classes: int = 2, depth: int = 5, rounds: int = 20, seed: int = 7):
    """Boosted trees; one against the rest beyond two classes."""
    gbt = GBTClassifier(maxDepth=depth, maxIter=rounds, seed=seed)
    if classes == 2:
        return _fit(gbt, xy)
    with reused(xy) as kept:
        return OneVsRest(classifier=gbt, parallelism=fits_at_once(kept)).fit(kept)


def predict_classes(model, xy: DataFrame) -> DataFrame:
    """Rows with ``prediction``; of one model for each class the largest score wins, the first of equal ones.

    The scores are plain columns: those of ``OneVsRestModel.transform`` go through array functions that Spark does not compile.
    """
    if not isinstance(model, OneVsRestModel):
        return model.transform(xy)
    scores = [f"__score{i}" for i in range(len(model.models))]
    out = xy
    for name, one in zip(scores, model.models, strict=True):
        raw = one.getRawPredictionCol()
        out = one.transform(out).withColumn(name, vector_to_array(raw)[1]).drop(raw, one.getProbabilityCol(), one.getPredictionCol())
    every = F.array(*scores)
    return out.withColumn(model.getPredictionCol(), (F.array_position(every, F.array_max(every)) - 1).cast("double")).drop(*scores)


def fit_naive_bayes(xy: DataFrame, smoothing: float = 1.0):
    return _fit(NaiveBayes(smoothing=smoothing, modelType="multinomial"), xy)


def fit_mlp(xy: DataFrame, layers: list[int], iterations: int = 100, seed: int = 7):
    return _fit(MultilayerPerceptronClassifier(layers=layers, maxIter=iterations, seed=seed), xy)


def fit_logistic(xy: DataFrame, reg: float = 0.01):
    return _fit(LogisticRegression(regParam=reg, maxIter=100), xy)


def fit_text_classifier(df: DataFrame, tokens: str, label: str, features: int = 1 << 14, reg: float = 0.01) -> PipelineModel:
    """Hashed TF-IDF and logistic regression as one pipeline over a token array column."""
    stages = [StringIndexer(inputCol=label, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="keep"),
              HashingTF(inputCol=tokens, outputCol="tf", numFeatures=features), IDF(inputCol="tf", outputCol="features"),
              LogisticRegression(regParam=reg, maxIter=50)]
    return _fit(Pipeline(stages=stages), df.select(tokens, label))


def fit_multilabel(df: DataFrame, features: str, labels: list[str], reg: float = 0.01) -> dict:
    """One binary model per label over the same vector."""
    with reused(df.select(features, *labels)) as kept:
        return {c: LogisticRegression(featuresCol=features, labelCol=c, regParam=reg, predictionCol=f"pred_{c}",
                                      probabilityCol=f"prob_{c}", rawPredictionCol=f"raw_{c}").fit(kept) for c in labels}


def predict_multilabel(df: DataFrame, models: dict) -> DataFrame:
    out = reduce(lambda d, m: m.transform(d), models.values(), df)
    return out.drop(*[f"{p}_{c}" for c in models for p in ("prob", "raw")])


# ---- search and persistence -------------------------------------------------

def random_search(estimator: Estimator, space: dict, evaluator: Evaluator, xy: DataFrame, key: str | list[str], n_iter: int = 10,
                  folds: int = 5, seed: int = 7, parallelism: int | None = None):
    """Cross-validated random draws from ``space`` (param: list of values): (best model, one row per draw)."""
    every = [dict(zip(space, values)) for values in product(*space.values())]
    draws = random.Random(seed).sample(every, min(n_iter, len(every)))  # no setting twice
    maps = [reduce(lambda b, kv: b.addGrid(kv[0], [kv[1]]), d.items(), ParamGridBuilder()).build()[0] for d in draws]
    folded = xy.withColumn("__fold", F.least(F.floor(unit_hash(key, seed) * folds), F.lit(folds - 1)).cast("int"))
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps, evaluator=evaluator, numFolds=folds, foldCol="__fold")
    with reused(folded) as kept:
        model = cv.setParallelism(parallelism or fits_at_once(kept)).fit(kept)
    rows = [(i, str({p.name: v for p, v in d.items()}), float(m)) for i, (d, m) in enumerate(zip(draws, model.avgMetrics))]
    return model.bestModel, xy.sparkSession.createDataFrame(rows, "draw int, params string, metric double")


def best_of(results: DataFrame, metric: str, mode: str = "min", tie: str = "draw") -> DataFrame:
    """The row with the best metric."""
    order = F.col(metric).asc() if mode == "min" else F.col(metric).desc()
    return results.orderBy(order, tie).limit(1)


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_or_fit(path: str, load: Callable, fit: Callable):
    """Load a saved model, or fit and save it."""
    try:
        return load(path)
    except Exception as err:
        if "does not exist" not in str(err) and "PATH_NOT_FOUND" not in str(err):
            raise
        model = fit()
        save_model(model, path)
        return model


# ---- recommenders -----------------------------------------------------------

@dataclass
class Recommender:
    """Stored factors by the callers' own 64-bit ids, with the mean ratings that speak for whoever has none."""

    user: str
    item: str
    rating: str
    rank: int
    reg: float
    user_factors: DataFrame  # (user, features)
    item_factors: DataFrame
    user_means: DataFrame  # (user, mean)
    item_means: DataFrame
    mean: float | None


def _numbered(ratings: DataFrame, col: str) -> DataFrame:
    """(id, place): the distinct ids in order with whole numbers from 0 on, which is what the solver takes; stored."""
    ids = ratings.select(F.col(col).cast("bigint").alias("id")).filter("id is not null").distinct()
    return cut_lineage(with_ordinal(ids, ["id"], name="rn", derived=True).select("id", (F.col("rn") - 1).cast("int").alias("place")))


def fit_als(ratings: DataFrame, user: str = "user_id", item: str = "movie_id", rating: str = "rating", rank: int = 10,
            reg: float = 0.1, iterations: int = 10, seed: int = 7) -> Recommender:
    """Factors of all users and items; rows with a null are left out."""
    known = stored(ratings.select(F.col(user).cast("bigint").alias("u"), F.col(item).cast("bigint").alias("i"),
                                  F.col(rating).cast("float").alias("r")).dropna(), "ratings")  # read for ids, triples and means
    users, items = _numbered(known, "u"), _numbered(known, "i")
    triples = known.join(users.toDF("u", "pu"), "u").join(items.toDF("i", "pi"), "i").select("pu", "pi", "r")
    als = ALS(userCol="pu", itemCol="pi", ratingCol="r", rank=rank, regParam=reg, maxIter=iterations, seed=seed, checkpointInterval=5)
    model = als.fit(triples)  # which it reads once, and keeps in blocks of its own

    def named(factors: DataFrame, ids: DataFrame, name: str) -> DataFrame:
        return cut_lineage(factors.withColumnRenamed("id", "place").join(ids, "place").select(F.col("id").alias(name), "features"))

    def means(col: str, name: str) -> DataFrame:
        return cut_lineage(known.groupBy(F.col(col).alias(name)).agg(F.avg("r").alias("mean")))

    return Recommender(user, item, rating, rank, reg, named(model.userFactors, users, user), named(model.itemFactors, items, item),
                       means("u", user), means("i", item), known.agg(F.avg("r")).first()[0])


def fold_in(fitted: Recommender, ratings: DataFrame, items: bool = False) -> Recommender:
    """The recommender with factors for users (or ``items``) that were not in training, from their ratings of what was; nothing is trained anew.

    Their normal equations against the stored factors are added up in one grouped pass, every batch its own first, so that one with a third of all
    ratings is a few rows by then. Ratings with a null or of unknown items teach nothing; who has factors already keeps them.
    """
    new, other = (fitted.item, fitted.user) if items else (fitted.user, fitted.item)
    own, against = (fitted.item_factors, fitted.user_factors) if items else (fitted.user_factors, fitted.item_factors)
    rank, reg = fitted.rank, fitted.reg
    upper = np.triu_indices(rank)
    width = len(upper[0]) + rank
    rows = ratings.select(F.col(new).cast("bigint").alias(new), F.col(other).cast("bigint").alias(other), F.col(fitted.rating).cast("double").alias("r")).dropna()
    rows = rows.join(own.select(new), new, "left_anti").join(against, other).select(new, "r", "features")

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                ids, place = np.unique(pdf[new].to_numpy(), return_inverse=True)
                f = np.stack(pdf["features"].to_numpy()).astype(np.float64)
                sums = np.zeros((len(ids), width))
                np.add.at(sums, place, np.column_stack([f[:, upper[0]] * f[:, upper[1]], f * pdf["r"].to_numpy()[:, None]]))
                yield pd.DataFrame({new: ids, "sums": list(sums), "n": np.bincount(place)})

    parts = rows.mapInPandas(add_up, f"`{new}` bigint, sums array<double>, n bigint")
    whole = parts.groupBy(new).agg(F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums"), F.sum("n").alias("n"))

    @F.pandas_udf("array<float>")
    def solve(sums: pd.Series, n: pd.Series) -> pd.Series:
        s = np.stack(sums.to_numpy()) if len(sums) else np.zeros((0, width))
        a = np.zeros((len(s), rank, rank))
        a[:, upper[0], upper[1]] = a[:, upper[1], upper[0]] = s[:, :-rank]
        a += (reg * n.to_numpy())[:, None, None] * np.eye(rank)
        return pd.Series(list(np.linalg.solve(a, s[:, -rank:, None])[:, :, 0].astype(np.float32)))

    more = cut_lineage(own.unionByName(whole.select(new, solve("sums", "n").alias("features"))))
    return replace(fitted, item_factors=more) if items else replace(fitted, user_factors=more)


def predict_ratings(fitted: Recommender, pairs: DataFrame, classes: int = 5) -> DataFrame:
    """Predicted rating and its class 0..classes-1 by rounding, for every pair.

    The product of the factors where both sides have some; else the mean of the item's ratings, of the user's, or of all.
    """
    out = pairs
    for factors, means, key, end in ((fitted.user_factors, fitted.user_means, fitted.user, "u"), (fitted.item_factors, fitted.item_means, fitted.item, "i")):
        known = factors.select(key, F.col("features").alias(f"__f{end}"))
        known = known.join(means.select(key, F.col("mean").alias(f"__m{end}")), key, "full")
        out = dimension_join(out, known, key, "left")  # pairs are sent once for each side
    product_ = F.aggregate(F.zip_with("__fu", "__fi", lambda a, b: a * b), F.lit(0).cast("float"), lambda a, x: a + x)
    guess = F.coalesce(product_.cast("double"), F.col("__mi"), F.col("__mu"), F.lit(fitted.mean).cast("double")).cast("float")
    out = out.withColumn("prediction", guess).drop("__fu", "__fi", "__mi", "__mu")
    return out.withColumn("rating_class", F.greatest(F.least(F.bround("prediction") - 1, F.lit(classes - 1)), F.lit(0)).cast("int"))


def recommend(fitted: Recommender, n: int) -> DataFrame:
    """Top n items per user by the product of their factors, one row each."""
    return similar_topk(fitted.user_factors, fitted.item_factors, n, "dot", "features", fitted.user, fitted.item)


# ---- batches ----------------------------------------------------------------

def map_batches(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Apply a table function to every Arrow batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield fn(pdf)
    return df.mapInPandas(run, schema)


def score_batches(df: DataFrame, col: str, load_model: Callable[[], Callable[[np.ndarray], np.ndarray]], name: str = "score",
                  batch_size: int = 1024, width: int | None = None, return_type: str = "double") -> DataFrame:
    """Score an array column with a user's numpy model; the model is loaded once per Python worker."""
    from pyspark.ml.functions import predict_batch_udf
    shapes = [[width]] if width else None
    udf = predict_batch_udf(load_model, return_type=DataType.fromDDL(return_type), batch_size=batch_size,
                            input_tensor_shapes=shapes)
    return df.withColumn(name, udf(F.col(col)))
