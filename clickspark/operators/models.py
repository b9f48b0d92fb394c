"""Click models fitted by Spark, scored and compared.

`fit_lr` and `fit_wide` reach the optimum of an L2 logistic regression. `fit_gbt` grows trees level by level, `fit_cross` is a
factorisation machine and `fit_deep` a multilayer perceptron: models of the same purpose, not the same models, as networks
with joint back-propagation."""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier
from pyspark.ml.feature import FeatureHasher, Imputer, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from . import descent
from .encode import OneHot, one_hot
from .metrics import auc, logloss


@dataclass
class Fitted:
    """A fitted pipeline with the preparation that its input needs."""

    model: PipelineModel
    texts: Sequence[str]
    dense: Sequence[str]
    encoder: OneHot | None = None

    def transform(self, df: DataFrame) -> DataFrame:
        prepared = _prepared(df, self.texts, self.dense)
        return self.model.transform(prepared if self.encoder is None else self.encoder.transform(prepared))

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        return score(self, df, out)


@dataclass
class Ready:
    """Input stages fitted on training rows, and these rows with `features`, written once for as many fits as are wanted."""

    inputs: PipelineModel
    texts: Sequence[str]
    dense: Sequence[str]
    rows: DataFrame
    label: str
    encoder: OneHot | None = None

    def fit(self, estimator) -> Fitted:
        return Fitted(PipelineModel(stages=[*self.inputs.stages, estimator.fit(self.rows)]), self.texts, self.dense, self.encoder)


def _prepared(df: DataFrame, texts: Sequence[str], dense: Sequence[str]) -> DataFrame:
    """Categories as texts, so that missing is an invalid value, and dense columns as doubles."""
    return df.withColumns({f"_{c}": F.col(c).cast("string") for c in texts} | {f"_{c}": F.col(c).cast("double") for c in dense})


def _inputs(texts: Sequence[str], dense: Sequence[str], scale: bool = True, hash_size: int | None = None) -> list:
    """Stages up to `features`: one-hot categories, which `one_hot` has added, or categories hashed into `hash_size` places, which bounds the width whatever
    their number; and dense columns imputed by the training mean and scaled."""
    stages, parts = [], []
    if texts and hash_size is not None:
        names = [f"_{c}" for c in texts]
        stages.append(FeatureHasher(inputCols=names, outputCol="_hashed", numFeatures=hash_size, categoricalCols=names))
        parts.append("_hashed")
    elif texts:
        parts += [f"_{c}_hot" for c in texts]
    if dense:
        stages += [Imputer(inputCols=[f"_{c}" for c in dense], outputCols=[f"_{c}_f" for c in dense]), VectorAssembler(inputCols=[f"_{c}_f" for c in dense], outputCol="_dense")]
        if scale:
            stages.append(StandardScaler(inputCol="_dense", outputCol="_scaled", withMean=True, withStd=True))
        parts.append("_scaled" if scale else "_dense")
    return [*stages, VectorAssembler(inputCols=parts, outputCol="features")]


def _tree_inputs(texts: Sequence[str], dense: Sequence[str]) -> list:
    """Stages up to `features` for trees: category codes and imputed numbers."""
    indexer = [StringIndexer(inputCols=[f"_{c}" for c in texts], outputCols=[f"_{c}_i" for c in texts], handleInvalid="keep")] if texts else []
    imputer = [Imputer(inputCols=[f"_{c}" for c in dense], outputCols=[f"_{c}_f" for c in dense])] if dense else []
    return [*indexer, *imputer, VectorAssembler(inputCols=[f"_{c}_i" for c in texts] + [f"_{c}_f" for c in dense], outputCol="features")]


def ready(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", hash_size: int | None = None, trees: bool = False, keep: Sequence[str] = ()) -> Ready:
    """Fits the input stages and writes the training features, with the label and the columns of `keep`."""
    prepared = _prepared(train, categories, dense)
    encoder = one_hot(prepared, [f"_{c}" for c in categories]) if categories and hash_size is None and not trees else None
    prepared = prepared if encoder is None else encoder.transform(prepared)
    inputs = Pipeline(stages=_tree_inputs(categories, dense) if trees else _inputs(categories, dense, hash_size=hash_size)).fit(prepared)
    return Ready(inputs, categories, dense, written(inputs.transform(prepared).select("features", label, *keep)), label, encoder)


def lr(given: Ready, c: float = 1.0, max_iter: int = 100) -> Fitted:
    """L2 logistic regression; Spark averages the loss, so the penalty is 1 / (c n)."""
    return given.fit(LogisticRegression(labelCol=given.label, maxIter=max_iter, regParam=1.0 / (c * max(given.rows.count(), 1)), elasticNetParam=0.0, standardization=False, tol=1e-9))


def gbt(given: Ready, rounds: int = 45, leaves: int = 3, rate: float = 0.1, subsample: float = 1.0, bins: int = 256, validation: str | None = None, seed: int = 0) -> Fitted:
    """Boosted trees as deep as the leaves need. `validation` names a boolean column, kept by `ready`, whose true rows stop the
    boosting early."""
    trees = GBTClassifier(labelCol=given.label, maxIter=rounds, stepSize=rate, maxDepth=max(1, math.ceil(math.log2(leaves))), subsamplingRate=subsample, maxBins=bins, seed=seed)
    return given.fit(trees.setValidationIndicatorCol(validation) if validation else trees)


def cross(given: Ready, rank: int = 8, max_iter: int = 50, rate: float = 0.05, seed: int = 0) -> Fitted:
    """A factorisation machine: low-rank crosses of all pairs of inputs."""
    return given.fit(FMClassifier(labelCol=given.label, factorSize=rank, maxIter=max_iter, stepSize=rate, seed=seed))


def deep(given: Ready, hidden: Sequence[int] = (64, 32), max_iter: int = 100, seed: int = 0) -> Fitted:
    """A multilayer perceptron over the features. Spark's perceptron gives the first weights and scores rows; the passes between are
    those of `descent`, which keep vectors as short as they are stored."""
    one = given.rows.limit(1).persist()
    layers = [len(one.first()["features"]), *hidden, 2]
    with_weights = lambda w: MultilayerPerceptronClassifier(labelCol=given.label, layers=layers, maxIter=0, seed=seed, initialWeights=w)
    start = with_weights(None).fit(one).weights.toArray()
    found = descent.fit_perceptron(descent.packed(given.rows, given.label), layers, start, max_iter)
    out = PipelineModel(stages=[*given.inputs.stages, with_weights(Vectors.dense(found)).fit(one)])
    one.unpersist()
    return Fitted(out, given.texts, given.dense, given.encoder)


def fit_lr(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", c: float = 1.0, max_iter: int = 100, hash_size: int | None = None) -> Fitted:
    """`lr` on its own inputs. Categories are hashed if hash_size is given."""
    return lr(ready(train, categories, dense, label, hash_size), c, max_iter)


def fit_wide(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", hash_size: int | None = None) -> Fitted:
    """The linear part over categories, crosses among them, and dense columns; hashed if hash_size is given."""
    return fit_lr(train, categories, dense, label, hash_size=hash_size)


def fit_gbt(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", rounds: int = 45, leaves: int = 3, rate: float = 0.1, subsample: float = 1.0, bins: int = 256, validation: str | None = None, seed: int = 0) -> Fitted:
    """`gbt` on its own inputs. Categories beyond `bins` need top_k_or_other first."""
    return gbt(ready(train, categories, dense, label, trees=True, keep=[validation] if validation else []), rounds, leaves, rate, subsample, bins, validation, seed)


def fit_cross(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", rank: int = 8, max_iter: int = 50, rate: float = 0.05, seed: int = 0, hash_size: int | None = None) -> Fitted:
    return cross(ready(train, categories, dense, label, hash_size), rank, max_iter, rate, seed)


def fit_deep(train: DataFrame, categories: Sequence[str], dense: Sequence[str], label: str = "clk", hidden: Sequence[int] = (64, 32), max_iter: int = 100, seed: int = 0, hash_size: int | None = 256) -> Fitted:
    """`deep` over hashed categories and scaled dense columns. Its first layer is dense, so its width is bounded by hash_size;
    one-hot categories (hash_size None) are for columns with few values."""
    return deep(ready(train, categories, dense, label, hash_size), hidden, max_iter, seed)


def score(model: Fitted, df: DataFrame, out: str = "score") -> DataFrame:
    """The rows with the probability of a click."""
    kept = df.columns
    return model.transform(df).withColumn(out, F.get(vector_to_array("probability"), F.lit(1))).select(*kept, out)


@dataclass
class Chosen:
    """The model of the best validation score, all models with their validation scores, and the chosen one's test scores."""

    name: str
    model: Fitted
    board: DataFrame
    test: DataFrame | None


_BOARD = "model string, auc double, logloss double, seconds double"


def _measured(model, rows: DataFrame, label: str) -> tuple[float | None, float | None]:
    scored = written(model.score(rows.where(F.col(label).isNotNull())).select("score", label))
    return auc(scored, label=label).first()[0], logloss(scored, label=label).first()[0]


def choose(fits: Mapping[str, Callable[[], Fitted]], valid: DataFrame, test: DataFrame | None = None, label: str = "clk", at_once: int = 4) -> Chosen:
    """Fits all configurations, `at_once` side by side, and chooses by AUC on the validation rows (ties by name; no AUC comes
    last). The test rows are scored once, by the chosen model alone, and never take part in the choice. A fit is anything that
    returns a model with `score`."""

    def one(item: tuple[str, Callable[[], Fitted]]) -> tuple:
        began = time.time()
        model = item[1]()
        return item[0], model, *_measured(model, valid, label), time.time() - began

    with ThreadPool(max(1, min(at_once, len(fits)))) as pool:
        found = pool.map(inheritable_thread_target(valid.sparkSession)(one), list(fits.items()))
    name, model, *_ = min(found, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
    spark = valid.sparkSession
    board = spark.createDataFrame([(n, a, x, s) for n, _, a, x, s in found], _BOARD).orderBy(F.desc("auc"), "model")
    told = None if test is None else spark.createDataFrame([(name, *_measured(model, test, label))], "model string, auc double, logloss double")
    return Chosen(name, model, board, told)


def leaderboard(fits: Mapping[str, Callable[[], Fitted]], valid: DataFrame, label: str = "clk") -> DataFrame:
    """model, auc, logloss, seconds of each configuration on the same validation rows, best first."""
    return choose(fits, valid, label=label).board
