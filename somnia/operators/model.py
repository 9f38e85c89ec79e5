"""Models as batch jobs: principal components, hidden units, scoring."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce
from operator import and_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from somnia.functions.scalar import EPS, code_string
from somnia.session import materialise

ARRAY = T.ArrayType(T.DoubleType())


@dataclass(frozen=True)
class Pca:
    """A fitted rotation; small, fixed size, safe to send to every task."""
    features: tuple[str, ...]
    mean: np.ndarray
    components: np.ndarray
    variance: np.ndarray
    whiten: bool = False

    @property
    def explained(self) -> np.ndarray:
        return self.variance / self.variance.sum()


def fit_pca(df: DataFrame, features: list[str], whiten: bool = False) -> Pca:
    """Means and covariances in one distributed aggregate, eigenvectors on the driver.

    The driver gets one row of ``features ** 2 / 2`` numbers. Each component's
    sign makes its largest loading positive.
    """
    d = len(features)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                 *[F.covar_samp(features[i], features[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    cov = np.zeros((d, d))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"c{i}_{j}"]
    val, vec = np.linalg.eigh(cov)
    order = np.argsort(val)[::-1]
    val, vec = np.maximum(val[order], 0.0), vec[:, order].T
    vec *= np.sign(vec[np.arange(d), np.abs(vec).argmax(axis=1)])[:, None]
    return Pca(tuple(features), np.array([row[f"m{i}"] for i in range(d)]), vec, val, whiten)


def _combine(terms: list[tuple[float, Column]], start: float = 0.0) -> Column:
    out = F.lit(float(start))
    for k, c in terms:
        out = out + F.lit(float(k)) * c
    return out


def pca_transform(df: DataFrame, pca: Pca, prefix: str = "pc") -> DataFrame:
    """Scores as plain arithmetic on columns, inside generated code."""
    outs = {}
    for k, load in enumerate(pca.components):
        scale = math.sqrt(pca.variance[k]) if pca.whiten and pca.variance[k] > 0 else 1.0
        outs[f"{prefix}{k}"] = _combine([(w / scale, F.col(f)) for w, f in zip(load, pca.features)],
                                        -float(load @ pca.mean) / scale)
    return df.withColumns(outs)


def pca_inverse(df: DataFrame, pca: Pca, prefix: str = "pc") -> DataFrame:
    scale = np.sqrt(pca.variance) if pca.whiten else np.ones(len(pca.variance))
    return df.withColumns({f: _combine([(pca.components[k, j] * scale[k], F.col(f"{prefix}{k}"))
                                        for k in range(len(pca.components))], pca.mean[j])
                           for j, f in enumerate(pca.features)})


def channel_pca(df: DataFrame, channels: list[str], n_components: int = 2,
                standardise: str = "time") -> DataFrame:
    """Loadings of channels and the top channel of each component.

    ``df`` has one column per channel and one row per instant. ``'time'``
    standardises each instant over its channels, as the studied program does;
    ``'channel'`` leaves that to the caller, ``'none'`` uses values as they are.
    """
    rows = df
    if standardise == "time":
        n = len(channels)
        mean = sum((F.col(c) for c in channels[1:]), F.col(channels[0])) / n
        var = sum(((F.col(c) - F.col("_m")) * (F.col(c) - F.col("_m")) for c in channels[1:]),
                  (F.col(channels[0]) - F.col("_m")) * (F.col(channels[0]) - F.col("_m"))) / n
        rows = rows.withColumn("_m", mean).withColumn("_s", F.sqrt(var))
        sd = F.when(F.col("_s") == 0, F.lit(1.0)).otherwise(F.col("_s"))
        rows = rows.withColumns({c: (F.col(c) - F.col("_m")) / sd for c in channels})
    fit = fit_pca(rows, channels)
    table = [(k + 1, c, float(fit.components[k, j]), bool(np.abs(fit.components[k]).argmax() == j))
             for k in range(n_components) for j, c in enumerate(channels)]
    return df.sparkSession.createDataFrame(table, "component int, channel string, loading double, top boolean")


@dataclass(frozen=True)
class HiddenUnits:
    """Trained weights of a mean-covariance model with D inputs, F factors."""
    vf: np.ndarray         # D x F
    fh: np.ndarray         # F x N covariance units
    bias_cov: np.ndarray   # N
    w_mean: np.ndarray     # D x M mean units
    bias_mean: np.ndarray  # M
    bias_vis: np.ndarray | None = None

    @property
    def n_units(self) -> int:
        return self.fh.shape[1] + self.w_mean.shape[1]


def hidden_probabilities(df: DataFrame, features: list[str], model: HiddenUnits, norm: str = "dataset") -> DataFrame:
    """Probability of each covariance and mean unit, as one array.

    ``norm='dataset'`` divides inputs to the covariance units by one length per
    feature over all rows, which is what inference in the studied program does;
    ``'row'`` uses each row's own length, which is what its training does.
    """
    d = len(features)
    rows = df
    if norm == "dataset":
        length = df.agg(F.array(*[F.sqrt(F.sum(F.col(f) * F.col(f)) / d + EPS) for f in features]).alias("l"))
        rows = df.withColumn("_l", length.scalar())
    else:
        own = sum((F.col(f) * F.col(f) for f in features[1:]), F.col(features[0]) * F.col(features[0]))
        rows = df.withColumn("_l", F.array_repeat(F.sqrt(own / d + 0.5), d))

    @F.pandas_udf(ARRAY)
    def units(x: pd.Series, length: pd.Series) -> pd.Series:
        v, l = np.stack(x.to_numpy()), np.stack(length.to_numpy())
        cov = -0.5 * ((v / l) @ model.vf) ** 2 @ model.fh + model.bias_cov
        mean = v @ model.w_mean + model.bias_mean
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-np.concatenate([cov, mean], axis=1)))
        return pd.Series(list(p))

    return rows.withColumn("probs", units(F.array(*[F.col(f).cast("double") for f in features]), "_l")).drop("_l")


def with_code(df: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Bits of the units that are on, written as a string."""
    return df.withColumn("code", code_string(F.transform("probs", lambda p: p >= threshold)))


def free_energy(df: DataFrame, features: list[str], model: HiddenUnits, small: float = 0.5) -> DataFrame:
    """Energy of each row under the model; high for rows unlike the training data."""
    bias_vis = np.zeros(len(features)) if model.bias_vis is None else model.bias_vis

    @F.pandas_udf("double")
    def energy(x: pd.Series) -> pd.Series:
        v = np.stack(x.to_numpy())
        sq = (v ** 2).sum(axis=1)
        unit = v / np.sqrt(sq / v.shape[1] + small)[:, None]
        cov = np.logaddexp(0, -0.5 * (unit @ model.vf) ** 2 @ model.fh + model.bias_cov).sum(axis=1)
        mean = np.logaddexp(0, v @ model.w_mean + model.bias_mean).sum(axis=1)
        return pd.Series(0.5 * sq - cov - mean - v @ bias_vis)

    return df.withColumn("energy", energy(F.array(*[F.col(f).cast("double") for f in features])))


def score_sequences(df: DataFrame, seq: str, model: Callable[[np.ndarray], np.ndarray], out: str = "scores") -> DataFrame:
    """Apply a user's model to sequences, a batch at a time.

    ``seq`` holds arrays of equal length ``L x K`` (epochs by inputs); ``model``
    maps ``[batch, L, K]`` to ``[batch, L, classes]``.
    """

    @F.pandas_udf(ARRAY)
    def run(x: pd.Series, length: pd.Series) -> pd.Series:
        return _batch(model, x, length)

    return _scored(df, seq, run, out)


def score_loaded(df: DataFrame, seq: str, data: bytes, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]], out: str = "scores") -> DataFrame:
    """``score_sequences`` with a model that every task makes once from ``data`` by ``load``.

    The bytes go to each executor once as a broadcast and not with every task, and ``load`` (unpickling, a runtime's
    session) runs once a task for all of its batches. A lost executor's successor fetches the bytes anew.
    """
    sent = df.sparkSession.sparkContext.broadcast(data)

    @F.pandas_udf(ARRAY)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = load(sent.value)
        for x, length in batches:
            yield _batch(model, x, length)

    return _scored(df, seq, run, out)


def _batch(model: Callable[[np.ndarray], np.ndarray], x: pd.Series, length: pd.Series) -> pd.Series:
    if not len(x):
        return pd.Series([], dtype=object)
    flat = np.stack(x.to_numpy())
    return pd.Series(list(np.asarray(model(flat.reshape(len(flat), length.iloc[0], -1)), dtype=np.float64).reshape(len(flat), -1)))


def _scored(df: DataFrame, seq: str, run: Callable, out: str) -> DataFrame:
    # Arrow carries one flat array per sequence each way; Spark cuts it up again.
    flat = df.withColumn("_y", run(F.flatten(seq), F.size(seq)))
    n = F.size("_y") / F.size(seq)
    cut = F.transform(F.sequence(F.lit(0), F.size(seq) - 1),
                      lambda i: F.slice("_y", (i * n + 1).cast("int"), n.cast("int")))
    return flat.withColumn(out, cut).drop("_y")


def average_augmented(df: DataFrame, keys: list[str], n_classes: int, n_aug: int) -> DataFrame:
    """Scores of the plain pass plus the mean of the augmented ones.

    ``copy`` is 0 for the plain pass and 1 to ``n_aug`` for the others.
    """
    weight = F.when(F.col("copy") == 0, 1.0).otherwise(1.0 / n_aug)
    return df.groupBy(*keys).agg(F.array(*[F.sum(F.col("scores")[c] * weight) for c in range(n_classes)]).alias("scores"))


def train_forest(df: DataFrame, features: list[str], label: str, trees: int = 100, seed: int = 42):
    """Random forest on feature columns, by Spark ML; rows with a NULL among features or label are not learned from."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    return Pipeline(stages=[
        VectorAssembler(inputCols=features, outputCol="_x", handleInvalid="keep"),
        RandomForestClassifier(featuresCol="_x", labelCol=label, numTrees=trees, seed=seed, predictionCol="pred"),
    ]).fit(df.dropna(subset=[*features, label]))


def forest_predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    """All rows with ``pred``, NULL where a feature is."""
    whole = reduce(and_, [F.col(c).isNotNull() & ~F.isnan(c) for c in features])
    return model.transform(df).select(*df.columns, F.when(whole, F.col("pred").cast("int")).alias("pred"))


def out_of_fold(df: DataFrame, features: list[str], label: str, subject: str, folds: int = 5, trees: int = 100, seed: int = 42) -> DataFrame:
    """Rows with ``fold`` and ``pred`` from the forest that learned from the other folds.

    A subject is in one fold, by a hash, so no subject is in both learning and testing. A fold whose other folds hold no
    whole row is not predicted: ``pred`` is NULL there. Rows with a NULL feature stay, without a prediction.
    """
    rows = materialise(df.withColumn("fold", F.pmod(F.xxhash64(F.lit(seed), subject), F.lit(folds)).cast("int")))
    parts = []
    for fold in range(folds):
        own, others = rows.where(F.col("fold") == fold), rows.where(F.col("fold") != fold)
        if others.dropna(subset=[*features, label]).isEmpty():
            parts.append(own.withColumn("pred", F.lit(None).cast("int")))
        else:
            parts.append(forest_predict(train_forest(others, features, label, trees, seed), own, features))
    return reduce(DataFrame.unionByName, parts)


def staging_report(df: DataFrame, classes: list[int], label: str, pred: str = "pred") -> DataFrame:
    """One row per class: support, confusion row ``pred_<class>``, precision, recall, F1, and the accuracy over all rows.

    Rows without label or prediction are not counted; where no row counts the report is empty. Predictions are counted once; the report reads at most
    ``classes`` squared counts.
    """
    from .evaluate import class_counts, class_scores
    counts = df.where(F.col(label).isin(classes) & F.col(pred).isin(classes)).groupBy(
        F.col(label).alias("true"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))
    counts = materialise(counts)
    scores = class_scores(class_counts(counts, classes))
    hit = F.sum(F.when(F.col("true") == F.col("pred"), F.col("n")).otherwise(0))
    accuracy = counts.agg(hit / F.nullif(F.sum("n"), F.lit(0))).scalar()
    row = counts.groupBy(F.col("true").alias("class")).agg(*[
        F.sum(F.when(F.col("pred") == c, F.col("n")).otherwise(0)).alias(f"pred_{c}") for c in classes])
    return scores.join(row, "class", "left").select(
        "class", (F.col("tp") + F.col("fn")).alias("support"), *[F.coalesce(f"pred_{c}", F.lit(0)).alias(f"pred_{c}") for c in classes],
        "precision", "recall", "f1", accuracy.alias("accuracy"))


def t_test_p(df: DataFrame) -> DataFrame:
    """Two-sided p of ``t`` with ``dof`` degrees of freedom."""

    @F.pandas_udf("double")
    def p(t: pd.Series, dof: pd.Series) -> pd.Series:
        return pd.Series([incomplete_beta(n / (n + x * x), n / 2, 0.5) if n > 0 and x == x else None
                          for x, n in zip(t, dof)], dtype="float64")

    return df.withColumn("p", p("t", "dof")).withColumn("p", F.nanvl("p", F.lit(None).cast("double")))


def incomplete_beta(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    tiny, c, d = 1e-300, 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
                    -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / ((1 + num * d) or tiny)
            c = (1 + num / c) or tiny
            step = c * d
            h *= step
        if abs(step - 1) < 1e-14:
            return front * h
    return math.nan  # not converged
