"""Fitted models as versioned Parquet: rotations, feature ranges and hidden-unit weights, kept by path and found again."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from somnia.operators.model import HiddenUnits, Pca, score_loaded

PIECE = 8 << 20  # bytes of a stored file in one row
SCHEMA = "kind string, part string, i int, j int, value double, name string"
ARRAYS = {"pca": ("mean", "components", "variance"), "units": ("vf", "fh", "bias_cov", "w_mean", "bias_mean", "bias_vis")}


def _rows(model) -> list[tuple]:
    """A model as cells; its size is that of its weights and does not grow with the data."""
    kind = "pca" if isinstance(model, Pca) else "units"
    rows = []
    for part in ARRAYS[kind]:
        values = getattr(model, part)
        if values is not None:
            rows += [(kind, part, *(int(x) for x in (*at, 0)[:2]), float(v), None) for at, v in np.ndenumerate(values)]
    if kind == "pca":
        rows += [(kind, "features", i, 0, None, f) for i, f in enumerate(model.features)]
        rows.append((kind, "whiten", 0, 0, float(model.whiten), None))
    return rows


def versions(spark: SparkSession, path: str) -> list[int]:
    """Versions kept at ``path``, oldest first; none if nothing is there."""
    try:
        found = spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r.version for r in found.select("version").distinct().collect())


def save_model(spark: SparkSession, model: Pca | HiddenUnits, path: str) -> int:
    """Write ``model`` as the next version at ``path``; earlier versions stay. One job writes a version, so none is left half written."""
    version = max(versions(spark, path), default=0) + 1
    table = spark.createDataFrame(_rows(model), SCHEMA).coalesce(1).withColumn("version", F.lit(version))
    table.write.mode("append").partitionBy("version").parquet(path)
    return version


def load_model(spark: SparkSession, path: str, version: int | None = None) -> Pca | HiddenUnits:
    """The model at ``path``, its latest version unless one is named."""
    have = versions(spark, path)
    wanted = version or max(have, default=None)
    if wanted not in have:
        raise FileNotFoundError(f"no version {version or ''} of a model at {path}")
    cells = spark.read.parquet(path).where(F.col("version") == wanted).collect()  # as many as the model has weights
    parts = {}
    for part in ARRAYS[cells[0].kind]:
        own = [c for c in cells if c.part == part]
        if own:
            shape = [max(c.i for c in own) + 1, max(c.j for c in own) + 1]
            parts[part] = np.zeros(shape)
            for c in own:
                parts[part][c.i, c.j] = c.value
    flat = {"mean", "variance", "bias_cov", "bias_mean", "bias_vis"}
    parts = {k: v[:, 0] if k in flat else v for k, v in parts.items()}
    if cells[0].kind == "units":
        return HiddenUnits(**parts)
    names = {c.i: c.name for c in cells if c.part == "features"}
    whiten = any(c.value for c in cells if c.part == "whiten")
    return Pca(tuple(names[i] for i in range(len(names))), parts["mean"], parts["components"], parts["variance"], whiten)


def load_or_fit(spark: SparkSession, path: str, fit: Callable[[], Pca | HiddenUnits]) -> Pca | HiddenUnits:
    """The model kept at ``path``, or one that ``fit`` makes and that is kept from now on."""
    if not versions(spark, path):
        save_model(spark, fit(), path)
    return load_model(spark, path)


def save_bytes(spark: SparkSession, data: bytes, path: str) -> int:
    """Write a user's model, in whatever form its runtime reads, as the next version at ``path``, in rows of at most 8 MB."""
    version = max(versions(spark, path), default=0) + 1
    rows = [(k, len(data), bytearray(data[at:at + PIECE])) for k, at in enumerate(range(0, max(len(data), 1), PIECE))]
    table = spark.createDataFrame(rows, "piece int, size long, data binary").coalesce(1).withColumn("version", F.lit(version))
    table.write.mode("append").partitionBy("version").parquet(path)
    return version


def load_bytes(spark: SparkSession, path: str, version: int | None = None, largest: int = 1 << 30) -> bytes:
    """The model that ``save_bytes`` wrote, its latest version unless one is named.

    Its size is read before its bytes: a model over ``largest`` bytes raises instead of filling the driver.
    """
    have = versions(spark, path)
    wanted = version or max(have, default=None)
    if wanted not in have:
        raise FileNotFoundError(f"no version {version or ''} of a model at {path}")
    rows = spark.read.parquet(path).where(F.col("version") == wanted)
    size = rows.agg(F.max("size")).first()[0]
    if size > largest:
        raise ValueError(f"the model at {path} has {size} bytes, over {largest}")
    data = b"".join(bytes(r.data) for r in rows.select("piece", "data").orderBy("piece").collect())  # at most largest
    if len(data) != size:
        raise ValueError(f"the model at {path} has {len(data)} of {size} bytes")
    return data


def score_stored(df: DataFrame, seq: str, path: str, load: Callable[[bytes], Callable[[np.ndarray], np.ndarray]],
                 version: int | None = None, out: str = "scores", largest: int = 1 << 30) -> DataFrame:
    """Scores of sequences by the model kept at ``path``: ``load`` makes it from its bytes, once a task."""
    return score_loaded(df, seq, load_bytes(df.sparkSession, path, version, largest), load, out)


def save_ranges(stats: DataFrame, path: str) -> None:
    """Feature statistics, as ``feature_stats`` gives them, beside a model; one row."""
    stats.coalesce(1).write.mode("overwrite").parquet(path)


def load_ranges(spark: SparkSession, path: str) -> DataFrame:
    """Saved statistics, for ``scale_features`` and ``unscale_features`` of other rows."""
    return spark.read.parquet(path)
