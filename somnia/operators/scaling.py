"""Feature and channel scalers, with saved statistics and inverses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from somnia.functions.scalar import EPS, ratio

from .ordered import CHUNK, attach, attach_by_hash, chunk_of, scan, summarise
from .quantiles import column_quantiles

# Scaler names in the order in which a setting is searched for them.
SCALERS = ["global", "single", "baseZeroG", "baseZeroS", "baseZeroCol", "stdz", "minZero", "NOscaling"]


def scaler_name(setting: str) -> str:
    return next((s for s in SCALERS if s in setting), "NOscaling")


def feature_stats(df: DataFrame, features: list[str]) -> DataFrame:
    """One row: min, max, mean and population deviation of each feature and of all."""
    aggs = []
    for f in features:
        aggs += [F.min(f).alias(f"min_{f}"), F.max(f).alias(f"max_{f}"), F.avg(f).alias(f"mean_{f}"),
                 F.stddev_pop(f).alias(f"std_{f}")]
    out = df.agg(*aggs)
    lows, highs = [F.col(f"min_{f}") for f in features], [F.col(f"max_{f}") for f in features]
    low = F.least(*lows) if len(lows) > 1 else lows[0]
    high = F.greatest(*highs) if len(highs) > 1 else highs[0]
    return out.withColumns({"min_all": low, "max_all": high})


def _with_stats(df: DataFrame, stats: DataFrame) -> DataFrame:
    """The single row of statistics beside every row, as a scalar subquery."""
    return df.withColumn("_s", stats.select(F.struct(*stats.columns)).scalar())


def _s(name):
    return F.col("_s")[name]


def _forward(f, kind):
    x, lo, hi = F.col(f), _s(f"min_{f}"), _s(f"max_{f}")
    glo, ghi = _s("min_all"), _s("max_all")
    return {
        "global": 10.0 * (ratio(x - glo, ghi - glo) - 0.5), "single": 10.0 * (ratio(x - lo, hi - lo) - 0.5),
        "baseZeroG": ratio(x - glo, ghi - glo), "baseZeroS": 10.0 * ratio(x - lo, hi - lo),
        "baseZeroCol": ratio(x - lo, hi - lo), "stdz": ratio(x - _s(f"mean_{f}"), _s(f"std_{f}")),
        "minZero": x - lo, "NOscaling": x,
    }[kind]


def _backward(f, kind):
    x, lo, hi = F.col(f), _s(f"min_{f}"), _s(f"max_{f}")
    glo, ghi = _s("min_all"), _s("max_all")
    return {
        "global": (x + 5.0) * (ghi - glo) / 10.0 + glo, "single": (x + 5.0) * (hi - lo) / 10.0 + lo,
        "baseZeroG": x * (ghi - glo) + glo, "baseZeroS": x * (hi - lo) / 10.0 + lo,
        "baseZeroCol": x * (hi - lo) + lo, "stdz": x * _s(f"std_{f}") + _s(f"mean_{f}"),
        "minZero": x + lo, "NOscaling": x,
    }[kind]


def scale_features(df: DataFrame, features: list[str], setting: str, stats: DataFrame | None = None) -> DataFrame:
    """Scale by ``stats``, or by the data's own when none are given."""
    stats = feature_stats(df, features) if stats is None else stats
    kind = scaler_name(setting)
    return _with_stats(df, stats).withColumns({f: _forward(f, kind) for f in features}).drop("_s")


def unscale_features(df: DataFrame, features: list[str], setting: str, stats: DataFrame) -> DataFrame:
    """Back to the space the saved ``stats`` were taken in."""
    kind = scaler_name(setting)
    return _with_stats(df, stats).withColumns({f: _backward(f, kind) for f in features}).drop("_s")


def subtract_mean(df: DataFrame, features: list[str]) -> DataFrame:
    """Features less their mean; statistics taken afterwards are those of the result."""
    stats = feature_stats(df, features)
    return _with_stats(df, stats).withColumns({f: F.col(f) - _s(f"mean_{f}") for f in features}).drop("_s")


def log_features(df: DataFrame, features: list[str]) -> DataFrame:
    """Log of the features that are nowhere negative; the others stay."""
    stats = feature_stats(df, features)
    return _with_stats(df, stats).withColumns({
        f: F.when(_s(f"min_{f}") >= 0, F.ln(F.greatest(F.col(f), F.lit(0.0)) + EPS)).otherwise(F.col(f)) for f in features}).drop("_s")


def sum_of_squares(df: DataFrame, features: list[str]) -> DataFrame:
    return df.agg(*[F.sum(F.col(f) * F.col(f)).alias(f) for f in features])


def scale_channels(df: DataFrame, keys: list[str], idx: str, value: str = "value", scaler: str = "RobustScaler",
                   chunk: int = CHUNK) -> DataFrame:
    """Scale each group of ``keys``, for example each channel, by its own statistics."""
    if scaler == "QuantileTransformer":
        return _to_quantiles(df, keys, idx, value)
    if scaler == "RobustScaler":
        stats = column_quantiles(df, keys, idx, [value], {"_a": 0.5, "_q1": 0.25, "_q3": 0.75}, chunk=chunk)
        spread = F.col(f"_q3_{value}") - F.col(f"_q1_{value}")
        stats = stats.select(*keys, "_first", "_last", F.col(f"_a_{value}").alias("_a"), spread.alias("_b"))
    elif scaler == "StandardScaler":
        stats = summarise(df, keys, idx, _a=F.avg(value), _b=F.stddev_pop(value))
    elif scaler == "MinMaxScaler":
        stats = summarise(df, keys, idx, _a=F.min(value), _b=F.max(value) - F.min(value))
    elif scaler == "MaxAbsScaler":
        stats = summarise(df, keys, idx, _a=F.lit(0.0), _b=F.max(F.abs(value)))
    else:
        raise ValueError(f"unknown scaler {scaler}")
    # A group without spread is shifted only.
    width = F.when(F.col("_b") == 0, F.lit(1.0)).otherwise(F.col("_b"))
    out = attach(df, stats, keys, idx, chunk)
    return out.withColumn(value, (F.col(value) - F.col("_a")) / width).drop("_a", "_b")


def _to_quantiles(df, keys, idx, value, bins: int = 1 << 16):
    """Value to its place in the group's distribution, 0 to 1, mid-place for equal values.

    Values are counted first, so equal ones are one row, and counted on in two
    levels over slices of the value range.
    """
    x = F.col(value).cast("double")
    counts = df.where(x.isNotNull()).groupBy(*keys, x.alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    span = df.agg(F.struct(F.min(x).alias("lo"), (F.max(x) - F.min(x)).alias("width")).alias("s"))
    placed = counts.withColumn("_s", span.scalar())
    slot = F.floor(ratio(F.col("_x") - F.col("_s.lo"), F.col("_s.width")) * bins)
    placed = scan(placed, keys, ["_x"], F.coalesce(slot, F.lit(0)).cast("long"), _upto=("sum", "_n")).drop("_s")
    rows = attach_by_hash(df.withColumn("_x", x), placed, [*keys, "_x"], [idx], counts.agg(F.max("_n")).scalar())
    total = summarise(df.where(x.isNotNull()), keys, idx, _total=F.count(F.lit(1)))
    rows = attach(rows, total, keys, idx)
    place = (F.col("_upto") - F.col("_n") + (F.col("_n") - 1) / 2) / F.greatest(F.col("_total") - 1, F.lit(1))
    return rows.withColumn(value, place).drop("_x", "_n", "_upto", "_total")


def _iqr(df, keys, idx, value, chunk):
    q = column_quantiles(df, keys, idx, [value], {"_q1": 0.25, "_q3": 0.75}, chunk=chunk)
    return q.select(*keys, "_first", "_last", (F.col(f"_q3_{value}") - F.col(f"_q1_{value}")).alias("_iqr"))


def clip_noisy(df: DataFrame, keys: list[str], idx: str, value: str = "value", k: float = 20.0,
               chunk: int = CHUNK) -> DataFrame:
    """Our reading: limit values to ``k`` times the channel's inter-quartile range."""
    out = attach(df, _iqr(df, keys, idx, value, chunk), keys, idx, chunk)
    lim = F.col("_iqr") * k
    return out.withColumn(value, F.greatest(F.least(F.col(value), lim), -lim)).drop("_iqr")


def zero_noisy_epochs(df: DataFrame, keys: list[str], idx: str, size: int, value: str = "value",
                      k: float = 20.0, chunk: int = CHUNK) -> DataFrame:
    """Our reading: an epoch with a value beyond ``k`` inter-quartile ranges becomes 0."""
    out = attach(df, _iqr(df, keys, idx, value, chunk), keys, idx, chunk).withColumn("epoch_idx", chunk_of(idx, size))
    peak = F.max(F.abs(value)).over(Window.partitionBy(*keys, "epoch_idx"))
    return (out.withColumn("_peak", peak)
            .withColumn(value, F.when(F.col("_peak") > F.col("_iqr") * k, F.lit(0.0)).otherwise(F.col(value)))
            .drop("_peak", "_iqr"))


def spread_check(df: DataFrame, keys: list[str], value: str, warn_mean: float = 5.0, warn_std: float = 5.0) -> DataFrame:
    """Mean and deviation per group against their limits, as a quality row."""
    out = df.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("ok", (F.abs("mean") <= warn_mean) & (F.col("std") <= warn_std))
