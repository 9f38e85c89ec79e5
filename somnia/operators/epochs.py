"""Samples to epochs: block aggregates, artefact masks, normalising, smoothing."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from somnia.functions.scalar import clip, most_frequent, ratio, ratio_indices, safe_ln

from somnia.schemas import FEATURES
from somnia.session import materialise

from .ordered import CHUNK, attach, chunk_of, drop_halo, halo, ordinal, summarise
from .quantiles import column_quantiles


def block(idx, size: int) -> Column:
    return chunk_of(idx, size)


def epoch_mode(df: DataFrame, keys: list[str], idx: str, size: int, label: str = "stage",
               whole_only: bool = True, classes: list[int] | None = None) -> DataFrame:
    """Most frequent label of each block, the smallest on ties; faster if ``classes`` are known."""
    out = df.groupBy(*keys, block(idx, size).alias("epoch_idx")).agg(
        most_frequent(label, classes).alias(label), F.count(F.lit(1)).alias("_n"))
    return (out.where(F.col("_n") == size) if whole_only else out).drop("_n")


def epoch_sum(df: DataFrame, keys: list[str], idx: str, size: int, value: str) -> DataFrame:
    """Sum of each whole block. A series of odd length first repeats its last value.

    The repeat can only complete the last block, so it is added there: a block
    one short of full whose last row ends a series of odd length counts it twice.
    """
    out = df.groupBy(*keys, block(idx, size).alias("epoch_idx")).agg(
        F.sum(value).alias("_s"), F.count(F.lit(1)).alias("_n"), F.max(idx).alias("_i"),
        F.max_by(value, idx).alias("_last"))
    repeats = (F.col("_n") == size - 1) & (F.col("_i") % 2 == 0)
    return (out.where((F.col("_n") == size) | repeats)
            .select(*keys, "epoch_idx", F.when(repeats, F.col("_s") + F.col("_last")).otherwise(F.col("_s")).alias(value)))


def block_mean(df: DataFrame, keys: list[str], idx: str, factor: int, value: str) -> DataFrame:
    """Down-sampling by the mean of each whole block."""
    out = df.groupBy(*keys, block(idx, factor).alias(idx)).agg(
        F.avg(value).alias(value), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == factor).drop("_n")


def prefix_average(df: DataFrame, keep: list[str]) -> DataFrame:
    """Mean over channels that share their letters; channels in ``keep`` stay."""
    prefix = F.regexp_extract("channel", r"^([A-Za-z]+)(\d+)$", 1)
    name = F.when(F.col("channel").isin(keep) | (prefix == ""), F.col("channel")).otherwise(prefix)
    return df.groupBy("recording_id", name.alias("channel"), "sample_idx").agg(F.avg("value").alias("value"))


def windowed_correlation(df: DataFrame, keys: list[str], idx: str, step: int, a: str, b: str) -> DataFrame:
    """Pearson correlation over ``2 * step + 1`` samples around each multiple of ``step``.

    A sample lies in at most three windows, so rows grow by a fixed factor. A
    channel that does not move within a window gives NULL.
    """
    lo, hi = F.ceil((F.col(idx) - step) / F.lit(step)), F.floor((F.col(idx) + step) / F.lit(step))
    spread = df.withColumn("bin", F.explode(F.sequence(lo.cast("long"), hi.cast("long")))).where("bin >= 1")
    out = spread.groupBy(*keys, "bin").agg(
        ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)).alias("corr"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == 2 * step + 1).select(*keys, (F.col("bin") - 1).alias("bin"), "corr")


def zscore(df: DataFrame, keys: list[str], idx: str, value: str, name: str = "z",
           chunk: int = CHUNK) -> DataFrame:
    """Deviation from the recording's mean in population standard deviations."""
    stats = summarise(df, keys, idx, _mean=F.avg(value), _sd=F.stddev_pop(value))
    out = attach(df, stats, keys, idx, chunk)
    return out.withColumn(name, ratio(F.col(value) - F.col("_mean"), F.col("_sd"))).drop("_mean", "_sd")


def first_difference(df: DataFrame, keys: list[str], idx: str, value: str, name: str = "diff",
                     chunk: int = CHUNK) -> DataFrame:
    """Next value minus this one; 0 at the end."""
    rows, w = halo(df, keys, idx, 0, 1, chunk)
    return drop_halo(rows.withColumn(name, F.coalesce(F.lead(value).over(w) - F.col(value), F.lit(0.0))))


def artefact_mask(df: DataFrame, keys: list[str], idx: str, value: str, fs: float,
                  amplitude: tuple[float, float] = (9.0, 8.0), around: tuple[float, float] = (0.2, 0.1),
                  chunk: int = CHUNK) -> DataFrame:
    """Flag samples near a large or fast deviation and set them to 0.

    A sample is masked within ``around[0]`` seconds of ``|z| > amplitude[0]`` or
    within ``around[1]`` seconds of ``|dz| > amplitude[1]``. Padding runs,
    merging them and testing membership gives the same set as the distance to
    the nearest flagged sample, which needs one window instead of three joins.
    The time axis has step ``n / (n - 1) / fs``.
    """
    stats = summarise(df, keys, idx, _mean=F.avg(value), _sd=F.stddev_pop(value), _n=F.count(F.lit(1)))
    out = attach(df, stats, keys, idx, chunk)
    out = out.withColumn("_z", ratio(F.col(value) - F.col("_mean"), F.col("_sd")))
    reach = math.ceil(max(around) * fs) + 1
    rows, w = halo(out, keys, idx, reach, reach + 1, chunk)
    i, step = F.col(idx), F.col("_n") / F.greatest(F.col("_n") - 1, F.lit(1)) / F.lit(fs)
    rows = rows.withColumns({
        "_big": F.when(F.abs("_z") > amplitude[0], i),
        "_fast": F.when(F.abs(F.coalesce(F.lead("_z").over(w) - F.col("_z"), F.lit(0.0))) > amplitude[1], i)})
    # Looking ahead is looking back in falling order: a frame that is open ahead
    # would be added up anew for every row.
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.partitionBy(*keys, "_chunk").orderBy(F.col(idx).desc()).rowsBetween(Window.unboundedPreceding, 0)
    near = F.lit(False)
    for flag, width in (("_big", around[0]), ("_fast", around[1])):
        before = i * step - F.max(flag).over(past) * step
        after = F.min(flag).over(ahead) * step - i * step
        near = near | F.coalesce(before <= width, F.lit(False)) | F.coalesce(after <= width, F.lit(False))
    rows = drop_halo(rows.withColumn("artefact", near))
    return (rows.withColumn(value, F.when(F.col("artefact"), F.lit(0.0)).otherwise(F.col(value)))
            .drop("_mean", "_sd", "_n", "_z", "_big", "_fast"))


def artefact_epochs(df: DataFrame, keys: list[str], idx: str, size: int, flag: str = "artefact",
                    threshold: float = 0.0) -> DataFrame:
    """Share of masked samples per whole epoch, and whether it passes ``threshold``."""
    out = df.groupBy(*keys, block(idx, size).alias("epoch_idx")).agg(
        (F.sum(F.col(flag).cast("int")) * 100 / F.lit(size)).alias("pct"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == size).drop("_n").withColumn("flagged", F.col("pct") > threshold)


def override_artefacts(labels: DataFrame, flagged: DataFrame, keys: list[str]) -> DataFrame:
    """Stage 0 for epochs any channel flags."""
    bad = flagged.where("flagged").select(*keys, "epoch_idx").distinct().withColumn("_bad", F.lit(True))
    return (labels.join(bad, [*keys, "epoch_idx"], "left")
            .withColumn("stage", F.when(F.col("_bad"), F.lit(0)).otherwise(F.col("stage"))).drop("_bad"))


def label_samples(samples: DataFrame, labels: DataFrame, keys: list[str], idx: str, size: int) -> DataFrame:
    """The epoch's label on each of its samples."""
    return samples.withColumn("epoch_idx", block(idx, size)).join(labels, [*keys, "epoch_idx"])


def stage_samples(samples: DataFrame, labels: DataFrame, keys: list[str], idx: str, size: int,
                  stage: int, chunk: int = CHUNK) -> DataFrame:
    """Samples of one stage's epochs, put end to end under a new index."""
    wanted = labels.where(F.col("stage") == stage).select(*keys, "epoch_idx")
    kept = samples.withColumn("epoch_idx", block(idx, size)).join(wanted, [*keys, "epoch_idx"], "left_semi")
    return ordinal(kept, keys, idx, "new_idx", chunk)


def cross_correlation(df: DataFrame, keys: list[str], idx: str, size: int, a: str, b: str,
                      lag: int = 0) -> DataFrame:
    """Per whole epoch, the sum of ``a[n + lag] * b[n]`` over samples inside it."""
    rows = df.select(*keys, block(idx, size).alias("epoch_idx"), idx, a, b)
    whole = rows.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys, "epoch_idx")))
    w = Window.partitionBy(*keys, "epoch_idx").orderBy(idx)
    moved = F.lead(a, lag) if lag >= 0 else F.lag(a, -lag)
    return (whole.withColumn("_p", moved.over(w) * F.col(b)).where(F.col("_n") == size)
            .groupBy(*keys, "epoch_idx").agg(F.coalesce(F.sum("_p"), F.lit(0.0)).alias("xcorr")))


def epoch_energy(df: DataFrame, keys: list[str], idx: str, size: int, value: str) -> DataFrame:
    out = df.groupBy(*keys, block(idx, size).alias("epoch_idx")).agg(
        F.sum(F.col(value) * F.col(value)).alias("energy"), F.count(F.lit(1)).alias("_n"))
    return out.where(F.col("_n") == size).drop("_n")


def detrend(df: DataFrame, keys: list[str], idx: str, size: int, value: str) -> DataFrame:
    """Remove the least-squares line of each epoch."""
    rows = df.withColumns({"epoch_idx": block(idx, size), "_t": (F.col(idx) % size).cast("double")})
    w = Window.partitionBy(*keys, "epoch_idx")
    line = F.regr_intercept(value, "_t").over(w) + F.regr_slope(value, "_t").over(w) * F.col("_t")
    return rows.withColumn(value, F.col(value) - line).drop("_t")


def normalise_percentile(df: DataFrame, keys: list[str], idx: str, values: list[str],
                         guarded: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Map the mean of the lowest tenth to 0, of the highest to 1, clip to [0.05, 1].

    ``guarded`` divides by 1 where both means are equal; otherwise the result
    is NULL there. ``idx`` is unique within ``keys``.
    """
    ends = column_quantiles(df, keys, idx, values, {"p10": 0.1, "p90": 0.9}, tails=True, chunk=chunk)
    sides = [c for v in values for c in (f"low_p10_{v}", f"top_p90_{v}")]
    rows = attach(df, ends.select(*keys, "_first", "_last", *sides), keys, idx, chunk)
    scaled = {}
    for v in values:
        width = F.col(f"top_p90_{v}") - F.col(f"low_p10_{v}")
        if guarded:
            width = F.when(width == 0, F.lit(1.0)).otherwise(width)
        scaled[v] = clip(ratio(F.col(v).cast("double") - F.col(f"low_p10_{v}"), width), 0.05, 1.0)
    return rows.withColumns(scaled).drop(*sides)


def smooth(df: DataFrame, keys: list[str], idx: str, values: list[str], width: int = 5, times: int = 3,
           chunk: int = CHUNK) -> DataFrame:
    """Box smoothing, repeated; beyond the ends and in gaps the series is 0."""
    half = width // 2
    rows, w = halo(df, keys, idx, half * times, half * times, chunk)
    frame = w.rangeBetween(-half, half)
    for _ in range(times):
        rows = rows.withColumns({v: F.sum(v).over(frame) / width for v in values})
    return drop_halo(rows)


def norm_to_range(df: DataFrame, keys: list[str], idx: str, value: str, lo: float = 0.0, hi: float = 1.0,
                  chunk: int = CHUNK) -> DataFrame:
    ends = summarise(df, keys, idx, _min=F.min(value), _max=F.max(value))
    out = attach(df, ends, keys, idx, chunk)
    span = F.col("_max") - F.col("_min")
    return out.withColumn(value, lo + ratio((F.col(value) - F.col("_min")) * (hi - lo), span)).drop("_min", "_max")


def epoch_features(powers: DataFrame, keys: list[str], theta_power: str = "code",
                   chunk: int = CHUNK) -> DataFrame:
    """The ten-feature vector from band powers ``noise theta delta sigma gamma`` and ``emg``.

    Powers are normalised; the seven indices are built from them, logged and
    normalised again; then indices and three powers are smoothed.
    """
    bands = ["noise", "theta", "delta", "sigma", "gamma", "emg"]
    # Powers and indices are one row per epoch but cost a pass over all samples,
    # and the percentiles read them several times: each is written once.
    powers = materialise(powers.select(*keys, "epoch_idx", *bands))
    normed = normalise_percentile(powers, keys, "epoch_idx", bands, chunk=chunk)
    indices = {n: safe_ln(c) for n, c in ratio_indices(theta_power=theta_power).items()}
    logged = materialise(normed.withColumns(indices))
    scaled = normalise_percentile(logged, keys, "epoch_idx", list(indices), chunk=chunk)
    return smooth(scaled, keys, "epoch_idx", FEATURES, chunk=chunk).select(*keys, "epoch_idx", *FEATURES)


def epoch_time(df: DataFrame, epoch_sec: float, name: str = "start_sec") -> DataFrame:
    return df.withColumn(name, F.col("epoch_idx") * F.lit(float(epoch_sec)))
