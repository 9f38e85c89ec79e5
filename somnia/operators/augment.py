"""Augmentations of sequences, chosen by name.

A sequence is a row: ``keys`` name it, each channel is an array column of the
same ``length``. Every augmentation applies to a row with probability
``apply_prob``; where it does and a ``weight`` column is there, the weight is
multiplied by ``aug_weight``. Draws are hashes of the keys and ``seed``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from . import sampling as S
from .signal import elastic


def _apply(df: DataFrame, keys, apply_prob, aug_weight, seed, made) -> DataFrame:
    out = df.withColumn("_on", S.augment_flag(apply_prob, f"{seed}on", *keys))
    out = out.withColumns({c: F.when(F.col("_on"), x).otherwise(F.col(c)) for c, x in made.items()})
    if "weight" in df.columns:
        out = out.withColumn("weight", S.weigh(F.col("_on"), "weight", aug_weight))
    return out.drop("_on")


def _between(lo, hi, seed, keys):
    """One draw per row from a range, or the number itself."""
    return F.lit(float(lo)) if hi is None else lo + (hi - lo) * S.uniform(seed, *keys)


def global_amplitude(df, keys, channels, min_scaling, max_scaling, apply_prob=1.0, aug_weight=0.5, seed=0):
    """All channels of a row times one factor."""
    if max_scaling <= min_scaling:
        raise ValueError("the largest scaling must exceed the smallest")
    u = _between(min_scaling, max_scaling, f"{seed}u", keys)
    return _apply(df, keys, apply_prob, aug_weight, seed, {c: S.amplitude(c, u) for c in channels})


def global_shift(df, keys, channels, min_shift, max_shift, apply_prob=1.0, aug_weight=0.5, seed=0):
    """One constant added to all channels of a row."""
    if max_shift <= min_shift:
        raise ValueError("the largest shift must exceed the smallest")
    u = _between(min_shift, max_shift, f"{seed}u", keys)
    return _apply(df, keys, apply_prob, aug_weight, seed, {c: S.shift(c, u) for c in channels})


def global_noise(df, keys, channels, sigma, mean=0.0, apply_prob=1.0, aug_weight=0.5, seed=0):
    """A normal draw added to each element of each channel."""
    return _apply(df, keys, apply_prob, aug_weight, seed,
                  {c: S.gaussian_noise(c, sigma, mean, f"{seed}{c}", *keys) for c in channels})


def channel_dropout(df, keys, channels, drop_fraction, apply_prob=1.0, aug_weight=0.5, seed=0):
    """Random channels become faint noise around their mean."""
    return _apply(df, keys, apply_prob, aug_weight, seed, S.drop_channels({c: c for c in channels}, drop_fraction, seed, *keys))


def _region(length, lo, hi, seed, keys, log_sample):
    if lo <= 0 or hi > 1:
        raise ValueError("region fractions lie above 0 and up to 1")
    return S.region(length, lo, hi, seed, *keys, log=log_sample)


def regional_noise(df, keys, channels, length, min_region_fraction, max_region_fraction, sigma=0.1, mean=0.0,
                   log_sample=True, apply_prob=1.0, aug_weight=0.5, seed=0):
    """Normal draws added within one region, the same for all channels."""
    start, n = _region(length, min_region_fraction, max_region_fraction, seed, keys, log_sample)
    return _apply(df, keys, apply_prob, aug_weight, seed, {
        c: S.regional_noise(c, start, n, length, sigma, f"{seed}{c}", *keys, mean=mean) for c in channels})


def regional_erase(df, keys, channels, length, min_region_fraction, max_region_fraction, log_sample=True,
                   apply_prob=1.0, aug_weight=0.5, seed=0):
    """A region becomes faint noise around the mean of all channels."""
    start, n = _region(length, min_region_fraction, max_region_fraction, seed, keys, log_sample)
    mean = sum((S._mean(F.col(c)) for c in channels[1:]), S._mean(F.col(channels[0]))) / len(channels)
    return _apply(df.withColumn("_mu", mean), keys, apply_prob, aug_weight, seed, {
        c: S.erase(c, start, n, length, f"{seed}{c}", *keys, mean=F.col("_mu")) for c in channels}).drop("_mu")


def regional_sign_flip(df, keys, channels, length, min_region_fraction, max_region_fraction, log_sample=True,
                       apply_prob=1.0, aug_weight=0.5, seed=0):
    start, n = _region(length, min_region_fraction, max_region_fraction, seed, keys, log_sample)
    return _apply(df, keys, apply_prob, aug_weight, seed, {c: S.sign_flip(c, start, n, length) for c in channels})


def regional_signal_mix(df, keys, channels, length, min_region_fraction, max_region_fraction, log_sample=True,
                        apply_prob=1.0, aug_weight=0.5, seed=0):
    """A region becomes the mean of itself and another region of the same row."""
    start, n = _region(length, min_region_fraction, max_region_fraction, seed, keys, log_sample)
    take, _ = S.region(length, min_region_fraction, max_region_fraction, f"{seed}t", *keys)
    return _apply(df, keys, apply_prob, aug_weight, seed, {c: S.signal_mix(c, start, take, n, length) for c in channels})


def elastic_deformation(df, keys, channels, labels, alpha, sigma, background=0.0, apply_prob=1.0, aug_weight=0.5, seed=0):
    """Stretch all channels and the labels of a row by the same offsets.

    ``alpha`` and ``sigma`` are numbers, or ranges that each row draws from.
    """
    pair = lambda v: v if isinstance(v, (list, tuple)) else (v, None)
    a, s = _between(*pair(alpha), f"{seed}a", keys), _between(*pair(sigma), f"{seed}s", keys)
    u = F.transform(channels[0], lambda x, i: S.uniform(f"{seed}u", *keys, i) * 2 - 1)
    rows = df.withColumns({"_u": u, "_a": a, "_s": s})
    moved = {c: elastic(F.col(c), F.col(labels), F.col("_u"), F.col("_a"), F.col("_s"), background) for c in channels}
    rows = rows.withColumns({f"_m_{c}": m for c, m in moved.items()})
    made = {c: F.col(f"_m_{c}.signal") for c in channels} | {labels: F.col(f"_m_{channels[0]}.labels")}
    return _apply(rows, keys, apply_prob, aug_weight, seed, made).drop("_u", "_a", "_s", *[f"_m_{c}" for c in channels])


# Names by which settings choose an augmentation.
BY_NAME = {
    "GlobalAmplitude": global_amplitude, "GlobalShift": global_shift, "GlobalGaussianNoise": global_noise,
    "ChannelDropout": channel_dropout, "RegionalGaussianNoise": regional_noise, "RegionalErase": regional_erase,
    "RegionalSignFlip": regional_sign_flip, "RegionalSignalMix": regional_signal_mix,
    "GlobalElasticDeformations": elastic_deformation,
}
