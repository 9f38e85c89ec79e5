"""Functions chosen by name from settings: strips, scalers, readers, augmentations."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from somnia.operators import augment, project, scaling
from somnia.sources import text

STRIPS: dict[str, Callable[..., DataFrame]] = {
    "strip_to_match": project.strip_to_match,
    "drop_class": project.drop_class,
    "trim_psg_trailing": project.drop_remainder,
}
QUALITY: dict[str, Callable[..., DataFrame]] = {
    "clip_noisy_values": scaling.clip_noisy,
    "zero_out_noisy_epochs": scaling.zero_noisy_epochs,
}
SCALERS = ("RobustScaler", "StandardScaler", "MinMaxScaler", "MaxAbsScaler", "QuantileTransformer")
READERS = text.READERS
AUGMENTERS: dict[str, Callable[..., DataFrame]] = dict(augment.BY_NAME)


def register(kind: dict, name: str):
    """Add a function under a name; a name is given once."""
    def wrap(fn):
        if name in kind:
            raise ValueError(f"{name} is registered already")
        kind[name] = fn
        return fn
    return wrap


def apply_named(df: DataFrame, kind: dict, steps: list[tuple[str, dict]]) -> DataFrame:
    """Run named steps in order, each with its own settings."""
    for name, settings in steps:
        if name not in kind:
            raise KeyError(f"no function named {name}; known: {sorted(kind)}")
        df = kind[name](df, **settings)
    return df
