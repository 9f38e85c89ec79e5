"""Selections and projections on samples, epochs, labels and channels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from somnia.functions.scalar import lookup
from somnia.schemas import CHANNEL_TYPES, PSG_STAGES, RAT_STAGES, SLEEP_STAGE_TEXT

from .ordered import CHUNK, attach, chunk_of, scan, summarise


def pick_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.where(F.col("channel").isin(channels))


def exclude_channels(df: DataFrame, channels: list[str]) -> DataFrame:
    return df.where(~F.col("channel").isin(channels))


def with_channel_type(df: DataFrame, types: dict[str, str] = CHANNEL_TYPES,
                      default: str = "seeg") -> DataFrame:
    return df.withColumn("type", lookup(types, "channel", default))


def rename_channels(df: DataFrame, names: dict[str, str]) -> DataFrame:
    return df.withColumn("channel", F.coalesce(lookup(names, "channel"), F.col("channel")))


def keep_stages(df: DataFrame, names: list[str], vocabulary: dict[str, int] = RAT_STAGES) -> DataFrame:
    """Epochs whose stage is named; names in any case. All names keeps all rows."""
    wanted = [vocabulary[n.lower()] for n in names]
    return df if set(wanted) == set(vocabulary.values()) else df.where(F.col("stage").isin(wanted))


def keep_datasets(df: DataFrame, datasets: list[str] | None = None, subjects: list | None = None) -> DataFrame:
    """Rows of the named datasets and subjects; both prune a partitioned store."""
    for name, values in (("dataset", datasets), ("subject", subjects)):
        df = df.where(F.col(name).isin(values)) if values is not None else df
    return df


def stage_map(spark: SparkSession, dataset: str, texts: dict[str, int] = SLEEP_STAGE_TEXT) -> DataFrame:
    """A dataset's map from text to class as rows, for ``stage_from_text``."""
    return spark.createDataFrame([(dataset, k, v) for k, v in texts.items()], "dataset string, text string, stage int")


def stage_from_text(df: DataFrame, stage_map: DataFrame, text: str = "description") -> DataFrame:
    """Class of each text by its dataset's map; NULL when the text is not mapped.

    The map has a few texts per dataset; Spark broadcasts it when its measured
    size allows and shuffles both sides otherwise.
    """
    m = stage_map.select("dataset", F.col("text").alias(text), "stage")
    return df.join(m, ["dataset", text], "left")


def stage_name(stage) -> Column:
    return lookup(PSG_STAGES, stage)


def in_range(stage, n_classes: int) -> Column:
    return F.col(stage).between(0, n_classes - 1)


def merge_nrem(stage) -> Column:
    return F.when(F.col(stage).isin(1, 2, 3), F.lit(1)).otherwise(F.col(stage))


def drop_head(df: DataFrame, idx: str, n: int) -> DataFrame:
    """Drop the first ``n`` rows of each recording and start again at 0."""
    return df.where(F.col(idx) >= n).withColumn(idx, F.col(idx) - n)


def whole_samples(seconds: float, fs: float) -> int:
    n = seconds * fs
    if n != int(n):
        raise ValueError(f"{seconds} s is not a whole number of samples at {fs} Hz")
    return int(n)


def drop_remainder(df: DataFrame, keys: list[str], idx: str, size: int) -> DataFrame:
    """Keep whole blocks of ``size`` rows. With a dense index only the last block
    can be short, so counting inside each block is enough."""
    w = Window.partitionBy(*keys, "_block")
    return (df.withColumn("_block", chunk_of(idx, size)).withColumn("_in", F.count(F.lit(1)).over(w))
            .where(F.col("_in") == size).drop("_block", "_in"))


SECONDS = 64  # of a recording in one chunk where rows are placed by time: 160,000 samples at 2,500 Hz


def crop_to_annotations(samples: DataFrame, annotations: DataFrame, keys: list[str], time: str,
                        margin: float = 1800.0, span: float = float(CHUNK), chunk: int = SECONDS) -> DataFrame:
    """Samples from ``margin`` before the second annotation to ``margin`` after
    the last but one; the outer annotations are recording edges. ``span`` and
    ``chunk`` are seconds of annotations and of samples for one task."""
    near = scan(annotations.select(*keys, "onset"), keys, ["onset"],
                F.floor(F.col("onset") / F.lit(span)).cast("long"),
                _prev=("lag", "onset"), _next=("lead", "onset"))
    ends = near.groupBy(*keys).agg(
        (F.min(F.when(F.col("_prev").isNotNull(), F.col("onset"))) - margin).alias("_from"),
        (F.max(F.when(F.col("_next").isNotNull(), F.col("onset"))) + margin).alias("_to"))
    out = attach(samples, ends, keys, time, chunk, "inner")
    return out.where(F.col(time).between(F.col("_from"), F.col("_to"))).drop("_from", "_to")


def trim_ends(df: DataFrame, keys: list[str], time: str, seconds: float, chunk: int = SECONDS) -> DataFrame:
    """Rows less the first and last ``seconds``; ``chunk`` counts seconds too."""
    last = df.groupBy(*keys).agg(F.max(time).alias("_last"))
    out = attach(df, last, keys, time, chunk)
    return out.where(F.col(time).between(F.lit(seconds), F.col("_last") - seconds)).drop("_last")


def wake_trim(pairs: DataFrame, minutes: float, period_sec: float, key: str = "study_id",
              idx: str = "idx", true: str = "true", chunk: int = CHUNK) -> DataFrame:
    """At most ``minutes`` of wake before the first and after the last sleep epoch.

    The last kept index is one short of the full margin, as in the studied
    program. A study without any sleep is returned whole.
    """
    n = int((60 / period_sec) * minutes)
    asleep = F.when(F.col(true) != 0, F.col(idx))
    ends = summarise(pairs, [key], idx, _from=F.min(asleep), _to=F.max(asleep))
    out = attach(pairs, ends, [key], idx, chunk)
    keep = (F.col(idx) >= F.col("_from") - n) & (F.col(idx) < F.col("_to") + n)
    return out.where(F.col("_from").isNull() | keep).drop("_from", "_to")


def equalise(true: DataFrame, pred: DataFrame, keys: list[str]) -> DataFrame:
    """Rows both sides have; a longer tail on either side falls away."""
    return true.join(pred, keys)


def mask_outside(df: DataFrame, stages: list[int], value: str = "value") -> DataFrame:
    return df.withColumn(value, F.when(F.col("stage").isin(stages), F.col(value)))


def decimate(df: DataFrame, idx: str, step: int) -> DataFrame:
    return df.where(F.col(idx) % step == 0).withColumn(idx, F.floor(F.col(idx) / step))


def strip_to_match(epochs: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """Our reading of a named strip function: epochs that have a label."""
    return epochs.join(labels, keys)


def drop_class(df: DataFrame, stage: int) -> DataFrame:
    """Our reading of a named strip function: rows of one class removed."""
    return df.where(F.col("stage") != stage)


def match_path(df: DataFrame, path: str, pattern: str, regex: bool = True) -> DataFrame:
    return df.where(F.col(path).rlike(pattern) if regex else F.col(path).like(pattern))


def bipolar(df: DataFrame, pairs: list[tuple[str, str]], keep: list[str] = ()) -> DataFrame:
    """Difference of two channels at each sample, plus channels kept as they are.

    One pass groups the samples of an instant; a pair with a missing side gives
    no row.
    """
    at = ["recording_id", "sample_idx"]
    names = sorted({c for pair in pairs for c in pair} | set(keep))
    wide = pick_channels(df, names).groupBy(*at).agg(
        *[F.max(F.when(F.col("channel") == c, F.col("value"))).alias(f"c{i}") for i, c in enumerate(names)])
    of = {c: F.col(f"c{i}") for i, c in enumerate(names)}
    made = [F.struct(F.lit(f"{a}-{b}").alias("channel"), (of[a] - of[b]).alias("value")) for a, b in pairs]
    made += [F.struct(F.lit(c).alias("channel"), of[c].alias("value")) for c in keep]
    return (wide.select(*at, F.explode(F.array(*made)).alias("_m")).select(*at, "_m.*")
            .where(F.col("value").isNotNull()))


def montage(df: DataFrame, wanted: list[str]) -> DataFrame:
    """Channels in ``wanted``: taken as they are when a recording has them, else
    built from ``A-B``. What can be neither taken nor built is left out."""
    derived = [tuple(w.split("-")) for w in wanted if w.count("-") == 1]
    have = pick_channels(df, wanted).select("recording_id", "channel", "sample_idx", "value")
    built = bipolar(df, derived).select("recording_id", "channel", "sample_idx", "value") if derived else None
    if built is None:
        return have
    present = have.select("recording_id", "channel", "sample_idx")
    return have.unionByName(built.join(present, ["recording_id", "channel", "sample_idx"], "left_anti"))


def first_available(channels: DataFrame, alternatives: list[list[str]]) -> DataFrame:
    """First alternative whose channels are all in the recording, as ``choice``."""
    flags = channels.groupBy("recording_id").agg(*[
        F.max((F.col("channel") == c).cast("int")).alias(f"h{i}_{j}")
        for i, alt in enumerate(alternatives) for j, c in enumerate(alt)])
    choice = F.lit(None).cast("int")
    for i in reversed(range(len(alternatives))):
        full = F.least(F.lit(1), *[F.col(f"h{i}_{j}") for j in range(len(alternatives[i]))]) == 1
        choice = F.when(full, F.lit(i)).otherwise(choice)
    return flags.select("recording_id", choice.alias("choice")).where(F.col("choice").isNotNull())


def scale_units(df: DataFrame, factor: float, offset=0.0, value: str = "value") -> DataFrame:
    return df.withColumn(value, F.col(value) * F.lit(factor) + offset)
