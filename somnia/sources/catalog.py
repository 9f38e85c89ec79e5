"""File listings, channel inventories and dataset settings as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from somnia.operators.ordered import attach_by_hash
from somnia.operators.project import with_channel_type


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Paths, sizes and times below a folder, without reading contents."""
    return (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
            .option("recursiveFileLookup", "true").load(path).select("path", "length", "modificationTime"))


def recording_triplets(files: DataFrame, path: str = "path") -> DataFrame:
    """HPC, PFC and states file of each trial, paired by name."""
    pattern = r"([^/]+)_(HPC|PFC|states)(\.[^/]*)?$"
    rows = files.select(path, F.regexp_extract(path, pattern, 1).alias("trial"),
                        F.lower(F.regexp_extract(path, pattern, 2)).alias("kind")).where("kind <> ''")
    return rows.groupBy("trial").agg(*[F.max(F.when(F.col("kind") == k, F.col(path))).alias(k)
                                       for k in ("hpc", "pfc", "states")])


def group_by_subject(files: DataFrame, regex: str, path: str = "path") -> DataFrame:
    """Subject key of each path, and how many files share it.

    The pattern must match once; ``ok`` is false where it does not. Files stay
    one row each, since a subject may have any number of them.
    """
    rows = files.withColumn("n_matches", F.regexp_count(path, F.lit(regex)))
    rows = rows.withColumns({"subject": F.regexp_extract(path, regex, 1), "ok": F.col("n_matches") == 1})
    sizes = rows.groupBy("subject").agg(F.count(F.lit(1)).alias("n_files"))
    return attach_by_hash(rows, sizes, ["subject"], [path], sizes.agg(F.max("n_files")).scalar())


def pair_by_id(true: DataFrame, pred: DataFrame, regex: str, path: str = "path") -> DataFrame:
    """True and predicted file of each study; ``ok`` if there is one of both."""
    side = lambda df, name: df.select(F.regexp_extract(path, regex, 1).alias("study_id"), F.col(path).alias(name))
    t, p = side(true, "true_path"), side(pred, "pred_path")
    agg = lambda df, c: df.groupBy("study_id").agg(F.min(c).alias(c), F.count(F.lit(1)).alias(f"n_{c}"))
    both = agg(t, "true_path").join(agg(p, "pred_path"), "study_id", "full")
    return both.withColumn("ok", F.coalesce((F.col("n_true_path") == 1) & (F.col("n_pred_path") == 1), F.lit(False)))


def split_manifest(splits: DataFrame, records: DataFrame, subject: str) -> DataFrame:
    """Paths of each part of each split."""
    return splits.join(records, subject).select("split", "part", subject, "path")


def channel_inventory(channels: DataFrame, types: list[str] | None = None) -> DataFrame:
    """Distinct channels with their type and the number of recordings that have them."""
    out = with_channel_type(channels.groupBy("channel").agg(F.count_distinct("recording_id").alias("n_recordings")))
    return out.where(F.col("type").isin([t.lower() for t in types])) if types else out


def dataset_paths(spark: SparkSession, settings: dict[str, dict]) -> DataFrame:
    """Settings of datasets as rows ``dataset, part, path, period_sec, scaler``."""
    rows = [(name, part, f"{s['data_dir'].rstrip('/')}/{sub}", float(s.get("period_sec", 30)), s.get("scaler", "RobustScaler"))
            for name, s in settings.items() for part, sub in s["parts"].items()]
    return spark.createDataFrame(rows, "dataset string, part string, path string, period_sec double, scaler string")


def channel_sets(groups: DataFrame, by: list[str], n_groups: int | None = None) -> DataFrame:
    """Every choice of one channel per group, less unordered duplicates.

    ``groups`` has ``group_no`` from 0 and ``channel``; how many groups there are
    is read from the data unless given, and a group beyond a given number raises. The combinations are the
    result; repeated rows of a channel are dropped first, so their number is
    that of a study's distinct channels, which its recorder fixes.
    """
    groups = groups.select(*by, "group_no", "channel").distinct()
    there = (groups.agg(F.max("group_no")).first()[0] or 0) + 1
    if n_groups is not None and there > n_groups:
        raise ValueError(f"there are {there} groups, not {n_groups}")
    n_groups = n_groups or there
    out = groups.where("group_no = 0").select(*by, F.array("channel").alias("_c"))
    for g in range(1, n_groups):
        side = groups.where(F.col("group_no") == g).select(*by, F.col("channel").alias("_n"))
        out = out.join(side, by).withColumn("_c", F.array_append("_c", F.col("_n"))).drop("_n")
    return (out.groupBy(*by, F.array_sort("_c").alias("_p")).agg(F.min("_c").alias("_m"))
            .select(*by, F.array_join("_m", "+").alias("channel_set")))
