"""Tables kept between jobs, laid out so that later reads prune."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from somnia.operators.ordered import CHUNK, Stored, attach, chunk_of, halo, ordinal, scan


def write_samples(df: DataFrame, path: str, partitions: list[str], mode: str = "append", chunk: int = CHUNK) -> None:
    """Samples by partition columns, each file sorted by channel and time.

    Rows are spread over tasks by recording, channel and chunk, so a long
    recording is written by many tasks.
    """
    at = ["recording_id", "channel", "sample_idx"]
    rows = df.withColumn("_chunk", chunk_of("sample_idx", chunk))
    (rows.repartition(*partitions, "recording_id", "channel", "_chunk").drop("_chunk")
     .sortWithinPartitions(*partitions, *at).write.mode(mode).partitionBy(*partitions).parquet(path))


def _table_name(path: str) -> str:
    return f"chunked_{hashlib.md5(path.encode()).hexdigest()}"


def write_chunked(df: DataFrame, path: str, keys: list[str] = ("recording_id", "channel"), idx: str = "sample_idx",
                  reach: int = 1 << 12, chunk: int = CHUNK, rows_per_bucket: int = 500_000) -> None:
    """Samples laid out for chunked work: bucketed by (keys, chunk), sorted by index, with the halo of each chunk beside it.

    One shuffle at writing spares one for each operator that reads. Rows within ``reach`` of a chunk's border are kept
    a second time, as copies that are not core: at most ``2 * reach / chunk`` more rows. Buckets follow the number of
    rows, so a bucket stays near ``rows_per_bucket`` whatever the size of a recording; the task that reads it holds that
    many rows in several sorts at once. ``idx`` is a key column: a row without one has no place and raises. A table at
    ``path`` is replaced.
    """
    keys = list(keys)
    size = df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(idx).isNull()).alias("lost")).first()
    if size.lost:
        raise ValueError(f"{size.lost} rows without {idx}")
    buckets = max(1, -(-size.n // rows_per_bucket))
    spark, at = df.sparkSession, [*keys, "_chunk"]
    rows, _ = halo(df, keys, idx, reach, reach, chunk)
    (rows.repartition(buckets, *at).write.mode("overwrite").option("path", f"{path}/rows").option("compression", "zstd")
     .bucketBy(buckets, *at).sortBy(*at, idx).saveAsTable(_table_name(path)))
    layout = spark.createDataFrame([(buckets, int(chunk), reach, at, idx)], "buckets int, span long, reach long, at array<string>, idx string")
    layout.coalesce(1).write.mode("overwrite").parquet(f"{path}/layout")


def open_chunked(spark: SparkSession, path: str) -> tuple[DataFrame, Stored]:
    """The table at ``path`` with ``_chunk`` and ``_core``, and the ``chunk`` to give to operators that read it; in any session.

    Joins and windows on (keys, chunk) start from the files without an exchange. ``drop_halo`` gives the samples alone.
    """
    spec = spark.read.parquet(f"{path}/layout").first()
    name = _table_name(path)
    if not spark.catalog.tableExists(name):
        quoted = lambda names: ", ".join(f"`{c}`" for c in names)
        fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(f"{path}/rows").schema)
        place = f"{path}/rows".replace("'", "\\'")
        spark.sql(f"CREATE TABLE {name} ({fields}) USING parquet CLUSTERED BY ({quoted(spec['at'])}) "
                  f"SORTED BY ({quoted([*spec['at'], spec['idx']])}) INTO {spec['buckets']} BUCKETS LOCATION '{place}'")
    return spark.table(name), Stored(spec["span"], spec["reach"])


def write_features(df: DataFrame, path: str, notes: dict[str, str] | None = None, mode: str = "append",
                   partitions: list[str] = ("dataset", "subject")) -> None:
    """Features and labels by dataset and subject; notes are kept as column comments.

    With very many subjects partition by dataset alone: one folder per subject
    would leave small files.
    """
    out = df
    for name, text in (notes or {}).items():
        out = out.withMetadata(name, {"comment": text})
    out.write.mode(mode).partitionBy(*partitions).parquet(path)


def write_predictions(df: DataFrame, path: str, mode: str = "append") -> None:
    """True labels, predictions and scores of all studies as one table by dataset."""
    df.write.mode(mode).partitionBy("dataset").parquet(path)


def read_features(spark: SparkSession, path: str, datasets: list[str] | None = None,
                  subjects: list | None = None, stages: list[int] | None = None) -> DataFrame:
    """A slice of the store; the first two conditions prune folders."""
    out = spark.read.parquet(path)
    for name, values in (("dataset", datasets), ("subject", subjects), ("stage", stages)):
        out = out.where(F.col(name).isin(values)) if values is not None else out
    return out


def merge_stores(parts: dict[str, DataFrame]) -> DataFrame:
    """Stores put together, each under its dataset name."""
    out = None
    for name, df in parts.items():
        one = df.withColumn("dataset", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def class_index(labels: DataFrame, study: str = "study_id", chunk: int = CHUNK) -> DataFrame:
    """Position of each epoch among its study's epochs of one class.

    A list per class would hold a whole study; rows with a position serve the
    same draws by an equality join.
    """
    return ordinal(labels.select(study, "stage", "epoch_idx"), [study, "stage"], "epoch_idx", "pos", chunk)


def stitch(df: DataFrame, keys: list[str], part: str, idx: str = "sample_idx", chunk: int = CHUNK) -> DataFrame:
    """Parts of a night put end to end: each index moves by the parts before it."""
    per = df.groupBy(*keys, part).agg(F.count(F.lit(1)).alias("_n"))
    ends = scan(per, keys, [part], chunk_of(part, chunk), _end=("sum", "_n"))
    shift = ends.select(*keys, part, (F.col("_end") - F.col("_n")).alias("_shift"))
    return attach(df, shift, [*keys, part], idx, chunk).withColumn(
        "stitched_idx", F.col(idx) + F.col("_shift")).drop("_shift")


def pending(work: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Work whose output is not there yet."""
    return work.join(done.select(*keys), keys, "left_anti")


def check_single_rate(recordings: DataFrame) -> DataFrame:
    """Rates per recording, and whether there is just one."""
    return recordings.groupBy("recording_id").agg(
        F.min("fs").alias("fs"), F.count_distinct("fs").alias("n_rates")).withColumn("ok", F.col("n_rates") == 1)


def model_input(features: DataFrame, order: str, start_day: float, epoch_sec: float, mode: int = 1,
                chunk: int = CHUNK) -> DataFrame:
    """Features with an epoch id from 0 and its time as a serial day."""
    out = ordinal(features, [], order, "id", chunk)
    return out.withColumns({"mode": F.lit(mode), "serial_day": F.lit(start_day) + F.col("id") * (epoch_sec / 86400.0)})
