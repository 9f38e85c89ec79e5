"""Text formats: vectorised signals, headers, electrodes, hypnograms, metric tables."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from somnia.functions.scalar import bare_suffix, pad_suffix
from somnia.operators.project import stage_name
from somnia.schemas import INTERVALS
from somnia.session import discard, materialise

FOLDERS_PER_TASK, ROWS_PER_TASK, READ_PER_TASK = 200, 1_000_000, 1 << 24


def parse_signal(lines: DataFrame, keys: list[str], line: str = "value") -> DataFrame:
    """Lines ``channel v1 v2 ...`` to one row per sample."""
    parts = F.split(F.trim(line), r"\s+")
    rows = lines.select(*keys, F.get(parts, F.lit(0)).alias("channel"),
                        F.posexplode(F.slice(parts, 2, F.size(parts))).alias("sample_idx", "_v"))
    return rows.select(*keys, "channel", F.col("sample_idx").cast("long").alias("sample_idx"),
                       F.col("_v").cast("double").alias("value"))


def read_signal(spark: SparkSession, path: str) -> DataFrame:
    """Signal files under ``path``; the recording is the file's name without suffix."""
    lines = spark.read.text(path).withColumn(
        "recording_id", F.regexp_extract(F.input_file_name(), r"([^/]+?)(\.[^./]*)?$", 1))
    return parse_signal(lines, ["recording_id"])


def header_values(lines: DataFrame, keys: list[str], names: list[str], line: str = "value") -> DataFrame:
    """``Name=value`` lines to one column per name."""
    key, val = F.regexp_extract(line, r"^(\w+)=(.*)$", 1), F.regexp_extract(line, r"^(\w+)=(.*)$", 2)
    return lines.groupBy(*keys).agg(*[F.max(F.when(key == n, val)).alias(n) for n in names])


def parse_electrodes(lines: DataFrame, to_metres: bool = False, line: str = "value") -> DataFrame:
    """``Name,X,Y,Z`` lines; millimetres become metres on request."""
    part = F.split(F.trim(line), ",")
    unit = 1000.0 if to_metres else 1.0
    return lines.where(F.size(part) >= 4).select(
        *[c for c in lines.columns if c != line], F.get(part, F.lit(0)).alias("name"),
        *[(F.get(part, F.lit(i)).cast("double") / unit).alias(a) for i, a in enumerate("xyz", 1)])


def rename_by_position(df: DataFrame, position: str, names: list[str], column: str = "name") -> DataFrame:
    """Give the row at each position the name listed there; lengths must agree."""
    n = df.agg(F.count(F.lit(1)).alias("n"))
    same = F.assert_true(n.scalar() == len(names), F.lit("number of names differs from number of rows"))
    listed = F.array(*[F.lit(x) for x in names])
    return df.withColumn(column, F.when(same.isNull(), F.get(listed, F.col(position).cast("int"))))


def find_coordinates(channels: DataFrame, electrodes: DataFrame) -> DataFrame:
    """Coordinates of each channel by name, else with its number padded, else bare.

    ``found`` is false for channels without any match.
    """
    at = F.struct("x", "y", "z")
    e = electrodes.groupBy("name").agg(F.first(at).alias("at"))
    out = channels
    tries: list[Column] = [F.col("channel"), pad_suffix(F.col("channel")), bare_suffix(F.col("channel"))]
    for i, name in enumerate(tries):
        side = e.select(F.col("name").alias(f"_k{i}"), F.col("at").alias(f"_a{i}"))
        out = out.withColumn(f"_k{i}", name).join(side, f"_k{i}", "left").drop(f"_k{i}")
    hit = F.coalesce("_a0", "_a1", "_a2")
    return out.select(*channels.columns, hit["x"].alias("x"), hit["y"].alias("y"), hit["z"].alias("z"),
                      hit.isNotNull().alias("found"))


def parse_channel_spec(specs: DataFrame, spec: str = "spec") -> DataFrame:
    """``A++B`` groups and ``name==TYPE`` marks: one row per channel of each spec."""
    rows = specs.withColumn("grouped", F.col(spec).contains("++"))
    rows = rows.select(*rows.columns, F.posexplode(F.split(spec, r"\+\+")).alias("position", "_c"))
    part = F.split("_c", "==")
    return rows.select(*specs.columns, "grouped", "position", F.trim(F.get(part, F.lit(0))).alias("channel"),
                       F.upper(F.trim(F.get(part, F.lit(1)))).alias("type"))


def mixed_specs(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """Requests that mix groups and single channels, which is an error."""
    return parsed.groupBy(*keys).agg(F.min("grouped").alias("_lo"), F.max("grouped").alias("_hi")).where(
        F.col("_lo") != F.col("_hi")).drop("_lo", "_hi")


@contextmanager
def _listing(spark: SparkSession):
    """Folders listed by a few tasks for each core; the default starts a task for each folder, up to 10,000."""
    key = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(key)
    spark.conf.set(key, str(min(int(before), 8 * spark.sparkContext.defaultParallelism)))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def read_intervals(spark: SparkSession, path: str, kind: str = "ids") -> DataFrame:
    """Sparse hypnogram: ``.ids`` is comma separated without header, ``.tsv`` has one. Folders' columns follow.

    Spark would give each few small files a task of their own; here tasks follow the bytes, or the cores if that is more.
    """
    tab = kind == "tsv"
    with _listing(spark):
        rows = spark.read.schema(INTERVALS).csv(path, sep="\t" if tab else ",", header=tab)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.coalesce(max(size // READ_PER_TASK + 1, 16 * spark.sparkContext.defaultParallelism))


def _by_recording(df: DataFrame, path: str, by: list[str], order: str, columns: list, kind: str, **options) -> None:
    """A folder per recording, its rows in order over the part files; a large recording has several tasks.

    Making a file takes far longer than filling it, so the tasks follow the number of recordings too, which their bytes
    do not tell. Where the folder is a local or mounted one, the tasks make the files themselves; elsewhere Spark does,
    and each task puts its own folders in place when it ends instead of the driver all of them at the end.
    """
    if not by:
        return df.orderBy(order).select(*columns).write.mode("overwrite").options(**options).format(kind).save(path)
    empty = {n for n, t in df.dtypes if t == "string"}  # an empty name is none: both lie in one folder
    named = [F.when(F.col(c) != "", F.col(c)).alias(c) if c in empty else F.col(c) for c in by]
    rows = materialise(df.select(*named, F.col(order).alias("_order"), *columns))
    size = rows.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(F.xxhash64(*by)).alias("folders")).first()
    tasks = max(1, -(-size.folders // FOLDERS_PER_TASK), -(-size.rows // ROWS_PER_TASK))
    placed = rows.repartitionByRange(tasks, *by, "_order").sortWithinPartitions(*by, "_order").drop("_order")
    spark = df.sparkSession
    to = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = to.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getUri().getScheme() == "file":
        fs.delete(to, True)
        fs.mkdirs(to)
        _make_files(placed, fs.makeQualified(to).toUri().getPath(), by, kind, options)
        fs.create(spark._jvm.org.apache.hadoop.fs.Path(to, "_SUCCESS")).close()
    else:
        placed.write.mode("overwrite").partitionBy(*by).option("mapreduce.fileoutputcommitter.algorithm.version", "2").options(**options).format(kind).save(path)
    discard(rows)


#: Characters of a value that Spark writes as % and two digits in a folder's name.
_ESCAPED = str.maketrans({c: f"%{ord(c):02X}" for c in [*map(chr, range(1, 32)), *"\"#%'*/:=?\\\x7f{[]^"]})


def _make_files(placed: DataFrame, top: str, by: list[str], kind: str, options: dict) -> None:
    """Files as Spark's writer would name and fill them, for rows sorted by ``by``.

    Hadoop's local file system starts several processes to set the permissions of each file and folder, which takes a
    hundred times as long as making them. A file gets its name when it is whole, and that name follows from the task's
    number, so what a task that runs again has left is replaced.
    """
    names = [c for c in placed.columns if c not in by]
    sep, job = options.get("sep", ","), uuid.uuid4()
    line = F.to_csv(F.struct(*names), {"sep": sep}) if kind == "csv" else F.coalesce(names[0], F.lit(""))
    head = f"{sep.join(names)}\n".encode() if options.get("header") else b""
    ending = "txt" if kind == "text" else kind

    def folder(values) -> str:
        parts = (f"{c.translate(_ESCAPED)}={v.translate(_ESCAPED) if v else '__HIVE_DEFAULT_PARTITION__'}" for c, v in zip(by, values))
        return os.path.join(top, *parts)

    def make(batches):
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{job}.c000.{ending}"
        draft = f".{name}.{context.taskAttemptId()}"
        at, file, made = None, None, 0

        def close():
            if file:
                file.close()
                os.replace(os.path.join(at, draft), os.path.join(at, name))

        try:
            for batch in batches:
                for *values, text in zip(*(column.to_pylist() for column in batch.columns)):
                    if (here := folder(values)) != at:
                        close()
                        at, file = here, None
                        os.makedirs(at, exist_ok=True)
                        file = open(os.path.join(at, draft), "wb")
                        file.write(head)
                        made += 1
                    file.write(text.encode() + b"\n")
            close()
        except BaseException:
            if file and not file.closed:
                file.close()
            raise
        yield pa.record_batch([pa.array([made])], ["made"])

    placed.select(*[F.col(c).cast("string") for c in by], line.alias("_line")).mapInArrow(make, "made long").agg(F.sum("made")).collect()


def _write_ids(df: DataFrame, path: str, by: list[str]) -> None:
    _by_recording(df, path, by, "init_sec", ["init_sec", "dur_sec", "stage"], "csv", header=False)


def _write_tsv(df: DataFrame, path: str, by: list[str]) -> None:
    _by_recording(df, path, by, "init_sec", ["init_sec", F.col("dur_sec").alias("duration_sec"), "stage"], "csv", header=True, sep="\t")


def _write_hyp(df: DataFrame, path: str, by: list[str]) -> None:
    """One stage name per line, in epoch order over the part files of each recording."""
    _by_recording(df, path, by, "epoch_idx", [stage_name("stage").alias("value")], "text")


def _write_table(df: DataFrame, path: str, by: list[str]) -> None:
    df.write.mode("overwrite").parquet(path)


SINKS = {"ids": _write_ids, "tsv": _write_tsv, "hyp": _write_hyp, "parquet": _write_table}
READERS = {"ids": lambda s, p: read_intervals(s, p, "ids"), "tsv": lambda s, p: read_intervals(s, p, "tsv"),
           "parquet": lambda s, p: s.read.parquet(p)}


def save_prediction(df: DataFrame, path: str, by: list[str] = ("recording_id",)) -> str:
    """Write by the path's ending; an unknown ending writes a table. Returns the kind.

    Text kinds get one folder per value of ``by``, from which readers take the
    columns again; ``by=[]`` writes the one recording that ``df`` holds.
    """
    kind = path.rsplit(".", 1)[-1] if "." in path.rsplit("/", 1)[-1] else ""
    kind = kind if kind in SINKS else "parquet"
    if kind != "parquet" and "scores" in df.columns:
        raise ValueError(f"scores cannot be written as .{kind}; use a table")
    SINKS[kind](df, path, list(by))
    return kind


def read_metric_tables(spark: SparkSession, paths: list[str], drop_rows: list[str] = (),
                       drop_cols: list[str] = ()) -> DataFrame:
    """Stack metric tables whose columns may differ, less the named rows and columns."""
    out = None
    for path in paths:
        t = spark.read.option("header", True).csv(path)
        key = t.columns[0]
        t = t.where(~F.col(key).isin(list(drop_rows))).drop(*drop_cols)
        t = t.select(F.col(key).alias("row"), *[F.col(c).cast("double").alias(c) for c in t.columns if c != key])
        out = t if out is None else out.unionByName(t, allowMissingColumns=True)
    return out


def write_evaluation(df: DataFrame, path: str, digits: int = 3) -> None:
    """Full values as ``csv`` and rounded ones as ``rounded`` below ``path``."""
    doubles = {n for n, t in df.dtypes if t == "double"}
    df.write.mode("overwrite").csv(f"{path}/csv", header=True)
    df.select(*[F.round(c, digits).alias(c) if c in doubles else F.col(c) for c in df.columns]).write.mode(
        "overwrite").csv(f"{path}/rounded", header=True, sep="\t")


def write_statistics(stats: DataFrame, path: str) -> None:
    stats.write.mode("overwrite").json(path)
