"""Session settings and the shared folder for tables written between jobs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_KEY = "spark.checkpoint.dir"


def build_session(app: str = "somnia", master: str | None = None, **conf) -> SparkSession:
    """Session with adaptive execution on; explicit settings win."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    settings.update(conf)
    for key, value in settings.items():
        b = b.config(key, value)
    return b.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """A new folder that every executor can reach.

    It lies under ``spark.checkpoint.dir``. Only a local session, where driver
    and executors share one disk, may fall back to a temporary folder.
    """
    base = spark.conf.get(CHECKPOINT_KEY, None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder all executors share")
        base = tempfile.mkdtemp(prefix="somnia-")
        spark.conf.set(CHECKPOINT_KEY, base)
    return f"{base.rstrip('/')}/somnia/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back.

    Cuts the plan where several later passes would otherwise run an expensive
    step again; the written table also survives the loss of executors.
    """
    path = shared_dir(df.sparkSession)
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.written_to = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` returned, once what was made from them is written itself."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
