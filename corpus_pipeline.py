"""A training corpus from raw documents: quality, near copies, test items, personal data, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somnia.llm import decontam, neardup, packing, pii, quality
from somnia.session import materialise


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules score 0.7 or more; all columns stay. The rules learn from the training labels.

    NULL and empty texts are scored by zero statistics; without labelled texts of both classes every row has the share of the label. Repeated
    rows share one score and stay or go together; an empty table gives an empty one.
    """
    rules = quality.fit(docs, _table(spark, sf_dir, "labels"))
    return quality.score(docs, rules, docs.columns, "__quality").filter(F.col("__quality") >= 0.7).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies, that with the smallest id; NULL texts are copies of the empty one, repeated rows become one.

    Columns of any name stay, and an empty table gives an empty one.
    """
    return neardup.keep_one(docs)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no item of the benchmark, as it is or edited; all columns stay.

    NULL and empty texts hold none and stay, as do rows without an id; repeated rows stay or go together.
    """
    return decontam.decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def sanitise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same rows with personal data generalised; n_chars follows the text.

    A NULL text stays NULL, an empty one empty; ids may be NULL, rows repeat, and other columns stay
    as they are whatever their names.
    """
    clean = pii.sanitise(docs)
    return clean.select(*[F.length("text").cast(clean.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in clean.columns])


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all rows in sequences of 1,024; NULL and empty texts give the end token alone, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality", keep_quality),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_test_items),
    ("pii", sanitise),
    ("packing", pack),
]

#: No SQL trains rules, throws darts or merges byte pairs; tests/llm compare each stage with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialise(docs)
    return docs
