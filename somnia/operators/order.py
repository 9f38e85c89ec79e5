"""Orders, top rows and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from somnia.session import materialise

from .ordered import CHUNK, chunk_of, ranked, scan


def chronological(df: DataFrame, cols: list[str], position: str | None = None) -> DataFrame:
    """Total order by a range shuffle; as a column ``position`` from 0 if named, which outlasts any later shuffle."""
    if position:
        return ranked(materialise(df), [], [F.col(c).asc_nulls_first() for c in cols], position)
    return df.orderBy(*cols)


def positions(df: DataFrame, group: str, owner: str, number: str, chunk: int = CHUNK) -> DataFrame:
    """Position of each row in the total order ``(group, owner, number)``.

    Rows are counted within (group, owner, chunk of the number) and carried on,
    so no task sorts the table, a group or an owner.
    """
    inner = scan(df, [group], [owner, number], F.struct(F.col(owner), chunk_of(number, chunk).alias("part")), _in=("count",))
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    # One row per group rank, a handful.
    before = sizes.select(group, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    return (inner.join(before, group).withColumn("position", F.col("_before") + F.col("_in") - 1)
            .drop("_before", "_in"))


def _top(df, keys, order, n):
    return (df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
            .where(F.col("rank") <= n))


def top_per_group(df: DataFrame, keys: list[str], value: str, tie: str, n: int) -> DataFrame:
    """The ``n`` largest rows per group, ties by name.

    Spark keeps only ``n`` rows per group on the map side before it shuffles.
    """
    return _top(df, keys, [F.col(value).desc(), F.col(tie)], n)


def first_n(df: DataFrame, keys: list[str], order: str, n: int) -> DataFrame:
    """The first ``n`` rows per group, limited on the map side as well."""
    return _top(df, keys, [F.col(order)], n)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def merge_train_val(train: DataFrame, val: DataFrame) -> DataFrame:
    return train.unionByName(val).withColumn("part", F.lit("train"))


def distinct_members(df: DataFrame, nested: str, name: str) -> DataFrame:
    """Distinct members of arrays of arrays; duplicates in a row go first."""
    return df.select(F.explode(F.array_distinct(F.flatten(nested))).alias(name)).distinct()
