"""Ordered work within a recording that never needs one task per recording.

A window ``PARTITION BY recording`` puts a whole recording into one task, and
one recording may hold a third of all rows. Rows are therefore cut into chunks
of a fixed index span, and what crosses a border is handled in one of two ways:

* ``halo`` copies the few rows near a border into the neighbour chunk, for
  frames of bounded reach;
* ``scan`` sums each chunk up in one row, runs the window over those rows, and
  joins the carry back on (keys, chunk), for running sums and neighbours of
  unbounded reach.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from somnia.session import materialise

CHUNK = 1 << 16


class Stored(int):
    """Chunk span of rows from ``sources.store.open_chunked``: they lie by (keys, chunk), with copies within ``reach`` of a border.

    Given as the ``chunk`` of an operator that reads those rows, it lets ``attach`` and ``halo`` use them where they lie.
    """

    def __new__(cls, span: int, reach: int):
        self = super().__new__(cls, span)
        self.reach = reach
        return self


def chunk_of(idx, chunk: int = CHUNK) -> Column:
    idx = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(idx / F.lit(int(chunk))).cast("long")


def halo(df: DataFrame, keys: list[str], idx: str, before: int, after: int,
         chunk: int = CHUNK) -> tuple[DataFrame, object]:
    """Rows copied into each chunk that can see them, and the window to use.

    A row's frame may reach ``before`` indices back and ``after`` ahead. Filter
    ``_core`` once the window values are in; each input row is core once.
    Rows of a chunked table are used as they lie if their copies reach far
    enough, and copied anew from the core rows if not.
    """
    if "_core" in df.columns:
        if isinstance(chunk, Stored) and max(before, after) <= chunk.reach:
            return df, Window.partitionBy(*keys, "_chunk").orderBy(idx)
        df = drop_halo(df)
    elif isinstance(chunk, Stored):
        raise ValueError("these rows lost the columns _chunk and _core of their table; take drop_halo of it and a plain chunk")
    i = F.col(idx)
    out = (
        df.withColumn("_chunk", F.explode(F.sequence(
            chunk_of(i - F.lit(after), chunk), chunk_of(i + F.lit(before), chunk))))
        .withColumn("_core", F.col("_chunk") == chunk_of(i, chunk))
    )
    return out, Window.partitionBy(*keys, "_chunk").orderBy(idx)


def drop_halo(df: DataFrame, keep_chunk: bool = False) -> DataFrame:
    """Core rows; with ``_chunk`` kept, a ``scan`` over it needs no new shuffle."""
    return df.where("_core").drop("_core") if keep_chunk else df.where("_core").drop("_core", "_chunk")


def scan(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
         keep_chunk: bool = False, **outs: tuple) -> DataFrame:
    """Running values over ``keys`` in ``order``, in two levels.

    ``chunk`` must not decrease along ``order``. Each output is one of
    ``("sum", col)`` and ``("count",)`` up to and including the row,
    ``("max_before", col)`` over earlier rows, ``("lag", col)`` and
    ``("lead", col)`` for the row before and after. With ``keep_chunk`` the
    chunk stays as ``_chunk`` for a next scan on the same shuffle.
    """
    rows = df.withColumn("_chunk", chunk)
    here = Window.partitionBy(*keys, "_chunk").orderBy(*order)
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    past = here.rowsBetween(Window.unboundedPreceding, -1)
    chunks = Window.partitionBy(*keys).orderBy("_chunk")
    before = chunks.rowsBetween(Window.unboundedPreceding, -1)
    position = F.struct(*order)

    inner, totals, carries, merged = {}, [], {}, {}
    for name, (kind, *arg) in outs.items():
        col = F.col(arg[0]) if arg and isinstance(arg[0], str) else (arg[0] if arg else F.lit(1))
        local, carry, total = f"_l_{name}", f"_c_{name}", f"_t_{name}"
        if kind in ("sum", "count"):
            inner[local] = (F.sum(col) if kind == "sum" else F.count(F.lit(1))).over(upto)
            totals.append((F.sum(col) if kind == "sum" else F.count(F.lit(1))).alias(total))
            carries[carry] = F.sum(total).over(before)
            merged[name] = F.coalesce(F.col(local) + F.col(carry), local, carry)
        elif kind == "max_before":
            inner[local] = F.max(col).over(past)
            totals.append(F.max(col).alias(total))
            carries[carry] = F.max(total).over(before)
            merged[name] = F.greatest(local, carry)
        elif kind in ("lag", "lead"):
            step = F.lag if kind == "lag" else F.lead
            inner[local] = step(F.struct(col.alias("v"))).over(here)
            pick = F.max_by if kind == "lag" else F.min_by
            totals.append(pick(F.struct(col.alias("v")), position).alias(total))
            carries[carry] = step(F.col(total)).over(chunks)
            merged[name] = F.coalesce(local, carry)["v"]
        else:
            raise ValueError(f"unknown running value {kind}")

    summary = rows.groupBy(*keys, "_chunk").agg(*totals)
    summary = summary.select(*keys, "_chunk", *[c.alias(n) for n, c in carries.items()])
    joined = rows.withColumns(inner).join(summary, [*keys, "_chunk"], "left")
    columns = [c for c in df.columns if c != "_chunk"] + (["_chunk"] if keep_chunk else [])
    return joined.select(*columns, *[c.alias(n) for n, c in merged.items()])


def ordinal(df: DataFrame, keys: list[str], order: str, name: str,
            chunk: int = CHUNK) -> DataFrame:
    """Position from 0 within ``keys`` by a unique integer column."""
    out = scan(df, keys, [order], chunk_of(order, chunk), **{name: ("count",)})
    return out.withColumn(name, F.col(name) - 1)


def ranked(df: DataFrame, keys: list[str], order: list[Column], name: str, total: str | None = None,
           rows_per_task: int = 500_000) -> DataFrame:
    """Position from 0 within ``keys`` in ``order``, for any sortable columns; optionally the rows of the key as ``total``.

    A range shuffle on keys and order, its tasks sorted and written with each row's place; rows per key and task are then
    counted and the counts of earlier tasks added. No window sees more than one row per key and task, so a key that holds
    most rows is spread like any other, and rows that are equal in all of these columns are told apart by their place in
    the input, which for a lasting order must come from a written table. NULL keys are a key of their own.
    """
    given = df.withColumn("_given", F.monotonically_increasing_id())
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // rows_per_task))
    sort = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("_given")]
    placed = given.repartitionByRange(tasks, *sort).sortWithinPartitions(*sort).drop("_given")
    placed = materialise(placed.withColumn("_at", F.monotonically_increasing_id()))
    task = F.shiftright("_at", 33)
    counts = placed.groupBy(*keys, task.alias("_task")).agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(own.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select(*[F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)], F.col("_task").alias("_counted"),
                           (before - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("_total"))
    same = [F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)]
    found = placed.join(counts, reduce(Column.__and__, same, task == F.col("_counted")))
    return found.select(*df.columns, (F.col("_at") + F.col("_shift")).alias(name), *([F.col("_total").alias(total)] if total else []))


def summarise(df: DataFrame, keys: list[str], idx: str, **aggs: Column) -> DataFrame:
    """Statistics per key with the index range that ``attach`` spreads them over; of a chunked table each row counts once."""
    df = df.where("_core") if "_core" in df.columns else df
    return df.groupBy(*keys).agg(F.min(idx).alias("_first"), F.max(idx).alias("_last"),
                                 *[a.alias(n) for n, a in aggs.items()])


def attach(df: DataFrame, stats: DataFrame, keys: list[str], idx: str,
           chunk: int = CHUNK, how: str = "left") -> DataFrame:
    """Join one row per key to every row of the key, without a hot join key.

    The statistics are first spread over the chunks each key has, so the large
    join runs on (keys, chunk) and no task gets more than a chunk of one key.
    Statistics from ``summarise`` know their chunks; for others the chunks are
    read off the rows.
    """
    stored = isinstance(chunk, Stored) and "_core" in df.columns
    rows = df if stored else df.withColumn("_chunk", chunk_of(idx, chunk))
    if "_first" in stats.columns:
        spread = stats.withColumn("_chunk", F.explode(F.sequence(
            chunk_of("_first", chunk), chunk_of("_last", chunk)))).drop("_first", "_last")
    else:
        spread = rows.select(*keys, "_chunk").distinct().join(stats, keys)
    joined = rows.join(spread, [*keys, "_chunk"], how)
    return joined if stored else joined.drop("_chunk")


def attach_by_hash(df: DataFrame, stats: DataFrame, keys: list[str], cols: list[str], largest: Column | None = None,
                   rows_per_part: int = CHUNK) -> DataFrame:
    """``attach`` for rows without an index: a key's rows are cut up by a hash of ``cols``.

    ``cols`` should tell rows apart. There are as many parts as the largest key needs for ``rows_per_part`` rows each;
    its size is counted unless ``largest``, a scalar column, says it.
    """
    if largest is None:
        largest = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).scalar()
    parts = F.greatest(F.ceil(F.coalesce(largest, F.lit(0)) / F.lit(rows_per_part)), F.lit(1)).cast("long")
    rows = df.withColumn("_part", F.pmod(F.xxhash64(*cols), parts))
    spread = rows.select(*keys, "_part").distinct().join(stats, keys)
    return rows.join(spread, [*keys, "_part"], "left").drop("_part")
