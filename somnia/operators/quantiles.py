"""Exact percentiles without collecting a group.

Spark's ``percentile`` keeps every distinct value of a group in one buffer.
Here a histogram with map-side combine finds the cell that holds each wanted
rank, and only the rows of those cells are shuffled, as counts by value. Cells
are a share of a value wide, 256 to each doubling, so that a long tail, one huge
artefact or columns of different size do not pull most rows into one cell, and
they need no pass for the span. Cells are told apart by number, never by
comparing bounds, so the result is exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import CHUNK, chunk_of, scan

BINS = 4096
ACCURACY = 1000  # a sketch's answer is off by at most n / ACCURACY ranks, or by less in large groups
HELD = 1_000_000  # values that a bracket holds at most


def _cell(value, lo, hi, bins):
    width = F.col(hi) - F.col(lo)
    pos = F.floor((F.col(value) - F.col(lo)) / F.nullif(width, F.lit(0.0)) * bins)
    return F.coalesce(F.least(F.greatest(pos, F.lit(0)), F.lit(bins - 1)), F.lit(0)).cast("int")


def _scaled_cell(value) -> Column:
    """Number of a value's cell: rises with the value, 256 cells to each doubling of its size, 0 for 0."""
    per = 256 / math.log(2)
    size = F.floor(F.least(F.ln(F.abs(F.col(value))), F.lit(711.0)) * per).cast("int") + math.ceil(746 * per)
    return F.coalesce(F.when(F.col(value) > 0, size).when(F.col(value) < 0, -size), F.lit(0))


def _locate(cells: DataFrame, by: list[str], order: str) -> DataFrame:
    """Keep the cells that hold a wanted rank, ranks made relative to the cell."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    out = cells.withColumn("_before", F.coalesce(F.sum("_n").over(w), F.lit(0)))
    inside = F.filter("_ranks", lambda r: (r["rel"] >= F.col("_before"))
                      & (r["rel"] < F.col("_before") + F.col("_n")))
    moved = F.transform(inside, lambda r: F.struct(
        r["rank"].alias("rank"), (r["rel"] - F.col("_before")).alias("rel")))
    return (out.withColumn("_ranks", moved).where(F.size("_ranks") > 0).drop("_before"))


def exact_percentiles(df: DataFrame, keys: list[str], value: str, ps: dict[str, float],
                      bins: int = BINS) -> DataFrame:
    """``keys`` plus one column per named fraction, linear between ranks."""
    rows = df.select(*keys, F.col(value).cast("double").alias("_x")).where(
        F.col("_x").isNotNull() & ~F.isnan("_x"))
    rows = rows.select(*keys, _scaled_cell("_x").alias("_c0"), "_x")

    size = Window.partitionBy(*keys)
    hist = rows.groupBy(*keys, "_c0").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    hist = hist.withColumn("_total", F.sum("_n").over(size))
    ranks = []
    for p in ps.values():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        ranks += [F.floor(pos).cast("long"), F.ceil(pos).cast("long")]
    hist = hist.withColumn("_ranks", F.transform(
        F.array_distinct(F.array(*ranks)), lambda r: F.struct(r.alias("rank"), r.alias("rel"))))
    first = _locate(hist, keys, "_c0").drop("_n")

    # A cell of one value is its own answer, however many rows hold it. Rows of
    # the other wanted cells are counted by value. Ranks inside a cell are running counts in two
    # levels, over slices of the cell's own value range.
    cell = [*keys, "_c0"]
    values = (rows.join(first.where("_lo < _hi"), cell).groupBy(*cell, "_x").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("_ranks", "_total", "_lo", "_hi")]))
    values = values.withColumn("_c1", _cell("_x", "_lo", "_hi", bins))
    last = scan(values, cell, ["_x"], F.col("_c1").cast("long"), _upto=("sum", "_n"))
    last = last.withColumn("_ranks", F.filter("_ranks", lambda r: (r["rel"] >= F.col("_upto") - F.col("_n"))
                                              & (r["rel"] < F.col("_upto")))).where(F.size("_ranks") > 0)

    alone = first.where("_lo = _hi").select(*keys, F.col("_lo").alias("_x"), "_total", "_ranks")
    hits = last.select(*keys, "_x", "_total", "_ranks").unionByName(alone)
    hits = hits.select(*keys, "_x", "_total", F.explode("_ranks.rank").alias("_rank"))
    outs = []
    for name, p in ps.items():
        pos = F.lit(float(p)) * (F.col("_total") - 1)
        low = F.max(F.when(F.col("_rank") == F.floor(pos), F.col("_x")))
        high = F.max(F.when(F.col("_rank") == F.ceil(pos), F.col("_x")))
        frac = F.max(pos - F.floor(pos))
        outs.append((low + (high - low) * frac).alias(name))
    return hits.groupBy(*keys).agg(*outs)


def column_quantiles(df: DataFrame, keys: list[str], idx: str, values: list[str], ps: dict[str, float],
                     tails: bool = False, chunk: int = CHUNK) -> DataFrame:
    """Exact percentiles of many columns: ``keys``, ``_first`` and ``_last`` index, and ``{name}_{value}`` columns.

    One wide pass makes a mergeable sketch of every column, combined map-side; its answers a few ranks further out than
    their error are brackets that hold each wanted rank. A second wide pass counts what lies below a bracket and keeps
    the values inside, at most HELD of them: sketches are the finer, the larger the largest group is, which one count
    tells beforehand. A group of few rows is its own bracket, a value that fills a bracket, such as masked zeros, is only
    counted. Brackets meet their rows on (keys, chunk), so a hot key is spread.

    Percentiles are linear between ranks; NULL and NaN do not count, a column without values has NULL. With ``tails``,
    ``low_{name}_{value}`` and ``top_{name}_{value}`` are the means of the values up to and from the percentile.
    """
    most = df.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    accuracy = max(ACCURACY, math.ceil(6 * most / HELD))
    x = {v: F.nanvl(F.col(v).cast("double"), F.lit(None)) for v in values}
    margin = 3 / accuracy
    points = [q for p in ps.values() for q in (max(p - margin, 0.0), min(p + margin, 1.0))]
    alone = most < 4 * accuracy  # every group is its own bracket
    aggs = [F.min(idx).alias("_first"), F.max(idx).alias("_last")]
    for i, v in enumerate(values):
        aggs += [F.count(x[v]).alias(f"_n{i}"), F.min(x[v]).alias(f"_l{i}"), F.max(x[v]).alias(f"_h{i}")]
        aggs += [] if alone else [F.percentile_approx(x[v], points, accuracy).alias(f"_q{i}")]
    stats = df.groupBy(*keys).agg(*aggs)
    cells, brackets = [(i, j) for i in range(len(values)) for j in range(len(ps))], []
    for i, j in cells:
        few, p = F.col(f"_n{i}") < 4 * accuracy, [*ps.values()][j]
        lo = F.col(f"_l{i}") if alone or p - margin <= 0 else F.when(few, F.col(f"_l{i}")).otherwise(F.col(f"_q{i}")[2 * j])
        hi = F.col(f"_h{i}") if alone or p + margin >= 1 else F.when(few, F.col(f"_h{i}")).otherwise(F.col(f"_q{i}")[2 * j + 1])
        brackets += [lo.alias(f"_lo{i}_{j}"), hi.alias(f"_hi{i}_{j}")]
    spread = stats.select(*keys, "_first", "_last", *[f"_n{i}" for i in range(len(values))], *brackets)
    spread = spread.withColumn("_chunk", F.explode(F.sequence(chunk_of("_first", chunk), chunk_of("_last", chunk))))
    rows = df.select(*keys, chunk_of(idx, chunk).alias("_chunk"), *[x[v].alias(f"_x{i}") for i, v in enumerate(values)])
    rows = rows.join(spread, [*keys, "_chunk"])

    same = ["_first", "_last", *[f"_n{i}" for i in range(len(values))], *[f"_{e}{i}_{j}" for i, j in cells for e in ("lo", "hi")]]
    parts = [F.max(c).alias(c) for c in same]
    for i, j in cells:
        at, lo, hi = F.col(f"_x{i}"), F.col(f"_lo{i}_{j}"), F.col(f"_hi{i}_{j}")
        parts += [F.count(F.when(at < lo, 1)).alias(f"_below{i}_{j}"), F.collect_list(F.when((at >= lo) & (at <= hi) & (lo < hi), at)).alias(f"_in{i}_{j}")]
        if tails:
            parts += [F.sum(F.when(at < lo, at)).alias(f"_sum{i}_{j}"), F.sum(F.when(at > hi, at)).alias(f"_rest{i}_{j}"),
                      F.count(F.when(at > hi, 1)).alias(f"_above{i}_{j}"), F.count(F.when((at == lo) & (lo == hi), 1)).alias(f"_same{i}_{j}")]
    found = rows.groupBy(*keys).agg(*parts)
    found = found.withColumns({f"_in{i}_{j}": F.sort_array(f"_in{i}_{j}") for i, j in cells})
    outs, places = [], [(i, v, j, name, p) for i, v in enumerate(values) for j, (name, p) in enumerate(ps.items())]
    cuts = {}
    for i, v, j, name, p in places:
        held, pos, below, lo = F.col(f"_in{i}_{j}"), F.lit(float(p)) * (F.col(f"_n{i}") - 1), F.col(f"_below{i}_{j}"), F.col(f"_lo{i}_{j}")
        rank = lambda r, held=held, below=below: F.get(held, (r - below).cast("int"))
        low, high = rank(F.floor(pos)), rank(F.ceil(pos))
        inside = F.when(F.col(f"_n{i}") > 0, F.assert_true((F.floor(pos) >= below) & (F.ceil(pos) < below + F.size(held)), "a rank lies outside its bracket"))
        value = F.coalesce(inside.cast("double"), low + (high - low) * (pos - F.floor(pos)))
        cuts[f"{name}_{v}"] = F.when(lo < F.col(f"_hi{i}_{j}"), value).otherwise(lo)
    found = found.withColumns(cuts)
    for i, v, j, name, p in places:
        outs.append(f"{name}_{v}")
        if tails:
            col = lambda c, i=i, j=j: F.coalesce(f"{c}{i}_{j}", F.lit(0.0))
            held, cut, lo = F.col(f"_in{i}_{j}"), F.col(f"{name}_{v}"), F.col(f"_lo{i}_{j}")
            total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, e: s + e)
            up, down = F.filter(held, lambda e: e <= cut), F.filter(held, lambda e: e >= cut)  # noqa: B023
            level = F.coalesce(lo * col("_same"), F.lit(0.0))
            outs += [((col("_sum") + level + total(up)) / F.nullif(col("_below") + col("_same") + F.size(up), F.lit(0))).alias(f"low_{name}_{v}"),
                     ((col("_rest") + level + total(down)) / F.nullif(col("_above") + col("_same") + F.size(down), F.lit(0))).alias(f"top_{name}_{v}")]
    return found.select(*keys, "_first", "_last", *outs)
