"""State graphs as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from somnia.functions.scalar import dominant
from somnia.session import materialise

from .ordered import drop_halo, halo, scan


def undirected(edges: DataFrame, weight: str = "prob") -> DataFrame:
    """Both directions of an edge added up."""
    return edges.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(
        F.sum(weight).alias(weight))


def degrees(edges: DataFrame, kind: str = "total") -> DataFrame:
    """Edges per node. ``total`` counts ends in the undirected graph, a loop
    twice; ``in`` counts incoming edges."""
    if kind == "in":
        return edges.groupBy(F.col("dst").alias("node")).agg(F.count(F.lit(1)).alias("degree"))
    ends = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    return (ends.select(F.explode(F.array("a", "b")).alias("node"))
            .groupBy("node").agg(F.count(F.lit(1)).alias("degree")))


def node_class(shares: DataFrame, threshold: float | None = None) -> DataFrame:
    """Stage that rules a state: above ``threshold``, or strictly the largest."""
    props = {k: F.col(f"p_{k}") for k in ("wake", "nrem", "rem")}
    return shares.withColumn("node_class", dominant(props, threshold))


def co_occurrence(df: DataFrame, keys: list[str], idx: str, state: str, reach: int,
                  chunk: int = 1 << 16) -> DataFrame:
    """How often two states lie within ``reach`` epochs of each other.

    Each epoch looks ahead over a frame of ``reach`` rows; no pairs beyond
    that are made.
    """
    rows, w = halo(df.select(*keys, idx, state), keys, idx, 0, reach, chunk)
    ahead = F.collect_list(state).over(w.rangeBetween(1, reach))
    rows = drop_halo(rows.withColumn("_ahead", ahead))
    ends = rows.select(F.col(state).alias("s"), F.explode("_ahead").alias("o")).where("s <> o")
    return ends.groupBy(F.least("s", "o").alias("src"), F.greatest("s", "o").alias("dst")).agg(
        F.count(F.lit(1)).alias("n"))


def power_vector(pairs: DataFrame, iterations: int) -> DataFrame:
    """``id v`` after so many steps of power iteration on the row-normalised graph of ``src dst n``.

    The vector starts as the degrees. Its constant part, to which all vectors of a connected graph tend, is taken out in
    each step, so what is left keeps telling the groups apart; the largest size is 1. A step is a join on the edges and
    one aggregate, written out; only two numbers per step are not by node. Where nothing is left all values are 0.
    """
    edges = pairs.select("src", "dst", "n").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "n"))
    edges = materialise(edges.groupBy("src", "dst").agg(F.sum("n").cast("double").alias("n")))
    nodes = edges.groupBy(F.col("src").alias("id")).agg(F.sum("n").alias("d"))
    vector = materialise(nodes.withColumn("v", F.col("d")))
    for step in range(iterations + 1):
        mean = vector.agg(F.sum(F.col("d") * F.col("v")) / F.sum("d")).scalar()
        centred = vector.withColumn("v", F.col("v") - mean)
        size = centred.agg(F.nullif(F.max(F.abs("v")), F.lit(0.0))).scalar()
        unit = centred.withColumn("v", F.coalesce(F.col("v") / size, F.lit(0.0)))
        if step == iterations:
            return unit.select("id", "v")
        seen = edges.join(unit.select(F.col("id").alias("dst"), "v"), "dst")
        vector = materialise(seen.groupBy(F.col("src").alias("id")).agg(
            F.sum("n").alias("d"), (F.sum(F.col("n") * F.col("v")) / F.sum("n")).alias("v")))


def temporal_clusters(pairs: DataFrame, k: int, iterations: int = 6, digits: int = 9) -> DataFrame:
    """Group states that occur close in time: ``power_vector`` cut at its ``k - 1`` widest gaps.

    Values are compared at ``digits`` places, so the order in which sums are made does not matter; of equal gaps the
    lowest counts first, and equal values never part. Groups are numbered upwards along the vector from 0.
    """
    at = materialise(power_vector(pairs, iterations).withColumn("v", F.round("v", digits)))
    gaps = scan(at.select("v").distinct(), [], ["v"], F.floor(F.col("v") * 1024).cast("long"), _before=("lag", "v"))
    gaps = gaps.withColumn("_gap", F.round(F.col("v") - F.col("_before"), digits)).where(F.col("_gap").isNotNull())
    cuts = gaps.orderBy(F.desc("_gap"), "v").limit(k - 1).agg(F.collect_list("v").alias("c"))  # k - 1 numbers
    number = F.size(F.filter("_cuts", lambda c: c <= F.col("v")))
    return at.withColumn("_cuts", cuts.scalar()).select(F.col("id").alias("latent_id"), number.alias("cluster"))
