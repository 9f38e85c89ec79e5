"""Sliding and fixed sequences of epochs, and what models give back for them."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from somnia.functions.scalar import argmax

from .ordered import CHUNK, attach, chunk_of, drop_halo, halo, scan, summarise


def centred_sequences(df: DataFrame, keys: list[str], idx: str, cols: list[str], margin: int,
                      chunk: int = CHUNK) -> DataFrame:
    """For each epoch the ``2 * margin + 1`` epochs around it, as one array.

    Near a border the centre moves inward so that the sequence stays whole. The
    frame reaches ``2 * margin`` rows, which covers any such move. Recordings
    shorter than a sequence give no rows.
    """
    size = 2 * margin + 1
    n = summarise(df, keys, idx, _n=F.max(idx) + 1)
    rows, w = halo(attach(df, n, keys, idx, chunk), keys, idx, 2 * margin, 2 * margin, chunk)
    item = F.struct(F.col(idx), *[F.col(c) for c in cols])
    rows = drop_halo(rows.withColumn("_seq", F.collect_list(item).over(w.rangeBetween(-2 * margin, 2 * margin))))
    centre = F.greatest(F.lit(margin), F.least(F.col("_n") - 1 - margin, F.col(idx)))
    first = centre - margin - F.greatest(F.lit(0), F.col(idx) - 2 * margin)
    return (rows.where(F.col("_n") >= size).withColumn("centre", centre)
            .withColumn("seq", F.slice("_seq", (first + 1).cast("int"), F.lit(size))).select(*keys, idx, "centre", "seq"))


def fixed_sequences(df: DataFrame, keys: list[str], idx: str, cols: list[str], size: int) -> DataFrame:
    """Consecutive sequences without overlap; a short last one is dropped."""
    item = F.struct(F.col(idx), *[F.col(c) for c in cols])
    out = df.groupBy(*keys, chunk_of(idx, size).alias("seq_id")).agg(F.sort_array(F.collect_list(item)).alias("seq"))
    return out.where(F.size("seq") == size)


def overlapping_sequences(df: DataFrame, keys: list[str], idx: str, cols: list[str], size: int, batch: int,
                          chunk: int = CHUNK) -> DataFrame:
    """A sequence from every start that leaves room for it, numbered in batches."""
    item = F.struct(F.col(idx), *[F.col(c) for c in cols])
    rows, w = halo(df, keys, idx, 0, size - 1, chunk)
    rows = drop_halo(rows.withColumn("seq", F.collect_list(item).over(w.rangeBetween(0, size - 1))))
    return rows.where(F.size("seq") == size).select(
        *keys, F.col(idx).alias("start"), chunk_of(idx, batch).alias("batch"), "seq")


def overlap_add(windows: DataFrame, keys: list[str], n_classes: int) -> DataFrame:
    """Sum of the scores that windows give an epoch, and the best class.

    ``windows`` has ``start`` and ``scores``, an array of score vectors.
    """
    rows = windows.select(*keys, "start", F.posexplode("scores").alias("_pos", "_s"))
    out = rows.groupBy(*keys, (F.col("start") + F.col("_pos")).alias("epoch_idx")).agg(
        F.array(*[F.sum(F.col("_s")[c]) for c in range(n_classes)]).alias("scores"), F.count(F.lit(1)).alias("n_windows"))
    return out.withColumn("pred", argmax("scores"))


def smooth_labels(df: DataFrame, keys: list[str], idx: str, label: str, kernel: list[float], n_classes: int,
                  chunk: int = CHUNK) -> DataFrame:
    """One-hot labels convolved with ``kernel``; the borders are mirrored."""
    half = (len(kernel) - 1) // 2
    n = summarise(df, keys, idx, _n=F.max(idx) + 1)
    rows, w = halo(attach(df, n, keys, idx, chunk), keys, idx, len(kernel), len(kernel), chunk)
    near = F.map_from_entries(F.collect_list(F.struct(F.col(idx), F.col(label))).over(
        w.rangeBetween(-len(kernel), len(kernel))))
    rows = drop_halo(rows.withColumn("_near", near))

    def at(offset):
        j = F.pmod(F.col(idx) + offset, 2 * F.col("_n"))
        return F.try_element_at("_near", F.when(j >= F.col("_n"), 2 * F.col("_n") - 1 - j).otherwise(j))

    labels = [(h, at(half - k)) for k, h in enumerate(kernel)]
    soft = [sum((F.when(x == c, F.lit(h)).otherwise(0.0) for h, x in labels[1:]),
                F.when(labels[0][1] == c, F.lit(labels[0][0])).otherwise(0.0)) for c in range(n_classes)]
    return rows.withColumn("soft", F.array(*soft)).drop("_near", "_n")


def study_ends(df: DataFrame, order: str, margin: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Epochs per study and where each study ends when all are put end to end."""
    per = df.groupBy(order).agg((F.count(F.lit(1)) - 2 * margin).alias("n_epochs"))
    per = per.withColumn("n_epochs", F.greatest("n_epochs", F.lit(0)))
    return scan(per, [], [order], chunk_of(order, chunk), end=("sum", "n_epochs"))


def global_batches(df: DataFrame, study: str, idx: str, margin: int, batch: int, chunk: int = CHUNK) -> DataFrame:
    """Global position and batch of each epoch that is a margin from both borders."""
    ends = study_ends(df, study, margin, chunk).withColumn("_n", F.col("n_epochs"))
    out = attach(df.select(study, idx), ends, [study], idx, chunk)
    pos = F.col("end") - F.col("_n") + F.col(idx) - margin
    return (out.where((F.col(idx) >= margin) & (F.col(idx) < margin + F.col("_n")))
            .select(study, idx, pos.alias("position"), chunk_of(pos, batch).alias("batch")))
