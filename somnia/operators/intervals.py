"""Runs, intervals, and points inside intervals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .ordered import CHUNK, attach, drop_halo, halo, scan


def runs(df: DataFrame, keys: list[str], idx: str, flag: Column,
         chunk: int = CHUNK) -> DataFrame:
    """Runs of true as ``(start, end)``, both ends inside the run.

    ``idx`` is dense. Only run borders reach the second, unbounded step.
    """
    rows, w = halo(df.withColumn("_flag", F.coalesce(flag, F.lit(False))), keys, idx, 1, 1, chunk)
    before = F.coalesce(F.lag("_flag").over(w), F.lit(False))
    after = F.coalesce(F.lead("_flag").over(w), F.lit(False))
    rows = rows.withColumns({"_first": F.col("_flag") & ~before, "_last": F.col("_flag") & ~after})
    borders = drop_halo(rows, True).where("_first OR _last").select(
        *keys, "_chunk", F.col(idx).alias("_i"), "_first", "_last")
    out = scan(borders, keys, ["_i"], F.col("_chunk"), _next=("lead", "_i"))
    return out.where("_first").select(
        *keys, F.col("_i").alias("start"), F.when(F.col("_last"), F.col("_i")).otherwise(F.col("_next")).alias("end"))


def merge_intervals(df: DataFrame, keys: list[str], start: str = "start", end: str = "end",
                    epsilon: float = 0.0, strict: bool = False, span: float = float(CHUNK)) -> DataFrame:
    """Merge intervals whose gap is at most ``epsilon`` (less, if ``strict``).

    Nested intervals are covered: the gap is taken to the furthest end so far.
    ``span`` is the width of the start range one task works on.
    """
    bucket = F.floor(F.col(start) / F.lit(span)).cast("long")
    apart = lambda reach: reach.isNull() | (F.col(start) - reach >= epsilon if strict else F.col(start) - reach > epsilon)
    here = Window.partitionBy(*keys, "_chunk").orderBy(start, end)
    reach = F.max(end).over(here.rowsBetween(Window.unboundedPreceding, -1))
    rows = df.select(*keys, start, end, bucket.alias("_chunk")).withColumn("_new", apart(reach).cast("long"))
    rows = rows.withColumn("_island", F.sum("_new").over(here.rowsBetween(Window.unboundedPreceding, 0)))
    islands = rows.groupBy(*keys, "_chunk", "_island").agg(F.min(start).alias(start), F.max(end).alias(end))
    # One row per chunk carries both: how far earlier chunks reach, and where the island that reaches so far begins. A
    # chunk's last island is the only one of its islands that can go on, and it is new if it is apart from that reach.
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    chunks = islands.groupBy(*keys, "_chunk").agg(F.max(end).alias("_top"), F.max(start).alias(start))
    chunks = chunks.withColumn("_reach", F.max("_top").over(before))
    chunks = chunks.withColumn("_root", F.max(F.when(apart(F.col("_reach")), F.col(start))).over(before))
    joined = islands.join(chunks.select(*keys, "_chunk", "_reach", "_root"), [*keys, "_chunk"], "left")
    first = F.when(apart(F.col("_reach")), F.col(start)).otherwise(F.col("_root"))
    return joined.groupBy(*keys, first.alias("_begin")).agg(F.min(start).alias("start"), F.max(end).alias("end")).drop("_begin")


def pad(df: DataFrame, width: float) -> DataFrame:
    return df.withColumns({"start": F.col("start") - width, "end": F.col("end") + width})


def _binned(intervals: DataFrame, start: str, end: str, width: float) -> DataFrame:
    return intervals.withColumn("_bin", F.explode(F.sequence(
        F.floor(F.col(start) / F.lit(width)).cast("long"), F.floor(F.col(end) / F.lit(width)).cast("long"))))


def label_points(points: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                 value: str = "stage", width: float = 3600.0, overlapping: bool = False) -> DataFrame:
    """Value of the interval ``[onset, onset + duration)`` that holds each point.

    Intervals with a NULL value are skipped. Both sides are cut into time bins,
    so the join is an equality on (keys, bin): a long recording spreads over
    many tasks, and a bin holds what its width can hold.

    A scoring has one interval at a time, so each point meets at most one. For
    ``overlapping`` annotations the one that starts last wins, the larger value
    on a tie. Of the intervals that span a whole bin only the winner is kept
    before points are joined.
    """
    right = (intervals.where(F.col(value).isNotNull())
             .withColumn("_to", F.col("onset") + F.col("duration")))
    right = _binned(right, "onset", "_to", width).select(
        *keys, "_bin", F.col("onset").alias("_from"), "_to", F.col(value).alias("_v"))
    if not overlapping:
        return _inside(points, right, keys, time, width, closed=False).select(*points.columns, F.col("_v").alias(value))
    spans = (F.col("_from") <= F.col("_bin") * width) & (F.col("_to") >= (F.col("_bin") + 1) * width)
    best = right.where(spans).groupBy(*keys, "_bin").agg(
        F.max(F.struct("_from", "_v", "_to")).alias("_m")).select(*keys, "_bin", "_m._from", "_m._to", "_m._v")
    right = right.where(~spans).unionByName(best)
    hit = _inside(points, right, keys, time, width, closed=False)
    return hit.groupBy(*points.columns).agg(F.max_by("_v", F.struct("_from", "_v")).alias(value))


def _inside(points, right, keys, time, width, closed):
    """Points with the interval around them, by equality on (keys, bin) and bounds."""
    right = right.select(*[F.col(k).alias(f"_r_{k}") for k in [*keys, "_bin"]],
                         *[c for c in right.columns if c not in (*keys, "_bin")])
    left = points.withColumn("_bin", F.floor(F.col(time) / F.lit(width)).cast("long"))
    cond = [F.col(k) == F.col(f"_r_{k}") for k in [*keys, "_bin"]]
    upper = F.col(time) <= F.col("_to") if closed else F.col(time) < F.col("_to")
    return left.join(right, [*cond, F.col(time) >= F.col("_from"), upper], "left")


def in_intervals(points: DataFrame, intervals: DataFrame, keys: list[str], time: str,
                 name: str = "inside", width: float = 3600.0) -> DataFrame:
    """Whether each point lies in a closed interval; intervals are disjoint.

    ``merge_intervals`` makes any set of intervals disjoint first.
    """
    right = _binned(intervals, "start", "end", width).select(
        *keys, "_bin", F.col("start").alias("_from"), F.col("end").alias("_to"))
    hit = _inside(points, right, keys, time, width, closed=True)
    return hit.select(*points.columns, F.col("_from").isNotNull().alias(name))


def encode_runs(df: DataFrame, keys: list[str], idx: str, label: str, period: int = 1,
                chunk: int = CHUNK) -> DataFrame:
    """Dense labels to ``(init_sec, dur_sec, label)`` rows."""
    rows, w = halo(df, keys, idx, 1, 0, chunk)
    changed = ~F.col(label).eqNullSafe(F.lag(label).over(w)) | F.lag(idx).over(w).isNull()
    rows = drop_halo(rows.withColumn("_new", changed.cast("long")), True)
    rows = scan(rows.select(*keys, "_chunk", idx, label, "_new"), keys, [idx], F.col("_chunk"), _run=("sum", "_new"))
    return rows.groupBy(*keys, "_run", label).agg(
        (F.min(idx) * period).alias("init_sec"), (F.count(F.lit(1)) * period).alias("dur_sec")).drop("_run")


def expand_runs(df: DataFrame, period: int, init: str = "init_sec", dur: str = "dur_sec",
                name: str = "epoch_idx") -> DataFrame:
    """One row per whole period of each interval; an interval shorter than one gives none."""
    n = F.floor(F.col(dur) / period)
    return (df.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
            .withColumn(name, F.floor(F.col(init) / period) + F.col("_k")).drop("_k", init, dur))


def fill_gaps(df: DataFrame, keys: list[str], fill: str, span: float = float(CHUNK)) -> DataFrame:
    """Add an interval with stage ``fill`` wherever the next one starts late."""
    cols = df.select(*keys, "init_sec", "dur_sec", "stage")
    nxt = scan(cols, keys, ["init_sec", "dur_sec"],
               F.floor(F.col("init_sec") / F.lit(span)).cast("long"), _next=("lead", "init_sec"))
    end = F.col("init_sec") + F.col("dur_sec")
    own = F.struct("init_sec", "dur_sec", "stage")
    gap = F.struct(end.alias("init_sec"), (F.col("_next") - end).alias("dur_sec"), F.lit(fill).alias("stage"))
    both = F.when(F.col("_next") > end, F.array(own, gap)).otherwise(F.array(own))
    return nxt.select(*keys, F.explode(both).alias("_r")).select(*keys, "_r.*")


def remove_offset(df: DataFrame, keys: list[str], init: str = "init_sec", chunk: int = CHUNK) -> DataFrame:
    """Start each recording at 0; ``whole_seconds`` is false where a start is not whole."""
    first = df.groupBy(*keys).agg(F.min(init).alias("_start"))
    out = attach(df, first, keys, init, chunk).withColumn(init, F.col(init) - F.col("_start"))
    return out.withColumn("whole_seconds", F.col(init) == F.floor(init)).drop("_start")


def correct_zero_durations(df: DataFrame, seconds: int) -> DataFrame:
    return df.withColumn("dur_sec", F.when(F.col("dur_sec") == 0, F.lit(seconds)).otherwise(F.col("dur_sec")))


def fixed_events(df: DataFrame, epoch: float) -> DataFrame:
    """Cut each annotation into events of one epoch that fit inside it."""
    n = F.floor(F.col("duration") / epoch).cast("long")
    return (df.where(n > 0).withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
            .withColumn("event_onset", F.col("onset") + F.col("_k") * epoch).drop("_k"))
