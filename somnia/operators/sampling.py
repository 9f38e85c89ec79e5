"""Draws, splits and augmentations that come out the same on every run.

Random numbers are hashes of a row's key and a seed, never ``rand()``, whose
values depend on how rows are partitioned.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from .order import chronological
from .ordered import CHUNK, chunk_of, ordinal, scan

TOP = 4  # hex digits that bucket a hash


def hash_key(seed, *cols) -> Column:
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string") for c in cols]))


def uniform(seed, *cols) -> Column:
    """Number in [0, 1) from 48 bits of the hash."""
    return F.conv(F.substring(hash_key(seed, *cols), 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def normal(seed, *cols) -> Column:
    """Standard normal draw per row; a fast hash, since it is drawn per sample."""
    u = lambda k: (F.pmod(F.xxhash64(F.lit(f"{seed}{k}"), *[F.col(c) for c in cols]), F.lit(1 << 40)) + 0.5) / float(1 << 40)
    return F.sqrt(-2 * F.ln(u("a"))) * F.cos(2 * math.pi * u("b"))


def bucket(h) -> Column:
    return F.conv(F.substring(h, 1, TOP), 16, 10).cast("long")


def take_random(df: DataFrame, keys: list[str], n: int, id_cols: list[str], seed: int = 0,
                require: bool = False) -> DataFrame:
    """``n`` rows of each group without replacement, with their rank from 0.

    A histogram over hash buckets, combined map-side, finds how far into the
    hash range each group must read; only those rows are shuffled and ranked.
    ``require`` raises if a group has fewer than ``n``.
    """
    rows = df.withColumn("_h", hash_key(seed, *id_cols)).withColumn("_b", bucket("_h"))
    hist = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    past = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    hist = hist.withColumns({"_before": F.coalesce(F.sum("_n").over(past), F.lit(0)),
                             "_total": F.sum("_n").over(Window.partitionBy(*keys))})
    if require:
        hist = hist.withColumn("_before", F.when(F.col("_total") < n, F.raise_error(
            F.lit(f"a group has fewer than {n} rows")).cast("long")).otherwise(F.col("_before")))
    cut = hist.where(F.col("_before") < n).select(*keys, "_b", "_before")
    near = rows.join(cut, [*keys, "_b"])
    rank = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("_h", *id_cols)) - 1 + F.col("_before")
    return near.withColumn("rank", rank).where(F.col("rank") < n).select(*df.columns, "rank")


def repeat_rows(df: DataFrame, times: int) -> DataFrame:
    return df.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(times))))


def shuffle(df: DataFrame, id_cols: list[str], seed: int = 0, position: str | None = None) -> DataFrame:
    """Rows in a random order that the seed fixes; all columns move together. ``position`` keeps the order as a column."""
    return chronological(df.withColumn("_h", hash_key(seed, *id_cols)), ["_h", *id_cols], position).drop("_h")


def class_probabilities(weights: list[float], n_classes: int) -> list[float]:
    if len(weights) != n_classes:
        raise ValueError(f"{len(weights)} probabilities for {n_classes} classes")
    total = float(sum(weights))
    return [w / total for w in weights]


def draw_balanced(epochs: DataFrame, draws: DataFrame, probs: list[float], margin: int = 0, seed: int = 0,
                  chunk: int = CHUNK) -> DataFrame:
    """Per draw: a class by probability, a study that has it, one of its epochs.

    ``epochs`` has ``study_id``, ``epoch_idx`` and ``stage``; ``draws`` has a key
    column ``draw``. Only studies that have the class can be drawn, which is
    what repeated tries come to. Choices are equality joins on positions, and
    the centre then moves up to ``margin`` epochs. A class that no epoch has
    gives no row.
    """
    per = epochs.groupBy("stage", "study_id").agg(F.count(F.lit(1)).alias("_n"))
    studies = scan(per, ["stage"], ["study_id"], chunk_of("study_id", chunk), _ord=("count",))
    n_studies = per.groupBy("stage").agg(F.count(F.lit(1)).alias("_studies"))
    placed = ordinal(epochs, ["stage", "study_id"], "epoch_idx", "_pos", chunk)
    u = uniform(f"{seed}c", "draw")
    edge, cls = 0.0, F.lit(len(probs) - 1)
    steps = []
    for c, p in enumerate(probs[:-1]):
        edge += p
        steps.append((c, edge))
    for c, e in reversed(steps):
        cls = F.when(u < e, F.lit(c)).otherwise(cls)
    d = draws.select("draw").withColumn("stage", cls).join(n_studies, "stage")
    d = d.withColumn("_ord", F.floor(uniform(f"{seed}s", "draw") * F.col("_studies")) + 1)
    d = d.join(studies, ["stage", "_ord"])
    d = d.withColumn("_pos", F.floor(uniform(f"{seed}e", "draw") * F.col("_n")))
    d = d.join(placed.select("stage", "study_id", "_pos", "epoch_idx"), ["stage", "study_id", "_pos"])
    moved = F.col("epoch_idx") + F.floor(uniform(f"{seed}m", "draw") * (2 * margin + 1)) - margin
    return d.select("draw", "stage", "study_id", "epoch_idx", moved.cast("long").alias("centre"))


def draw_uniform(epochs: DataFrame, draws: DataFrame, seed: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Per draw: a study, then one of its epochs, each alike likely."""
    per = epochs.groupBy("study_id").agg(F.count(F.lit(1)).alias("_n"))
    studies = scan(per, [], ["study_id"], chunk_of("study_id", chunk), _ord=("count",))
    placed = ordinal(epochs.select("study_id", "epoch_idx"), ["study_id"], "epoch_idx", "_pos", chunk)
    d = draws.select("draw").withColumn("_studies", per.agg(F.count(F.lit(1)).alias("n")).scalar())
    d = d.withColumn("_ord", F.floor(uniform(f"{seed}s", "draw") * F.col("_studies")) + 1).join(studies, "_ord")
    d = d.withColumn("_pos", F.floor(uniform(f"{seed}e", "draw") * F.col("_n")))
    return d.join(placed, ["study_id", "_pos"]).select("draw", "study_id", "epoch_idx")


def dataset_mix(sizes: DataFrame, alpha: float) -> DataFrame:
    """Probability of each dataset between its share of studies and an equal share."""
    total = sizes.agg(F.struct(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k")).alias("s"))
    out = sizes.withColumn("_s", total.scalar())
    prob = F.col("n") / F.col("_s.n") * (1 - alpha) + F.lit(alpha) / F.col("_s.k")
    return out.withColumn("prob", prob).drop("_s")


def samples_per_pass(n_epochs: DataFrame, cap: int, margin: int) -> DataFrame:
    """Sequences per pass from a one-row count: the lesser of all and the cap, by length."""
    return n_epochs.select(F.floor(F.least(F.col("n"), F.lit(cap)) / (2 * margin + 1)).alias("n_samples"))


def _array_split(rank: Column, n: Column, k: int) -> Column:
    """Part of ``k`` nearly equal parts; the first ``n % k`` have one more."""
    size, extra = F.floor(n / k), n % k
    head = extra * (size + 1)
    return F.when(rank < head, F.floor(rank / (size + 1))).otherwise(
        extra + F.floor((rank - head) / F.greatest(size, F.lit(1)))).cast("int")


def split_sizes(n: Column, k: int, test_fraction: float, val_fraction: float, max_test: int | None = None,
                max_val: int | None = None) -> tuple[Column, Column]:
    test = F.ceil(n / k) if k > 1 else F.ceil(n * test_fraction)
    val = F.ceil(n * F.lit(val_fraction))
    test = F.least(test, F.lit(max_test)) if max_test else test
    val = F.least(val, F.lit(max_val)) if max_val else val
    val = F.when(val + test >= n, F.raise_error(F.lit("no training subjects left")).cast("long")).otherwise(val)
    return test, val


def split_subjects(subjects: DataFrame, subject: str, k: int, val_fraction: float = 0.2,
                   test_fraction: float = 0.2, max_test: int | None = None, max_val: int | None = None,
                   seed: int = 0) -> DataFrame:
    """``split``, ``subject`` and ``part`` for ``k`` folds, or one fixed split if ``k`` is 1.

    A subject is never in two parts of a split. Ranks are two-level counts over
    hash buckets, so no task sorts all subjects.
    """
    base = subjects.select(subject).distinct()
    n = base.agg(F.count(F.lit(1)).alias("n"))
    h = base.withColumn("_h", hash_key(f"{seed}t", subject))
    ranked = scan(h, [], ["_h", subject], bucket("_h"), _r=("count",)).withColumn("_r", F.col("_r") - 1)
    ranked = ranked.withColumn("_n", n.scalar())
    n_test, n_val = split_sizes(F.col("_n"), k, test_fraction, val_fraction, max_test, max_val)
    fold = _array_split(F.col("_r"), F.col("_n"), k) if k > 1 else F.when(F.col("_r") < n_test, 0).otherwise(-1)
    rows = ranked.withColumns({"_fold": fold, "_val": n_val}).withColumn(
        "split", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    rows = rows.withColumns({"_test": F.col("_fold") == F.col("split"), "_h": hash_key(f"{seed}v", "split", subject)})
    rest = rows.withColumn("_rest", (~F.col("_test")).cast("long"))
    rest = scan(rest, ["split"], ["_h", subject], bucket("_h"), _v=("sum", "_rest"))
    part = (F.when(F.col("_test"), F.lit("test")).when(F.col("_v") <= F.col("_val"), F.lit("val")).otherwise(F.lit("train")))
    return rest.select("split", subject, part.alias("part"))


def split_counts(splits: DataFrame, records: DataFrame, subject: str) -> DataFrame:
    """Records and subjects per part of each split, and in total."""
    per = records.groupBy(subject).agg(F.count(F.lit(1)).alias("_n"))
    return (splits.join(per, subject).rollup("split", "part")
            .agg(F.sum("_n").alias("records"), F.count(F.lit(1)).alias("subjects"))
            .where(F.col("split").isNotNull())
            .select("split", F.coalesce("part", F.lit("total")).alias("part"), "records", "subjects"))


def augment_flag(prob: float, seed, *keys) -> Column:
    """Whether an augmentation applies to a sequence."""
    return uniform(seed, *keys) <= prob


def weigh(flag: Column, weight, aug_weight: float = 0.5) -> Column:
    return F.when(flag, F.col(weight) * aug_weight).otherwise(F.col(weight))


def region(length: int, lo: float, hi: float, seed, *keys, log: bool = True) -> tuple[Column, Column]:
    """Start and length of a region; it wraps around the end of the sequence."""
    u = uniform(f"{seed}l", *keys)
    if log:
        frac = F.pow(F.lit(10.0), F.lit(math.log10(lo)) + u * (math.log10(hi) - math.log10(lo)))
        n = F.floor(frac * length)
    else:
        a, b = int(lo * length), int(hi * length)
        n = F.floor(a + u * (b - a))
    return F.floor(uniform(f"{seed}p", *keys) * length).cast("int"), n.cast("int")


def in_region(pos, start, n, length: int) -> Column:
    return F.pmod(pos - start, F.lit(length)) < n


def amplitude(signal, factor: Column) -> Column:
    return F.transform(signal, lambda x: x * factor)


def shift(signal, amount: Column) -> Column:
    return F.transform(signal, lambda x: x + amount)


def sign_flip(signal, start: Column, n: Column, length: int) -> Column:
    return F.transform(signal, lambda x, i: F.when(in_region(i, start, n, length), -x).otherwise(x))


def signal_mix(signal, start: Column, take: Column, n: Column, length: int) -> Column:
    """Region becomes the mean of itself and an equally long region from ``take``."""
    def at(i):
        other = F.element_at(signal, (F.pmod(take + F.pmod(i - start, F.lit(length)), F.lit(length)) + 1).cast("int"))
        own = F.element_at(signal, (i + 1).cast("int"))
        return F.when(in_region(i, start, n, length), (own + other) / 2).otherwise(own)
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)


def gaussian_noise(signal, sigma: float, mean: float, seed, *keys) -> Column:
    """A normal draw added to each element."""
    k = [F.col(c) for c in keys]
    return F.transform(signal, lambda x, i: x + mean + sigma * _draw(seed, k, i))


def _draw(seed, keys, i):
    """Standard normal draw per element, from both halves of one hash."""
    h = hash_key(seed, *keys, i)
    u = lambda at: (F.conv(F.substring(h, at, 12), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 48))
    return F.sqrt(-2 * F.ln(u(1))) * F.cos(2 * math.pi * u(13))


def regional_noise(signal, start, n, length: int, sigma: float, seed, *keys, mean: float = 0.0) -> Column:
    k = [F.col(c) for c in keys]
    return F.transform(signal, lambda x, i: F.when(
        in_region(i, start, n, length), x + mean + sigma * _draw(seed, k, i)).otherwise(x))


def _mean(signal):
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x) / F.size(signal)


def erase(signal, start, n, length: int, seed, *keys, mean: Column | None = None) -> Column:
    """Region becomes faint noise around the mean of the whole sequence."""
    k, mu = [F.col(c) for c in keys], _mean(signal) if mean is None else mean
    return F.transform(signal, lambda x, i: F.when(in_region(i, start, n, length), mu + 0.01 * _draw(seed, k, i)).otherwise(x))


def drop_channels(channels: dict[str, str], fraction: float, seed, *keys) -> dict[str, Column]:
    """Replace random channels by faint noise around their mean, at least one."""
    n = max(int(len(channels) * fraction), 1)
    if n >= len(channels):
        raise ValueError(f"cannot drop {n} of {len(channels)} channels")
    k = [F.col(c) for c in keys]
    marks = {c: F.struct(hash_key(f"{seed}d", F.lit(c), *keys).alias("h"), F.lit(c).alias("c")) for c in channels}
    order = F.slice(F.array_sort(F.array(*marks.values())), 1, n)
    out = {}
    for c in channels:
        dropped = F.exists(order, lambda m: m["c"] == c)
        mu = _mean(F.col(c))
        out[c] = F.when(dropped, F.transform(c, lambda x, i: mu + 0.01 * _draw(f"{seed}{c}", k, i))).otherwise(F.col(c))
    return out
