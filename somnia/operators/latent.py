"""Latent states: codes, stage shares, entropy, reduction, scoring of new data.

States are few next to epochs, but nothing here assumes a number: tables of
states are ordinary join sides, broadcast by Spark only when their measured size
allows it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from somnia.functions.scalar import log2, ratio
from somnia.schemas import RAT_STAGES

from .model import t_test_p
from .ordered import attach_by_hash, scan
from .quantiles import exact_percentiles

WAKE, NREM, REM = RAT_STAGES["wake"], RAT_STAGES["nrem"], RAT_STAGES["rem"]
SLEEP = {"wake": WAKE, "nrem": NREM, "rem": REM}


def unique_states(df: DataFrame, code: str = "code", prefix_bits: int = 12) -> DataFrame:
    """One row per code: id from 1 in code order, size, first epoch."""
    out = df.groupBy(code).agg(F.count(F.lit(1)).alias("n_epochs"), F.min("epoch_id").alias("first_epoch"))
    bucket = F.conv(F.substring(F.rpad(code, prefix_bits, "0"), 1, prefix_bits), 2, 10).cast("long")
    return scan(out, [], [code], bucket, latent_id=("count",))


def assign_states(df: DataFrame, states: DataFrame, code: str = "code") -> DataFrame:
    return df.join(states.select(code, "latent_id"), code)


def off_units(states: DataFrame, n_bits: int, code: str = "code") -> DataFrame:
    """Per unit, in how many states it is on, and whether it never is."""
    sums = states.agg(*[F.sum(F.substring(code, b + 1, 1).cast("long")).alias(f"b{b}") for b in range(n_bits)])
    rows = F.array(*[F.struct(F.lit(b).alias("unit"), F.col(f"b{b}").alias("n_on")) for b in range(n_bits)])
    return sums.select(F.explode(rows).alias("r")).select("r.*").withColumn("always_off", F.col("n_on") == 0)


def stage_shares(df: DataFrame, stages: dict[str, int] = SLEEP, state: str = "latent_id",
                 stage: str = "stage", digits: int | None = None) -> DataFrame:
    """Share of each named stage in a state; all its epochs count below the line."""
    share = lambda v: F.sum(F.when(F.col(stage) == v, 1).otherwise(0)) / F.count(F.lit(1))
    out = df.groupBy(state).agg(F.count(F.lit(1)).alias("n_epochs"), *[share(v).alias(f"p_{k}") for k, v in stages.items()])
    if digits is None:
        return out
    return out.withColumns({f"p_{k}": F.round(f"p_{k}", digits) for k in stages})


def majority_stage(shares: DataFrame) -> Column:
    """Largest of three shares at three decimals; wake before NREM before REM on ties."""
    w, n, r = (F.round(c, 3) for c in ("p_wake", "p_nrem", "p_rem"))
    return (F.when((w >= n) & (w >= r), F.lit(WAKE)).when((n >= r) & (n >= w), F.lit(NREM)).otherwise(F.lit(REM)))


def fit_state_stages(df: DataFrame) -> DataFrame:
    """Training table: majority stage and shares per code.

    ``code`` may be a shortened key that several states share; the state with
    the highest id then gives the stage, as the last one seen does in a loop.
    """
    per = df.groupBy("code", "latent_id").agg(
        F.count(F.lit(1)).alias("n_epochs"),
        *[(F.sum(F.when(F.col("stage") == v, 1).otherwise(0)) / F.count(F.lit(1))).alias(f"p_{k}") for k, v in SLEEP.items()])
    per = per.withColumn("stage", majority_stage(per))
    last = F.max_by(F.struct("stage", "p_wake", "p_nrem", "p_rem"), "latent_id")
    return per.groupBy("code").agg(last.alias("_m")).select("code", "_m.*")


def score_states(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Stage of each epoch by its code; -1 for codes training never saw."""
    m = fitted.select("code", F.col("stage").alias("pred"))
    return df.join(m, "code", "left").withColumn("pred", F.coalesce("pred", F.lit(-1)))


def hypnodensity(df: DataFrame, fitted: DataFrame) -> DataFrame:
    """Wake, NREM and REM share of each epoch's state; NULL for unseen codes."""
    return df.join(fitted.select("code", "p_wake", "p_nrem", "p_rem"), "code", "left")


def new_states(test: DataFrame, train: DataFrame) -> DataFrame:
    return test.select("code").distinct().join(train.select("code").distinct(), "code", "left_anti")


def state_stage_counts(df: DataFrame, stages: list[int], min_size: int = 0) -> DataFrame:
    """Epochs per state and listed stage, for states with more than ``min_size`` epochs.

    A state's size counts all its epochs. Both come from one aggregate.
    """
    per = df.groupBy("latent_id", "stage").agg(F.count(F.lit(1)).alias("n"))
    size = F.sum("n").over(Window.partitionBy("latent_id"))
    return per.withColumn("_size", size).where((F.col("_size") > min_size) & F.col("stage").isin(stages)).drop("_size")


def share_of_stage(counts: DataFrame) -> DataFrame:
    """``p(state | stage)``."""
    w = Window.partitionBy("stage")
    return counts.withColumn("p", F.col("n") / F.sum("n").over(w))


def state_entropy(shares: DataFrame, names: list[str]) -> DataFrame:
    """Entropy in bits of the stage shares of each state."""
    terms = [F.when(F.col(c) > 0, -F.col(c) * log2(F.col(c))).otherwise(0.0) for c in names]
    return shares.withColumn("entropy", sum(terms[1:], terms[0]))


def mutual_information(counts: DataFrame) -> DataFrame:
    """Per stage: entropy term, information that states carry on it, and their ratio.

    With N all epochs, the information of stage j is
    ``(sum_i n_ij log2(n_ij / (n_i n_j)) + n_j log2 N) / N``: marginals are
    windows over the counts and N is the sum of a few stage rows, so the epochs
    behind the counts are read once.
    """
    n = F.col("n").cast("double")
    rows = counts.where("n > 0").withColumns({
        "_i": F.sum(n).over(Window.partitionBy("latent_id")), "_j": F.sum(n).over(Window.partitionBy("stage"))})
    per = rows.groupBy("stage").agg(F.sum(n * log2(n / (F.col("_i") * F.col("_j")))).alias("_a"), F.sum(n).alias("_n"))
    per = per.withColumn("_t", F.sum("_n").over(Window.partitionBy()))  # one row per stage
    p = F.col("_n") / F.col("_t")
    out = per.select("stage", ((F.col("_a") + F.col("_n") * log2(F.col("_t"))) / F.col("_t")).alias("mi"),
                     (-p * log2(p)).alias("entropy"))
    return out.withColumn("ratio", ratio(F.col("mi"), F.col("entropy")))


def stage_entropy(counts: DataFrame) -> DataFrame:
    """Entropy term of each stage; their sum is the entropy of the stages."""
    return mutual_information(counts).select("stage", "entropy")


def total_information(counts: DataFrame) -> DataFrame:
    return mutual_information(counts).agg(F.sum("mi").alias("mi"), F.sum("entropy").alias("entropy")).withColumn(
        "ratio", ratio(F.col("mi"), F.col("entropy")))


def state_covariance(df: DataFrame, features: list[str], state: str = "latent_id") -> DataFrame:
    """Mean and sample covariance per state for each pair of features, in one pass."""
    pairs = [(a, b) for i, a in enumerate(features) for b in features[i:]]
    out = df.groupBy(state).agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(features)],
                                *[F.covar_samp(a, b).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    at = {f: i for i, f in enumerate(features)}
    rows = F.array(*[F.struct(F.lit(a).alias("f1"), F.lit(b).alias("f2"), F.col(f"m{at[a]}").alias("mean1"),
                              F.col(f"m{at[b]}").alias("mean2"), F.col(f"c{i}").alias("cov"))
                     for i, (a, b) in enumerate(pairs)])
    return out.select(state, F.explode(rows).alias("r")).select(state, "r.*")


def state_means(df: DataFrame, features: list[str], state: str = "latent_id") -> DataFrame:
    return df.groupBy(state).agg(F.count(F.lit(1)).alias("n_epochs"), *[F.avg(f).alias(f) for f in features])


def state_boxes(df: DataFrame, keys: list[str], value: str, by: list[str] = ()) -> DataFrame:
    """Quartiles, and the furthest values within 1.5 inter-quartile ranges of them.

    ``by`` names what tells rows apart, so that a large state is spread whatever its values; without it all columns do.
    """
    q = exact_percentiles(df, keys, value, {"q1": 0.25, "median": 0.5, "q3": 0.75})
    iqr = F.col("q3") - F.col("q1")
    inside = F.col(value).between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    x = F.when(inside, F.col(value))
    cols = list(by) or df.columns
    rows = attach_by_hash(df.select(*dict.fromkeys([*keys, value, *cols])), q, keys, cols)
    return rows.groupBy(*keys).agg(*[F.first(c).alias(c) for c in ("q1", "median", "q3")],
                                   F.min(x).alias("whisker_low"), F.max(x).alias("whisker_high"))


def state_histogram(df: DataFrame, threshold: int, norm: str = "L2") -> DataFrame:
    """Share of each state overall, per group and per subject.

    ``L2`` divides by the root of the sum of squares over the kept states;
    ``length`` by all epochs of the scope, those of dropped states included.
    """
    spread = F.explode(F.array(
        F.struct(F.lit("all").alias("scope"), F.lit(None).cast("long").alias("key")),
        F.struct(F.lit("group").alias("scope"), F.col("grp").cast("long").alias("key")),
        F.struct(F.lit("subject").alias("scope"), F.col("subject").cast("long").alias("key"))))
    # Three scopes of (subject, state) counts, not of epochs.
    base = df.groupBy("grp", "subject", "latent_id").agg(F.count(F.lit(1)).alias("n"))
    per = (base.withColumn("_s", spread).select("_s.*", "latent_id", "n")
           .groupBy("scope", "key", "latent_id").agg(F.sum("n").alias("n")))
    scope = Window.partitionBy("scope", "key")
    per = per.withColumn("_all", F.sum("n").over(scope))
    # The overall count of a state is the row of scope "all".
    size = F.max(F.when(F.col("scope") == "all", F.col("n"))).over(Window.partitionBy("latent_id"))
    kept = per.withColumn("_size", size).where(F.col("_size") > threshold)
    if norm == "L2":
        share = F.col("n") / F.sqrt(F.sum(F.col("n").cast("double") * F.col("n")).over(scope))
    else:
        share = F.col("n") / F.col("_all")
    return kept.select("scope", "key", "latent_id", "n", share.alias("share"))


def subject_matrix(df: DataFrame, states: list) -> DataFrame:
    """Epochs of each subject in each of the listed states."""
    return df.groupBy("subject").agg(*[
        F.sum(F.when(F.col("latent_id") == s, 1).otherwise(0)).alias(f"s_{s}") for s in states])


def group_t_tests(df: DataFrame, square: bool = False) -> DataFrame:
    """Equal-variance t statistic between two groups of subjects, per state.

    A subject without epochs in a state counts as 0. Groups are one digit, so a
    state has at most 45 pairs; sums come from one aggregate. ``square`` gives
    the whole matrix: a pair both ways round with the statistic of the smaller
    group against the larger, and each group against itself with 0.
    """
    digits = range(10)
    per = df.groupBy("latent_id", "grp", "subject").agg(F.count(F.lit(1)).cast("double").alias("x"))
    subjects = df.select("grp", "subject").distinct().groupBy().agg(
        F.array(*[F.sum(F.when(F.col("grp") == g, 1.0).otherwise(0.0)) for g in digits]).alias("n"))
    pick = lambda x: F.array(*[F.sum(F.when(F.col("grp") == g, x).otherwise(0.0)) for g in digits])
    sums = per.groupBy("latent_id").agg(pick(F.col("x")).alias("s"), pick(F.col("x") * F.col("x")).alias("q"))
    pairs = F.explode(F.array(*[F.struct(F.lit(i).alias("g1"), F.lit(j).alias("g2"))
                                for i in digits for j in digits if square or i < j]))
    rows = sums.withColumn("n", subjects.scalar()).withColumn("_p", pairs).select("*", "_p.g1", "_p.g2")
    at = lambda arr, g: F.get(arr, g)
    lo, hi = F.least("g1", "g2"), F.greatest("g1", "g2")
    n1, n2 = at("n", lo), at("n", hi)
    m1, m2 = ratio(at("s", lo), n1), ratio(at("s", hi), n2)
    within = (at("q", lo) - n1 * m1 * m1) + (at("q", hi) - n2 * m2 * m2)
    dof = n1 + n2 - 2
    pooled = F.when(dof > 0, within / F.nullif(dof, F.lit(0.0)))
    # Sums of squares of equal values leave rounding dust instead of 0.
    t = F.when(within > 1e-12 * (at("q", lo) + at("q", hi)), (m1 - m2) / F.sqrt(pooled * (1 / F.nullif(n1, F.lit(0.0)) + 1 / F.nullif(n2, F.lit(0.0)))))
    t = F.when(F.col("g1") == F.col("g2"), F.lit(0.0)).otherwise(t) if square else t
    return rows.where((n1 > 0) & (n2 > 0)).select("latent_id", "g1", "g2", t.alias("t"), dof.alias("dof"))


def group_test_matrix(df: DataFrame) -> DataFrame:
    """The square matrices of t and p per state; p is 1 on the diagonal."""
    tests = t_test_p(group_t_tests(df, square=True))
    return tests.withColumn("p", F.when(F.col("g1") == F.col("g2"), F.lit(1.0)).otherwise(F.col("p")))


# Least share of a stage's epochs that makes one of its states large.
LARGE_SHARE = {WAKE: 0.20, NREM: 0.07, REM: 0.10}


def mark_large(states: DataFrame, shares: dict[int, float] = LARGE_SHARE) -> DataFrame:
    """``large`` for states with at least the given share of their stage's epochs."""
    need = F.lit(None).cast("double")
    for stage, share in shares.items():
        need = F.when(F.col("stage") == stage, F.lit(share)).otherwise(need)
    total = F.sum("n_epochs").over(Window.partitionBy("stage"))
    return states.withColumn("large", F.col("n_epochs") >= need * total)


def nearest_large(states: DataFrame, features: list[str]) -> DataFrame:
    """Map each small state to the nearest large state of its stage.

    ``states`` has ``stage``, ``large`` and mean features. A stage has at most
    ``1 / share`` large states (14 at the fixed shares), so they are carried as
    one short array per stage and no pairs are written out. The lowest id wins
    ties; a stage without a large state maps its states to themselves.
    """
    point = F.array(*[F.col(f) for f in features])
    large = states.where("large").groupBy("stage").agg(
        F.collect_list(F.struct(F.col("latent_id").alias("id"), point.alias("at"))).alias("_large"))
    dist = lambda s: F.aggregate(F.zip_with(s["at"], point, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda u, v: u + v)
    near = F.array_min(F.transform("_large", lambda s: F.struct(F.sqrt(dist(s)).alias("d"), s["id"].alias("id"))))
    target = F.when(F.col("large"), F.col("latent_id")).otherwise(F.coalesce(near["id"], F.col("latent_id")))
    return states.join(large, "stage", "left").withColumn("target", target).drop("_large")


def relabel(df: DataFrame, mapping: DataFrame) -> DataFrame:
    m = mapping.select("latent_id", "target")
    return df.join(m, "latent_id", "left").withColumn("latent_id", F.coalesce("target", "latent_id")).drop("target")


def grouping_sizes(mapping: DataFrame) -> DataFrame:
    """Per reduced state, how many states and epochs went into it."""
    return mapping.groupBy("target").agg(F.count(F.lit(1)).alias("n_states"), F.sum("n_epochs").alias("n_epochs"))


def transitions(df: DataFrame, keys: list[str], idx: str = "epoch_id", state: str = "latent_id",
                chunk: int = 1 << 16, by: list[str] = ()) -> DataFrame:
    """Counts of state changes between epochs with adjacent ids.

    ``keys`` bound a recording or trial, so no change crosses its border;
    ``by`` keeps a table per group.
    """
    from .ordered import drop_halo, halo
    rows, w = halo(df, keys, idx, 0, 1, chunk)
    rows = rows.withColumns({"_next": F.lead(state).over(w), "_gap": F.lead(idx).over(w) - F.col(idx)})
    return (drop_halo(rows).where("_gap = 1").groupBy(*by, F.col(state).alias("src"), F.col("_next").alias("dst"))
            .agg(F.count(F.lit(1)).alias("n")))


def transition_shares(counts: DataFrame, by: list[str] = ()) -> DataFrame:
    return counts.withColumn("prob", F.col("n") / F.sum("n").over(Window.partitionBy(*by, "src")))


def keep_large_ends(edges: DataFrame, sizes: DataFrame, threshold: int) -> DataFrame:
    """Edges between states above the size; shares are not taken again."""
    big = sizes.where(F.col("n_epochs") > threshold)
    return (edges.join(big.select(F.col("latent_id").alias("src")), "src", "left_semi")
            .join(big.select(F.col("latent_id").alias("dst")), "dst", "left_semi"))


def reduced_summary(df: DataFrame, stages: dict[str, int] = SLEEP, sleep_only: bool = False) -> DataFrame:
    rows = df.where(F.col("stage").isin(list(SLEEP.values()))) if sleep_only else df
    out = stage_shares(rows, stages, digits=None)
    return out.withColumn("majority", majority_stage(out))
