"""Queries: draws, splits and augmentations."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.functions.registry import AUGMENTERS, apply_named
from somnia.operators import sampling as S, signal as G
from .proxies import EPOCH, LAB, SIG, epoch_labels, fin, out, signal
from .registry import query

KEY = ["recording_id"]


def _h(seed, *cols):
    return "md5(" + " || '|' || ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]]) + ")"


def _u(seed, *cols):
    return f"(CAST(('0x' || substr({_h(seed, *cols)}, 1, 12)) AS BIGINT) / 281474976710656.0)"


def _n(seed, *cols):
    """Standard normal draw from both halves of one hash."""
    a, b = (f"((CAST(('0x' || substr({_h(seed, *cols)}, {at}, 12)) AS BIGINT) + CAST(0.5 AS DOUBLE)) / 281474976710656.0)" for at in (1, 13))
    return f"(sqrt(-2 * ln({a})) * cos(2 * pi() * {b}))"


@query("balanced_take", "S-01", out(LAB + f", r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY {_h(3, 'recording_id', 'epoch_idx')}) - 1 AS rank FROM lab)", "SELECT recording_id, epoch_idx, stage, rank, unnest([1, 2]) AS copy FROM r WHERE rank < 10", "recording_id epoch_idx stage rank copy"))
def _(t):
    taken = S.take_random(epoch_labels(t), ["stage"], 10, ["recording_id", "epoch_idx"], 3)
    return fin(S.shuffle(S.repeat_rows(taken, 2), ["recording_id", "epoch_idx", "copy"], 4))


EPS = LAB + ", ep AS (SELECT recording_id AS study_id, epoch_idx, stage FROM lab)"
PROB = [0.1, 0.2, 0.3, 0.2, 0.2]


def _class(seed):
    edge, out_ = 0.0, ""
    for c, p in enumerate(PROB[:-1]):
        edge += p
        out_ += f" WHEN {_u(seed, 'event_id')} < {edge!r} THEN {c}"
    return f"CASE{out_} ELSE 4 END"


def _draws(stage, seed, margin):
    return (EPS.replace("stage FROM lab)", f"{stage} FROM lab)") + ", st AS (SELECT stage, study_id, count(*) AS n, row_number() OVER (PARTITION BY stage ORDER BY study_id) AS o FROM ep GROUP BY 1, 2), "
            "ns AS (SELECT stage, count(*) AS m FROM st GROUP BY 1), po AS (SELECT *, row_number() OVER (PARTITION BY stage, study_id ORDER BY epoch_idx) - 1 AS p FROM ep), "
            f"dr AS (SELECT event_id AS draw, {_class(f'{seed}c') if stage == 'stage' else '0'} AS stage, {_u(f'{seed}s', 'event_id')} AS us, {_u(f'{seed}e', 'event_id')} AS ue, {_u(f'{seed}m', 'event_id')} AS um FROM events), "
            "d2 AS (SELECT dr.*, CAST(floor(us * m) AS BIGINT) + 1 AS o FROM dr JOIN ns ON dr.stage = ns.stage), "
            "d3 AS (SELECT d2.*, st.study_id, CAST(floor(ue * st.n) AS BIGINT) AS p FROM d2 JOIN st ON st.stage = d2.stage AND st.o = d2.o), "
            f"d4 AS (SELECT d3.draw, d3.stage, d3.study_id, po.epoch_idx, po.epoch_idx + CAST(floor(um * {2 * margin + 1}) AS BIGINT) - {margin} AS centre FROM d3 JOIN po ON po.stage = d3.stage AND po.study_id = d3.study_id AND po.p = d3.p)")


def _epochs(t):
    return epoch_labels(t).withColumnRenamed("recording_id", "study_id")


@query("balanced_draws", "S-02 S-05", out(_draws("stage", 5, 2), "SELECT * FROM d4", "draw stage study_id epoch_idx centre"))
def _(t):
    draws = t.events.select(F.col("event_id").alias("draw"))
    probs = S.class_probabilities([p * 10 for p in PROB], 5)
    return fin(S.draw_balanced(_epochs(t), draws, probs, 2, 5))


@query("uniform_draws", "S-03", out(_draws("0 AS stage", 6, 0), "SELECT draw, study_id, epoch_idx FROM d4", "draw study_id epoch_idx"))
def _(t):
    return fin(S.draw_uniform(_epochs(t), t.events.select(F.col("event_id").alias("draw")), 6))


@query("dataset_mix", "S-04", out("ds AS (SELECT n_name AS dataset, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1)", "SELECT dataset, n, 0.75 * n / (SELECT CAST(sum(n) AS DOUBLE) FROM ds) + 0.25 / (SELECT count(*) FROM ds) AS prob FROM ds", "n", "prob"))
def _(t):
    ds = t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy(F.col("n_name").alias("dataset")).agg(
        F.count(F.lit(1)).alias("n"))
    return fin(S.dataset_mix(ds, 0.25))


@query("class_probabilities", "S-05", out(LAB, "SELECT stage, sqrt(count(*)) / sum(sqrt(count(*))) OVER () AS prob FROM lab GROUP BY 1", "stage", "prob"))
def _(t):
    w = epoch_labels(t).groupBy("stage").agg(F.sqrt(F.count(F.lit(1))).alias("w"))
    return fin(w.select("stage", (F.col("w") / w.agg(F.sum("w")).scalar()).alias("prob")))


def _splits(k, frac, seed, n_test):
    fold = (f"CASE WHEN r < n % {k} * (n // {k} + 1) THEN r // (n // {k} + 1) ELSE n % {k} + (r - n % {k} * (n // {k} + 1)) // (n // {k}) END"
            if k > 1 else f"CASE WHEN r < {n_test} THEN 0 ELSE -1 END")
    return (f"s0 AS (SELECT c_custkey, row_number() OVER (ORDER BY {_h(f'{seed}t', 'c_custkey')}) - 1 AS r, count(*) OVER () AS n FROM customer), "
            f"s1 AS (SELECT *, {fold} AS fold, unnest(range({k})) AS split FROM s0), "
            f"s2 AS (SELECT *, CASE WHEN fold = split THEN 0 ELSE 1 END AS rest FROM s1), "
            f"s3 AS (SELECT *, sum(rest) OVER (PARTITION BY split ORDER BY {_h(f'{seed}v', 'split', 'c_custkey')}) AS vr FROM s2), "
            f"spl AS (SELECT split, c_custkey, CASE WHEN rest = 0 THEN 'test' WHEN vr <= ceil(n * {frac}) THEN 'val' ELSE 'train' END AS part FROM s3)")


def splits(t):
    return S.split_subjects(t.customer, "c_custkey", 7, 0.2, seed=11)


SPL = _splits(7, 0.2, 11, 0)


@query("folds_by_subject", "S-06", out(SPL, "SELECT * FROM spl", "split c_custkey"))
def _(t):
    return fin(splits(t))


@query("fixed_split", "S-07", out(_splits(1, 0.25, 12, "ceil(n * 0.3)"), "SELECT * FROM spl", "split c_custkey"))
def _(t):
    return fin(S.split_subjects(t.customer, "c_custkey", 1, 0.25, 0.3, seed=12))


@query("split_counts", "A-41 S-06", out(SPL + ", rec AS (SELECT o_custkey AS c_custkey, count(*) AS n FROM orders GROUP BY 1), j AS (SELECT split, part, n FROM spl JOIN rec ON rec.c_custkey = spl.c_custkey)", "SELECT split, part, sum(n) AS records, count(*) AS subjects FROM j GROUP BY 1, 2 UNION ALL SELECT split, 'total', sum(n), count(*) FROM j GROUP BY 1", "split records subjects"))
def _(t):
    return fin(S.split_counts(splits(t), t.orders.select(F.col("o_custkey").alias("c_custkey")), "c_custkey"))


@query("split_manifest", "IO-18", out(SPL, "SELECT split, part, spl.c_custkey, 'records/' || o_orderkey || '.parquet' AS path FROM spl JOIN orders ON o_custkey = spl.c_custkey", "split c_custkey"))
def _(t):
    from somnia.sources.catalog import split_manifest
    rec = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.concat(F.lit("records/"), "o_orderkey", F.lit(".parquet")).alias("path"))
    return fin(split_manifest(splits(t), rec, "c_custkey"))


@query("random_studies", "S-08", out(f"r AS (SELECT c_custkey, row_number() OVER (ORDER BY {_h(13, 'c_custkey')}) - 1 AS rank FROM customer)", "SELECT * FROM r WHERE rank < 40", "c_custkey rank"))
def _(t):
    return fin(S.take_random(t.customer.select("c_custkey"), [], 40, ["c_custkey"], 13))


@query("samples_per_pass", "S-15", out(LAB, "SELECT least(count(*), 500000) // 35 AS n_samples FROM lab", "n_samples"))
def _(t):
    return fin(S.samples_per_pass(epoch_labels(t).agg(F.count(F.lit(1)).alias("n")), 500_000, 17))


SEQ = SIG + f", sq AS (SELECT * FROM (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, sample_idx % {EPOCH} AS i, v, k, count(*) OVER (PARTITION BY recording_id, sample_idx // {EPOCH}) AS c FROM sig) WHERE c = {EPOCH})"
ID = ["recording_id", "epoch_idx"]


def sequences(t):
    """Whole epochs as arrays ``v`` and ``k``."""
    f = G.frames(signal(t), KEY, "sample_idx", ["v", "k"], EPOCH)
    return f.select(*ID, F.col("frame_v").alias("v"), F.col("frame_k").alias("k"))


def rows(df, *cols):
    """Sequences back to one row per element."""
    z = F.arrays_zip(*cols)
    keep = [c for c in df.columns if c in (*ID, "weight", "flag")]
    return df.select(*keep, F.posexplode(z).alias("i", "_z")).select(*keep, "i", "_z.*")


@query("augmentation_flags", "S-09", out(SEQ, f"SELECT DISTINCT recording_id, epoch_idx, CASE WHEN {_u(21, 'recording_id', 'epoch_idx')} <= 0.3 THEN 1 ELSE 0 END AS flag, CASE WHEN {_u(21, 'recording_id', 'epoch_idx')} <= 0.3 THEN 0.5 ELSE 1 END AS weight FROM sq", "recording_id epoch_idx flag", "weight"))
def _(t):
    s = sequences(t).withColumns({"weight": F.lit(1.0), "flag": S.augment_flag(0.3, 21, *ID)})
    return fin(s.select(*ID, "flag", S.weigh(F.col("flag"), "weight").alias("weight")))


@query("amplitude_and_shift", "S-11", out(SEQ, f"SELECT recording_id, epoch_idx, i, v * (0.5 + 1.5 * {_u(22, 'recording_id', 'epoch_idx')}) AS v, k + (-5 + 10 * {_u(23, 'recording_id', 'epoch_idx')}) AS k FROM sq", "recording_id epoch_idx i", "v k"))
def _(t):
    s = sequences(t).withColumns({"v": S.amplitude("v", 0.5 + 1.5 * S.uniform(22, *ID)), "k": S.shift("k", -5 + 10 * S.uniform(23, *ID))})
    return fin(rows(s, "v", "k"))


REG = SEQ + f", rg AS (SELECT *, CAST(floor({_u('24p', 'recording_id', 'epoch_idx')} * {EPOCH}) AS INT) AS st, CAST(floor(10 ** (log10(0.1) + {_u('24l', 'recording_id', 'epoch_idx')} * (log10(0.8) - log10(0.1))) * {EPOCH}) AS INT) AS ln, CAST(floor({_u('25p', 'recording_id', 'epoch_idx')} * {EPOCH}) AS INT) AS tk FROM sq)"


@query("region_choice", "S-10", out(REG, f"SELECT recording_id, epoch_idx, i, CASE WHEN (i - st + {EPOCH}) % {EPOCH} < ln THEN 1 ELSE 0 END AS inside FROM rg", "recording_id epoch_idx i inside"))
def _(t):
    start, n = S.region(EPOCH, 0.1, 0.8, 24, *ID)
    s = sequences(t).withColumn("inside", F.transform("v", lambda x, i: S.in_region(i, start, n, EPOCH)))
    return fin(rows(s, "inside"))


@query("sign_flip", "S-13", out(REG, f"SELECT recording_id, epoch_idx, i, CASE WHEN (i - st + {EPOCH}) % {EPOCH} < ln THEN -v ELSE v END AS v FROM rg", "recording_id epoch_idx i", "v"))
def _(t):
    start, n = S.region(EPOCH, 0.1, 0.8, 24, *ID)
    return fin(rows(sequences(t).withColumn("v", S.sign_flip("v", start, n, EPOCH)), "v"))


@query("signal_mix", "S-13", out(REG, f"SELECT a.recording_id, a.epoch_idx, a.i, CASE WHEN (a.i - a.st + {EPOCH}) % {EPOCH} < a.ln THEN (a.v + b.v) / 2 ELSE a.v END AS v FROM rg a JOIN rg b ON a.recording_id = b.recording_id AND a.epoch_idx = b.epoch_idx AND b.i = (a.tk + (a.i - a.st + {EPOCH}) % {EPOCH}) % {EPOCH}", "recording_id epoch_idx i", "v"))
def _(t):
    start, n = S.region(EPOCH, 0.1, 0.8, 24, *ID)
    take, _n = S.region(EPOCH, 0.1, 0.8, 25, *ID)
    return fin(rows(sequences(t).withColumn("v", S.signal_mix("v", start, take, n, EPOCH)), "v"))


E_ID = ("recording_id", "epoch_idx")
X_ID = (*E_ID, "i")


def _region_sql(seed, hi):
    """Start and length of a region of a tenth to ``hi`` of an epoch, and whether element i is inside."""
    start = f"CAST(floor({_u(f'{seed}p', *E_ID)} * {EPOCH}) AS INT)"
    return f"((i - {start} + {EPOCH}) % {EPOCH} < CAST(floor(10 ** (log10(0.1) + {_u(f'{seed}l', *E_ID)} * (log10({hi}) - log10(0.1))) * {EPOCH}) AS INT))", start


def _dropped(seed, c):
    """Of two channels the one with the smaller hash."""
    h = lambda name: f"md5('{seed}d|{name}|' || CAST(recording_id AS VARCHAR) || '|' || CAST(epoch_idx AS VARCHAR))"
    return f"{h(c)} < {h('k' if c == 'v' else 'v')}"


def _mean_sql(c):
    return f"avg({c}) OVER (PARTITION BY recording_id, epoch_idx)"


def _stretch(source, alpha, sigma, seed, prefix=""):
    """CTEs up to ``{prefix}moved``: signals ``v`` and ``w`` and label ``y`` of ``source`` read off at i plus smoothed offsets."""
    last = EPOCH - 1
    return f"""{prefix}off AS (SELECT *, {_u(seed, *X_ID)} * 2 - 1 AS u, {alpha} AS al, {sigma} AS sg FROM {source}),
{prefix}ker AS (SELECT recording_id, epoch_idx, i, exp(-0.5 * pow(d / sg, 2)) / sum(exp(-0.5 * pow(d / sg, 2))) OVER (PARTITION BY recording_id, epoch_idx, i) AS g, d
 FROM (SELECT *, unnest(range(-CAST(floor(4.0 * sg + 0.5) AS INT), CAST(floor(4.0 * sg + 0.5) AS INT) + 1)) AS d FROM {prefix}off)),
{prefix}pos AS (SELECT a.recording_id, a.epoch_idx, a.i, a.i + any_value(a.al) * coalesce(sum(k.g * b.u), 0) AS p FROM {prefix}off a JOIN {prefix}ker k USING (recording_id, epoch_idx, i)
 LEFT JOIN {prefix}off b ON b.recording_id = a.recording_id AND b.epoch_idx = a.epoch_idx AND b.i = a.i + k.d GROUP BY 1, 2, 3),
{prefix}moved AS (SELECT p.recording_id, p.epoch_idx, p.i, CASE WHEN p BETWEEN 0 AND {last} THEN l.v + (r.v - l.v) * (p - floor(p)) ELSE 0 END AS v,
 CASE WHEN p BETWEEN 0 AND {last} THEN l.w + (r.w - l.w) * (p - floor(p)) ELSE 0 END AS w, CASE WHEN p BETWEEN 0 AND {last} THEN n.y ELSE 0 END AS y
 FROM {prefix}pos p JOIN {source} l ON l.recording_id = p.recording_id AND l.epoch_idx = p.epoch_idx AND l.i = greatest(0, least({last}, floor(p)))
 JOIN {source} r ON r.recording_id = p.recording_id AND r.epoch_idx = p.epoch_idx AND r.i = greatest(0, least({last}, floor(p) + 1))
 JOIN {source} n ON n.recording_id = p.recording_id AND n.epoch_idx = p.epoch_idx AND n.i = greatest(0, least({last}, ceil(p - 0.5))))"""


IN26, _ = _region_sql(26, 0.8)


@query("noise_and_erase", "S-11 S-13", out(SEQ, f"SELECT recording_id, epoch_idx, i, v, v + 0.5 * {_n(27, *X_ID)} AS noisy, CASE WHEN {IN26} THEN v + 0.1 * {_n(28, *X_ID)} ELSE v END AS part, CASE WHEN {IN26} THEN {_mean_sql('v')} + 0.01 * {_n(29, *X_ID)} ELSE v END AS erased FROM sq", "recording_id epoch_idx i", "v noisy part erased"))
def _(t):
    start, n = S.region(EPOCH, 0.1, 0.8, 26, *ID)
    s = sequences(t)
    s = s.withColumns({"noisy": S.gaussian_noise("v", 0.5, 0.0, 27, *ID), "part": S.regional_noise("v", start, n, EPOCH, 0.1, 28, *ID),
                       "erased": S.erase("v", start, n, EPOCH, 29, *ID)})
    return fin(rows(s, "v", "noisy", "part", "erased"))


@query("channel_dropout", "S-12", out(SEQ, "SELECT recording_id, epoch_idx, i, " + ", ".join(f"CASE WHEN {_dropped(30, c)} THEN {_mean_sql(c)} + 0.01 * {_n(f'30{c}', *X_ID)} ELSE {c} END AS {c}" for c in "vk") + " FROM sq", "recording_id epoch_idx i", "v k"))
def _(t):
    s = sequences(t)
    return fin(rows(s.withColumns(S.drop_channels({"v": "v", "k": "k"}, 0.5, 30, *ID)), "v", "k"))


@query("elastic", "S-14", out(SEQ + ", src AS (SELECT recording_id, epoch_idx, i, v, v AS w, CAST(trunc(k) AS INT) AS y FROM sq), " + _stretch("src", 3.0, 2.0, 31), "SELECT recording_id, epoch_idx, i, v, y AS k FROM moved", "recording_id epoch_idx i k", "v"))
def _(t):
    s = sequences(t).withColumn("u", F.transform("v", lambda x, i: S.uniform(31, *ID, i) * 2 - 1))
    e = s.withColumn("e", G.elastic(F.col("v"), F.transform("k", lambda x: x.cast("int")), F.col("u"), 3.0, 2.0))
    return fin(rows(e.select(*ID, F.col("e.signal").alias("v"), F.col("e.labels").alias("k")), "v", "k"))


BYN = SEQ + f""", fl AS (SELECT *, {_u('41on', 'recording_id', 'epoch_idx')} <= 0.6 AS amp, {_u('42on', 'recording_id', 'epoch_idx')} <= 0.5 AS flip,
 CAST(floor({_u('42p', 'recording_id', 'epoch_idx')} * {EPOCH}) AS INT) AS st, CAST(floor(10 ** (log10(0.1) + {_u('42l', 'recording_id', 'epoch_idx')} * (log10(0.8) - log10(0.1))) * {EPOCH}) AS INT) AS ln FROM sq)"""


@query("augmenters_by_name", "X-01 X-02 S-09", out(BYN, "SELECT recording_id, epoch_idx, i, CASE WHEN amp THEN 0.5 ELSE 1 END * CASE WHEN flip THEN 0.5 ELSE 1 END AS weight, " + ", ".join(f"{c} * CASE WHEN amp THEN 0.5 + 1.5 * {_u('41u', 'recording_id', 'epoch_idx')} ELSE 1 END * CASE WHEN flip AND (i - st + {EPOCH}) % {EPOCH} < ln THEN -1 ELSE 1 END AS {c}" for c in "vk") + " FROM fl", "recording_id epoch_idx i", "weight v k"))
def _(t):
    common = {"keys": ID, "channels": ["v", "k"]}
    steps = [("GlobalAmplitude", {**common, "min_scaling": 0.5, "max_scaling": 2.0, "apply_prob": 0.6, "seed": 41}),
             ("RegionalSignFlip", {**common, "length": EPOCH, "min_region_fraction": 0.1, "max_region_fraction": 0.8, "apply_prob": 0.5, "seed": 42})]
    return fin(rows(apply_named(sequences(t).withColumn("weight", F.lit(1.0)), AUGMENTERS, steps), "v", "k"))


def _chain():
    """One CTE per augmenter, each with its own flag; ``w`` is channel k, ``y`` the labels."""
    names = {"v": "v", "w": "k"}
    ctes = SEQ + ", s0 AS (SELECT recording_id, epoch_idx, i, v, k AS w, CAST(trunc(k) AS INT) AS y, CAST(1 AS DOUBLE) AS weight FROM sq)"

    def step(seed, source, made):
        on = f"{_u(f'{seed}on', *E_ID)} <= 0.5"
        cols = ", ".join(f"CASE WHEN {on} THEN {made(c, n)} ELSE {c} END AS {c}" for c, n in names.items())
        return f", s{seed} AS (SELECT recording_id, epoch_idx, i, {cols}, y, weight * CASE WHEN {on} THEN 0.5 ELSE 1 END AS weight FROM {source})"

    ctes += step(51, "s0", lambda c, n: f"{c} + (-1 + 2 * {_u('51u', *E_ID)})")
    ctes += step(52, "s51", lambda c, n: f"{c} + 0.1 * {_n(f'52{n}', *X_ID)}")
    ctes += step(53, "s52", lambda c, n: f"CASE WHEN {_dropped(53, n)} THEN {_mean_sql(c)} + 0.01 * {_n(f'53{n}', *X_ID)} ELSE {c} END")
    ctes += step(54, "s53", lambda c, n: f"CASE WHEN {_region_sql(54, 0.5)[0]} THEN {c} + 0.1 * {_n(f'54{n}', *X_ID)} ELSE {c} END")
    ctes += step(55, "s54", lambda c, n: f"CASE WHEN {_region_sql(55, 0.5)[0]} THEN ({_mean_sql('v')} + {_mean_sql('w')}) / 2 + 0.01 * {_n(f'55{n}', *X_ID)} ELSE {c} END")
    inside, start = _region_sql(56, 0.5)
    take = f"CAST(floor({_u('56tp', *E_ID)} * {EPOCH}) AS INT)"
    ctes += f""", mx AS (SELECT *, {inside} AS inside, ({take} + (i - {start} + {EPOCH}) % {EPOCH}) % {EPOCH} AS o FROM s55),
ot AS (SELECT a.*, b.v AS ov, b.w AS ow FROM mx a JOIN s55 b ON a.recording_id = b.recording_id AND a.epoch_idx = b.epoch_idx AND b.i = a.o)"""
    ctes += step(56, "ot", lambda c, n: f"CASE WHEN inside THEN ({c} + o{c}) / 2 ELSE {c} END")
    return ctes + ", " + _stretch("s56", f"1 + 2 * {_u('57a', *E_ID)}", f"1 + {_u('57s', *E_ID)}", "57u", "e")


ALL = f"""SELECT a.recording_id, a.epoch_idx, a.i, weight * CASE WHEN f THEN 0.5 ELSE 1 END AS weight, CASE WHEN f THEN m.v ELSE a.v END AS v, CASE WHEN f THEN m.w ELSE a.w END AS k, CASE WHEN f THEN m.y ELSE a.y END AS y
 FROM (SELECT *, {_u('57on', *E_ID)} <= 0.5 AS f FROM s56) a JOIN emoved m USING (recording_id, epoch_idx, i)"""


@query("all_augmenters", "X-02 S-11 S-12 S-13 S-14", out(_chain(), ALL, "recording_id epoch_idx i y", "weight v k"))
def _(t):
    common = {"keys": ID, "channels": ["v", "k"], "apply_prob": 0.5}
    part = {"length": EPOCH, "min_region_fraction": 0.1, "max_region_fraction": 0.5}
    steps = [("GlobalShift", {**common, "min_shift": -1.0, "max_shift": 1.0, "seed": 51}), ("GlobalGaussianNoise", {**common, "sigma": 0.1, "seed": 52}),
             ("ChannelDropout", {**common, "drop_fraction": 0.5, "seed": 53}), ("RegionalGaussianNoise", {**common, **part, "seed": 54}),
             ("RegionalErase", {**common, **part, "seed": 55}), ("RegionalSignalMix", {**common, **part, "seed": 56}),
             ("GlobalElasticDeformations", {**common, "labels": "y", "alpha": (1.0, 3.0), "sigma": (1.0, 2.0), "seed": 57})]
    s = sequences(t).withColumns({"weight": F.lit(1.0), "y": F.transform("k", lambda x: x.cast("int"))})
    return fin(rows(apply_named(s, AUGMENTERS, steps), "v", "k", "y"))
