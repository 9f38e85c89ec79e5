"""Queries: artefacts, intervals, smoothing, normalising, sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.operators import epochs as E, intervals as I, sequences as Q
from somnia.session import shared_dir
from somnia.sources import store as S
from .proxies import ANN, EPOCH, FS, HYP, LAB, SIG, annotations, epoch_labels, fin, hypnogram, out, signal
from .registry import query

KEY = ["recording_id"]
V = lambda t: signal(t).select("recording_id", "sample_idx", "v")


def _box(src, col, dst):
    return f"{dst} AS (SELECT recording_id, sample_idx, sum({col}) OVER (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) / 5 AS v FROM {src})"


@query("smooth", "W-01", out(SIG + ", " + ", ".join([_box("sig", "v", "b1"), _box("b1", "v", "b2"), _box("b2", "v", "b3")]), "SELECT * FROM b3", "recording_id sample_idx", "v"))
def _(t):
    return fin(E.smooth(V(t), KEY, "sample_idx", ["v"]))


ZS = SIG + ", z AS (SELECT recording_id, sample_idx, v, (v - avg(v) OVER p) / nullif(stddev_pop(v) OVER p, 0) AS z, count(*) OVER p AS n FROM sig WINDOW p AS (PARTITION BY recording_id))"
DZ = ZS + ", d AS (SELECT *, coalesce(lead(z) OVER (PARTITION BY recording_id ORDER BY sample_idx) - z, 0) AS dz FROM z)"


@query("zscore", "W-02", out(ZS, "SELECT recording_id, sample_idx, z FROM z", "recording_id sample_idx", "z"))
def _(t):
    return fin(E.zscore(V(t), KEY, "sample_idx", "v").select("recording_id", "sample_idx", "z"))


@query("first_difference", "W-03", out(SIG, "SELECT recording_id, sample_idx, coalesce(lead(v) OVER (PARTITION BY recording_id ORDER BY sample_idx) - v, 0) AS diff FROM sig", "recording_id sample_idx", "diff"))
def _(t):
    return fin(E.first_difference(V(t), KEY, "sample_idx", "v").select("recording_id", "sample_idx", "diff"))


RUN = SIG + ', g AS (SELECT recording_id, sample_idx, sample_idx - row_number() OVER (PARTITION BY recording_id ORDER BY sample_idx) AS isl FROM sig WHERE v > 20), runs AS (SELECT recording_id, min(sample_idx) AS "start", max(sample_idx) AS "end" FROM g GROUP BY recording_id, isl)'


def runs(t):
    return I.runs(V(t), KEY, "sample_idx", F.col("v") > 20)


@query("runs", "W-04", out(RUN, "SELECT * FROM runs", "recording_id start end"))
def _(t):
    return fin(runs(t))


@query("pad_intervals", "W-23", out(RUN, 'SELECT recording_id, "start" - 0.5 AS "start", "end" + 0.5 AS "end" FROM runs', "recording_id", "start end"))
def _(t):
    return fin(I.pad(runs(t), 0.5))


def _merged(eps, op):
    return (RUN + ', r1 AS (SELECT *, max("end") OVER (PARTITION BY recording_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runs), '
            f'r2 AS (SELECT *, sum(CASE WHEN reach IS NULL OR "start" - reach {op} {eps} THEN 1 ELSE 0 END) OVER (PARTITION BY recording_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS isl FROM r1), '
            'mrg AS (SELECT recording_id, min("start") AS "start", max("end") AS "end" FROM r2 GROUP BY recording_id, isl)')


@query("merge_intervals", "W-05", out(_merged(2, ">"), "SELECT * FROM mrg", "recording_id start end"))
def _(t):
    return fin(I.merge_intervals(runs(t), KEY, epsilon=2))


@query("merge_intervals_strict", "W-05", out(_merged(2, ">="), "SELECT * FROM mrg", "recording_id start end"))
def _(t):
    return fin(I.merge_intervals(runs(t), KEY, epsilon=2, strict=True))


@query("in_intervals", "J-02 W-05", out(_merged(2, ">"), 'SELECT s.recording_id, s.sample_idx, CASE WHEN m."start" IS NULL THEN 0 ELSE 1 END AS inside FROM sig s LEFT JOIN mrg m ON s.recording_id = m.recording_id AND s.sample_idx BETWEEN m."start" AND m."end"', "recording_id sample_idx inside"))
def _(t):
    merged = I.merge_intervals(runs(t), KEY, epsilon=2)
    return fin(I.in_intervals(V(t).select("recording_id", "sample_idx"), merged, KEY, "sample_idx"))


ART = DZ + f""", tm AS (SELECT *, sample_idx * (n / (n - 1.0) / {FS}) AS tm, n / (n - 1.0) / {FS} AS st FROM d),
fl AS (SELECT *, max(CASE WHEN abs(z) > 2.5 THEN sample_idx END) OVER a AS pb, min(CASE WHEN abs(z) > 2.5 THEN sample_idx END) OVER b AS nb,
 max(CASE WHEN abs(dz) > 3.0 THEN sample_idx END) OVER a AS pf, min(CASE WHEN abs(dz) > 3.0 THEN sample_idx END) OVER b AS nf FROM tm
 WINDOW a AS (PARTITION BY recording_id ORDER BY sample_idx ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY recording_id ORDER BY sample_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
art AS (SELECT recording_id, sample_idx, v, coalesce((sample_idx - pb) * st <= 0.6, false) OR coalesce((nb - sample_idx) * st <= 0.6, false)
 OR coalesce((sample_idx - pf) * st <= 0.3, false) OR coalesce((nf - sample_idx) * st <= 0.3, false) AS artefact FROM fl)"""


def masked(t):
    return E.artefact_mask(V(t), KEY, "sample_idx", "v", FS, (2.5, 3.0), (0.6, 0.3))


@query("artefact_mask", "W-24 W-02 W-03 W-04 W-23", out(ART, "SELECT recording_id, sample_idx, CASE WHEN artefact THEN 0 ELSE v END AS v, artefact FROM art", "recording_id sample_idx artefact", "v"))
def _(t):
    return fin(masked(t))


@query("artefacts_on_store", "IO-03 IO-09 W-24", out(ART, "SELECT recording_id, sample_idx, CASE WHEN artefact THEN 0 ELSE v END AS v, artefact FROM art", "recording_id sample_idx artefact", "v"))
def _(t):
    path = shared_dir(t.spark)
    S.write_chunked(V(t), path, KEY, reach=256, chunk=4096)
    rows, chunk = S.open_chunked(t.spark, path)
    return fin(E.artefact_mask(rows, KEY, "sample_idx", "v", FS, (2.5, 3.0), (0.6, 0.3), chunk))


@query("artefact_epochs", "A-33", out(ART, f"SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, 100.0 * sum(CAST(artefact AS INT)) / {EPOCH} AS pct, CASE WHEN sum(CAST(artefact AS INT)) > 0 THEN 1 ELSE 0 END AS flagged FROM art GROUP BY 1, 2 HAVING count(*) = {EPOCH}", "recording_id epoch_idx flagged", "pct"))
def _(t):
    return fin(E.artefact_epochs(masked(t), KEY, "sample_idx", EPOCH))


@query("override_artefact_labels", "A-33 U-02", out(ART + f", labn AS (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, stage, count(*) AS n FROM sig GROUP BY ALL), lab AS (SELECT recording_id, epoch_idx, stage FROM (SELECT *, row_number() OVER (PARTITION BY recording_id, epoch_idx ORDER BY n DESC, stage) AS rn, sum(n) OVER (PARTITION BY recording_id, epoch_idx) AS total FROM labn) WHERE rn = 1 AND total = {EPOCH}), bad AS (SELECT DISTINCT recording_id, sample_idx // {EPOCH} AS epoch_idx FROM art WHERE artefact)", "SELECT lab.recording_id, lab.epoch_idx, CASE WHEN bad.epoch_idx IS NULL THEN lab.stage ELSE 0 END AS stage FROM lab LEFT JOIN bad ON lab.recording_id = bad.recording_id AND lab.epoch_idx = bad.epoch_idx", "recording_id epoch_idx stage"))
def _(t):
    flagged = E.artefact_epochs(masked(t), KEY, "sample_idx", EPOCH)
    return fin(E.override_artefacts(epoch_labels(t), flagged, KEY))


@query("label_points", "J-01 W-09", out(LAB + f", iv AS (SELECT recording_id, epoch_idx * {EPOCH} AS a, (epoch_idx + 1) * {EPOCH} AS b, stage FROM lab WHERE stage < 4)", "SELECT s.recording_id, s.sample_idx, iv.stage FROM sig s LEFT JOIN iv ON s.recording_id = iv.recording_id AND s.sample_idx >= iv.a AND s.sample_idx < iv.b", "recording_id sample_idx stage"))
def _(t):
    scored = I.encode_runs(epoch_labels(t), KEY, "epoch_idx", "stage", EPOCH).where("stage < 4")
    spans = scored.select("recording_id", F.col("init_sec").alias("onset"), F.col("dur_sec").alias("duration"), "stage")
    return fin(I.label_points(V(t).select("recording_id", "sample_idx"), spans, KEY, "sample_idx"))


@query("fixed_events", "J-14 X-08", out(ANN, "SELECT recording_id, id, onset + unnest(range(CAST(floor(duration / 2592000) AS BIGINT))) * 2592000 AS event_onset, stage FROM ann", "recording_id id stage", "event_onset"))
def _(t):
    a = annotations(t).select("recording_id", "id", "onset", "duration", "stage")
    return fin(I.fixed_events(a, 2592000.0).select("recording_id", "id", "event_onset", "stage"))


@query("encode_runs", "W-09", out(LAB + ", ch AS (SELECT *, CASE WHEN stage IS DISTINCT FROM lag(stage) OVER (PARTITION BY recording_id ORDER BY epoch_idx) OR epoch_idx = 0 THEN 1 ELSE 0 END AS c FROM lab), gr AS (SELECT *, sum(c) OVER (PARTITION BY recording_id ORDER BY epoch_idx) AS g FROM ch)", "SELECT recording_id, stage, min(epoch_idx) * 30 AS init_sec, count(*) * 30 AS dur_sec FROM gr GROUP BY recording_id, g, stage", "recording_id stage init_sec dur_sec"))
def _(t):
    return fin(I.encode_runs(epoch_labels(t), KEY, "epoch_idx", "stage", 30))


@query("expand_runs", "W-10", out(HYP, "SELECT recording_id, init_sec // 30 + unnest(range(dur_sec // 30)) AS epoch_idx, stage FROM hyp", "recording_id epoch_idx"))
def _(t):
    return fin(I.expand_runs(hypnogram(t), 30))


@query("fill_gaps", "W-11", out(HYP + ", nx AS (SELECT *, lead(init_sec) OVER (PARTITION BY recording_id ORDER BY init_sec, dur_sec) AS nxt FROM hyp)", "SELECT recording_id, init_sec, dur_sec, stage FROM hyp UNION ALL SELECT recording_id, init_sec + dur_sec, nxt - init_sec - dur_sec, 'UNKNOWN' FROM nx WHERE nxt > init_sec + dur_sec", "recording_id init_sec dur_sec"))
def _(t):
    return fin(I.fill_gaps(hypnogram(t), KEY, "UNKNOWN"))


@query("remove_offset", "W-12", out(HYP, "SELECT recording_id, init_sec - min(init_sec) OVER (PARTITION BY recording_id) AS init_sec, dur_sec, stage, 1 AS whole_seconds FROM hyp", "recording_id init_sec dur_sec whole_seconds"))
def _(t):
    return fin(I.remove_offset(hypnogram(t), KEY))


@query("correct_zero_durations", "W-13", out(HYP, "SELECT recording_id, init_sec, CASE WHEN dur_sec = 0 THEN 30 ELSE dur_sec END AS dur_sec, stage FROM hyp", "recording_id init_sec dur_sec"))
def _(t):
    return fin(I.correct_zero_durations(hypnogram(t), 30))


def _wei(src, key, col):
    return (f"q AS (SELECT {key}, quantile_cont({col}, 0.1) AS p10, quantile_cont({col}, 0.9) AS p90 FROM {src} GROUP BY {key}), "
            f"a AS (SELECT q.{key}, avg(s.{col}) FILTER (s.{col} <= p10) AS lo, avg(s.{col}) FILTER (s.{col} >= p90) AS hi FROM {src} s JOIN q ON s.{key} = q.{key} GROUP BY 1)")


@query("normalise_percentile", "W-14 F-03", out(SIG + ", " + _wei("sig", "recording_id", "v"), "SELECT s.recording_id, s.sample_idx, greatest(least((s.v - lo) / (hi - lo), 1), 0.05) AS v FROM sig s JOIN a ON s.recording_id = a.recording_id", "recording_id sample_idx", "v"))
def _(t):
    return fin(E.normalise_percentile(V(t), KEY, "sample_idx", ["v"]))


@query("norm_to_range", "F-04", out(SIG, "SELECT recording_id, sample_idx, (v - min(v) OVER p) / nullif(max(v) OVER p - min(v) OVER p, 0) AS v FROM sig WINDOW p AS (PARTITION BY recording_id)", "recording_id sample_idx", "v"))
def _(t):
    return fin(E.norm_to_range(V(t), KEY, "sample_idx", "v"))


N = ", n AS (SELECT recording_id, count(*) AS n FROM lab GROUP BY 1)"


@query("centred_sequences", "W-15", out(LAB + N + ", c AS (SELECT lab.recording_id, lab.epoch_idx, greatest(1, least(n - 2, epoch_idx)) AS centre FROM lab JOIN n ON lab.recording_id = n.recording_id WHERE n >= 3)", "SELECT c.recording_id, c.epoch_idx, c.centre, l.epoch_idx - c.centre + 1 AS pos, l.stage FROM c JOIN lab l ON l.recording_id = c.recording_id AND l.epoch_idx BETWEEN c.centre - 1 AND c.centre + 1", "recording_id epoch_idx centre pos stage"))
def _(t):
    q = Q.centred_sequences(epoch_labels(t), KEY, "epoch_idx", ["stage"], 1)
    return fin(q.select("recording_id", "epoch_idx", "centre", F.posexplode("seq").alias("pos", "s")).select(
        "recording_id", "epoch_idx", "centre", "pos", "s.stage"))


@query("fixed_sequences", "W-16", out(LAB, "SELECT recording_id, seq_id, pos, stage FROM (SELECT recording_id, epoch_idx // 2 AS seq_id, epoch_idx % 2 AS pos, stage, count(*) OVER (PARTITION BY recording_id, epoch_idx // 2) AS n FROM lab) WHERE n = 2", "recording_id seq_id pos stage"))
def _(t):
    q = Q.fixed_sequences(epoch_labels(t), KEY, "epoch_idx", ["stage"], 2)
    return fin(q.select("recording_id", "seq_id", F.posexplode("seq").alias("pos", "s")).select("recording_id", "seq_id", "pos", "s.stage"))


@query("overlapping_sequences", "W-17", out(LAB + N, 'SELECT a.recording_id, a.epoch_idx AS "start", a.epoch_idx // 2 AS batch, b.epoch_idx - a.epoch_idx AS pos, b.stage FROM lab a JOIN n ON a.recording_id = n.recording_id JOIN lab b ON a.recording_id = b.recording_id AND b.epoch_idx BETWEEN a.epoch_idx AND a.epoch_idx + 1 WHERE a.epoch_idx + 2 <= n', "recording_id start batch pos stage"))
def _(t):
    q = Q.overlapping_sequences(epoch_labels(t), KEY, "epoch_idx", ["stage"], 2, 2)
    return fin(q.select("recording_id", "start", "batch", F.posexplode("seq").alias("pos", "s")).select(
        "recording_id", "start", "batch", "pos", "s.stage"))


@query("overlap_add", "W-18", out(LAB + N + ", w AS (SELECT a.recording_id, b.epoch_idx, (b.stage + a.epoch_idx) % 3 AS x0, (b.stage * 2 + a.epoch_idx) % 5 AS x1 FROM lab a JOIN n ON a.recording_id = n.recording_id JOIN lab b ON a.recording_id = b.recording_id AND b.epoch_idx BETWEEN a.epoch_idx AND a.epoch_idx + 1 WHERE a.epoch_idx + 2 <= n)", "SELECT recording_id, epoch_idx, sum(x0) AS s0, sum(x1) AS s1, count(*) AS n_windows, CASE WHEN sum(x1) > sum(x0) THEN 1 ELSE 0 END AS pred FROM w GROUP BY 1, 2", "recording_id epoch_idx n_windows pred", "s0 s1"))
def _(t):
    q = Q.overlapping_sequences(epoch_labels(t), KEY, "epoch_idx", ["stage"], 2, 2)
    w = q.withColumn("scores", F.transform("seq", lambda e: F.array(
        ((e["stage"] + F.col("start")) % 3).cast("double"), ((e["stage"] * 2 + F.col("start")) % 5).cast("double"))))
    added = Q.overlap_add(w, KEY, 2)
    return fin(added.select("recording_id", "epoch_idx", F.col("scores")[0].alias("s0"), F.col("scores")[1].alias("s1"), "n_windows", "pred"))


@query("smooth_labels", "W-19 F-19", out(LAB + N + ", k AS (SELECT unnest([-1, 0, 1]) AS o, unnest([0.5, 0.3, 0.2]) AS h), m AS (SELECT lab.recording_id, epoch_idx, h, n, ((epoch_idx + o) % (2 * n) + 2 * n) % (2 * n) AS j FROM lab JOIN n ON lab.recording_id = n.recording_id, k), j2 AS (SELECT m.recording_id, m.epoch_idx, m.h, l.stage FROM m JOIN lab l ON l.recording_id = m.recording_id AND l.epoch_idx = CASE WHEN j >= n THEN 2 * n - 1 - j ELSE j END)", "SELECT recording_id, epoch_idx, " + ", ".join(f"sum(CASE WHEN stage = {c} THEN h ELSE 0 END) AS c{c}" for c in range(5)) + " FROM j2 GROUP BY 1, 2", "recording_id epoch_idx", "c0 c1 c2 c3 c4"))
def _(t):
    # The kernel is turned round by convolution: its first weight meets the next epoch.
    q = Q.smooth_labels(epoch_labels(t), KEY, "epoch_idx", "stage", [0.2, 0.3, 0.5], 5)
    return fin(q.select("recording_id", "epoch_idx", *[F.col("soft")[c].alias(f"c{c}") for c in range(5)]))


@query("study_ends", "W-20", out(LAB, 'SELECT recording_id, count(*) AS n_epochs, sum(count(*)) OVER (ORDER BY recording_id) AS "end" FROM lab GROUP BY 1', "recording_id n_epochs end"))
def _(t):
    return fin(Q.study_ends(epoch_labels(t), "recording_id"))


@query("global_batches", "W-21", out(LAB + N, 'SELECT lab.recording_id, epoch_idx, row_number() OVER (ORDER BY lab.recording_id, epoch_idx) - 1 AS "position", (row_number() OVER (ORDER BY lab.recording_id, epoch_idx) - 1) // 4 AS batch FROM lab JOIN n ON lab.recording_id = n.recording_id WHERE epoch_idx >= 1 AND epoch_idx < n - 1', "recording_id epoch_idx position batch"))
def _(t):
    return fin(Q.global_batches(epoch_labels(t), "recording_id", "epoch_idx", 1, 4))


@query("epoch_time", "W-22", out(LAB, "SELECT recording_id, epoch_idx, epoch_idx * 7.5 AS start_sec FROM lab", "recording_id epoch_idx", "start_sec"))
def _(t):
    return fin(E.epoch_time(epoch_labels(t), 7.5).select("recording_id", "epoch_idx", "start_sec"))
