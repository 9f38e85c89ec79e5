"""Queries: votes, confusion tables, scores and epoch aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.operators import epochs as E, evaluate as V, scaling as SC
from somnia.operators.project import equalise, in_range, merge_nrem, wake_trim
from .proxies import (LAB, PAI, SAMP, SIG, VEC, VECTOR, VOT, epoch_labels, feature_vectors, fin, out, pairs, samples,
                      signal, votes)
from .registry import query

CLASSES = list(range(5))
TRIM = PAI + """, ends AS (SELECT study_id, min(CASE WHEN true_ <> 0 THEN idx END) AS a, max(CASE WHEN true_ <> 0 THEN idx END) AS b FROM pai GROUP BY 1),
tri AS (SELECT p.* FROM pai p JOIN ends e ON p.study_id = e.study_id WHERE e.a IS NULL OR (p.idx >= e.a - 4 AND p.idx < e.b + 4))"""
CC = ", cls AS (SELECT unnest(range(5)) AS c)"


def _cc(src, by=""):
    sel = f"{by}, " if by else ""
    return (f"SELECT {sel}c AS class, count(*) FILTER (true_ = c AND pred = c) AS tp, count(*) FILTER (true_ <> c AND pred = c) AS fp, "
            f"count(*) FILTER (true_ = c AND pred <> c) AS fn, count(*) FILTER (true_ <> c AND pred <> c) AS tn FROM {src}, cls GROUP BY ALL")


PRF = ("tp / nullif(CAST(tp + fp AS DOUBLE), 0) AS pr, tp / nullif(CAST(tp + fn AS DOUBLE), 0) AS rc")


def trimmed(t):
    return wake_trim(pairs(t), 2, 30)


@query("hard_vote", "A-34", out(VOT, "SELECT study_id, epoch_idx, pred FROM (SELECT study_id, epoch_idx, pred, row_number() OVER (PARTITION BY study_id, epoch_idx ORDER BY count(*) DESC, pred) AS rn FROM vot GROUP BY 1, 2, 3) WHERE rn = 1", "study_id epoch_idx pred"))
def _(t):
    return fin(V.hard_vote(votes(t), ["study_id", "epoch_idx"], classes=CLASSES))


def _vote_sql(fn):
    best = "list_position([s0,s1,s2,s3,s4], list_max([s0,s1,s2,s3,s4])) - 1 AS pred"
    agg = ", ".join(f"{fn}(s{c}) AS s{c}" for c in range(5))
    return out(VOT, f"SELECT study_id, epoch_idx, s0, s4, {best} FROM (SELECT study_id, epoch_idx, {agg} FROM vot GROUP BY 1, 2)",
               "study_id epoch_idx pred", "s0 s4")


def _vote(t, how):
    v = V.soft_vote(votes(t), ["study_id", "epoch_idx"], 5, how)
    return fin(v.select("study_id", "epoch_idx", F.col("scores")[0].alias("s0"), F.col("scores")[4].alias("s4"), "pred"))


@query("soft_vote", "A-35 F-17", _vote_sql("avg"))
def _(t):
    return _vote(t, "mean")


@query("summed_vote", "A-36", _vote_sql("sum"))
def _(t):
    return _vote(t, "sum")


@query("aligned_pairs", "P-16 J-12", out(PAI, "SELECT study_id, idx, true_ AS \"true\", pred FROM pai", "study_id idx true pred"))
def _(t):
    key = ["study_id", "epoch_idx"]
    both = equalise(V.hard_vote(votes(t), key, "true"), V.hard_vote(votes(t), key, "pred", CLASSES), key)
    return fin(both.withColumnRenamed("epoch_idx", "idx"))


@query("wake_trimmed_pairs", "P-15", out(TRIM, "SELECT study_id, idx, true_ AS \"true\", pred FROM tri", "study_id idx true pred"))
def _(t):
    return fin(trimmed(t))


@query("class_scores", "A-11 A-34 P-15 P-16", out(TRIM + CC, f"SELECT class, tp, fp, fn, tn, coalesce(pr, 0) AS precision, coalesce(rc, 0) AS recall, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM (SELECT *, {PRF} FROM ({_cc('tri')}))", "class tp fp fn tn", "precision recall f1"))
def _(t):
    return fin(V.class_scores(V.class_counts(V.confusion(trimmed(t)), CLASSES)))


@query("confusion_matrix", "A-09", out(PAI, "SELECT true_ AS \"true\", " + ", ".join(f"count(*) FILTER (pred = {c}) AS pred_{c}" for c in CLASSES) + " FROM pai WHERE true_ IN (0,1,2,3,4) AND pred IN (0,1,2,3,4) GROUP BY 1", "true pred_0 pred_1 pred_2 pred_3 pred_4"))
def _(t):
    return fin(V.confusion_matrix(pairs(t), CLASSES))


@query("confusion_matrix_row_share", "A-10", out(PAI, "SELECT true_ AS \"true\", " + ", ".join(f"count(*) FILTER (pred = {c}) / CAST(count(*) AS DOUBLE) AS pred_{c}" for c in (1, 2, 3)) + " FROM pai WHERE true_ IN (1,2,3) AND pred IN (1,2,3) GROUP BY 1", "true", "pred_1 pred_2 pred_3"))
def _(t):
    return fin(V.normalised_confusion(pairs(t), [1, 2, 3]))


@query("one_vs_rest_scores", "A-12", out(PAI + CC, f"SELECT class, pr AS precision, rc AS recall, 2 * pr * rc / nullif(pr + rc, 0) AS f1, (tp + tn) / CAST(tp + tn + fp + fn AS DOUBLE) AS accuracy, tn / nullif(CAST(tn + fp AS DOUBLE), 0) AS specificity FROM (SELECT *, {PRF} FROM ({_cc('pai')}))", "class", "precision recall f1 accuracy specificity"))
def _(t):
    cc = V.class_counts(V.confusion(pairs(t)), CLASSES)
    return fin(V.one_vs_rest(cc).select("class", "precision", "recall", "f1", "accuracy", "specificity"))


KEPT = ", pai4 AS (SELECT * FROM pai WHERE true_ IN (0, 1, 2, 3))"
KAPPA = """(SELECT (po - pe) / (1 - pe) FROM (SELECT sum(CASE WHEN true_ = pred THEN n ELSE 0 END) / sum(n) AS po FROM cm),
 (SELECT sum(t * p) / (max(tot) * max(tot)) AS pe FROM (SELECT true_ AS c, sum(n) AS t FROM cm GROUP BY 1) JOIN (SELECT pred AS c, sum(n) AS p FROM cm GROUP BY 1) USING (c), (SELECT sum(n) AS tot FROM cm)))"""


@query("global_scores", "A-13 A-14 P-09 U-04", out(PAI + KEPT + CC + ", cm AS (SELECT true_, pred, CAST(count(*) AS DOUBLE) AS n FROM pai4 GROUP BY 1, 2)", f"SELECT (SELECT avg(CASE WHEN true_ = pred THEN 1.0 ELSE 0.0 END) FROM pai4) AS accuracy, (SELECT avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)) FROM (SELECT *, {PRF} FROM ({_cc('pai4')})) WHERE tp + fp + fn > 0) AS macro_f1, (SELECT avg(CASE WHEN true_ = pred THEN 1.0 ELSE 0.0 END) FROM pai4) AS micro_f1, {KAPPA} AS kappa", "", "accuracy macro_f1 micro_f1 kappa"))
def _(t):
    return fin(V.global_scores(V.confusion(pairs(t)), [0, 1, 2, 3], CLASSES))


@query("label_set", "U-04 P-09", out(PAI, "SELECT true_ AS label FROM pai UNION SELECT pred FROM pai EXCEPT SELECT 4", "label"))
def _(t):
    return fin(V.label_set(pairs(t), [4]))


@query("scores_by_study", "A-15 A-16", out(TRIM + CC, f"SELECT study_id, class, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1) AS dice, CASE WHEN tp + fp + fn > 0 THEN (po - pe) / nullif(1 - pe, 0) END AS kappa FROM (SELECT *, (tp + tn) / CAST(tp + fp + fn + tn AS DOUBLE) AS po, (CAST(tp + fn AS DOUBLE) * (tp + fp) + CAST(tn + fp AS DOUBLE) * (tn + fn)) / (CAST(tp + fp + fn + tn AS DOUBLE) * (tp + fp + fn + tn)) AS pe FROM ({_cc('tri', 'study_id')}))", "study_id class", "dice kappa"))
def _(t):
    cc = V.class_counts(V.confusion(trimmed(t), ["study_id"]), CLASSES, ["study_id"])
    return fin(V.class_kappa(V.class_dice(cc)).select("study_id", "class", "dice", "kappa"))


DICE = ", dic AS (SELECT study_id, class, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 1) AS dice FROM (" + _cc("tri", "study_id") + "))"


@query("study_table", "A-17 M-15", out(TRIM + CC + DICE + ", wide AS (SELECT CAST(study_id AS VARCHAR) AS study_id, " + ", ".join(f"max(dice) FILTER (class = {c}) AS cls_{c}" for c in CLASSES) + ", avg(dice) AS mean FROM dic GROUP BY 1)", "SELECT * FROM wide UNION ALL SELECT 'Grand mean', " + ", ".join(f"avg(cls_{c})" for c in CLASSES) + ", avg(mean) FROM wide", "", "cls_0 cls_1 cls_2 cls_3 cls_4 mean"))
def _(t):
    cc = V.class_counts(V.confusion(trimmed(t), ["study_id"]), CLASSES, ["study_id"])
    return fin(V.study_table(V.class_dice(cc), CLASSES, "dice"))


@query("study_summary", "A-18", out(TRIM + CC + DICE + ", per AS (SELECT CAST(class AS VARCHAR) AS class, avg(dice) AS mean, stddev_samp(dice) AS std, min(dice) AS min, max(dice) AS max FROM dic GROUP BY 1)", "SELECT * FROM per UNION ALL SELECT 'mean', avg(mean), avg(std), avg(min), avg(max) FROM per", "", "mean std min max"))
def _(t):
    cc = V.class_counts(V.confusion(trimmed(t), ["study_id"]), CLASSES, ["study_id"])
    return fin(V.reduced_summary(V.class_dice(cc), "dice"))


@query("scores_with_mean", "A-19 P-10", out(PAI + ", cls AS (SELECT unnest([0, 1, 4]) AS c), nrem AS (SELECT CASE WHEN true_ IN (1,2,3) THEN 1 ELSE true_ END AS true_, CASE WHEN pred IN (1,2,3) THEN 1 ELSE pred END AS pred FROM pai), per AS (SELECT CAST(class AS VARCHAR) AS class, coalesce(pr, 0) AS precision, coalesce(rc, 0) AS recall, coalesce(2 * pr * rc / nullif(pr + rc, 0), 0) AS f1 FROM (SELECT *, " + PRF + " FROM (" + _cc("nrem") + ")))", "SELECT * FROM per UNION ALL SELECT 'mean', avg(precision), avg(recall), avg(f1) FROM per", "", "precision recall f1"))
def _(t):
    p = pairs(t).withColumns({"true": merge_nrem("true"), "pred": merge_nrem("pred")})
    names = ["precision", "recall", "f1"]
    return fin(V.with_macro_row(V.class_scores(V.class_counts(V.confusion(p), [0, 1, 4])).select("class", *names), names))


@query("validation_counters", "A-45 P-08", out(PAI + """, cls AS (SELECT unnest(range(4)) AS c), ds AS (SELECT n.n_name AS dataset, p.true_, p.pred FROM pai p JOIN supplier s ON s.s_suppkey = p.study_id JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE true_ BETWEEN 0 AND 3 AND pred BETWEEN 0 AND 3),
 per AS (SELECT dataset, avg(coalesce(pr, 0)) AS precision, avg(coalesce(rc, 0)) AS recall, avg(coalesce(2 * pr * rc / nullif(pr + rc, 0), 0)) AS f1 FROM (SELECT *, """ + PRF + " FROM (" + _cc("ds", "dataset") + ")) GROUP BY 1)", "SELECT * FROM per UNION ALL SELECT 'mean', avg(precision), avg(recall), avg(f1) FROM per", "", "precision recall f1"))
def _(t):
    where = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("study_id"), F.col("n_name").alias("dataset"))
    return fin(V.validation_scores(V.validation_counters(pairs(t).join(where, "study_id"), 4)))


@query("in_range_pairs", "P-08", out(PAI, "SELECT study_id, count(*) AS n FROM pai WHERE true_ BETWEEN 0 AND 2 AND pred BETWEEN 0 AND 2 GROUP BY 1", "study_id n"))
def _(t):
    return fin(pairs(t).where(in_range("true", 3) & in_range("pred", 3)).groupBy("study_id").agg(F.count(F.lit(1)).alias("n")))


@query("soft_dice_loss", "M-14", out(VOT, "SELECT study_id, 1 - (" + " + ".join(f"(2 * sum(CASE WHEN true_ = {c} THEN s{c} / 10 ELSE 0 END) + 1) / (sum((CASE WHEN true_ = {c} THEN 1.0 ELSE 0.0 END) + s{c} / 10) + 1)" for c in CLASSES) + ") / 5 AS loss FROM vot GROUP BY 1", "study_id", "loss"))
def _(t):
    v = votes(t).withColumn("scores", F.transform("scores", lambda s: s / 10))
    return fin(V.soft_dice_loss(v, 5))


@query("class_frequencies", "A-07 A-08", out(LAB, "SELECT stage, count(*) AS n, count(*) / CAST((SELECT count(*) FROM lab) AS DOUBLE) AS freq FROM lab GROUP BY 1", "stage n", "freq"))
def _(t):
    return fin(V.class_frequencies(epoch_labels(t)))


@query("epoch_mode", "A-01", out(LAB, "SELECT * FROM lab", "recording_id epoch_idx stage"))
def _(t):
    return fin(epoch_labels(t))


@query("epoch_sum", "A-02", out(SIG + ", odd AS (SELECT recording_id, max(sample_idx) AS last FROM sig GROUP BY 1 HAVING max(sample_idx) % 2 = 0), ext AS (SELECT recording_id, sample_idx, v FROM sig UNION ALL SELECT s.recording_id, s.sample_idx + 1, s.v FROM sig s JOIN odd o ON s.recording_id = o.recording_id AND s.sample_idx = o.last)", "SELECT recording_id, sample_idx // 4 AS epoch_idx, sum(v) AS v FROM ext GROUP BY 1, 2 HAVING count(*) = 4", "recording_id epoch_idx", "v"))
def _(t):
    return fin(E.epoch_sum(signal(t), ["recording_id"], "sample_idx", 4, "v"))


@query("block_mean", "A-03 P-12 M-13", out(SIG, "SELECT recording_id, sample_idx // 4 AS sample_idx, avg(v) AS v FROM sig GROUP BY 1, 2 HAVING count(*) = 4", "recording_id sample_idx", "v"))
def _(t):
    return fin(E.block_mean(signal(t), ["recording_id"], "sample_idx", 4, "v"))


@query("prefix_average", "A-04", out(SIG + ", ch AS (SELECT recording_id, sample_idx, 'TB' || (sample_idx % 2) AS c0, sample_idx, unnest(['TB1','TB2','EOG1','C']) AS channel, unnest([v, k, v + k, v - k]) AS value FROM sig)", "SELECT recording_id, sample_idx, CASE WHEN channel IN ('TB1','TB2') THEN 'TB' ELSE channel END AS channel, avg(value) AS value FROM ch GROUP BY 1, 2, 3", "recording_id sample_idx", "value"))
def _(t):
    v, k = F.col("v"), F.col("k")
    ch = [("TB1", v), ("TB2", k), ("EOG1", v + k), ("C", v - k)]
    long = signal(t).select("recording_id", "sample_idx", F.explode(F.array(*[
        F.struct(F.lit(n).alias("channel"), x.alias("value")) for n, x in ch])).alias("c")).select("recording_id", "sample_idx", "c.*")
    return fin(E.prefix_average(long, ["EOG1"]))


@query("windowed_correlation", "A-05 J-16", out(SIG + ", w AS (SELECT recording_id, unnest([sample_idx // 4, sample_idx // 4 + 1, CASE WHEN sample_idx % 4 = 0 THEN sample_idx // 4 - 1 END]) AS b, v, k FROM sig)", "SELECT recording_id, b - 1 AS bin, covar_pop(v, k) / nullif(stddev_pop(v) * stddev_pop(k), 0) AS corr FROM w WHERE b >= 1 GROUP BY 1, 2 HAVING count(*) = 9", "recording_id bin", "corr"))
def _(t):
    return fin(E.windowed_correlation(signal(t), ["recording_id"], "sample_idx", 4, "v", "k"))


@query("feature_stats", "A-06 IO-23", out(VEC, "SELECT " + ", ".join(f"min({f}) AS min_{f}, max({f}) AS max_{f}, avg({f}) AS mean_{f}, stddev_pop({f}) AS std_{f}" for f in ("f0", "f1")) + ", least(min(f0), min(f1)) AS min_all, greatest(max(f0), max(f1)) AS max_all FROM vec", "", "min_f0 max_f0 mean_f0 std_f0 min_f1 max_f1 mean_f1 std_f1 min_all max_all"))
def _(t):
    return fin(SC.feature_stats(feature_vectors(t), ["f0", "f1"]))


@query("feature_sum_of_squares", "A-48", out(VEC, "SELECT " + ", ".join(f"sum({f} * {f}) AS {f}" for f in VECTOR) + " FROM vec", "", " ".join(VECTOR)))
def _(t):
    return fin(SC.sum_of_squares(feature_vectors(t), VECTOR))


@query("spread_check", "A-46", out(SAMP, "SELECT recording_id, channel, avg(value) AS mean, stddev_pop(value) AS std, CASE WHEN abs(avg(value)) <= 48 AND stddev_pop(value) <= 40 THEN 1 ELSE 0 END AS ok FROM samp GROUP BY 1, 2", "recording_id ok", "mean std"))
def _(t):
    return fin(SC.spread_check(samples(t), ["recording_id", "channel"], "value", 48.0, 40.0))
