"""Queries: selecting, masking, trimming and re-referencing."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.functions.registry import QUALITY, STRIPS, apply_named
from somnia.operators import project as P
from somnia.operators.epochs import label_samples
from somnia.schemas import RAT_STAGES
from .proxies import ANN, COD, EPOCH, LAB, SAMP, SIG, annotations, coded_epochs, epoch_labels, fin, out, samples, signal
from .registry import query

TEXTS = [("F", "NATION_0", 0), ("O", "NATION_0", 1), ("P", "NATION_0", 1), ("F", "NATION_1", 2), ("O", "NATION_1", 4)]
CHAN = {"5": "EOG1", "1": "EKG", "2": "TBAR", "3": "C3", "4": "ZX"}
CHS = """chs AS (SELECT o_custkey AS recording_id, CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'EOG1' WHEN '1' THEN 'EKG' WHEN '2' THEN 'TBAR' WHEN '3' THEN 'C3' ELSE 'ZX' END AS channel, o_totalprice AS value FROM orders)"""
TYPE = "CASE channel WHEN 'EOG1' THEN 'eog' WHEN 'EKG' THEN 'ecg' WHEN 'TBAR' THEN 'eeg' WHEN 'C3' THEN 'eeg' ELSE 'seeg' END"


def channels(t):
    """``recording_id channel value``: a named channel per order."""
    from somnia.functions.scalar import lookup
    return t.orders.select(F.col("o_custkey").alias("recording_id"),
                           lookup(CHAN, F.substring("o_orderpriority", 1, 1), "ZX").alias("channel"),
                           F.col("o_totalprice").alias("value"))


@query("pick_channels", "P-01", out(SAMP, "SELECT * FROM samp WHERE channel IN ('v')", "recording_id sample_idx", "value"))
def _(t):
    return fin(P.pick_channels(samples(t), ["v"]))


@query("exclude_channels", "P-01", out(CHS, "SELECT channel, count(*) AS n FROM chs WHERE channel NOT IN ('EOG1', 'EKG') GROUP BY 1", "n"))
def _(t):
    return fin(P.exclude_channels(channels(t), ["EOG1", "EKG"]).groupBy("channel").agg(F.count(F.lit(1)).alias("n")))


@query("channel_types", "P-02 F-23", out(CHS, f"SELECT channel, {TYPE} AS type, count(*) AS n, sum(value) AS total FROM chs GROUP BY 1, 2", "n", "total"))
def _(t):
    return fin(P.with_channel_type(channels(t)).groupBy("channel", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("rename_channels", "P-03", out(CHS, "SELECT recording_id, CASE channel WHEN 'ZX' THEN 'Oz' WHEN 'C3' THEN 'C4' ELSE channel END AS channel, value FROM chs", "recording_id", "value"))
def _(t):
    return fin(P.rename_channels(channels(t), {"ZX": "Oz", "C3": "C4"}))


@query("keep_stages", "P-04 F-14", out(COD, "SELECT epoch_id, stage FROM cod WHERE stage IN (1, 5)", "epoch_id stage"))
def _(t):
    return fin(P.keep_stages(coded_epochs(t), ["Wake", "REM"], RAT_STAGES).select("epoch_id", "stage"))


@query("pick_subjects", "P-05", out("sb AS (SELECT o_orderkey, c_custkey AS subject, n_name AS dataset FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)", "SELECT * FROM sb WHERE dataset IN ('NATION_1', 'NATION_7')", "o_orderkey subject"))
def _(t):
    rows = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
            .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
            .select("o_orderkey", F.col("c_custkey").alias("subject"), F.col("n_name").alias("dataset")))
    return fin(P.keep_datasets(rows, ["NATION_1", "NATION_7"]))


@query("stage_from_text", "P-06", out("ds AS (SELECT n_name AS dataset, o_orderstatus AS description FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey), m(description, dataset, stage) AS (VALUES " + ", ".join(str(x) for x in TEXTS) + ")", "SELECT ds.dataset, ds.description, m.stage, count(*) AS n FROM ds LEFT JOIN m USING (dataset, description) GROUP BY ALL", "stage n"))
def _(t):
    ds = (t.orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey"))
          .join(t.nation, F.col("c_nationkey") == F.col("n_nationkey"))
          .select(F.col("n_name").alias("dataset"), F.col("o_orderstatus").alias("description")))
    m = t.spark.createDataFrame(TEXTS, "text string, dataset string, stage int")
    return fin(P.stage_from_text(ds, m).groupBy("dataset", "description", "stage").agg(F.count(F.lit(1)).alias("n")))


@query("stage_names", "P-07", out(LAB, "SELECT recording_id, epoch_idx, CASE stage WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' WHEN 4 THEN 'REM' END AS name FROM lab", "recording_id epoch_idx"))
def _(t):
    return fin(epoch_labels(t).select("recording_id", "epoch_idx", P.stage_name("stage").alias("name")))


@query("merge_nrem", "P-10", out(LAB, "SELECT CASE WHEN stage IN (1, 2, 3) THEN 1 ELSE stage END AS stage, count(*) AS n FROM lab GROUP BY 1", "stage n"))
def _(t):
    return fin(epoch_labels(t).select(P.merge_nrem("stage").alias("stage")).groupBy("stage").agg(F.count(F.lit(1)).alias("n")))


@query("drop_head", "P-11", out(SIG, "SELECT recording_id, sample_idx - 8 AS sample_idx, v FROM sig WHERE sample_idx >= 8", "recording_id sample_idx", "v"))
def _(t):
    n = P.whole_samples(2.0, 4.0)
    return fin(P.drop_head(signal(t).select("recording_id", "sample_idx", "v"), "sample_idx", n))


@query("drop_remainder", "P-12 P-19", out(SIG + ", n AS (SELECT recording_id, count(*) AS n FROM sig GROUP BY 1)", f"SELECT sig.recording_id, sample_idx, v FROM sig JOIN n ON sig.recording_id = n.recording_id WHERE sample_idx < n // {EPOCH} * {EPOCH}", "recording_id sample_idx", "v"))
def _(t):
    rows = signal(t).select("recording_id", "sample_idx", "v")
    return fin(apply_named(rows, STRIPS, [("trim_psg_trailing", {"keys": ["recording_id"], "idx": "sample_idx", "size": EPOCH})]))


@query("trim_to_batches", "P-12", out("", "SELECT event_id, value FROM events WHERE event_id < (SELECT count(*) FROM events) // 1024 * 1024", "event_id", "value"))
def _(t):
    return fin(P.drop_remainder(t.events.select("event_id", "value"), [], "event_id", 1024))


@query("crop_to_annotations", "P-13", out(ANN + ", rk AS (SELECT recording_id, onset, row_number() OVER (PARTITION BY recording_id ORDER BY onset) AS a, row_number() OVER (PARTITION BY recording_id ORDER BY onset DESC) AS b FROM ann), ends AS (SELECT recording_id, min(onset) FILTER (a >= 2) - 864000 AS lo, max(onset) FILTER (b >= 2) + 864000 AS hi FROM rk GROUP BY 1)", "SELECT ann.recording_id, id, onset FROM ann JOIN ends ON ann.recording_id = ends.recording_id WHERE onset BETWEEN lo AND hi", "recording_id id", "onset"))
def _(t):
    a = annotations(t)
    rows = a.select("recording_id", "id", "onset")
    return fin(P.crop_to_annotations(rows, a, ["recording_id"], "onset", 864000.0))


@query("trim_ends", "P-14", out(ANN + ", mx AS (SELECT recording_id, max(onset) AS m FROM ann GROUP BY 1)", "SELECT ann.recording_id, id FROM ann JOIN mx ON ann.recording_id = mx.recording_id WHERE onset BETWEEN 20000000 AND m - 20000000", "recording_id id"))
def _(t):
    a = annotations(t).select("recording_id", "id", "onset")
    return fin(P.trim_ends(a, ["recording_id"], "onset", 2e7).select("recording_id", "id"))


@query("mask_other_stages", "P-17 J-08", out(LAB, f"SELECT s.recording_id, s.sample_idx, CASE WHEN lab.stage IN (1, 3) THEN s.v END AS v FROM sig s JOIN lab ON s.recording_id = lab.recording_id AND s.sample_idx // {EPOCH} = lab.epoch_idx", "recording_id sample_idx", "v"))
def _(t):
    rows = label_samples(signal(t).select("recording_id", "sample_idx", "v"), epoch_labels(t), ["recording_id"], "sample_idx", EPOCH)
    return fin(P.mask_outside(rows, [1, 3], "v").select("recording_id", "sample_idx", "v"))


@query("decimate", "P-18", out(SIG, "SELECT recording_id, sample_idx // 5 AS sample_idx, v FROM sig WHERE sample_idx % 5 = 0", "recording_id sample_idx", "v"))
def _(t):
    return fin(P.decimate(signal(t).select("recording_id", "sample_idx", "v"), "sample_idx", 5))


@query("strip_to_match", "P-19", out(LAB, f"SELECT DISTINCT s.recording_id, s.sample_idx // {EPOCH} AS epoch_idx, lab.stage FROM sig s JOIN lab ON s.recording_id = lab.recording_id AND s.sample_idx // {EPOCH} = lab.epoch_idx WHERE lab.stage <> 2", "recording_id epoch_idx stage"))
def _(t):
    eps = signal(t).select("recording_id", P.chunk_of("sample_idx", EPOCH).alias("epoch_idx")).distinct()
    steps = [("strip_to_match", {"labels": epoch_labels(t), "keys": ["recording_id", "epoch_idx"]}), ("drop_class", {"stage": 2})]
    return fin(apply_named(eps, STRIPS, steps))


@query("match_path", "P-20", out("", "SELECT page_id, url FROM pages WHERE regexp_matches(url, '/(fr|de)/[0-9]+')", "page_id"))
def _(t):
    return fin(P.match_path(t.pages.select("page_id", "url"), "url", "/(fr|de)/[0-9]+"))


@query("bipolar", "P-21", out(SIG, "SELECT recording_id, sample_idx, unnest(['v-k', 'k']) AS channel, unnest([v - k, k]) AS value FROM sig", "recording_id sample_idx", "value"))
def _(t):
    return fin(P.bipolar(samples(t), [("v", "k")], ["k"]))


@query("montage", "P-22", out(SIG, "SELECT recording_id, sample_idx, unnest(['v', 'k-v']) AS channel, unnest([v, k - v]) AS value FROM sig", "recording_id sample_idx", "value"))
def _(t):
    return fin(P.montage(samples(t), ["v", "k-v", "x-y"]))


@query("first_available_channels", "P-23", out(CHS + ", h AS (SELECT recording_id, max(CAST(channel = 'EOG1' AS INT)) AS e, max(CAST(channel = 'C3' AS INT)) AS c, max(CAST(channel = 'ZX' AS INT)) AS z FROM chs GROUP BY 1)", "SELECT * FROM (SELECT recording_id, CASE WHEN e = 1 AND c = 1 THEN 0 WHEN z = 1 THEN 1 WHEN e = 1 THEN 2 END AS choice FROM h) WHERE choice IS NOT NULL", "recording_id choice"))
def _(t):
    return fin(P.first_available(channels(t), [["EOG1", "C3"], ["ZX"], ["EOG1"]]))


@query("scale_units", "P-24", out(SIG, "SELECT recording_id, sample_idx, v * 1e6 + 500 AS v FROM sig", "recording_id sample_idx", "v"))
def _(t):
    return fin(P.scale_units(signal(t).select("recording_id", "sample_idx", "v"), 1e6, 500.0, "v"))


@query("clip_noisy", "D-17 X-03", out(SAMP + ", q AS (SELECT recording_id, channel, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM samp GROUP BY 1, 2)", "SELECT s.recording_id, s.channel, sample_idx, greatest(least(value, 1.5 * iqr), -1.5 * iqr) AS value FROM samp s JOIN q ON s.recording_id = q.recording_id AND s.channel = q.channel", "recording_id sample_idx", "value"))
def _(t):
    return fin(apply_named(samples(t), QUALITY, [("clip_noisy_values", {"keys": ["recording_id", "channel"], "idx": "sample_idx", "k": 1.5})]))


@query("zero_noisy_epochs", "D-18", out(SAMP + f", q AS (SELECT recording_id, channel, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS iqr FROM samp GROUP BY 1, 2), pk AS (SELECT recording_id, channel, sample_idx // {EPOCH} AS e, max(abs(value)) AS pk FROM samp GROUP BY 1, 2, 3)", f"SELECT s.recording_id, s.channel, sample_idx, sample_idx // {EPOCH} AS epoch_idx, CASE WHEN pk > 3 * iqr THEN 0 ELSE value END AS value FROM samp s JOIN q ON s.recording_id = q.recording_id AND s.channel = q.channel JOIN pk ON s.recording_id = pk.recording_id AND s.channel = pk.channel AND pk.e = s.sample_idx // {EPOCH}", "recording_id sample_idx epoch_idx", "value"))
def _(t):
    return fin(apply_named(samples(t), QUALITY, [("zero_out_noisy_epochs", {"keys": ["recording_id", "channel"], "idx": "sample_idx", "size": EPOCH, "k": 3.0})]))
