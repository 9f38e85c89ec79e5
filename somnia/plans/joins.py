"""Queries: matching epochs, channels, files and groups."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.operators import epochs as E
from somnia.sources import catalog as C, text as X
from .proxies import EPOCH, LAB, SIG, epoch_labels, fin, out, signal
from .registry import query

KEY = ["recording_id"]
GRP = """grp AS (SELECT c_custkey AS study_id, unnest([0, 0, 1, 1]) AS group_no, unnest(['EEG' || (c_nationkey % 3), 'EEG3', 'EOG1', 'EEG' || (c_nationkey % 2 + 2)]) AS channel FROM customer)"""


def groups(t):
    n = F.col("c_nationkey")
    name = lambda k: F.concat(F.lit("EEG"), k.cast("string"))
    items = [(0, name(n % 3)), (0, F.lit("EEG3")), (1, F.lit("EOG1")), (1, name(n % 2 + 2))]
    return t.customer.select(F.col("c_custkey").alias("study_id"), F.explode(F.array(*[
        F.struct(F.lit(g).alias("group_no"), c.alias("channel")) for g, c in items])).alias("r")).select("study_id", "r.*")


@query("label_samples", "J-08 J-16", out(LAB, f"SELECT s.recording_id, s.sample_idx, lab.epoch_idx, s.v, s.k, lab.stage FROM sig s JOIN lab ON s.recording_id = lab.recording_id AND s.sample_idx // {EPOCH} = lab.epoch_idx", "recording_id sample_idx epoch_idx stage", "v k"))
def _(t):
    return fin(E.label_samples(signal(t).drop("stage"), epoch_labels(t), KEY, "sample_idx", EPOCH))


@query("channel_sets", "J-09", out(GRP + ", p AS (SELECT a.study_id, a.channel AS x, b.channel AS y FROM grp a JOIN grp b ON a.study_id = b.study_id WHERE a.group_no = 0 AND b.group_no = 1), d AS (SELECT study_id, x, y, row_number() OVER (PARTITION BY study_id, least(x, y), greatest(x, y) ORDER BY x, y) AS rn FROM p)", "SELECT study_id, x || '+' || y AS channel_set FROM d WHERE rn = 1", "study_id"))
def _(t):
    return fin(C.channel_sets(groups(t), ["study_id"]))


@query("stage_samples", "J-10", out(LAB, f"SELECT s.recording_id, s.sample_idx, s.v, s.sample_idx // {EPOCH} AS epoch_idx, row_number() OVER (PARTITION BY s.recording_id ORDER BY s.sample_idx) - 1 AS new_idx FROM sig s JOIN lab ON s.recording_id = lab.recording_id AND s.sample_idx // {EPOCH} = lab.epoch_idx WHERE lab.stage = 3", "recording_id sample_idx epoch_idx new_idx", "v"))
def _(t):
    rows = signal(t).select("recording_id", "sample_idx", "v")
    return fin(E.stage_samples(rows, epoch_labels(t), KEY, "sample_idx", EPOCH, 3))


ELEC = """ele AS (SELECT 'TR' || lpad(CAST(s_suppkey % 40 AS VARCHAR), 2, '0') AS name, min(s_acctbal) AS x, min(CAST(s_nationkey AS DOUBLE)) AS y, max(s_acctbal) AS z FROM supplier GROUP BY 1),
chn AS (SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN 'TR' || p_size WHEN p_size % 3 = 0 THEN 'TR' || lpad(CAST(p_size AS VARCHAR), 3, '0') ELSE 'X' || p_size END AS channel FROM part)"""


@query("find_coordinates", "J-11 F-15", out(ELEC + ", nm AS (SELECT *, regexp_extract(channel, '^(\\D+)(\\d+)$', 1) AS base, regexp_replace(regexp_extract(channel, '^(\\D+)(\\d+)$', 2), '^0+([0-9])', '\\1') AS num FROM chn)", "SELECT n.p_partkey, n.channel, coalesce(a.x, b.x, c.x) AS x, coalesce(a.y, b.y, c.y) AS y, coalesce(a.z, b.z, c.z) AS z, CASE WHEN coalesce(a.name, b.name, c.name) IS NULL THEN 0 ELSE 1 END AS found FROM nm n LEFT JOIN ele a ON a.name = n.channel LEFT JOIN ele b ON b.name = n.base || (CASE WHEN length(n.num) < 2 THEN lpad(n.num, 2, '0') ELSE n.num END) LEFT JOIN ele c ON c.name = n.base || n.num", "p_partkey found", "x y z"))
def _(t):
    ele = t.supplier.groupBy(F.concat(F.lit("TR"), F.lpad((F.col("s_suppkey") % 40).cast("string"), 2, "0")).alias("name")).agg(
        F.min("s_acctbal").alias("x"), F.min(F.col("s_nationkey").cast("double")).alias("y"), F.max("s_acctbal").alias("z"))
    size = F.col("p_size").cast("string")
    name = (F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("TR"), size))
            .when(F.col("p_size") % 3 == 0, F.concat(F.lit("TR"), F.lpad(size, 3, "0"))).otherwise(F.concat(F.lit("X"), size)))
    return fin(X.find_coordinates(t.part.select("p_partkey", name.alias("channel")), ele))


FIL = """tru AS (SELECT 'true/' || o_custkey || '_' || (o_orderkey % 3) || '.npy' AS path FROM orders), prd AS (SELECT 'pred/' || c_custkey || '_' || (c_custkey % 3) || '.npy' AS path FROM customer)"""


@query("pair_files", "J-12", out(FIL + ", a AS (SELECT regexp_extract(path, '/([0-9]+_[0-9]+)[.]', 1) AS study_id, min(path) AS true_path, count(*) AS n_true_path FROM tru GROUP BY 1), b AS (SELECT regexp_extract(path, '/([0-9]+_[0-9]+)[.]', 1) AS study_id, min(path) AS pred_path, count(*) AS n_pred_path FROM prd GROUP BY 1)", "SELECT coalesce(a.study_id, b.study_id) AS study_id, true_path, n_true_path, pred_path, n_pred_path, CASE WHEN n_true_path = 1 AND n_pred_path = 1 THEN 1 ELSE 0 END AS ok FROM a FULL JOIN b ON a.study_id = b.study_id", "n_true_path n_pred_path ok"))
def _(t):
    true = t.orders.select(F.concat(F.lit("true/"), "o_custkey", F.lit("_"), F.col("o_orderkey") % 3, F.lit(".npy")).alias("path"))
    pred = t.customer.select(F.concat(F.lit("pred/"), "c_custkey", F.lit("_"), F.col("c_custkey") % 3, F.lit(".npy")).alias("path"))
    return fin(C.pair_by_id(true, pred, r"/([0-9]+_[0-9]+)[.]"))


@query("group_by_subject", "J-13", out("f AS (SELECT url AS path, len(regexp_extract_all(url, '/([a-z]+)/[0-9]+')) AS n_matches, regexp_extract(url, '/([a-z]+)/[0-9]+', 1) AS subject FROM pages)", "SELECT path, n_matches, subject, CASE WHEN n_matches = 1 THEN 1 ELSE 0 END AS ok, count(*) OVER (PARTITION BY subject) AS n_files FROM f", "n_matches ok n_files"))
def _(t):
    return fin(C.group_by_subject(t.pages.select(F.col("url").alias("path")), "/([a-z]+)/[0-9]+"))


@query("aligned_channels", "J-16 D-10", out(SIG, f"SELECT a.recording_id, a.sample_idx // {EPOCH} AS epoch_idx, sum(CASE WHEN b.sample_idx IS NOT NULL THEN b.v * a.k ELSE 0 END) AS xcorr FROM sig a LEFT JOIN sig b ON a.recording_id = b.recording_id AND b.sample_idx = a.sample_idx + 2 AND b.sample_idx // {EPOCH} = a.sample_idx // {EPOCH} GROUP BY 1, 2 HAVING count(*) = {EPOCH}", "recording_id epoch_idx", "xcorr"))
def _(t):
    return fin(E.cross_correlation(signal(t), KEY, "sample_idx", EPOCH, "v", "k", 2))
