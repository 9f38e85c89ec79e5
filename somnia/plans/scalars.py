"""Queries: column functions and scalers."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from somnia.functions import scalar as S
from somnia.operators import scaling as SC
from somnia.sources import text as X
from .proxies import COD, EPOCH, LAB, SAMP, SIG, VEC, VECTOR, VOT, coded_epochs, epoch_labels, feature_vectors, fin, out, samples, signal, votes
from .registry import query

LI = "f AS (SELECT l_quantity AS theta, l_extendedprice / 1000 AS delta, l_discount * 100 AS sigma, l_tax * 100 AS gamma, l_linenumber AS emg, l_orderkey, l_partkey FROM lineitem)"
IDX = {"index_w": "emg * emg * gamma / nullif(theta, 0)", "index_r": "{th} * gamma / nullif(delta * delta * emg * emg, 0)",
       "index_n": "sigma * delta / nullif(gamma * gamma, 0)", "index_1": "emg * gamma / nullif(delta, 0)",
       "index_2": "sigma * delta / nullif(theta, 0)", "index_3": "theta * gamma / nullif(delta, 0)", "index_4": "delta / nullif(theta, 0)"}


def _powers(t):
    return t.lineitem.select("l_orderkey", "l_partkey", F.col("l_quantity").alias("theta"), (F.col("l_extendedprice") / 1000).alias("delta"),
                             (F.col("l_discount") * 100).alias("sigma"), (F.col("l_tax") * 100).alias("gamma"),
                             F.col("l_linenumber").cast("double").alias("emg"))


def _index_query(name, power, top):
    @query(name, "F-01", out(LI, "SELECT l_orderkey, l_partkey, " + ", ".join(f"{e.format(th=top)} AS {n}" for n, e in IDX.items()) + " FROM f", "l_orderkey l_partkey", " ".join(IDX)))
    def _(t):
        p = _powers(t)
        return fin(p.select("l_orderkey", "l_partkey", *[c.alias(n) for n, c in S.ratio_indices(theta_power=power).items()]))


_index_query("ratio_indices", "code", "theta * 2")
_index_query("ratio_indices_squared", "square", "theta * theta")


@query("safe_log", "F-02", out(SIG, "SELECT recording_id, sample_idx, CASE WHEN v - 5 > 0 THEN ln(v - 5) END AS x FROM sig", "recording_id sample_idx", "x"))
def _(t):
    return fin(signal(t).select("recording_id", "sample_idx", S.safe_ln(F.col("v") - 5).alias("x")))


@query("log_features", "F-02", out(SIG + ", m AS (SELECT min(k) AS mk, min(v - 100) AS mv FROM sig)", "SELECT recording_id, sample_idx, CASE WHEN mk >= 0 THEN ln(k + 2.220446049250313e-16) ELSE k END AS k, CASE WHEN mv >= 0 THEN ln(v - 100) ELSE v - 100 END AS v FROM sig, m", "recording_id sample_idx", "k v"))
def _(t):
    rows = signal(t).select("recording_id", "sample_idx", "k", (F.col("v") - 100).alias("v"))
    return fin(SC.log_features(rows, ["k", "v"]))


@query("clip", "F-03", out(SIG, "SELECT recording_id, sample_idx, greatest(least(v, 90.0), 10.0) AS v FROM sig", "recording_id sample_idx", "v"))
def _(t):
    return fin(signal(t).select("recording_id", "sample_idx", S.clip("v", 10.0, 90.0).alias("v")))


STT = VEC + ", st AS (SELECT " + ", ".join(f"min({f}) AS mn_{f}, max({f}) AS mx_{f}, avg({f}) AS av_{f}, stddev_pop({f}) AS sd_{f}" for f in VECTOR) + " FROM vec), g AS (SELECT *, least(" + ", ".join(f"mn_{f}" for f in VECTOR) + ") AS mn, greatest(" + ", ".join(f"mx_{f}" for f in VECTOR) + ") AS mx FROM st)"
FWD = {"global": "10 * (({f} - mn) / (mx - mn) - 0.5)", "single": "10 * (({f} - mn_{f}) / (mx_{f} - mn_{f}) - 0.5)",
       "baseZeroG": "({f} - mn) / (mx - mn)", "baseZeroS": "10 * ({f} - mn_{f}) / (mx_{f} - mn_{f})",
       "baseZeroCol": "({f} - mn_{f}) / (mx_{f} - mn_{f})", "stdz": "({f} - av_{f}) / sd_{f}", "minZero": "{f} - mn_{f}", "NOscaling": "{f}"}


def _scaler_query(kind):
    @query(f"scale_features_{kind}", "F-05", out(STT, "SELECT vec_id, " + ", ".join(f"{FWD[kind].format(f=f)} AS {f}" for f in VECTOR) + " FROM vec, g", "vec_id", " ".join(VECTOR)))
    def _(t):
        return fin(SC.scale_features(feature_vectors(t), VECTOR, kind).drop("label"))


for _kind in FWD:
    _scaler_query(_kind)


@query("unscale_features", "F-06", out(VEC, "SELECT vec_id, " + ", ".join(VECTOR) + " FROM vec", "vec_id", " ".join(VECTOR)))
def _(t):
    rows = feature_vectors(t)
    stats = SC.feature_stats(rows, VECTOR)
    back = rows
    for kind in SC.SCALERS:
        back = SC.unscale_features(SC.scale_features(back, VECTOR, kind, stats), VECTOR, kind, stats)
    return fin(back.drop("label"))


@query("subtract_mean", "F-07", out(VEC + ", a AS (SELECT " + ", ".join(f"avg({f}) AS a_{f}" for f in VECTOR) + " FROM vec), c AS (SELECT " + ", ".join(f"{f} - a_{f} AS {f}" for f in VECTOR) + " FROM vec, a)", "SELECT min(f0) AS min_f0, max(f0) AS max_f0, avg(f0) AS mean_f0, stddev_pop(f0) AS std_f0, min(f0) AS min_all, max(f0) AS max_all FROM c", "", "min_f0 max_f0 mean_f0 std_f0 min_all max_all"))
def _(t):
    return fin(SC.feature_stats(SC.subtract_mean(feature_vectors(t), VECTOR), ["f0"]))


@query("logistic", "F-08", out(VEC, "SELECT vec_id, 1 / (1 + exp(-f0)) AS p FROM vec", "vec_id", "p"))
def _(t):
    return fin(feature_vectors(t).select("vec_id", S.logistic("f0").alias("p")))


@query("state_codes", "F-09 F-10", out(COD, "SELECT epoch_id, code, " + " + ".join(f"CAST(substr(code, {i + 1}, 1) AS INT) * {2 ** (5 - i)}" for i in range(6)) + " AS number, substr(code, 3) AS key FROM cod", "epoch_id number"))
def _(t):
    c = coded_epochs(t)
    bits = F.transform(F.split("code", ""), lambda b: b.cast("int"))
    return fin(c.select("epoch_id", S.code_string(bits).alias("code"), S.code_number("code").alias("number"), S.code_key("code", 2).alias("key")))


@query("recording_names", "F-11", out("nm AS (SELECT o_orderkey, 'Rat' || o_custkey || '_SD' || (o_orderkey % 20) || '_' || CASE o_orderstatus WHEN 'F' THEN 'OR' WHEN 'O' THEN 'OD' ELSE 'HC' END || CASE WHEN o_orderkey % 3 = 0 THEN '_RGS' ELSE '' END || '_posttrial' || (o_orderkey % 5) AS name, o_custkey AS rat, o_orderkey % 20 AS day, CASE o_orderstatus WHEN 'F' THEN 'OR' WHEN 'O' THEN 'OD' ELSE 'HC' END AS condition, CASE WHEN o_orderkey % 3 = 0 THEN 'RGS' END AS treatment, o_orderkey % 5 AS trial FROM orders)", "SELECT * FROM nm", "o_orderkey rat day trial"))
def _(t):
    key = F.col("o_orderkey")
    cond = F.when(F.col("o_orderstatus") == "F", "OR").when(F.col("o_orderstatus") == "O", "OD").otherwise("HC")
    name = F.concat(F.lit("Rat"), "o_custkey", F.lit("_SD"), key % 20, F.lit("_"), cond,
                    F.when(key % 3 == 0, "_RGS").otherwise(""), F.lit("_posttrial"), key % 5)
    rows = t.orders.select("o_orderkey", name.alias("name"))
    return fin(rows.withColumns(S.recording_parts(F.col("name"))))


@query("group_digits", "F-12", out("", "SELECT o_orderkey, CAST(substr(CAST(o_custkey AS VARCHAR), 1, 1) AS INT) AS grp FROM orders", "o_orderkey grp"))
def _(t):
    return fin(t.orders.select("o_orderkey", S.group_digit("o_custkey").alias("grp")))


SPEC = "sp AS (SELECT p_partkey, 'EEG' || p_size || CASE WHEN p_partkey % 2 = 0 THEN '==eeg' ELSE '' END || CASE WHEN p_brand = 'Brand#1' THEN '++EOG1==EOG ++EMG' ELSE '' END AS spec FROM part)"


@query("channel_specs", "F-13 F-14", out(SPEC + ", ex AS (SELECT p_partkey, spec, contains(spec, '++') AS grouped, unnest(string_split(spec, '++')) AS c, unnest(range(len(string_split(spec, '++')))) AS \"position\" FROM sp)", "SELECT p_partkey, spec, CASE WHEN grouped THEN 1 ELSE 0 END AS grouped, \"position\", trim(string_split(c, '==')[1]) AS channel, upper(trim(string_split(c, '==')[2])) AS type FROM ex", "p_partkey grouped position"))
def _(t):
    return fin(X.parse_channel_spec(_specs(t)))


def _specs(t):
    spec = F.concat(F.lit("EEG"), "p_size", F.when(F.col("p_partkey") % 2 == 0, "==eeg").otherwise(""),
                    F.when(F.col("p_brand") == "Brand#1", "++EOG1==EOG ++EMG").otherwise(""))
    return t.part.select("p_partkey", spec.alias("spec"))


@query("mixed_channel_specs", "F-13", out("", "SELECT p_size FROM part GROUP BY 1 HAVING min(CAST(p_brand = 'Brand#1' AS INT)) <> max(CAST(p_brand = 'Brand#1' AS INT))", "p_size"))
def _(t):
    parsed = X.parse_channel_spec(_specs(t)).join(t.part.select("p_partkey", "p_size"), "p_partkey")
    return fin(X.mixed_specs(parsed, ["p_size"]))


@query("padded_suffix", "F-15", out("", "SELECT s_suppkey, 'TR0' || (s_suppkey // 10 * 10 + s_suppkey % 10) AS name, 'TR' || CASE WHEN s_suppkey < 10 THEN '0' || s_suppkey ELSE CAST(s_suppkey AS VARCHAR) END AS padded FROM supplier", "s_suppkey"))
def _(t):
    name = F.concat(F.lit("TR0"), "s_suppkey")
    return fin(t.supplier.select("s_suppkey", name.alias("name"), S.pad_suffix(name).alias("padded")))


@query("argmax_scores", "F-17 F-18", out(VOT, "SELECT study_id, epoch_idx, list_position([s0,s1,s2,s3,s4], list_max([s0,s1,s2,s3,s4])) - 1 AS best, list_max([s0,s1,s2,s3,s4]) AS top, CASE WHEN list_max([s0,s1,s2,s3,s4]) >= 9 THEN pred END AS sure FROM vot", "study_id epoch_idx best sure", "top"))
def _(t):
    v = votes(t)
    return fin(v.select("study_id", "epoch_idx", S.argmax("scores").alias("best"), F.array_max("scores").alias("top"),
                        F.when(F.array_max("scores") >= 9, F.col("pred")).alias("sure")))


@query("one_hot_and_mix", "F-19 F-20", out(LAB, "SELECT recording_id, epoch_idx, " + ", ".join(f"0.9 * CASE WHEN stage = {c} THEN 1 ELSE 0 END + 0.1 / 5 AS y{c}" for c in range(5)) + " FROM lab", "recording_id epoch_idx", "y0 y1 y2 y3 y4"))
def _(t):
    y = epoch_labels(t).withColumn("y", S.mix_labels(S.one_hot("stage", 5), 0.1, 5))
    return fin(y.select("recording_id", "epoch_idx", *[F.col("y")[c].alias(f"y{c}") for c in range(5)]))


@query("serial_days", "F-21 IO-22", out("", "SELECT event_id, epoch_us(TIMESTAMP '2020-01-01') // 1000000 + event_id * 30 AS at FROM events", "event_id at"))
def _(t):
    day = F.col("event_id") * 30.0 / 86400.0
    at = S.serial_day(day, 1577836800.0)
    return fin(t.events.select("event_id", F.round(at.cast("double")).cast("long").alias("at")))


@query("json_options", "F-22", out("", "SELECT event_id, CAST(regexp_extract(props, '\"k\": *([0-9]+)', 1) AS BIGINT) AS k FROM events", "event_id k"))
def _(t):
    schema = T.StructType([T.StructField("k", T.LongType())])
    return fin(t.events.select("event_id", F.from_json("props", schema)["k"].alias("k")))


@query("map_default", "F-23", out("", "SELECT event_id, CASE event_type WHEN 'view' THEN 'W' WHEN 'click' THEN 'N1' ELSE 'unknown' END AS name FROM events", "event_id"))
def _(t):
    return fin(t.events.select("event_id", S.lookup({"view": "W", "click": "N1"}, "event_type", "unknown").alias("name")))


@query("sign_over_slope", "F-24", out(SIG, "SELECT recording_id, sample_idx, sign(v - 40) / nullif(k - 50, 0) AS x FROM sig", "recording_id sample_idx", "x"))
def _(t):
    return fin(signal(t).select("recording_id", "sample_idx", S.sign_over_slope(F.col("v") - 40, F.col("k") - 50).alias("x")))


@query("dominant_class", "F-25", out("", "SELECT l_orderkey, l_partkey, CASE WHEN l_discount > l_tax THEN 'discount' WHEN l_tax > l_discount THEN 'tax' ELSE 'mixed' END AS rule FROM lineitem", "l_orderkey l_partkey"))
def _(t):
    return fin(t.lineitem.select("l_orderkey", "l_partkey", S.dominant(
        {"discount": F.col("l_discount"), "tax": F.col("l_tax")}).alias("rule")))


def _channel_scaler(name, a, b):
    @query(f"scale_channels_{name}", "D-15 X-06", out(SAMP + f", q AS (SELECT recording_id, channel, {a} AS a, {b} AS b FROM samp GROUP BY 1, 2)", "SELECT s.recording_id, s.channel, sample_idx, (value - a) / CASE WHEN b = 0 THEN 1 ELSE b END AS value FROM samp s JOIN q ON s.recording_id = q.recording_id AND s.channel = q.channel", "recording_id sample_idx", "value"))
    def _(t):
        return fin(SC.scale_channels(samples(t), ["recording_id", "channel"], "sample_idx", scaler=name))


_channel_scaler("RobustScaler", "quantile_cont(value, 0.5)", "quantile_cont(value, 0.75) - quantile_cont(value, 0.25)")
_channel_scaler("StandardScaler", "avg(value)", "stddev_pop(value)")
_channel_scaler("MinMaxScaler", "min(value)", "max(value) - min(value)")
_channel_scaler("MaxAbsScaler", "0", "max(abs(value))")


@query("scale_channels_QuantileTransformer", "D-15 X-06", out(SAMP, "SELECT recording_id, channel, sample_idx, (rank() OVER w - 1 + (count(*) OVER (PARTITION BY recording_id, channel, value) - 1) / 2.0) / greatest(count(*) OVER (PARTITION BY recording_id, channel) - 1, 1) AS value FROM samp WINDOW w AS (PARTITION BY recording_id, channel ORDER BY value)", "recording_id sample_idx", "value"))
def _(t):
    return fin(SC.scale_channels(samples(t), ["recording_id", "channel"], "sample_idx", scaler="QuantileTransformer"))


@query("scale_sequences", "D-16", out(SAMP + f", sq AS (SELECT *, sample_idx // {EPOCH} AS seq FROM samp), q AS (SELECT recording_id, channel, seq, quantile_cont(value, 0.5) AS a, quantile_cont(value, 0.75) - quantile_cont(value, 0.25) AS b FROM sq GROUP BY 1, 2, 3)", "SELECT s.recording_id, s.channel, s.seq, sample_idx, (value - a) / CASE WHEN b = 0 THEN 1 ELSE b END AS value FROM sq s JOIN q ON s.recording_id = q.recording_id AND s.channel = q.channel AND s.seq = q.seq", "recording_id seq sample_idx", "value"))
def _(t):
    rows = samples(t).withColumn("seq", F.floor(F.col("sample_idx") / EPOCH))
    return fin(SC.scale_channels(rows, ["recording_id", "channel", "seq"], "sample_idx"))
