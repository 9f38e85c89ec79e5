"""Queries: reading, writing, listing and linking recordings."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.functions.registry import READERS
from somnia.session import shared_dir
from somnia.sources import catalog as C, store as S, text as X
from .proxies import HYP, LAB, PAI, SAMP, SIG, VEC, VECTOR, epoch_labels, feature_vectors, fin, hypnogram, out, pairs, samples, signal
from .registry import query

BLOCK = 64  # samples per line


def _lines(t):
    """Signal text: one line per recording, channel and block of samples."""
    at = F.struct("sample_idx", F.col("value").cast("string").alias("x"))
    rows = samples(t).groupBy("recording_id", "channel", F.floor(F.col("sample_idx") / BLOCK).alias("block")).agg(
        F.sort_array(F.collect_list(at)).alias("f"))
    return rows.select("recording_id", "block", F.concat_ws(" ", "channel", F.concat_ws(" ", "f.x")).alias("value"))


@query("parse_signal_text", "IO-01", out(SAMP, f"SELECT recording_id, sample_idx // {BLOCK} AS block, channel, sample_idx % {BLOCK} AS sample_idx, value FROM samp", "recording_id block sample_idx", "value"))
def _(t):
    return fin(X.parse_signal(_lines(t), ["recording_id", "block"]))


@query("read_signal_files", "IO-01", out(SAMP, "SELECT channel, count(*) AS n, sum(value) AS total FROM samp GROUP BY 1", "n", "total"))
def _(t):
    path = shared_dir(t.spark)
    _lines(t).select("value").write.text(path)
    rows = X.read_signal(t.spark, path)
    return fin(rows.groupBy("channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("header_values", "IO-02", out("", "SELECT page_id, 'rec' || page_id || '.eeg' AS \"DataFile\", url AS \"MarkerFile\" FROM pages", "page_id"))
def _(t):
    lines = t.pages.select("page_id", F.explode(F.array(
        F.concat(F.lit("DataFile=rec"), "page_id", F.lit(".eeg")), F.concat(F.lit("MarkerFile="), "url"),
        F.lit("; a comment"))).alias("value"))
    return fin(X.header_values(lines, ["page_id"], ["DataFile", "MarkerFile"]))


def _dataset(col):
    return F.concat(F.lit("d"), (F.col(col) % 4).cast("string"))


@query("sample_store", "IO-03 IO-09", out(SAMP, "SELECT 'd' || (recording_id % 4) AS dataset, recording_id, channel, count(*) AS n, sum(value) AS total FROM samp WHERE channel = 'v' GROUP BY 1, 2, 3", "recording_id n", "total"))
def _(t):
    path = shared_dir(t.spark)
    S.write_samples(samples(t).withColumn("dataset", _dataset("recording_id")), path, ["dataset", "channel"])
    rows = t.spark.read.parquet(path).where("channel = 'v'")
    return fin(rows.groupBy("dataset", "recording_id", "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")))


@query("recording_triplets", "IO-04", out("f AS (SELECT o_custkey, CASE o_orderstatus WHEN 'F' THEN 'HPC' WHEN 'O' THEN 'PFC' ELSE 'states' END AS kind, 'lfp/Rat' || o_custkey || '_' || CASE o_orderstatus WHEN 'F' THEN 'HPC' WHEN 'O' THEN 'PFC' ELSE 'states' END || '.mat' AS path FROM orders)", "SELECT 'Rat' || o_custkey AS trial, max(path) FILTER (kind = 'HPC') AS hpc, max(path) FILTER (kind = 'PFC') AS pfc, max(path) FILTER (kind = 'states') AS states FROM f GROUP BY 1"))
def _(t):
    kind = F.when(F.col("o_orderstatus") == "F", "HPC").when(F.col("o_orderstatus") == "O", "PFC").otherwise("states")
    files = t.orders.select(F.concat(F.lit("lfp/Rat"), "o_custkey", F.lit("_"), kind, F.lit(".mat")).alias("path"))
    return fin(C.recording_triplets(files))


PRT = SIG + ", prt AS (SELECT recording_id % 50 AS subject, recording_id // 50 AS part, sample_idx, v FROM sig)"


@query("stitch_parts", "IO-05", out(PRT, "SELECT subject, part, sample_idx, v, row_number() OVER (PARTITION BY subject ORDER BY part, sample_idx) - 1 AS stitched_idx FROM prt", "subject part sample_idx stitched_idx", "v"))
def _(t):
    rows = signal(t).select((F.col("recording_id") % 50).alias("subject"), F.floor(F.col("recording_id") / 50).alias("part"), "sample_idx", "v")
    return fin(S.stitch(rows, ["subject"], "part"))


@query("feature_store", "IO-06 IO-09 P-05", out(LAB, "SELECT 'd' || (recording_id % 4) AS dataset, recording_id AS subject, epoch_idx, stage FROM lab WHERE recording_id % 4 IN (1, 2) AND stage IN (1, 3)", "subject epoch_idx stage"))
def _(t):
    path = shared_dir(t.spark)
    rows = epoch_labels(t).select(_dataset("recording_id").alias("dataset"), (F.col("recording_id")).alias("subject"), "epoch_idx", "stage")
    S.write_features(rows.repartition("dataset"), path, {"stage": "0 W, 1 N1, 2 N2, 3 N3, 4 REM"}, partitions=["dataset"])
    return fin(S.read_features(t.spark, path, ["d1", "d2"], stages=[1, 3]).select("dataset", "subject", "epoch_idx", "stage"))


@query("prediction_store", "IO-16", out(PAI, "SELECT n_name AS dataset, study_id, idx, true_ AS \"true\", pred FROM pai JOIN supplier ON s_suppkey = study_id JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_2', 'NATION_9', 'NATION_15')", "study_id idx true pred"))
def _(t):
    path = shared_dir(t.spark)
    where = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_suppkey").alias("study_id"), F.col("n_name").alias("dataset"))
    S.write_predictions(pairs(t).join(where, "study_id"), path)
    rows = S.read_features(t.spark, path, ["NATION_2", "NATION_9", "NATION_15"])
    return fin(rows.select("dataset", "study_id", "idx", "true", "pred"))


@query("class_index", "IO-08", out(LAB, "SELECT recording_id AS study_id, stage, epoch_idx, row_number() OVER (PARTITION BY recording_id, stage ORDER BY epoch_idx) - 1 AS pos FROM lab", "study_id stage epoch_idx pos"))
def _(t):
    return fin(S.class_index(epoch_labels(t).withColumnRenamed("recording_id", "study_id")))


def _interval_files(kind):
    @query(f"intervals_{kind}", "IO-10 IO-12 X-04", out(HYP, "SELECT recording_id, init_sec, dur_sec, stage FROM hyp", "recording_id init_sec dur_sec"))
    def _(t):
        path = f"{shared_dir(t.spark)}/hypnogram.{kind}"
        X.save_prediction(hypnogram(t), path)
        return fin(READERS[kind](t.spark, path).select("recording_id", "init_sec", "dur_sec", "stage"))


for _kind in ("ids", "tsv", "parquet"):
    _interval_files(_kind)


@query("stage_lines", "IO-11 IO-12", out(LAB, "SELECT recording_id, CASE stage WHEN 0 THEN 'W' WHEN 1 THEN 'N1' WHEN 2 THEN 'N2' WHEN 3 THEN 'N3' WHEN 4 THEN 'REM' END AS value FROM lab", "recording_id"))
def _(t):
    path = f"{shared_dir(t.spark)}/stages.hyp"
    X.save_prediction(epoch_labels(t), path)
    return fin(t.spark.read.text(path).select("recording_id", "value"))


ELE = "ele AS (SELECT s_suppkey, s_name || ',' || s_acctbal || ',' || s_nationkey || ',' || (s_suppkey * 0.5) || ',extra' AS value, s_name, s_acctbal, s_nationkey FROM supplier)"


@query("electrodes", "IO-13", out(ELE, "SELECT s_suppkey, s_name AS name, s_acctbal / 1000 AS x, s_nationkey / 1000 AS y, s_suppkey * 0.5 / 1000 AS z FROM ele", "s_suppkey", "x y z"))
def _(t):
    line = F.concat_ws(",", "s_name", F.col("s_acctbal").cast("string"), F.col("s_nationkey").cast("string"), (F.col("s_suppkey") * 0.5).cast("string"), F.lit("extra"))
    return fin(X.parse_electrodes(t.supplier.select("s_suppkey", line.alias("value")), to_metres=True))


@query("electrode_names", "IO-13", out("", "SELECT n_nationkey, 'E' || n_nationkey AS name FROM nation", "n_nationkey"))
def _(t):
    return fin(X.rename_by_position(t.nation.select("n_nationkey", F.col("n_name").alias("name")), "n_nationkey", [f"E{i}" for i in range(25)]))


@query("metric_tables", "IO-14 IO-15", out("", """SELECT c_mktsegment AS "row", round_even(avg(c_acctbal) * 1000, 0) / 1000 AS bal, NULL::DOUBLE AS price FROM customer WHERE c_mktsegment <> 'BUILDING' GROUP BY 1
 UNION ALL SELECT o_orderstatus, NULL, round_even(avg(o_totalprice) * 1000, 0) / 1000 FROM orders GROUP BY 1""", "", "bal price"))
def _(t):
    a, b = shared_dir(t.spark), shared_dir(t.spark)
    three = lambda c: F.rint(F.avg(c) * 1000) / 1000
    X.write_evaluation(t.customer.groupBy("c_mktsegment").agg(three("c_acctbal").alias("bal"), F.count(F.lit(1)).alias("n")), a)
    X.write_evaluation(t.orders.groupBy("o_orderstatus").agg(three("o_totalprice").alias("price")), b)
    return fin(X.read_metric_tables(t.spark, [f"{a}/csv", f"{b}/csv"], ["BUILDING"], ["n"]))


@query("pending_work", "IO-17", out("", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)", "doc_id"))
def _(t):
    return fin(S.pending(t.documents.select("doc_id", "lang"), t.labels, ["doc_id"]))


# Datasets named in the settings.
REGIONS = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("dataset_registry", "IO-19", out("r AS (SELECT r_name AS dataset, unnest(['train', 'val']) AS part, unnest(['tr', 'va']) AS sub FROM region)", "SELECT r.dataset, part, '/data/' || lower(r.dataset) || '/' || sub AS path, 30 AS period_sec, 'RobustScaler' AS scaler, count(*) AS n_studies FROM r JOIN region ON r_name = dataset JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL", "n_studies", "period_sec"))
def _(t):
    reg = C.dataset_paths(t.spark, {n: {"data_dir": f"/data/{n.lower()}/", "parts": {"train": "tr", "val": "va"}} for n in REGIONS})
    studies = (t.customer.join(t.nation, F.col("c_nationkey") == F.col("n_nationkey")).join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
               .groupBy(F.col("r_name").alias("dataset")).agg(F.count(F.lit(1)).alias("n_studies")))
    return fin(reg.join(studies, "dataset").select("dataset", "part", "path", "period_sec", "scaler", "n_studies"))


@query("channel_inventory", "IO-20", out("c AS (SELECT o_custkey, CASE substr(o_orderpriority, 1, 1) WHEN '5' THEN 'EOG1' WHEN '1' THEN 'EKG' WHEN '2' THEN 'TBAR' WHEN '3' THEN 'C3' ELSE 'ZX' END AS channel FROM orders)", "SELECT channel, count(DISTINCT o_custkey) AS n_recordings, CASE channel WHEN 'EOG1' THEN 'eog' ELSE 'eeg' END AS type FROM c WHERE channel IN ('EOG1', 'TBAR', 'C3') GROUP BY 1", "n_recordings"))
def _(t):
    from .project import channels
    return fin(C.channel_inventory(channels(t), ["EEG", "EOG"]))


@query("single_rate_check", "IO-21", out("", "SELECT l_suppkey AS recording_id, min(l_linenumber) AS fs, count(DISTINCT l_linenumber) AS n_rates, CASE WHEN count(DISTINCT l_linenumber) = 1 THEN 1 ELSE 0 END AS ok FROM lineitem GROUP BY 1", "recording_id fs n_rates ok"))
def _(t):
    return fin(S.check_single_rate(t.lineitem.select(F.col("l_suppkey").alias("recording_id"), F.col("l_linenumber").alias("fs"))))


@query("model_input", "IO-22 W-22", out(VEC, "SELECT vec_id, label, row_number() OVER (ORDER BY vec_id) - 1 AS id, 1 AS mode, 737000.5 + (row_number() OVER (ORDER BY vec_id) - 1) * (2 / 86400.0) AS serial_day, f0 FROM vec", "vec_id label id mode", "serial_day f0"))
def _(t):
    return fin(S.model_input(feature_vectors(t), "vec_id", 737000.5, 2.0).select("vec_id", "label", "id", "mode", "serial_day", "f0"))


@query("statistics_files", "IO-23 A-06", out(VEC, "SELECT min(f0) AS min_f0, max(f0) AS max_f0, avg(f0) AS mean_f0, stddev_pop(f0) AS std_f0 FROM vec", "", "min_f0 max_f0 mean_f0 std_f0"))
def _(t):
    from somnia.operators.scaling import feature_stats
    path = shared_dir(t.spark)
    X.write_statistics(feature_stats(feature_vectors(t), VECTOR), path)
    names = ["min_f0", "max_f0", "mean_f0", "std_f0"]
    return fin(t.spark.read.schema(", ".join(f"{n} double" for n in names)).json(path))


GIVEN = ["documents", "events", "lineitem", "orders"]


@query("file_listing", "IO-04", "SELECT table_name AS name, 'parquet' AS kind, CAST(1 AS BIGINT) AS has_data FROM information_schema.tables WHERE table_name IN (" + ", ".join(f"'{n}'" for n in GIVEN) + ")")
def _(t):
    """Which of four given tables lie in the folder, as one file or as a folder of parts, and whether they hold bytes."""
    files = C.list_files(t.spark, t.folder, "*.parquet")
    named = files.select(F.regexp_extract("path", r"/([a-z]+)\.([a-z]+)(/[^/]*)?$", 1).alias("name"), F.regexp_extract("path", r"/([a-z]+)\.([a-z]+)(/[^/]*)?$", 2).alias("kind"), "length")
    return fin(named.where(F.col("name").isin(GIVEN)).groupBy("name", "kind").agg((F.sum("length") > 0).alias("has_data")))
