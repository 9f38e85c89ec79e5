"""Hand-worked cases: ties, borders, absent classes, known numbers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somnia.functions import scalar as S
from somnia.functions.registry import STRIPS, apply_named, register
from somnia.operators import epochs as E, evaluate as V, graph as G, intervals as I, latent as L, model as M, order as O, project as P, scaling as SC
from somnia.sources import catalog as C, store, text as X


def rows(df, *cols):
    return [tuple(r) for r in df.orderBy(*cols).collect()]


def test_mode_ties_take_the_smallest(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([3, 1, 3, 1])], "rec int, i long, stage int")
    assert rows(E.epoch_mode(df, ["rec"], "i", 4), "rec") == [(0, 0, 1)]
    assert rows(V.hard_vote(df.withColumnRenamed("stage", "pred"), ["rec"]), "rec") == [(0, 1)]


def test_runs(spark):
    df = spark.createDataFrame([(0, i, v) for i, v in enumerate([0, 1, 1, 0, 1])], "rec int, i long, v int")
    assert rows(I.runs(df, ["rec"], "i", F.col("v") == 1), "start") == [(0, 1, 2), (0, 4, 4)]


def test_merge_intervals(spark):
    df = spark.createDataFrame([(0, 0.0, 2.0), (0, 2.0, 3.0), (0, 5.0, 6.0), (1, 0.0, 10.0), (1, 1.0, 2.0), (1, 9.0, 12.0)],
                               "rec int, start double, end double")
    for span in (1.0, 100.0):
        assert rows(I.merge_intervals(df, ["rec"], span=span), "rec", "start") == [(0, 0, 3), (0, 5, 6), (1, 0, 12)]
        strict = rows(I.merge_intervals(df, ["rec"], strict=True, span=span).where("rec = 0"), "start")
        assert strict == [(0, 0, 2), (0, 2, 3), (0, 5, 6)]


def test_smoothing_pads_with_zeros(spark):
    df = spark.createDataFrame([(0, i, 1.0) for i in range(6)], "rec int, i long, x double")
    once = [r.x for r in E.smooth(df, ["rec"], "i", ["x"], times=1).orderBy("i").collect()]
    np.testing.assert_allclose(once, [0.6, 0.8, 1, 1, 0.8, 0.6])


def test_transition_example(spark):
    path = list("ABBCBADDABAD")
    df = spark.createDataFrame(list(enumerate(path)), "epoch_id long, latent_id string")
    counts = L.transitions(df, [], chunk=4)
    assert {(r.src, r.dst): r.n for r in counts.collect()} == {
        ("A", "B"): 2, ("A", "D"): 2, ("B", "A"): 2, ("B", "B"): 1, ("B", "C"): 1, ("C", "B"): 1, ("D", "A"): 1, ("D", "D"): 1}
    shares = L.transition_shares(counts)
    assert all(abs(r.p - 1) < 1e-12 for r in shares.groupBy("src").agg(F.sum("prob").alias("p")).collect())
    assert dict(rows(G.degrees(shares), "node")) == {"A": 2, "B": 4, "C": 1, "D": 3}


def test_file_grouping(spark):
    files = spark.createDataFrame([("FILE_1_1",), ("FILE_1_2",), ("FILE_2_1",), ("OTHER",)], "path string")
    got = {r.path: (r.subject, r.n_files, r.ok) for r in C.group_by_subject(files, r"FILE_(\d+)_").collect()}
    assert got == {"FILE_1_1": ("1", 2, True), "FILE_1_2": ("1", 2, True), "FILE_2_1": ("2", 1, True), "OTHER": ("", 1, False)}


def test_absent_class(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1)], "true int, pred int")
    cc = V.class_counts(V.confusion(df), [0, 1, 2])
    got = {r["class"]: r for r in V.class_scores(V.class_kappa(V.class_dice(cc))).collect()}
    assert got[2].dice == 1 and got[2].kappa is None and got[2].f1 == 0
    assert got[0].precision == 1 and got[0].recall == 0.5
    rest = {r["class"]: r for r in V.one_vs_rest(cc).collect()}
    assert rest[2].precision is None and rest[2].accuracy == 1


def test_wake_trim_end_is_exclusive(spark):
    true = [0, 0, 0, 2, 2, 0, 0, 0]
    df = spark.createDataFrame([("a", i, s, 0) for i, s in enumerate(true)] + [("b", 0, 0, 0), ("b", 1, 0, 1)],
                               "study_id string, idx long, true int, pred int")
    got = rows(P.wake_trim(df, 1, 60, chunk=3).select("study_id", "idx"), "study_id", "idx")
    assert got == [("a", 2), ("a", 3), ("a", 4), ("b", 0), ("b", 1)]


def test_published_scaling_numbers(spark):
    """Scaled means follow from the published minimum, maximum and mean of ten features."""
    lo = [0.06391711, 0.05345405, 0.05529967, 0.06842954, 0.05, 0.08800578, 0.05, 0.0204, 0.05314069, 0.02058258]
    hi = [0.96249, 1.0, 0.9443975, 0.9799507, 1.0, 1.0, 1.0, 0.8002132, 1.0, 0.8891308]
    mean = [0.5938795, 0.44995108, 0.40374973, 0.6366637, 0.4386411, 0.5208334, 0.47898516, 0.10254367, 0.24854186, 0.16247807]
    want = [0.8978295, -0.81111586, -1.0808628, 1.23391, -0.90904826, -0.2540471, -0.48437023, -3.9466171, -2.936321, -3.3662522]
    names = [f"f{i}" for i in range(10)]
    stats = spark.createDataFrame([tuple(x for t in zip(lo, hi, mean, [1.0] * 10) for x in t) + (0.0, 1.0)],
                                  ", ".join(f"min_{n} double, max_{n} double, mean_{n} double, std_{n} double" for n in names)
                                  + ", min_all double, max_all double")
    df = spark.createDataFrame([tuple(mean), tuple(lo), tuple(hi)], ", ".join(f"{n} double" for n in names))
    out = SC.scale_features(df, names, "single", stats).collect()
    np.testing.assert_allclose(out[0], want, atol=5e-5)  # published from single precision
    assert set(out[1]) == {-5.0} and set(out[2]) == {5.0}


@pytest.mark.parametrize("kind", SC.SCALERS)
def test_unscaling_undoes_scaling(spark, kind):
    df = spark.createDataFrame(pd.DataFrame(np.random.default_rng(2).normal(size=(40, 3)), columns=list("abc")))
    stats = SC.feature_stats(df, list("abc"))
    back = SC.unscale_features(SC.scale_features(df, list("abc"), f"x_{kind}", stats), list("abc"), kind, stats)
    np.testing.assert_allclose(np.sort(back.toPandas(), axis=0), np.sort(df.toPandas(), axis=0), atol=1e-9)


def test_scaler_is_found_by_substring():
    assert [SC.scaler_name(s) for s in ("myglobal", "single_x", "baseZeroCol", "what")] == ["global", "single", "baseZeroCol", "NOscaling"]


def test_entropy_of_known_terms(spark):
    """Stage shares with known entropy terms, whose sum and ratio are published."""
    terms = {"wake": 0.38813084, "nrem": 0.5203285, "rem": 0.1649103}
    assert abs(sum(terms.values()) - 1.0733696669340134) < 1e-6
    assert abs(0.939778682296037 / 1.0733696669340134 - 0.8755405628150763) < 1e-9
    n = {1: 40, 3: 50, 5: 10}
    counts = spark.createDataFrame([(s, s, k) for s, k in n.items()], "latent_id int, stage int, n long")
    got = {r.stage: r for r in L.mutual_information(counts).collect()}
    for s, k in n.items():
        assert abs(got[s].entropy + k / 100 * math.log2(k / 100)) < 1e-12 and abs(got[s].ratio - 1) < 1e-12


def test_information_is_symmetric_and_bounded(spark):
    rng = np.random.default_rng(4)
    pairs = [(int(a), int(b), int(rng.integers(1, 50))) for a in range(6) for b in range(3)]
    a = spark.createDataFrame(pairs, "latent_id int, stage int, n long")
    b = a.select(F.col("stage").alias("latent_id"), F.col("latent_id").alias("stage"), "n")
    ra, rb = L.total_information(a).first(), L.total_information(b).first()
    assert abs(ra.mi - rb.mi) < 1e-9 and 0 <= ra.mi <= min(ra.entropy, rb.entropy)


def test_unmatched_code_scores_minus_one(spark):
    train = spark.createDataFrame([("01", 1, 3), ("01", 1, 3), ("01", 1, 1), ("10", 2, 5)], "code string, latent_id long, stage int")
    fitted = L.fit_state_stages(train)
    test = spark.createDataFrame([(0, "01"), (1, "11"), (2, "10")], "id int, code string")
    assert rows(L.score_states(test, fitted).select("id", "pred"), "id") == [(0, 3), (1, -1), (2, 5)]
    assert rows(L.hypnodensity(test, fitted).select("id", "p_rem"), "id") == [(0, 0.0), (1, None), (2, 1.0)]
    assert rows(L.new_states(test, train), "code") == [("11",)]


def test_last_of_duplicate_keys_wins(spark):
    train = spark.createDataFrame([("1", 1, 3), ("1", 2, 5)], "code string, latent_id long, stage int")
    assert L.fit_state_stages(train).first().stage == 5


def test_majority_ties(spark):
    df = spark.createDataFrame([(0.4, 0.4, 0.2), (0.2, 0.4, 0.4), (0.1, 0.2, 0.7)], "p_wake double, p_nrem double, p_rem double")
    assert [r.m for r in df.select(L.majority_stage(df).alias("m")).collect()] == [1, 3, 5]


def test_small_states_go_to_the_nearest_large_one(spark):
    df = spark.createDataFrame([(1, 50, 1, 0.0), (2, 40, 1, 10.0), (3, 2, 1, 6.0), (4, 2, 1, 5.0), (5, 9, 3, 5.0)],
                               "latent_id long, n_epochs long, stage int, x double")
    out = L.nearest_large(L.mark_large(df), ["x"])
    assert {r.latent_id: r.target for r in out.collect()} == {1: 1, 2: 2, 3: 2, 4: 1, 5: 5}


def test_epoch_sum_repeats_the_last_of_an_odd_series(spark):
    df = spark.createDataFrame([("a", i, float(i)) for i in range(7)] + [("b", i, 1.0) for i in range(6)] + [("c", i, 1.0) for i in range(5)],
                               "rec string, i long, x double")
    assert rows(E.epoch_sum(df, ["rec"], "i", 4, "x"), "rec", "epoch_idx") == [("a", 0, 6.0), ("a", 1, 21.0), ("b", 0, 4.0), ("c", 0, 4.0)]


def test_prefix_average_and_montage(spark):
    df = spark.createDataFrame([("r", c, 0, v) for c, v in [("TB1", 1.0), ("TB2", 3.0), ("EOG1", 5.0), ("Cz", 7.0)]],
                               "recording_id string, channel string, sample_idx long, value double")
    assert {r.channel: r.value for r in E.prefix_average(df, ["EOG1"]).collect()} == {"TB": 2.0, "EOG1": 5.0, "Cz": 7.0}
    assert {r.channel: r.value for r in P.montage(df, ["Cz", "TB2-TB1", "Cz-XX"]).collect()} == {"Cz": 7.0, "TB2-TB1": 2.0}
    with pytest.raises(ValueError):
        P.whole_samples(0.3, 5.5)


def test_gap_filling_and_offsets(spark):
    df = spark.createDataFrame([("r", 60, 30, "W"), ("r", 120, 0, "N1"), ("r", 150, 30, "N2")], "recording_id string, init_sec long, dur_sec long, stage string")
    filled = rows(I.fill_gaps(df, ["recording_id"], "?", 100.0).drop("recording_id"), "init_sec", "dur_sec")
    assert filled == [(60, 30, "W"), (90, 30, "?"), (120, 0, "N1"), (120, 30, "?"), (150, 30, "N2")]
    assert rows(I.remove_offset(df, ["recording_id"]).select("init_sec", "whole_seconds"), "init_sec") == [(0, True), (60, True), (90, True)]
    half = df.withColumn("init_sec", F.col("init_sec") + F.when(F.col("stage") == "N2", 0.5).otherwise(0.0))
    assert half.transform(I.remove_offset, ["recording_id"]).where("NOT whole_seconds").count() == 1


def test_one_class_and_empty_sides(spark):
    empty = spark.createDataFrame([], "rec int, i long, x double")
    assert E.smooth(empty, ["rec"], "i", ["x"]).count() == 0
    assert I.runs(empty, ["rec"], "i", F.col("x") > 0).count() == 0
    flat = spark.createDataFrame([(0, 0, 1.0), (0, 1, 1.0)], "rec int, i long, x double")
    assert [r.z for r in E.zscore(flat, ["rec"], "i", "x").collect()] == [None, None]
    guarded = E.normalise_percentile(flat, ["rec"], "i", ["x"], guarded=True)
    assert [r.x for r in guarded.collect()] == [0.05, 0.05]


def test_named_functions(spark):
    df = spark.createDataFrame([(1,), (2,)], "stage int")
    assert apply_named(df, STRIPS, [("drop_class", {"stage": 1})]).count() == 1
    with pytest.raises(KeyError):
        apply_named(df, STRIPS, [("nothing", {})])
    with pytest.raises(ValueError):
        register(STRIPS, "drop_class")(lambda d: d)


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(0, 1, [0.1])], "epoch_idx long, stage int, scores array<double>")
    with pytest.raises(ValueError):
        X.save_prediction(df, str(tmp_path / "a.hyp"))
    assert X.save_prediction(df, str(tmp_path / "a.npy")) == "parquet"
    assert X.save_prediction(df.drop("scores"), str(tmp_path / "b.hyp"), by=[]) == "hyp"
    assert spark.read.text(str(tmp_path / "b.hyp")).first().value == "N1"


def test_sinks_keep_recordings(spark, tmp_path):
    epochs = [(rec, i, (i + rec) % 3) for rec in (7, 8) for i in range(30)]
    df = spark.createDataFrame(epochs, "recording_id long, epoch_idx long, stage int").repartition(5)
    X.save_prediction(df, str(tmp_path / "a.hyp"))
    for rec in (7, 8):
        files = sorted((tmp_path / "a.hyp" / f"recording_id={rec}").glob("*.txt"))
        lines = [line for f in files for line in f.read_text().splitlines()]
        assert lines == [["W", "N1", "N2"][(i + rec) % 3] for i in range(30)]
    spans = spark.createDataFrame([(7, 0, 30, "W"), (8, 0, 60, "N1"), (8, 60, 30, "W")], "recording_id long, init_sec int, dur_sec int, stage string")
    for kind in ("ids", "tsv"):
        X.save_prediction(spans, str(tmp_path / f"b.{kind}"))
        got = X.READERS[kind](spark, str(tmp_path / f"b.{kind}")).select("recording_id", "init_sec", "dur_sec", "stage")
        assert sorted(map(tuple, got.collect())) == [(7, 0, 30, "W"), (8, 0, 60, "N1"), (8, 60, 30, "W")]


def test_sinks_spread_recordings_over_tasks(spark, tmp_path):
    """Many small recordings: their files are made by several tasks, however few bytes they hold."""
    spans = spark.range(900).selectExpr("CASE WHEN id >= 450 THEN id - 449 END AS recording_id", "id AS init_sec", "30 AS dur_sec", "'W' AS stage")
    X.save_prediction(spans, str(tmp_path / "a.ids"))
    files = list((tmp_path / "a.ids").glob("*/*.csv"))
    assert len({f.name.split("-")[1] for f in files}) >= 3 and len({f.parent for f in files}) == 451
    got = X.read_intervals(spark, str(tmp_path / "a.ids")).select("recording_id", "init_sec", "dur_sec", "stage")
    assert sorted((r or 0, *x) for r, *x in got.collect()) == [(max(i - 449, 0), i, 30, "W") for i in range(900)]


def test_sinks_make_files_as_spark_would(spark, tmp_path):
    """Folder names, quoting, headers and order are those of Spark's writer, without a process started for each file."""
    import os
    odd = ["a b", "x=1/2", "50%", "", "7", "q'\"[{^", "a:b?", "\u00fc\t", "\x7f"]
    rows = [(r, 10 * i, 30, s) for r in odd for i, s in enumerate(["W", 'say "N1", ', "", None, " pad ", "tab\tbed"])]
    spans = spark.createDataFrame(rows, "recording_id string, init_sec long, dur_sec long, stage string").repartition(4)
    for kind, options, columns in (("ids", {"header": False}, ["init_sec", "dur_sec", "stage"]), ("tsv", {"header": True, "sep": "\t"}, ["init_sec", "dur_sec AS duration_sec", "stage"])):
        X.save_prediction(spans, str(tmp_path / f"a.{kind}"))
        spans.selectExpr("recording_id", *columns).repartition(1).sortWithinPartitions("recording_id", "init_sec").write.partitionBy("recording_id").options(**options).csv(str(tmp_path / f"b.{kind}"))
        texts = lambda top: {f.parent.name: f.read_bytes() for f in top.glob("*/part-*.csv")}
        assert texts(tmp_path / f"a.{kind}") == texts(tmp_path / f"b.{kind}") and len(texts(tmp_path / f"a.{kind}")) == len(odd)
        assert (tmp_path / f"a.{kind}" / "_SUCCESS").exists() and not [f for f in (tmp_path / f"a.{kind}").rglob(".part-*") if not f.name.endswith(".crc")]
        X.save_prediction(spans.where("recording_id = '7'"), str(tmp_path / f"a.{kind}"))  # replaces what was there
        assert [f.name for f in (tmp_path / f"a.{kind}").glob("*=*")] == ["recording_id=7"]
    assert spark.conf.get("spark.sql.sources.parallelPartitionDiscovery.parallelism") == "10000"
    two = spark.createDataFrame([(a, b, i, 30, "W") for i, (a, b) in enumerate([(None, 1), ("", 1), (None, 2), ("", 2), ("x", 1)])], "a string, b int, init_sec long, dur_sec long, stage string")
    X.save_prediction(two, str(tmp_path / "e.ids"), by=["a", "b"])
    assert sorted((r.a, r.b, r.init_sec) for r in X.read_intervals(spark, str(tmp_path / "e.ids")).na.fill("-", ["a"]).collect()) == [("-", 1, 0), ("-", 1, 1), ("-", 2, 2), ("-", 2, 3), ("x", 1, 4)]
    started = lambda: int(next(x for x in open("/proc/stat") if x.startswith("processes")).split()[1])
    many = spark.range(2000).selectExpr("id AS recording_id", "id AS init_sec", "30 AS dur_sec", "'W' AS stage")
    X.save_prediction(many, str(tmp_path / "c.ids"))  # workers are up
    before = started()
    X.save_prediction(many, str(tmp_path / "d.ids"))
    assert started() - before < 2000 and len(os.listdir(tmp_path / "d.ids")) == 2000 + 2  # and the marker with its checksum


def test_labels_outside_the_classes_are_an_error(spark):
    df = spark.createDataFrame([(0, i, s) for i, s in enumerate([9, 9, 1, None])], "rec int, i long, stage int")
    with pytest.raises(Exception, match="label 9 is not among"):
        E.epoch_mode(df, ["rec"], "i", 4, classes=[0, 1]).collect()
    assert rows(E.epoch_mode(df, ["rec"], "i", 4, classes=[0, 1, 9]), "rec") == [(0, 0, 9)]


def test_positions_and_crops_split_a_recording(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = spark.range(1000).select(F.lit(0).alias("g"), F.lit(1).alias("rec"), F.col("id").alias("i"), F.col("id").cast("double").alias("s"))
        assert rows(O.positions(df, "g", "rec", "i", 64).select("i", "position"), "i") == [(i, i) for i in range(1000)]
        assert [r.i for r in P.trim_ends(df, ["rec"], "s", 100.0).orderBy("i").collect()] == list(range(100, 900))
        notes = spark.createDataFrame([(1, float(x)) for x in (0, 300, 500, 990)], "rec int, onset double")
        assert [r.i for r in P.crop_to_annotations(df, notes, ["rec"], "s", 50.0).orderBy("i").collect()] == list(range(250, 551))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_forest_keeps_rows_without_features(spark):
    df = spark.createDataFrame([(i, float(i % 2), None if i == 5 else 1.0, i % 2) for i in range(40)], "i int, a double, b double, y int")
    got = M.forest_predict(M.train_forest(df, ["a", "b"], "y", trees=5), df, ["a", "b"]).toPandas().set_index("i")
    assert len(got) == 40 and np.isnan(got.pred[5])
    assert (got.pred.drop(5) == got.y.drop(5)).all()


def test_name_and_length_checks(spark):
    df = spark.createDataFrame([(0, "a"), (1, "b")], "pos int, name string")
    with pytest.raises(Exception, match="number of names"):
        X.rename_by_position(df, "pos", ["x"]).collect()
    assert rows(store.check_single_rate(spark.createDataFrame([("a", 1), ("a", 1), ("b", 1), ("b", 2)], "recording_id string, fs int")), "recording_id") == [
        ("a", 1, 1, True), ("b", 1, 2, False)]


def test_recording_name_parts(spark):
    df = spark.createDataFrame([("Rat3_SD4_OR_RGS_posttrial5",), ("Rat12_SD1_HC_posttrial2",)], "n string")
    got = [tuple(r) for r in df.select(*[c.alias(k) for k, c in S.recording_parts(F.col("n")).items()]).collect()]
    assert got == [(3, 4, "OR", "RGS", 5), (12, 1, "HC", None, 2)]


def test_flat_and_single_samples_give_null_not_errors(spark):
    flat = spark.createDataFrame([(0, i, 1.0, float(i)) for i in range(9)] + [(1, 0, 3.0, 4.0)], "rec int, i long, a double, b double")
    assert [r["corr"] for r in E.windowed_correlation(flat, ["rec"], "i", 2, "a", "b").collect()] == [None] * 3
    masked = E.artefact_mask(flat, ["rec"], "i", "a", 4.0).collect()
    assert len(masked) == 10 and not any(r.artefact for r in masked)
    assert E.norm_to_range(flat, ["rec"], "i", "a").where("a IS NULL").count() == 10
    assert E.detrend(flat, ["rec"], "i", 4, "b").count() == 10
    assert SC.scale_channels(flat, ["rec"], "i", "a").where("a = 0").count() == 10


def test_stage_texts(spark):
    df = spark.createDataFrame([("a", "Sleep stage 4"), ("a", "Sleep stage 3"), ("a", "other"), ("b", "Sleep stage R")], "dataset string, description string")
    got = {(r.dataset, r.description): r.stage for r in P.stage_from_text(df, P.stage_map(spark, "a")).collect()}
    assert got == {("a", "Sleep stage 4"): 3, ("a", "Sleep stage 3"): 3, ("a", "other"): None, ("b", "Sleep stage R"): None}
