"""Components, tests, splits, draws and augmentations."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somnia.operators import model as M, sampling as S
from somnia.session import materialise, shared_dir


def test_pca_matches_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 4)) @ rng.normal(size=(4, 4))
    df = spark.createDataFrame(pd.DataFrame(x, columns=list("abcd")))
    fit = M.fit_pca(df, list("abcd"), whiten=True)
    _, s, vt = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    np.testing.assert_allclose(fit.variance, s ** 2 / 199, rtol=1e-9)
    np.testing.assert_allclose(np.abs(fit.components), np.abs(vt), atol=1e-9)
    scores = M.pca_transform(df, fit)
    assert abs(scores.agg(F.var_samp("pc3")).first()[0] - 1) < 1e-9
    back = M.pca_inverse(scores, fit).select(*"abcd").toPandas().to_numpy()
    np.testing.assert_allclose(np.sort(back, axis=0), np.sort(x, axis=0), atol=1e-9)
    assert abs(fit.explained.sum() - 1) < 1e-12


def test_models_are_kept_and_found_again(spark, tmp_path):
    """Fitted, saved, loaded by another session, used on other rows: the same numbers; versions stay apart."""
    from somnia.operators import scaling as C
    from somnia.sources import models as K
    rng = np.random.default_rng(3)
    x = pd.DataFrame(rng.normal(size=(120, 3)) @ rng.normal(size=(3, 3)), columns=list("abc"))
    df, other = spark.createDataFrame(x), spark.createDataFrame(x * 2 + 1)
    path, calls = f"{tmp_path}/pca", []
    fit = M.fit_pca(df, list("abc"), whiten=True)
    assert K.versions(spark, path) == []
    with pytest.raises(FileNotFoundError):
        K.load_model(spark, path)
    for _ in range(2):
        again = K.load_or_fit(spark.newSession(), path, lambda: calls.append(1) or fit)
    assert len(calls) == 1 and again.features == fit.features and again.whiten
    for part in K.ARRAYS["pca"]:
        np.testing.assert_array_equal(getattr(again, part), getattr(fit, part))
    assert M.pca_transform(other, again).collect() == M.pca_transform(other, fit).collect()
    assert K.save_model(spark, M.fit_pca(other, list("ab")), path) == 2
    assert K.load_model(spark, path).features == ("a", "b") and K.load_model(spark, path, 1).features == ("a", "b", "c")
    for bias in (None, rng.normal(size=3)):
        units = M.HiddenUnits(rng.normal(size=(3, 2)), rng.random((2, 4)), rng.normal(size=4), rng.normal(size=(3, 1)), rng.normal(size=1), bias)
        K.save_model(spark, units, f"{tmp_path}/units")
        read = K.load_model(spark, f"{tmp_path}/units")
        assert (read.bias_vis is None) == (bias is None) and read.n_units == 5
        got, want = (M.hidden_probabilities(other, list("abc"), u, "row").collect() for u in (read, units))
        assert got == want
    K.save_ranges(C.feature_stats(df, list("abc")), f"{tmp_path}/ranges")
    read = C.scale_features(other, list("abc"), "single", K.load_ranges(spark, f"{tmp_path}/ranges"))
    assert read.collect() == C.scale_features(other, list("abc"), "single", C.feature_stats(df, list("abc"))).collect()


@pytest.mark.parametrize("t,dof,p", [(2.2281388519649385, 10, 0.05), (12.706204736432095, 1, 0.05), (0.0, 5, 1.0), (-1.9599639845400545, 1e7, 0.05)])
def test_t_test_p(spark, t, dof, p):
    df = spark.createDataFrame([(float(t), float(dof)), (None, 3.0)], "t double, dof double")
    got = [r.p for r in M.t_test_p(df).collect()]
    assert abs(got[0] - p) < 1e-6 and got[1] is None


def test_channel_pca_finds_the_loud_channel(spark):
    rng = np.random.default_rng(2)
    x = pd.DataFrame(rng.normal(size=(300, 3)) * [1, 9, 1], columns=list("abc"))
    out = M.channel_pca(spark.createDataFrame(x), list("abc"), 2, "none")
    assert [r.channel for r in out.where("top AND component = 1").collect()] == ["b"]


@pytest.mark.parametrize("k,frac", [(5, 0.2), (3, 0.1), (1, 0.25)])
def test_splits_are_disjoint_and_cover(spark, k, frac):
    df = spark.createDataFrame([(i,) for i in range(43)], "s long")
    out = S.split_subjects(df, "s", k, frac, test_fraction=0.2, seed=3).toPandas()
    assert len(out) == 43 * k and out.groupby("split").s.nunique().eq(43).all()
    sizes = out.groupby(["split", "part"]).size().unstack()
    assert (sizes.val == int(np.ceil(43 * frac))).all()
    if k > 1:
        assert sorted(out[out.part == "test"].s) == list(range(43))
        assert sizes.test.tolist() == [len(a) for a in np.array_split(range(43), k)]
    else:
        assert sizes.test.tolist() == [int(np.ceil(43 * 0.2))]


def test_split_without_training_subjects_is_an_error(spark):
    df = spark.createDataFrame([(i,) for i in range(5)], "s long")
    with pytest.raises(Exception, match="no training subjects"):
        S.split_subjects(df, "s", 2, 0.5).collect()


def test_take_random_is_whole_and_repeatable(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).cast("int").alias("k"), "id")
    a = S.take_random(df, ["k"], 100, ["id"], 1).toPandas()
    b = S.take_random(df.repartition(13), ["k"], 100, ["id"], 1).toPandas()
    assert a.groupby("k").size().tolist() == [100, 100] and set(a.id) == set(b.id)
    assert sorted(a[a.k == 0]["rank"]) == list(range(100))
    with pytest.raises(Exception, match="fewer than"):
        S.take_random(df, ["k"], 2000, ["id"], 1, require=True).collect()
    assert S.take_random(df, ["k"], 2000, ["id"], 1).count() == 2000 + 1667


def test_balanced_draws_follow_the_probabilities(spark):
    """Class 1 is rare and one study holds most epochs; neither shows in the draws."""
    rows = [(s, e, int(e % 50 == 0)) for s, n in [(0, 2000), (1, 100), (2, 100)] for e in range(n)]
    ep = spark.createDataFrame(rows, "study_id long, epoch_idx long, stage int")
    out = S.draw_balanced(ep, spark.range(6000).withColumnRenamed("id", "draw"), [0.5, 0.5], 3, 9, chunk=64).toPandas()
    assert len(out) == 6000
    assert abs(out.stage.mean() - 0.5) < 0.03
    assert out.groupby("study_id").size().between(1800, 2200).all()
    assert (out.centre - out.epoch_idx).between(-3, 3).all() and (out.centre - out.epoch_idx).nunique() == 7
    with pytest.raises(ValueError):
        S.class_probabilities([1.0], 2)


def test_noise_erase_and_dropout(spark):
    n = 400
    df = spark.createDataFrame([(i, [float(i)] * n, [1.0] * n, [2.0] * n) for i in range(5)], "id long, v array<double>, k array<double>, m array<double>")
    start, size = S.region(n, 0.25, 0.25, 1, "id", log=False)
    out = df.withColumns({"noisy": S.gaussian_noise("v", 2.0, 1.0, 2, "id"), "gone": S.erase("v", start, size, n, 3, "id", mean=F.lit(50.0)),
                          "part": S.regional_noise("v", start, size, n, 1.0, 4, "id"), "n": size}).toPandas()
    for r in out.itertuples():
        d = np.array(r.noisy) - r.id
        assert abs(d.mean() - 1) < 0.4 and abs(d.std() - 2) < 0.3
        assert (np.abs(np.array(r.gone) - 50) < 0.1).sum() == r.n == 100
        assert (np.array(r.part) != r.id).sum() == r.n
    dropped = df.withColumns(S.drop_channels({c: c for c in "vkm"}, 0.34, 5, "id")).toPandas()
    changed = np.array([[len(set(getattr(r, c))) > 1 for c in "vkm"] for r in dropped.itertuples()])
    assert (changed.sum(axis=1) == 1).all() and changed.any(axis=0).sum() > 1
    with pytest.raises(ValueError):
        S.drop_channels({"v": "v"}, 0.5, 1, "id")


def test_model_scoring_keeps_order(spark):
    df = spark.createDataFrame([(i, [[float(i), 1.0], [2.0, float(i)]]) for i in range(7)], "id long, x array<array<double>>")
    out = M.score_sequences(df, "x", lambda x: x.sum(axis=2, keepdims=True)).orderBy("id").collect()
    assert [r.scores for r in out] == [[[i + 1.0], [2.0 + i]] for i in range(7)]


def test_stored_model_is_loaded_once_a_task(spark, tmp_path, monkeypatch):
    """Scores by path equal those of the model itself; versions, pieces and the bound on size hold."""
    from somnia.sources import models as K
    monkeypatch.setattr(K, "PIECE", 7)
    path, loads = f"{tmp_path}/user", spark.sparkContext.accumulator(0)

    def load(data):
        loads.add(1)
        w = np.frombuffer(data).reshape(2, 3)
        return lambda x: x @ w

    weights = np.arange(6.0).reshape(2, 3)
    assert K.save_bytes(spark, weights.tobytes(), path) == 1
    df = spark.createDataFrame([(i, [[float(i), 1.0], [2.0, float(i)]]) for i in range(4_000)], "id long, x array<array<double>>").repartition(2)
    batches = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got = K.score_stored(df, "x", path, load).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batches)
    want = M.score_sequences(df, "x", lambda x: x @ weights).collect()
    assert sorted(got) == sorted(want) and loads.value == 2
    assert K.save_bytes(spark, (2 * weights).tobytes(), path) == 2
    assert K.load_bytes(spark.newSession(), path) == (2 * weights).tobytes() and K.load_bytes(spark, path, 1) == weights.tobytes()
    assert K.save_bytes(spark, b"", f"{tmp_path}/none") == 1 and K.load_bytes(spark, f"{tmp_path}/none") == b""
    with pytest.raises(ValueError):
        K.load_bytes(spark, path, largest=47)
    with pytest.raises(FileNotFoundError):
        K.score_stored(df, "x", path, load, 3)
    assert K.score_stored(df.limit(0), "x", path, load).count() == 0


def test_shared_folder_follows_the_setting(spark):
    assert shared_dir(spark).startswith(spark.conf.get("spark.checkpoint.dir"))
    df = spark.range(10)
    assert materialise(df).count() == 10


def test_augmenters_share_a_row_between_channels(spark):
    from somnia.functions.registry import AUGMENTERS, apply_named
    n = 60
    df = spark.createDataFrame([(i, [float(j) for j in range(n)], [100.0 + j for j in range(n)], list(range(n)), 1.0) for i in range(40)],
                               "id long, v array<double>, k array<double>, y array<int>, weight double")
    on = {"keys": ["id"], "channels": ["v", "k"], "apply_prob": 0.5}
    part = {"length": n, "min_region_fraction": 0.2, "max_region_fraction": 0.5}
    out = apply_named(df, AUGMENTERS, [("RegionalSignFlip", {**on, **part, "seed": 1})]).toPandas()
    for r in out.itertuples():
        same = np.array(r.v)[1:] < 0
        assert (same == (np.array(r.k)[1:] < 0)).all() and r.weight == (0.5 if same.any() else 1.0)
    assert 5 < (out.weight == 0.5).sum() < 35
    erased = apply_named(df, AUGMENTERS, [("RegionalErase", {**on, **part, "apply_prob": 1.0, "seed": 2})]).toPandas()
    mean = (np.mean(np.arange(n)) * 2 + 100) / 2
    assert all(12 <= (np.abs(np.array(r.k) - mean) < 0.1).sum() + 0 <= 31 for r in erased.itertuples())
    moved = apply_named(df, AUGMENTERS, [("GlobalElasticDeformations", {**on, "labels": "y", "alpha": (2.0, 4.0), "sigma": 2, "apply_prob": 1.0, "seed": 3})]).toPandas()
    for r in moved.itertuples():
        v, k = np.array(r.v), np.array(r.k)
        inside = k != 0
        np.testing.assert_allclose(k[inside] - v[inside], 100.0)
        assert (np.abs(np.array(r.y)[inside] - v[inside]) <= 0.5 + 1e-9).all()
    with pytest.raises(ValueError):
        AUGMENTERS["RegionalErase"](df, ["id"], ["v"], n, 0.0, 0.5)
    with pytest.raises(ValueError):
        AUGMENTERS["GlobalShift"](df, ["id"], ["v"], 1.0, 1.0)


def test_report_is_that_of_the_predictions(spark):
    """Accuracy, confusion, precision and recall by a plain count; no subject is in both learning and testing."""
    rng = np.random.default_rng(3)
    n = 600
    stage = rng.integers(0, 3, n)
    pdf = pd.DataFrame({"subject": np.where(np.arange(n) < 200, 0, rng.integers(1, 12, n)), "a": stage + rng.normal(0, 0.4, n), "b": rng.normal(size=n), "stage": stage})
    pdf.loc[5, "a"] = np.nan
    df = spark.createDataFrame(pdf).withColumn("a", F.nanvl("a", F.lit(None).cast("double")))
    done = materialise(M.out_of_fold(df, ["a", "b"], "stage", "subject", folds=4, trees=10))
    p = done.toPandas()
    assert len(p) == n and p.groupby("subject").fold.nunique().max() == 1 and p.fold.nunique() > 2 and p.pred.isna().sum() == 1
    p = p.dropna(subset=["pred"])
    report = M.staging_report(done, [0, 1, 2, 3], "stage").toPandas().set_index("class").sort_index()
    assert (p.pred == p.stage).mean() > 0.8 and np.allclose(report.accuracy, (p.pred == p.stage).mean())
    for c in range(4):
        row, true, said = report.loc[c], p[p.stage == c], p[p.pred == c]
        assert row.support == len(true) and [row[f"pred_{k}"] for k in range(4)] == [(true.pred == k).sum() for k in range(4)]
        assert row.recall == pytest.approx((true.pred == c).mean() if len(true) else 0) and row.precision == pytest.approx((said.stage == c).mean() if len(said) else 0)
    lone = M.out_of_fold(df.where("subject = 0"), ["a", "b"], "stage", "subject", folds=3, trees=2)
    assert lone.where("pred IS NOT NULL").isEmpty() and lone.count() == 200
    assert M.staging_report(lone, [0, 1], "stage").isEmpty()


def test_clusters_do_not_hang_on_partitions(spark):
    """Three blocks of states, dense inside and thin between: the same groups for any partitioning, and the blocks."""
    from somnia.operators import graph as G
    rng = np.random.default_rng(4)
    pairs = [(i, j, int(rng.integers(80, 120) if i // 10 == j // 10 else rng.integers(0, 3) if j // 10 - i // 10 == 1 else 0)) for i in range(30) for j in range(i + 1, 30)]
    df = spark.createDataFrame([p for p in pairs if p[2]], "src long, dst long, n long")
    found = [{r.latent_id: r.cluster for r in G.temporal_clusters(df.repartition(k), 3, 12).collect()} for k in (2, 7)]
    assert found[0] == found[1] and len(found[0]) == 30
    assert [len({found[0][i] for i in range(b, b + 10)}) for b in (0, 10, 20)] == [1, 1, 1] and len(set(found[0].values())) == 3
    assert G.temporal_clusters(df.limit(0), 3).count() == 0
    ring = spark.createDataFrame([(i, (i + 1) % 6, 1) for i in range(6)], "src long, dst long, n long")
    assert {r.cluster for r in G.temporal_clusters(ring, 3).collect()} == {0}  # nothing tells its nodes apart


def test_test_matrix_is_square(spark):
    from somnia.operators import latent as L
    df = spark.createDataFrame([(1, s // 2, s, e) for s in range(6) for e in range(3 * s % 7 + 1)], "latent_id long, grp int, subject long, epoch_id long")
    got = {(r.g1, r.g2): (r.t, r.p) for r in L.group_test_matrix(df).collect()}
    assert len(got) == 9 and all(got[a, b] == got[b, a] for a, b in got) and all(got[g, g] == (0.0, 1.0) for g in range(3))
