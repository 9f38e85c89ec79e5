"""Spectra, filters and smoothing against plain numpy on the whole series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somnia.functions.scalar import ratio_indices
from somnia.operators import epochs as E, signal as G


def frame(spark, x, name="x"):
    return spark.createDataFrame(pd.DataFrame({"rec": 0, "i": np.arange(len(x)), name: x}))


def series(df, col="x", by="i"):
    return df.orderBy(by).toPandas()[col].to_numpy(dtype=float)


def test_tapers_are_orthonormal_and_concentrated():
    for n in (64, 1500):
        tapers, ratios = G.slepian_tapers(n)
        assert len(tapers) == 7 and (ratios > 0.9).all()
        np.testing.assert_allclose(tapers @ tapers.T, np.eye(7), atol=0.03)  # one point is cut off


def test_long_and_short_taper_routes_agree():
    n = 600
    m = n + 1
    k, w = np.arange(m), 4.0 / m
    slow = G._leading_vectors(((m - 1 - 2 * k) / 2.0) ** 2 * np.cos(2 * np.pi * w), k[1:] * (m - k[1:]) / 2.0, 7)
    fast, _ = G.slepian_tapers(n)
    for a, b in zip(slow[:, :n], fast):
        assert min(abs(a - b).max(), abs(a + b).max()) < 1e-9


def test_multitaper_power_of_a_sine(spark):
    fs, size = 100.0, 200
    t = np.arange(5 * size) / fs
    x = 3 * np.sin(2 * np.pi * 8 * t) + np.sin(2 * np.pi * 30 * t)
    out = G.multitaper_band_power(frame(spark, x), ["rec"], "i", fs, size,
                                  {"theta": ("x", 6, 10), "beta": ("x", 28, 32), "gap": ("x", 15, 20)}).toPandas()
    assert len(out) == 5
    assert (out.theta / out.beta).between(7, 11).all() and (out.gap < out.beta / 1e3).all()


def test_welch_total_is_variance(spark):
    x = np.random.default_rng(1).normal(size=64 * 50)
    psd = G.welch(frame(spark, x), ["rec"], "i", "x", 128.0, 64).toPandas()
    assert abs(psd.psd.sum() * 2.0 - 1) < 0.05


@pytest.mark.parametrize("chunk", [64, 100000])
def test_band_pass_keeps_phase_and_blocks_outside(spark, chunk):
    fs = 50.0
    t = np.arange(1500) / fs
    keep, drop = np.sin(2 * np.pi * 5 * t), np.sin(2 * np.pi * 0.2 * t) + np.sin(2 * np.pi * 20 * t)
    y = series(G.zero_phase_filter(frame(spark, keep + drop), ["rec"], "i", "x", fs, 2.5, 10.0, chunk=chunk))
    assert len(y) == len(t)
    assert np.abs(y - keep)[150:-150].max() < 0.03


@pytest.mark.parametrize("fs,low,high,n", [
    (2500.0, 0.1, 0.45, 1_000_000), (2500.0, 0.3, 0.45, 1_000_000), (2500.0, 0.3, 35.0, 300_000), (2500.0, 300.0, 600.0, 50_000),
    (128.0, 0.1, 0.45, 100_000), (128.0, 0.3, None, 50_000), (128.0, None, 20.0, 50_000)])
def test_frames_agree_with_one_piece(fs, low, high, n):
    """A drifting signal cut into frames gives what it gives whole, with a far longer reach."""
    x = np.random.default_rng(2).normal(size=n).cumsum()
    settle = G.settle_length(fs, low, high)
    response = lambda m: G.squared_response(m, fs, low, high)
    whole = G._filtered(x, 0, n, 4 * settle, 27, response)
    for parts in (3, 8):
        cuts = np.linspace(0, n, parts + 1).astype(int)
        got = [G._filtered(x[max(a - settle, 0):b + settle], min(a, settle), b - a, settle, 27, response) for a, b in zip(cuts, cuts[1:])]
        assert np.abs(np.concatenate(got) - whole).max() < 1e-3 * whole.std()


def test_filter_chunks_agree_with_one_piece(spark):
    x = np.random.default_rng(2).normal(size=60_000).cumsum()
    run = lambda **kw: series(G.zero_phase_filter(frame(spark, x), ["rec"], "i", "x", 128.0, 0.1, 0.45, **kw))
    one, default, many = run(chunk=10**6), run(), run(chunk=7_000)
    np.testing.assert_allclose(default, one, atol=1e-3 * one.std())
    np.testing.assert_allclose(many, one, atol=1e-3 * one.std())


def test_filter_bands_must_fit(spark):
    df = frame(spark, np.zeros(10))
    with pytest.raises(ValueError, match="shorter"):
        G.zero_phase_filter(df, ["rec"], "i", "x", 2500.0, 0.3, 35.0, settle=576)
    with pytest.raises(ValueError, match="fit"):
        G.high_pass_for_emg(df, ["rec"], "i", "x", 500.0)
    with pytest.raises(ValueError, match="fit"):
        G.eye_features(df.withColumn("y", df.x), ["rec"], "i", "x", "y", 60.0, 30)


@pytest.mark.parametrize("fs, passes, stops", [
    (2500.0, (300.0, 600.0), (275.0, 625.0)), (1000.0, (300.0, 475.0), (275.0, 500.0)), (100.0, (10.0, None), (8.0, None)),
    (100.0, (None, 10.0), (None, 12.0)), (100.0, (5.0, 10.0), (4.0, 12.0)), (100.0, (20.0, None), (1.0, None))])
@pytest.mark.parametrize("loss, attenuation", [(1.0, 60.0), (0.1, 40.0)])
def test_elliptic_keeps_its_limits(fs, passes, stops, loss, attenuation):
    """At most ``loss`` dB inside, at least ``attenuation`` dB outside, and both are reached: no lower order could."""
    design = G.Elliptic(fs, passes, stops, loss, attenuation)
    f = np.linspace(0, fs / 2, 200_001)
    lost = -10 * np.log10(np.maximum(design.power(f), 1e-30))
    inside = (f >= (passes[0] or 0)) & (f <= (passes[1] or fs))
    outside = (f <= (stops[0] if stops[0] else -1)) | (f >= (stops[1] if stops[1] else fs))
    assert lost[inside].min() > -1e-9 and lost[inside].max() == pytest.approx(loss, abs=1e-3) and lost[inside].max() < loss + 1e-6
    assert lost[outside].min() > attenuation - 1e-6
    assert lost.max() > attenuation - 1e-6 and (design.poles.real < 0).all()


def test_elliptic_edges_must_fit():
    for passes, stops in [((300.0, 600.0), (275.0, None)), ((300.0, 600.0), (310.0, 625.0)), ((None, None), (None, None)), ((300.0, 1250.0), (275.0, 1300.0))]:
        with pytest.raises(ValueError, match="fit"):
            G.Elliptic(2500.0, passes, stops)


def test_elliptic_chunks_agree_with_one_piece(spark):
    x = np.random.default_rng(8).normal(size=60_000).cumsum()
    run = lambda **kw: series(G.high_pass_for_emg(frame(spark, x), ["rec"], "i", "x", 2500.0, **kw))
    np.testing.assert_allclose(run(chunk=5_000), run(chunk=10**6), atol=1e-6 * x.std())


def test_filtered_samples_keep_no_frame():
    """A short recording's samples must not hold the memory of the padded frame that was filtered for them."""
    out = G._filtered(np.arange(40.0), 0, 40, 500, 27, lambda m: np.ones(m // 2 + 1))
    assert out.base is None and np.allclose(out, np.arange(40.0))


def test_notch(spark):
    fs = 50.0
    t = np.arange(2000) / fs
    x = np.sin(2 * np.pi * 3 * t) + np.sin(2 * np.pi * 12 * t)
    y = series(G.zero_phase_filter(frame(spark, x), ["rec"], "i", "x", fs, 11.0, 13.0, stop=True, chunk=512))
    assert np.abs(y - np.sin(2 * np.pi * 3 * t))[200:-200].max() < 0.05


@pytest.mark.parametrize("chunk", [16, 10**6])
def test_savitzky_golay(spark, chunk):
    x = np.random.default_rng(3).normal(size=75)
    got = series(G.savitzky_golay(frame(spark, x), ["rec"], "i", "x", 11, 4, chunk))
    t = np.arange(-5, 6)
    want = np.array([np.polyval(np.polyfit(t, x[c - 5:c + 6], 4), i - c) for i, c in
                     ((i, min(max(i, 5), len(x) - 6)) for i in range(len(x)))])
    np.testing.assert_allclose(got, want, atol=1e-9)


@pytest.mark.parametrize("up,down", [(1, 2), (2, 3), (3, 2)])
@pytest.mark.parametrize("chunk", [50, 10**6])
def test_resample(spark, up, down, chunk):
    x = np.sin(2 * np.pi * 0.03 * np.arange(600))
    out = G.resample(frame(spark, x), ["rec"], "i", "x", up, down, chunk)
    got = series(out)
    n = -(-600 * up // down)
    assert out.count() == n and out.select("i").distinct().count() == n
    want = np.sin(2 * np.pi * 0.03 * np.arange(n) * down / up)
    assert np.abs(got - want)[40:-40].max() < 0.01


def test_autocorrelation_slope(spark):
    size = 64
    x = np.r_[np.sin(2 * np.pi * np.arange(size) / 10), np.ones(size)]
    got = series(G.autocorrelation_slope(frame(spark, x), ["rec"], "i", "x", size), "slope", "epoch_idx")
    ac = np.correlate(x[:size], x[:size], "full")[size - 1:]
    p = next(i for i in range(1, size - 1) if ac[i - 1] < ac[i] > ac[i + 1])
    assert abs(got[0] - (ac[p] - ac[0]) / p) < 1e-9 and got[1] == 0


def test_cross_correlation_matches_full_correlation(spark):
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=40), rng.normal(size=40)
    df = spark.createDataFrame(pd.DataFrame({"rec": 0, "i": np.arange(40), "a": a, "b": b}))
    for lag in (-3, 0, 2):
        got = series(E.cross_correlation(df, ["rec"], "i", 20, "a", "b", lag), "xcorr", "epoch_idx")
        want = [np.correlate(a[s:s + 20], b[s:s + 20], "full")[19 + lag] for s in (0, 20)]
        np.testing.assert_allclose(got, want, atol=1e-9)


def wei(x):
    lo, hi = x[x <= np.percentile(x, 10)].mean(), x[x >= np.percentile(x, 90)].mean()
    return np.clip((x - lo) / (hi - lo), 0.05, 1)


@pytest.mark.parametrize("chunk", [16, 10**6])
def test_epoch_features_follow_the_whole_array_recipe(spark, chunk):
    rng = np.random.default_rng(5)
    names = ["noise", "theta", "delta", "sigma", "gamma", "emg"]
    pdf = pd.DataFrame(rng.gamma(2.0, size=(90, 6)), columns=names).assign(rec=0, epoch_idx=np.arange(90))
    got = E.epoch_features(spark.createDataFrame(pdf), ["rec"], chunk=chunk).orderBy("epoch_idx").toPandas()
    n = {c: wei(pdf[c].to_numpy()) for c in names}
    t, d, s, g, e = (n[c] for c in ("theta", "delta", "sigma", "gamma", "emg"))
    idx = {"index_w": e * e * g / t, "index_r": 2 * t * g / (d * d * e * e), "index_n": s * d / g ** 2,
           "index_1": e * g / d, "index_2": s * d / t, "index_3": t * g / d, "index_4": d / t}
    box = lambda x: np.convolve(x, np.ones(5) / 5, "same")
    for name, x in {**{k: wei(np.log(v)) for k, v in idx.items()}, "noise": n["noise"], "theta": t, "delta": d}.items():
        np.testing.assert_allclose(got[name], box(box(box(x))), atol=1e-9, err_msg=name)


def test_emg_proxy(spark):
    rng = np.random.default_rng(6)
    fs, n = 1000.0, 4000
    common = rng.normal(size=n)
    a, b = common + 0.1 * rng.normal(size=n), np.where(np.arange(n) < 2000, common, rng.normal(size=n))
    df = spark.createDataFrame(pd.DataFrame({"rec": 0, "i": np.arange(n), "a": a, "b": b}))
    out = G.emg_from_signals(df, ["rec"], "i", "a", "b", fs, 5.0, 5, chunk=1024).orderBy("bin").toPandas()
    assert len(out) == len(np.arange(200, n - 200, 200))
    assert out.emg[:8].min() > 0.9 and out.emg[-8:].abs().max() < 0.5
    assert out.norm.min() == 0 and out.norm.max() == 1 and out.smoothed.notna().all()


def test_emg_query_smooths(spark):
    """The smoothed form of the query is the fit of order 4 over 9 bins, so it moves them; a recording of fewer has none."""
    from somnia.plans import load
    rng = np.random.default_rng(8)
    rows = [(u, 1000 * u + i, "view", float(rng.normal()), f'{{"k": {rng.integers(0, 100)}}}') for u, n in ((0, 100), (1, 44), (2, 30)) for i in range(n)]
    events = spark.createDataFrame(rows, "user_id long, event_id long, event_type string, value double, props string")
    out = load()["emg_from_signals"].build(type("T", (), {"spark": spark, "events": events})()).orderBy("recording_id", "bin").toPandas()
    t = np.arange(-4, 5)
    for rec, of in out.groupby("recording_id"):
        x = of.emg.dropna().to_numpy()
        if len(x) < 9:
            assert of.smoothed.isna().all()
            continue
        want = [np.polyval(np.polyfit(t, x[c - 4:c + 5], 4), i - c) for i, c in ((i, min(max(i, 4), len(x) - 5)) for i in range(len(x)))]
        np.testing.assert_allclose(of.smoothed[of.emg.notna()], want, atol=2e-5)
        assert np.abs(of.smoothed - of.emg).max() > 1e-3
    assert sorted(out.recording_id.unique()) == [0, 1, 2]


def test_emg_smooths_over_bins_without_a_value(spark, monkeypatch):
    """A channel that stands still gives bins without a value; the others are smoothed at their own places, in any chunks."""
    rng = np.random.default_rng(9)
    fs, n = 1000.0, 6000
    a, b = rng.normal(size=n), rng.normal(size=n)
    a[1500:4000] = 0.0
    monkeypatch.setattr(G, "high_pass_for_emg", lambda df, keys, idx, value, *_, **__: df.select(*keys, idx, value))  # leaves no dust on zeros
    df = spark.createDataFrame(pd.DataFrame({"rec": 0, "i": np.arange(n), "a": a, "b": b}))
    outs = [G.emg_from_signals(df, ["rec"], "i", "a", "b", fs, 25.0, 11, chunk=c).orderBy("bin").toPandas() for c in (16, 1 << 14)]
    np.testing.assert_allclose(outs[0].smoothed, outs[1].smoothed, atol=1e-9)
    x, t = outs[0].emg.dropna().to_numpy(), np.arange(-5, 6)
    want = [np.polyval(np.polyfit(t, x[c - 5:c + 6], 4), i - c) for i, c in ((i, min(max(i, 5), len(x) - 6)) for i in range(len(x)))]
    np.testing.assert_allclose(outs[0].smoothed[outs[0].emg.notna()], want, atol=1e-7)
    assert 0 < outs[0].emg.isna().sum() == outs[0].smoothed.isna().sum()


def test_elastic_follows_interpolation(spark):
    rng = np.random.default_rng(7)
    x, y, u = rng.normal(size=50), rng.integers(0, 5, 50), rng.random(50) * 2 - 1
    df = spark.createDataFrame([(x.tolist(), [int(v) for v in y], u.tolist(), [0.0] * 50)], "x array<double>, y array<int>, u array<double>, z array<double>")
    still = df.select(G.elastic(F.col("x"), F.col("y"), F.col("z"), 5.0, 2.0).alias("e")).first().e
    np.testing.assert_allclose(still.signal, x)
    assert still.labels == list(y)
    moved = np.array(df.select(G.elastic(F.col("x"), F.col("y"), F.col("u"), 5.0, 2.0, -9.0).alias("e")).first().e.signal)
    inside = moved[moved != -9.0]
    assert inside.min() >= x.min() and inside.max() <= x.max() and not np.allclose(moved, x)


def test_theta_power_choices(spark):
    df = spark.createDataFrame([(3.0, 1.0, 1.0, 1.0, 1.0)], "theta double, delta double, sigma double, gamma double, emg double")
    assert df.select(ratio_indices()["index_r"]).first()[0] == 6.0
    assert df.select(ratio_indices(theta_power="square")["index_r"]).first()[0] == 9.0


def test_filters_of_one_step_are_those_of_many(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"rec": 0, "i": np.arange(9_000), "x": rng.normal(size=9_000).cumsum(), "y": rng.normal(size=9_000)})
    df = spark.createDataFrame(pdf)
    wanted = {"p": ("x", 0.3, 35.0), "q": ("y", 0.5, None), "r": ("x", 0.3, 0.45)}
    got = G.zero_phase_filters(df, ["rec"], "i", wanted, 250.0, chunk=2_000).orderBy("i").toPandas()
    assert (got.i == np.arange(9_000)).all()
    for name, (column, low, high) in wanted.items():
        alone = series(G.zero_phase_filter(df, ["rec"], "i", column, 250.0, low, high), column)
        np.testing.assert_allclose(got[name], alone, atol=1e-5 * pdf[column].std())


def test_normalised_eye_features(spark):
    """At 250 Hz against numpy: channels normalised, filtered whole, one measure logged and normalised again."""
    rng = np.random.default_rng(6)
    fs, size, n = 250.0, 500, 10_000
    a = np.sin(np.arange(n) / 40) + rng.normal(0, 0.3, n).cumsum() / 10
    pdf = pd.DataFrame({"rec": 0, "i": np.arange(n), "a": a, "b": -a + rng.normal(0, 0.2, n)})
    got = G.normalised_eye_features(spark.createDataFrame(pdf), ["rec"], "i", "a", "b", fs, size).orderBy("epoch_idx").toPandas()

    def norm(x):
        lo, hi = (np.sort(x)[:len(x) // 10].mean(), np.sort(x)[-(len(x) // 10):].mean())
        return np.clip((x - lo) / (hi - lo), 0.05, 1)

    normed = {c: norm(pdf[c].to_numpy()) for c in "ab"}

    def power(low, high):  # the digital band-pass applied both ways, on the series with long held and reflected ends
        pad = 60_000
        out = []
        for x in normed.values():
            head, tail = 2 * x[0] - x[27:0:-1], 2 * x[-1] - x[-2:-29:-1]
            y = np.r_[np.full(pad, head[0]), head, x, tail, np.full(pad, tail[-1])]
            w = np.tan(np.pi * np.fft.rfftfreq(len(y)).clip(1e-12, 0.5 - 1e-12))
            lo, hi = np.tan(np.pi * low / fs), np.tan(np.pi * high / fs)
            g = 1 / (1 + ((w * w - lo * hi) / (w * (hi - lo))) ** 8)
            z = np.fft.irfft(np.fft.rfft(y - y[0]) * g, len(y))
            out.append(z[pad + 27:pad + 27 + n].reshape(-1, size))
        return out

    def slope(row):
        ac = np.correlate(row, row, "full")[size - 1:]
        peaks = [k for k in range(1, size - 1) if ac[k] > ac[k - 1] and ac[k] > ac[k + 1]]
        return (ac[peaks[0]] - ac[0]) / peaks[0] if peaks else 0.0

    x, y = power(0.1, 0.45)
    np.testing.assert_allclose(got.slow_b, (x * x).sum(1) * (x * y).sum(1), rtol=1e-2, atol=1e-2 * np.abs(got.slow_b).max())
    x, y = power(0.3, 35.0)
    rem = [np.sign((u * v).sum()) / slope(u) if slope(u) else np.nan for u, v in zip(x, y)]
    np.testing.assert_allclose(got.rem.to_numpy(float), rem, rtol=1e-2)
    with np.errstate(invalid="ignore"):
        logged = np.log(rem)
    assert np.array_equal(np.isnan(logged), got.rem_norm.isna()) and np.isfinite(logged).any()
    known = got.rem_norm.dropna()
    assert known.between(0.05, 1).all() and (np.argsort(logged[np.isfinite(logged)], kind="stable")[-1] == np.argmax(known.to_numpy()))
