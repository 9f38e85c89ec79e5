"""Queries: spectra, band powers, filters and epoch features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from somnia.operators import epochs as E, signal as G
from .proxies import EPOCH, FS, SAMP, SIG, epoch_labels, fin, out, samples, signal
from .registry import query

KEY = ["recording_id"]
CH = ["recording_id", "channel"]
RATE = 100.0  # nominal rate that puts the bands inside a 16-sample frame
# Bands wide enough to hold bins of 6.25 Hz: feature, channel, limits.
FEATURE_BANDS = {"noise": ("k", 0.0, 5.0), "delta": ("v", 5.0, 15.0), "theta": ("k", 6.0, 10.0),
                 "sigma": ("v", 11.0, 20.0), "gamma": ("v", 35.0, 45.0)}
CHANNEL = {"delta": (0.5, 13.0), "theta": (6.0, 19.0), "gamma": (30.0, 45.0), "total": (0.5, 45.0)}
EEG = {"delta": (0.5, 10.0), "alpha": (10.0, 15.0), "beta": (15.0, 30.0)}


def _weights(size, a):
    return f"({a} - {1 - a:.2f} * cos(2 * pi() * n / {size}))"


def _frames(size, keys="recording_id, channel", src="samp", hop=None):
    """Whole frames: position n, value less the frame's mean."""
    if hop is None:
        fr = f"SELECT {keys}, sample_idx // {size} AS e, sample_idx % {size} AS n, value FROM {src}"
    else:
        fr = (f"SELECT {keys}, e, sample_idx - e * {hop} AS n, value FROM (SELECT {keys}, sample_idx, value, "
              f"unnest(range(greatest((sample_idx - {size}) // {hop} + CASE WHEN sample_idx >= {size} THEN 1 ELSE 0 END, 0), sample_idx // {hop} + 1)) AS e FROM {src}) WHERE sample_idx >= e * {hop} AND sample_idx < e * {hop} + {size}")
    return (f"fr0 AS ({fr}), fr AS (SELECT * FROM (SELECT *, value - avg(value) OVER w AS x, count(*) OVER w AS c FROM fr0 "
            f"WINDOW w AS (PARTITION BY {keys}, e)) WHERE c = {size}), fq AS (SELECT unnest(range({size // 2 + 1})) AS k)")


def _dft(size, a, fs, keys="recording_id, channel"):
    w = _weights(size, a)
    return (f"ps AS (SELECT {keys}, e, k * {fs / size} AS freq, CASE WHEN k = 0 OR k = {size // 2} THEN 1 ELSE 2 END * "
            f"(sum(x * {w} * cos(2 * pi() * k * n / {size})) ** 2 + sum(x * {w} * sin(2 * pi() * k * n / {size})) ** 2) "
            f"/ ({fs} * sum({w} ** 2)) AS psd FROM fr, fq GROUP BY {keys}, e, k)")


HAM = SAMP + ", " + _frames(EPOCH) + ", " + _dft(EPOCH, 0.54, RATE)
HAN = SAMP + ", " + _frames(8, hop=4) + ", " + _dft(8, 0.5, RATE)


def _tapers():
    t, r = G.slepian_tapers(EPOCH)
    rows = ", ".join(f"({j}, {n}, {float(x)!r}, {float(w)!r})" for j, (row, w) in enumerate(zip(t, r)) for n, x in enumerate(row))
    return f"tp(j, n, h, wt) AS (VALUES {rows})"


MTS = SAMP + ", " + _frames(EPOCH) + ", " + _tapers() + f""", mt AS (SELECT recording_id, channel, e, k, j, any_value(wt) AS wt,
 CASE WHEN k = 0 OR k = {EPOCH // 2} THEN 0.5 ELSE 1 END * (sum(x * h * cos(2 * pi() * k * fr.n / {EPOCH})) ** 2 + sum(x * h * sin(2 * pi() * k * fr.n / {EPOCH})) ** 2) AS p
 FROM fr JOIN tp ON tp.n = fr.n, fq GROUP BY recording_id, channel, e, k, j),
ps AS (SELECT recording_id, channel, e, k * {RATE / EPOCH} AS freq, 2 * sum(wt * p) / sum(wt) AS psd FROM mt GROUP BY recording_id, channel, e, k)"""


@query("multitaper_spectrum", "D-01", out(MTS, "SELECT recording_id, channel, e AS epoch_idx, freq, psd FROM ps", "recording_id epoch_idx", "freq psd"))
def _(t):
    return fin(G.epoch_spectrum(samples(t), CH, "sample_idx", "value", RATE, EPOCH))


def band_powers(t):
    """Each feature's band on the channel it is measured on."""
    return G.multitaper_band_power(signal(t), KEY, "sample_idx", RATE, EPOCH, FEATURE_BANDS)


@query("band_power_by_feature", "D-01 D-02", out(MTS, "SELECT recording_id, e AS epoch_idx, " + ", ".join(f"sum(CASE WHEN channel = '{c}' AND freq BETWEEN {lo} AND {hi} THEN psd ELSE 0 END) AS {f}" for f, (c, lo, hi) in FEATURE_BANDS.items()) + " FROM ps GROUP BY 1, 2", "recording_id epoch_idx", " ".join(FEATURE_BANDS)))
def _(t):
    return fin(band_powers(t).select("recording_id", "epoch_idx", *FEATURE_BANDS))


POWERS = ["noise", "theta", "delta", "sigma", "gamma", "emg"]
INDICES = {"index_w": "emg * emg * gamma / theta", "index_r": "theta * 2 * gamma / (delta * delta * emg * emg)",
           "index_n": "sigma * delta / (gamma * gamma)", "index_1": "emg * gamma / delta", "index_2": "sigma * delta / theta",
           "index_3": "theta * gamma / delta", "index_4": "delta / theta"}


def _wei(src, dst, cols, keep=()):
    cuts = ", ".join(f"quantile_cont({c}, 0.1) AS {c}_l, quantile_cont({c}, 0.9) AS {c}_h" for c in cols)
    ends = ", ".join(f"avg({c}) FILTER ({c} <= {c}_l) AS {c}_a, avg({c}) FILTER ({c} >= {c}_h) AS {c}_b" for c in cols)
    norm = ", ".join(f"CASE WHEN {c}_b <> {c}_a AND {c} IS NOT NULL THEN greatest(least(({c} - {c}_a) / ({c}_b - {c}_a), 1), 0.05) END AS {c}" for c in cols)
    rest = "".join(f", {k}" for k in keep)
    return (f"{dst}q AS (SELECT recording_id, {cuts} FROM {src} GROUP BY 1), {dst}e AS (SELECT {src}.recording_id, {ends} FROM {src} JOIN {dst}q USING (recording_id) GROUP BY 1), "
            f"{dst} AS (SELECT {src}.recording_id, epoch_idx, {norm}{rest} FROM {src} JOIN {dst}e ON {src}.recording_id = {dst}e.recording_id)")


def _boxes(src, cols):
    parts, prev = [], src
    for i in range(3):
        agg = ", ".join(f"sum({c}) OVER w / 5 AS {c}" for c in cols)
        parts.append(f"bx{i} AS (SELECT recording_id, epoch_idx, {agg} FROM {prev} WINDOW w AS (PARTITION BY recording_id ORDER BY epoch_idx RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING))")
        prev = f"bx{i}"
    return ", ".join(parts)


NAMES = [*INDICES, "noise", "theta", "delta"]
FEAT = (MTS + ", bp AS (SELECT recording_id, e AS epoch_idx, " + ", ".join(
    f"sum(CASE WHEN channel = '{c}' AND freq BETWEEN {lo} AND {hi} THEN psd ELSE 0 END) AS {f}" for f, (c, lo, hi) in FEATURE_BANDS.items())
    + f" FROM ps GROUP BY 1, 2), em AS (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, sum(v * v) AS emg FROM sig GROUP BY 1, 2), "
    + "ft AS (SELECT bp.*, emg FROM bp JOIN em ON bp.recording_id = em.recording_id AND bp.epoch_idx = em.epoch_idx), " + _wei("ft", "nm", POWERS)
    + ", lg AS (SELECT *, " + ", ".join(f"ln({e}) AS {n}" for n, e in INDICES.items()) + " FROM nm), "
    + _wei("lg", "sc", list(INDICES), ["noise", "theta", "delta"]) + ", " + _boxes("sc", NAMES))


@query("epoch_features", "D-03 W-14 F-01 F-02 W-01", out(FEAT, "SELECT * FROM bx2", "recording_id epoch_idx", " ".join(NAMES)))
def _(t):
    emg = E.epoch_energy(signal(t), KEY, "sample_idx", EPOCH, "v").withColumnRenamed("energy", "emg")
    return fin(E.epoch_features(band_powers(t).join(emg, [*KEY, "epoch_idx"]), KEY))


@query("welch_hamming", "D-04", out(HAM, "SELECT recording_id, channel, freq, avg(psd) AS psd FROM ps GROUP BY 1, 2, 3", "recording_id", "freq psd"))
def _(t):
    return fin(G.welch(samples(t), CH, "sample_idx", "value", RATE, EPOCH))


@query("welch_hann", "D-04", out(HAN, "SELECT recording_id, channel, freq, avg(psd) AS psd FROM ps GROUP BY 1, 2, 3", "recording_id", "freq psd"))
def _(t):
    return fin(G.welch(samples(t), CH, "sample_idx", "value", RATE, 8, window="hann"))


def _areas(src, keys):
    parts = []
    for b, (lo, hi) in CHANNEL.items():
        parts.append(f"SELECT {keys}, '{b}' AS band, sum((psd + nx) / 2 * {RATE / EPOCH}) AS power FROM (SELECT {keys}, freq, psd, lead(psd) OVER (PARTITION BY {keys} ORDER BY freq) AS nx FROM {src} WHERE freq BETWEEN {lo} AND {hi}) WHERE nx IS NOT NULL GROUP BY {keys}")
    return " UNION ALL ".join(parts)


WEL = HAM + ", wl AS (SELECT recording_id, channel, freq, avg(psd) AS psd FROM ps GROUP BY 1, 2, 3), bp AS (" + _areas("wl", "recording_id, channel") + ")"


def channel_powers(t):
    psd = G.welch(samples(t), CH, "sample_idx", "value", RATE, EPOCH)
    return G.band_powers(psd, CH, RATE, EPOCH, CHANNEL)


@query("channel_band_power", "D-04", out(WEL, "SELECT * FROM bp", "recording_id", "power"))
def _(t):
    return fin(channel_powers(t))


@query("channel_ranking", "A-42 K-04", out(WEL, "SELECT recording_id, channel, band, power, row_number() OVER (PARTITION BY recording_id, band ORDER BY power DESC, channel) AS rank FROM bp", "recording_id rank", "power"))
def _(t):
    return fin(G.rank_channels(channel_powers(t), KEY))


@query("relative_band_power", "D-05", out(MTS, "SELECT recording_id, channel, e AS epoch_idx, " + ", ".join(f"avg(CASE WHEN freq >= {a} AND freq < {b} THEN psd END) / nullif(sum(psd), 0) AS {n}" for n, (a, b) in EEG.items()) + " FROM ps WHERE freq BETWEEN 0.5 AND 30 GROUP BY 1, 2, 3", "recording_id epoch_idx", " ".join(EEG)))
def _(t):
    sp = G.epoch_spectrum(samples(t), CH, "sample_idx", "value", RATE, EPOCH)
    return fin(G.relative_band_power(sp, [*CH, "epoch_idx"], EEG))


def _join_labels(src):
    return (f", labn AS (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, stage, count(*) AS n FROM sig GROUP BY ALL), lab AS (SELECT recording_id, epoch_idx, stage FROM "
            f"(SELECT *, row_number() OVER (PARTITION BY recording_id, epoch_idx ORDER BY n DESC, stage) AS rn, sum(n) OVER (PARTITION BY recording_id, epoch_idx) AS total FROM labn) WHERE rn = 1 AND total = {EPOCH})"
            f", pl AS (SELECT p.*, lab.stage FROM {src} p JOIN lab ON lab.recording_id = p.recording_id AND lab.epoch_idx = p.e)")


@query("mean_spectrum_by_stage", "A-44", out(HAM + _join_labels("ps"), "SELECT channel, stage, freq, avg(psd) AS psd FROM pl GROUP BY 1, 2, 3", "stage", "freq psd"))
def _(t):
    sp = G.epoch_spectrum(samples(t), CH, "sample_idx", "value", RATE, EPOCH, "hamming")
    return fin(sp.join(epoch_labels(t), [*KEY, "epoch_idx"]).groupBy("channel", "stage", "freq").agg(F.avg("psd").alias("psd")))


@query("band_power_by_stage", "A-43", out(HAM + ", bp AS (" + _areas("ps", "recording_id, channel, e") + ")" + _join_labels("bp"), "SELECT channel, stage, band, avg(power) AS power FROM pl GROUP BY 1, 2, 3", "stage", "power"))
def _(t):
    sp = G.epoch_spectrum(samples(t), CH, "sample_idx", "value", RATE, EPOCH, "hamming")
    bp = G.band_powers(sp, [*CH, "epoch_idx"], RATE, EPOCH, CHANNEL)
    return fin(bp.join(epoch_labels(t), [*KEY, "epoch_idx"]).groupBy("channel", "stage", "band").agg(F.avg("power").alias("power")))


@query("cross_correlation", "D-10", out(SIG, f"SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, sum(v * k) AS xcorr FROM sig GROUP BY 1, 2 HAVING count(*) = {EPOCH}", "recording_id epoch_idx", "xcorr"))
def _(t):
    return fin(E.cross_correlation(signal(t), KEY, "sample_idx", EPOCH, "v", "k"))


@query("epoch_energy", "D-11", out(SIG, f"SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, sum(v * v) AS energy FROM sig GROUP BY 1, 2 HAVING count(*) = {EPOCH}", "recording_id epoch_idx", "energy"))
def _(t):
    return fin(E.epoch_energy(signal(t), KEY, "sample_idx", EPOCH, "v"))


@query("autocorrelation_slope", "D-12", out(SIG + f""", f AS (SELECT recording_id, sample_idx // {EPOCH} AS e, sample_idx % {EPOCH} AS n, v, count(*) OVER (PARTITION BY recording_id, sample_idx // {EPOCH}) AS c FROM sig),
ac AS (SELECT a.recording_id, a.e, b.n - a.n AS lag, sum(a.v * b.v) AS r FROM f a JOIN f b ON a.recording_id = b.recording_id AND a.e = b.e AND b.n >= a.n WHERE a.c = {EPOCH} GROUP BY 1, 2, 3),
nb AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q, first_value(r) OVER w AS r0 FROM ac WINDOW w AS (PARTITION BY recording_id, e ORDER BY lag)),
pk AS (SELECT recording_id, e, min(lag) FILTER (r > p AND r > q) AS l FROM nb GROUP BY 1, 2)""", "SELECT pk.recording_id, pk.e AS epoch_idx, CASE WHEN l IS NULL THEN 0 ELSE (nb.r - nb.r0) / l / nb.r0 END AS slope FROM pk LEFT JOIN nb ON nb.recording_id = pk.recording_id AND nb.e = pk.e AND nb.lag = pk.l", "recording_id epoch_idx", "slope"))
def _(t):
    # Over the energy, so that no value sits on a rounding edge of the comparison.
    s = signal(t)
    slope, energy = G.autocorrelation_slope(s, KEY, "sample_idx", "v", EPOCH), E.epoch_energy(s, KEY, "sample_idx", EPOCH, "v")
    both = slope.join(energy, [*KEY, "epoch_idx"])
    return fin(both.select(*KEY, "epoch_idx", (F.col("slope") / F.col("energy")).alias("slope")))


@query("detrend", "D-19", out(SIG + f", l AS (SELECT recording_id, sample_idx // {EPOCH} AS e, regr_slope(v, sample_idx % {EPOCH}) AS b, regr_intercept(v, sample_idx % {EPOCH}) AS a FROM sig GROUP BY 1, 2)", f"SELECT s.recording_id, s.sample_idx, v - (a + b * (sample_idx % {EPOCH})) AS v, e AS epoch_idx FROM sig s JOIN l ON s.recording_id = l.recording_id AND s.sample_idx // {EPOCH} = l.e", "recording_id sample_idx epoch_idx", "v"))
def _(t):
    return fin(E.detrend(signal(t).select("recording_id", "sample_idx", "v"), KEY, "sample_idx", EPOCH, "v"))


def _zero_phase(gain, length, reach, rate, source="samp"):
    """CTEs up to ``filtered``: a convolution with the impulse response of a power response.

    ``gain`` is the response as SQL of the warped frequency w = tan(pi f / rate) of bin k. The series goes on by odd
    reflection of 27 values and is then held, so what lies beyond is the response's tail times the last value.
    """
    return _edges(source) + ", " + _convolved("", gain, length, f"{reach}", rate, "sum(h) OVER (ORDER BY d DESC)", source)


def _edges(source="samp"):
    return f"""ser AS (SELECT recording_id, channel, count(*) AS n, least(27, count(*) - 1) AS e FROM {source} GROUP BY 1, 2),
ext AS (SELECT recording_id, channel, sample_idx AS j, value AS x FROM {source}
 UNION ALL SELECT s.recording_id, s.channel, -b.sample_idx, 2 * a.value - b.value FROM ser s JOIN {source} a USING (recording_id, channel)
 JOIN {source} b USING (recording_id, channel) WHERE a.sample_idx = 0 AND b.sample_idx BETWEEN 1 AND e
 UNION ALL SELECT s.recording_id, s.channel, 2 * (n - 1) - b.sample_idx, 2 * a.value - b.value FROM ser s JOIN {source} a USING (recording_id, channel)
 JOIN {source} b USING (recording_id, channel) WHERE a.sample_idx = n - 1 AND b.sample_idx BETWEEN n - 1 - e AND n - 2)"""


def _convolved(name, gain, length, reach, rate, tail, source="samp"):
    return f"""spec{name} AS (SELECT k, {gain} AS g FROM (SELECT k, tan(pi() * k / {length}.0) AS w FROM range(0, {length // 2} + 1) r(k))),
taps{name} AS (SELECT d, fsum(g * cos(2 * pi() * ((d * k) % {length}) / {length}) * CASE WHEN k IN (0, {length // 2}) THEN 1 ELSE 2 END) / {length} AS h
 FROM (SELECT unnest(range(0, {reach})) AS d), spec{name} GROUP BY d),
tails{name} AS (SELECT d, h, {tail} AS t FROM taps{name}),
near{name} AS (SELECT a.recording_id, a.channel, a.sample_idx, sum(x.x * h) AS y FROM {source} a JOIN ext x ON x.recording_id = a.recording_id AND x.channel = a.channel
 JOIN taps{name} ON d = abs(x.j - a.sample_idx) GROUP BY 1, 2, 3),
filtered{name} AS (SELECT a.recording_id, a.channel, a.sample_idx, y + l.x * coalesce(p.t, 0) + r.x * coalesce(q.t, 0) AS value
 FROM near{name} a JOIN ser s USING (recording_id, channel) JOIN ext l ON l.recording_id = s.recording_id AND l.channel = s.channel AND l.j = -e
 JOIN ext r ON r.recording_id = s.recording_id AND r.channel = s.channel AND r.j = n - 1 + e
 LEFT JOIN tails{name} p ON p.d = a.sample_idx + e + 1 LEFT JOIN tails{name} q ON q.d = n + e - a.sample_idx)"""


def _eyes(rate):
    """Filtered channels of the three eye bands as ``filtered_<band>``, and what is made of them by epoch.

    A band-pass answers a constant with 0, so the tail of its response is minus the taps before it, and taps are needed
    as far as the longest recording only.
    """
    ctes = SAMP + ", " + _edges()
    for band, (low, high) in G.EYE_BANDS.items():
        tail = "-first_value(h) OVER (ORDER BY d) / 2 - coalesce(sum(CASE WHEN d > 0 THEN h END) OVER (ORDER BY d ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
        ctes += ", " + _convolved(f"_{band}", _butterworth(rate, low, high), 1 << 16, "(SELECT max(sample_idx) + 64 FROM samp)", rate, tail)
        ctes += f""", ep_{band} AS (SELECT recording_id, sample_idx // {EPOCH} AS e, sample_idx % {EPOCH} AS n, a.value AS x, b.value AS y, count(*) OVER (PARTITION BY recording_id, sample_idx // {EPOCH}) AS c
 FROM filtered_{band} a JOIN filtered_{band} b USING (recording_id, sample_idx) WHERE a.channel = 'v' AND b.channel = 'k'),
xc_{band} AS (SELECT recording_id, e, sum(x * y) AS xc, sum(x * x) AS energy FROM ep_{band} WHERE c = {EPOCH} GROUP BY 1, 2),
ac_{band} AS (SELECT a.recording_id, a.e, b.n - a.n AS lag, sum(a.x * b.x) AS r FROM ep_{band} a JOIN ep_{band} b ON a.recording_id = b.recording_id AND a.e = b.e AND b.n >= a.n WHERE a.c = {EPOCH} GROUP BY 1, 2, 3),
nb_{band} AS (SELECT *, lag(r) OVER w AS p, lead(r) OVER w AS q, first_value(r) OVER w AS r0 FROM ac_{band} WINDOW w AS (PARTITION BY recording_id, e ORDER BY lag)),
sl_{band} AS (SELECT recording_id, e, coalesce(min_by((r - r0) / nullif(lag, 0), lag) FILTER (r > p AND r > q), 0) AS slope FROM nb_{band} GROUP BY 1, 2)"""
    return ctes + """, eye AS (SELECT recording_id, e AS epoch_idx, sign(r.xc) / nullif(s.slope, 0) AS rem, b.energy * b.xc AS slow_b, (1 - t.slope) * c.xc AS slow_c
 FROM xc_rem r JOIN sl_rem s USING (recording_id, e) JOIN xc_slow_b b USING (recording_id, e) JOIN xc_slow_c c USING (recording_id, e) JOIN sl_slow_c t USING (recording_id, e))"""


EXACT = 1e-17  # responses faded so far that both engines agree at six places


def _butterworth(rate, low, high, stop=False):
    a, b = (f"tan(pi() * {f} / {rate})" for f in (low, high))
    s = f"pow((w * w - {a} * {b}) / (w * ({b} - {a})), 8)"
    return f"CASE WHEN k = 0 THEN {int(stop)} ELSE {f'1 - 1 / (1 + {s})' if stop else f'1 / (1 + {s})'} END"


def _elliptic(design):
    """The design's zeros and poles; its limits are what tests/test_signal.py checks."""
    number = lambda x: repr(float(x))
    half, parts = len(design.zeros), [number(design.floor)]
    for z, p in zip(np.abs(design.zeros) ** 2, design.poles[:half]):
        parts.append(f"pow({number(abs(p) ** 2 / z)} * ({number(z)} - o), 2) / (pow({number(abs(p) ** 2)} - o, 2) + 4 * o * {number(p.real ** 2)})")
    parts += [f"{number(abs(p) ** 2)} / (o + {number(abs(p) ** 2)})" for p in design.poles[2 * half:]]
    square = f"pow((w * w - {number(design.low * design.high)}) / (greatest(w, 1e-9) * {number(design.high - design.low)}), 2)"
    return f"(SELECT {' * '.join(parts)} FROM (SELECT {square} AS o))"


@query("band_pass", "D-06 D-20", out(SAMP + ", " + _zero_phase(_butterworth(FS, 0.3, 1.5), 2048, 512, FS), "SELECT * FROM filtered", "recording_id sample_idx", "value"))
def _(t):
    return fin(G.zero_phase_filter(samples(t), CH, "sample_idx", "value", FS, 0.3, 1.5, tol=EXACT))


NOTCH = f"WITH {SAMP}, {_zero_phase(_butterworth(FS, 0.9, 1.1, True), 8192, 2048, FS)} SELECT * FROM filtered"


# One of its values at sf0.01 lies within 2e-11 of a half of the sixth place, closer than the two engines' sums agree
# (6e-11 at most), so it rounds differently: tests/test_queries.py compares it with NOTCH unrounded.
@query("notch", "D-20")
def _(t):
    return fin(G.zero_phase_filter(samples(t), CH, "sample_idx", "value", FS, 0.9, 1.1, stop=True, tol=EXACT))


# The bands of these queries ask for a real rate; the events are read as if sampled at it.
EMG_RATE, EYE_RATE = 2500.0, 128.0
EMG_FILTER = _zero_phase(_elliptic(G.emg_design(EMG_RATE)), 1 << 15, 8192, EMG_RATE)


@query("high_pass_for_emg", "D-07", out(SAMP + ", " + EMG_FILTER, "SELECT * FROM filtered", "recording_id sample_idx", "value"))
def _(t):
    return fin(G.high_pass_for_emg(samples(t), CH, "sample_idx", "value", EMG_RATE, tol=1e-13))


def _polynomial_weights(window=9, order=4):
    """Rows of the least-squares fit: value at offset r of a window from its elements j."""
    at = np.arange(window) - window // 2
    v = np.vander(at / 4.0, order + 1, increasing=True)
    h = v @ np.linalg.inv(v.T @ v) @ v.T
    return "sg(r, j, w) AS (VALUES " + ", ".join(f"({r - 4}, {j - 4}, {float(h[r, j])!r})" for r in range(window) for j in range(window)) + ")"


# Nine bins: a polynomial of order 4 through 5 points is those points, which would leave the correlation as it is.
@query("emg_from_signals", "D-08 A-05 F-04", out(SAMP + ", " + EMG_FILTER + """, pairs AS (SELECT a.recording_id, a.sample_idx AS i, a.value AS v, b.value AS k
 FROM filtered a JOIN filtered b USING (recording_id, sample_idx) WHERE a.channel = 'v' AND b.channel = 'k'),
bins AS (SELECT recording_id, i, v, k, unnest(range(CAST(ceil((i - 4) / 4.0) AS BIGINT), CAST(floor((i + 4) / 4.0) AS BIGINT) + 1)) AS bin FROM pairs),
corr AS (SELECT recording_id, bin - 1 AS bin, covar_pop(v, k) / nullif(stddev_pop(v) * stddev_pop(k), 0) AS emg FROM bins WHERE bin >= 1 GROUP BY recording_id, bins.bin HAVING count(*) = 9), """ + _polynomial_weights() + """,
known AS (SELECT recording_id, bin, emg, row_number() OVER w - 1 AS i, greatest(4, least(count(*) OVER (PARTITION BY recording_id) - 5, row_number() OVER w - 1)) AS c
 FROM corr WHERE emg IS NOT NULL WINDOW w AS (PARTITION BY recording_id ORDER BY bin)),
soft AS (SELECT a.recording_id, a.bin, sum(sg.w * b.emg) AS smoothed FROM known a JOIN sg ON sg.r = a.i - a.c
 JOIN known b ON b.recording_id = a.recording_id AND b.i = a.c + sg.j GROUP BY 1, 2 HAVING count(*) = 9)""",
    """SELECT recording_id, bin, emg, (emg - min(emg) OVER w) / nullif(max(emg) OVER w - min(emg) OVER w, 0) AS norm, smoothed
 FROM corr LEFT JOIN soft USING (recording_id, bin) WINDOW w AS (PARTITION BY recording_id)""", "recording_id bin", "emg norm smoothed"))
def _(t):
    return fin(G.emg_from_signals(signal(t), KEY, "sample_idx", "v", "k", EMG_RATE, EMG_RATE / 4, 9, tol=1e-13))


@query("savitzky_golay", "D-09", out(SAMP + ", " + _polynomial_weights() + ", sn AS (SELECT *, greatest(4, least(count(*) OVER (PARTITION BY recording_id, channel) - 5, sample_idx)) AS c FROM samp)", "SELECT a.recording_id, a.channel, a.sample_idx, sum(sg.w * b.value) AS value FROM sn a JOIN sg ON sg.r = a.sample_idx - a.c JOIN samp b ON b.recording_id = a.recording_id AND b.channel = a.channel AND b.sample_idx = a.c + sg.j GROUP BY 1, 2, 3", "recording_id sample_idx", "value"))
def _(t):
    return fin(G.savitzky_golay(samples(t), CH, "sample_idx", "value", 9))


# A product of four filtered values reaches 10^9, so six places of it are more than a double holds: sign and log keep its digits.
@query("eye_features", "D-13 F-24", out(_eyes(EYE_RATE), "SELECT recording_id, epoch_idx, rem, sign(slow_b) * ln(1 + abs(slow_b)) AS slow_b_log, slow_c FROM eye", "recording_id epoch_idx", "rem slow_b_log slow_c"))
def _(t):
    found = G.eye_features(signal(t), KEY, "sample_idx", "v", "k", EYE_RATE, EPOCH, tol=1e-13)
    return fin(found.select(*KEY, "epoch_idx", "rem", (F.signum("slow_b") * F.log1p(F.abs("slow_b"))).alias("slow_b_log"), "slow_c"))


@query("normalised_eye_features", "D-13 F-24 W-14")
def _(t):
    return fin(G.normalised_eye_features(signal(t), KEY, "sample_idx", "v", "k", EYE_RATE, EPOCH))


SINC = """rs AS (SELECT recording_id, channel, m, m * 1.5 AS p FROM (SELECT recording_id, channel, unnest(range(CAST(ceil(count(*) * 2 / 3.0) AS BIGINT))) AS m FROM samp GROUP BY 1, 2)),
hw AS (SELECT rs.recording_id, rs.channel, m, value, CASE WHEN p = sample_idx THEN 1.0 ELSE sin(pi() * (p - sample_idx) * 2 / 3) / (pi() * (p - sample_idx) * 2 / 3) END
 * CASE WHEN abs(p - sample_idx) < 15 THEN 0.5 + 0.5 * cos(pi() * (p - sample_idx) / 15) ELSE 0 END AS h
 FROM rs JOIN samp ON rs.recording_id = samp.recording_id AND rs.channel = samp.channel AND sample_idx BETWEEN floor(p) - 14 AND floor(p) + 15)"""


@query("resample", "D-14", out(SAMP + ", " + SINC, "SELECT recording_id, channel, m AS sample_idx, sum(h * value) / sum(h) AS value FROM hw GROUP BY 1, 2, 3", "recording_id sample_idx", "value"))
def _(t):
    return fin(G.resample(samples(t), CH, "sample_idx", "value", 2, 3))
