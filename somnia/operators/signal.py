"""Spectra, filters and resampling on framed signals.

Spark cuts a channel into frames of bounded length (an epoch, or a chunk with
the samples on both sides that a filter needs), spreads the frames over tasks
and hands them to numpy in Arrow batches. No task sees a whole recording.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from somnia.schemas import CHANNEL_BANDS, EEG_BANDS, RAT_BANDS
from somnia.session import materialise

from .ordered import chunk_of, halo, ordinal

ARRAY = T.ArrayType(T.DoubleType())
FRAME = 1 << 14  # samples of a chunk that is handed to numpy as one array
#: Hz of the rapid-eye and the two slow-eye measures.
EYE_BANDS = {"rem": (0.3, 35.0), "slow_b": (0.1, 0.45), "slow_c": (0.3, 0.45)}


def frames(df: DataFrame, keys: list[str], idx: str, value: str | list[str], size: int,
           hop: int | None = None) -> DataFrame:
    """Whole frames of ``size`` samples as one array; the array is never longer.

    Frames start every ``hop`` samples, end to end by default. For a list of
    columns there is one array ``frame_<column>`` each.
    """
    columns = [value] if isinstance(value, str) else value
    item = F.struct(F.col(idx), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    if hop is None or hop == size:
        rows = df.withColumn("_frame", chunk_of(idx, size))
    else:
        first = F.greatest(F.floor((F.col(idx) - size) / F.lit(hop)).cast("long") + 1, F.lit(0).cast("long"))
        rows = df.withColumn("_frame", F.explode(F.sequence(first, chunk_of(idx, hop))))
    out = rows.groupBy(*keys, F.col("_frame").alias("epoch_idx")).agg(F.sort_array(F.collect_list(item)).alias("_f"))
    names = ["frame"] if isinstance(value, str) else [f"frame_{c}" for c in columns]
    return out.where(F.size("_f") == size).select(
        *keys, "epoch_idx", *[F.col(f"_f.x{i}").alias(n) for i, n in enumerate(names)])


def _stack(col: pd.Series) -> np.ndarray:
    return np.stack(col.to_numpy()).astype(np.float64)


def _rows(a: np.ndarray) -> pd.Series:
    return pd.Series(list(a))


@lru_cache(maxsize=32)
def slepian_tapers(n: int, half_bandwidth: float = 4.0, count: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """Leading Slepian sequences of length ``n`` and their energy concentration.

    They are eigenvectors of a symmetric tridiagonal matrix: eigenvalues by
    bisection on sign changes, vectors by inverse iteration. Tapers are built
    for one point more and cut, as for spectra; those that keep less than 0.9
    of their energy in the band are left out.
    """
    m = n + 1
    w = half_bandwidth / m
    k = np.arange(m)
    diag = ((m - 1 - 2 * k) / 2.0) ** 2 * math.cos(2 * math.pi * w)
    off = k[1:] * (m - k[1:]) / 2.0
    count = min(count, n)
    if m <= 1024:
        full = np.diag(diag) + np.diag(off, 1) + np.diag(off, -1)
        vecs = np.linalg.eigh(full)[1][:, ::-1][:, :count].T.copy()
    else:
        vecs = _leading_vectors(diag, off, count)
    for j, x in enumerate(vecs):
        # Sign: even tapers have a positive mean, odd ones start upward.
        if (j % 2 == 0 and x.sum() < 0) or (j % 2 and ((m - 1 - 2 * k) * x).sum() < 0):
            vecs[j] = -x
    size = 1 << (2 * m - 1).bit_length()
    spec = np.fft.rfft(vecs, size)
    auto = np.fft.irfft(np.abs(spec) ** 2, size)[:, :m]
    r = 4 * w * np.sinc(2 * w * k)
    r[0] = 2 * w
    ratios = auto @ r
    vecs = vecs[:, :n]
    keep = ratios > 0.9
    if not keep.any():
        keep[np.argmax(ratios)] = True
    return vecs[keep], ratios[keep]


def _leading_vectors(diag, off, count):
    m = len(diag)
    span = np.abs(np.r_[0, off]) + np.abs(np.r_[off, 0])
    lo = np.full(count, (diag - span).min())
    hi = np.full(count, (diag + span).max())
    sq = off ** 2
    want = np.arange(count)
    for _ in range(64):
        mid = (lo + hi) / 2
        q = diag[0] - mid
        above = (q > 0).astype(int)
        for i in range(1, m):
            q = diag[i] - mid - sq[i - 1] / np.where(q == 0, 1e-300, q)
            above += q > 0
        up = above > want
        lo, hi = np.where(up, mid, lo), np.where(up, hi, mid)
    vecs = np.empty((count, m))
    for j, lam in enumerate((lo + hi) / 2):
        d, e = (diag - lam).tolist(), off.tolist()
        x = np.cos(np.arange(m) * math.pi * j / m + 0.3)
        for _ in range(3):
            x = _solve_tridiagonal(d, e, x.tolist())
            x /= np.abs(x).max()
            x /= np.linalg.norm(x)
        for prev in vecs[:j]:
            x = x - prev * (prev @ x)
        x /= np.linalg.norm(x)
        vecs[j] = x
    return vecs


def _solve_tridiagonal(d, e, b):
    """Symmetric tridiagonal solve with row exchanges, on plain floats."""
    n = len(d)
    up1, up2, dd, rhs = e[:] + [0.0], [0.0] * n, d[:], b[:]
    for i in range(n - 1):
        low = e[i]
        if abs(dd[i]) >= abs(low):
            f = low / (dd[i] or 1e-300)
            dd[i + 1] -= f * up1[i]
            rhs[i + 1] -= f * rhs[i]
        else:
            f = dd[i] / low
            dd[i], u1, old1 = low, dd[i + 1], up1[i]
            dd[i + 1], up1[i] = old1 - f * u1, u1
            if i + 1 < n - 1:
                up2[i] = up1[i + 1]
                up1[i + 1] = -f * up1[i + 1]
            rhs[i], rhs[i + 1] = rhs[i + 1], rhs[i] - f * rhs[i + 1]
    x = [0.0] * n
    for i in range(n - 1, -1, -1):
        s = rhs[i]
        if i + 1 < n:
            s -= up1[i] * x[i + 1]
        if i + 2 < n:
            s -= up2[i] * x[i + 2]
        x[i] = s / (dd[i] or 1e-300)
    return np.array(x)


def multitaper_spectrum(x: np.ndarray, tapers: np.ndarray, ratios: np.ndarray) -> np.ndarray:
    """One-sided multitaper power of each row; rows lose their mean first."""
    x = x - x.mean(axis=1, keepdims=True)
    total = 0.0
    for taper, weight in zip(tapers, ratios):
        spec = np.fft.rfft(x * taper, axis=1)
        spec[:, 0] /= math.sqrt(2)
        if x.shape[1] % 2 == 0:
            spec[:, -1] /= math.sqrt(2)
        total = total + weight * np.abs(spec) ** 2
    return 2 * total / ratios.sum()


def multitaper_band_power(df: DataFrame, keys: list[str], idx: str, fs: float, size: int,
                          bands: dict[str, tuple[str, float, float]] = RAT_BANDS) -> DataFrame:
    """Power of each epoch summed over the bins of each band, ends included.

    A band names the column it is measured on; all columns of an epoch are
    framed in the same shuffle.
    """
    tapers, ratios = slepian_tapers(size)
    freqs = np.fft.rfftfreq(size, 1 / fs)
    columns = sorted({c for c, _, _ in bands.values()})
    out, at = frames(df, keys, idx, columns, size), {}
    for c in columns:
        mine = [(b, lo, hi) for b, (col, lo, hi) in bands.items() if col == c]
        masks = np.stack([(freqs >= lo) & (freqs <= hi) for _, lo, hi in mine]).astype(float)
        out = out.withColumn(f"_p_{c}", _band_udf(tapers, ratios, masks)(f"frame_{c}"))
        at.update({b: F.col(f"_p_{c}")[i].alias(b) for i, (b, _, _) in enumerate(mine)})
    return out.select(*keys, "epoch_idx", *[at[b] for b in bands])


def _band_udf(tapers, ratios, masks):
    @F.pandas_udf(ARRAY)
    def powers(frame: pd.Series) -> pd.Series:
        return _rows(multitaper_spectrum(_stack(frame), tapers, ratios) @ masks.T)
    return powers


def _spectrum(size: int, fs: float, window: str):
    """Arrow function from frames to one-sided power at each FFT bin."""
    if window == "multitaper":
        tapers, ratios = slepian_tapers(size)
        power = lambda x: multitaper_spectrum(x, tapers, ratios)
    else:
        # Raised-cosine weights of the two windows.
        a = {"hamming": 0.54, "hann": 0.5}[window]
        win = a - (1 - a) * np.cos(2 * np.pi * np.arange(size) / size)
        scale = 1.0 / (fs * (win ** 2).sum())

        def power(x):
            p = np.abs(np.fft.rfft((x - x.mean(axis=1, keepdims=True)) * win, axis=1)) ** 2 * scale
            p[:, 1:(-1 if size % 2 == 0 else None)] *= 2
            return p

    @F.pandas_udf(ARRAY)
    def run(frame: pd.Series) -> pd.Series:
        return _rows(power(_stack(frame)))

    return run


def welch(df: DataFrame, keys: list[str], idx: str, value: str, fs: float, size: int,
          overlap: int | None = None, window: str = "hamming") -> DataFrame:
    """Mean periodogram per key, as rows ``freq`` and ``psd``.

    Frames lose their mean and overlap by ``overlap`` samples: none with the
    Hamming window, half a frame with the Hann window, unless given.
    """
    overlap = (size // 2 if window == "hann" else 0) if overlap is None else overlap
    run = _spectrum(size, fs, window)
    per = frames(df, keys, idx, value, size, size - overlap).withColumn("_p", run("frame"))
    mean = per.groupBy(*keys).agg(F.array(*[F.avg(F.col("_p")[i]) for i in range(size // 2 + 1)]).alias("_p"))
    return _freq_rows(mean, keys, "_p", fs, size)


def _freq_rows(df, keys, power, fs, size):
    return df.select(*keys, F.posexplode(power).alias("_i", "psd")).select(
        *keys, (F.col("_i") * F.lit(fs / size)).alias("freq"), "psd")


def epoch_spectrum(df: DataFrame, keys: list[str], idx: str, value: str, fs: float, size: int,
                   window: str = "multitaper") -> DataFrame:
    """Power of each whole epoch at each frequency."""
    run = _spectrum(size, fs, window)
    out = frames(df, keys, idx, value, size).withColumn("_p", run("frame"))
    return _freq_rows(out, [*keys, "epoch_idx"], "_p", fs, size)


def band_powers(spectrum: DataFrame, keys: list[str], fs: float, size: int,
                bands: dict[str, tuple[float, float]] = CHANNEL_BANDS) -> DataFrame:
    """Area under the spectrum in each band by trapezoids, band ends included.

    Bins are evenly spaced, so the area is the sum of the bins less half of the
    first and last one in the band: plain conditional sums, no ordering.
    """
    step = fs / size
    at = [step * i for i in range(size // 2 + 1)]
    outs = []
    for name, (lo, hi) in bands.items():
        inside = [i for i, f in enumerate(at) if lo <= f <= hi]
        if len(inside) < 2:
            outs.append(F.struct(F.lit(name).alias("band"), F.lit(0.0).alias("power")))
            continue
        k = F.round(F.col("freq") / step).cast("int")
        weight = F.when((k == inside[0]) | (k == inside[-1]), 0.5).otherwise(1.0)
        area = F.sum(F.when(k.between(inside[0], inside[-1]), F.col("psd") * weight)) * step
        outs.append(F.struct(F.lit(name).alias("band"), area.alias("power")))
    per = spectrum.groupBy(*keys).agg(F.array(*outs).alias("_b"))
    return per.select(*keys, F.explode("_b").alias("_r")).select(*keys, "_r.*")


def relative_band_power(spectrum: DataFrame, keys: list[str], bands: dict[str, tuple[float, float]] = EEG_BANDS,
                        lo: float = 0.5, hi: float = 30.0) -> DataFrame:
    """Mean share of the total power per bin in each half-open band."""
    rows = spectrum.where(F.col("freq").between(lo, hi))
    total = F.sum("psd")
    return rows.groupBy(*keys).agg(*[
        (F.avg(F.when((F.col("freq") >= a) & (F.col("freq") < b), F.col("psd"))) / F.nullif(total, F.lit(0.0))).alias(name)
        for name, (a, b) in bands.items()])


def rank_channels(powers: DataFrame, by: list[str], n_top: int | None = None) -> DataFrame:
    """Channels by power within each band."""
    w = Window.partitionBy(*by, "band").orderBy(F.col("power").desc(), "channel")
    out = powers.withColumn("rank", F.row_number().over(w))
    return out.where(F.col("rank") <= n_top) if n_top else out


def padded_chunks(df: DataFrame, keys: list[str], idx: str, value: str, pad: int, chunk: int) -> DataFrame:
    """Chunks as arrays with up to ``pad`` samples of both neighbours.

    ``_skip`` samples precede the chunk's own ``_own``; fewer than ``pad``
    before or behind mean a recording edge.
    """
    rows, _ = halo(df.select(*keys, idx, value), keys, idx, pad, pad, chunk)
    item = F.struct(F.col(idx).alias("i"), F.col(value).cast("double").alias("x"), F.col("_core").alias("own"))
    out = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(item)).alias("_f"))
    own = F.filter("_f", lambda r: r["own"])
    return (out.withColumn("_own", own).where(F.size("_own") > 0)
            .select(*keys, F.col("_own")[0]["i"].alias("_start"), F.size("_own").alias("_size"),
                    (F.col("_own")[0]["i"] - F.col("_f")[0]["i"]).cast("int").alias("_skip"), F.col("_f.x").alias("frame")))


def _unchunk(out: DataFrame, keys: list[str], idx: str, value: str) -> DataFrame:
    rows = out.select(*keys, "_start", F.posexplode("_y").alias("_k", value))
    return rows.select(*keys, (F.col("_start") + F.col("_k")).alias(idx), value)


def squared_response(n: int, fs: float, low: float | None, high: float | None, order: int = 4,
                     stop: bool = False) -> np.ndarray:
    """``|H|^2`` of a digital Butterworth filter at the bins of a length-``n`` FFT.

    Running such a filter forward and backward multiplies the spectrum by it,
    with no phase. ``low`` alone passes what is above it, ``high`` alone what
    is below, both pass (or ``stop``) the band between.
    """
    warp = lambda f: math.tan(math.pi * f / fs)
    k = np.minimum(np.arange(n // 2 + 1) / n, 0.5 - 1e-12)
    w = np.tan(np.pi * k)
    with np.errstate(divide="ignore", over="ignore"):
        if low and high:
            a, b = warp(low), warp(high)
            s = (w ** 2 - a * b) / (w * (b - a))
            s = 1 / s if stop else s
        elif low:
            s = warp(low) / w
        else:
            s = w / warp(high)
        return 1 / (1 + s ** (2 * order))


def _fade(poles: np.ndarray, tol: float) -> int:
    """Samples until a digital filter with these analogue poles (rate 1) has faded to ``tol``: the slowest pole decides."""
    return int(math.ceil(math.log(tol) / math.log(np.abs((1 + poles) / (1 - poles)).max())))


def settle_length(fs: float, low: float | None, high: float | None, order: int = 4, tol: float = 1e-7) -> int:
    """Samples until the impulse response of the filter has faded to ``tol``, from the pole nearest the unit circle."""
    edges = [f for f in (low, high) if f]
    if not edges or min(edges) <= 0 or max(edges) >= fs / 2 or (low and high and low >= high):
        raise ValueError(f"band {low} to {high} does not fit a rate of {fs}")
    warp = lambda f: math.tan(math.pi * f / fs)
    proto = np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    # The poles of a stop band are those of the band: the prototype's are closed under inversion.
    return _fade(_placed(proto, low and warp(low), high and warp(high)), tol)


def _placed(proto: np.ndarray, low: float | None, high: float | None) -> np.ndarray:
    """Poles of a low-pass prototype moved to the warped band."""
    if low and high:
        half = proto * (high - low) / 2
        root = np.sqrt(half ** 2 - low * high)
        return np.r_[half + root, half - root]
    return low / proto if low else high * proto


def _moduli(k: float) -> list[float]:
    """Descending Landen moduli of ``k`` until they vanish."""
    out = []
    while k > 1e-17 and len(out) < 12:
        k = (k / (1 + math.sqrt(max(1 - k * k, 0.0)))) ** 2
        out.append(k)
    return out


def _cd(u, k: float):
    """Jacobi cd of ``u`` quarter periods, by ascending the moduli."""
    w = np.cos(np.asarray(u, complex) * np.pi / 2)
    for v in reversed(_moduli(k)):
        w = (1 + v) * w / (1 + v * w ** 2)
    return w


def _inverse_sn(w: complex, k: float) -> complex:
    """The ``u`` in quarter periods with sn(u) = w, by descending the moduli."""
    before = k
    for v in _moduli(k):
        w = 2 * w / ((1 + v) * (1 + np.sqrt(1 - before ** 2 * w ** 2 + 0j)))
        before = v
    return 2 / np.pi * np.arcsin(w + 0j)


class Elliptic:
    """Digital elliptic filter from limits: at most ``loss`` dB between the pass edges, at least ``attenuation`` dB beyond the stop edges.

    An edge may be None on the side that is open; a stop edge at half the rate or beyond sets no limit. The order is the
    least that keeps both limits, from the ratio of the quarter periods of the selectivity and of the two ripples.
    """

    def __init__(self, fs: float, passes: tuple[float | None, float | None], stops: tuple[float | None, float | None],
                 loss: float = 1.0, attenuation: float = 60.0):
        (low, high), warp = passes, lambda f: math.tan(math.pi * f / fs)
        given = [f for f in (stops[0], low, high, stops[1]) if f is not None]
        if not (low or high) or any(f <= 0 for f in given) or given != sorted(set(given)) or max(f for f in passes if f) >= fs / 2 or bool(low) != bool(stops[0]) or bool(high) != bool(stops[1]):
            raise ValueError(f"pass {passes} and stop {stops} do not fit a rate of {fs}")
        self.fs, self.low, self.high = fs, low and warp(low), high and warp(high)
        ripple, depth = math.sqrt(10 ** (loss / 10) - 1), math.sqrt(10 ** (attenuation / 10) - 1)
        edge = min(abs(self._prototype(warp(f))) for f in stops if f and f < fs / 2)
        ratio = ripple / depth
        quarter = lambda k: math.pi / 2 * math.prod(1 + v for v in _moduli(k))
        other = lambda k: math.sqrt(1 - k * k)
        degree = quarter(1 / edge) * quarter(other(ratio)) / (quarter(other(1 / edge)) * quarter(ratio))
        n = self.order = max(1, math.ceil(degree - 1e-9))
        # The selectivity that this order reaches exactly with both ripples.
        u = (2 * np.arange(1, n // 2 + 1) - 1) / n
        sn = lambda x, k: _cd(1 - x, k)
        k = self.selectivity = other(float(np.real(other(ratio) ** n * np.prod(sn(u, other(ratio)) ** 4)))) if n > 1 else ratio
        centre = -1j / n * _inverse_sn(1j / ripple, ratio)
        self.zeros = 1j / (k * _cd(u, k))
        pairs = 1j * _cd(u - 1j * centre, k)
        self.poles = np.r_[pairs, pairs.conj(), [1j * _cd(1 - 1j * centre, k)] if n % 2 else []]
        self.floor = 1.0 if n % 2 else 10 ** (-loss / 10)

    def _prototype(self, w):
        """Place of a warped frequency on the axis of the low-pass prototype, whose pass edge is 1."""
        if self.low and self.high:
            return (w ** 2 - self.low * self.high) / (w * (self.high - self.low))
        return self.low / w if self.low else w / self.high

    def power(self, f) -> np.ndarray:
        """Share of the power at frequency ``f`` that one pass leaves."""
        w = np.tan(np.pi * np.minimum(np.asarray(f, float) / self.fs, 0.5 - 1e-12))
        with np.errstate(divide="ignore"):
            s = np.clip(self._prototype(w), -1e12, 1e12)[..., None] * 1j
        half = len(self.zeros)
        pairs = np.abs((s - self.zeros) * (s + self.zeros) / ((s - self.poles[:half]) * (s - self.poles[half:2 * half]))) ** 2
        scale = np.abs(self.poles[:half] / self.zeros) ** 4
        real = np.abs(self.poles[2 * half:] / (s - self.poles[2 * half:])) ** 2
        return self.floor * (pairs * scale).prod(-1) * real.prod(-1)

    def settle(self, tol: float = 1e-7) -> int:
        return _fade(_placed(self.poles, self.low, self.high), tol)


def _filtered(x, skip, n, settle, edge, response):
    """The ``n`` own samples after ``skip`` others of one frame; ``response`` gives the filter at a length."""
    left, right = settle - skip, settle - (len(x) - skip - n)
    y = _extend(x, left, right, min(edge, len(x) - 1))
    m = 1 << (len(y) - 1).bit_length()
    z = np.fft.irfft(np.fft.rfft(_hold(y, m)) * response(m), m)
    return z[settle:settle + n].copy()  # a view would keep the whole frame, for each frame of a batch


def zero_phase_filter(df: DataFrame, keys: list[str], idx: str, value: str, fs: float, low: float | None = None,
                      high: float | None = None, order: int = 4, stop: bool = False, settle: int | None = None,
                      edge: int = 27, chunk: int | None = None, tol: float = 1e-7) -> DataFrame:
    """Zero-phase Butterworth filter, chunk by chunk.

    Each chunk is filtered together with ``settle`` samples on both sides, as many as the impulse response needs to fade
    to ``tol`` (``settle_length``), so the result does not depend on ``chunk``. Its default grows with ``settle``: at most half as
    many samples again are copied. At recording edges the signal is continued by odd reflection over ``edge`` samples,
    then held. A ``settle`` too short for the band, or a band that does not fit the rate, is an error.
    """
    needed = settle_length(fs, low, high, order, tol)
    return _zero_phase(df, keys, idx, value, lambda m: squared_response(m, fs, low, high, order, stop), needed, settle, edge, chunk)


def zero_phase_elliptic(df: DataFrame, keys: list[str], idx: str, value: str, design: Elliptic, settle: int | None = None,
                        edge: int = 27, chunk: int | None = None, tol: float = 1e-7) -> DataFrame:
    """An elliptic filter run forward and backward: its limits hold for each of the two runs. Chunks and edges as above."""
    return _zero_phase(df, keys, idx, value, lambda m: design.power(np.arange(m // 2 + 1) * design.fs / m), design.settle(tol), settle, edge, chunk)


def _zero_phase(df, keys, idx, value, response, needed, settle, edge, chunk):
    needed = max(needed, edge + 1)
    if settle is not None and settle < needed:
        raise ValueError(f"settle {settle} is shorter than the {needed} samples this band needs")
    settle = settle or needed
    chunk = chunk or max(FRAME, 4 * settle)

    @F.pandas_udf(ARRAY)
    def run(frame: pd.Series, skip: pd.Series, size: pd.Series) -> pd.Series:
        gains = lru_cache(response)
        return pd.Series([_filtered(np.asarray(x, dtype=np.float64), s, n, settle, edge, gains) for x, s, n in zip(frame, skip, size)])

    out = padded_chunks(df, keys, idx, value, settle, chunk)
    return _unchunk(out.withColumn("_y", run("frame", "_skip", "_size")), keys, idx, value)


def _extend(x, left, right, edge):
    if left > 0:
        head = 2 * x[0] - x[edge:0:-1] if edge else x[:0]
        head = np.r_[np.full(max(left - len(head), 0), head[0] if len(head) else x[0]), head][-left:]
        x = np.r_[head, x]
    if right > 0:
        tail = 2 * x[-1] - x[-2:-edge - 2:-1] if edge else x[:0]
        tail = np.r_[tail, np.full(max(right - len(tail), 0), tail[-1] if len(tail) else x[-1])][:right]
        x = np.r_[x, tail]
    return x


def _hold(y, m):
    """Fill up to ``m`` samples, going smoothly from the last value to the first."""
    gap = m - len(y)
    ramp = np.linspace(y[-1], y[0], gap + 2)[1:-1] if gap else y[:0]
    return np.r_[y, ramp]


def emg_design(fs: float, loss: float = 1.0, attenuation: float = 60.0) -> Elliptic:
    """What is above 300 Hz and 25 Hz below the top, which is 625 Hz or half the rate; 25 Hz wide edges on both sides."""
    top = min(625.0, fs / 2)
    return Elliptic(fs, (300.0, top - 25), (275.0, top), loss, attenuation)


def high_pass_for_emg(df: DataFrame, keys: list[str], idx: str, value: str, fs: float, design: Elliptic | None = None,
                      chunk: int | None = None, tol: float = 1e-7) -> DataFrame:
    """Zero-phase elliptic band for the muscle signal, ``emg_design`` unless another is given. A rate that it does not fit is an error."""
    return zero_phase_elliptic(df, keys, idx, value, design or emg_design(fs), chunk=chunk, tol=tol)


def savitzky_golay(df: DataFrame, keys: list[str], idx: str, value: str, window: int, order: int = 4,
                   chunk: int = FRAME) -> DataFrame:
    """Local polynomial smoothing; the first and last half window are read off
    the polynomial of the first and last whole window.

    ``window`` is odd. A recording shorter than it gives NULL.
    """
    half = window // 2
    t = np.arange(window) - half
    fit = np.linalg.pinv(np.vander(t.astype(float) / max(half, 1), order + 1, increasing=True))
    at = lambda u: np.vander(np.atleast_1d(u).astype(float) / max(half, 1), order + 1, increasing=True) @ fit

    @F.pandas_udf(ARRAY)
    def run(frame: pd.Series, skip: pd.Series, size: pd.Series) -> pd.Series:
        mid = at(0)[0]
        out = []
        for x, s, n in zip(frame, skip, size):
            x = np.asarray(x, dtype=np.float64)
            if len(x) < window:
                out.append(np.full(n, np.nan))
                continue
            y = np.full(len(x), np.nan)
            y[half:len(x) - half] = np.correlate(x, mid, "valid")
            y[:half] = at(t[:half]) @ x[:window]
            y[len(x) - half:] = at(t[half + 1:]) @ x[-window:]
            out.append(y[s:s + n])
        return pd.Series(out)

    # Enough of the neighbours that an edge window lies whole inside one array.
    out = padded_chunks(df, keys, idx, value, window, chunk)
    out = _unchunk(out.withColumn("_y", run("frame", "_skip", "_size")), keys, idx, value)
    return out.withColumn(value, F.nanvl(F.col(value), F.lit(None).cast("double")))


def resample(df: DataFrame, keys: list[str], idx: str, value: str, up: int, down: int, chunk: int = FRAME,
             taps: int = 10) -> DataFrame:
    """Change the rate by ``up / down`` with a windowed-sinc low-pass.

    Our reading of a named rate change. Each output sample is a weighted sum of
    the inputs around it, so chunks only need a fixed reach of neighbours.
    """
    cut = min(1.0, up / down)
    reach = int(math.ceil(taps / cut))

    @F.pandas_udf(ARRAY)
    def run(frame: pd.Series, skip: pd.Series, size: pd.Series, start: pd.Series) -> pd.Series:
        out = []
        for x, s, n, i0 in zip(frame, skip, size, start):
            x = np.asarray(x, dtype=np.float64)
            first, last = -(-int(i0) * up // down), -(-(int(i0) + int(n)) * up // down)
            pos = np.arange(first, last) * down / up - i0 + s
            lo = np.floor(pos).astype(int)
            k = lo[:, None] + np.arange(-reach + 1, reach + 1)
            d = pos[:, None] - k
            h = cut * np.sinc(cut * d) * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0.0)
            h = h * ((k >= 0) & (k < len(x)))
            out.append((h * x[np.clip(k, 0, len(x) - 1)]).sum(axis=1) / h.sum(axis=1))
        return pd.Series(out)

    out = padded_chunks(df, keys, idx, value, reach + 1, chunk)
    out = out.withColumn("_y", run("frame", "_skip", "_size", "_start"))
    return _unchunk(out.withColumn("_start", F.ceil(F.col("_start") * up / F.lit(down)).cast("long")), keys, idx, value)


def autocorrelation_slope(df: DataFrame, keys: list[str], idx: str, value: str, size: int) -> DataFrame:
    """Slope from lag 0 to the first local maximum of each epoch's autocorrelation; 0 if none."""

    return frames(df, keys, idx, value, size).select(*keys, "epoch_idx", _peak_slope()("frame").alias("slope"))


def _peak_slope():
    @F.pandas_udf("double")
    def slope(frame: pd.Series) -> pd.Series:
        x = _stack(frame)
        n = 1 << (2 * x.shape[1] - 1).bit_length()
        ac = np.fft.irfft(np.abs(np.fft.rfft(x, n, axis=1)) ** 2, n, axis=1)[:, :x.shape[1]]
        return pd.Series([_first_peak_slope(row) for row in ac])

    return slope


def _first_peak_slope(ac):
    i, n = 1, len(ac)
    tol = 1e-9 * max(abs(ac[0]), 1e-300)  # FFT dust must not split a plateau
    while i < n - 1:
        if ac[i] > ac[i - 1] + tol:
            j = i
            while j + 1 < n - 1 and abs(ac[j + 1] - ac[i]) <= tol:
                j += 1
            if ac[j + 1] < ac[i] - tol:
                p = (i + j) // 2
                return (ac[p] - ac[0]) / p
            i = j
        i += 1
    return 0.0


def zero_phase_filters(df: DataFrame, keys: list[str], idx: str, outputs: dict[str, tuple[str, float | None, float | None]],
                       fs: float, order: int = 4, edge: int = 27, chunk: int | None = None, tol: float = 1e-7) -> DataFrame:
    """Several zero-phase Butterworth filters of several columns in one step: ``outputs`` maps a name to (column, low, high).

    One halo as wide as the slowest band asks for, one shuffle, and one Arrow step in which a frame is filtered for every
    output. Chunks and edges are those of ``zero_phase_filter``.
    """
    settle = max(edge + 1, *[settle_length(fs, low, high, order, tol) for _, low, high in outputs.values()])
    chunk = chunk or max(FRAME, 4 * settle)
    columns = sorted({column for column, _, _ in outputs.values()})

    @F.pandas_udf(ARRAY)
    def run(frame: pd.Series, skip: pd.Series, size: pd.Series) -> pd.Series:
        gains = [lru_cache(lambda m, low=low, high=high: squared_response(m, fs, low, high, order)) for _, low, high in outputs.values()]
        done = []
        for flat, s, n in zip(frame, skip, size):
            x = np.asarray(flat, dtype=np.float64).reshape(len(columns), -1)
            done.append(np.concatenate([_filtered(x[columns.index(c)], s, n, settle, edge, g) for (c, _, _), g in zip(outputs.values(), gains)]))
        return pd.Series(done)

    rows, _ = halo(df.select(*keys, idx, *columns), keys, idx, settle, settle, chunk)
    item = F.struct(F.col(idx).alias("i"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(columns)], F.col("_core").alias("own"))
    out = rows.groupBy(*keys, "_chunk").agg(F.sort_array(F.collect_list(item)).alias("_f"))
    out = out.withColumn("_own", F.filter("_f", lambda r: r["own"])).where(F.size("_own") > 0)
    first, size = F.col("_own")[0]["i"], F.size("_own")
    out = out.select(*keys, first.alias("_start"), size.alias("_size"),
                     run(F.concat(*[F.col(f"_f.x{k}") for k in range(len(columns))]), (first - F.col("_f")[0]["i"]).cast("int"), size).alias("_y"))
    rows = out.select(*keys, "_start", "_size", "_y", F.explode(F.sequence(F.lit(0), F.col("_size") - 1)).alias("_k"))
    return rows.select(*keys, (F.col("_start") + F.col("_k")).alias(idx),
                       *[F.col("_y")[F.col("_k") + k * F.col("_size")].alias(name) for k, name in enumerate(outputs)])


def eye_features(df: DataFrame, keys: list[str], idx: str, a: str, b: str, fs: float, size: int,
                 bands: dict[str, tuple[float, float]] = EYE_BANDS, chunk: int | None = None, tol: float = 1e-7) -> DataFrame:
    """Rapid-eye and two slow-eye measures of each epoch from two eye channels.

    ``bands`` are in Hz and must fit the rate. Quantities that would divide by 0 or take the log of a negative number are
    NULL. All bands of both channels are filtered in one step and an epoch is put together once.
    """
    from somnia.functions.scalar import sign_over_slope
    wanted = {f"_{band}_{c}": (c, *bands[band]) for band in ("rem", "slow_b", "slow_c") for c in (a, b)}
    whole = frames(zero_phase_filters(df, keys, idx, wanted, fs, chunk=chunk, tol=tol), keys, idx, list(wanted), size)

    def dot(x, y):
        both = F.zip_with(f"frame__{x}", f"frame__{y}", lambda u, v: u * v)
        return F.aggregate(both, F.lit(0.0), lambda s, v: s + v)

    xc = lambda band: dot(f"{band}_{a}", f"{band}_{b}")
    slope = _peak_slope()
    found = whole.withColumns({"_s": slope(f"frame__rem_{a}"), "_c": slope(f"frame__slow_c_{a}")})
    return found.select(*keys, "epoch_idx", sign_over_slope(xc("rem"), "_s").alias("rem"),
                        (F.abs(dot(f"slow_b_{a}", f"slow_b_{a}")) * xc("slow_b")).alias("slow_b"),
                        ((1 - F.col("_c")) * xc("slow_c")).alias("slow_c"))


def normalised_eye_features(df: DataFrame, keys: list[str], idx: str, a: str, b: str, fs: float, size: int,
                            bands: dict[str, tuple[float, float]] = EYE_BANDS, chunk: int | None = None) -> DataFrame:
    """``eye_features`` of channels normalised by percentiles; the rapid-eye measure logged and normalised by percentiles.

    Adds ``rem_norm``, NULL where the measure is not positive; such epochs do not count towards the percentiles.
    """
    from .epochs import normalise_percentile
    from somnia.functions.scalar import safe_ln
    rows = normalise_percentile(df.select(*keys, idx, a, b), keys, idx, [a, b])
    found = materialise(eye_features(rows, keys, idx, a, b, fs, size, bands, chunk))
    return normalise_percentile(found.withColumn("rem_norm", safe_ln("rem")), keys, "epoch_idx", ["rem_norm"])


def emg_from_signals(df: DataFrame, keys: list[str], idx: str, a: str, b: str, fs: float, rate: float = 5.0,
                     window: int | None = None, design: Elliptic | None = None, chunk: int = FRAME, tol: float = 1e-7) -> DataFrame:
    """Muscle-tone proxy: correlation of two high-passed channels at ``rate`` Hz,
    its 0-to-1 form and its smoothed form. ``design`` and ``tol`` as in ``high_pass_for_emg``.

    The smoothing is of order 4 over ``window`` bins that have a value, so up to 5 it returns what it is given; a
    recording with fewer has no smoothed form. Writes one row per bin to the shared folder."""
    from .epochs import norm_to_range, windowed_correlation
    fa = high_pass_for_emg(df, keys, idx, a, fs, design, tol=tol)
    fb = high_pass_for_emg(df, keys, idx, b, fs, design, tol=tol)
    step = round(fs / rate)
    # Read by the norm and the smoothing, and made by two filters over all samples: written once.
    emg = materialise(windowed_correlation(fa.join(fb, [*keys, idx]), keys, idx, step, a, b).withColumnRenamed("corr", "emg"))
    both = norm_to_range(emg.withColumn("norm", F.col("emg")), keys, "bin", "norm", chunk=chunk)
    window = window or int(fs) | 1
    # Bins without a value are left out, so the others are numbered anew for a window that counts places.
    known = ordinal(emg.where(F.col("emg").isNotNull()), keys, "bin", "_at", chunk)
    soft = savitzky_golay(known, keys, "_at", "emg", window, chunk=chunk).withColumnRenamed("emg", "smoothed")
    soft = known.drop("emg").join(soft, [*keys, "_at"]).drop("_at")
    return both.join(soft, [*keys, "bin"], "left")


def elastic(signal: Column, labels: Column, shift: Column, alpha, sigma, background: float = 0.0) -> Column:
    """Stretch a sequence in time by smoothed random offsets.

    ``shift`` is an array of uniform draws in [-1, 1); ``alpha`` scales the
    offsets and ``sigma`` smooths them, as numbers or columns. Signals are
    interpolated linearly, labels by nearest neighbour; beyond the ends signals
    are ``background`` and labels 0. Returns a struct of ``signal`` and ``labels``.
    """

    @F.pandas_udf("signal array<double>, labels array<int>")
    def run(x: pd.Series, y: pd.Series, u: pd.Series, al: pd.Series, sg: pd.Series) -> pd.DataFrame:
        sig, lab = [], []
        for xs, ys, us, a, s in zip(x, y, u, al, sg):
            n, radius = len(xs), int(4.0 * s + 0.5)
            g = np.exp(-0.5 * (np.arange(-radius, radius + 1) / s) ** 2)
            smooth = np.convolve(np.asarray(us, float), g / g.sum(), "full")[radius:radius + n]
            at = np.arange(n) + smooth * a
            inside = (at >= 0) & (at <= n - 1)
            sig.append(np.where(inside, np.interp(at, np.arange(n), np.asarray(xs, float)), background))
            near = np.clip(np.ceil(at - 0.5).astype(int), 0, n - 1)
            lab.append(np.where(inside, np.asarray(ys)[near], 0).astype(np.int32))
        return pd.DataFrame({"signal": sig, "labels": lab})

    number = lambda v: F.lit(float(v)) if isinstance(v, (int, float)) else v
    return run(signal, labels, shift, number(alpha), number(sigma))
