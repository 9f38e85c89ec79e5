"""Queries: components, hidden units, scoring, random forest."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from somnia.operators import latent as L, model as M, sequences as Q
from somnia.session import shared_dir
from somnia.sources.models import load_or_fit, save_bytes, score_stored
from .proxies import CLASSES, LAB, SIG, VEC, VECTOR, epoch_labels, feature_vectors, fin, out, signal
from .registry import query
from .signals import EPOCH, band_powers

D, N_FACTORS, N_COV, N_MEAN = 10, 10, 11, 10


def _weights():
    """Stand-in weights from a formula that SQL can repeat."""
    i, j = np.arange(D)[:, None], np.arange(32)[None, :]
    return M.HiddenUnits(
        vf=np.sin(i * 7.0 + j[:, :N_FACTORS] * 3.0), fh=np.abs(np.cos(i * 5.0 + j[:, :N_COV] * 2.0)) * 0.2,
        bias_cov=np.sin(np.arange(N_COV) * 1.7) + 2.0, w_mean=np.cos(i * 3.0 + j[:, :N_MEAN] * 5.0) * 0.3,
        bias_mean=np.cos(np.arange(N_MEAN) * 2.3), bias_vis=np.sin(np.arange(D) * 0.9) * 0.1)


LONG = VEC + ", x AS (" + " UNION ALL ".join(f"SELECT vec_id, {i} AS i, f{i} AS v FROM vec" for i in range(D)) + ")"
IDX = f", fa AS (SELECT unnest(range({N_FACTORS})) AS f), cu AS (SELECT unnest(range({N_COV})) AS u), mu AS (SELECT unnest(range({N_MEAN})) AS u)"


def _units(norm):
    length = ("SELECT i, sqrt(sum(v * v) / 10 + 2.220446049250313e-16) AS l FROM x GROUP BY i" if norm == "dataset"
              else "SELECT vec_id, sqrt(sum(v * v) / 10 + 0.5) AS l FROM x GROUP BY vec_id")
    key = "x.i = ln.i" if norm == "dataset" else "x.vec_id = ln.vec_id"
    return (LONG + IDX + f", ln AS ({length}), ft AS (SELECT x.vec_id, f, sum(v / l * sin(x.i * 7.0 + f * 3.0)) AS a FROM x JOIN ln ON {key}, fa GROUP BY 1, 2), "
            "ca AS (SELECT vec_id, u, -0.5 * sum(a * a * abs(cos(f * 5.0 + u * 2.0)) * 0.2) + sin(u * 1.7) + 2.0 AS z FROM ft, cu GROUP BY 1, 2), "
            "ma AS (SELECT vec_id, u, sum(v * cos(i * 3.0 + u * 5.0) * 0.3) + cos(u * 2.3) AS z FROM x, mu GROUP BY 1, 2), "
            f"hid AS (SELECT vec_id, u AS unit, 1 / (1 + exp(-z)) AS p FROM ca UNION ALL SELECT vec_id, u + {N_COV}, 1 / (1 + exp(-z)) FROM ma)")


def hidden(t, norm="dataset"):
    return M.hidden_probabilities(feature_vectors(t), VECTOR, _weights(), norm)


@query("hidden_probabilities", "M-04 F-08", out(_units("dataset"), "SELECT * FROM hid", "vec_id unit", "p"))
def _(t):
    return fin(hidden(t).select("vec_id", F.posexplode("probs").alias("unit", "p")))


@query("hidden_probabilities_by_row", "M-04", out(_units("row"), "SELECT * FROM hid", "vec_id unit", "p"))
def _(t):
    return fin(hidden(t, "row").select("vec_id", F.posexplode("probs").alias("unit", "p")))


@query("hidden_state_codes", "M-05 F-09", out(_units("dataset") + ", cd AS (SELECT vec_id, string_agg(CASE WHEN p >= 0.5 THEN '1' ELSE '0' END, '' ORDER BY unit) AS code FROM hid GROUP BY 1)", "SELECT vec_id, code, dense_rank() OVER (ORDER BY code) AS latent_id FROM cd", "vec_id latent_id"))
def _(t):
    coded = M.with_code(hidden(t)).withColumnRenamed("vec_id", "epoch_id")
    return fin(L.assign_states(coded, L.unique_states(coded)).select(F.col("epoch_id").alias("vec_id"), "code", "latent_id"))


@query("free_energy", "M-06", out(_units("row") + ", ec AS (SELECT vec_id, sum(ln(1 + exp(z))) AS s FROM ca GROUP BY 1), em AS (SELECT vec_id, sum(ln(1 + exp(z))) AS s FROM ma GROUP BY 1), ev AS (SELECT vec_id, sum(0.5 * v * v - v * sin(i * 0.9) * 0.1) AS s FROM x GROUP BY 1)", "SELECT ev.vec_id, ev.s - ec.s - em.s AS energy FROM ev JOIN ec ON ev.vec_id = ec.vec_id JOIN em ON ev.vec_id = em.vec_id", "vec_id", "energy"))
def _(t):
    return fin(M.free_energy(feature_vectors(t), VECTOR, _weights()).select("vec_id", "energy"))


@query("pca_scores", "M-01")
def _(t):
    rows = feature_vectors(t)
    fit = M.fit_pca(rows, VECTOR, whiten=True)
    return fin(M.pca_transform(rows, fit).select("vec_id", *[f"pc{k}" for k in range(D)]))


@query("pca_round_trip", "M-01 M-02", out(VEC, "SELECT vec_id, " + ", ".join(VECTOR) + " FROM vec", "vec_id", " ".join(VECTOR)))
def _(t):
    rows = feature_vectors(t)
    fit = M.fit_pca(rows, VECTOR)
    return fin(M.pca_inverse(M.pca_transform(rows, fit), fit).select("vec_id", *VECTOR))


@query("pca_variances", "M-01", out(VEC, "SELECT " + " + ".join(f"var_samp({f})" for f in VECTOR) + " AS total FROM vec", "", "total"))
def _(t):
    rows = feature_vectors(t)
    scores = M.pca_transform(rows, M.fit_pca(rows, VECTOR))
    return fin(scores.agg(sum((F.var_samp(f"pc{k}") for k in range(1, D)), F.var_samp("pc0")).alias("total")))


@query("pca_spectrum", "M-01", out(LONG + ", cv AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS c FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2)", "SELECT 1 AS power, i, j, c AS value FROM cv UNION ALL SELECT 2, a.i, b.j, sum(a.c * b.c) FROM cv a JOIN cv b ON a.j = b.i GROUP BY 2, 3", "power i j", "value"))
def _(t):
    """Covariance and its square put together again from the kept components: only eigenvectors with their variances give both."""
    rows, path = feature_vectors(t), shared_dir(t.spark)
    fit = load_or_fit(t.spark, path, lambda: M.fit_pca(rows, VECTOR))
    parts = t.spark.read.parquet(path)
    load = parts.where("part = 'components'").select(F.col("i").alias("c"), F.col("j").alias("f"), F.col("value").alias("w"))
    size = parts.where("part = 'variance'").select(F.col("i").alias("c"), F.col("value").alias("l"))
    pairs = load.join(load.select("c", F.col("f").alias("g"), F.col("w").alias("u")), "c").join(size, "c")
    powers = F.explode(F.array(*[F.struct(F.lit(k).alias("power"), F.pow("l", F.lit(float(k))).alias("lk")) for k in (1, 2)])).alias("p")
    cells = pairs.select("f", "g", "w", "u", powers).groupBy("p.power", F.col("f").alias("i"), F.col("g").alias("j"))
    return fin(cells.agg(F.sum(F.col("w") * F.col("u") * F.col("p.lk")).alias("value")).where(F.lit(len(fit.features) == D)))


def _inverse_sql():
    """The covariance matrix beside the unit matrix, swept one pivot after the other."""
    ctes = LONG + f""", cv AS (SELECT a.i, b.i AS j, covar_samp(a.v, b.v) AS v FROM x a JOIN x b USING (vec_id) GROUP BY 1, 2),
g0 AS MATERIALIZED (SELECT i, j, v FROM cv UNION ALL SELECT i, {D} + j, CASE WHEN i = j THEN 1.0 ELSE 0.0 END FROM cv)"""
    for k in range(D):
        ctes += f""", g{k + 1} AS MATERIALIZED (SELECT a.i, a.j, CASE WHEN a.i = {k} THEN a.v / p.v ELSE a.v - c.v * r.v / p.v END AS v
 FROM g{k} a JOIN g{k} p ON p.i = {k} AND p.j = {k} JOIN g{k} c ON c.i = a.i AND c.j = {k} JOIN g{k} r ON r.i = {k} AND r.j = a.j)"""
    return ctes + ", dv AS (SELECT vec_id, i, v - avg(v) OVER (PARTITION BY i) AS v FROM x)"


@query("pca_distance", "M-01", out(_inverse_sql(), f"SELECT a.vec_id, sum(a.v * g.v * b.v) AS distance FROM dv a JOIN dv b USING (vec_id) JOIN g{D} g ON g.i = a.i AND g.j = {D} + b.i GROUP BY 1", "vec_id", "distance"))
def _(t):
    """How far each vector lies out: the square sum of its whitened scores is its distance by the inverse covariance."""
    rows = feature_vectors(t)
    scores = M.pca_transform(rows, M.fit_pca(rows, VECTOR, whiten=True))
    return fin(scores.select("vec_id", sum((F.pow(f"pc{k}", 2) for k in range(1, D)), F.pow("pc0", 2)).alias("distance")))


# Four channels made of two span a plane at each instant, so the covariance has two eigenvalues, from its trace and the
# trace of its square; C * (C - l2) is then the projection on the first axis up to a factor, and a column of it the axis.
PLANE = SIG + """, ch AS (SELECT v, k, v - k AS d, v / 2 + k AS m, (v + k + (v - k) + (v / 2 + k)) / 4 AS a FROM sig),
sd AS (SELECT *, sqrt((pow(v - a, 2) + pow(k - a, 2) + pow(d - a, 2) + pow(m - a, 2)) / 4) AS s FROM ch),
z AS (SELECT row_number() OVER () AS id, (v - a) / w AS v, (k - a) / w AS k, (d - a) / w AS d, (m - a) / w AS m FROM (SELECT *, CASE WHEN s = 0 THEN 1 ELSE s END AS w FROM sd)),
zl AS (UNPIVOT z ON v, k, d, m INTO NAME channel VALUE x),
c AS MATERIALIZED (SELECT p.channel AS i, q.channel AS j, covar_samp(p.x, q.x) AS c FROM zl p JOIN zl q USING (id) GROUP BY 1, 2),
tr AS (SELECT sum(CASE WHEN i = j THEN c END) AS t, sum(c * c) AS q FROM c),
ei AS (SELECT (t + sqrt(2 * q - t * t)) / 2 AS l1, (t - sqrt(2 * q - t * t)) / 2 AS l2 FROM tr),
c2 AS (SELECT a.i, b.j, sum(a.c * b.c) AS c2 FROM c a JOIN c b ON a.j = b.i GROUP BY 1, 2),
pr AS (SELECT 1 AS component, i, j, (c2 - l2 * c) / (l1 * (l1 - l2)) AS p FROM c JOIN c2 USING (i, j), ei
 UNION ALL SELECT 2, i, j, (c2 - l1 * c) / (l2 * (l2 - l1)) FROM c JOIN c2 USING (i, j), ei),
best AS (SELECT component, max_by(i, p) AS j, max(p) AS p FROM pr WHERE i = j GROUP BY 1)"""


@query("channel_pca", "M-03", out(PLANE, "SELECT pr.component, pr.i AS channel, pr.p / sqrt(best.p) AS loading, CASE WHEN pr.i = pr.j THEN 1 ELSE 0 END AS top FROM pr JOIN best ON best.component = pr.component AND best.j = pr.j", "component top", "loading"))
def _(t):
    s = signal(t).select("v", "k", (F.col("v") - F.col("k")).alias("d"), (F.col("v") / 2 + F.col("k")).alias("m"))
    return fin(M.channel_pca(s, ["v", "k", "d", "m"]))


@query("random_forest", "M-10 F-22")
def _(t):
    p = band_powers(t).join(epoch_labels(t), ["recording_id", "epoch_idx"])
    names = ["noise", "delta", "theta", "sigma", "gamma"]
    p = p.withColumn("held_out", F.crc32(F.col("recording_id").cast("string").cast("binary")) % 4 == 0)
    model = M.train_forest(p.where(~F.col("held_out")), names, "stage", trees=20)
    return fin(M.forest_predict(model, p, names).select("recording_id", "epoch_idx", "stage", "held_out", "pred"))


NAMES = ["noise", "delta", "theta", "sigma", "gamma"]


def _folds(t):
    p = band_powers(t).join(epoch_labels(t), ["recording_id", "epoch_idx"])
    return M.out_of_fold(p, NAMES, "stage", "recording_id", folds=3)


@query("forest_report", "M-10")
def _(t):
    return fin(M.staging_report(_folds(t), CLASSES, "stage"))


@query("forest_report_totals", "M-10", out(LAB, "SELECT stage AS class, count(*) AS support, count(*) AS predicted FROM lab GROUP BY 1", "class support predicted"))
def _(t):
    """What of the report does not hang on the trees: epochs per class, each predicted by some fold."""
    r = M.staging_report(_folds(t), CLASSES, "stage").where("support > 0")
    return fin(r.select("class", "support", sum(F.col(f"pred_{c}") for c in CLASSES).alias("predicted")))


# Three classes from two inputs per epoch; the window's first input counts too.
W = np.array([[1.0, 0.0, 2.0], [0.0, 3.0, -1.0]])


def _model(x):
    return x @ W + x[:, :1, :1]


EPM = SIG + f""", em AS (SELECT recording_id, sample_idx // {EPOCH} AS epoch_idx, CAST(floor(avg(v)) AS BIGINT) AS a, CAST(floor(avg(k)) AS BIGINT) AS b FROM sig GROUP BY 1, 2 HAVING count(*) = {EPOCH}),
n AS (SELECT recording_id, count(*) AS n FROM em GROUP BY 1),
w AS (SELECT s.recording_id, s.epoch_idx AS st, s.a AS a0, e.epoch_idx, e.a, e.b FROM em s JOIN n ON s.recording_id = n.recording_id JOIN em e ON e.recording_id = s.recording_id AND e.epoch_idx BETWEEN s.epoch_idx AND s.epoch_idx + 1 WHERE s.epoch_idx + 2 <= n)"""


def _inputs(t):
    means = signal(t).groupBy("recording_id", F.floor(F.col("sample_idx") / EPOCH).alias("epoch_idx")).agg(
        F.floor(F.avg("v")).cast("double").alias("a"), F.floor(F.avg("k")).cast("double").alias("b"), F.count(F.lit(1)).alias("n"))
    q = Q.overlapping_sequences(means.where(F.col("n") == EPOCH), ["recording_id"], "epoch_idx", ["a", "b"], 2, 64)
    return q.withColumn("x", F.transform("seq", lambda e: F.array(e["a"], e["b"])))


def _from_weights(data):
    w = np.frombuffer(data).reshape(2, 3)
    return lambda x: x @ w + x[:, :1, :1]


SUMS = out(EPM, "SELECT recording_id, epoch_idx, sum(a + a0) AS s0, sum(3 * b + a0) AS s1, sum(2 * a - b + a0) AS s2, count(*) AS n_windows FROM w GROUP BY 1, 2", "recording_id epoch_idx n_windows", "s0 s1 s2")


@query("score_stored_model", "M-11 W-18 X-05", SUMS)
def _(t):
    path = shared_dir(t.spark)
    save_bytes(t.spark, np.ascontiguousarray(W, np.float64).tobytes(), path)
    added = Q.overlap_add(score_stored(_inputs(t), "x", path, _from_weights), ["recording_id"], 3)
    return fin(added.select("recording_id", "epoch_idx", *[F.col("scores")[c].alias(f"s{c}") for c in range(3)], "n_windows"))


@query("score_sequences", "M-11 W-18 X-05", SUMS)
def _(t):
    scored = M.score_sequences(_inputs(t), "x", _model)
    added = Q.overlap_add(scored, ["recording_id"], 3)
    return fin(added.select("recording_id", "epoch_idx", *[F.col("scores")[c].alias(f"s{c}") for c in range(3)], "n_windows"))


@query("augmented_scores", "M-12", out(EPM, "SELECT recording_id, st AS \"start\", epoch_idx - st AS pos, (a + a0) * 1.0 + 2 * (a + a0) * 1.5 AS s0, (3 * b + a0) + (3 * b + a0) * 3 AS s1 FROM w", "recording_id start pos", "s0 s1"))
def _(t):
    # Copies 1 and 2 scale the input by 2 and 4: their mean is 3 times the plain pass.
    q = _inputs(t).withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))))
    q = q.withColumn("x", F.transform("x", lambda e: F.transform(e, lambda y: y * F.pow(F.lit(2.0), F.col("copy")))))
    s = M.score_sequences(q, "x", _model).select("recording_id", "start", "copy", F.posexplode("scores").alias("pos", "scores"))
    avg = M.average_augmented(s, ["recording_id", "start", "pos"], 3, 2)
    return fin(avg.select("recording_id", "start", "pos", F.col("scores")[0].alias("s0"), F.col("scores")[1].alias("s1")))
