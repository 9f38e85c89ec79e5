"""Queries: state codes, information, reduction, transitions, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from somnia.functions.scalar import code_key, dominant
from somnia.operators import graph as G, latent as L
from somnia.operators.model import t_test_p
from .proxies import COD, FIN, STA, coded_epochs, fin, fine_epochs, out, state_epochs
from .registry import query

STAGES = [1, 3, 5]
SHR = STA + """, shr AS (SELECT latent_id, count(*) AS n_epochs, avg(CASE WHEN stage = 1 THEN 1.0 ELSE 0 END) AS p_wake,
 avg(CASE WHEN stage = 3 THEN 1.0 ELSE 0 END) AS p_nrem, avg(CASE WHEN stage = 5 THEN 1.0 ELSE 0 END) AS p_rem FROM sta GROUP BY 1),
maj AS (SELECT *, CASE WHEN round(p_wake, 3) >= round(p_nrem, 3) AND round(p_wake, 3) >= round(p_rem, 3) THEN 1
 WHEN round(p_nrem, 3) >= round(p_rem, 3) AND round(p_nrem, 3) >= round(p_wake, 3) THEN 3 ELSE 5 END AS majority FROM shr)"""
CNT = STA + """, sz AS (SELECT latent_id, count(*) AS n_epochs FROM sta GROUP BY 1),
cnt AS (SELECT latent_id, stage, count(*) AS n FROM sta WHERE stage IN (1, 3, 5) AND latent_id IN (SELECT latent_id FROM sz WHERE n_epochs > 100) GROUP BY 1, 2)"""
INF = CNT + """, inf AS (SELECT latent_id, stage, n / CAST(tot AS DOUBLE) * log2((n / CAST(tot AS DOUBLE)) / ((rs / CAST(tot AS DOUBLE)) * (cs / CAST(tot AS DOUBLE)))) AS mi
 FROM (SELECT *, sum(n) OVER () AS tot, sum(n) OVER (PARTITION BY latent_id) AS rs, sum(n) OVER (PARTITION BY stage) AS cs FROM cnt)),
ent AS (SELECT stage, -p * log2(p) AS entropy FROM (SELECT stage, sum(n) / CAST((SELECT sum(n) FROM cnt) AS DOUBLE) AS p FROM cnt GROUP BY 1))"""


def sizes(sta):
    return sta.groupBy("latent_id").agg(F.count(F.lit(1)).alias("n_epochs"))


def counts(t):
    return L.state_stage_counts(state_epochs(t), STAGES, 100)


@query("unique_states", "A-20 M-05", out(COD, "SELECT code, count(*) AS n_epochs, min(epoch_id) AS first_epoch, dense_rank() OVER (ORDER BY code) AS latent_id FROM cod GROUP BY 1", "n_epochs first_epoch latent_id"))
def _(t):
    return fin(L.unique_states(coded_epochs(t)))


@query("assigned_states", "J-03 M-05", out(STA, "SELECT epoch_id, subject, stage, latent_id FROM sta", "epoch_id subject stage latent_id"))
def _(t):
    return fin(state_epochs(t).select("epoch_id", "subject", "stage", "latent_id"))


@query("stage_shares", "A-21 F-16", out(SHR, "SELECT latent_id, n_epochs, round(p_wake, 3) AS p_wake, round(p_nrem, 3) AS p_nrem, round(p_rem, 3) AS p_rem FROM shr", "latent_id n_epochs", "p_wake p_nrem p_rem"))
def _(t):
    return fin(L.stage_shares(state_epochs(t), digits=3))


@query("state_given_stage", "A-22", out(STA, "SELECT latent_id, stage, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY stage) AS DOUBLE) AS p FROM sta WHERE stage IN (1, 3, 5) GROUP BY 1, 2", "latent_id stage n", "p"))
def _(t):
    return fin(L.share_of_stage(L.state_stage_counts(state_epochs(t), STAGES)))


@query("state_entropy", "A-23", out(SHR, "SELECT latent_id, n_epochs, " + " + ".join(f"CASE WHEN p_{s} > 0 THEN -p_{s} * log2(p_{s}) ELSE 0 END" for s in ("wake", "nrem", "rem")) + " AS entropy FROM shr WHERE n_epochs > 100", "latent_id n_epochs", "entropy"))
def _(t):
    shares = L.stage_shares(state_epochs(t)).where("n_epochs > 100")
    return fin(L.state_entropy(shares, ["p_wake", "p_nrem", "p_rem"]).select("latent_id", "n_epochs", "entropy"))


@query("stage_entropy", "A-24", out(INF, "SELECT * FROM ent", "stage", "entropy"))
def _(t):
    return fin(L.stage_entropy(counts(t)))


@query("mutual_information", "A-25", out(INF, "SELECT mi, entropy, mi / entropy AS ratio FROM (SELECT (SELECT sum(mi) FROM inf) AS mi, (SELECT sum(entropy) FROM ent) AS entropy)", "", "mi entropy ratio"))
def _(t):
    return fin(L.total_information(counts(t)))


@query("mutual_information_by_stage", "A-26", out(INF, "SELECT i.stage, i.mi, e.entropy, i.mi / e.entropy AS ratio FROM (SELECT stage, sum(mi) AS mi FROM inf GROUP BY 1) i JOIN ent e ON i.stage = e.stage", "stage", "mi entropy ratio"))
def _(t):
    return fin(L.mutual_information(counts(t)))


F3 = ["v", "k", "r"]
PAIRS = [(a, b) for i, a in enumerate(F3) for b in F3[i:]]


@query("state_covariance", "A-27", out(STA, " UNION ALL ".join(f"SELECT latent_id, '{a}' AS f1, '{b}' AS f2, avg({a}) AS mean1, avg({b}) AS mean2, covar_samp({a}, {b}) AS cov FROM sta GROUP BY 1" for a, b in PAIRS), "latent_id", "mean1 mean2 cov"))
def _(t):
    return fin(L.state_covariance(state_epochs(t), F3))


@query("state_means", "A-28 J-15", out(STA, "SELECT latent_id, count(*) AS n_epochs, avg(v) AS v, avg(k) AS k, avg(r) AS r FROM sta GROUP BY 1", "latent_id n_epochs", "v k r"))
def _(t):
    return fin(L.state_means(state_epochs(t), F3))


@query("subject_matrix", "A-29 F-12", out(STA, "SELECT subject, " + ", ".join(f"count(*) FILTER (latent_id = {s}) AS s_{s}" for s in range(1, 65)) + " FROM sta GROUP BY 1", "subject " + " ".join(f"s_{s}" for s in range(1, 65))))
def _(t):
    return fin(L.subject_matrix(state_epochs(t), list(range(1, 65))))


HIS = STA + """, b AS (SELECT 'all' AS scope, NULL::BIGINT AS key, latent_id FROM sta UNION ALL SELECT 'group', grp, latent_id FROM sta UNION ALL SELECT 'subject', subject, latent_id FROM sta),
h AS (SELECT scope, key, latent_id, count(*) AS n, sum(count(*)) OVER (PARTITION BY scope, key) AS tot FROM b GROUP BY 1, 2, 3),
keep AS (SELECT * FROM h WHERE latent_id IN (SELECT latent_id FROM sta GROUP BY 1 HAVING count(*) > 300))"""


@query("state_histogram_l2", "A-30", out(HIS, "SELECT scope, key, latent_id, n, n / sqrt(sum(CAST(n AS DOUBLE) * n) OVER (PARTITION BY scope, key)) AS share FROM keep", "key latent_id n", "share"))
def _(t):
    return fin(L.state_histogram(state_epochs(t), 300))


@query("state_histogram_length", "A-30", out(HIS, "SELECT scope, key, latent_id, n, n / CAST(tot AS DOUBLE) AS share FROM keep", "key latent_id n", "share"))
def _(t):
    return fin(L.state_histogram(state_epochs(t), 300, "length"))


TT = STA + """, su AS (SELECT DISTINCT grp, subject FROM sta), st AS (SELECT DISTINCT latent_id FROM sta),
x AS (SELECT st.latent_id, su.grp, su.subject, count(sta.epoch_id) AS x FROM su CROSS JOIN st LEFT JOIN sta ON sta.latent_id = st.latent_id AND sta.subject = su.subject GROUP BY 1, 2, 3),
g AS (SELECT latent_id, grp, CAST(count(*) AS DOUBLE) AS n, avg(x) AS m, coalesce(var_samp(x), 0) AS va FROM x GROUP BY 1, 2),
tt AS (SELECT a.latent_id, a.grp AS g1, b.grp AS g2, a.n + b.n - 2 AS dof, CASE WHEN a.n + b.n > 2 THEN ((a.n - 1) * a.va + (b.n - 1) * b.va) / (a.n + b.n - 2) END AS pooled, a.m - b.m AS d, 1 / a.n + 1 / b.n AS w FROM g a JOIN g b ON a.latent_id = b.latent_id AND a.grp < b.grp)"""


@query("group_t_tests", "A-31 J-17", out(TT, "SELECT latent_id, g1, g2, CASE WHEN pooled > 1e-12 THEN d / sqrt(pooled * w) END AS t, dof FROM tt", "latent_id g1 g2", "t dof"))
def _(t):
    return fin(L.group_t_tests(state_epochs(t)))


# Two-sided p of t at a whole number of degrees of freedom: the finite series in powers of the cosine of atan(t / sqrt(dof)).
TP = TT + """, tv AS (SELECT latent_id, g1, g2, CAST(dof AS BIGINT) AS dof, CASE WHEN pooled > 1e-12 THEN d / sqrt(pooled * w) END AS t FROM tt),
co AS (SELECT k, exp(sum(CASE WHEN k > 0 THEN ln(2.0 * k / (2 * k + 1)) ELSE 0 END) OVER (ORDER BY k)) AS od, exp(sum(CASE WHEN k > 0 THEN ln((2.0 * k - 1) / (2 * k)) ELSE 0 END) OVER (ORDER BY k)) AS ev
 FROM (SELECT unnest(range((SELECT coalesce(max(dof), 0) FROM tv) // 2 + 1)) AS k)),
an AS (SELECT *, atan(abs(t) / sqrt(dof)) AS h FROM tv WHERE dof > 0 AND t IS NOT NULL),
se AS (SELECT latent_id, g1, g2, sum(CASE WHEN dof % 2 = 1 AND k < (dof - 1) // 2 THEN od * pow(cos(h), 2 * k + 1) WHEN dof % 2 = 0 AND k < dof // 2 THEN ev * pow(cos(h), 2 * k) ELSE 0 END) AS s FROM an, co GROUP BY 1, 2, 3),
pv AS (SELECT an.latent_id, an.g1, an.g2, CASE WHEN dof % 2 = 1 THEN 1 - 2 / pi() * (h + sin(h) * s) ELSE 1 - sin(h) * s END AS p FROM an JOIN se USING (latent_id, g1, g2)),
tp AS (SELECT tv.latent_id, tv.g1, tv.g2, t, dof, p FROM tv LEFT JOIN pv USING (latent_id, g1, g2))"""


@query("group_t_test_p", "A-31", out(TP, "SELECT * FROM tp", "latent_id g1 g2", "t dof p"))
def _(t):
    return fin(t_test_p(L.group_t_tests(state_epochs(t))))


@query("group_test_matrix", "A-31 J-17", out(TP, "SELECT * FROM tp UNION ALL SELECT latent_id, g2, g1, t, dof, p FROM tp UNION ALL SELECT latent_id, grp, grp, 0, 2 * n - 2, 1 FROM g", "latent_id g1 g2", "t dof p"))
def _(t):
    return fin(L.group_test_matrix(state_epochs(t)))


@query("majority_stage", "A-32 M-07", out(SHR, "SELECT latent_id, n_epochs, majority FROM maj", "latent_id n_epochs majority"))
def _(t):
    shares = L.stage_shares(state_epochs(t))
    return fin(shares.select("latent_id", "n_epochs", L.majority_stage(shares).alias("majority")))


@query("off_units", "A-37", out(COD + ", u AS (SELECT DISTINCT code FROM cod)", "SELECT b AS unit, sum(CAST(substr(code, CAST(b AS INT) + 1, 1) AS BIGINT)) AS n_on, CASE WHEN sum(CAST(substr(code, CAST(b AS INT) + 1, 1) AS BIGINT)) = 0 THEN 1 ELSE 0 END AS always_off FROM u, (SELECT unnest(range(6)) AS b) GROUP BY 1", "unit n_on always_off"))
def _(t):
    return fin(L.off_units(L.unique_states(coded_epochs(t)), 6))


BOX = STA + ", q AS (SELECT latent_id, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median, quantile_cont(v, 0.75) AS q3 FROM sta GROUP BY 1)"


@query("state_boxes", "A-38", out(BOX, "SELECT q.latent_id, q1, median, q3, min(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low, max(v) FILTER (v BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high FROM sta JOIN q ON sta.latent_id = q.latent_id GROUP BY ALL", "latent_id", "q1 median q3 whisker_low whisker_high"))
def _(t):
    return fin(L.state_boxes(state_epochs(t), ["latent_id"], "v", ["epoch_id"]))


LARGE = {1: 0.04, 3: 0.03, 5: 0.05}
BIG = SHR + """, fs AS (SELECT latent_id, avg(v) AS v, avg(k) AS k, avg(r) AS r FROM sta GROUP BY 1),
lg AS (SELECT maj.latent_id, n_epochs, majority AS stage, v, k, r, n_epochs >= CASE majority WHEN 1 THEN 0.04 WHEN 3 THEN 0.03 ELSE 0.05 END * sum(n_epochs) OVER (PARTITION BY majority) AS big FROM maj JOIN fs ON maj.latent_id = fs.latent_id),
nr AS (SELECT s.latent_id, l.latent_id AS target, row_number() OVER (PARTITION BY s.latent_id ORDER BY sqrt((s.v - l.v) ** 2 + (s.k - l.k) ** 2 + (s.r - l.r) ** 2), l.latent_id) AS rn FROM lg s JOIN lg l ON s.stage = l.stage AND l.big WHERE NOT s.big),
mp AS (SELECT lg.*, CASE WHEN big THEN lg.latent_id ELSE coalesce(nr.target, lg.latent_id) END AS target FROM lg LEFT JOIN nr ON nr.latent_id = lg.latent_id AND nr.rn = 1)"""


def reduced(t):
    sta = state_epochs(t)
    shares = L.stage_shares(sta)
    states = shares.select("latent_id", "n_epochs", L.majority_stage(shares).alias("stage"))
    means = L.state_means(sta, F3).drop("n_epochs")
    return L.nearest_large(L.mark_large(states.join(means, "latent_id"), LARGE), F3)


@query("large_states", "A-39", out(BIG, "SELECT latent_id, n_epochs, stage, CAST(big AS INT) AS large FROM lg", "latent_id n_epochs stage large"))
def _(t):
    shares = L.stage_shares(state_epochs(t))
    states = shares.select("latent_id", "n_epochs", L.majority_stage(shares).alias("stage"))
    return fin(L.mark_large(states, LARGE))


@query("nearest_large_state", "J-07 M-08", out(BIG, "SELECT latent_id, stage, target FROM mp", "latent_id stage target"))
def _(t):
    return fin(reduced(t).select("latent_id", "stage", "target"))


@query("grouping_sizes", "A-47", out(BIG, "SELECT target, count(*) AS n_states, sum(n_epochs) AS n_epochs FROM mp GROUP BY 1", "target n_states n_epochs"))
def _(t):
    return fin(L.grouping_sizes(reduced(t)))


@query("reduced_states", "M-08 A-40", out(BIG + ", rl AS (SELECT mp.target AS latent_id, sta.stage FROM sta JOIN mp ON sta.latent_id = mp.latent_id WHERE sta.stage IN (1, 3, 5)), sh2 AS (SELECT latent_id, count(*) AS n_epochs, avg(CASE WHEN stage = 1 THEN 1.0 ELSE 0 END) AS p_wake, avg(CASE WHEN stage = 3 THEN 1.0 ELSE 0 END) AS p_nrem, avg(CASE WHEN stage = 5 THEN 1.0 ELSE 0 END) AS p_rem FROM rl GROUP BY 1)", "SELECT *, CASE WHEN round(p_wake, 3) >= round(p_nrem, 3) AND round(p_wake, 3) >= round(p_rem, 3) THEN 1 WHEN round(p_nrem, 3) >= round(p_rem, 3) THEN 3 ELSE 5 END AS majority FROM sh2", "latent_id n_epochs majority", "p_wake p_nrem p_rem"))
def _(t):
    return fin(L.reduced_summary(L.relabel(state_epochs(t).select("latent_id", "stage"), reduced(t)), sleep_only=True))


@query("reduced_states_with_artefact", "A-40", out(STA, "SELECT latent_id, count(*) AS n_epochs, " + ", ".join(f"avg(CASE WHEN stage = {v} THEN 1.0 ELSE 0 END) AS p_{k}" for k, v in (("artefact", 0), ("wake", 1), ("nrem", 3), ("ts", 4), ("rem", 5))) + " FROM sta GROUP BY 1", "latent_id n_epochs", "p_artefact p_wake p_nrem p_ts p_rem"))
def _(t):
    from somnia.schemas import RAT_STAGES
    return fin(L.reduced_summary(state_epochs(t), RAT_STAGES).drop("majority"))


# The first half month trains the state table, the rest is scored by it.
FIT = FIN + """, tr AS (SELECT *, dense_rank() OVER (ORDER BY code) AS latent_id, substr(code, 3) AS key FROM fine WHERE early),
ps AS (SELECT key, latent_id, avg(CASE WHEN stage = 1 THEN 1.0 ELSE 0 END) AS p_wake, avg(CASE WHEN stage = 3 THEN 1.0 ELSE 0 END) AS p_nrem, avg(CASE WHEN stage = 5 THEN 1.0 ELSE 0 END) AS p_rem FROM tr GROUP BY 1, 2),
fit AS (SELECT key, CASE WHEN round(p_wake, 3) >= round(p_nrem, 3) AND round(p_wake, 3) >= round(p_rem, 3) THEN 1 WHEN round(p_nrem, 3) >= round(p_rem, 3) THEN 3 ELSE 5 END AS stage, p_wake, p_nrem, p_rem
 FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY latent_id DESC) AS rn FROM ps) WHERE rn = 1)"""


def fitted(t):
    train = fine_epochs(t).where("early")
    coded = L.assign_states(train, L.unique_states(train))
    return L.fit_state_stages(coded.withColumn("code", code_key("code", 2)))


def unseen(t):
    return fine_epochs(t).where("NOT early").withColumn("code", code_key("code", 2))


@query("fit_state_stages", "M-07 J-06 F-10", out(FIT, "SELECT key AS code, stage, p_wake, p_nrem, p_rem FROM fit", "stage", "p_wake p_nrem p_rem"))
def _(t):
    return fin(fitted(t))


@query("score_states", "J-04 M-07 F-10", out(FIT, "SELECT epoch_id, fine.stage, coalesce(fit.stage, -1) AS pred FROM fine LEFT JOIN fit ON fit.key = substr(fine.code, 3) WHERE NOT early", "epoch_id stage pred"))
def _(t):
    return fin(L.score_states(unseen(t), fitted(t)).select("epoch_id", "stage", "pred"))


@query("hypnodensity", "M-09 F-18", out(FIT, "SELECT epoch_id, p_wake, p_nrem, p_rem, greatest(p_wake, p_nrem, p_rem) AS confidence FROM fine LEFT JOIN fit ON fit.key = substr(fine.code, 3) WHERE NOT early", "epoch_id", "p_wake p_nrem p_rem confidence"))
def _(t):
    return fin(L.hypnodensity(unseen(t), fitted(t)).select(
        "epoch_id", "p_wake", "p_nrem", "p_rem", F.array_max(F.array("p_wake", "p_nrem", "p_rem")).alias("confidence")))


@query("new_states", "J-05", out(FIN, "SELECT DISTINCT code FROM fine WHERE NOT early AND code NOT IN (SELECT code FROM fine WHERE early)"))
def _(t):
    rows = fine_epochs(t)
    return fin(L.new_states(rows.where("NOT early"), rows.where("early")))


TRN = STA + """, nx AS (SELECT *, lead(latent_id) OVER (PARTITION BY half ORDER BY epoch_id) AS dst, lead(epoch_id) OVER (PARTITION BY half ORDER BY epoch_id) - epoch_id AS gap FROM (SELECT *, epoch_id // 500 AS half FROM sta)),
trn AS (SELECT latent_id AS src, dst, count(*) AS n FROM nx WHERE gap = 1 GROUP BY 1, 2), prb AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY src) AS DOUBLE) AS prob FROM trn)"""


def edges(t):
    trials = state_epochs(t).withColumn("trial", F.floor(F.col("epoch_id") / 500))
    return L.transition_shares(L.transitions(trials, ["trial"]))


@query("transitions", "W-06", out(STA + ", nx AS (SELECT latent_id, lead(latent_id) OVER (ORDER BY epoch_id) AS dst FROM sta)", "SELECT latent_id AS src, dst, count(*) AS n FROM nx WHERE dst IS NOT NULL GROUP BY 1, 2", "src dst n"))
def _(t):
    return fin(L.transitions(state_epochs(t), []))


@query("transitions_in_trials", "W-07 W-08", out(TRN, "SELECT * FROM prb", "src dst n", "prob"))
def _(t):
    return fin(edges(t))


@query("transitions_of_large_states", "W-08", out(TRN + ", big AS (SELECT latent_id FROM sta GROUP BY 1 HAVING count(*) > 300)", "SELECT * FROM prb WHERE src IN (SELECT * FROM big) AND dst IN (SELECT * FROM big)", "src dst n", "prob"))
def _(t):
    return fin(L.keep_large_ends(edges(t), sizes(state_epochs(t)), 300))


@query("transitions_by_group", "G-04 W-06", out(STA + ", nx AS (SELECT *, lead(latent_id) OVER (PARTITION BY grp ORDER BY epoch_id) AS dst, lead(epoch_id) OVER (PARTITION BY grp ORDER BY epoch_id) - epoch_id AS gap FROM sta)", "SELECT grp, latent_id AS src, dst, count(*) AS n FROM nx WHERE gap = 1 GROUP BY 1, 2, 3", "grp src dst n"))
def _(t):
    return fin(L.transitions(state_epochs(t), ["grp"], by=["grp"]))


@query("undirected_edges", "G-01", out(TRN, "SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(prob) AS prob FROM prb GROUP BY 1, 2", "a b", "prob"))
def _(t):
    return fin(G.undirected(edges(t)))


@query("node_degrees", "G-02", out(TRN + ", un AS (SELECT DISTINCT least(src, dst) AS a, greatest(src, dst) AS b FROM prb)", "SELECT node, count(*) AS degree FROM (SELECT a AS node FROM un UNION ALL SELECT b FROM un) GROUP BY 1", "node degree"))
def _(t):
    return fin(G.degrees(edges(t)))


@query("node_in_degrees", "G-02", out(TRN, "SELECT dst AS node, count(*) AS degree FROM prb GROUP BY 1", "node degree"))
def _(t):
    return fin(G.degrees(edges(t), "in"))


@query("node_classes", "G-03 F-25", out(SHR, "SELECT latent_id, CASE WHEN p_wake > p_nrem AND p_wake > p_rem THEN 'wake' WHEN p_nrem > p_wake AND p_nrem > p_rem THEN 'nrem' WHEN p_rem > p_wake AND p_rem > p_nrem THEN 'rem' ELSE 'mixed' END AS dominant, CASE WHEN p_wake > 0.25 THEN 'wake' WHEN p_nrem > 0.25 THEN 'nrem' WHEN p_rem > 0.25 THEN 'rem' ELSE 'mixed' END AS node_class FROM shr", "latent_id"))
def _(t):
    shares = L.stage_shares(state_epochs(t))
    rule = dominant({k: F.col(f"p_{k}") for k in ("wake", "nrem", "rem")})
    return fin(G.node_class(shares.withColumn("dominant", rule), 0.25).select("latent_id", "dominant", "node_class"))


@query("state_co_occurrence", "G-05", out(STA, "SELECT least(a.latent_id, b.latent_id) AS src, greatest(a.latent_id, b.latent_id) AS dst, count(*) AS n FROM sta a JOIN sta b ON b.epoch_id > a.epoch_id AND b.epoch_id <= a.epoch_id + 2 WHERE a.latent_id <> b.latent_id GROUP BY 1, 2", "src dst n"))
def _(t):
    return fin(G.co_occurrence(state_epochs(t), [], "epoch_id", "latent_id", 2))


def _power_sql(steps):
    """``u`` holds a step's averages over neighbours, ``w`` the same without the constant part and with largest size 1."""
    ctes = STA + """, ow AS (SELECT a.latent_id AS a, b.latent_id AS b FROM sta a JOIN sta b ON b.epoch_id > a.epoch_id AND b.epoch_id <= a.epoch_id + 2 WHERE a.latent_id <> b.latent_id),
ed AS MATERIALIZED (SELECT src, dst, CAST(count(*) AS DOUBLE) AS n FROM (SELECT a AS src, b AS dst FROM ow UNION ALL SELECT b, a FROM ow) GROUP BY 1, 2),
u0 AS MATERIALIZED (SELECT src AS id, sum(n) AS d, sum(n) AS v FROM ed GROUP BY 1)"""
    for k in range(steps + 1):
        ctes += f""", c{k} AS MATERIALIZED (SELECT id, d, v - (SELECT sum(d * v) / sum(d) FROM u{k}) AS v FROM u{k}),
w{k} AS MATERIALIZED (SELECT id, d, coalesce(v / nullif((SELECT max(abs(v)) FROM c{k}), 0), 0) AS v FROM c{k}),
u{k + 1} AS MATERIALIZED (SELECT src AS id, sum(n) AS d, sum(n * v) / sum(n) AS v FROM ed JOIN w{k} ON dst = id GROUP BY 1)"""
    return ctes + f""", pos AS (SELECT id, round(v, 9) AS v FROM w{steps}), gp AS (SELECT v, round(v - lag(v) OVER (ORDER BY v), 9) AS gap FROM (SELECT DISTINCT v FROM pos)),
cut AS (SELECT v FROM gp WHERE gap IS NOT NULL ORDER BY gap DESC, v LIMIT 2)"""


@query("temporal_vector", "G-05", out(_power_sql(6), "SELECT id, v FROM w6", "id", "v"))
def _(t):
    return fin(G.power_vector(G.co_occurrence(state_epochs(t), [], "epoch_id", "latent_id", 2), 6))


@query("temporal_clusters", "G-05", out(_power_sql(6), "SELECT id AS latent_id, (SELECT count(*) FROM cut WHERE cut.v <= pos.v) AS cluster FROM pos", "latent_id cluster"))
def _(t):
    return fin(G.temporal_clusters(G.co_occurrence(state_epochs(t), [], "epoch_id", "latent_id", 2), 3))
