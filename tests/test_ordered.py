"""Chunked windows, counts and joins give what one window per key gives."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from somnia.operators import epochs as E, intervals as I, latent as L, sequences as Q
from somnia.operators.ordered import attach, chunk_of, drop_halo, halo, ordinal, scan, summarise
from somnia.operators.quantiles import _scaled_cell, exact_percentiles

CHUNKS = [3, 7, 64]


@pytest.fixture(scope="module")
def series(spark):
    """Recording 0 holds two thirds of all rows."""
    rng = np.random.default_rng(1)
    parts = [pd.DataFrame({"rec": r, "i": np.arange(n), "x": np.round(rng.normal(size=n), 3)}) for r, n in [(0, 200), (1, 61), (2, 1), (3, 38)]]
    pdf = pd.concat(parts, ignore_index=True)
    return pdf, spark.createDataFrame(pdf.sample(frac=1, random_state=2)).cache()


def rows(df, *cols):
    return df.toPandas().sort_values(list(cols)).reset_index(drop=True)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_scan(series, chunk):
    pdf, df = series
    g = pdf.groupby("rec").x
    want = pdf.assign(s=g.cumsum(), n=pdf.groupby("rec").cumcount() + 1, p=g.shift(1), q=g.shift(-1), m=g.cummax().groupby(pdf.rec).shift(1))
    out = scan(df, ["rec"], ["i"], chunk_of("i", chunk), s=("sum", "x"), n=("count",), p=("lag", "x"), q=("lead", "x"), m=("max_before", "x"))
    pd.testing.assert_frame_equal(rows(out, "rec", "i")[want.columns], want, check_dtype=False, atol=1e-9)


def test_scan_without_keys_and_with_empty_chunks(spark):
    df = spark.createDataFrame([(5, 1), (900, 2), (901, 3), (70000, 4)], "i long, v long")
    out = rows(scan(df, [], ["i"], chunk_of("i", 10), s=("sum", "v"), p=("lag", "v"), q=("lead", "v")), "i")
    assert out.s.tolist() == [1, 3, 6, 10]
    assert [None if pd.isna(x) else int(x) for x in out.p] == [None, 1, 2, 3]
    assert [None if pd.isna(x) else int(x) for x in out.q] == [2, 3, 4, None]


def test_lag_keeps_null_values(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (13, "c")], "i long, v string")
    out = rows(scan(df, [], ["i"], chunk_of("i", 10), p=("lag", "v")), "i")
    assert [None if pd.isna(x) else x for x in out.p] == [None, "a", None]


@pytest.mark.parametrize("chunk", CHUNKS)
def test_halo(series, chunk):
    pdf, df = series
    h, w = halo(df, ["rec"], "i", 4, 2, chunk)
    out = rows(drop_halo(h.withColumn("s", F.sum("x").over(w.rowsBetween(-4, 2)))), "rec", "i")
    want = [pdf[(pdf.rec == r) & (pdf.i >= i - 4) & (pdf.i <= i + 2)].x.sum() for r, i in zip(pdf.rec, pdf.i)]
    assert len(out) == len(pdf)
    np.testing.assert_allclose(out.s, want, atol=1e-9)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_ordinal_and_attach(series, chunk):
    pdf, df = series
    out = rows(ordinal(df.withColumn("key", F.col("i") * 5 + 2), ["rec"], "key", "pos", chunk), "rec", "i")
    assert out.pos.tolist() == pdf.i.tolist()
    for stats in (df.groupBy("rec").agg(F.avg("x").alias("m")), summarise(df, ["rec"], "i", m=F.avg("x"))):
        got = rows(attach(df, stats, ["rec"], "i", chunk), "rec", "i")
        assert len(got) == len(pdf)
        np.testing.assert_allclose(got.m, pdf.groupby("rec").x.transform("mean"))


def test_attach_has_no_hot_key(series):
    """No join of rows with statistics runs on the recording alone."""
    _, df = series
    plan = attach(df, summarise(df, ["rec"], "i", m=F.avg("x")), ["rec"], "i", 7)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and all("_chunk" in j for j in joins)


@pytest.mark.parametrize("bins", [4, 64, 4096])
def test_percentiles(spark, bins):
    rng = np.random.default_rng(3)
    pdf = pd.concat([
        pd.DataFrame({"k": 0, "x": rng.normal(size=301)}), pd.DataFrame({"k": 1, "x": np.r_[rng.normal(size=50), 1e9, -1e9]}),
        pd.DataFrame({"k": 2, "x": np.repeat([1.0, 2.0, 2.0, 3.0], 40)}), pd.DataFrame({"k": 3, "x": [5.0]}),
        pd.DataFrame({"k": 4, "x": np.zeros(9)}), pd.DataFrame({"k": 5, "x": 1000 + rng.random(77) * 1e-6})], ignore_index=True)
    ps = {"a": 0.1, "b": 0.25, "c": 0.5, "d": 0.9, "e": 0.0, "f": 1.0}
    out = rows(exact_percentiles(spark.createDataFrame(pdf), ["k"], "x", ps, bins), "k")
    for name, p in ps.items():
        np.testing.assert_allclose(out[name], pdf.groupby("k").x.quantile(p), rtol=1e-12, atol=1e-12)


def test_percentiles_of_long_tails_have_no_hot_cell(spark):
    """Long tails, both signs, one huge artefact, masked zeros and columns of different size: few rows share a cell."""
    rng = np.random.default_rng(9)
    n = 20_000
    drawn = {"tail": rng.lognormal(0, 3, n), "both": rng.lognormal(0, 2, n) * rng.choice([-1, 1], n), "small": rng.normal(0, 1e-9, n),
             "large": rng.normal(0, 1e9, n), "artefact": np.r_[rng.normal(size=n - 1), 1e7], "masked": np.where(rng.random(n) < 0.6, 0, rng.normal(size=n))}
    pdf = pd.concat([pd.DataFrame({"k": k, "x": x}) for k, x in drawn.items()])
    df = spark.createDataFrame(pdf)
    ps = {"p10": 0.1, "p50": 0.5, "p90": 0.9}
    got = exact_percentiles(df, ["k"], "x", ps).toPandas().set_index("k")
    for k, x in drawn.items():
        np.testing.assert_allclose(got.loc[k, list(ps)].to_numpy(float), np.percentile(x, [10, 50, 90]), rtol=1e-12)
    cells = df.groupBy("k", _scaled_cell("x").alias("c")).agg(F.count("*").alias("n"), F.countDistinct("x").alias("values"))
    assert cells.where("values > 1").agg(F.max("n")).first()[0] < n * 0.01


def test_percentiles_skip_missing_and_take_no_keys(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (3.0,)], "x double")
    assert exact_percentiles(df, [], "x", {"m": 0.5}).first().m == 2.0


@pytest.mark.parametrize("chunk", CHUNKS)
def test_runs_and_encoding(series, chunk):
    pdf, df = series
    got = rows(I.runs(df, ["rec"], "i", F.col("x") > 0, chunk), "rec", "start")
    want = []
    for r, g in pdf.groupby("rec"):
        start = None
        for i, on in zip([*g.i, len(g)], [*(g.x > 0), False]):
            if on and start is None:
                start = i
            elif not on and start is not None:
                want.append((r, start, i - 1))
                start = None
    assert [tuple(x) for x in got.itertuples(index=False)] == want
    dense = df.select("rec", "i", (F.col("x") > 0).cast("int").alias("stage"))
    sparse = I.encode_runs(dense, ["rec"], "i", "stage", 30, chunk)
    back = rows(I.expand_runs(sparse, 30, name="i"), "rec", "i")
    assert back.stage.tolist() == (pdf.x > 0).astype(int).tolist() and back.i.tolist() == pdf.i.tolist()


@pytest.mark.parametrize("chunk", CHUNKS)
def test_smoothing(series, chunk):
    pdf, df = series
    box = np.ones(5) / 5
    want = np.concatenate([np.convolve(np.convolve(np.convolve(g.x, box, "full")[2:len(g) + 2], box, "full")[2:len(g) + 2], box, "full")[2:len(g) + 2]
                           for _, g in pdf.groupby("rec")])
    np.testing.assert_allclose(rows(E.smooth(df, ["rec"], "i", ["x"], chunk=chunk), "rec", "i").x, want, atol=1e-12)


@pytest.mark.parametrize("chunk", [5, 64])
def test_sequences(series, chunk):
    pdf, df = series
    out = rows(Q.centred_sequences(df, ["rec"], "i", ["x"], 3, chunk), "rec", "i")
    sizes = pdf.groupby("rec").size()
    assert len(out) == sum(n for n in sizes if n >= 7)
    for r in out.itertuples():
        centre = min(max(r.i, 3), sizes[r.rec] - 4)
        assert r.centre == centre and [e["i"] for e in r.seq] == list(range(centre - 3, centre + 4))
    over = rows(Q.overlapping_sequences(df, ["rec"], "i", ["x"], 5, 4, chunk), "rec", "start")
    assert len(over) == sum(max(n - 4, 0) for n in sizes)
    assert all([e["i"] for e in r.seq] == list(range(r.start, r.start + 5)) for r in over.itertuples())


def test_constant_scores_add_up_to_window_counts(spark, series):
    _, df = series
    w = Q.overlapping_sequences(df, ["rec"], "i", ["x"], 5, 4, 7).withColumn(
        "scores", F.transform("seq", lambda e: F.array(F.lit(1.0), F.lit(2.0))))
    out = Q.overlap_add(w, ["rec"], 2)
    assert out.where((F.col("scores")[0] != F.col("n_windows")) | (F.col("pred") != 1)).count() == 0


@pytest.mark.parametrize("kernel", [[0.2, 0.5, 0.3], [0.1, 0.2, 0.4, 0.2, 0.1]])
def test_label_smoothing_mirrors_borders(spark, kernel):
    labels = {0: [0, 1, 2, 2, 1], 1: [2, 0], 2: [1]}
    df = spark.createDataFrame([(r, i, s) for r, v in labels.items() for i, s in enumerate(v)], "rec int, i long, s int")
    out = rows(Q.smooth_labels(df, ["rec"], "i", "s", kernel, 3, 2), "rec", "i")
    half = len(kernel) // 2
    for r, v in labels.items():
        hot = np.eye(3)[v]
        pad = np.pad(hot, ((half + 1, half + 1), (0, 0)), "symmetric")
        want = np.array([[np.convolve(pad[:, c], kernel, "same")[i + half + 1] for c in range(3)] for i in range(len(v))])
        np.testing.assert_allclose(np.stack(out[out.rec == r].soft), want, atol=1e-12)


@pytest.mark.parametrize("chunk", CHUNKS)
def test_transitions_with_gaps(spark, chunk):
    ids = [0, 1, 2, 5, 6, 7, 8, 20]
    state = list("ABBCBADD")
    df = spark.createDataFrame(list(zip(ids, state)), "epoch_id long, latent_id string")
    got = {(r.src, r.dst): r.n for r in L.transitions(df, [], chunk=chunk).collect()}
    want = {}
    for (i, a), (j, b) in zip(zip(ids, state), list(zip(ids, state))[1:]):
        if j - i == 1:
            want[a, b] = want.get((a, b), 0) + 1
    assert got == want


@pytest.mark.parametrize("chunk", [4, 64])
def test_artefact_mask_equals_interval_route(spark, chunk):
    """Distance to flagged samples is what padding, merging and membership give."""
    rng = np.random.default_rng(5)
    n, fs = 120, 10.0
    x = rng.normal(size=n)
    x[[17, 60, 61, 119]] = [30, -25, 28, 40]
    df = spark.createDataFrame(pd.DataFrame({"rec": 0, "i": np.arange(n), "x": x}))
    got = rows(E.artefact_mask(df, ["rec"], "i", "x", fs, (3.0, 2.5), (0.35, 0.2), chunk), "i")
    z = E.zscore(df, ["rec"], "i", "x", chunk=chunk)
    d = E.first_difference(z, ["rec"], "i", "z", chunk=chunk)
    step = n / (n - 1) / fs
    at = d.withColumn("time", F.col("i") * step)
    inside = []
    for flag, width in ((F.abs("z") > 3.0, 0.35), (F.abs("diff") > 2.5, 0.2)):
        r = I.runs(d, ["rec"], "i", flag, chunk).select("rec", *[(F.col(c) * step).alias(c) for c in ("start", "end")])
        merged = I.merge_intervals(I.pad(r, width), ["rec"], span=1.0)
        inside.append(rows(I.in_intervals(at.select("rec", "i", "time"), merged, ["rec"], "time", width=2.0), "i").inside)
    assert got.artefact.tolist() == (inside[0] | inside[1]).tolist()
    assert (got.x[got.artefact] == 0).all() and 0 < got.artefact.sum() < n


@pytest.mark.parametrize("width", [3.0, 1000.0])
def test_labels_of_overlapping_annotations(spark, width):
    """The interval that starts last wins, also after a nested one has ended."""
    rng = np.random.default_rng(8)
    iv = [(r, float(rng.integers(0, 60)), float(rng.integers(0, 30)), int(s)) for r in (0, 1) for s in rng.integers(0, 5, 12)] + [(0, 5.0, 50.0, None)]
    pts = [(r, float(t)) for r in (0, 1, 2) for t in np.arange(0, 70, 1.5)]
    a = spark.createDataFrame(iv, "rec int, onset double, duration double, stage int")
    p = spark.createDataFrame(pts, "rec int, time double")
    got = {(x.rec, x.time): x.stage for x in I.label_points(p, a, ["rec"], "time", width=width, overlapping=True).collect()}
    for r, t in pts:
        hits = [(on, s) for q, on, d, s in iv if q == r and s is not None and on <= t < on + d]
        assert got[r, t] == (max(hits)[1] if hits else None)
    apart = spark.createDataFrame([(0, 0.0, 10.0, 1), (0, 10.0, 5.0, 2), (1, 3.0, 40.0, 3)], "rec int, onset double, duration double, stage int")
    one = {(x.rec, x.time): x.stage for x in I.label_points(p, apart, ["rec"], "time", width=width).collect()}
    assert one[0, 9.0] == 1 and one[0, 10.5] == 2 and one[0, 15.0] is None and one[1, 42.0] == 3 and one[2, 0.0] is None
    assert len(one) == len(pts)


@pytest.mark.parametrize("accuracy, held, size", [(1000, 10**6, 1 << 16), (100, 10**6, 512), (20, 800, 512)])  # few, bracketed, finer sketches
def test_column_quantiles(spark, monkeypatch, accuracy, held, size):
    from somnia.operators import quantiles
    monkeypatch.setattr(quantiles, "ACCURACY", accuracy)
    monkeypatch.setattr(quantiles, "HELD", held)
    rng, n = np.random.default_rng(accuracy), 9000
    pdf = pd.DataFrame({
        "k": np.where(np.arange(n) < n * 0.9, "hot", np.where(np.arange(n) < n - 7, "b", "c")), "i": np.arange(n),
        "tail": rng.lognormal(0, 3, n), "offset": 1e6 + rng.uniform(-1, 1, n), "masked": np.where(rng.random(n) < 0.6, 0.0, rng.normal(size=n)),
        "artefact": np.where(rng.random(n) < 1e-3, -1e12, rng.normal(size=n)), "ties": rng.integers(0, 5, n).astype(float)})
    pdf.loc[pdf.k == "c", "ties"] = np.nan
    pdf.loc[::11, "offset"] = np.nan
    values, ps = ["tail", "offset", "masked", "artefact", "ties"], {"p10": 0.1, "m": 0.5, "p90": 0.9, "least": 0.0, "most": 1.0}
    got = quantiles.column_quantiles(spark.createDataFrame(pdf).repartition(5), ["k"], "i", values, ps, True, size).toPandas().set_index("k")
    for k, own in pdf.groupby("k"):
        assert (got.loc[k, "_first"], got.loc[k, "_last"]) == (own.i.min(), own.i.max())
        for v in values:
            x = own[v].dropna().to_numpy()
            for name, p in ps.items():
                cut = got.loc[k, f"{name}_{v}"]
                if not len(x):
                    assert pd.isna(cut) and pd.isna(got.loc[k, f"low_{name}_{v}"])
                    continue
                assert cut == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-300)
                assert got.loc[k, f"low_{name}_{v}"] == pytest.approx(x[x <= cut].mean(), rel=1e-9)
                assert got.loc[k, f"top_{name}_{v}"] == pytest.approx(x[x >= cut].mean(), rel=1e-9)


def test_positions_in_any_order(spark):
    """Hot key, ties, NULL keys and more tasks than rows of some keys."""
    from somnia.operators.ordered import ranked
    rng = np.random.default_rng(4)
    data = [(None if x < 0.1 else "hot" if x < 0.8 else f"k{int(x * 100)}", float(rng.integers(0, 40)), i) for i, x in enumerate(rng.random(3000))]
    df = spark.createDataFrame(data, "k string, x double, i long").repartition(7)
    got = ranked(df, ["k"], [F.col("x").desc(), F.col("i")], "at", "n", rows_per_task=100).toPandas()
    pdf = pd.DataFrame(data, columns=["k", "x", "i"]).sort_values(["x", "i"], ascending=[False, True])
    for k, own in pdf.groupby(pdf.k.fillna("null")):
        mine = got[got.k.fillna("null") == k].sort_values("at")
        assert list(mine["at"]) == list(range(len(own))) and list(mine.i) == list(own.i) and (mine.n == len(own)).all()
    everything = ranked(df.limit(0), [], [F.col("x")], "at")
    assert everything.columns == ["k", "x", "i", "at"] and everything.count() == 0


@pytest.mark.parametrize("epsilon, strict", [(0, False), (2, False), (2, True), (50, False)])
def test_merging_needs_one_scan(spark, epsilon, strict):
    """Against a plain loop, with islands over many chunks, nested ones and ties; the input is planned at most four times."""
    rng = np.random.default_rng(7)
    start = rng.integers(0, 900, 400)
    pdf = pd.DataFrame({"rec": np.where(np.arange(400) < 300, 0, rng.integers(1, 4, 400)), "start": start, "end": start + rng.integers(0, 9, 400) ** 2 // 9})
    pdf.loc[0, ["rec", "start", "end"]] = (3, 5, 700)
    want = []
    for rec, part in pdf.groupby("rec"):
        begin = reach = None
        for s, e in sorted(zip(part.start, part.end)):
            if reach is None or (s - reach >= epsilon if strict else s - reach > epsilon):
                want += [] if reach is None else [(rec, begin, reach)]
                begin, reach = s, e
            reach = max(reach, e)
        want.append((rec, begin, reach))
    df = spark.createDataFrame(pdf)
    for span in (1.0, 10.0, 64.0, 5000.0):
        got = I.merge_intervals(df, ["rec"], epsilon=epsilon, strict=strict, span=span)
        assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") + plan.count("LocalRelation") <= 4


def test_statistics_come_back_without_a_hot_task(spark):
    """One key holds a third of all rows; without broadcasts no task of the join gets over twice the mean."""
    from somnia.operators.ordered import attach_by_hash
    df = spark.range(60_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 40 + 1).alias("k"), F.lit(1.5).alias("x"))
    stats = df.groupBy("k").agg(F.count("*").alias("n"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        out = attach_by_hash(df, stats, ["k"], ["id"], rows_per_part=500)
        sizes = [r["count"] for r in out.groupBy(F.spark_partition_id().alias("p")).count().collect()]
        assert sum(sizes) == 60_000 and len(sizes) == 8 and max(sizes) < 2 * 60_000 / 8
        assert out.where("n IS NULL").isEmpty() and out.where("k = 0 AND n <> 20000").isEmpty()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    empty = df.limit(0)
    assert attach_by_hash(empty, stats.limit(0), ["k"], ["id"]).count() == 0


def _way_down(plan):
    """Operators from the plan's root along first children, in AQE's initial plan."""
    node, names = plan.executedPlan().initialPlan(), []
    while True:
        names.append(node.nodeName())
        if not node.children().size():
            return names, node.toString()
        node = node.children().apply(0)


@pytest.mark.parametrize("reach", [0, 40, 200])
def test_chunked_table(spark, series, tmp_path, reach):
    """Masks, differences and sums on the table equal those on plain rows, in a session that did not write it, without moving a sample."""
    from somnia.sources import store as S
    pdf, df = series
    path = f"{tmp_path}/store"
    for _ in range(2):  # the second replaces the first
        S.write_chunked(df, path, ["rec"], "i", reach=reach, chunk=64, rows_per_bucket=50)
    other = spark.newSession()
    other.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    table, chunk = S.open_chunked(other, path)
    assert chunk == 64 and chunk.reach == reach and table.where("_core").count() == len(pdf)
    pd.testing.assert_frame_equal(rows(drop_halo(table), "rec", "i")[["rec", "i", "x"]], pdf, check_dtype=False)
    mask = lambda d, c: E.artefact_mask(d, ["rec"], "i", "x", 100, (2.0, 2.5), (0.2, 0.1), c)
    got, want = mask(table, chunk), mask(df, 64)
    pd.testing.assert_frame_equal(rows(got, "rec", "i")[want.columns], rows(want, "rec", "i"), check_dtype=False, atol=1e-12)
    step = E.first_difference(table, ["rec"], "i", "x", "d", chunk) if reach else None
    if reach:
        pd.testing.assert_frame_equal(rows(step, "rec", "i")[["rec", "i", "d"]], rows(E.first_difference(df, ["rec"], "i", "x", "d"), "rec", "i")[["rec", "i", "d"]], check_dtype=False)
    names, leaf = _way_down(got._jdf.queryExecution())
    assert "Bucketed: true" in leaf and ("Exchange" in names) == (reach < 23)  # 0.2 s at 100 Hz and one more sample each way
    names, _ = _way_down(want._jdf.queryExecution())
    assert "Exchange" in names
    with pytest.raises(ValueError):
        E.first_difference(drop_halo(table), ["rec"], "i", "x", "d", chunk)


def test_chunked_table_of_nothing_and_of_rows_without_place(spark, tmp_path):
    from somnia.sources import store as S
    empty = spark.createDataFrame([], "rec long, i long, x double")
    S.write_chunked(empty, f"{tmp_path}/none", ["rec"], "i")
    table, _ = S.open_chunked(spark, f"{tmp_path}/none")
    assert table.count() == 0
    with pytest.raises(ValueError):
        S.write_chunked(spark.createDataFrame([(1, None, 0.5)], empty.schema), f"{tmp_path}/lost", ["rec"], "i")


def test_chunked_table_has_buckets_that_a_task_can_sort(spark, tmp_path):
    from somnia.sources import store as S
    df = spark.range(1_200_000).select(F.lit(0).alias("rec"), F.col("id").alias("i"))
    S.write_chunked(df, f"{tmp_path}/store", ["rec"], "i", reach=16, chunk=4096)
    assert spark.read.parquet(f"{tmp_path}/store/layout").first().buckets == 3
    table, _ = S.open_chunked(spark, f"{tmp_path}/store")
    assert table.where("_core").agg(F.sum("i")).first()[0] == sum(range(1_200_000))
