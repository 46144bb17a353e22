"""The detectors, models, readers, sinks and streams against plain NumPy and pandas, or against files made here."""

import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telltale import cli
from telltale.operators import audit, candidates, detect, export, features, heads, metrics, packets, relate, sequence, state
from telltale.plans import catalogue, network
from telltale.sources import sinks, tables
from telltale.streaming import detector, stateful

SF = "/root/testdata/sf0.001"


def spread(x, floor=None):
    """Robust scale, in the words of the survey."""
    x = x[np.isfinite(x)]
    if not len(x):
        return 1.0
    s = 1.4826 * np.median(np.abs(x - np.median(x)))
    return s if s > 1e-9 else max(np.std(x), 1.0)


def plain_huber(z, y, delta=1.5, ridge=1e-3, steps=200):
    z = np.column_stack([np.ones(len(z)), z])
    beta = np.linalg.lstsq(z, y, rcond=None)[0]
    penalty = np.diag([0.0] + [ridge] * (z.shape[1] - 1))
    for _ in range(steps):
        r = y - z @ beta
        w = np.minimum(1, delta * max(spread(r), 1e-3) / (np.abs(r) + 1e-9))
        beta = np.linalg.solve(z.T @ (z * w[:, None]) + penalty, z.T @ (w * y))
    return beta, spread(y - z @ beta)


def plain_model(table, target, names):
    """(centre, scale, beta, sigma) of a trimmed fit on complete rows."""
    t = table[[target, *names]].dropna()
    x, y = t[names].to_numpy(), t[target].to_numpy()
    centre, scale = np.median(x, 0), np.array([spread(c) for c in x.T])
    z = (x - centre) / scale
    beta, s = plain_huber(z, y)
    r = np.abs(y - beta[0] - z @ beta[1:]) / max(s, 1e-3)
    keep = r <= np.quantile(r, 0.97)
    beta, s = plain_huber(z[keep], y[keep])
    return centre, scale, beta, s


@pytest.fixture(scope="module")
def net(spark):
    """Three pressures that lean on each other and on a flow, two flows, 60 days of hours, with a leak in the last week."""
    rng = np.random.default_rng(3)
    ts = pd.date_range("2024-01-01", periods=60 * 24, freq="h")
    day = np.sin(2 * np.pi * ts.hour / 24)
    load = rng.normal(0, 1, len(ts)).cumsum() * 0.05
    t = pd.DataFrame({f"press_{k}": 50 + 3 * day * (k + 1) + load * (1 + 0.3 * k) + rng.normal(0, 0.4, len(ts)) for k in range(3)}, index=ts)
    t["flow_0"] = 20 - 2 * day - load + rng.normal(0, 0.5, len(ts))
    t["flow_1"] = 8 + day + rng.normal(0, 0.5, len(ts))
    leak = (ts >= "2024-02-24") & (ts < "2024-02-26")
    t.loc[leak, ["press_0", "press_1"]] -= 6
    t.loc[leak, "flow_0"] += 6
    t.iloc[5, 0] = t.iloc[77, 3] = np.nan
    long = t.stack(future_stack=True).rename("value").reset_index().set_axis(["ts", "series", "value"], axis=1)
    long["kind"] = np.where(long["series"].str.startswith("press"), "pressure", "flow")
    df = spark.createDataFrame(long[["series", "kind", "ts", "value"]].astype({"value": object}).where(long["value"].notna(), None), "series string, kind string, ts timestamp_ntz, value double")
    return t, df.repartition(4).cache()


SETTINGS = detect.Settings(slots="daily_hour", anchors=2, pair_anchors=1, least_top=2, slope_rows=6, week_rows=168, vote=2.0, quiet=4, merge=6, burst_confirm=(3, 2), incipient_confirm=(6, 3), least_rows=100, steps=60)


def plain_full(table, cut, s):
    """Burst, CUSUM, incipient and final scores, allowance and thresholds of the full detector, in pandas."""
    pressures, flows = [c for c in table if c.startswith("press")], [c for c in table if c.startswith("flow")]
    smooth = table[table.index < cut].rolling(3, min_periods=1).median()
    location = {c: smooth[c].groupby(smooth.index.hour).median() for c in smooth}
    off = lambda t: t - pd.DataFrame({c: location[c].reindex(t.index.hour).to_numpy() for c in t}, index=t.index)
    more = lambda t: t.assign(pressure_mean=t[pressures].mean(axis=1), pressure_min=t[pressures].min(axis=1))
    calm = more(off(smooth))
    corr = calm[pressures].fillna(0).corr().abs()
    near = {p: sorted((q for q in pressures if q != p), key=lambda q: (-corr.loc[p, q], q)) for p in pressures}
    models = {("p", p): (p, near[p][: s.anchors] + flows) for p in pressures}
    models |= {("f", f): (f, [g for g in flows if g != f] + ["pressure_mean", "pressure_min"]) for f in flows}
    models |= {("w", p, a): (p, [a] + flows) for p in pressures for a in near[p][: s.pair_anchors]}
    fitted = {k: plain_model(calm, *m) for k, m in models.items()}

    def resid(t, k):
        (target, names), (centre, scale, beta, _) = models[k], fitted[k]
        x = t[names].to_numpy()
        return t[target] - beta[0] - ((np.where(np.isnan(x), centre, x) - centre) / scale) @ beta[1:]

    low = lambda r, sc: (-r / max(sc, 1e-3)).clip(lower=0)
    own = {p: resid(calm, ("p", p)) for p in pressures}
    week, fall = ({p: spread((own[p] - own[p].shift(n)).to_numpy()) for p in pressures} for n in (s.week_rows, s.slope_rows - 1))

    def total(t):
        ds = more(off(t.rolling(3, min_periods=1).median()))
        r = {p: resid(ds, ("p", p)) for p in pressures}
        frame = lambda f: pd.DataFrame({p: f(p) for p in pressures})
        pressure = frame(lambda p: low(r[p], fitted["p", p][3])).fillna(0)
        pair = frame(lambda p: pd.concat([low(resid(ds, k), fitted[k][3]) for k in models if k[:2] == ("w", p)], axis=1).median(axis=1)).fillna(0)
        ewma = frame(lambda p: low(r[p] - r[p].shift(s.week_rows), week[p])).ewm(alpha=s.alpha, adjust=False).mean().fillna(0)
        slope = frame(lambda p: low(r[p] - r[p].shift(s.slope_rows - 1), fall[p])).fillna(0)
        flow = pd.DataFrame({f: (resid(ds, ("f", f)) / max(fitted["f", f][3], 1e-3)).clip(lower=0) for f in flows}).fillna(0)
        top = lambda f, k: pd.Series(np.sort(f.to_numpy(), 1)[:, ::-1][:, :k].mean(1), f.index)
        night = ((t.index.hour >= 1) & (t.index.hour < 4)).astype(float)
        fk = top(flow, 2)
        burst = s.pressure * top(pressure, 2) + s.pairwise * top(pair, 2) + s.flow * fk + s.night * fk * night
        return burst, top(ewma, 2) + s.slope * top(slope, 2), fk, pressure + pair + 0.5 * ewma + 0.25 * slope

    def cusum(x, a):
        out = np.zeros(len(x))
        for i in range(1, len(x)):
            out[i] = max(0, s.decay * out[i - 1] + x.iloc[i] - a)
        return out

    burst, inc, fk, _ = total(table[table.index < cut])
    allowance = np.median(burst) + 0.5 * spread(burst.to_numpy())
    th = {"burst": np.quantile(np.maximum(burst, cusum(burst, allowance)), s.burst_q), "incipient": np.quantile(inc, s.incipient_q), "hold": np.quantile(np.maximum(burst, inc), s.hold_q), "flow_hold": np.quantile(fk, s.flow_hold_q)}
    burst, inc, fk, evidence = total(table[table.index >= cut])
    cu = cusum(burst, allowance)
    final, trigger, votes = np.maximum(burst, inc), np.maximum(burst, cu), (evidence >= s.vote).sum(axis=1)
    vote = lambda f, w, n: pd.Series(f).rolling(w, min_periods=1).sum().to_numpy() >= n
    bv, iv = vote((trigger >= th["burst"]).to_numpy(), *s.burst_confirm), vote((inc >= th["incipient"]).to_numpy(), *s.incipient_confirm)
    on, quiet, states = False, 0, []
    for i in range(len(burst)):
        enough, hit = votes.iloc[i] >= s.start_votes, fk.iloc[i] >= th["flow_hold"]
        if not on:
            on, quiet = bool((bv[i] and (enough or hit)) or (iv[i] and enough)), 0
        elif final.iloc[i] >= th["hold"] or hit or votes.iloc[i] >= s.hold_votes:
            quiet = 0
        else:
            quiet += 1
            on = quiet < s.quiet
        states.append(int(on))
    closed, i = list(states), 0
    while i < len(closed):
        j = i
        while j < len(closed) and closed[j] == closed[i]:
            j += 1
        if closed[i] == 0 and 0 < i and j < len(closed) and j - i <= s.merge:
            states[i:j] = [1] * (j - i)
        i = j
    return pd.DataFrame({"score_burst": burst, "burst_cusum": cu, "score_incipient": inc, "score_final": final, "votes": votes, "leak_state": states}), th, allowance


def test_full_detector(net):
    table, df = net
    cut = pd.Timestamp("2024-02-20")
    want, th, allowance = plain_full(table, cut, SETTINGS)
    fitted = detect.fit_full(df.where(F.col("ts") < F.lit(cut.isoformat()).cast("timestamp_ntz")), SETTINGS)
    assert fitted.allowance == pytest.approx(allowance, rel=1e-2)
    for k, v in th.items():
        assert fitted.thresholds[k] == pytest.approx(v, rel=1e-2), k
    results, _ = detect.detect_full(df.where(F.col("ts") >= F.lit(cut.isoformat()).cast("timestamp_ntz")), fitted)
    got = results.toPandas().set_index("ts").sort_index()
    # the fits end at slightly different spreads: steps here weigh by the spread of the step before
    for c in ("score_burst", "burst_cusum", "score_incipient", "score_final"):
        assert np.abs(got[c] - want[c]).mean() < 0.02 * want[c].mean() + 0.01 and np.corrcoef(got[c], want[c])[0, 1] > 0.9995, c
    assert (got["votes"] == want["votes"]).mean() > 0.97 and (got["leak_state"] == want["leak_state"]).mean() > 0.97
    leak = (got.index >= "2024-02-24 04:00") & (got.index < "2024-02-26")
    assert got["leak_state"][leak].mean() > 0.9 and got["leak_state"][got.index < "2024-02-23"].mean() < 0.3


def test_robust_models(spark, net):
    table, df = net
    feats = spark.createDataFrame([("a", "press_0", "press_1"), ("a", "press_0", "flow_0"), ("b", "flow_1", "press_2"), ("c", "none", "press_2")], "model string, target string, feature string")
    none = spark.createDataFrame([("none", None, pd.Timestamp("2024-01-01").to_pydatetime())], "series string, value double, ts timestamp_ntz").select("series", F.lit("flow").alias("kind"), "ts", "value")
    got = {r["model"]: r for r in relate.robust_models(df.unionByName(none), feats, steps=60).collect()}
    for k, (target, names) in {"a": ("press_0", ["flow_0", "press_1"]), "b": ("flow_1", ["press_2"])}.items():
        centre, scale, beta, s = plain_model(table, target, names)
        assert got[k]["features"] == names
        assert np.allclose(got[k]["center"], centre) and np.allclose(got[k]["scale"], scale)
        assert np.allclose(got[k]["beta"], beta, rtol=1e-3, atol=1e-3) and got[k]["sigma"] == pytest.approx(s, rel=1e-3)
    assert got["c"]["beta"] == [0.0, 0.0] and got["c"]["sigma"] == 1.0
    r = relate.model_residuals(df, spark.createDataFrame([got["a"]]))
    r = r.toPandas().set_index("ts").sort_index()["resid"]
    centre, scale, beta, _ = plain_model(table, "press_0", ["flow_0", "press_1"])
    x = table[["flow_0", "press_1"]].to_numpy()
    want = table["press_0"] - beta[0] - ((np.where(np.isnan(x), centre, x) - centre) / scale) @ beta[1:]
    assert np.allclose(r.dropna(), want.dropna(), atol=2e-3)


def test_candidates(spark, net):
    table, df = net
    base = detect.Settings(least_top=2, slope_rows=6, quiet=4, merge=6, step_s=3600, week_rows=168, burst_confirm=(3, 2), incipient_confirm=(6, 3), vote=2.0)
    truth = spark.createDataFrame([(t.to_pydatetime(), int("2024-02-24" <= str(t) < "2024-02-26")) for t in table.index], "ts timestamp_ntz, leak int")
    got = candidates.compare(df.where("ts < '2024-02-20'"), df.where("ts >= '2024-02-20'"), truth, base, candidates=candidates.CANDIDATES[1:]).orderBy("place").collect()
    assert [r["name"] for r in got][-1] == "reference" and got[0]["recall"] > 0.8
    assert {r["bytes"] for r in got if r["name"] == "tiny_daily24_proto"} == {5 * 24 * 2 + 3 * 12 + 5 * 4}
    assert candidates.by_name("tiny_daily24_proto").sensors == 6


def test_areas(spark):
    d = spark.createDataFrame([(["a", "b", "c"],), (["c"],), (["x"],), ([],)], "top array<string>")
    assert [r[0] for r in d.select(detect.area_of({"a": "north", "b": "north", "c": "south"}, "unknown")).collect()] == ["north", "south", "unknown", "unknown"]


def test_few_healthy_rows(net):
    with pytest.raises(ValueError):
        detect.fit_full(net[1].limit(50), SETTINGS)


def test_hysteresis_brute_force(spark):
    """Also where starts don't hold, and nulls."""
    rng = np.random.default_rng(5)
    rows = [(f"s{k}", (pd.Timestamp("2024-01-01") + pd.Timedelta(hours=i)).to_pydatetime(), [True, False, None][rng.choice(3, p=[0.1, 0.8, 0.1])], [True, False, None][rng.choice(3, p=[0.3, 0.6, 0.1])]) for k in range(3) for i in range(500)]
    want, on, quiet, series = {}, False, 0, None
    for s, ts, start, hold in rows:
        if s != series:
            on, quiet, series = False, 0, s
        if not on:
            on, quiet = bool(start), 0
        elif hold:
            quiet = 0
        else:
            quiet += 1
            on = quiet < 3
        want[s, pd.Timestamp(ts)] = int(on)
    df = spark.createDataFrame(rows, "series string, ts timestamp_ntz, start boolean, hold boolean")
    assert {(r["series"], pd.Timestamp(r["ts"])): r["state"] for r in state.hysteresis(df, 3).collect()} == want


def test_quantile_edges(spark):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=30_000), np.zeros(20_000), [5.0] * 3])
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(4)
    assert np.allclose(metrics.quantile_edges(df, "x", 10, most=500), np.quantile(x, np.arange(1, 10) / 10))
    assert metrics.quantile_edges(df.limit(0), "x", 10) == []


def numbers(df, columns):
    return df.orderBy(columns[0]).select(*columns).toPandas()


def test_logistic_head(spark):
    d = catalogue.learnable(spark, SF)
    t = d.where("split = 'train'").toPandas()
    x, y = t[catalogue.FEATURES].to_numpy(float), t["y"].to_numpy()
    sd = x.std(0, ddof=1)
    z = np.column_stack([np.ones(len(x)), x / sd])
    w = np.zeros(z.shape[1])
    penalty = np.diag([0.0] + [1.0] * x.shape[1])
    for _ in range(60):
        p = 1 / (1 + np.exp(-z @ w))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + penalty, z.T @ (y - p) - penalty @ w)
    rest = d.where("split <> 'train'").orderBy("event_id").toPandas()
    want = 1 / (1 + np.exp(-(w[0] + rest[catalogue.FEATURES].to_numpy(float) / sd @ w[1:])))
    got = numbers(catalogue.QUERIES["logistic_head"](spark, SF), ["event_id", "p"])["p"]
    assert np.abs(got - want).max() < 0.02


def test_boosted_and_calibrated(spark):
    t = catalogue.QUERIES["gbt_head_calibrated"](spark, SF).toPandas()
    assert ((t["p"] > 0.5) == (t["y"] > 0.5)).mean() > 0.95
    o = t.sort_values("p")["p_cal"].to_numpy()
    assert (np.diff(o) >= -1e-9).all() or len(set(t["p"])) < len(t)
    one = spark.createDataFrame([(1, 0.5, 1.0), (2, 0.7, 1.0)], "id int, x double, y double")
    assert [r["p"] for r in heads.boosted_head(one, one, ["x"]).collect()] == [pytest.approx(1 - 1e-6)] * 2
    few = spark.createDataFrame([(k, 0.2 + 0.1 * (k % 7), float(k % 2)) for k in range(12)], "id int, p double, y double")
    assert all(0 <= r["p_cal"] <= 1 for r in heads.calibrated(few, few).collect())
    assert [r["p_cal"] for r in heads.calibrated(few.where("y = 1"), few).collect()] == [r["p"] for r in few.collect()]


def test_regression_head(spark):
    d = spark.createDataFrame([(float(k), float(3 * (k % 10))) for k in range(300)], "x double, y double").withColumn("m", F.col("x") % 10)
    got = heads.regression_head(d, d, ["m"], "y").toPandas()
    assert np.abs(got["pred_y"] - got["y"]).mean() < 1.0


def test_principal_components(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").toPandas()
    x = np.array(e["embedding"].tolist(), float)
    z = (x - x.mean(0)) / x.std(0, ddof=1)
    _, _, v = np.linalg.svd(z - z.mean(0), full_matrices=False)
    got = numbers(catalogue.QUERIES["principal_components"](spark, SF), ["vec_id", "pc1", "pc2"])
    assert np.allclose(got[["pc1", "pc2"]], np.abs(z @ v[:2].T), atol=2e-3)


def test_ovr_localizer(spark):
    t = catalogue.QUERIES["ovr_localizer"](spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/events.parquet").select("event_id", "value").toPandas(), on="event_id")
    assert ((t["p_b"] > 0.5) == (t["value"] > 90)).mean() > 0.9


def test_packet_set(spark):
    p = catalogue.QUERIES["packet_set"](spark, SF).toPandas()
    n = p["kind"].value_counts()
    assert n["hard_negative"] == max(24, round(0.25 * n["positive"])) and n["easy_negative"] == round(0.35 * n["positive"])
    assert not p[p["kind"] == "easy_negative"]["ts"].isin(p[p["kind"] == "hard_negative"]["ts"]).any()
    parts = p[p["kind"] == "positive"].groupby("split")["ts"].agg(["min", "max", "size"])
    assert parts.loc["train", "max"] <= parts.loc["cal", "min"] and parts.loc["cal", "max"] <= parts.loc["val", "min"]
    assert parts.loc["train", "size"] == round(0.6 * n["positive"])


def test_stage2_features(spark):
    f = catalogue.QUERIES["stage2_features"](spark, SF)
    one = f.groupBy("trigger").agg(F.count("*").alias("n"), F.count_distinct("feature").alias("d")).where("n <> d")
    assert one.isEmpty()
    names = [r[0] for r in f.select("feature").distinct().collect()]
    assert {"raw|AF|12|mean", "demand|hhi|36|auc", "reason_event_start", "trigger_order", "hour_sin", "top1_share"} <= set(names)
    binary, localiser = (features.select_features([*names, "reason_hard_negative", "reason_easy_negative", "event_rows", "stage1|leak_state|12|mean", "sensor|a|12|max"], w) for w in ("binary", "localiser"))
    assert not {"hour_sin", "reason_event_start", "trigger_order", "event_rows", "stage1|leak_state|12|mean"} & set(binary) and {"raw|AF|12|mean", "sensor|a|12|max", "top1_share"} <= set(binary)
    assert {"hour_sin", "reason_event_start", "event_rows", "raw|AF|12|mean"} <= set(localiser) and not {"reason_hard_negative", "reason_easy_negative"} & set(localiser)
    w = features.wide(f, ["raw|AF|12|mean", "trigger_order"])
    assert w.count() == f.select("trigger").distinct().count()


def test_small_splits(spark):
    for n, want in ((1, ["train"]), (2, ["train", "cal"]), (3, ["train", "cal", "val"]), (5, ["train"] * 3 + ["cal", "val"])):
        d = spark.createDataFrame([(1, k) for k in range(n)], "g int, k int")
        assert [r["split"] for r in packets.split_three(d, "g", ["k"]).orderBy("k").collect()] == want
    assert packets.sample_rows(spark.range(100), "id", 7).count() == 7


def test_permutation_importance(spark):
    d = spark.createDataFrame([(float(k % 2), float(k * 7 % 13), k % 2) for k in range(400)], "a double, b double, y int").repartition(3)
    accuracy = lambda t: t.agg(F.avg(((F.col("p") > 0.5).cast("int") == F.col("y")).cast("double"))).first()[0]
    got = {r["feature"]: r["importance"] for r in features.permutation_importance(d, ["a", "b"], "y", lambda t: t.withColumn("p", F.col("a")), accuracy, shuffles=2).collect()}
    assert got["a"] > 0.3 and got["b"] == pytest.approx(0.0)


# readers and sinks


def csv(path, header, rows, sep=";"):
    path.write_text("\n".join([sep.join(header), *(sep.join(r) for r in rows)]) + "\n")


def test_readers(spark, tmp_path):
    csv(tmp_path / "2018_SCADA_Pressures.csv", ["Timestamp", " n1 ", "n2"], [["01.01.2018 00:05", "1,5", "x"], ["2018-01-01 00:00:00", "2,5", "3"], ["01.01.2018 00:05", "9", "9"], ["bad", "1", "1"]])
    csv(tmp_path / "2018_SCADA_Flows.csv", ["Timestamp", "p1"], [["2018-01-01 00:05", "7,25"], ["2018-01-01 00:10", "8"]])
    p = tables.read_semicolon(spark, f"file://{tmp_path}/2018_SCADA_Pressures.csv")
    assert p.columns == ["Timestamp", "n1", "n2"] and p.where("Timestamp is null").count() == 1 and p.where("n2 is null").count() == 1
    s = {str(r["ts"]): (r["n1"], r["p1"]) for r in tables.read_split(spark, f"file://{tmp_path}", 2018).where("ts is not null").collect()}
    assert s == {"2018-01-01 00:00:00": (2.5, None), "2018-01-01 00:05:00": (1.5, 7.25), "2018-01-01 00:10:00": (None, 8.0)}
    with pytest.raises(ValueError):
        tables.read_split(spark, f"file://{tmp_path}", 1999)
    (tmp_path / "report.txt").write_text("repaired 2018-03-02 10:15 and later 2018-02-01T08:00:30, done")
    assert [str(r["start_ts"]) for r in tables.leak_report(spark, f"file://{tmp_path}/report.txt").collect()] == ["2018-01-31 08:00:30", "2018-03-01 10:15:00"]
    csv(tmp_path / "merged.csv", ["when_time", "press_1", "press_10", "press_2", "flow_1", "none", "pipe_1_bin"], [["2018-01-01 00:00", "1", "2", "3", "4", "", "0"], ["2018-01-01 00:05", "a", "2", "3", "4", "", "1"]], ",")
    t, groups = tables.read_merged(spark, f"file://{tmp_path}/merged.csv")
    assert "none" not in t.columns and groups["pressure"] == ["press_1", "press_2", "press_10"] and groups["label"] == ["pipe_1_bin"]
    assert t.where("press_1 is null").count() == 1
    assert tables.read_scada(spark, f"file://{tmp_path}/merged.csv").columns[0] == "ts"
    assert tables.prepare(t.unionByName(t), "ts", ["press_1"]).count() == 2
    with pytest.raises(ValueError):
        tables.column_groups(["press_1"])
    assert tables.column_groups(["press_1", "f"], {"flow": ["f"]})["flow"] == ["f"]
    assert tables.renamed(t.select("ts", "press_1", "flow_1"), "col").columns == ["ts", "col_1", "col_2"]
    assert tables.first_path(spark, [f"file://{tmp_path}/nowhere", f"file://{tmp_path}"]) == f"file://{tmp_path}"
    with pytest.raises(ValueError):
        tables.find_time_column(t.select(F.lit("x").alias("time")))
    with pytest.raises(ValueError):
        tables.require_rows(t, 3)
    assert tables.require_rows(t, 3, t) is t
    assert tables.read_parsed(spark, f"file://{tmp_path}/merged.csv", "when_time").count() == 2


def test_settings_and_summaries(spark, tmp_path):
    s = tables.settings_from_json('{"quiet": 9, "burst_confirm": [4, 3]}', detect.Settings())
    assert (s.quiet, s.burst_confirm) == (9, (4, 3))
    with pytest.raises(ValueError):
        tables.settings_from_json('{"nonsense": 1}', s)
    (tmp_path / "a_summary.json").write_text('{"name": "a",\n "recall": 0.5}')
    (tmp_path / "a_memory.csv").write_text("part,bytes\ntables,10\n")
    summaries, memory = tables.candidate_summaries(spark, f"file://{tmp_path}")
    assert summaries.first()["file"] == "a_summary.json" and memory.first()["bytes"] == 10
    assert tables.baseline_metrics(spark, f"file://{tmp_path}/a_summary.json").collect()[0]["value"] == 0.5
    (tmp_path / "none").mkdir()
    with pytest.raises(ValueError):
        tables.candidate_summaries(spark, f"file://{tmp_path}/none")


def test_active_flows(spark):
    t = spark.createDataFrame([("f1", 200, 0.9, 0.01), ("f2", 200, 0.1, 0.5), ("f3", 200, 0.1, 0.5)], "series string, n long, at_ends double, distinct_share double")
    assert audit.active_flows(["f1", "f2", "f3", "f4"], ["f3"], t) == ["f2"]


def test_run_folder(spark, net, tmp_path):
    settings = detect.Settings(slots="daily_hour", pair_anchors=1, least_top=2, slope_rows=6, quiet=4, merge=6, step_s=3600, week_rows=168)
    fitted = detect.fit_tiny(net[1].where("ts < '2024-01-20'"), settings)
    run = sinks.Run(spark, f"file://{tmp_path}/run")
    run.table(fitted.scales, "scales", "by series", "csv", report=True)
    run.json(sinks.parameters(fitted), "parameters.json")
    run.text(sinks.stage1_header(fitted), "stage1.h")
    run.text(sinks.stage2_header({"leak": (["a", "b"], [0.5, -1.0], 0.25)}), "stage2.h")
    run.close("A run", {"Metrics": "none"})
    got = json.loads(run.read_text("parameters.json"))
    assert len(got["tables"]["press_0"]) == 24 and set(got["thresholds"]) == {"burst", "incipient", "hold", "flow_hold"}
    head = run.read_text("stage1.h")
    assert "static const int16_t table_press_0[24] = {" in head and "threshold_burst" in head
    table = np.array([int(x) for x in head.split("table_press_0[24] = {")[1].split("}")[0].split(",")])
    scale = float(head.split("table_press_0_scale = ")[1].split("f;")[0])
    assert np.abs(table * scale - got["tables"]["press_0"]).max() <= scale
    assert "leak_w[2] = {0.5f, -1f}" in run.read_text("stage2.h")
    assert [r["name"] for r in run.manifest().collect()] == sorted(r[0] for r in run.made)
    assert "| series |" in run.read_text("scales.md") and "## Metrics" in run.read_text("report.md")
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/run/scales").count() == 5
    assert json.loads(json.dumps({"a": np.float64(1), "b": {1}, "c": pd.Timestamp("2024-01-01")}, default=sinks.plain))["b"] == [1]


def test_command_line(spark, net, tmp_path):
    t = net[0].copy()
    t.index = t.index - pd.Timedelta(days=31)  # December 2023 and January 2024
    t["pipe_1"] = 0.0
    t.loc[(t.index >= "2024-01-24") & (t.index < "2024-01-26"), "pipe_1"] = 3.0
    t.rename_axis("time").reset_index().to_csv(tmp_path / "merged.csv", index=False)
    (tmp_path / "settings.json").write_text(json.dumps({"slots": "daily_hour", "pair_anchors": 1, "least_top": 2, "slope_rows": 6, "quiet": 4, "merge": 6, "step_s": 3600, "week_rows": 168}))
    run = cli.run(spark, cli.arguments(["--merged", f"file://{tmp_path}/merged.csv", "--train-year", "2023", "--test-year", "2024", "--config", f"file://{tmp_path}/settings.json", "--compact", "--output-dir", f"file://{tmp_path}/out"]))
    m = spark.read.json(f"{run.folder}/metrics").first()
    assert m["recall"] > 0.9 and m["precision"] > 0.2
    assert spark.read.json(f"{run.folder}/events").count() >= 1 and "# Stage 1" in run.read_text("report.md")


# streams


def wait(query):
    query.awaitTermination()


def test_windows_and_sessions(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet")
    e.orderBy("ts").repartitionByRange(4, "ts").write.parquet(f"file://{tmp_path}/in")
    stream = detector.events_stream(spark, f"file://{tmp_path}/in")
    wait(detector.run(detector.hourly(stream, "60 days"), f"file://{tmp_path}/hours", f"file://{tmp_path}/c1"))
    late = detector.hourly(e)
    want = {(r["series"], r["ts"]): r["value"] for r in late.collect()}
    for r in spark.read.schema(late.schema).parquet(f"file://{tmp_path}/hours").collect():
        assert r["value"] == pytest.approx(want[r["series"], r["ts"]])
    sessions = detector.sessions(e)
    assert sessions.agg(F.sum("n")).first()[0] == e.count()


def test_stateful_stream_equals_batch(spark, net, tmp_path):
    """Three triggers of a stream give what one pass in plain Python gives; a repeated file changes nothing."""
    table = net[0]
    x = (55 - table["press_0"]).clip(lower=0).fillna(0)
    names = [["a", "b"] if i % 90 < 45 else ["c"] for i in range(len(x))]
    rows = pd.DataFrame({"network": "n", "ts": x.index.tz_localize("UTC"), "value": x.to_numpy(), "names": names})
    schema = "network string, ts timestamp, value double, names array<string>"
    for k in range(3):
        spark.createDataFrame(rows.iloc[k * 480 : (k + 1) * 480], schema).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    src = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = stateful.follow(src, allowance=6.0, start=4.0, hold=1.0, recheck_s=12 * 3600, min_shift_s=3 * 3600)
    wait(detector.run(out, f"file://{tmp_path}/out", f"file://{tmp_path}/c"))
    got = spark.read.schema(stateful.OUT).parquet(f"file://{tmp_path}/out").orderBy("ts").toPandas()
    assert len(got) == len(x)
    ewma, cusum, on, quiet, event, since, last = None, 0.0, False, 0, 0, None, set()
    for i, v in enumerate(x):
        ewma = v if ewma is None else 0.15 * v + 0.85 * ewma
        cusum = max(0.0, 0.85 * cusum + v - 6.0)
        if not on:
            if cusum >= 4.0:
                on, quiet, event, since = True, 0, event + 1, None
        elif cusum >= 1.0:
            quiet = 0
        else:
            quiet += 1
            on = quiet < 3
        reason, now = None, set(names[i])
        if on:
            gap = None if since is None else (i - since) * 3600
            reason = "event_start" if gap is None else "periodic_recheck" if gap >= 12 * 3600 else "sensor_shift" if gap >= 3 * 3600 and state.jaccard(now, last) < 0.5 else None
            if reason:
                since, last = i, now
        r = got.iloc[i]
        assert (r["ewma"], r["cusum"]) == (pytest.approx(ewma), pytest.approx(cusum))
        assert (r["state"], r["event_id"], r["reason"] or None) == (int(on), event if on else 0, reason)
    assert set(got["reason"].dropna()) == {"event_start", "periodic_recheck", "sensor_shift"}
    batch = sequence.cusum(spark.createDataFrame(rows, schema).withColumn("series", F.lit("n")), 6.0, skip_first=False).orderBy("ts").toPandas()
    assert np.allclose(batch["cusum"], got["cusum"])
    feats = spark.createDataFrame(rows[["ts", "value"]])
    asked = stateful.at_triggers(spark.createDataFrame(got[got["reason"].notna()][["ts", "reason"]]), feats, {"value": 1.0}, -5.0)
    assert asked.count() == got["reason"].notna().sum()
    one = asked.first()
    assert math.isclose(one["p"], 1 / (1 + math.exp(5 - one["value"])))


def test_c_arrays(spark):
    d = spark.createDataFrame([(1, 10), (0, -5)], "i int, v int")
    assert export.c_array(d, "i", "v", "x").first()["text"] == "static const int16_t x[2] = {-5, 10};"


def test_network_queries_are_listed():
    assert {"tiny_detect", "full_detect", "packet_features"} <= set(catalogue.QUERIES) and network.TINY.monitored == 3
