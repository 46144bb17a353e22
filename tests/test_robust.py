"""Robust regressions: plain NumPy, the broadcast and the spread form, full width; flows like switches don't score."""

import dataclasses
import time

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from telltale.operators import detect, relate, robust


def sigma(x):
    mad = np.median(np.abs(x - np.median(x))) * 1.4826
    return mad if mad > 1e-9 else max(np.std(x), 1.0)


def plain(x, y, delta=1.5, ridge=1e-3, steps=30, trim=0.97):
    """The fit in plain NumPy: centre, scale, coefficients, spread."""
    whole = ~np.isnan(y) & ~np.isnan(x).any(1)
    x, y = x[whole], y[whole]
    centre, scale = np.median(x, 0), np.array([sigma(c) for c in x.T])
    z = np.column_stack([np.ones(len(x)), (x - centre) / scale])

    def fit(z, y):
        beta = np.linalg.lstsq(z, y, rcond=None)[0]
        for _ in range(steps):
            r = y - z @ beta
            w = np.minimum(1, delta * max(sigma(r), 1e-3) / (np.abs(r) + 1e-9))
            new = np.linalg.solve((z * w[:, None]).T @ z + np.diag([0] + [ridge] * x.shape[1]), z.T @ (w * y))
            moved = np.linalg.norm(new - beta) / (1 + np.linalg.norm(beta))
            beta = new
            if moved <= 1e-6:
                break
        return beta, max(sigma(y - z @ beta), 1e-3)

    beta, s = fit(z, y)
    size = np.abs(y - z @ beta) / s
    near = size <= np.quantile(size, trim)
    return centre, scale, *fit(z[near], y[near])


def panel(spark, table: pd.DataFrame):
    long = table.rename_axis("ts").reset_index().melt("ts", var_name="series")
    return spark.createDataFrame(long).withColumn("value", F.nanvl("value", F.lit(None).cast("double"))).withColumn("ts", F.col("ts").cast("timestamp_ntz")).repartition(6)


def network(rows, pressures, flows, demands, seed=1):
    rng = np.random.default_rng(seed)
    day = np.sin(np.arange(rows) * 2 * np.pi / 288)
    d = day[:, None] * rng.uniform(0.5, 2, demands) + rng.normal(size=(rows, demands))
    f = d @ rng.uniform(0, 0.3, (demands, flows)) + rng.normal(size=(rows, flows)) * 0.1
    p = -d @ rng.uniform(0, 0.2, (demands, pressures)) - f @ rng.uniform(0, 0.2, (flows, pressures)) + rng.standard_t(3, size=(rows, pressures)) * 0.2
    names = [f"press_{k}" for k in range(pressures)] + [f"flow_{k}" for k in range(flows)] + [f"n{k}" for k in range(demands)]
    return pd.DataFrame(np.hstack([p, f, d]), index=pd.date_range("2018-01-01", periods=rows, freq="5min"), columns=names)


def test_broadcast_and_spread_equal_numpy(spark):
    table = network(1500, 4, 2, 5)
    table.iloc[100:140, 1] = np.nan
    table.iloc[::37, 4] = np.nan
    feats = {"a": ("press_0", ["flow_0", "n1", "press_1"]), "b": ("flow_1", sorted(c for c in table if c != "flow_1")), "c": ("press_2", ["n4"]), "none": ("gone", ["n1"])}
    asked = spark.createDataFrame([(m, t, f) for m, (t, names) in feats.items() for f in names], "model string, target string, feature string")
    df = panel(spark, table)
    for size in (robust.BROADCAST_BYTES, 0):
        got = {r["model"]: r for r in relate.robust_models(df, asked, broadcast_bytes=size).collect()}
        assert set(got) == set(feats) and got["none"]["beta"] == [0.0, 0.0]
        for m in "abc":
            target, names = feats[m]
            centre, scale, beta, s = plain(table[names].to_numpy(), table[target].to_numpy())
            assert got[m]["features"] == names and np.allclose(got[m]["center"], centre, rtol=1e-12) and np.allclose(got[m]["scale"], scale, rtol=1e-12)
            assert np.allclose(got[m]["beta"], beta, rtol=1e-6, atol=1e-8) and np.isclose(got[m]["sigma"], s, rtol=1e-6)


def test_exact_quantiles_by_passes(spark):
    """Negative values, zeros of both signs, ties, even and odd counts."""
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(size=501), [0.0, -0.0, 5.0, 5.0, -1e300, 1e-300]])
    assert (np.argsort(robust.order_key(x), kind="stable") == np.argsort(x, kind="stable")).all() and (robust.of_order_key(robust.order_key(x)) == x).all()
    for n in (len(x), len(x) - 1, 1):
        table = pd.DataFrame({"a": x[:n], "b": 1.0, "y": 2.0}, index=pd.date_range("2018-01-01", periods=n, freq="h"))
        data = robust.Spread(robust.matrix_rows(panel(spark, table), ["a", "b", "y"]))
        model = robust.Model("m", 2, [0, 1])
        for q in (0.0, 0.25, 0.5, 0.97, 1.0):
            assert np.allclose(data.quantiles([model], "x", q)[0], np.quantile(table[["a", "b"]].to_numpy(), q, axis=0), rtol=1e-12)


def test_full_width(spark):
    """33 pressures, 3 flows and 82 demands of four weeks at five minutes, all models at once; residuals of all too."""
    table = network(4 * 2016, 33, 3, 82)
    df = panel(spark, table)
    other = [c for c in table if c[0] in "fn"]
    rows = [(f"p{k}", f"press_{k}", f) for k in range(33) for f in [*other, f"press_{(k + 1) % 33}", f"press_{(k + 5) % 33}"]]
    rows += [(f"f{k}", f"flow_{k}", f) for k in range(3) for f in other if f != f"flow_{k}"]
    began = time.time()
    models = relate.robust_models(df, spark.createDataFrame(rows, "model string, target string, feature string"))
    got = {r["model"]: r for r in models.collect()}
    assert len(got) == 36
    n = relate.model_residuals(df, models).where("resid is not null").count()
    assert n == 36 * len(table) and time.time() - began < 240
    for m in ("p7", "f2"):
        r = got[m]
        _, _, beta, s = plain(table[r["features"]].to_numpy(), table[r["target"]].to_numpy())
        assert np.allclose(r["beta"], beta, rtol=1e-5, atol=1e-7) and np.isclose(r["sigma"], s, rtol=1e-6)


def test_switching_flow_changes_nothing(spark):
    """A square-wave flow that is left out of the scores, by its form or by name."""
    table = network(24 * 40, 4, 2, 3)
    table.index = pd.date_range("2018-01-01", periods=len(table), freq="h")
    table["flow_9"] = np.where(np.arange(len(table)) // 7 % 2, 10.0, 0.0)
    kind = {"p": "pressure", "f": "flow", "n": "demand"}
    df = panel(spark, table).withColumn("kind", F.create_map(*[F.lit(x) for kv in kind.items() for x in kv])[F.substring("series", 1, 1)])
    s = detect.Settings(slots="daily_hour", pair_anchors=1, least_top=2, slope_rows=6, week_rows=168, least_rows=100)
    assert detect.scored_flows(df, s) == detect.scored_flows(df, s, simple=True) == ["flow_0", "flow_1"]
    assert detect.scored_flows(df, dataclasses.replace(s, leave_switches=False)) == ["flow_0", "flow_1", "flow_9"]
    assert detect.scored_flows(df, dataclasses.replace(s, exclude_flows=("flow_0",))) == ["flow_1"]
    both = [detect.fit_tiny(d, s) for d in (df, df.where("series <> 'flow_9'"))]
    assert both[0].thresholds == both[1].thresholds and both[0].flows == both[1].flows
    states = [detect.detect_tiny(df, f)[0].orderBy("ts").select("score_final", "leak_state").collect() for f in both[:1]]
    assert states[0] == detect.detect_tiny(df.where("series <> 'flow_9'"), both[1])[0].orderBy("ts").select("score_final", "leak_state").collect()
