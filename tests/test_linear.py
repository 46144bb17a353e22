"""Kept linear heads against plain NumPy."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telltale.operators import heads, linear
from telltale.sources import sinks
from telltale.streaming import detector, stateful


def plain_fit(z, y, v, penalty):
    """Weighted logistic regression with an intercept in the first column, by damped Newton steps."""
    b = np.zeros(z.shape[1])
    loss = lambda b: (v * (np.logaddexp(0, z @ b) - y * (z @ b))).sum() + 0.5 * (penalty * b * b).sum()
    for _ in range(200):
        q = 1 / (1 + np.exp(-z @ b))
        move = np.linalg.solve((z * (v * q * (1 - q))[:, None]).T @ z + np.diag(penalty), z.T @ (v * (q - y)) + penalty * b)
        while loss(b - move) > loss(b) + 1e-12:
            move = move / 2
        b = b - move
    return b


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(8)
    n = 1500
    t = pd.DataFrame({f"x{k}": rng.normal(k, 1 + k, n) for k in range(4)})
    t["flat"] = 7.0
    t["a.b"] = rng.exponential(2, n)
    t["w"] = rng.uniform(0.2, 3, n)
    t["leak"] = (t["x0"] + 0.5 * t["x1"] - 0.3 * t["a.b"] + rng.logistic(0, 1, n) > 1).astype(float)
    t["rare"] = (t["x3"] + rng.normal(0, 2, n) > 9).astype(float)
    t["always"], t["never"] = 1.0, 0.0
    t["part"] = rng.choice(["train", "cal"], n, p=[0.7, 0.3])
    t.loc[::97, "x2"] = np.nan
    return t, spark.createDataFrame(t).repartition(5)


NAMES = ["x0", "x1", "x2", "x3", "flat", "a.b"]


@pytest.mark.parametrize(("weight", "balanced", "hessians"), [(None, False, 64 << 20), ("w", True, 1)])
def test_folded_score_is_the_pipeline(spark, table, tmp_path, monkeypatch, weight, balanced, hessians):
    """Scaling, regression and calibration one after the other give what the folded, saved and reloaded table gives."""
    monkeypatch.setattr(linear, "HESSIANS", hessians)
    t, df = table
    train, cal = df.where("part = 'train'"), df.where("part = 'cal'")
    labels = ["leak", "rare", "always", "never"]
    made = linear.fit(train, NAMES, labels, weight, balanced, cal)
    linear.keep(made, f"file://{tmp_path}/heads")
    back = linear.kept(spark, f"file://{tmp_path}/heads")
    got = linear.score(df, back).toPandas().sort_values(["x0", "x1"])
    plain = t.sort_values(["x0", "x1"])
    x = plain[NAMES].fillna(0).to_numpy()
    fitted = (plain["part"] == "train").to_numpy()
    mean, sd = x[fitted].mean(0), x[fitted].std(0)
    z = np.column_stack([np.ones(len(x)), (x - mean) / np.where(sd > 0, sd, 1)])
    for label in ("leak", "rare"):
        y = plain[label].to_numpy()
        v = plain["w"].to_numpy() if weight else np.ones(len(y))
        if balanced:
            n, hits = fitted.sum(), y[fitted].sum()
            v = v * np.where(y > 0, n / (2 * hits), n / (2 * (n - hits)))
        odds = z @ plain_fit(z[fitted], y[fitted], v[fitted], np.ones(z.shape[1]))
        c = plain_fit(np.column_stack([np.ones((~fitted).sum()), odds[~fitted]]), y[~fitted], np.ones((~fitted).sum()), np.array([0.0, 1.0]))
        want = 1 / (1 + np.exp(-(c[0] + c[1] * odds)))
        assert np.abs(got[f"p_{label}"].to_numpy() - want).max() < 1e-7
        # the table itself against its own unfolded form
        names, weights, b = linear.coefficients(back)[label]
        assert sorted(NAMES) == names
        again = 1 / (1 + np.exp(-(b + plain[names].fillna(0).to_numpy() @ np.array(weights))))
        assert np.abs(got[f"p_{label}"].to_numpy() - again).max() < 1e-12
    assert (got["p_always"] > 1 - 1e-9).all() and (got["p_never"] < 1e-9).all()


def test_kept_head_on_a_stream_and_in_a_header(spark, table, tmp_path):
    t, df = table
    made = linear.fit(df, NAMES, ["leak"])
    df.coalesce(2).write.parquet(f"file://{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"file://{tmp_path}/in")
    detector.run(linear.score(stream, made), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    key = ["x0", "x1"]
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas().sort_values(key)["p_leak"].to_numpy()
    assert np.array_equal(got, linear.score(df, made).toPandas().sort_values(key)["p_leak"].to_numpy())
    names, weights, b = linear.coefficients(made)["leak"]
    head = sinks.stage2_header(linear.coefficients(made))
    assert f"leak_w[{len(names)}]" in head and f"leak_b = {b:.9g}f" in head
    plain = linear.fit(df, ["x0", "x1"], ["leak"])
    feats = df.withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id() % 1000))
    names, weights, b = linear.coefficients(plain)["leak"]
    asked = stateful.at_triggers(feats.select("ts").limit(3).distinct(), feats, dict(zip(names, weights, strict=True)), b)
    scored = linear.score(asked, plain)
    assert scored.count() >= 3 and scored.where(F.abs(F.col("p") - F.col("p_leak")) > 1e-9).count() == 0


def test_odd_tables(spark, table):
    """No rows, one row, missing labels and no features."""
    _, df = table
    none = df.where("false")
    assert [r["p_leak"] < 1e-9 for r in linear.score(df.limit(2), linear.fit(none, NAMES, ["leak"])).collect()] == [True, True]
    one = df.where("leak = 1").limit(1)
    assert linear.score(one, linear.fit(one, NAMES, ["leak"])).first()["p_leak"] > 1 - 1e-9
    gaps = df.withColumn("leak", F.when(F.col("leak") == 1, 1.0))
    (_, one, b), (_, two, c) = (linear.coefficients(linear.fit(d, ["x0"], ["leak"]))["leak"] for d in (df, gaps))
    assert [*one, b] == pytest.approx([*two, c], abs=1e-9)
    with pytest.raises(ValueError, match="features"):
        linear.fit(df, [], ["leak"])
    both = heads.one_versus_rest(df, df, ["x0", "x1"], ["leak", "rare"], "w")
    assert {"p_leak", "p_rare"} <= set(both.columns) and both.where("(p_leak > 0.5) = (leak = 1)").count() > 0.6 * df.count()
