"""Greedy peaks in blocks, vectors of long features, and importance from one table of copies."""

from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from telltale.operators import features, linear, metrics, state

START = datetime(2024, 1, 1)


def plain_peaks(rows, gap, limit):
    taken = []
    for at, v in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(taken) < limit and all(abs(at - t) >= gap for t in taken):
            taken.append(at)
    return sorted(taken)


@pytest.mark.parametrize("shape", ["noise", "rising", "ties"])
def test_peaks_in_blocks(spark, shape):
    """Blocks of four gaps: chains over many blocks, ties and gaps of exactly the least distance."""
    rng = np.random.default_rng(5)
    at = np.unique(rng.integers(0, 4000, 900))
    value = {"noise": rng.normal(size=len(at)), "rising": at.astype(float), "ties": rng.integers(0, 3, len(at)).astype(float)}[shape]
    df = spark.createDataFrame([("a", START + timedelta(seconds=int(t)), float(v)) for t, v in zip(at, value)] + [("b", START, 1.0), ("b", None, 9.0)], "series string, ts timestamp_ntz, value double").repartition(5)
    for limit in (7, 10_000):
        got = state.suppress_peaks(df, 10, limit, block_gaps=4).collect()
        mine = sorted(int((r["ts"] - START).total_seconds()) for r in got if r["series"] == "a")
        assert mine == plain_peaks(list(zip(at.tolist(), value.tolist())), 10, limit)
        assert sum(r["series"] == "b" for r in got) == 1


def test_no_peaks(spark):
    none = spark.createDataFrame([], "series string, ts timestamp_ntz, value double")
    assert state.suppress_peaks(none, 10, 5).isEmpty()


def test_vectors(spark):
    """Constant features go, one that a trigger lacks stays, NaN and missing ones get the median, unknown ones go nowhere."""
    rows = [(t, "b", float(t)) for t in (1, 2, 3)] + [(t, "same", 4.0) for t in (1, 2, 3)] + [(1, "a", 7.0), (2, "a", 7.0), (3, "b.c|x", float("nan")), (1, "b.c|x", 1.0), (2, "b.c|x", 5.0)]
    long = spark.createDataFrame(rows, "trigger int, feature string, value double").repartition(4)
    words = [(r["feature"], r["fill"]) for r in features.numbered(long, 3).orderBy("place").collect()]
    assert words == [("a", 7.0), ("b", 2.0), ("b.c|x", 3.0)]
    more = long.unionByName(spark.createDataFrame([(9, "other", 1.0)], long.schema))
    got = {r["trigger"]: r["x"] for r in features.vectors(more, words).collect()}
    assert got == {1: [7.0, 1.0, 1.0], 2: [7.0, 2.0, 5.0], 3: [7.0, 3.0, 3.0], 9: [7.0, 2.0, 3.0]}


def test_heads_on_vectors(spark):
    """An array of features gives the head, and the probabilities, that columns give."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(300, 3))
    y = (x @ [1.0, -2.0, 0.0] + rng.normal(size=300) > 0).astype(int)
    df = spark.createDataFrame([(*map(float, r), int(v)) for r, v in zip(x, y)], "a double, b double, c double, y int").withColumn("x", F.array("a", "b", "c"))
    names = ["a", "b", "c"]
    plain, vector = linear.fit(df, names, ["y"]), linear.fit(df, names, ["y"], vector="x")
    want = {(r["label"], r["feature"]): r["weight"] for r in plain.collect()}
    assert {(r["label"], r["feature"]): pytest.approx(r["weight"]) for r in vector.collect()} == want
    few = linear.strongest(df, names, ["y"], 2, "x")
    r = [abs(np.corrcoef(x[:, k], y)[0, 1]) for k in range(3)]
    assert few == [names[k] for k in sorted(np.argsort(r)[-2:])]
    head = linear.fit(df.select("a", "b", "y"), ["b", "a"], ["y"])
    both = linear.score(linear.score(df, head, "p_"), head, "q_", names, "x")
    assert both.where("abs(p_y - q_y) > 1e-12").isEmpty()


def test_importance_of_all_copies(spark):
    """A copy has the same values of each feature in another order; the feature that decides is the one that counts."""
    d = spark.createDataFrame([(float(k % 2), float(k * 7 % 13), k % 2) for k in range(400)], "a double, b double, y int").repartition(3)
    copies = features.dealt(d, ["a", "b"], 2)
    assert {r["copy"]: r["n"] for r in copies.groupBy("copy").agg(F.count("*").alias("n")).collect()} == {k: 400 for k in range(5)}
    sums = {(r["sa"], r["sb"], r["sy"]) for r in copies.groupBy("copy").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.sum("y").alias("sy")).collect()}
    assert len(sums) == 1
    metric = lambda t, copy: metrics.ranking(t, "p", "y", copy).select(copy, F.col("average_precision").alias("metric"))
    got = {r["feature"]: r["importance"] for r in features.permutation_importance(d, ["a", "b"], "y", lambda t: t.withColumn("p", F.col("a")), metric).collect()}
    assert got["a"] > 0.2 and got["b"] == pytest.approx(0.0)
