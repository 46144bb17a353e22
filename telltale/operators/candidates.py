"""Compact configurations side by side: each is fitted, judged on a span of its own, and ranked."""

from dataclasses import replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators import detect
from telltale.operators.export import CANDIDATES, Candidate

#: What a device allows (fixed values): bytes of tables, calls of the second stage a day.
MOST_BYTES, MOST_CALLS = 256 * 1024, 3.0


def by_name(name: str) -> Candidate:
    for c in CANDIDATES:
        if c.name == name:
            return c
    raise KeyError(name)


def settings_of(c: Candidate, base: detect.Settings) -> detect.Settings:
    return replace(base, slots=c.baseline, monitored=c.sensors, pair_anchors=c.anchors)


def run_candidate(c: Candidate, train: DataFrame, test: DataFrame, truth: DataFrame, base: detect.Settings, leaks: DataFrame | None = None) -> DataFrame:
    """One row: name, recall, precision, fpr, calls_per_day, bytes (16-bit tables, pairs and scales), fits."""
    fitted = detect.fit_tiny(train, settings_of(c, base), leaks)
    results = detect.detect_tiny(test, fitted)[0]
    m = detect.evaluate(results, truth)
    calls = detect.trigger_rows(results, fitted.settings, True).agg(F.count("*").alias("calls"))
    days = results.agg((F.count("*") * base.step_s / 86400).alias("days"))
    rows = [t.agg((F.count("*") * n).alias(k)) for t, n, k in ((fitted.profile, 2, "a"), (fitted.models, 12, "b"), (fitted.scales, 4, "c"))]
    out = m.join(F.broadcast(calls)).join(F.broadcast(days))
    for r in rows:
        out = out.join(F.broadcast(r))  # one row each
    size = (F.col("a") + F.col("b") + F.col("c")).alias("bytes")
    rate = F.coalesce(F.try_divide(F.col("calls"), F.col("days")), F.lit(0.0))
    return out.select(F.lit(c.name).alias("name"), "recall", "precision", "fpr", rate.alias("calls_per_day"), size).withColumn("fits", (F.col("bytes") <= MOST_BYTES) & (F.col("calls_per_day") <= MOST_CALLS))


def reference_row(spark, figures: dict[str, float]) -> DataFrame:
    """The row of the detector that compact ones are compared with."""
    return spark.range(1).select(F.lit("reference").alias("name"), *[F.lit(float(figures.get(k, 0.0))).alias(k) for k in ("recall", "precision", "fpr", "calls_per_day")], F.lit(int(figures.get("bytes", 0))).cast("long").alias("bytes"), F.lit(False).alias("fits"))


def best_first(df: DataFrame) -> DataFrame:
    """Adds place, 1 for the best: those that fit first, then recall, precision, bytes and name. Figures are of validation, never of the final test."""
    return df.withColumn("place", F.row_number().over(Window.orderBy(F.desc("fits"), F.desc("recall"), F.desc("precision"), "bytes", "name")))  # a row for each candidate


def compare(train: DataFrame, test: DataFrame, truth: DataFrame, base: detect.Settings, leaks: DataFrame | None = None, figures: dict[str, float] | None = None, candidates=CANDIDATES) -> DataFrame:
    """All candidates and the reference, ranked."""
    out = reference_row(train.sparkSession, figures or {})
    for c in candidates:
        out = out.unionByName(run_candidate(c, train, test, truth, base, leaks))
    return best_first(out)
