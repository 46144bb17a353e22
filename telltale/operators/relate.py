"""Relations between series: correlations, centrality, pairwise and robust regressions, and interval joins."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators import robust, seasonal
from telltale.scratch import Scratch


def paired(panel: DataFrame) -> DataFrame:
    """ts, a, b, x, y for every ordered pair of different series at the same time."""
    a = panel.select("ts", F.col("series").alias("a"), F.col("value").alias("x"))
    b = panel.select("ts", F.col("series").alias("b"), F.col("value").alias("y"))
    return a.join(b, "ts").where("a <> b")


def correlations(panel: DataFrame) -> DataFrame:
    """a, b, r: null counts as 0, no spread gives 0."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    p = paired(panel).groupBy("a", "b").agg(F.corr(zero("x"), zero("y")).alias("r"))
    return p.withColumn("r", F.coalesce(F.nanvl("r", F.lit(0.0)), F.lit(0.0)))


def centrality(panel: DataFrame) -> DataFrame:
    """Mean absolute correlation with the other series (divided by the number of series)."""
    n = panel.agg(F.count_distinct("series").alias("n"))
    return correlations(panel).groupBy("a").agg(F.sum(F.abs("r")).alias("s")).join(F.broadcast(n)).select(F.col("a").alias("series"), (F.col("s") / F.col("n")).alias("centrality"))


def top_anchors(panel: DataFrame, k: int) -> DataFrame:
    """a, b, r, rank: the k series that each is most correlated with, either way."""
    w = Window.partitionBy("a").orderBy(F.abs("r").desc(), "b")
    return correlations(panel).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ridge_lines(panel: DataFrame, penalty: float = 1e-3, least: int = 8) -> DataFrame:
    """target, anchor, slope, intercept of target on anchor: one grouped aggregation of moments."""
    ok = F.col("x").isNotNull() & F.col("y").isNotNull()
    m = paired(panel).where(ok).groupBy(F.col("a").alias("target"), F.col("b").alias("anchor")).agg(F.count("*").alias("n"), F.covar_pop("x", "y").alias("c"), F.var_pop("y").alias("v"), F.avg("x").alias("mx"), F.avg("y").alias("my"))
    slope = F.col("c") * F.col("n") / (F.col("v") * F.col("n") + F.lit(penalty))
    return m.where(F.col("n") >= least).select("target", "anchor", "n", slope.alias("slope"), (F.col("mx") - slope * F.col("my")).alias("intercept"))


def over_anchors(df: DataFrame, value: Column, keys: list[str], how: str, out: str) -> DataFrame:
    """What a target's anchors say together at each time: their `median` (the full detector) or `mean` (the compact one)."""
    told = {"median": F.percentile(value, F.lit(0.5)), "mean": F.avg(value)}[how]
    return df.groupBy(*keys).agg(told.alias(out))


def robust_models(panel: DataFrame, features: DataFrame, delta: float = 1.5, ridge: float = 1e-3, steps: int = 30, trim: float = 0.97, broadcast_bytes: int = robust.BROADCAST_BYTES) -> DataFrame:
    """model, target, features, center, scale, beta (intercept first), sigma: trimmed Huber regressions of each model's target on its features.

    features: (model, target, feature). Rows with a null are left out; features are centred by their median and scaled
    robustly. The fit is repeated on the rows whose residual is within the trim quantile. Models without complete rows
    predict the target's median, with its robust scale. A table of broadcast_bytes at most (a matrix of times and
    series) is broadcast and its models are dealt over tasks; a larger one is passed over step by step.
    """
    scratch = Scratch(panel.sparkSession)
    features = scratch.cut(features)
    fitted = robust.fitted(panel.select("ts", "series", "value"), features, delta, ridge, steps, trim, broadcast_bytes)
    names = features.groupBy("model", "target").agg(F.array_sort(F.collect_list("feature")).alias("all"))
    plain = seasonal.robust_scale(panel, ["series"]).select(F.col("series").alias("target"), "location", F.col("scale").alias("spread"))
    none = lambda x: F.transform("all", lambda _: F.lit(x))
    whole = names.join(fitted, "model", "left").join(plain, "target", "left")
    return whole.select(
        "model", "target", F.coalesce("features", "all").alias("features"), F.coalesce("center", none(0.0)).alias("center"), F.coalesce("scale", none(1.0)).alias("scale"),
        F.coalesce("beta", F.concat(F.array(F.coalesce("location", F.lit(0.0))), none(0.0))).alias("beta"), F.coalesce("sigma", "spread", F.lit(1.0)).alias("sigma"),
    )


def model_residuals(panel: DataFrame, models: DataFrame) -> DataFrame:
    """model, target, ts, resid (null where the target is), sigma. A missing feature counts as its centre."""
    return robust.residuals(panel, models)


def in_intervals(df: DataFrame, intervals: DataFrame, outside: bool = False, bucket_s: int = 86_400) -> DataFrame:
    """Rows whose ts lies in a closed interval (start_ts, end_ts), or outside all of them.

    An equality on the day makes it a hash join: intervals are dealt to each day that they touch.
    """
    day = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_s)
    spans = intervals.select("start_ts", "end_ts", F.explode(F.sequence(day("start_ts"), day("end_ts"))).alias("__day"))
    marked = df.withColumn("__d", day("ts"))
    return marked.join(spans, (F.col("__d") == F.col("__day")) & F.col("ts").between(F.col("start_ts"), F.col("end_ts")), "left_anti" if outside else "left_semi").drop("__d")


def overlapped(truth: DataFrame, found: DataFrame, bucket_s: int = 30 * 86_400) -> DataFrame:
    """Truth intervals that any found interval overlaps, by shared buckets of time."""
    bucket = lambda c: F.floor(F.unix_seconds(F.col(c).cast("timestamp")) / bucket_s)
    f = found.select(F.col("start_ts").alias("__s"), F.col("end_ts").alias("__e"), F.explode(F.sequence(bucket("start_ts"), bucket("end_ts"))).alias("__b"))
    t = truth.withColumn("__k", F.explode(F.sequence(bucket("start_ts"), bucket("end_ts"))))
    return t.join(f, (F.col("__k") == F.col("__b")) & (F.col("__s") <= F.col("end_ts")) & (F.col("__e") >= F.col("start_ts")), "left_semi").drop("__k").distinct()
