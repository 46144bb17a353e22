"""Evaluation: confusion and rates, threshold search, ranking metrics, calibration."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators.ranks import running_sums


def confusion(df: DataFrame, truth: str, call: str, keys=(), empty: float | None = 0.0) -> DataFrame:
    """tp, fp, fn, tn and rates of 0/1 columns; an empty denominator gives `empty` (None: null)."""
    y, p = F.col(truth) == 1, F.col(call) == 1
    c = df.groupBy(*keys).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"), F.count("*").alias("n"))
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(empty).cast("double"))
    x = {k: F.col(k).cast("double") for k in ("tp", "fp", "fn", "tn", "n")}
    return c.select("*", rate(x["tp"], x["tp"] + x["fn"]).alias("recall"), rate(x["tp"], x["tp"] + x["fp"]).alias("precision"), rate(x["fp"], x["fp"] + x["tn"]).alias("fpr"), rate(x["tp"] + x["fp"], x["n"]).alias("active"), rate(x["tp"] + x["fn"], x["n"]).alias("positive"))


def by_threshold(df: DataFrame, score: str, truth: str, key: str) -> DataFrame:
    """For each distinct score of a group: cumulative tp and n of rows at or above it, and the group's positives."""
    g = df.groupBy(key, F.col(score).alias("threshold")).agg(F.sum(truth).alias("y"), F.count("*").alias("c"))
    t = running_sums(g, [key], "threshold", {"tp": "y", "n": "c"})
    return t.withColumnRenamed("tp_all", "pos").withColumnRenamed("n_all", "total")


def best_threshold(df: DataFrame, score: str, truth: str, key: str, min_recall: float = 0.95) -> DataFrame:
    """Of thresholds with enough recall the one of greatest precision, then F1, then the greatest."""
    t = by_threshold(df, score, truth, key).where("pos > 0")
    t = t.withColumn("recall", F.col("tp") / F.col("pos")).withColumn("precision", F.col("tp") / F.col("n"))
    t = t.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0))).where(F.col("recall") >= min_recall)
    best = F.max(F.struct("precision", "f1", "threshold", "recall")).alias("b")
    return t.groupBy(key).agg(best).select(key, "b.threshold", "b.precision", "b.recall", "b.f1")


def ranking(df: DataFrame, score: str, truth: str, key: str) -> DataFrame:
    """Average precision (ties together), ROC area and Brier score; the ranking metrics are null for one class."""
    t = by_threshold(df, score, truth, key)
    neg = F.col("total") - F.col("pos")
    area = F.sum((F.col("tp") - F.col("y") / 2) * (F.col("c") - F.col("y")))
    ap = F.sum(F.col("y") * F.col("tp") / F.col("n"))
    both = (F.first("pos") > 0) & (F.first("pos") < F.first("total"))
    m = t.groupBy(key).agg(F.when(both, F.try_divide(ap, F.first("pos"))).alias("average_precision"), F.when(both, F.try_divide(area, F.first("pos") * F.first(neg))).alias("roc_auc"))
    b = df.groupBy(key).agg(F.avg(F.pow(F.col(score) - F.col(truth), 2)).alias("brier"), F.count("*").alias("n"), F.avg(truth).alias("base_rate"))
    return m.join(b, key)


def recall_at_precision(df: DataFrame, score: str, truth: str, key: str, target: float) -> DataFrame:
    return recalls_at_precisions(df, score, truth, key, {"recall_at_precision": target})


def recalls_at_precisions(df: DataFrame, score: str, truth: str, key: str, targets: dict[str, float]) -> DataFrame:
    """key and, for each name, the greatest recall at that precision or more; all from one table of thresholds."""
    t = by_threshold(df, score, truth, key)
    ok = lambda target: F.when(F.col("tp") / F.col("n") >= target, F.col("tp") / F.col("pos"))
    return t.groupBy(key).agg(*[F.coalesce(F.max(ok(target)), F.lit(0.0)).alias(name) for name, target in targets.items()])


def quantile_edges(df: DataFrame, score: str, parts: int, most: int = 10_000) -> list[float]:
    """Exact quantiles at 1/parts, 2/parts and so on (linear between neighbours), without all values in one buffer.

    Approximate quantiles a little below and above bound where each lies, again among what they leave, until at most
    `most` values are between (or all of them are equal); only these are looked at, of the others only the number counts.
    """
    v = F.col(score).cast("double")
    known = df.where(v.isNotNull())
    n = known.count()
    if not n:
        return []
    ranks = [k / parts * (n - 1) for k in range(1, parts)]
    low, high, below, between = [float("-inf")] * len(ranks), [float("inf")] * len(ranks), [0] * len(ranks), [n] * len(ranks)
    while wide := [i for i in range(len(ranks)) if between[i] > most and low[i] < high[i]]:
        ask = []
        for i in wide:
            place = (ranks[i] - below[i]) / between[i]
            ask.append(F.percentile_approx(F.when(v.between(low[i], high[i]), v), F.array(F.lit(max(0.0, place - 0.005)), F.lit(min(1.0, place + 0.005))), F.lit(1000)))
        for i, (a, b) in zip(wide, known.agg(*[x.alias(f"e{k}") for k, x in enumerate(ask)]).first(), strict=True):
            low[i], high[i] = a, b
        told = known.agg(*[x.alias(f"c{k}") for k, x in enumerate(y for i in wide for y in (F.count_if(v < low[i]), F.count_if(v.between(low[i], high[i]))))]).first()
        for k, i in enumerate(wide):
            below[i], between[i] = told[2 * k], told[2 * k + 1]
    few = known.agg(*[F.array_sort(F.collect_list(F.when(v.between(low[i], high[i]), v)) if low[i] < high[i] else F.array(F.lit(low[i]))).alias(f"v{i}") for i in range(len(ranks))]).first()
    out = []
    for i, rank in enumerate(ranks):
        inside = few[f"v{i}"]
        a, b = (inside[min(max(int(rank) + d - below[i], 0), len(inside) - 1)] for d in (0, 1))
        out.append(a + (b - a) * (rank - int(rank)))
    return out


def calibration(df: DataFrame, score: str, truth: str, bins: int = 10) -> DataFrame:
    """Mean score and rate of truth in bins between exact quantiles."""
    edges = quantile_edges(df, score, bins)
    b = sum(((F.col(score) >= F.lit(e)).cast("int") for e in edges), F.lit(0))
    return df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(score).alias("mean_score"), F.avg(truth).alias("rate"))


def localisation(df: DataFrame, key: str, cls: str, p: str, truth: str) -> DataFrame:
    """One row over (key, class, p, truth 0/1): macro F1 at 0.5 over classes with rows, mean average precision over classes that have both kinds, hit rates of the top 1 and 3.

    Rows (keys) without a true class count for no hit rate.
    """
    called, true = F.col(p) >= 0.5, F.col(truth) == 1
    per = df.groupBy(cls).agg(F.count_if(called & true).alias("tp"), F.count_if(called & ~true).alias("fp"), F.count_if(~called & true).alias("fn"))
    f1 = per.agg(F.avg(F.coalesce(F.try_divide(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))).alias("macro_f1"))
    ap = ranking(df, p, truth, cls).agg(F.avg("average_precision").alias("mean_average_precision"))
    first = Window.partitionBy(key).orderBy(F.col(p).desc(), cls)
    k = df.withColumn("__k", F.row_number().over(first)).withColumn("__any", F.max(truth).over(Window.partitionBy(key))).where("__any = 1")
    n = F.count_distinct(key)
    hits = k.agg(*[F.coalesce(F.try_divide(F.count_distinct(F.when(true & (F.col("__k") <= t), F.col(key))), n), F.lit(0.0)).alias(f"top{t}") for t in (1, 3)])
    return f1.join(F.broadcast(ap)).join(F.broadcast(hits))


def acceptance(df: DataFrame, call: str, negative: str, kind: str) -> DataFrame:
    """Share of calls among all packets, among the actual ones (not sampled) and among real hard negatives."""
    c = F.col(call).cast("double")
    return df.agg(F.avg(c).alias("accepted_all"), F.avg(F.when(F.col(negative) == 0, c)).alias("accepted_actual"), F.avg(F.when(F.col(kind) == "real_negative", c)).alias("accepted_real_negative"))


def per_calendar_day(df: DataFrame, ts: str) -> DataFrame:
    """d, n for each day from the first to the last, also for those without rows."""
    days = df.agg(F.explode(F.sequence(F.to_date(F.min(ts)), F.to_date(F.max(ts)))).alias("d"))
    return days.join(df.groupBy(F.to_date(ts).alias("d")).agg(F.count("*").alias("n")), "d", "left").na.fill(0, ["n"])


def group_importance(df: DataFrame, family: Column, importance: str) -> DataFrame:
    """Summed importance of each family of features."""
    return df.groupBy(family.alias("family")).agg(F.sum(importance).alias("importance"))
