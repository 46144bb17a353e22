"""Cross-section scores: what all series say at one time."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, score: str) -> DataFrame:
    """Adds `rank` at each ts: greatest score first, then the name."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy("ts").orderBy(F.col(score).desc_nulls_last(), "series")))


def topk_mean(df: DataFrame, score: str, k: int, out: str = "topk") -> DataFrame:
    """Mean of the k greatest scores at each ts; null counts as 0."""
    r = ranked(df.withColumn(score, F.coalesce(F.col(score), F.lit(0.0))), score)
    return r.where(F.col("rank") <= k).groupBy("ts").agg(F.avg(score).alias(out))


def votes(df: DataFrame, flag: Column, out: str = "votes") -> DataFrame:
    return df.groupBy("ts").agg(F.count_if(flag).alias(out))


def top_series(df: DataFrame, score: str, k: int = 5, positive: bool = True) -> DataFrame:
    """ts, top: names of the k greatest scores in order."""
    r = ranked(df.where(F.col(score) > 0) if positive else df, score).where(F.col("rank") <= k)
    return r.groupBy("ts").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "series"))), lambda x: x["series"]).alias("top"))


def concentration(df: DataFrame, value: str = "value") -> DataFrame:
    """Total, mean, deviation, maximum, median, Herfindahl index and entropy of shares at each ts."""
    v = F.greatest(F.coalesce(F.col(value), F.lit(0.0)), F.lit(0.0))
    s, q = F.sum(v), F.sum(v * v)
    logs = F.sum(F.when(v > 0, v * F.ln(v)).otherwise(0.0))
    return df.groupBy("ts").agg(
        F.sum(value).alias("total"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"), F.max(value).alias("max"), F.percentile(value, F.lit(0.5)).alias("median"),
        F.coalesce(F.try_divide(q, s * s), F.lit(0.0)).alias("hhi"), F.coalesce(F.when(s > 0, F.ln(s) - logs / s), F.lit(0.0)).alias("entropy"),
    )
