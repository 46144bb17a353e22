"""Data audit: what a panel or table holds, and whether it is complete."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def overview(df: DataFrame, ts: str, step_s: int, keys=()) -> DataFrame:
    """Rows, span, duplicate times, steps other than step_s, size of the full grid and whether it matches."""
    times = df.groupBy(*keys, ts).agg(F.count("*").alias("c"))
    gap = F.unix_seconds(F.col(ts).cast("timestamp")) - F.unix_seconds(F.lag(ts).over(Window.partitionBy(*keys).orderBy(ts)).cast("timestamp"))
    t = times.withColumn("gap", gap).groupBy(*keys).agg(F.sum("c").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"), F.sum(F.col("c") - 1).alias("duplicates"), F.count_if(F.col("gap") != step_s).alias("odd_gaps"), F.count("*").alias("n_times"))
    expected = F.floor((F.unix_seconds(F.col("last_ts").cast("timestamp")) - F.unix_seconds(F.col("first_ts").cast("timestamp"))) / step_s) + 1
    return t.withColumn("expected", expected).withColumn("complete", F.col("expected") == F.col("n_times"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """Count, nulls, distinct values, mean, sample deviation, minimum and maximum of each column."""
    return df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot([], columns, "name", "v").groupBy("name").agg(
        F.count("v").alias("n"), F.count_if(F.col("v").isNull()).alias("nulls"), F.count_distinct("v").alias("n_distinct"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))


def value_share(df: DataFrame, column: str) -> DataFrame:
    c = df.groupBy(column).agg(F.count("*").alias("n"))
    return c.join(F.broadcast(c.agg(F.sum("n").alias("all")))).select(column, "n", (F.col("n") * 100.0 / F.col("all")).alias("pct"))


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Equal bins between the least and the greatest value; the greatest falls in the last bin."""
    r = F.broadcast(df.agg(F.min(column).alias("lo"), F.max(column).alias("hi")))
    b = F.least(F.floor((F.col(column) - F.col("lo")) * bins / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))), F.lit(bins - 1))
    return df.where(F.col(column).isNotNull()).join(r).groupBy(F.coalesce(b, F.lit(0)).cast("long").alias("bin")).agg(F.count("*").alias("n"))


def binary_like(panel: DataFrame, edge: float = 0.15, share: float = 0.85, unique: float = 0.02, least: int = 100) -> DataFrame:
    """Which series switch between two levels: most values near an end of q05..q95, few distinct ones."""
    q = panel.where("value is not null").groupBy("series").agg(F.percentile("value", F.lit(0.05)).alias("lo"), F.percentile("value", F.lit(0.95)).alias("hi"))
    z = panel.where("value is not null").join(q, "series").withColumn("z", F.try_divide(F.col("value") - F.col("lo"), F.col("hi") - F.col("lo")))
    s = z.groupBy("series").agg(F.count("*").alias("n"), F.avg(((F.col("z") <= edge) | (F.col("z") >= 1 - edge)).cast("double")).alias("at_edges"), (F.count_distinct(F.round("value", 2)) / F.count("*")).alias("distinct_share"))
    return s.withColumn("switching", F.coalesce((F.col("n") >= least) & (F.col("at_edges") >= share) & (F.col("distinct_share") <= unique), F.lit(False)))


def binary_ends(df: DataFrame, decimals: int = 2) -> DataFrame:
    """series, n, at_ends (share of rows equal to the least or greatest value), distinct_share: what tells switches from measured flows, in its simple form."""
    ends = df.groupBy("series").agg(F.min("value").alias("lo"), F.max("value").alias("hi"), F.count("value").alias("n"), F.count_distinct(F.round("value", decimals)).alias("d"))
    at = (F.col("value") == F.col("lo")) | (F.col("value") == F.col("hi"))
    return df.join(ends, "series").groupBy("series").agg(F.first("n").alias("n"), F.avg(at.cast("double")).alias("at_ends"), (F.first("d") / F.first("n")).alias("distinct_share"))


def active_flows(flows: list[str], excluded: list[str], like_switches: DataFrame, at_ends: float = 0.85, distinct: float = 0.02) -> list[str]:
    """Flows that count: not in the given list, and not like switches (a table of binary_ends() or binary_like(); a flow that it lacks is left out)."""
    share = [c for c in like_switches.columns if c in ("at_ends", "at_edges")][0]
    ok = {r["series"] for r in like_switches.where(~((F.col(share) >= at_ends) & (F.col("distinct_share") <= distinct))).select("series").collect()}
    return [f for f in flows if f in ok and f not in set(excluded)]


def correlations_with(df: DataFrame, columns: list[str], target: str) -> DataFrame:
    """name, r: the correlation of each column with the target, in one pass."""
    row = df.agg(*[F.corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in columns])
    return row.unpivot([], columns, "name", "r")


def label_checks(df: DataFrame, same: list, classes: str, positive, ts: str) -> DataFrame:
    """One row: whether pairs of conditions agree in every row, how many classes there are, the first positive time, rows that are not positive."""
    return df.agg(*[F.bool_and(a == b).alias("same" if k == 0 else f"same_{k}") for k, (a, b) in enumerate(same)], F.count_distinct(classes).alias("classes"), F.min(F.when(positive, F.col(ts))).alias("first_positive"), F.count_if(~positive).alias("negatives"))


def run_lengths(df: DataFrame, flag: str, value: str = "value") -> DataFrame:
    """series, rows, top, start_ts of each run of flag = 1: its length and greatest value."""
    from telltale.operators.sequence import run_numbers

    return run_numbers(df, flag).where(F.col(flag) == 1).groupBy("series", "run").agg(F.count("*").alias("rows"), F.max(value).alias("top"), F.min("ts").alias("start_ts"))


def group_profile(df: DataFrame, columns: list[str], group: str) -> DataFrame:
    """Mean, sample deviation, minimum and maximum of each column in each group."""
    long = df.select(group, *[F.col(c).cast("double").alias(c) for c in columns]).unpivot([group], columns, "name", "v")
    return long.groupBy(group, "name").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"), F.min("v").alias("min"), F.max("v").alias("max"))
