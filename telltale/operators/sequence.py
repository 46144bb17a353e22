"""Causal sequence operators on a long panel (series, ts, value): smoothing, lags, recurrences, votes, runs and peaks.

Every window is partitioned by the keys, so series are worked on in parallel. Nulls are skipped by the statistics.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KEYS = ("series",)


def ordered(keys=KEYS):
    return Window.partitionBy(*keys).orderBy("ts")


def causal_median(df: DataFrame, window: int = 3, value: str = "value", keys=KEYS, out: str = "smooth") -> DataFrame:
    """Median of the last `window` rows (fewer at the start), nulls skipped."""
    return df.withColumn(out, F.percentile(value, F.lit(0.5)).over(ordered(keys).rowsBetween(1 - window, 0)))


def lag_difference(df: DataFrame, rows: int, value: str = "value", keys=KEYS, out: str = "diff") -> DataFrame:
    return df.withColumn(out, F.col(value) - F.lag(value, rows).over(ordered(keys)))


def time_lag_difference(df: DataFrame, interval: str, value: str = "value", keys=KEYS, out: str = "diff") -> DataFrame:
    """Difference to the row exactly `interval` earlier, whatever gaps lie between."""
    past = df.select(*keys, (F.col("ts") + F.expr(f"INTERVAL {interval}")).alias("ts"), F.col(value).alias("__past"))
    return df.join(past, [*keys, "ts"], "left").withColumn(out, F.col(value) - F.col("__past")).drop("__past")


def time_mean(df: DataFrame, seconds: int, value: str = "value", keys=KEYS, out: str = "mean") -> DataFrame:
    """Mean and sample deviation over (ts - seconds, ts]: open on the left."""
    w = Window.partitionBy(*keys).orderBy(F.unix_seconds(F.col("ts").cast("timestamp"))).rangeBetween(1 - seconds, 0)
    return df.withColumn(out, F.avg(value).over(w)).withColumn(f"{out}_std", F.stddev_samp(value).over(w))


def in_blocks(df: DataFrame, decay: float, keys=KEYS) -> tuple[DataFrame, Column]:
    """Adds `__block` and `__k` (place in it, from 0), with blocks so long that what lies a block back has decayed below double precision; and decay ** __k.

    Without a decay a series is one block.
    """
    rows = math.ceil(40 / -math.log10(decay)) if 0 < decay < 1 else 1 if decay <= 0 else 1 << 62
    place = F.row_number().over(ordered(keys)) - 1
    out = df.withColumn("__k", place.cast("long")).withColumn("__block", F.floor(F.col("__k") / rows)).withColumn("__k", F.col("__k") - F.col("__block") * rows)
    return out, F.pow(F.lit(float(decay)), F.col("__k").cast("double"))


def last_of_block_before(df: DataFrame, columns: dict[str, Column], keys=KEYS) -> DataFrame:
    """Adds to each row what `columns` are at the last row of the block before (null in the first)."""
    ends = df.groupBy(*keys, (F.col("__block") + 1).alias("__block")).agg(*[F.max_by(c, "__k").alias(n) for n, c in columns.items()])
    return df.join(ends, [*keys, "__block"], "left")


def ewma(df: DataFrame, alpha: float = 0.15, value: str = "value", keys=KEYS, out: str = "ewma") -> DataFrame:
    """y0 = x0, then alpha * x + (1 - alpha) * y; null counts as 0. All rows count, however small alpha is.

    In a block y is decay ** k * (sum of x_j * weight_j / decay ** j), a running sum; the block before adds its last y.
    """
    told, power = in_blocks(df, 1 - alpha, keys)
    if alpha >= 1:
        return df.withColumn(out, F.coalesce(F.col(value), F.lit(0.0)))
    weight = F.when((F.col("__k") == 0) & (F.col("__block") == 0), 1.0).otherwise(alpha)
    inside = Window.partitionBy(*keys, "__block").orderBy("__k")
    told = told.withColumn("__y", F.sum(F.coalesce(F.col(value), F.lit(0.0)) * weight / power).over(inside) * power)
    told = last_of_block_before(told, {"__last": F.col("__y")}, keys)
    return told.select(*df.columns, (F.col("__y") + F.coalesce("__last", F.lit(0.0)) * power * (1 - alpha)).alias(out))


def ewma_known(df: DataFrame, alpha: float = 0.15, value: str = "value", keys=KEYS, out: str = "ewma") -> DataFrame:
    """The same over the known values: it starts at the first, and after g nulls what was before weighs (1 - alpha) ** (g + 1) against alpha. Null before the first value, else carried on where the value is null.

    With a_i the share of what was before, y is P_i * (sum of (1 - a_j) * x_j / P_j), P being the product of all a so
    far. Blocks end where P has fallen by 40 powers of ten, and each adds the last y of the block before.
    """
    told = df.withColumn("__i", F.row_number().over(ordered(keys)))
    known = told.where(F.col(value).isNotNull()).select(*keys, "__i", F.col(value).alias("__x"))
    w = Window.partitionBy(*keys).orderBy("__i")
    old = F.pow(F.lit(1.0 - alpha), (F.col("__i") - F.lag("__i").over(w)).cast("double"))
    known = known.withColumn("__a", F.greatest(old / (old + alpha), F.lit(1e-300)))
    known = known.withColumn("__l", F.sum(F.coalesce(-F.log10("__a"), F.lit(0.0))).over(w)).withColumn("__block", F.floor(F.col("__l") / 40))
    inside = Window.partitionBy(*keys, "__block").orderBy("__i")
    power = F.pow(F.lit(10.0), F.col("__block") * 40 - F.col("__l"))
    known = known.withColumn("__y", F.sum((1 - F.coalesce("__a", F.lit(0.0))) * F.col("__x") / power).over(inside) * power)
    ends = known.groupBy(*keys, (F.col("__block") + 1).alias("__block")).agg(F.max_by("__y", "__i").alias("__last"), F.max("__l").alias("__ended"))
    known = known.join(ends, [*keys, "__block"], "left")
    y = F.col("__y") + F.coalesce(F.col("__last") * F.pow(F.lit(10.0), F.col("__ended") - F.col("__l")), F.lit(0.0))
    both = told.join(known.select(*keys, "__i", y.alias("__y")), [*keys, "__i"], "left")
    return both.withColumn(out, F.last("__y", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("__i"))).select(*df.columns, out)


def cusum(df: DataFrame, allowance: float = 0.5, decay: float = 0.85, skip_first: bool = True, value: str = "value", keys=KEYS, out: str = "cusum") -> DataFrame:
    """c = max(0, decay * c + x - allowance) from 0; skip_first leaves the first row at 0 whatever its value. All rows count.

    With T the running sum of (x_j - allowance) / decay ** j, c is decay ** k * (T - least T so far), where 0 stands for
    the start: windows, no loop. Across blocks c is the greater of that and what the block before leaves.
    """
    told, power = in_blocks(df, decay, keys)
    first = (F.col("__k") == 0) & (F.col("__block") == 0)
    step = F.coalesce(F.col(value), F.lit(0.0)) - F.lit(allowance)
    inside = Window.partitionBy(*keys, "__block").orderBy("__k")
    # the start of a series is a 0 that nothing lies before
    told = told.withColumn("__t", F.sum((F.when(first, 0.0).otherwise(step) if skip_first else step) / power).over(inside))
    told = told.withColumn("__low", F.min("__t").over(inside))
    told = told.withColumn("__s", F.col("__t") * power).withColumn("__p", (F.col("__t") - F.col("__low")) * power)
    told = last_of_block_before(told, {"__before": F.greatest("__p", "__s")}, keys)
    carried = F.coalesce("__before", F.lit(0.0)) * power * decay + F.col("__s")
    return told.select(*df.columns, F.greatest("__p", carried).alias(out))


def rolling_vote(df: DataFrame, flag: Column, window: int, needed: int, keys=KEYS, out: str = "vote") -> DataFrame:
    """1 where at least `needed` of the last `window` rows have the flag."""
    return df.withColumn(out, (F.sum(F.coalesce(flag, F.lit(False)).cast("int")).over(ordered(keys).rowsBetween(1 - window, 0)) >= needed).cast("int"))


def run_numbers(df: DataFrame, flag: str, keys=KEYS) -> DataFrame:
    """Adds `run`: the number of the maximal stretch of equal flags that a row is in."""
    w = ordered(keys)
    change = F.coalesce((F.col(flag) != F.lag(flag).over(w)).cast("int"), F.lit(0))
    return df.withColumn("__change", change).withColumn("run", F.sum("__change").over(w)).drop("__change")


def islands(df: DataFrame, flag: str, min_rows: int = 1, pad_seconds: tuple[int, int] = (0, 0), keys=KEYS) -> DataFrame:
    """Closed intervals of the maximal runs of flag = 1 of at least min_rows rows, padded; overlaps stay separate."""
    shift = lambda c, s: F.timestamp_seconds(F.unix_seconds(c.cast("timestamp")) + s).cast("timestamp_ntz")
    marked = run_numbers(df.withColumn("__flag", F.coalesce(F.col(flag).cast("int"), F.lit(0))), "__flag", keys).where("__flag = 1")
    runs = marked.groupBy(*keys, "run").agg(F.min("ts").alias("a"), F.max("ts").alias("b"), F.count("*").alias("n_rows")).where(F.col("n_rows") >= min_rows)
    return runs.select(*keys, shift(F.col("a"), -pad_seconds[0]).alias("start_ts"), shift(F.col("b"), pad_seconds[1]).alias("end_ts"), "n_rows")


def merge_gaps(df: DataFrame, flag: str, max_gap: int, keys=KEYS, out: str = "merged") -> DataFrame:
    """Inner runs of 0 of at most max_gap rows become 1; runs at either end stay."""
    runs = run_numbers(df, flag, keys)
    inside = Window.partitionBy(*keys, "run")
    ends = Window.partitionBy(*keys)
    fill = (F.col(flag) == 0) & (F.count("*").over(inside) <= max_gap) & (F.col("run") > 0) & (F.col("run") < F.max("run").over(ends))
    return runs.withColumn(out, F.when(fill, 1).otherwise(F.col(flag))).drop("run")


def event_ids(df: DataFrame, flag: str, keys=KEYS, out: str = "event_id") -> DataFrame:
    """Number of the rising edge that a row's active stretch began with, 0 where inactive."""
    w = ordered(keys)
    rise = ((F.col(flag) == 1) & (F.coalesce(F.lag(flag).over(w), F.lit(0)) == 0)).cast("int")
    return df.withColumn("__rise", rise).withColumn(out, F.when(F.col(flag) == 1, F.sum("__rise").over(w)).otherwise(0)).drop("__rise")


def local_peaks(df: DataFrame, half: int = 3, slack: float = 1e-12, value: str = "value", keys=KEYS, out: str = "is_peak") -> DataFrame:
    return df.withColumn(out, F.col(value) >= F.max(value).over(ordered(keys).rowsBetween(-half, half)) - F.lit(slack))


def rolling_levels(df: DataFrame, windows: tuple[int, ...] = (12, 72), value: str = "value", keys=KEYS) -> DataFrame:
    """Means of the last 12 and 72 rows (fewer at the start): mean_<rows>."""
    return df.select("*", *[F.avg(value).over(ordered(keys).rowsBetween(1 - n, 0)).alias(f"mean_{n}") for n in windows])


def standardised(df: DataFrame, value: str = "value", keys=KEYS, out: str = "z") -> DataFrame:
    """(x - mean) / sample deviation of the series; null where there is no spread."""
    w = Window.partitionBy(*keys)
    return df.withColumn(out, F.try_divide(F.col(value) - F.avg(value).over(w), F.stddev_samp(value).over(w)))


def trailing_stats(df: DataFrame, rows: int, value: str = "value", keys=KEYS, dx: float = 1.0) -> DataFrame:
    """Eleven statistics of the last `rows` rows: last, mean, std, min, max, median, q10, q90, slope, delta, auc."""
    w = ordered(keys)
    f = w.rowsBetween(1 - rows, 0)
    v = F.col(value)
    base = df.withColumn("__i", F.row_number().over(w).cast("double")).withColumn("__pair", (v + F.lag(value).over(w)) / 2 * F.lit(dx))
    inner = w.rowsBetween(2 - rows, 0)  # the first pair of a frame reaches outside it
    first = F.first(value).over(f)
    pairs = F.sum("__pair").over(inner) if rows > 1 else F.lit(0.0)
    return base.select(
        *df.columns, v.alias("last"), F.avg(v).over(f).alias("mean"), F.stddev_pop(v).over(f).alias("std"), F.min(v).over(f).alias("min"), F.max(v).over(f).alias("max"),
        *[F.percentile(v, F.lit(q)).over(f).alias(n) for n, q in (("median", 0.5), ("q10", 0.1), ("q90", 0.9))], F.coalesce(F.regr_slope(v, F.col("__i")).over(f), F.lit(0.0)).alias("slope"), (v - first).alias("delta"), F.coalesce(pairs, F.lit(0.0)).alias("auc"),
    )


def running_context(df: DataFrame, value: str, keys) -> DataFrame:
    """Running count, maximum and mean in each group, in order of time."""
    w = ordered(keys).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("n_so_far", F.count("*").over(w)).withColumn("max_so_far", F.max(value).over(w)).withColumn("mean_so_far", F.avg(value).over(w))


def order_context(df: DataFrame, keys) -> DataFrame:
    """Position in the group and minutes since the row before (-1 for the first)."""
    w = ordered(keys)
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 60e6
    return df.withColumn("trigger_order", F.row_number().over(w)).withColumn("prior", F.col("trigger_order") - 1).withColumn("minutes_since", F.coalesce(gap, F.lit(-1.0)))
