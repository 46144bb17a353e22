"""Seasonal profiles: a robust location and scale for each series and slot of the week or day, and residuals."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAD = 1.4826


def slot(ts: str, mode: str) -> Column:
    """weekly_5min (2016 slots), weekly_hour (168), weekday (7), daily_hour (24) or none."""
    t = F.col(ts)
    day, hour = F.weekday(t), F.hour(t)
    return {"weekly_5min": F.floor((day * 1440 + hour * 60 + F.minute(t)) / 5), "weekly_hour": day * 24 + hour, "weekday": day, "daily_hour": hour, "none": F.lit(0)}[mode].cast("int")


def slots(mode: str) -> int:
    return {"weekly_5min": 2016, "weekly_hour": 168, "weekday": 7, "daily_hour": 24, "none": 1}[mode]


def robust_scale(df: DataFrame, keys: list[str], value: str = "value", floor: float | None = None) -> DataFrame:
    """keys, location (median), scale: 1.4826 * MAD; without spread max(std, 1), or with `floor` the std if it reaches it."""
    med = df.groupBy(*keys).agg(F.percentile(value, F.lit(0.5)).alias("location"), F.stddev_pop(value).alias("std"), F.count(value).alias("n"))
    mad = df.join(med, keys).groupBy(*keys).agg(F.percentile(F.abs(F.col(value) - F.col("location")), F.lit(0.5)).alias("mad"))
    spare = F.greatest("std", F.lit(1.0)) if floor is None else F.greatest("std", F.lit(floor))
    sigma = F.when(F.col("mad") * MAD > (1e-9 if floor is None else floor), F.col("mad") * MAD).otherwise(F.coalesce(spare, F.lit(1.0 if floor is None else floor)))
    return med.join(mad, keys).select(*keys, "location", sigma.alias("scale"), "n")


def profile(df: DataFrame, mode: str, value: str = "value", min_rows: int = 1) -> DataFrame:
    """series, slot, location, scale on the complete grid of slots.

    Slots without (at least min_rows) values take the location before them, else the next, else the series' median,
    and the series' overall scale; a slot without spread takes the overall scale too.
    """
    told = df.withColumn("slot", slot("ts", mode))
    local = told.groupBy("series", "slot").agg(F.percentile(value, F.lit(0.5)).alias("loc"), F.count(value).alias("n")).where(F.col("n") >= min_rows)
    mad = told.join(local, ["series", "slot"]).groupBy("series", "slot").agg(F.percentile(F.abs(F.col(value) - F.col("loc")), F.lit(0.5)).alias("mad"))
    overall = robust_scale(df, ["series"], value).select("series", F.col("location").alias("all_loc"), F.col("scale").alias("all_scale"))
    grid = overall.withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(slots(mode) - 1))))
    full = grid.join(local, ["series", "slot"], "left").join(mad, ["series", "slot"], "left")
    w = Window.partitionBy("series").orderBy("slot")
    before = F.last("loc", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("loc", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    scale = F.when(F.col("mad") > 0, F.col("mad") * MAD).otherwise(F.col("all_scale"))
    return full.select("series", "slot", F.coalesce("loc", before, after, "all_loc").alias("location"), scale.alias("scale"))


def residuals(df: DataFrame, seasonal: DataFrame, mode: str, value: str = "value") -> DataFrame:
    """Adds slot, location, scale and resid. The profile has a row for each series and slot; Spark picks the join by its size."""
    return df.withColumn("slot", slot("ts", mode)).join(seasonal, ["series", "slot"], "left").withColumn("resid", F.col(value) - F.col("location"))
