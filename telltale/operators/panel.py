"""Panels: raw rows regularised to (series, ts, value) on a complete time grid, and back to wide tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def regular(df: DataFrame, ts: str, series: str, value, unit: str, step: str) -> DataFrame:
    """value (an aggregate) by time step and series, with null where a step has no rows.

    The grid is made of the span of times (two values) and the series: as many rows as the result.
    """
    cells = df.groupBy(F.date_trunc(unit, ts).alias("t"), F.col(series).alias("series")).agg(value.alias("value"))
    span = df.agg(F.date_trunc(unit, F.min(ts)).alias("a"), F.date_trunc(unit, F.max(ts)).alias("b"))
    # the span is one row; each series makes its own times
    grid = df.select(F.col(series).alias("series")).distinct().join(F.broadcast(span)).select("series", F.explode(F.sequence("a", "b", F.expr(f"INTERVAL {step}"))).alias("t"))
    return grid.join(cells, ["t", "series"], "left").select("series", F.col("t").cast("timestamp_ntz").alias("ts"), "value")


def wide(panel: DataFrame, names: list[str]) -> DataFrame:
    return panel.groupBy("ts").pivot("series", names).agg(F.first("value"))


def long(table: DataFrame, ts: str, columns: list[str]) -> DataFrame:
    return table.unpivot([ts], columns, "series", "value").withColumnRenamed(ts, "ts")


def dedupe_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in a stated order."""
    from pyspark.sql import Window

    return df.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__n = 1").drop("__n")


def align(tables: list[DataFrame], key: str, how: str) -> DataFrame:
    """Joins tables on the key, left or full; an outer key is the first that is not null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.join(t, key, how)
    return out
