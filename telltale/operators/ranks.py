"""Ranks in few groups of many rows: ranges of the order are counted first, so no task sorts a whole group."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges that each group is cut into. Their edges are approximate quantiles, which only have to be roughly even.
RANGES = 64


def numeric(df: DataFrame, column: str) -> Column:
    """A column as something to take quantiles of, in the same order."""
    kind = df.schema[column].dataType.typeName()
    return F.unix_micros(F.col(column).cast("timestamp")).cast("double") if kind.startswith("timestamp") else F.col(column).cast("double")


def in_ranges(df: DataFrame, keys: list[str], by: str, ranges: int = RANGES) -> DataFrame:
    """Adds `__range`, which grows with `by` in each group; equal values are in one range, nulls in the first."""
    edges = df.groupBy(*keys).agg(F.percentile_approx(numeric(df, by), F.array(*[F.lit(k / ranges) for k in range(1, ranges)]), F.lit(1000)).alias("__edges"))
    at = F.size(F.filter("__edges", lambda e: e < numeric(df, by)))
    edges = edges.select(*[F.col(k).alias(f"__{k}") for k in keys], "__edges")
    same = [df[k].eqNullSafe(edges[f"__{k}"]) for k in keys]
    on = same[0] if same else F.lit(True)
    for s in same[1:]:
        on = on & s
    return df.join(edges, on, "left").withColumn("__range", F.coalesce(F.greatest(at, F.lit(0)), F.lit(0))).drop("__edges", *[f"__{k}" for k in keys])


def ranked(df: DataFrame, keys: list[str], order: list[str], descending: bool = False) -> DataFrame:
    """Adds `rank` (from 1) and `group_rows` in each group by `order`; the first column of the order makes the ranges."""
    told = in_ranges(df, keys, order[0])
    told = told.withColumn("__range", -F.col("__range") if descending else F.col("__range"))
    sort = [F.col(c).desc_nulls_last() if descending else F.col(c).asc_nulls_first() for c in order]
    sizes = told.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    # a row for each group and range
    w = Window.partitionBy(*keys)
    before = sizes.withColumn("__before", F.sum("__n").over(w.orderBy("__range")) - F.col("__n")).withColumn("group_rows", F.sum("__n").over(w)).drop("__n")
    before = before.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), "__before", "group_rows")
    inner = told.withColumn("rank", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*sort)))
    on = inner["__range"] == before["__at"]
    for k in keys:
        on = on & inner[k].eqNullSafe(before[f"__{k}"])
    return inner.join(before, on).withColumn("rank", (F.col("rank") + F.col("__before")).cast("long")).drop("__range", "__at", "__before", *[f"__{k}" for k in keys])


def running_sums(df: DataFrame, keys: list[str], by: str, sums: dict[str, str]) -> DataFrame:
    """Adds running sums of columns (name to column) from the greatest `by` down to each row, and `<name>_all` over the group. One row for each value of `by`."""
    told = in_ranges(df, keys, by)
    totals = told.groupBy(*keys, "__range").agg(*[F.sum(c).alias(f"__{n}") for n, c in sums.items()])
    w = Window.partitionBy(*keys)
    above = totals.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__range").alias("__at"), *[(F.sum(f"__{n}").over(w.orderBy(F.desc("__range"))) - F.col(f"__{n}")).alias(f"__above_{n}") for n in sums], *[F.sum(f"__{n}").over(w).alias(f"{n}_all") for n in sums])
    on = told["__range"] == above["__at"]
    for k in keys:
        on = on & told[k].eqNullSafe(above[f"__{k}"])
    down = Window.partitionBy(*keys, "__range").orderBy(F.desc(by))
    own = told.select("*", *[F.sum(c).over(down).alias(f"__own_{n}") for n, c in sums.items()])
    out = own.join(above, on)
    return out.select(*df.columns, *[(F.col(f"__own_{n}") + F.col(f"__above_{n}")).alias(n) for n in sums], *[f"{n}_all" for n in sums])
