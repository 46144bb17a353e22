"""Compact parameters for small devices: quantisation, C arrays and a model of memory."""

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def quantise(df: DataFrame, key: str, value: str) -> DataFrame:
    """Symmetric 16-bit: scale = max|x| / 32767 for each key (1 if all are 0), q = x / scale rounded half to even."""
    s = df.groupBy(key).agg((F.max(F.abs(value)) / 32767).alias("scale"))
    s = s.withColumn("scale", F.when(F.col("scale") > 0, F.col("scale")).otherwise(1.0))
    return df.join(s, key).withColumn("q", F.rint(F.col(value) / F.col("scale")).cast("smallint"))


def c_array(df: DataFrame, order: str, value: str, name: str, kind: str = "int16_t") -> DataFrame:
    """One row: a C initialiser. For parameter tables, which are small."""
    items = F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).alias("v")))), lambda x: x["v"].cast("string"))
    return df.agg(F.concat(F.lit(f"static const {kind} {name}["), F.count("*").cast("string"), F.lit("] = {"), F.array_join(items, ", "), F.lit("};")).alias("text"))


@dataclass(frozen=True)
class Candidate:
    """A configuration of the compact detector."""

    name: str
    baseline: str
    sensors: int
    anchors: int
    localiser: str
    features: str


#: The compact configurations that are compared (fixed values).
CANDIDATES = (
    Candidate("ultra_tiny_none_proto", "none", 6, 1, "prototype", "small"),
    Candidate("tiny_daily24_proto", "daily_hour", 6, 1, "prototype", "medium"),
    Candidate("tiny_weekly168_ovr", "weekly_hour", 8, 2, "ovr", "full"),
)
