"""Scalar helpers as column expressions."""

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.lit(-50.0), F.least(F.lit(50.0), x))))


def logit(p: Column) -> Column:
    q = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(q / (1 - q))


def cyclic(ts: str) -> dict[str, Column]:
    """Sine and cosine of hour of day (with minutes), day of week (Monday 0) and month; night is hours 0 to 5."""
    t = F.col(ts)
    turns = {"hour": (F.hour(t) + F.minute(t) / 60) / 24, "dow": F.weekday(t) / 7, "month": F.month(t) / 12}
    out = {f"{k}_{f.__name__}": f(x * (2 * math.pi)) for k, x in turns.items() for f in (F.sin, F.cos)}
    return out | {"is_night": (F.hour(t) < 6).cast("int")}


def safe_float(text: Column, default: float | None = None) -> Column:
    """A number, or the default where there is none (also for NaN and infinities)."""
    x = text.try_cast("double")
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(default).cast("double")).otherwise(x)
