"""The second half of the compact detector on a stream: EWMA, CUSUM, hysteresis and the trigger clock as state of each network."""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from telltale.operators.scan import jaccard

STATE = "ewma double, cusum double, active int, quiet int, event_id long, seen long, since long, row long, names array<string>"
OUT = "network string, ts timestamp, ewma double, cusum double, state int, event_id long, reason string"


def follow(scores: DataFrame, alpha: float = 0.15, allowance: float = 0.5, decay: float = 0.85, start: float = 1.0, hold: float = 0.5, quiet: int = 3, recheck_s: int = 3600, min_shift_s: int = 600, likeness: float = 0.5) -> DataFrame:
    """scores (network, ts, value, names) as a stream to one row for each: EWMA and CUSUM of the value, state, event and trigger reason.

    The state is on from a CUSUM of `start` until `quiet` rows in a row are under `hold`. Rows of a trigger are taken in
    order of time, to the microsecond; one that is not newer than the last seen (a repeated or late row) is left out. All that is kept of a network is nine values.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        if state.exists:
            ewma, cusum, on, silent, event, seen, since, row, names = state.get
        else:
            ewma, cusum, on, silent, event, seen, since, row, names = None, 0.0, 0, 0, 0, -1, -1, 0, []
        out = []
        for ts, value, now in zip(rows["ts"], rows["value"], rows["names"], strict=True):
            at = int(ts.value // 1_000)
            if at <= seen:
                continue
            seen, x = at, 0.0 if pd.isna(value) else float(value)
            ewma = x if ewma is None else alpha * x + (1 - alpha) * ewma
            cusum = max(0.0, decay * cusum + x - allowance)
            if not on:
                if cusum >= start:
                    on, silent, event, since = 1, 0, event + 1, -1
            elif cusum >= hold:
                silent = 0
            else:
                silent += 1
                on = int(silent < quiet)
            reason, top = None, {n for n in now if n} if now is not None else set()
            if on:
                gap = (at - since) / 1_000_000
                if since < 0:
                    reason = "event_start"
                elif gap >= recheck_s:
                    reason = "periodic_recheck"
                elif gap >= min_shift_s and jaccard(top, set(names)) < likeness:
                    reason = "sensor_shift"
                if reason:
                    since, names = at, sorted(top)
            out.append((key[0], ts, ewma, cusum, on, event if on else 0, reason))
        state.update((ewma, cusum, on, silent, event, seen, since, row + len(out), list(names)))
        yield pd.DataFrame(out, columns=["network", "ts", "ewma", "cusum", "state", "event_id", "reason"])

    return scores.groupBy("network").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def at_triggers(triggers: DataFrame, features: DataFrame, weights: dict[str, float], intercept: float) -> DataFrame:
    """Second-stage probabilities, only for what a stream of triggers asks: joined to a table of features (ts and columns), scored by a linear head."""
    from pyspark.sql import functions as F

    from telltale.functions.scalar import sigmoid

    told = triggers.join(features, "ts")
    return told.withColumn("p", sigmoid(sum((F.col(c) * w for c, w in weights.items()), F.lit(float(intercept)))))
