"""The compact detector as one stream: late, shuffled and repeated readings in, states, events and trigger reasons out.

1. Readings meet the slot tables and scales of a fit (stream-static join), and each series keeps a median ring, a ring
   of residuals (slope) and an EWMA, in order of event time.
2. All sensors of a network and time meet in one row (as many entries as it has sensors); pairs, leading means, votes
   and names are array expressions.
3. Each network keeps CUSUM, votes, hysteresis, event number and trigger clock.

Results are those of `detect.detect_tiny` on the same rows, for all times that the watermark has passed.
"""

from collections.abc import Iterable
from functools import reduce
from statistics import median

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.operators import detect, seasonal
from telltale.operators.detect import Fitted, Settings
from telltale.operators.scan import jaccard
from telltale.streaming.ordered import InOrder, missing, prepare, run_in_order

NAN = float("nan")


class Sensor(InOrder):
    """A series' smoothed value and its own scores."""

    READS = "value double, location double, scale double"
    KEEPS = "ring array<double>, residuals array<double>, ewma double, n long"
    OUT = "network string, series string, kind string, ts timestamp, value double, pressure double, slope double, ewma double, flow double"

    def __init__(self, s: Settings):
        self.smooth, self.back, self.alpha = s.smooth, s.slope_rows, s.alpha

    def fresh(self) -> tuple:
        return [], [], 0.0, 0

    def step(self, kept, rows, key):
        ring, past, ewma, n = list(kept[0]), list(kept[1]), kept[2], kept[3]
        out = []
        for at, value, location, scale in rows:
            ring = [*ring, NAN if missing(value) else value][-self.smooth :]
            known = [v for v in ring if not missing(v)]
            smooth = median(known) if known else NAN
            resid, scale = smooth - location, max(scale, 1e-6)
            change = abs(resid - past[0]) / scale if len(past) == self.back else 0.0
            past = [*past, resid][-self.back :]
            pressure = 0.0 if missing(resid) else abs(resid) / scale
            ewma = pressure if n == 0 else self.alpha * pressure + (1 - self.alpha) * ewma
            n += 1
            out.append((at, smooth, pressure, 0.0 if missing(change) else change, ewma, 0.0 if missing(resid) else max(resid, 0.0) / scale))
        return (ring, past, ewma, n), out


class Network(InOrder):
    """A network's state, events and triggers from the scores of all sensors."""

    READS = "value double, score_incipient double, flow_topk double, votes long, top array<string>, burst double, incipient double, hold double, flow_hold double"
    KEEPS = "cusum double, bursts array<int>, incipients array<int>, active int, silent int, event_id long, clock long, since long, names array<string>"
    OUT = "network string, ts timestamp, burst_cusum double, score_incipient double, score_final double, votes long, leak_state int, event_id long, top array<string>, reason string"

    def __init__(self, s: Settings):
        self.s = s
        self.recheck, self.shift = (max(1, round(x / s.step_s)) for x in (s.recheck_h * 3600, s.shift_min * 60))

    def fresh(self) -> tuple:
        return 0.0, [], [], 0, 0, 0, 0, 0, []

    def step(self, kept, rows, key):
        s = self.s
        cusum, bursts, incipients, on, silent, event, clock, since, names = kept
        bursts, incipients, out = list(bursts), list(incipients), []
        for at, x, slow, flow, votes, top, *thresholds in rows:
            burst, incipient, hold, flow_hold = thresholds
            cusum = max(0.0, s.decay * cusum + x - s.allowance)
            final = max(cusum, slow)
            bursts = [*bursts, int(cusum >= burst)][-s.burst_confirm[0] :]
            incipients = [*incipients, int(slow >= incipient)][-s.incipient_confirm[0] :]
            quick, steady = sum(bursts) >= s.burst_confirm[1], sum(incipients) >= s.incipient_confirm[1]
            if not on:
                if votes >= s.start_votes and (quick or steady):
                    on, silent, event, clock, since = 1, 0, event + 1, 0, 0
            elif votes >= s.hold_votes and (final >= hold or flow >= flow_hold or steady):
                silent = 0
            else:
                silent += 1
                on = int(silent < max(s.quiet, s.merge))
            reason = None
            if on:
                clock += 1
                seen = {n for n in list(top)[:3] if n}
                if not since:
                    reason = "event_start"
                elif clock - since >= self.recheck:
                    reason = "periodic_recheck"
                elif clock - since >= self.shift and jaccard(seen, set(names)) < s.jaccard:
                    reason = "sensor_shift"
                if reason:
                    since, names = clock, sorted(seen)
            out.append((at, cusum, slow, final, votes, on, event if on else 0, list(top), reason))
        return (cusum, bursts, incipients, on, silent, event, clock, since, list(names)), out


class Merged(InOrder):
    """Events of rows of a state, gaps of at most max_gap rows closed; open ones are told as they grow, with final = false."""

    READS = "value int"
    KEEPS = "event_id long, start long, end long, rows long"
    OUT = "network string, event_id long, start_ts timestamp, end_ts timestamp, n_rows long, final boolean"

    def __init__(self, max_gap: int, step_s: int, provisional: bool):
        self.gap, self.step_us, self.provisional = max_gap, step_s * 1_000_000, provisional

    def fresh(self) -> tuple:
        return 0, -1, -1, 0

    def step(self, kept, rows, key):
        event, start, end, n = kept
        out, grown = [], False
        for at, value in rows:
            if not value:
                continue
            if n and at > end + (self.gap + 1) * self.step_us:
                out.append((event, start, end, n, True))
                n = 0
            if not n:
                event, start = event + 1, at
            end, grown = at, True
            n = (end - start) // self.step_us + 1
        if grown and self.provisional:
            out.append((event, start, end, n, False))
        return (event, start, end, n), out

    def passed(self, kept, upto, key):
        event, start, end, n = kept
        last = end + (self.gap + 1) * self.step_us
        if n and upto >= last:
            return (event, -1, -1, 0), [(event, start, end, n, True)], None
        return kept, [], last if n else None


def merged_events(states: DataFrame, max_gap: int, step_s: int, state: str = "state", late: str = "1 hour", provisional: bool = True) -> DataFrame:
    """states (network, ts, a 0/1 column on a grid of step_s) as a stream to network, event_id, start_ts, end_ts, n_rows (gaps included), final.

    An event is final when max_gap + 1 steps behind its last row have passed the watermark; final events are those that
    `sequence.merge_gaps` and `event_ids` give. provisional (a query in update mode) also tells open events when they
    grow; the later row of an event replaces the earlier. A null counts as 0; a time without a row too, on the grid.
    """
    prepare(states.sparkSession)
    told = states.select("network", F.col("ts").cast("timestamp").alias("ts"), F.coalesce(F.col(state).cast("int"), F.lit(0)).alias("value")).withWatermark("ts", late)
    processor = Merged(max_gap, step_s, provisional)
    told = told.where(F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts"))
    return told.groupBy("network").transformWithStateInPandas(processor, processor.OUT, "update" if provisional else "append", "EventTime")


def together(tables: Iterable[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def slot_table(fits: dict[str, Fitted]) -> DataFrame:
    """network, series, slot, location, scale of all fits."""
    return together(f.profile.select("series", "slot", "location").join(f.scales.select("series", "scale"), "series").withColumn("network", F.lit(n)) for n, f in fits.items())


def plan_table(fits: dict[str, Fitted]) -> DataFrame:
    """A row for each network: its pair lines, how many sensors lead, and its thresholds."""

    def one(name: str, f: Fitted) -> DataFrame:
        lines = f.models.agg(F.collect_list(F.struct("target", "anchor", "slope", "intercept", "sigma")).alias("lines"), F.count_distinct("target").alias("targets"))
        return lines.select(F.lit(name).alias("network"), "lines", "targets", *[F.lit(float(f.thresholds[k])).alias(k) for k in ("burst", "incipient", "hold", "flow_hold")], F.array(*[F.lit(x) for x in f.flows]).cast("array<string>").alias("scored"))

    return together(one(n, f) for n, f in fits.items())


def leading_mean(values: Column, k: Column) -> Column:
    """Mean of the k greatest; 0 of none."""
    high = F.slice(F.sort_array(F.transform(values, lambda x: F.coalesce(x, F.lit(0.0))), asc=False), F.lit(1), k)
    return F.when(F.size(high) > 0, F.aggregate(high, F.lit(0.0), lambda a, b: a + b) / F.size(high)).otherwise(0.0)


def sensor_rows(readings: DataFrame, fits: dict[str, Fitted], late: str) -> DataFrame:
    """Scores of each sensor and time. Series that no fit knows are left out."""
    s = settings_of(fits)
    told = readings.select("network", "series", "kind", F.col("ts").cast("timestamp").alias("ts"), F.when(~F.isnan("value"), F.col("value")).alias("value")).withWatermark("ts", late)
    told = told.withColumn("slot", seasonal.slot("ts", s.slots)).join(slot_table(fits), ["network", "series", "slot"])
    return run_in_order(told, ["network", "series", "kind"], Sensor(s))


def settings_of(fits: dict[str, Fitted]) -> Settings:
    found = {f.settings for f in fits.values()}
    if len(found) != 1:
        raise ValueError("networks of one stream share their settings")
    return found.pop()


def network_rows(sensors: DataFrame, fits: dict[str, Fitted]) -> DataFrame:
    """network, ts and what `Network` reads: the scores of all sensors at a time."""
    s = settings_of(fits)
    met = sensors.groupBy("network", "ts").agg(F.collect_list(F.struct("series", "kind", F.when(~F.isnan("value"), F.col("value")).alias("value"), "pressure", "slope", "ewma", "flow")).alias("rows")).join(plan_table(fits), "network")
    met = met.withColumn("p", F.filter("rows", lambda r: r["kind"] == "pressure")).withColumn("f", F.filter("rows", lambda r: (r["kind"] == "flow") & F.array_contains("scored", r["series"])))
    met = met.withColumn("values", F.map_from_entries(F.transform("p", lambda r: F.struct(r["series"], r["value"]))))

    def pairs(r: Column) -> Column:
        """Mean distance of a sensor from its lines, in their scales."""
        own = F.filter("lines", lambda x: x["target"] == r["series"])
        gaps = F.filter(F.transform(own, lambda x: F.abs(r["value"] - x["slope"] * F.try_element_at("values", x["anchor"]) - x["intercept"]) / F.greatest(x["sigma"], F.lit(1e-6))), lambda g: g.isNotNull())
        return F.when(F.size(gaps) > 0, F.aggregate(gaps, F.lit(0.0), lambda a, b: a + b) / F.size(gaps)).otherwise(0.0)

    met = met.withColumn("p", F.transform("p", lambda r: F.struct(r["series"].alias("series"), r["pressure"].alias("pressure"), r["slope"].alias("slope"), r["ewma"].alias("ewma"), pairs(r).alias("pairwise"))))
    met = met.withColumn("evidence", F.transform("p", lambda r: F.struct((s.pressure * r["pressure"] + s.pairwise * r["pairwise"] + s.slope * r["slope"]).alias("e"), r["series"].alias("series"))))
    n = F.when(F.col("targets") > 0, F.col("targets")).otherwise(F.size("p"))
    k = F.greatest(F.lit(1), F.least(n, F.greatest(F.lit(s.least_top), F.ceil(n * s.top_share)))).cast("int")
    lead = {c: leading_mean(F.col(f"p.{c}"), k) for c in ("pressure", "pairwise", "ewma", "slope")}
    flow = leading_mean(F.col("f.flow"), F.lit(1))
    met = met.select("*", flow.alias("flow_topk"), *[x.alias(f"{c}_topk") for c, x in lead.items()])
    burst = s.pressure * F.col("pressure_topk") + s.pairwise * F.col("pairwise_topk") + s.flow * F.col("flow_topk")
    slow = 0.5 * F.col("ewma_topk") + 0.5 * F.col("slope_topk") + s.night * F.col("flow_topk") * detect.is_night("ts", s.night_hours).cast("double")
    votes = F.size(F.filter("evidence", lambda x: x["e"] > s.vote)).cast("long")
    top = F.transform(F.slice(F.array_sort(F.transform("evidence", lambda x: F.struct((-x["e"]).alias("e"), x["series"].alias("series")))), 1, s.names), lambda x: x["series"])
    return met.where(F.size("p") > 0).select("network", "ts", burst.alias("value"), slow.alias("score_incipient"), "flow_topk", votes.alias("votes"), top.alias("top"), "burst", "incipient", "hold", "flow_hold")


def detect_stream(readings: DataFrame, fits: dict[str, Fitted], late: str = "1 hour") -> DataFrame:
    """readings (network, series, kind, ts, value) as a stream to a row for each network and time: scores, votes, state, event, leading names and trigger reason.

    fits: a fit of `detect.fit_tiny` for each network; networks without one are left out. Readings that come up to `late`
    after the newest count; null or NaN is a missing value, and a time without any pressure gives no row.
    """
    return run_in_order(network_rows(sensor_rows(readings, fits, late), fits), ["network"], Network(settings_of(fits)))
