"""The two detectors, full and compact: fitted on one span of time, applied to another.

A panel is (series, kind, ts, value) on a complete grid; kinds are pressure, flow, level and demand. What a fit leaves
are small tables (rows for each series, slot or model) and a few thresholds; detection joins them to any panel.
"""

from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators import audit, relate, scores, seasonal, sequence, state
from telltale.scratch import Scratch


@dataclass(frozen=True)
class Settings:
    """Parameters of a detector. Counts are rows, unless a name says otherwise."""

    slots: str = "weekly_5min"
    smooth: int = 3
    anchors: int = 6
    pair_anchors: int = 4
    least_top: int = 3
    top_share: float = 0.15
    delta: float = 1.5
    ridge: float = 1e-3
    steps: int = 30
    trim: float = 0.97
    alpha: float = 0.15
    slope_rows: int = 24
    week_rows: int = 2016
    vote: float = 0.9
    start_votes: int = 2
    hold_votes: int = 1
    pressure: float = 1.0
    pairwise: float = 0.8
    flow: float = 0.4
    night: float = 0.25
    slope: float = 0.8
    allowance: float = 0.5
    decay: float = 0.85
    burst_q: float = 0.99
    incipient_q: float = 0.97
    hold_q: float = 0.90
    flow_hold_q: float = 0.88
    burst_confirm: tuple[int, int] = (3, 2)
    incipient_confirm: tuple[int, int] = (12, 6)
    quiet: int = 72
    merge: int = 144
    names: int = 5
    night_hours: tuple[int, int] = (1, 4)
    recheck_h: float = 12.0
    shift_min: float = 720.0
    jaccard: float = 0.2
    step_s: int = 300
    monitored: int | None = None
    least_rows: int = 1000
    exclude_flows: tuple[str, ...] = ()
    leave_switches: bool = True


@dataclass
class Fitted:
    """What a fit leaves."""

    settings: Settings
    profile: DataFrame
    models: DataFrame
    scales: DataFrame
    thresholds: dict[str, float] = field(default_factory=dict)
    allowance: float = 0.5
    flows: list[str] = field(default_factory=list)


def scored_flows(panel: DataFrame, s: Settings, simple: bool = False) -> list[str]:
    """Flows whose scores count: not those that settings name, and (leave_switches) not those that switch between two levels, by their quantiles or, in the simple form, by their ends."""
    flows = panel.where("kind = 'flow'").select("series", "value")
    names = sorted(r["series"] for r in flows.select("series").distinct().collect())
    if not s.leave_switches:
        return [n for n in names if n not in s.exclude_flows]
    if simple:
        return audit.active_flows(names, list(s.exclude_flows), audit.binary_ends(flows.withColumn("value", F.round("value", 2)).where("value is not null")))
    switching = {r["series"] for r in audit.binary_like(flows).where("switching").collect()}
    return [n for n in names if n not in switching and n not in s.exclude_flows]


def resolve_slots(mode: str, week_rows: int) -> str:
    """`auto` is the finest profile that a week of so many rows has."""
    return mode if mode != "auto" else "weekly_5min" if week_rows == 2016 else "weekly_hour"


def is_night(ts: str, hours: tuple[int, int] = (1, 4)) -> Column:
    return (F.hour(ts) >= hours[0]) & (F.hour(ts) < hours[1])


def pressure_summary(panel: DataFrame) -> DataFrame:
    """Mean and least pressure at each time, as two more series."""
    s = panel.where("kind = 'pressure'").groupBy("ts").agg(F.avg("value").alias("pressure_mean"), F.min("value").alias("pressure_min"))
    return s.unpivot(["ts"], ["pressure_mean", "pressure_min"], "series", "value").select("series", F.lit("summary").alias("kind"), "ts", "value")


def smoothed(panel: DataFrame, rows: int) -> DataFrame:
    return sequence.causal_median(panel, rows).select("series", "kind", "ts", F.col("smooth").alias("value"))


def top_k(s: Settings, sensors: int) -> int:
    return max(1, min(sensors, max(s.least_top, -int(-sensors * s.top_share // 1))))


def top_means(df: DataFrame, columns: list[str], k: int) -> DataFrame:
    """ts and for each column the mean of its k greatest values at that time; null counts as 0. A time's list is as long as there are series."""
    high = lambda c: F.slice(F.sort_array(F.collect_list(F.coalesce(F.col(c), F.lit(0.0))), asc=False), 1, k)
    t = df.groupBy("ts").agg(*[high(c).alias(c) for c in columns])
    return t.select("ts", *[(F.aggregate(c, F.lit(0.0), lambda a, b: a + b) / F.size(c)).alias(f"{c}_topk") for c in columns])


def robust(values: DataFrame, column: str) -> tuple[float, float]:
    """Median and robust scale of one column."""
    r = seasonal.robust_scale(values.withColumn("all", F.lit(1)), ["all"], column).first()
    return (r["location"], r["scale"]) if r else (0.0, 1.0)


def quantiles(table: DataFrame, asked: dict[str, tuple[str, float]]) -> dict[str, float]:
    row = table.agg(*[F.percentile(c, F.lit(q)).alias(n) for n, (c, q) in asked.items()]).first()
    return {n: row[n] for n in asked}


# the full detector


def deseasoned(panel: DataFrame, profile: DataFrame, s: Settings) -> DataFrame:
    return seasonal.residuals(panel, profile, s.slots).select("series", "kind", "ts", F.col("resid").alias("value"))


def full_features(panel: DataFrame, s: Settings) -> DataFrame:
    """model, target, feature: each pressure by its nearest pressures and all other signals; each flow by the other flows, levels, demands and the pressures' mean and minimum; each pair of a pressure and one of its nearest, with all other signals."""
    p = panel.where("kind = 'pressure'").select("series", "ts", "value")
    kinds = panel.select("series", "kind").distinct()
    others = kinds.where("kind in ('flow', 'level', 'demand')").select(F.col("series").alias("feature"), F.col("kind").alias("k"))
    near = relate.top_anchors(p, max(s.anchors, s.pair_anchors)).select(F.col("a").alias("target"), F.col("b").alias("feature"), "rank")
    pressures = kinds.where("kind = 'pressure'").select(F.col("series").alias("target"))
    key = lambda k, *c: F.concat_ws("|", F.lit(k), *c).alias("model")
    one = near.where(F.col("rank") <= s.anchors).select("target", "feature").unionByName(pressures.join(others.select("feature"), F.lit(True)))
    flows = kinds.where("kind = 'flow'").select(F.col("series").alias("target"))
    summary = panel.sparkSession.createDataFrame([("pressure_mean",), ("pressure_min",)], "feature string")
    flow = flows.join(others.select("feature").unionByName(summary), F.col("target") != F.col("feature"))
    pairs = near.where(F.col("rank") <= s.pair_anchors).select("target", F.col("feature").alias("anchor"))
    two = pairs.select("target", "anchor", F.col("anchor").alias("feature")).unionByName(pairs.join(others.select("feature"), F.lit(True)))
    parts = one.select(key("pressure", "target"), "target", "feature"), flow.select(key("flow", "target"), "target", "feature"), two.select(key("pair", "target", "anchor"), "target", "feature")
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def negative(c: str, scale: str) -> Column:
    """How many scales it is below zero; null where it is null."""
    return F.when(F.col(c).isNotNull(), F.greatest(F.lit(0.0), -F.col(c) / F.greatest(F.col(scale), F.lit(1e-3))))


def full_sensor_scores(ds: DataFrame, models: DataFrame, scales: DataFrame, s: Settings, active: list[str]) -> tuple[DataFrame, DataFrame]:
    """Scores of each pressure (pressure, pairwise, weekly, ewma, slope) and of each flow: what is lower than foreseen, or for flows higher."""
    r = relate.model_residuals(ds.select("series", "ts", "value").unionByName(pressure_summary(ds).select("series", "ts", "value")), models)
    r = r.withColumn("kind", F.substring_index("model", "|", 1))
    own = r.where("kind = 'pressure'").select(F.col("target").alias("series"), "ts", "resid", "sigma")
    drift = sequence.lag_difference(own, s.week_rows, "resid", out="week")
    drift = sequence.lag_difference(drift, max(1, s.slope_rows - 1), "resid", out="fall").join(F.broadcast(scales), "series", "left")
    told = drift.select("series", "ts", negative("resid", "sigma").alias("pressure"), negative("week", "week_scale").alias("weekly"), negative("fall", "fall_scale").alias("slope"))
    told = sequence.ewma_known(told, s.alpha, "weekly", out="ewma")
    pair = relate.over_anchors(r.where("kind = 'pair'").withColumnRenamed("target", "series"), negative("resid", "sigma"), ["series", "ts"], "median", "pairwise")
    flows = r.where((F.col("kind") == "flow") & F.col("target").isin(active)).select(F.col("target").alias("series"), "ts", F.greatest(F.lit(0.0), F.col("resid") / F.greatest("sigma", F.lit(1e-3))).alias("flow"))
    return told.join(pair, ["series", "ts"], "left").na.fill(0.0, ["pressure", "pairwise", "weekly", "ewma", "slope"]), flows.na.fill(0.0, ["flow"])


def full_totals(sensors: DataFrame, flows: DataFrame, s: Settings, n_pressures: int, n_flows: int, allowance: float) -> DataFrame:
    """All scores of each time: burst (raw, CUSUM, trigger), incipient and final."""
    k = top_k(s, n_pressures)
    t = top_means(sensors, ["pressure", "pairwise", "ewma", "slope"], k).join(top_means(flows, ["flow"], max(1, min(n_flows, k))), "ts", "left").na.fill(0.0, ["flow_topk"])
    burst = s.pressure * F.col("pressure_topk") + s.pairwise * F.col("pairwise_topk") + s.flow * F.col("flow_topk") + s.night * F.col("flow_topk") * is_night("ts", s.night_hours).cast("double")
    t = t.withColumn("series", F.lit("all")).withColumn("score_burst", burst).withColumn("score_incipient", F.col("ewma_topk") + s.slope * F.col("slope_topk"))
    t = sequence.cusum(t, allowance, s.decay, value="score_burst", out="burst_cusum")
    return t.withColumn("score_trigger", F.greatest("score_burst", "burst_cusum")).withColumn("score_final", F.greatest("score_burst", "score_incipient"))


def counts(panel: DataFrame) -> tuple[int, int]:
    n = {r["kind"]: r["n"] for r in panel.groupBy("kind").agg(F.count_distinct("series").alias("n")).collect()}
    return n.get("pressure", 0), n.get("flow", 0)


def fit_full(panel: DataFrame, s: Settings, leaks: DataFrame | None = None) -> Fitted:
    """Profile, models, drift scales, CUSUM allowance and thresholds. Rows in `leaks` (start_ts, end_ts) teach nothing but the thresholds.

    Smoothing comes before rows are left out. Fewer than least_rows healthy times are an error.
    """
    scratch = Scratch(panel.sparkSession)
    smooth = scratch.cut(smoothed(panel, s.smooth))
    healthy = relate.in_intervals(smooth, leaks, True) if leaks is not None else smooth
    if healthy.select("ts").distinct().count() < s.least_rows:
        raise ValueError(f"fewer than {s.least_rows} healthy rows")
    profile = scratch.cut(seasonal.profile(healthy, s.slots))
    calm = scratch.cut(deseasoned(healthy, profile, s))
    both = scratch.cut(calm.select("series", "ts", "value").unionByName(pressure_summary(calm).select("series", "ts", "value")))
    models = scratch.cut(relate.robust_models(both, full_features(calm, s), s.delta, s.ridge, s.steps, s.trim))
    own = scratch.cut(relate.model_residuals(both, models.where("model like 'pressure|%'")).select(F.col("target").alias("series"), "ts", "resid"))
    # differences of the rows that are left, across what was left out
    drift = sequence.lag_difference(sequence.lag_difference(own, s.week_rows, "resid", out="week"), max(1, s.slope_rows - 1), "resid", out="fall")
    week, fall = (seasonal.robust_scale(drift, ["series"], c).select("series", F.col("scale").alias(f"{c}_scale")) for c in ("week", "fall"))
    scales = scratch.cut(week.join(fall, "series"))
    active = scored_flows(healthy, s)
    n = counts(panel)[0], len(active)
    sensors, flows = map(scratch.cut, full_sensor_scores(deseasoned(smooth, profile, s), models, scales, s, active))
    middle, spread = robust(full_totals(sensors, flows, s, *n, s.allowance), "score_burst")
    allowance = middle + 0.5 * spread
    whole = full_totals(sensors, flows, s, *n, allowance)
    asked = {"burst": ("score_trigger", s.burst_q), "incipient": ("score_incipient", s.incipient_q), "hold": ("score_final", s.hold_q), "flow_hold": ("flow_topk", s.flow_hold_q)}
    out = Fitted(s, profile, models, scales, quantiles(whole, asked), allowance, active)
    scratch.drop(sensors, flows, own, both, calm, smooth)
    return out


def confirmed(t: DataFrame, s: Settings, th: dict[str, float], burst: str) -> DataFrame:
    t = sequence.rolling_vote(t, F.col(burst) >= th["burst"], *s.burst_confirm, out="burst_vote")
    return sequence.rolling_vote(t, F.col("score_incipient") >= th["incipient"], *s.incipient_confirm, out="incipient_vote")


def area_of(areas: dict[str, str] | None, default: str | None) -> Column:
    """The area that most of a row's leading sensors (`top`) are in; of several, the last by name."""
    place = F.create_map(*[F.lit(x) for kv in (areas or {"": ""}).items() for x in kv])
    known = F.filter(F.transform("top", lambda n: F.try_element_at(place, n)), lambda x: x.isNotNull())
    votes = F.transform(F.array_distinct(known), lambda a: F.struct(F.size(F.filter("top", lambda n: F.try_element_at(place, n) == a)).alias("c"), a.alias("area")))
    return F.coalesce(F.array_max(votes)["area"], F.lit(default))


def detect_full(panel: DataFrame, fitted: Fitted, areas: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results by time, evidence by sensor and time): states, event ids, votes, the leading sensors and their area (null without areas)."""
    s, th = fitted.settings, fitted.thresholds
    scratch = Scratch(panel.sparkSession)
    ds = scratch.cut(deseasoned(smoothed(panel, s.smooth), fitted.profile, s))
    sensors, flows = map(scratch.cut, full_sensor_scores(ds, fitted.models, fitted.scales, s, fitted.flows))
    evidence = sensors.select("series", "ts", (F.col("pressure") + F.col("pairwise") + 0.5 * F.col("ewma") + 0.25 * F.col("slope")).alias("evidence"))
    n = counts(panel)[0], len(fitted.flows)
    t = full_totals(sensors, flows, s, *n, fitted.allowance).join(scores.votes(evidence, F.col("evidence") >= s.vote), "ts", "left").na.fill(0, ["votes"])
    t = confirmed(t, s, th, "score_trigger")
    flow_hit = (F.col("flow_topk") >= th["flow_hold"]) if n[1] else F.lit(False)
    enough = F.col("votes") >= s.start_votes
    start = ((F.col("burst_vote") == 1) & (enough | flow_hit)) | ((F.col("incipient_vote") == 1) & enough)
    hold = (F.col("score_final") >= th["hold"]) | flow_hit | (F.col("votes") >= s.hold_votes)
    t = state.hysteresis(t.withColumn("start", start).withColumn("hold", hold), s.quiet).drop("start", "hold")
    t = sequence.event_ids(sequence.merge_gaps(t, "state", s.merge, out="leak_state"), "leak_state")
    lead = scores.top_series(evidence, "evidence", s.names).withColumn("area", area_of(areas, None))
    return t.join(lead, "ts", "left").drop("state", "series"), evidence


def summarise_full(results: DataFrame) -> DataFrame:
    """For each event its span, hours, peak, usual area, and the five names that lead most often."""
    e = results.where("event_id > 0")
    seconds = lambda c: F.unix_seconds(c.cast("timestamp"))
    main = e.groupBy("event_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), ((seconds(F.max("ts")) - seconds(F.min("ts"))) / 3600).alias("hours"), F.max_by("ts", F.struct("score_final", -seconds(F.col("ts")))).alias("peak_ts"), F.max("score_final").alias("peak_score"), F.mode("area", True).alias("area"))
    seen = e.select("event_id", F.explode("top").alias("name")).groupBy("event_id", "name").agg(F.count("*").alias("c"))
    lead = seen.withColumn("k", F.row_number().over(Window.partitionBy("event_id").orderBy(F.desc("c"), "name"))).where("k <= 5")
    return main.join(lead.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "name"))), lambda x: x["name"]).alias("top")), "event_id", "left")


# the compact detector


def fit_tiny(panel: DataFrame, s: Settings, leaks: DataFrame | None = None) -> Fitted:
    """Slot medians, residual scales, pair lines and thresholds, all from the rows that are left without leaks (all rows, if under a tenth is left).

    Smoothing comes after rows are left out. Pressures are the `monitored` most central ones.
    """
    slots = resolve_slots(s.slots, s.week_rows)
    s = replace(s, slots=slots)
    train = panel
    if leaks is not None:
        left = relate.in_intervals(panel, leaks, True)
        n, all_rows = (d.select("ts").distinct().count() for d in (left, panel))
        train = left if n >= max(10, all_rows // 10) else panel
    scratch = Scratch(panel.sparkSession)
    smooth = scratch.cut(smoothed(train, s.smooth))
    pressures = smooth.where("kind = 'pressure'").select("series", "ts", "value")
    if s.monitored:
        names = relate.centrality(pressures).orderBy(F.desc(F.round("centrality", 12)), "series").limit(s.monitored).select("series")
        smooth = smooth.where("kind <> 'pressure'").unionByName(smooth.join(F.broadcast(names), "series", "left_semi").select(*smooth.columns))
        smooth = scratch.cut(smooth)
        pressures = smooth.where("kind = 'pressure'").select("series", "ts", "value")
    profile = scratch.cut(slot_medians(smooth, slots))
    resid = smooth.withColumn("slot", seasonal.slot("ts", slots)).join(profile, ["series", "slot"]).select("series", (F.col("value") - F.col("location")).alias("value"))
    scales = scratch.cut(seasonal.robust_scale(resid, ["series"], floor=1e-3).select("series", "scale"))
    near = relate.top_anchors(pressures, s.pair_anchors).select(F.col("a").alias("target"), F.col("b").alias("anchor"))
    lines = relate.ridge_lines(pressures, s.ridge).join(near, ["target", "anchor"])
    gaps = pair_gaps(pressures, lines).select(F.concat_ws("|", "target", "anchor").alias("series"), F.col("gap").alias("value"))
    spread = seasonal.robust_scale(gaps, ["series"], floor=1e-3).select(F.col("series").alias("model"), F.col("scale").alias("sigma"))
    models = scratch.cut(lines.withColumn("model", F.concat_ws("|", "target", "anchor")).join(spread, "model"))
    out = Fitted(s, profile, models, scales, {}, s.allowance, scored_flows(train, s, simple=True))
    sensors, flows = map(scratch.cut, tiny_sensor_scores(train, out))
    asked = {"burst": ("burst_cusum", s.burst_q), "incipient": ("score_incipient", s.incipient_q), "hold": ("score_final", s.hold_q), "flow_hold": ("flow_topk", s.flow_hold_q)}
    floors, spare = {"burst": 0.10, "incipient": 0.10, "hold": 0.05, "flow_hold": 0.05}, {"burst": 1.0, "incipient": 1.0, "hold": 0.5, "flow_hold": 0.25}
    found = quantiles(tiny_totals(sensors, flows, out), asked)
    out.thresholds = {k: max(floors[k], spare[k] if v is None else v) for k, v in found.items()}
    scratch.drop(smooth, sensors, flows)
    return out


def slot_medians(panel: DataFrame, slots: str) -> DataFrame:
    """series, slot, location: the median of each slot, or the series' where a slot has none."""
    told = panel.withColumn("slot", seasonal.slot("ts", slots))
    local = told.groupBy("series", "slot").agg(F.percentile("value", F.lit(0.5)).alias("loc"))
    every = panel.groupBy("series").agg(F.percentile("value", F.lit(0.5)).alias("middle")).withColumn("slot", F.explode(F.sequence(F.lit(0), F.lit(seasonal.slots(slots) - 1))))
    return every.join(local, ["series", "slot"], "left").select("series", "slot", F.coalesce("loc", "middle").alias("location"))


def pair_gaps(pressures: DataFrame, lines: DataFrame) -> DataFrame:
    """target, anchor, ts, gap: how far a target lies from the line through its anchor."""
    a = pressures.select(F.col("series").alias("target"), "ts", F.col("value").alias("y"))
    b = pressures.select(F.col("series").alias("anchor"), "ts", F.col("value").alias("x"))
    return lines.join(a, "target").join(b, ["anchor", "ts"]).withColumn("gap", F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"))


def tiny_sensor_scores(panel: DataFrame, fitted: Fitted) -> tuple[DataFrame, DataFrame]:
    """Scores of each monitored pressure, two-sided: its own z and that of its pairs (each as itself), its EWMA and its change; and of each flow, if it is high."""
    s = fitted.settings
    smooth = smoothed(panel, s.smooth)
    told = smooth.withColumn("slot", seasonal.slot("ts", s.slots)).join(fitted.profile, ["series", "slot"]).join(F.broadcast(fitted.scales), "series").withColumn("resid", F.col("value") - F.col("location"))
    scale = F.greatest("scale", F.lit(1e-6))
    p = told.where("kind = 'pressure'").select("series", "ts", "resid", "scale", "value", (F.abs("resid") / scale).alias("pressure"))
    p = sequence.lag_difference(p, s.slope_rows, "resid", out="change")
    p = sequence.ewma(p.withColumn("slope", F.coalesce(F.abs("change"), F.lit(0.0)) / scale), s.alpha, "pressure", out="ewma")
    gaps = relate.over_anchors(pair_gaps(p.select("series", "ts", "value"), fitted.models).withColumnRenamed("target", "series"), F.abs("gap") / F.greatest("sigma", F.lit(1e-6)), ["series", "ts"], "mean", "pairwise")
    p = p.select("series", "ts", "pressure", "slope", "ewma").join(gaps, ["series", "ts"], "left").na.fill(0.0, ["pairwise"])
    flows = told.where((F.col("kind") == "flow") & F.col("series").isin(fitted.flows)).select("series", "ts", (F.greatest("resid", F.lit(0.0)) / scale).alias("flow"))
    return p.na.fill(0.0, ["pressure", "ewma"]), flows.na.fill(0.0, ["flow"])


def tiny_totals(sensors: DataFrame, flows: DataFrame, fitted: Fitted) -> DataFrame:
    s = fitted.settings
    n = fitted.models.select("target").distinct().count() or sensors.select("series").distinct().count()
    t = top_means(sensors, ["pressure", "pairwise", "ewma", "slope"], top_k(s, n)).join(top_means(flows, ["flow"], 1), "ts", "left").na.fill(0.0, ["flow_topk"])
    t = t.withColumn("series", F.lit("all")).withColumn("burst_raw", s.pressure * F.col("pressure_topk") + s.pairwise * F.col("pairwise_topk") + s.flow * F.col("flow_topk"))
    t = t.withColumn("score_incipient", 0.5 * F.col("ewma_topk") + 0.5 * F.col("slope_topk") + s.night * F.col("flow_topk") * is_night("ts", s.night_hours).cast("double"))
    t = sequence.cusum(t, s.allowance, s.decay, skip_first=False, value="burst_raw", out="burst_cusum")
    return t.withColumn("score_final", F.greatest("burst_cusum", "score_incipient"))


def detect_tiny(panel: DataFrame, fitted: Fitted, areas: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(results by time, evidence by sensor and time). There is no closing of gaps; the quiet limit is the longer of the two instead."""
    s, th = fitted.settings, fitted.thresholds
    sensors, flows = map(Scratch(panel.sparkSession).cut, tiny_sensor_scores(panel, fitted))
    evidence = sensors.select("series", "ts", (s.pressure * F.col("pressure") + s.pairwise * F.col("pairwise") + s.slope * F.col("slope")).alias("evidence"))
    t = tiny_totals(sensors, flows, fitted).join(scores.votes(evidence, F.col("evidence") > s.vote), "ts", "left").na.fill(0, ["votes"])
    t = confirmed(t, s, th, "burst_cusum")
    start = (F.col("votes") >= s.start_votes) & ((F.col("burst_vote") == 1) | (F.col("incipient_vote") == 1))
    hold = (F.col("votes") >= s.hold_votes) & ((F.col("score_final") >= th["hold"]) | (F.col("flow_topk") >= th["flow_hold"]) | (F.col("incipient_vote") == 1))
    t = state.hysteresis(t.withColumn("start", start).withColumn("hold", hold), max(s.quiet, s.merge)).withColumnRenamed("state", "leak_state")
    t = sequence.event_ids(t, "leak_state").drop("start", "hold")
    lead = scores.top_series(evidence, "evidence", s.names, positive=False)
    lead = lead.withColumn("area", area_of(areas, "unknown"))
    return t.join(lead, "ts", "left").drop("series"), evidence


def summarise_tiny(results: DataFrame, step_s: int) -> DataFrame:
    """For each event its span, hours (rows times the step), peak score, usual area and the names at its last row."""
    e = results.where("event_id > 0")
    return e.groupBy("event_id").agg(F.min("ts").alias("start_ts"), F.max("ts").alias("end_ts"), (F.count("*") * step_s / 3600).alias("hours"), F.max("score_final").alias("peak_score"), F.mode("area", True).alias("area"), F.max_by("top", "ts").alias("top"))


def trigger_rows(results: DataFrame, s: Settings, tiny: bool = False) -> DataFrame:
    """event_id, ts, reason: when the second stage is asked. The compact form counts rows of the step and looks at three names."""
    rows = results.where("event_id > 0").select("event_id", "ts", F.col("top").alias("names")).withColumn("all", F.lit(1))
    if tiny:
        t = state.schedule(rows, max(1, round(s.recheck_h * 3600 / s.step_s)), max(1, round(s.shift_min * 60 / s.step_s)), s.jaccard, ["all", "event_id"], 3, True)
    else:
        t = state.schedule(rows, s.recheck_h * 3600, s.shift_min * 60, s.jaccard, ["all", "event_id"])
    return t.select("event_id", "ts", "reason")


def evaluate(results: DataFrame, truth: DataFrame, empty: float | None = 0.0) -> DataFrame:
    """Confusion and rates by row; truth: (ts, leak 0/1), a missing time is 0."""
    from telltale.operators import metrics

    told = results.select("ts", "leak_state").join(truth, "ts", "left").na.fill(0, ["leak"])
    return metrics.confusion(told, "leak", "leak_state", empty=empty)
