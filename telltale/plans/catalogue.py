"""Every registered query by name, with the SQL that says the same.

Panels: `hourly` is the mean value of each event type by hour on a complete grid; `daily` is the quantity shipped by
day for each return flag and line status. Doubles are rounded, counts are 64-bit.
"""

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telltale.functions import scalar
from telltale.operators import audit, export, heads, linear, metrics, packets, panel, relate, scores, seasonal, sequence, state
from telltale.scratch import Scratch
from telltale.sources import tables

QUERIES: dict = {}
SQL: dict[str, str] = {}

P1 = """cells AS (SELECT date_trunc('hour', ts) AS t, event_type AS series, avg(value) AS value FROM events GROUP BY ALL),
grid AS (SELECT unnest(generate_series(a, b, INTERVAL 1 HOUR)) AS t FROM (SELECT date_trunc('hour', min(ts)) AS a, date_trunc('hour', max(ts)) AS b FROM events)),
p1 AS (SELECT s.series, g.t AS ts, c.value FROM grid g CROSS JOIN (SELECT DISTINCT event_type AS series FROM events) s LEFT JOIN cells c ON c.t = g.t AND c.series = s.series)"""
P2 = """p2 AS (SELECT l_returnflag || l_linestatus AS series, CAST(date_trunc('day', l_shipdate) AS TIMESTAMP) AS ts, sum(l_quantity) AS value FROM lineitem GROUP BY ALL),
flagged AS (SELECT *, CAST(value > 1.25 * avg(value) OVER (PARTITION BY series) AS INT) AS flag FROM p2)"""


def read(spark: SparkSession, sf: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{table}.parquet")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def hourly(spark, sf) -> DataFrame:
    return panel.regular(read(spark, sf, "events"), "ts", "event_type", F.avg("value"), "hour", "1 HOUR")


def daily(spark, sf) -> DataFrame:
    rows = read(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("series"), F.date_trunc("day", "l_shipdate").cast("timestamp_ntz").alias("ts"), "l_quantity")
    return rows.groupBy("series", "ts").agg(F.sum("l_quantity").alias("value"))


def flagged(spark, sf) -> DataFrame:
    return daily(spark, sf).withColumn("flag", (F.col("value") > 1.25 * F.avg("value").over(Window.partitionBy("series"))).cast("int"))


def r(c, n: int = 6):
    return F.round(c, n)


def long_(c):
    return F.col(c).cast("long").alias(c)


ALARM = f"""WITH {P1},
sm AS (SELECT series, ts, median(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS v FROM p1),
loc AS (SELECT series, hour(ts) AS slot, median(v) AS loc FROM sm GROUP BY ALL),
res AS (SELECT sm.series, ts, v - loc AS resid FROM sm JOIN loc ON loc.series = sm.series AND loc.slot = hour(ts)),
med AS (SELECT series, median(resid) AS m, stddev_pop(resid) AS sd FROM res GROUP BY series),
mad AS (SELECT res.series, median(abs(resid - m)) AS d FROM res JOIN med USING (series) GROUP BY ALL),
z AS (SELECT res.series, ts, coalesce(abs(resid) / CASE WHEN 1.4826 * d > 0.001 THEN 1.4826 * d ELSE greatest(sd, 0.001) END, 0.0) AS z FROM res JOIN med USING (series) JOIN mad USING (series)),
rk AS (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY z DESC, series) AS k FROM z),
top AS (SELECT ts, avg(z) AS score FROM rk WHERE k <= 3 GROUP BY ts)"""
VOTES = """thr AS (SELECT quantile_cont(score, 0.97) AS q FROM top),
v AS (SELECT ts, CAST(sum(CAST(score >= q AS INT)) OVER (ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) >= 2 AS INT) AS vote FROM top, thr),
g AS (SELECT *, row_number() OVER (ORDER BY ts) - row_number() OVER (PARTITION BY vote ORDER BY ts) AS run FROM v)"""


def hourly_scores(spark, sf) -> DataFrame:
    smooth = sequence.causal_median(hourly(spark, sf)).withColumn("value", F.col("smooth")).drop("smooth")
    loc = smooth.withColumn("slot", seasonal.slot("ts", "daily_hour")).groupBy("series", "slot").agg(F.percentile("value", F.lit(0.5)).alias("loc"))
    resid = smooth.withColumn("slot", seasonal.slot("ts", "daily_hour")).join(loc, ["series", "slot"]).withColumn("value", F.col("value") - F.col("loc"))
    scale = seasonal.robust_scale(resid, ["series"], floor=1e-3).select("series", "scale")
    return resid.join(scale, "series").select("series", "ts", F.abs(F.col("value") / F.col("scale")).alias("z"))


@query(f"{ALARM}, {VOTES} SELECT min(ts) AS start_ts, max(ts) AS end_ts, count(*) AS n_rows FROM g WHERE vote = 1 GROUP BY run")
def hourly_alarms(spark, sf):
    """Which hours are alarmed: smoothing, daily profile, robust scores, exact threshold, votes, intervals."""
    top = scores.topk_mean(hourly_scores(spark, sf), "z", 3, "score").withColumn("series", F.lit("all"))
    level = F.broadcast(top.agg(F.percentile("score", F.lit(0.97)).alias("q")))
    voted = sequence.rolling_vote(top.join(level), F.col("score") >= F.col("q"), 3, 2)
    return sequence.islands(voted, "vote").select("start_ts", "end_ts", "n_rows")


@query(f"{ALARM} SELECT ts, round(score, 6) AS score FROM top")
def topk_mean(spark, sf):
    return scores.topk_mean(hourly_scores(spark, sf), "z", 3, "score").select("ts", r("score").alias("score"))


@query(f"{ALARM} SELECT ts, count(*) FILTER (z >= 1.5) AS votes FROM z GROUP BY ts")
def sensor_votes(spark, sf):
    return scores.votes(hourly_scores(spark, sf), F.col("z") >= 1.5)


@query(f"{ALARM} SELECT ts, coalesce(string_agg(series, ', ' ORDER BY k), '') AS top_sensors FROM rk WHERE k <= 5 AND z > 0 GROUP BY ts")
def top_sensors(spark, sf):
    return scores.top_series(hourly_scores(spark, sf), "z").select("ts", F.array_join("top", ", ").alias("top_sensors"))


@query(f"WITH {P1} SELECT series, ts, round(median(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS smooth FROM p1")
def median_smooth(spark, sf):
    return sequence.causal_median(hourly(spark, sf)).select("series", "ts", r("smooth").alias("smooth"))


PROFILE = """loc AS (SELECT series, {slot} AS slot, median(value) AS loc FROM p1 WHERE value IS NOT NULL GROUP BY ALL),
mad AS (SELECT p1.series, slot, median(abs(value - loc)) AS d FROM p1 JOIN loc ON loc.series = p1.series AND loc.slot = {slot} GROUP BY ALL),
al AS (SELECT series, median(value) AS m, stddev_pop(value) AS sd FROM p1 GROUP BY series),
alm AS (SELECT p1.series, median(abs(value - m)) AS d FROM p1 JOIN al USING (series) GROUP BY ALL),
sc AS (SELECT al.series, m, CASE WHEN 1.4826 * alm.d > 1e-9 THEN 1.4826 * alm.d ELSE greatest(sd, 1.0) END AS s FROM al JOIN alm USING (series)),
prof AS (SELECT sc.series, CAST(g.slot AS BIGINT) AS slot, coalesce(last_value(loc IGNORE NULLS) OVER (PARTITION BY sc.series ORDER BY g.slot ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), first_value(loc IGNORE NULLS) OVER (PARTITION BY sc.series ORDER BY g.slot ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING), m) AS location, CASE WHEN mad.d > 0 THEN 1.4826 * mad.d ELSE s END AS scale
FROM sc CROSS JOIN (SELECT unnest(range({n})) AS slot) g LEFT JOIN loc ON loc.series = sc.series AND loc.slot = g.slot LEFT JOIN mad ON mad.series = sc.series AND mad.slot = g.slot)"""
WEEK, DAY = PROFILE.format(slot="((isodow(ts) - 1) * 24 + hour(ts))", n=168), PROFILE.format(slot="hour(ts)", n=24)


def profile(spark, sf, mode):
    return seasonal.profile(hourly(spark, sf), mode)


@query(f"WITH {P1}, {WEEK} SELECT series, slot, round(location, 6) AS location, round(scale, 6) AS scale FROM prof")
def slot_profile_weekly(spark, sf):
    return profile(spark, sf, "weekly_hour").select("series", long_("slot"), r("location").alias("location"), r("scale").alias("scale"))


@query(f"WITH {P1}, {DAY} SELECT series, slot, round(location, 6) AS location, round(scale, 6) AS scale FROM prof")
def slot_profile_daily(spark, sf):
    return profile(spark, sf, "daily_hour").select("series", long_("slot"), r("location").alias("location"), r("scale").alias("scale"))


@query(f"WITH {P1}, {DAY} SELECT p1.series, ts, round(value - location, 6) AS resid, round((value - location) / scale, 6) AS z FROM p1 JOIN prof ON prof.series = p1.series AND prof.slot = hour(ts)")
def seasonal_residual(spark, sf):
    p = hourly(spark, sf)
    return seasonal.residuals(p, seasonal.profile(p, "daily_hour"), "daily_hour").select("series", "ts", r("resid").alias("resid"), r(F.col("resid") / F.col("scale")).alias("z"))


@query(f"WITH {P1}, {DAY} SELECT series, round(m, 6) AS location, round(s, 6) AS scale FROM sc")
def robust_scale(spark, sf):
    return seasonal.robust_scale(hourly(spark, sf), ["series"]).select("series", r("location").alias("location"), r("scale").alias("scale"))


@query("SELECT event_type, round(quantile_cont(value, 0.88), 6) AS q88, round(quantile_cont(value, 0.95), 6) AS q95, round(quantile_cont(value, 0.995), 6) AS q995 FROM events GROUP BY event_type")
def calibration_quantiles(spark, sf):
    q = lambda x, n: r(F.percentile("value", F.lit(x))).alias(n)
    return read(spark, sf, "events").groupBy("event_type").agg(q(0.88, "q88"), q(0.95, "q95"), q(0.995, "q995"))


@query(f"WITH {P2} SELECT series, ts, round(value - lag(value, 7) OVER (PARTITION BY series ORDER BY ts), 6) AS diff FROM p2")
def lag_diff(spark, sf):
    return sequence.lag_difference(daily(spark, sf), 7).select("series", "ts", r("diff").alias("diff"))


@query(f"WITH {P2} SELECT a.series, a.ts, round(a.value - b.value, 6) AS diff FROM p2 a LEFT JOIN p2 b ON a.series = b.series AND a.ts = b.ts + INTERVAL 7 DAY")
def week_over_week(spark, sf):
    return sequence.time_lag_difference(daily(spark, sf), "7 DAYS").select("series", "ts", r("diff").alias("diff"))


@query(f"WITH {P1} SELECT series, ts, round(avg(value) OVER w, 6) AS mean FROM p1 WINDOW w AS (PARTITION BY series ORDER BY ts RANGE BETWEEN INTERVAL 86399 SECOND PRECEDING AND CURRENT ROW)")
def range_24h_mean(spark, sf):
    return sequence.time_mean(hourly(spark, sf), 86400).select("series", "ts", r("mean").alias("mean"))


#: Values are divided by a prime, so that no result lies on the edge of rounding.
FOLD = "WITH RECURSIVE {p2}, x AS (SELECT series, ts, value / 97 AS v, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM p2), f AS (SELECT series, ts, i, {first} AS y FROM x WHERE i = 1 UNION ALL SELECT x.series, x.ts, x.i, {step} FROM f JOIN x ON x.series = f.series AND x.i = f.i + 1) SELECT series, ts, round(y, 6) AS {name} FROM f"


@query(FOLD.format(p2=P2, first="v", step="0.15 * v + 0.85 * y", name="ewma"))
def ewma(spark, sf):
    return sequence.ewma(daily(spark, sf).withColumn("value", F.col("value") / 97)).select("series", "ts", r("ewma").alias("ewma"))


@query(FOLD.format(p2=P2, first="v", step="0.004 * v + 0.996 * y", name="ewma"))
def ewma_slow(spark, sf):
    """A long memory: rows a thousand back still count."""
    return sequence.ewma(daily(spark, sf).withColumn("value", F.col("value") / 97), 0.004).select("series", "ts", r("ewma").alias("ewma"))


@query(f"""WITH RECURSIVE {P2}, x AS (SELECT series, ts, CASE WHEN value % 3 > 0 THEN value / 97 END AS v, row_number() OVER (PARTITION BY series ORDER BY ts) AS i FROM p2),
f AS (SELECT series, ts, i, v AS y, 1.0::DOUBLE AS w FROM x WHERE i = 1 UNION ALL SELECT x.series, x.ts, x.i, CASE WHEN v IS NULL THEN y WHEN y IS NULL THEN v ELSE (0.85 * w * y + 0.15 * v) / (0.85 * w + 0.15) END, CASE WHEN v IS NULL AND y IS NOT NULL THEN 0.85 * w ELSE 1.0 END FROM f JOIN x ON x.series = f.series AND x.i = f.i + 1)
SELECT series, ts, round(y, 6) AS ewma FROM f""")
def ewma_known(spark, sf):
    """Nulls are skipped, but what was before them loses weight."""
    d = daily(spark, sf).withColumn("value", F.when(F.col("value") % 3 > 0, F.col("value") / 97))
    return sequence.ewma_known(d).select("series", "ts", r("ewma").alias("ewma"))


@query(FOLD.format(p2=P2, first="0.0::DOUBLE", step="greatest(0.0, 0.85 * y + v - 1.0002713::DOUBLE)", name="cusum"))
def cusum(spark, sf):
    return sequence.cusum(daily(spark, sf).withColumn("value", F.col("value") / 97), 1.0002713).select("series", "ts", r("cusum").alias("cusum"))


@query(FOLD.format(p2=P2, first="greatest(0.0, v - 1.0002713::DOUBLE)", step="greatest(0.0, 0.998 * y + v - 1.0002713::DOUBLE)", name="cusum"))
def cusum_slow(spark, sf):
    """Hardly any decay, the first row counts."""
    return sequence.cusum(daily(spark, sf).withColumn("value", F.col("value") / 97), 1.0002713, 0.998, False).select("series", "ts", r("cusum").alias("cusum"))


@query(f"WITH {P2} SELECT series, ts, CAST(sum(flag) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW) >= 6 AS BIGINT) AS vote FROM flagged")
def rolling_vote(spark, sf):
    return sequence.rolling_vote(flagged(spark, sf), F.col("flag") == 1, 12, 6).select("series", "ts", long_("vote"))


RUNS = f"WITH {P2}, g AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) - row_number() OVER (PARTITION BY series, flag ORDER BY ts) AS run FROM flagged)"


@query(RUNS + " SELECT series, min(ts) - INTERVAL 12 HOUR AS start_ts, max(ts) + INTERVAL 1 DAY AS end_ts, count(*) AS n_rows FROM g WHERE flag = 1 GROUP BY series, run HAVING count(*) >= 2")
def islands(spark, sf):
    return sequence.islands(flagged(spark, sf), "flag", 2, (43200, 86400))


MERGED = RUNS + """, m AS (SELECT *, count(*) OVER (PARTITION BY series, flag, run) AS c, min(ts) OVER (PARTITION BY series, flag, run) AS a, max(ts) OVER (PARTITION BY series, flag, run) AS b, min(ts) OVER (PARTITION BY series) AS lo, max(ts) OVER (PARTITION BY series) AS hi FROM g),
merged AS (SELECT series, ts, value, flag, CASE WHEN flag = 0 AND c <= 3 AND a > lo AND b < hi THEN 1 ELSE flag END AS merged FROM m),
e AS (SELECT *, CASE WHEN merged = 1 AND coalesce(lag(merged) OVER (PARTITION BY series ORDER BY ts), 0) = 0 THEN 1 ELSE 0 END AS rise FROM merged),
ids AS (SELECT series, ts, value, CASE WHEN merged = 1 THEN sum(rise) OVER (PARTITION BY series ORDER BY ts) ELSE 0 END AS event_id FROM e)"""


@query(MERGED + " SELECT series, ts, CAST(merged AS BIGINT) AS merged FROM merged")
def merge_gaps(spark, sf):
    return sequence.merge_gaps(flagged(spark, sf), "flag", 3).select("series", "ts", long_("merged"))


def events_of(spark, sf):
    return sequence.event_ids(sequence.merge_gaps(flagged(spark, sf), "flag", 3), "merged")


@query(MERGED + " SELECT series, ts, CAST(event_id AS BIGINT) AS event_id FROM ids")
def event_ids(spark, sf):
    return events_of(spark, sf).select("series", "ts", long_("event_id"))


@query(MERGED + " SELECT series, CAST(event_id AS BIGINT) AS event_id, min(ts) AS start_time, max(ts) AS end_time, CAST(date_diff('hour', min(ts), max(ts)) AS DOUBLE) AS duration_hours, arg_max(ts, (value, -epoch(ts))) AS peak_time, round(max(value), 6) AS peak_score FROM ids WHERE event_id > 0 GROUP BY series, event_id")
def event_summary(spark, sf):
    e = events_of(spark, sf).where("event_id > 0")
    secs = lambda c: F.unix_seconds(c.cast("timestamp"))
    return e.groupBy("series", F.col("event_id").cast("long").alias("event_id")).agg(F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), r((secs(F.max("ts")) - secs(F.min("ts"))) / 3600, 4).alias("duration_hours"), F.max_by("ts", F.struct("value", -secs(F.col("ts")))).alias("peak_time"), r(F.max("value")).alias("peak_score"))


HYST = """WITH RECURSIVE {p2}, n AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, flag = 1 AS st, value > 0.9 * avg(value) OVER (PARTITION BY series) AS ho FROM flagged),
f AS (SELECT series, ts, i, CAST(st AS INT) AS state, 0 AS quiet FROM n WHERE i = 1 UNION ALL
SELECT n.series, n.ts, n.i, CASE WHEN f.state = 0 THEN CAST(n.st AS INT) WHEN n.ho OR f.quiet + 1 < 3 THEN 1 ELSE 0 END, CASE WHEN f.state = 0 OR n.ho OR f.quiet + 1 >= 3 THEN 0 ELSE f.quiet + 1 END FROM f JOIN n ON n.series = f.series AND n.i = f.i + 1)
SELECT series, ts, CAST(state AS BIGINT) AS state FROM f"""


def hysteresis_rows(spark, sf):
    f = flagged(spark, sf)
    return f.select("series", "ts", (F.col("flag") == 1).alias("start"), (F.col("value") > 0.9 * F.avg("value").over(Window.partitionBy("series"))).alias("hold"))


@query(HYST.format(p2=P2))
def leak_state(spark, sf):
    return state.hysteresis(hysteresis_rows(spark, sf), 3).select("series", "ts", long_("state"))


@query(HYST.format(p2=P2).replace("f.quiet + 1 < 3", "f.quiet + 1 < 6").replace("f.quiet + 1 >= 3", "f.quiet + 1 >= 6"))
def leak_state_long_quiet(spark, sf):
    return state.hysteresis(hysteresis_rows(spark, sf), 6).select("series", "ts", long_("state"))


@query()
def triggers(spark, sf):
    """Stage-two triggers of the daily events: starts, rechecks after 5 days, shifts of the leading names."""
    names = scores.top_series(daily(spark, sf), "value", 3)
    rows = events_of(spark, sf).where("event_id > 0").join(names, "ts").select("series", "event_id", "ts", F.col("top").alias("names"))
    return state.schedule(rows, 5 * 86400, 2 * 86400, 0.5, ["series", "event_id"]).select("series", "event_id", "ts", "reason")


INTERVALS = RUNS + ", iv AS (SELECT min(ts) AS a, max(ts) AS b FROM g WHERE flag = 1 AND series = 'AF' GROUP BY run HAVING count(*) >= 2)"


def long_runs(spark, sf):
    return sequence.islands(flagged(spark, sf).where("series = 'AF'"), "flag", 2)


@query(INTERVALS + " SELECT series, ts, round(value, 6) AS value FROM p2 WHERE EXISTS (SELECT 1 FROM iv WHERE ts BETWEEN a AND b)")
def interval_semi(spark, sf):
    return relate.in_intervals(daily(spark, sf), long_runs(spark, sf)).select("series", "ts", r("value").alias("value"))


@query(INTERVALS + " SELECT series, ts, round(value, 6) AS value FROM p2 WHERE NOT EXISTS (SELECT 1 FROM iv WHERE ts BETWEEN a AND b)")
def interval_anti(spark, sf):
    return relate.in_intervals(daily(spark, sf), long_runs(spark, sf), True).select("series", "ts", r("value").alias("value"))


@query(RUNS + ", iv AS (SELECT series, min(ts) AS a, max(ts) AS b FROM g WHERE flag = 1 GROUP BY series, run HAVING count(*) >= 2) SELECT count(*) AS truth_events, count(*) FILTER (EXISTS (SELECT 1 FROM iv f WHERE f.series = 'RF' AND f.a <= t.b AND f.b >= t.a)) AS matched FROM iv t WHERE t.series = 'AF'")
def event_overlap_recall(spark, sf):
    runs = sequence.islands(flagged(spark, sf), "flag", 2).drop("n_rows")
    truth, found = runs.where("series = 'AF'"), runs.where("series = 'RF'")
    hit = relate.overlapped(truth, found).agg(F.count("*").alias("matched"))
    return truth.agg(F.count("*").alias("truth_events")).join(F.broadcast(hit))


CORR = "pr AS (SELECT a.series AS a, b.series AS b, coalesce(a.value, 0) AS x, coalesce(b.value, 0) AS y FROM p1 a JOIN p1 b ON a.ts = b.ts AND a.series <> b.series), co AS (SELECT a, b, coalesce(corr(x, y), 0) AS r FROM pr GROUP BY a, b)"


@query(f"WITH {P1}, {CORR} SELECT a, b, round(r, 6) AS r FROM co")
def pairwise_corr(spark, sf):
    return relate.correlations(hourly(spark, sf)).select("a", "b", r("r").alias("r"))


@query(f"WITH {P1}, {CORR} SELECT a AS series, round(sum(abs(r)) / (SELECT count(DISTINCT series) FROM p1), 6) AS centrality FROM co GROUP BY a")
def centrality(spark, sf):
    return relate.centrality(hourly(spark, sf)).select("series", r("centrality").alias("centrality"))


@query(f"WITH {P1}, m AS (SELECT a.series AS target, b.series AS anchor, count(*) AS n, covar_pop(a.value, b.value) AS c, var_pop(b.value) AS v, avg(a.value) AS mx, avg(b.value) AS my FROM p1 a JOIN p1 b ON a.ts = b.ts AND a.series <> b.series WHERE a.value IS NOT NULL AND b.value IS NOT NULL GROUP BY ALL) SELECT target, anchor, n, round(c * n / (v * n + 0.001), 6) AS slope, round(mx - c * n / (v * n + 0.001) * my, 6) AS intercept FROM m WHERE n >= 8")
def pairwise_slope(spark, sf):
    return relate.ridge_lines(hourly(spark, sf)).select("target", "anchor", "n", r("slope").alias("slope"), r("intercept").alias("intercept"))


@query()
def robust_regression(spark, sf):
    """Trimmed Huber regressions of each series on its nearest ones; tests compare them with plain NumPy."""
    p = hourly(spark, sf)
    near = relate.top_anchors(p, 3).select(F.col("a").alias("model"), F.col("a").alias("target"), F.col("b").alias("feature"))
    return relate.robust_models(p, near, steps=15).select("target", F.array_join("features", ",").alias("features"), F.transform("beta", lambda b: F.round(b, 4)).alias("beta"), r("sigma", 4).alias("sigma"))


@query(f"WITH {P2}, q AS (SELECT series, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM p2 GROUP BY series) SELECT p2.series, count(*) AS n, round(avg(CAST((value - lo) / (hi - lo) <= 0.15 OR (value - lo) / (hi - lo) >= 0.85 AS INT)), 6) AS at_edges, round(count(DISTINCT round(value, 2)) / count(*), 6) AS distinct_share FROM p2 JOIN q USING (series) GROUP BY p2.series")
def binary_like(spark, sf):
    return audit.binary_like(daily(spark, sf)).select("series", "n", r("at_edges").alias("at_edges"), r("distinct_share").alias("distinct_share"))


@query(f"""WITH {P2}, x AS (SELECT *, row_number() OVER (PARTITION BY series ORDER BY ts) AS i, (value + lag(value) OVER (PARTITION BY series ORDER BY ts)) / 2 * 5 AS pr FROM p2)
SELECT series, ts, round(avg(value) OVER w, 4) AS mean, round(stddev_pop(value) OVER w, 4) AS std, round(min(value) OVER w, 4) AS min, round(max(value) OVER w, 4) AS max, round(quantile_cont(value, 0.5) OVER w, 4) AS median, round(quantile_cont(value, 0.1) OVER w, 4) AS q10, round(quantile_cont(value, 0.9) OVER w, 4) AS q90,
round(CASE WHEN i = 1 THEN 0.0 ELSE regr_slope(value, i) OVER w END, 4) AS slope, round(value - first_value(value) OVER w, 4) AS delta, round(coalesce(sum(pr) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 10 PRECEDING AND CURRENT ROW), 0.0), 4) AS auc
FROM x WINDOW w AS (PARTITION BY series ORDER BY ts ROWS BETWEEN 11 PRECEDING AND CURRENT ROW)""")
def packet_stats(spark, sf):
    s = sequence.trailing_stats(daily(spark, sf), 12, dx=5.0)
    return s.select("series", "ts", *[r(c, 4).alias(c) for c in ("mean", "std", "min", "max", "median", "q10", "q90", "slope", "delta", "auc")])


@query(f"WITH {P2} SELECT ts, round(sum(value), 4) AS total, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS std, round(max(value), 4) AS max, round(median(value), 4) AS median, round(sum(value * value) / (sum(value) * sum(value)), 6) AS hhi, abs(round(ln(sum(value)) - sum(value * ln(value)) / sum(value), 6)) AS entropy FROM p2 GROUP BY ts")
def cross_section_hhi_entropy(spark, sf):
    c = scores.concentration(daily(spark, sf))
    return c.select("ts", *[r(x, 4).alias(x) for x in ("total", "mean", "std", "max", "median")], r("hhi").alias("hhi"), F.abs(r("entropy")).alias("entropy"))


@query("SELECT event_id, user_id, count(*) OVER w AS n_so_far, round(max(value) OVER w, 6) AS max_so_far, round(avg(value) OVER w, 6) AS mean_so_far FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING)")
def event_context(spark, sf):
    c = sequence.running_context(read(spark, sf, "events"), "value", ["user_id"])
    return c.select("event_id", "user_id", "n_so_far", r("max_so_far").alias("max_so_far"), r("mean_so_far").alias("mean_so_far"))


@query("SELECT event_id, CAST(row_number() OVER w AS BIGINT) AS trigger_order, CAST(row_number() OVER w - 1 AS BIGINT) AS prior, round(coalesce((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 60e6, -1.0), 4) AS minutes_since FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)")
def trigger_order(spark, sf):
    return sequence.order_context(read(spark, sf, "events"), ["user_id"]).select("event_id", long_("trigger_order"), long_("prior"), r("minutes_since", 4).alias("minutes_since"))


@query("""WITH x AS (SELECT event_id, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS k, count(*) OVER (PARTITION BY event_type) AS n FROM events),
y AS (SELECT *, greatest(1, round_even(n * 0.6, 0)) AS a, greatest(1, round_even(n * 0.2, 0)) AS b FROM x)
SELECT event_id, CASE WHEN k <= a THEN 'train' WHEN k <= a + CASE WHEN a + b >= n THEN greatest(1, n - a - 1) ELSE b END THEN 'cal' ELSE 'val' END AS split FROM y""")
def threeway_split(spark, sf):
    return packets.split_three(read(spark, sf, "events"), "event_type", ["ts"]).select("event_id", "split")


@query("SELECT event_id, CAST(ntile(3) OVER (PARTITION BY event_type ORDER BY ts) AS BIGINT) AS part FROM events")
def ntile_split(spark, sf):
    return packets.thirds(read(spark, sf, "events"), "event_type", ["ts"]).select("event_id", long_("part"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY month(ts), hour(ts) ORDER BY (event_id * 7919) % 10007, event_id) AS k, count(*) OVER (PARTITION BY month(ts), hour(ts)) AS n FROM events) WHERE k <= round_even(n * 0.35, 0)")
def stratified_sample(spark, sf):
    e = read(spark, sf, "events").withColumn("m", F.month("ts")).withColumn("h", F.hour("ts"))
    return packets.stratified(e, ["m", "h"], [(F.col("event_id") * 7919) % 10007, "event_id"], 0.35).select("event_id")


@query(f"WITH {P2} SELECT series, ts, value >= max(value) OVER (PARTITION BY series ORDER BY ts ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) - 1e-12 AS is_peak FROM p2")
def local_peaks(spark, sf):
    return sequence.local_peaks(daily(spark, sf)).select("series", "ts", "is_peak")


@query()
def peak_suppression(spark, sf):
    p = sequence.local_peaks(daily(spark, sf)).where("is_peak").drop("is_peak")
    return state.suppress_peaks(p, 12 * 86400, 40)


def judged(spark, sf):
    d = read(spark, sf, "events").select("event_id", "event_type", (F.col("value") / 1000).alias("score"), (F.pmod("event_id", F.lit(3)) == 0).cast("int").alias("y"))
    return d.withColumn("call", (F.col("score") >= 0.05).cast("int"))


J = "j AS (SELECT event_id, event_type, value / 1000 AS score, CAST(event_id % 3 = 0 AS INT) AS y, CAST(value / 1000 >= 0.05 AS INT) AS call FROM events)"


@query(f"WITH {J} SELECT event_type, count(*) FILTER (y = 1 AND call = 1) AS tp, count(*) FILTER (y = 0 AND call = 1) AS fp, count(*) FILTER (y = 1 AND call = 0) AS fn, count(*) FILTER (y = 0 AND call = 0) AS tn, round(coalesce(count(*) FILTER (y = 1 AND call = 1) / nullif(count(*) FILTER (y = 1), 0), 0), 6) AS recall, round(coalesce(count(*) FILTER (y = 1 AND call = 1) / nullif(count(*) FILTER (call = 1), 0), 0), 6) AS precision, round(coalesce(count(*) FILTER (y = 0 AND call = 1) / nullif(count(*) FILTER (y = 0), 0), 0), 6) AS fpr FROM j GROUP BY event_type")
def confusion_metrics(spark, sf):
    c = metrics.confusion(judged(spark, sf), "y", "call", ["event_type"])
    return c.select("event_type", "tp", "fp", "fn", "tn", *[r(x).alias(x) for x in ("recall", "precision", "fpr")])


@query("""WITH d AS (SELECT date_trunc('day', ts) AS d, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1), s AS (SELECT min(ts) AS a, max(ts) AS b FROM events)
SELECT round((SELECT sum(n) FROM d) / ((epoch_us(b) - epoch_us(a)) / 86400e6), 6) AS per_elapsed_day, round((SELECT avg(n) FROM d), 6) AS per_active_day, round((SELECT sum(n) FROM d) / (date_diff('day', date_trunc('day', a), date_trunc('day', b)) + 1), 6) AS per_calendar_day FROM s""")
def calls_per_day(spark, sf):
    """Three rates: per elapsed day, per day with calls, per calendar day."""
    e = read(spark, sf, "events")
    span = e.agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    d = e.where("event_type = 'error'").groupBy(F.date_trunc("day", "ts").alias("d")).agg(F.count("*").alias("n")).agg(F.sum("n").alias("n"), F.avg("n").alias("m"))
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return span.join(F.broadcast(d)).select(r(F.col("n") / ((us("b") - us("a")) / 86400e6)).alias("per_elapsed_day"), r("m").alias("per_active_day"), r(F.col("n") / (F.datediff("b", "a") + 1)).alias("per_calendar_day"))


CUM = f"WITH {J}, g AS (SELECT event_type, score, sum(y) AS y, count(*) AS c FROM j GROUP BY ALL), t AS (SELECT event_type, score, y, c, sum(y) OVER w AS tp, sum(c) OVER w AS n, sum(y) OVER (PARTITION BY event_type) AS pos, sum(c) OVER (PARTITION BY event_type) AS total FROM g WINDOW w AS (PARTITION BY event_type ORDER BY score DESC))"


@query(CUM + ", u AS (SELECT event_type, score AS threshold, tp / n AS p, tp / pos AS rec FROM t WHERE pos > 0), v AS (SELECT *, coalesce(2 * p * rec / nullif(p + rec, 0), 0) AS f1 FROM u WHERE rec >= 0.95) SELECT event_type, round(threshold, 6) AS threshold, round(p, 6) AS precision, round(rec, 6) AS recall FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY p DESC, f1 DESC, threshold DESC) AS k FROM v) WHERE k = 1")
def threshold_search(spark, sf):
    return metrics.best_threshold(judged(spark, sf), "score", "y", "event_type").select("event_type", r("threshold").alias("threshold"), r("precision").alias("precision"), r("recall").alias("recall"))


@query(CUM + ", a AS (SELECT event_type, sum(y * tp / n) / any_value(pos) AS ap, sum((tp - y / 2) * (c - y)) / (any_value(pos) * any_value(total - pos)) AS auc FROM t GROUP BY event_type) SELECT a.event_type, round(ap, 6) AS average_precision, round(auc, 6) AS roc_auc, round(b.brier, 6) AS brier FROM a JOIN (SELECT event_type, avg(pow(score - y, 2)) AS brier FROM j GROUP BY 1) b USING (event_type)")
def ranking_metrics(spark, sf):
    return metrics.ranking(judged(spark, sf), "score", "y", "event_type").select("event_type", *[r(x).alias(x) for x in ("average_precision", "roc_auc", "brier")])


@query(CUM + " SELECT event_type, round(coalesce(max(tp / pos) FILTER (tp / n >= 0.35), 0), 6) AS recall_at_precision FROM t GROUP BY event_type")
def recall_at_precision(spark, sf):
    return metrics.recall_at_precision(judged(spark, sf), "score", "y", "event_type", 0.35).select("event_type", r("recall_at_precision").alias("recall_at_precision"))


@query(f"WITH {J}, e AS (SELECT quantile_cont(score, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS q FROM j) SELECT CAST(len(list_filter(q, lambda x: x <= score)) AS BIGINT) AS bin, count(*) AS n, round(avg(score), 6) AS mean_score, round(avg(y), 6) AS rate FROM j, e GROUP BY 1")
def calibration_curve(spark, sf):
    return metrics.calibration(judged(spark, sf), "score", "y").select(long_("bin"), "n", r("mean_score").alias("mean_score"), r("rate").alias("rate"))


@query("""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, unnest(range(64)) AS i FROM embeddings), s AS (SELECT i, avg(v) AS m, stddev_pop(v) AS sd FROM x GROUP BY i),
z AS (SELECT vec_id, label, i, (v - m) / CASE WHEN sd > 0 THEN sd ELSE 1 END AS z FROM x JOIN s USING (i)), o AS (SELECT label AS cls, i, sum(z) AS s, count(*) AS n FROM z GROUP BY ALL), al AS (SELECT i, sum(z) AS s, count(*) AS n FROM z GROUP BY i),
c AS (SELECT cls, i, o.s / o.n AS pos, (al.s - o.s) / greatest(al.n - o.n, 1) AS neg FROM o JOIN al USING (i)), d AS (SELECT vec_id, label, cls, sum(pow(z - neg, 2) - pow(z - pos, 2)) / 64 AS g FROM z JOIN c USING (i) GROUP BY ALL)
SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(cls AS BIGINT) AS cls, round(1 / (1 + exp(-g)), 6) AS p FROM d""")
def prototype_localizer(spark, sf):
    return heads.prototypes(read(spark, sf, "embeddings"), "vec_id", "embedding", "label").select("vec_id", long_("label"), long_("cls"), r("p").alias("p"))


@query(SQL["prototype_localizer"].replace("SELECT vec_id, CAST(label AS BIGINT) AS label, CAST(cls AS BIGINT) AS cls, round(1 / (1 + exp(-g)), 6) AS p FROM d", ", k AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(1 / (1 + exp(-g)), 9) DESC, cls) AS k FROM d) SELECT count(*) FILTER (k = 1 AND cls = label) / count(DISTINCT vec_id) AS top1, count(*) FILTER (k <= 3 AND cls = label) / count(DISTINCT vec_id) AS top3 FROM k"))
def topk_hit_rate(spark, sf):
    p = heads.prototypes(read(spark, sf, "embeddings"), "vec_id", "embedding", "label")
    k = p.withColumn("k", F.row_number().over(Window.partitionBy("vec_id").orderBy(F.round("p", 9).desc(), "cls")))
    hit = F.col("cls") == F.col("label")
    n = F.count_distinct("vec_id")
    return k.agg((F.count_if(hit & (F.col("k") == 1)) / n).alias("top1"), (F.count_if(hit & (F.col("k") <= 3)) / n).alias("top3"))


@query(f"WITH {J} SELECT event_type, count(*) FILTER (call = 1) AS accepted, count(*) FILTER (call = 0) AS rejected, round(count(*) FILTER (call = 1) / count(*), 6) AS accepted_fraction FROM j GROUP BY event_type")
def reason_crosstab(spark, sf):
    t = judged(spark, sf).groupBy("event_type").pivot("call", [0, 1]).count().na.fill(0)
    return t.select("event_type", F.col("1").alias("accepted"), F.col("0").alias("rejected"), r(F.col("1") / (F.col("0") + F.col("1"))).alias("accepted_fraction"))


@query("SELECT event_id, round(n / (k * c), 6) AS weight FROM (SELECT event_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY event_type) AS c, (SELECT count(DISTINCT event_type) FROM events) AS k FROM events)")
def class_weights(spark, sf):
    return packets.class_weights(read(spark, sf, "events"), "event_type").select("event_id", r("weight").alias("weight"))


@query("SELECT event_id, round(n / (k * c), 6) AS weight FROM (SELECT event_id, count(*) OVER () AS n, count(*) OVER (PARTITION BY user_id) AS c, (SELECT count(DISTINCT user_id) FROM events) AS k FROM events)")
def signature_weights(spark, sf):
    return packets.signature_weights(read(spark, sf, "events"), "user_id").select("event_id", r("weight").alias("weight"))


@query(f"WITH {P2}, x AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY series ORDER BY ts)) AS gap FROM p2) SELECT series, count(*) AS n_rows, min(ts) AS first_ts, max(ts) AS last_ts, count(*) FILTER (gap <> 86400) AS odd_gaps, CAST((epoch(max(ts)) - epoch(min(ts))) / 86400 + 1 AS BIGINT) AS expected FROM x GROUP BY series")
def quality_audit(spark, sf):
    return audit.overview(daily(spark, sf), "ts", 86400, ["series"]).select("series", "n_rows", "first_ts", "last_ts", "odd_gaps", long_("expected"))


@query(" UNION ALL ".join(f"SELECT '{c}' AS name, count({c}) AS n, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS n_distinct, round(avg({c}), 4) AS mean, round(stddev_samp({c}), 4) AS std, min({c}) + 0.0 AS min, max({c}) + 0.0 AS max FROM lineitem" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")))
def column_profile(spark, sf):
    p = audit.column_profile(read(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])
    return p.select("name", "n", "nulls", "n_distinct", r("mean", 4).alias("mean"), r("std", 4).alias("std"), "min", "max")


@query("SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, max(o_totalprice) AS top FROM orders GROUP BY 1")
def monthly_rollup(spark, sf):
    return read(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"), r(F.avg("o_totalprice"), 4).alias("mean"), F.max("o_totalprice").alias("top"))


@query("SELECT o_orderpriority, count(*) AS n, round(avg(o_totalprice), 4) AS mean, round(median(o_totalprice), 4) AS median, min(o_totalprice) AS min, max(o_totalprice) AS max FROM orders GROUP BY 1")
def group_stats(spark, sf):
    v = "o_totalprice"
    return read(spark, sf, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"), r(F.avg(v), 4).alias("mean"), r(F.percentile(v, F.lit(0.5)), 4).alias("median"), F.min(v).alias("min"), F.max(v).alias("max"))


@query("SELECT o_orderstatus, count(*) AS n, round(count(*) * 100.0 / (SELECT count(*) FROM orders), 4) AS pct FROM orders GROUP BY 1")
def value_counts(spark, sf):
    return audit.value_share(read(spark, sf, "orders"), "o_orderstatus").select("o_orderstatus", "n", r("pct", 4).alias("pct"))


@query("WITH b AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT CAST(least(floor((o_totalprice - lo) * 40 / (hi - lo)), 39) AS BIGINT) AS bin, count(*) AS n FROM orders, b GROUP BY 1")
def histogram(spark, sf):
    return audit.histogram(read(spark, sf, "orders"), "o_totalprice", 40)


@query("SELECT hour(ts) AS hour, round(avg(value), 6) AS mean, count(*) AS n FROM events GROUP BY 1")
def hourly_profile(spark, sf):
    return read(spark, sf, "events").groupBy(F.hour("ts").cast("long").alias("hour")).agg(r(F.avg("value")).alias("mean"), F.count("*").alias("n"))


@query("SELECT event_id, year(ts) AS year, strftime(ts, '%Y-%m') AS year_month, hour(ts) AS hour, isodow(ts) - 1 AS dow, month(ts) AS month, isodow(ts) >= 6 AS is_weekend FROM events")
def calendar_features(spark, sf):
    t = F.col("ts")
    return read(spark, sf, "events").select("event_id", F.year(t).cast("long").alias("year"), F.date_format(t, "yyyy-MM").alias("year_month"), F.hour(t).cast("long").alias("hour"), F.weekday(t).cast("long").alias("dow"), F.month(t).cast("long").alias("month"), (F.weekday(t) >= 5).alias("is_weekend"))


@query("SELECT event_id, round(sin(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS hour_sin, round(cos(2 * pi() * (hour(ts) + minute(ts) / 60) / 24), 6) AS hour_cos, round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS dow_sin, CAST(hour(ts) < 6 AS BIGINT) AS is_night FROM events")
def cyclic_calendar(spark, sf):
    c = scalar.cyclic("ts")
    return read(spark, sf, "events").select("event_id", r(c["hour_sin"]).alias("hour_sin"), r(c["hour_cos"]).alias("hour_cos"), r(c["dow_sin"]).alias("dow_sin"), c["is_night"].cast("long").alias("is_night"))


WIDE = f"WITH {P2}, w AS (SELECT ts, sum(value) FILTER (series = 'AF') AS pipe_1, sum(value) FILTER (series = 'NO') AS pipe_2, sum(value) FILTER (series = 'RF') AS pipe_3 FROM p2 GROUP BY ts)"


def pipes(spark, sf):
    w = panel.wide(daily(spark, sf), ["AF", "NO", "RF"])
    return w.toDF("ts", "pipe_1", "pipe_2", "pipe_3")


@query(WIDE + " SELECT ts, round(coalesce(pipe_1, 0) + coalesce(pipe_2, 0) + coalesce(pipe_3, 0), 4) AS leak_mag_total, CAST(coalesce(CAST(pipe_1 > 0 AS INT), 0) + coalesce(CAST(pipe_2 > 0 AS INT), 0) + coalesce(CAST(pipe_3 > 0 AS INT), 0) AS BIGINT) AS leak_count, concat(coalesce(CAST(pipe_1 > 0 AS INT), 0), coalesce(CAST(pipe_2 > 0 AS INT), 0), coalesce(CAST(pipe_3 > 0 AS INT), 0)) AS pipe_state FROM w")
def label_build(spark, sf):
    t = tables.label_columns(pipes(spark, sf), ["pipe_1", "pipe_2", "pipe_3"])
    return t.select("ts", r("leak_mag_total", 4).alias("leak_mag_total"), long_("leak_count"), F.concat("pipe_1_bin", "pipe_2_bin", "pipe_3_bin").alias("pipe_state"))


ORD = "o AS (SELECT CAST(date_trunc('day', o_orderdate) AS TIMESTAMP) AS ts, count(*) AS orders FROM orders GROUP BY 1)"


def orders_by_day(spark, sf):
    return read(spark, sf, "orders").groupBy(F.date_trunc("day", "o_orderdate").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("orders"))


@query(WIDE + f", {ORD} SELECT w.ts, round(pipe_1, 4) AS pipe_1, round(pipe_2, 4) AS pipe_2, orders FROM w LEFT JOIN o ON w.ts = o.ts")
def left_align_join(spark, sf):
    return panel.align([pipes(spark, sf), orders_by_day(spark, sf)], "ts", "left").select("ts", r("pipe_1", 4).alias("pipe_1"), r("pipe_2", 4).alias("pipe_2"), "orders")


@query(WIDE + f", {ORD} SELECT coalesce(w.ts, o.ts) AS ts, round(pipe_1, 4) AS pipe_1, orders FROM w FULL JOIN o ON w.ts = o.ts")
def outer_align_join(spark, sf):
    return panel.align([pipes(spark, sf), orders_by_day(spark, sf)], "ts", "full").select("ts", r("pipe_1", 4).alias("pipe_1"), "orders")


@query("SELECT CAST(day(ts) AS BIGINT) AS day, min(event_id) AS event_id FROM (SELECT ts, event_id, row_number() OVER (PARTITION BY day(ts) ORDER BY ts, event_id) AS k FROM events) WHERE k = 1 GROUP BY 1")
def dedupe_keep_first(spark, sf):
    e = read(spark, sf, "events").withColumn("day", F.day("ts").cast("long"))
    return panel.dedupe_first(e, ["day"], ["ts", "event_id"]).select("day", "event_id")


@query("WITH p AS (SELECT event_type, count(*) AS n, count(*) FILTER (event_id % 3 = 0) AS pos FROM events GROUP BY 1) SELECT event_type, n, pos, round(pos / n, 6) AS rate FROM p")
def packet_summary(spark, sf):
    return judged(spark, sf).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("y").alias("pos"), r(F.avg("y")).alias("rate"))


@query("WITH m AS (SELECT event_type, max(abs(value)) / 32767 AS scale FROM events GROUP BY 1) SELECT event_id, CAST(round_even(value / scale, 0) AS BIGINT) AS q, round(scale, 9) AS scale FROM events JOIN m USING (event_type)")
def quantize_int16(spark, sf):
    return export.quantise(read(spark, sf, "events"), "event_type", "value").select("event_id", long_("q"), r("scale", 9).alias("scale"))


def learnable(spark, sf):
    e = packets.split_three(read(spark, sf, "events"), "event_type", ["ts"])
    f = scalar.cyclic("ts")
    e = e.select("event_id", "split", "value", *[x.cast("double").alias(k) for k, x in f.items()], (F.col("event_type") == "purchase").cast("double").alias("is_purchase"))
    return Scratch(spark).cut(e.withColumn("y", (F.col("value") * (1 + F.col("is_purchase")) > 60).cast("double")))


FEATURES = ["value", "is_purchase", "hour_sin", "hour_cos", "is_night"]


@query()
def logistic_head(spark, sf):
    d = learnable(spark, sf)
    return heads.logistic_head(d.where("split = 'train'"), d.where("split <> 'train'"), FEATURES).select("event_id", "split", "y", r("p", 3).alias("p"))


@query()
def gbt_head_calibrated(spark, sf):
    d = learnable(spark, sf)
    p = heads.boosted_head(d.where("split = 'train'"), d.where("split <> 'train'"), FEATURES, rounds=10)
    return heads.calibrated(p.where("split = 'cal'"), p.where("split = 'val'")).select("event_id", "y", r("p", 3).alias("p"), r("p_cal", 3).alias("p_cal"))


@query()
def ovr_localizer(spark, sf):
    d = learnable(spark, sf).withColumn("pipe_a", F.col("y")).withColumn("pipe_b", (F.col("value") > 90).cast("double"))
    return heads.one_versus_rest(d.where("split = 'train'"), d.where("split = 'val'"), FEATURES, ["pipe_a", "pipe_b"]).select("event_id", r("p_pipe_a", 3).alias("p_a"), r("p_pipe_b", 3).alias("p_b"))


@query()
def kept_heads(spark, sf):
    """Coefficients of two labels' heads on raw features, fitted together with weights of label signatures times balance, calibration folded in."""
    d = learnable(spark, sf).withColumn("pipe_a", F.col("y")).withColumn("pipe_b", (F.col("value") > 90).cast("double")).withColumn("signature", F.concat_ws("|", "pipe_a", "pipe_b"))
    train = packets.signature_weights(d.where("split = 'train'"), "signature")
    k = linear.fit(train, FEATURES, ["pipe_a", "pipe_b"], "weight", True, d.where("split = 'cal'"))
    return k.select("label", "feature", r("weight", 4).alias("weight"))


@query()
def principal_components(spark, sf):
    p = heads.principal(read(spark, sf, "embeddings"), "embedding")
    return p.select("vec_id", r(F.abs(F.col("pc")[0]), 3).alias("pc1"), r(F.abs(F.col("pc")[1]), 3).alias("pc2"))
