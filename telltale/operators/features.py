"""Features of lookback packets: what was seen in the rows before each trigger, in long form (trigger, feature, value)."""

import inspect
import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.functions import scalar
from telltale.scratch import Scratch

STATS = ("last", "mean", "std", "min", "max", "median", "q10", "q90", "slope", "delta", "auc")
HORIZONS = (12, 36, 72, 144)
#: Families of features by how their names begin (fixed values).
FAMILIES = (("raw|", "raw"), ("demand|", "demand"), ("stage1|", "stage1"), ("sensor|", "sensor"), ("summary|", "sensor_summary"), ("top|", "top_sensors"), ("reason_", "metadata"), ("area_", "metadata"), ("trigger_", "metadata"), ("hour_", "calendar"), ("dow_", "calendar"), ("month_", "calendar"), ("is_", "calendar"), ("event_", "event"))


def positions(panel: DataFrame, order: str = "ts") -> DataFrame:
    """ts, pos: each time's number on the grid of all times."""
    return panel.select(order).distinct().withColumn("__one", F.lit(1)).withColumn("pos", F.row_number().over(Window.partitionBy("__one").orderBy(order)).cast("long")).drop("__one")


def at_rows(triggers: DataFrame, times: DataFrame) -> DataFrame:
    """Triggers with their row (pos); those at no row are left out."""
    return triggers.join(times, "ts")


def packets(triggers: DataFrame, rows: DataFrame, lookback: int) -> DataFrame:
    """trigger (its ts), at (its pos), back (0 for its own row), and all columns of the last `lookback` rows.

    Rows and triggers meet by blocks of `lookback` positions (packets_by_block).
    """
    return packets_by_block(triggers, rows, lookback).drop("__block")


def packets_by_block(triggers: DataFrame, rows: DataFrame, lookback: int) -> DataFrame:
    """packets() with `__block`, the trigger's block of `lookback` positions, by which they are partitioned: what is grouped by it and by trigger moves no more.

    A row goes to its block and the next, if these have triggers, so rows without triggers near go nowhere. Rows are
    dealt before they become many packets' rows: few bytes of rows would otherwise be one task, and a series one at most.
    """
    t = triggers.select(F.col("ts").alias("trigger"), F.col("pos").alias("at")).distinct().withColumn("__block", F.floor(F.col("at") / lookback))
    own = F.floor(F.col("pos") / lookback)
    r = rows.withColumn("__block", F.explode(F.array(own, own + 1))).join(t.select("__block").distinct(), "__block", "left_semi")
    # both, because either may be the broadcast one
    r, t = (x.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__block") for x in (r, t))
    near = F.col("pos").between(F.col("at") - (lookback - 1), F.col("at"))
    return r.join(t, "__block").where(near).withColumn("back", F.col("at") - F.col("pos"))


def packet_summaries(triggers: DataFrame, panel: DataFrame, times: DataFrame, horizons=HORIZONS, step: float = 5.0) -> DataFrame:
    """trigger, series, horizon and the eleven statistics of each series over the last rows before each trigger (fewer at the start)."""
    w = Window.partitionBy("series").orderBy("pos")
    rows = panel.join(times, "ts").withColumn("pair", (F.col("value") + F.lag("value").over(w)) / 2 * F.lit(step))
    p = packets_by_block(at_rows(triggers, times), rows, max(horizons)).withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).where("back < horizon")
    v, x = F.col("value"), F.col("pos").cast("double")
    known = F.when(v.isNotNull(), F.col("pos"))
    first_last = F.max_by(v, known) - F.min_by(v, known)
    inner = F.when(F.col("back") < F.col("horizon") - 1, F.col("pair"))
    told = p.groupBy("__block", "trigger", "series", "horizon").agg(
        F.max_by(v, known).alias("last"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"), F.percentile(v, F.array(F.lit(0.5), F.lit(0.1), F.lit(0.9))).alias("q"),
        F.when(F.count(v) > 0, F.coalesce(F.regr_slope(v, x), F.lit(0.0))).alias("slope"), first_last.alias("delta"), F.when(F.count(v) > 0, F.coalesce(F.sum(inner), F.lit(0.0))).alias("auc"),
    )
    # one table of values gives all three quantiles
    quantiles = [F.get("q", F.lit(i)).alias(c) for i, c in enumerate(("median", "q10", "q90"))]
    return told.select("trigger", "series", "horizon", "last", "mean", "std", "min", "max", *quantiles, "slope", "delta", "auc")


def long_features(summaries: DataFrame, family: str) -> DataFrame:
    """trigger, feature, value: one row for each statistic."""
    names = F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("v")) for s in STATS])).alias("x")
    return summaries.select("trigger", "series", "horizon", names).select("trigger", F.concat_ws("|", F.lit(family), "series", F.col("horizon").cast("string"), "x.s").alias("feature"), F.col("x.v").alias("value"))


def top_stability(triggers: DataFrame, tops: DataFrame, times: DataFrame, lookback: int, k: int = 3) -> DataFrame:
    """trigger, top1_share, top3_jaccard: how often the leading name led before, and the mean likeness of the leading three (0 for two empty sets)."""
    p = packets(at_rows(triggers, times), tops.join(times, "ts"), lookback)
    now = tops.select(F.col("ts").alias("trigger"), F.slice("top", 1, k).alias("now"))
    t = p.join(now, "trigger").withColumn("old", F.slice("top", 1, k))
    first = lambda c: F.coalesce(F.try_element_at(c, F.lit(1)), F.lit(""))
    alike = F.coalesce(F.try_divide(F.size(F.array_intersect("old", "now")), F.size(F.array_union("old", "now"))), F.lit(0.0))
    return t.groupBy("trigger").agg(F.avg((first("old") == first("now")).cast("double")).alias("top1_share"), F.avg(alike).alias("top3_jaccard"))


def top_history(triggers: DataFrame, tops: DataFrame, times: DataFrame, lookback: int) -> DataFrame:
    """trigger, series, times_in_top, rank_weight (sum of 1 / rank), now_weight, now_rank (0 where it is not in the top now)."""
    p = packets_by_block(at_rows(triggers, times), tops.join(times, "ts"), lookback)
    e = p.select("__block", "trigger", "back", F.posexplode("top").alias("i", "series")).withColumn("w", 1.0 / (F.col("i") + 1))
    now = F.col("back") == 0
    return e.groupBy("__block", "trigger", "series").agg(F.count("*").alias("times_in_top"), F.sum("w").alias("rank_weight"), F.sum(F.when(now, F.col("w")).otherwise(0.0)).alias("now_weight"), F.sum(F.when(now, F.col("i") + 1).otherwise(0)).cast("long").alias("now_rank")).drop("__block")


def vocabulary(train: DataFrame, columns: list[str]) -> dict[str, list[str]]:
    """The values that training triggers have; null is `unknown`."""
    return {c: sorted(r[0] for r in train.select(F.coalesce(c, F.lit("unknown"))).distinct().collect()) for c in columns}


def one_hot(df: DataFrame, words: dict[str, list[str]]) -> DataFrame:
    """Adds <column>_<value> (0 or 1) for each known value."""
    return df.select("*", *[(F.coalesce(c, F.lit("unknown")) == v).cast("double").alias(f"{c}_{v}") for c, values in words.items() for v in values])


def named_values(df: DataFrame, family: str) -> DataFrame:
    """trigger, feature (<family>|<column>), value of all other columns."""
    names = [c for c in df.columns if c != "trigger"]
    long = df.select("trigger", *[F.col(c).cast("double").alias(c) for c in names]).unpivot(["trigger"], names, "s", "value")
    return long.select("trigger", F.concat_ws("|", F.lit(family), "s").alias("feature"), "value")


def cross_section(triggers: DataFrame, panel: DataFrame) -> DataFrame:
    """trigger and the mean, deviation, maximum, median and 0.9 quantile of all series at its own time."""
    own = triggers.select(F.col("ts").alias("trigger"), "ts").distinct().join(panel, "ts")
    q = lambda a: F.percentile("value", F.lit(a))
    return own.groupBy("trigger").agg(F.avg("value").alias("now_mean"), F.stddev_pop("value").alias("now_std"), F.max("value").alias("now_max"), q(0.5).alias("now_median"), q(0.9).alias("now_q90"))


def sensor_summary(triggers: DataFrame, evidence: DataFrame, lead: DataFrame, times: DataFrame, lookback: int, names: int = 5) -> DataFrame:
    """One row for each trigger: what all sensors (series, ts, value; null is 0) say at its time.

    max, mean, std, the greatest three and the gap of the first two, entropy and concentration of shares, the leader's
    share, how often the leader led in the lookback and how alike the leading three were, and the places (from 1) of the
    names that `lead` (ts, top) gives; a name that isn't there is one behind the last. Ties go by name.
    """
    from telltale.operators import scores

    known = evidence.withColumn("value", F.coalesce(F.nanvl("value", F.lit(0.0)), F.lit(0.0)))
    own = scores.ranked(known.join(triggers.select("ts").distinct(), "ts", "left_semi"), "value").join(lead, "ts", "left")
    at = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("value"))), F.lit(0.0))
    total, n = F.sum("value"), F.count("*")
    place = lambda k: F.coalesce(F.max(F.when(F.col("series") == F.get("top", F.lit(k - 1)), F.col("rank"))), n + 1).cast("double")
    now = own.groupBy("ts").agg(
        at(1).alias("max"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"), *[at(k).alias(f"top{k}") for k in (1, 2, 3)],
        F.when(n > 1, at(1) - at(2)).otherwise(0.0).alias("gap12"), F.when(total > 0, at(1) / total).otherwise(0.0).alias("top1_share_now"), *[place(k).alias(f"place_of_lead_{k}") for k in range(1, names + 1)],
    )
    shares = scores.concentration(known.join(triggers.select("ts").distinct(), "ts", "left_semi")).select("ts", "entropy", "hhi")
    kept = top_stability(triggers, scores.top_series(known, "value", 3, positive=False), times, lookback).withColumnsRenamed({"top1_share": "persistence", "top3_jaccard": "likeness"})
    return now.join(shares, "ts").withColumnRenamed("ts", "trigger").join(kept, "trigger", "left")


def event_context(triggers: DataFrame, results: DataFrame, step_s: float, score: str = "score_final") -> DataFrame:
    """One row for each trigger: rows and hours of its event so far, and the greatest and mean score; zeros outside of events."""
    from telltale.operators import sequence

    inside = sequence.running_context(results.where("event_id > 0").select("event_id", "ts", score), score, ["event_id"])
    t = triggers.select(F.col("ts").alias("trigger")).distinct().join(inside.withColumnRenamed("ts", "trigger"), "trigger", "left")
    return t.select("trigger", *[F.coalesce(c.cast("double"), F.lit(0.0)).alias(n) for n, c in (("event_rows", F.col("n_so_far")), ("event_hours", F.col("n_so_far") * F.lit(step_s / 3600)), ("event_max", F.col("max_so_far")), ("event_mean", F.col("mean_so_far")))])


def numbered(train: DataFrame, triggers: int) -> DataFrame:
    """feature, place (from 0, in order of names), fill (its median) of the long features that vary in training; one that a trigger lacks varies too.

    A row for each kind of feature, so a table of some thousands whatever the number of triggers.
    """
    v = F.nanvl("value", F.lit(None).cast("double"))
    known = train.groupBy("feature").agg(F.min(v).alias("lo"), F.max(v).alias("hi"), F.count(v).alias("n"), F.percentile(v, F.lit(0.5)).alias("fill"))
    known = known.where((F.col("lo") < F.col("hi")) | ((F.col("n") > 0) & (F.col("n") < triggers)))
    return known.withColumn("place", F.row_number().over(Window.orderBy("feature")) - 1).select("feature", "place", F.col("fill").cast("double").alias("fill"))


def vectors(features: DataFrame, words: list[tuple[str, float]]) -> DataFrame:
    """trigger, x: long features scattered into one array in the order of `words` (feature, fill); what is missing gets its fill.

    A trigger's (place, value) pairs are gathered and scattered by batches, so that thousands of features aren't
    thousands of columns.
    """
    fills = np.array([f for _, f in words], dtype=float)
    table = features.sparkSession.createDataFrame(pa.table({"feature": pa.array([n for n, _ in words], pa.string()), "place": pa.array(range(len(words)), pa.int32())}))
    told = features.join(F.broadcast(table), "feature", "left")
    # triggers without any known feature get the fills
    pairs = told.groupBy("trigger").agg(F.collect_list(F.when(F.col("place").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value"), F.struct("place", F.col("value").cast("double").alias("value")))).alias("pairs"))
    pairs = pairs.select("trigger", F.col("pairs.place").alias("places"), F.col("pairs.value").alias("values"))

    def scatter(batches):
        for b in batches:
            out = np.tile(fills, (b.num_rows, 1))
            places, values = b.column("places"), b.column("values")
            rows = np.repeat(np.arange(b.num_rows), np.diff(places.offsets.to_numpy()))
            out[rows, places.flatten().to_numpy(zero_copy_only=False)] = values.flatten().to_numpy(zero_copy_only=False)
            ends = pa.array(np.arange(b.num_rows + 1) * len(fills), pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("trigger"), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], names=["trigger", "x"])

    return pairs.mapInArrow(scatter, f"trigger {pairs.schema['trigger'].dataType.simpleString()}, x array<double>")


def trigger_context(triggers: DataFrame) -> DataFrame:
    """Adds trigger_order (from 1), trigger_prior and trigger_minutes (since the one before in the event, -1 for the first)."""
    from telltale.operators.sequence import order_context

    t = order_context(triggers, ["event_id"])
    return t.withColumnRenamed("prior", "trigger_prior").withColumnRenamed("minutes_since", "trigger_minutes")


def calendar(ts: str) -> list[Column]:
    return [c.cast("double").alias(k) for k, c in scalar.cyclic(ts).items()]


def full_features(triggers: DataFrame, panels: dict[str, DataFrame], tops: DataFrame, times: DataFrame, horizons=HORIZONS, step: float = 5.0, words: dict[str, list[str]] | None = None) -> DataFrame:
    """trigger, feature, value: everything the second stage knows of each trigger.

    panels: family (raw, demand, stage1, sensor) to (series, ts, value). A wide table has thousands of columns, so features
    stay long until wide() takes those that are asked for.
    """
    parts = [long_features(packet_summaries(triggers, p, times, horizons, step), f) for f, p in panels.items()]
    lead = top_history(triggers, tops, times, max(horizons))
    names = F.explode(F.array(*[F.struct(F.lit(c).alias("s"), F.col(c).cast("double").alias("v")) for c in ("times_in_top", "rank_weight", "now_weight", "now_rank")])).alias("x")
    parts.append(lead.select("trigger", "series", names).select("trigger", F.concat_ws("|", F.lit("top"), "series", "x.s").alias("feature"), F.col("x.v").alias("value")))
    t = one_hot(trigger_context(triggers), words or vocabulary(triggers, ["reason"]))
    t = t.select(F.col("ts").alias("trigger"), *[F.col(c).cast("double").alias(c) for c in t.columns if re.match("reason_|area_|trigger_", c)], *calendar("ts")).join(top_stability(triggers, tops, times, max(horizons)), "trigger", "left")
    parts.append(t.unpivot(["trigger"], [c for c in t.columns if c != "trigger"], "feature", "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def tiny_features(triggers: DataFrame, panel: DataFrame, scores_: DataFrame, windows=(12, 72)) -> DataFrame:
    """One row for each trigger: its scores, the mean and maximum of all series now and on average over the last 12 and 72 rows, and the calendar."""
    level = panel.groupBy("ts").agg(F.avg("value").alias("level_mean"), F.max("value").alias("level_max")).withColumn("series", F.lit("all"))
    w = Window.partitionBy("series").orderBy("ts")
    rolled = level.select("ts", "level_mean", "level_max", *[F.avg(c).over(w.rowsBetween(1 - n, 0)).alias(f"{c}_{n}") for c in ("level_mean", "level_max") for n in windows])
    return triggers.join(rolled, "ts").join(scores_, "ts").select("*", *calendar("ts"))


def wide(features: DataFrame, names: list[str]) -> DataFrame:
    return features.groupBy("trigger").pivot("feature", names).agg(F.first("value"))


def align(train: DataFrame, others: list[DataFrame], columns: list[str]) -> list[DataFrame]:
    """All frames with the train columns that vary (null counts as a value), nulls filled with the train median, as floats; other columns stay. A column that a frame lacks is null before."""
    stats = train.agg(*[(F.count_distinct(c) + F.max(F.col(c).isNull().cast("int"))).alias(f"n|{c}") for c in columns], *[F.percentile(F.col(c), F.lit(0.5)).alias(f"m|{c}") for c in columns]).first()
    keep = [c for c in columns if (stats[f"n|{c}"] or 0) > 1]
    out = []
    for df in [train, *others]:
        value = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("double")  # noqa: B023, E731
        out.append(df.select(*[c for c in df.columns if c not in columns], *[F.coalesce(value(c), F.lit(float(stats[f"m|{c}"] or 0.0))).cast("float").alias(c) for c in keep]))
    return out


def union_filled(frames: list[DataFrame], fill: float = 0.0) -> DataFrame:
    """All rows with all columns, in order of their names; a column that a frame lacks is `fill`."""
    columns = sorted({c for f in frames for c in f.columns})
    out = None
    for f in frames:
        same = f.select(*[F.col(c) if c in f.columns else F.lit(fill).alias(c) for c in columns])
        out = same if out is None else out.unionByName(same)
    return out


def family(name: Column) -> Column:
    out = F.when(F.lit(False), F.lit(""))
    for start, f in FAMILIES:
        out = out.when(F.startswith(name, F.lit(start)), F.lit(f))
    return out.otherwise(F.lit("other"))


def select_features(names: list[str], which: str) -> list[str]:
    """Names of a feature set: `binary`, `localiser`, or `small`, `medium` or `full` for the compact heads.

    Sampled packets differ from triggers in their reason, their event and when they are, so the binary head sees
    neither these nor the detector's own state; the localiser, which learns from real triggers only, sees all but the
    reasons that name sampled packets.
    """
    if which == "binary":
        return [n for n in names if not n.startswith(("reason_", "area_", "trigger_", "event_", "hour_", "dow_", "month_", "is_", "stage1|leak_state|"))]
    if which == "localiser":
        return [n for n in names if n not in ("reason_hard_negative", "reason_easy_negative", "area_hard_negative", "area_easy_negative")]
    starts = {"small": ("score_", "level_mean"), "medium": ("score_", "level_", "hour_"), "full": ("",)}[which]
    return [n for n in names if n.startswith(starts)]


def predictions(df: DataFrame, classes: list[str], threshold: float, p: str = "p", strip: str = "_bin") -> DataFrame:
    """Adds decision (p >= threshold), top1 to top3 of the classes (columns p_<class>), and true_pipes, the classes with <class> > 0, joined by commas."""
    short = lambda c: c.removesuffix(strip) if strip else c
    order = F.array_sort(F.array(*[F.struct((-F.col(f"p_{c}")).alias("m"), F.lit(short(c)).alias("c")) for c in classes]))
    true = F.array_join(F.filter(F.array(*[F.when(F.col(c) > 0, F.lit(short(c))) for c in classes]), lambda x: x.isNotNull()), ", ")
    return df.select("*", (F.col(p) >= threshold).cast("int").alias("decision"), *[F.try_element_at(order, F.lit(k))["c"].alias(f"top{k}") for k in (1, 2, 3)], true.alias("true_pipes"))


def call_flags(df: DataFrame, truth: str, call: str) -> DataFrame:
    """Adds tp, fp, fn, tn (0 or 1) to each row."""
    y, c = F.col(truth) == 1, F.coalesce(F.col(call), F.lit(0)) == 1
    return df.select("*", *[x.cast("int").alias(n) for n, x in (("tp", y & c), ("fp", ~y & c), ("fn", y & ~c), ("tn", ~y & ~c))])


def permutation_importance(df: DataFrame, features: list[str], truth: str, score, metric, top: int = 60, shuffles: int = 3) -> DataFrame:
    """feature, importance: how much the metric of score(df) falls on average when a feature's values are dealt anew; only the `top` features most correlated with the truth are tried.

    score: frame to frame with `p`; metric: that frame to a number, or, if it takes a second argument (a column of
    copies), to a table of that column and `metric`, and all copies are scored and judged as one table. Rows are ranked by
    a hash once; a deal is a stride through these ranks that shares no factor with their number.
    """
    corr = df.agg(*[F.abs(F.corr(F.col(f).cast("double"), F.col(truth).cast("double"))).alias(f"c{i}") for i, f in enumerate(features)]).first()
    tried = [features[i] for i in sorted(range(len(features)), key=lambda i: (-(corr[f"c{i}"] or 0.0), features[i]))[:top]]
    scratch = Scratch(df.sparkSession)
    copies = scratch.cut(dealt(df, tried, shuffles))
    if len(inspect.signature(metric).parameters) > 1:
        told = {r["copy"]: r["metric"] for r in metric(score(copies), "copy").collect()}
    else:
        told = {k: metric(score(copies.where(F.col("copy") == k))) for k in range(1 + len(tried) * shuffles)}
    scratch.drop(copies)
    base = told.get(0)
    falls = [[base - told[1 + i * shuffles + k] for k in range(shuffles) if base is not None and told.get(1 + i * shuffles + k) is not None] for i in range(len(tried))]
    return df.sparkSession.createDataFrame([(f, float(np.mean(d)) if d else None) for f, d in zip(tried, falls, strict=True)], "feature string, importance double")


def dealt(df: DataFrame, features: list[str], shuffles: int) -> DataFrame:
    """df as copy 0, and for each feature i and deal k a copy (1 + i * shuffles + k) in which that feature has other rows' values."""
    from telltale.operators.ranks import ranked

    scratch = Scratch(df.sparkSession)
    salted = df.withColumn("__id", F.monotonically_increasing_id()).withColumn("__h", F.xxhash64("__id", *[F.col(f"`{f}`").cast("string") for f in features]))
    rows = scratch.cut(ranked(scratch.cut(salted), [], ["__h", "__id"]).drop("group_rows", "__h", "__id"))
    n = rows.count()
    strides = []
    # fixed primes: starts of the search for strides
    for k in range(shuffles):
        a = (7919 + 104729 * k) % max(n, 1) or 1
        while math.gcd(a, max(n, 1)) != 1:
            a += 1
        strides.append((a, 31 * k + 17))
    places = F.array(*[F.struct(F.lit(k).alias("k"), F.pmod((F.col("rank") - 1) * F.lit(a) + F.lit(b), F.lit(max(n, 1))).alias("from")) for k, (a, b) in enumerate(strides)])
    asked = rows.withColumn("__deal", F.explode(places)).withColumn("__k", F.col("__deal.k")).withColumn("__from", F.col("__deal.from") + 1).drop("__deal")
    given = rows.select(F.col("rank").alias("__from"), F.struct(*[F.col(f"`{f}`").alias(f"v{i}") for i, f in enumerate(features)]).alias("__v"))
    met = asked.join(given, "__from").withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(len(features) - 1))))
    own = lambda c: F.col(f"`{c}`")
    mixed = [F.when(F.col("__i") == features.index(c), F.col(f"__v.v{features.index(c)}")).otherwise(own(c)).alias(c) if c in features else own(c) for c in df.columns]
    anew = met.select(*mixed, (1 + F.col("__i") * shuffles + F.col("__k")).cast("int").alias("copy"))
    return df.withColumn("copy", F.lit(0)).unionByName(anew)
