"""The second stage as one run: packets of a detector's triggers are made, learnt from, confirmed, located and judged.

A span of time is cut in three: the first healthy rows teach the detector, the rest of the development span gives packets
to learn from, and what comes after it is only judged. All heads are kept as tables.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.operators import detect, features, heads, linear, metrics, packets, scores, sequence, state
from telltale.operators.ranks import ranked
from telltale.scratch import Scratch
from telltale.sources import tables

#: Scores of the detectors whose history is part of a packet.
STAGE1 = ("score_burst", "burst_raw", "burst_cusum", "score_trigger", "score_incipient", "score_final", "pressure_topk", "pairwise_topk", "ewma_topk", "slope_topk", "flow_topk", "votes", "leak_state")


@dataclass(frozen=True)
class Settings:
    """horizons: rows looked back on. most: features that a linear head takes, those most correlated with its labels. boosted: the binary head is of boosted trees over all features instead, calibrated apart. Shares and weights are of packets.py."""

    horizons: tuple[int, ...] = features.HORIZONS
    healthy_share: float = 0.6
    gap_rows: int = 12
    min_recall: float = 0.95
    precisions: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)
    most: int = 200
    boosted: bool = False
    rounds: int = 20
    regression: bool = True
    important: int = 60
    shuffles: int = 3


@dataclass
class Heads:
    """What the second stage leaves: features in their order with what fills them, kept heads, the threshold."""

    words: list[tuple[str, float]]
    binary: DataFrame | None
    pipes: DataFrame | None
    threshold: float

    @property
    def names(self) -> list[str]:
        return [n for n, _ in self.words]


def fit_end(table: DataFrame, leak: Column, share: float = 0.6):
    """The last time that teaches the detector: `share` of the rows before the first leak (packets.healthy_block)."""
    n = packets.healthy_block(table, leak, share).first()["fit_rows"]
    return ranked(table.select("ts"), [], ["ts"]).where(F.col("rank") == n).agg(F.max("ts")).first()[0]


def truth(table: DataFrame, pipes: list[str]) -> DataFrame:
    """ts, y, a 0/1 column for each pipe, and the magnitude and count of leaks if the table has them."""
    flags = [(F.coalesce(F.col(f"`{c}`"), F.lit(0.0)) > 0).cast("int").alias(c) for c in pipes]
    return table.select("ts", tables.any_leak(table, pipes).cast("int").alias("y"), *flags, *[F.col(c).cast("double").alias(c) for c in ("leak_mag_total", "leak_count") if c in table.columns])


def packet_rows(triggers: DataFrame, results: DataFrame, known: DataFrame, test_from, s: Settings, step_s: int) -> DataFrame:
    """ts, event_id, reason, kind, split (train, cal, val, test), sampled_negative: all packets of a run.

    Triggers before `test_from` are positives or real negatives; healthy times of that span that no trigger has give the
    hard negatives (peaks of the final score, gap_rows apart) and the easy ones. Triggers from then on are `test`.
    """
    told = triggers.join(known.select("ts", "y"), "ts")
    early = F.col("ts") < test_from
    calm = results.where(early).select("ts", F.coalesce("score_final", F.lit(0.0)).alias("value")).join(known.where("y = 0").select("ts"), "ts", "left_semi").join(triggers.select("ts"), "ts", "left_anti").withColumn("series", F.lit("all"))
    calm = Scratch(triggers.sparkSession).cut(calm.select("series", "ts", "value"))
    dev = told.where(early)
    positives = dev.where("y = 1").count()
    most = max(24, round(0.25 * positives))
    peaks = state.suppress_peaks(sequence.local_peaks(calm).where("is_peak").drop("is_peak"), s.gap_rows * step_s, most)
    made = packets.packet_set(dev.where("y = 1"), dev.where("y = 0"), peaks.select("ts", "value"), calm.select("ts"))
    late = told.where(~early).select("ts", "event_id", "reason", F.when(F.col("y") == 1, "positive").otherwise("real_negative").alias("kind"), F.lit("test").alias("split"))
    return made.unionByName(late).withColumn("sampled_negative", F.col("kind").isin("hard_negative", "easy_negative").cast("int"))


def packet_features(rows: DataFrame, panel: DataFrame, results: DataFrame, evidence: DataFrame, s: Settings, step_s: int) -> DataFrame:
    """trigger, feature, value of all families: raw signals, demands, the detector's scores, single sensors and their summary, leading sensors, the event so far, the trigger itself and the calendar."""
    times = Scratch(panel.sparkSession).cut(features.positions(results))
    minutes, back = step_s / 60, max(s.horizons)
    told = [c for c in STAGE1 if c in results.columns]
    own = results.select("ts", *[F.col(c).cast("double").alias(c) for c in told]).unpivot(["ts"], told, "series", "value")
    demand = panel.where("kind = 'demand'")
    panels = {"raw": panel.where("kind <> 'demand'").select("series", "ts", "value"), "stage1": own, "sensor": evidence.select("series", "ts", F.col("evidence").alias("value"))}
    apart = [features.named_values(features.sensor_summary(rows, panels["sensor"], results.select("ts", "top"), times, back), "summary"), features.event_context(rows, results, step_s).unpivot(["trigger"], ["event_rows", "event_hours", "event_max", "event_mean"], "feature", "value")]
    if not demand.isEmpty():
        panels["demand"] = scores.concentration(demand).unpivot(["ts"], ["total", "mean", "std", "max", "median", "hhi", "entropy"], "series", "value")
        apart.append(features.named_values(features.cross_section(rows, demand), "demand"))
    words = features.vocabulary(rows.where("split = 'train'"), ["reason"])
    out = features.full_features(rows.select("ts", "event_id", "reason"), panels, results.where("top is not null").select("ts", "top"), times, s.horizons, minutes, words)
    for a in apart:
        out = out.unionByName(a.select("trigger", "feature", "value"))
    return out


def judged(parts: dict[str, DataFrame], s: Settings, threshold: float) -> DataFrame:
    """One row for each part that has rows: `part`, confusion and rates of the calls, ranking metrics and recall at stated precisions; all parts are judged as one table."""
    rows = None
    for name, part in parts.items():
        told = part.select("y", "p", F.lit(name).alias("part"), (F.col("p") >= threshold).cast("int").alias("call"))
        rows = told if rows is None else rows.unionByName(told)
    out = metrics.confusion(rows, "y", "call", ["part"]).join(metrics.ranking(rows, "p", "y", "part").drop("n"), "part")
    if not s.precisions:
        return out
    return out.join(metrics.recalls_at_precisions(rows, "p", "y", "part", {f"recall_at_{round(100 * t)}": t for t in s.precisions}), "part", "left")


def located(rows: DataFrame, pipes: list[str], name: str) -> DataFrame:
    """One row of localisation metrics over positive packets of real triggers."""
    some = rows.where("y = 1 and sampled_negative = 0")
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("cls"), F.col(f"p_{c}").alias("p"), F.col(c).alias("truth")) for c in pipes])).alias("x")
    return metrics.localisation(some.select("ts", each).select("ts", "x.*"), "ts", "cls", "p", "truth").withColumn("part", F.lit(name))


def fit_heads(rows: DataFrame, words: list[tuple[str, float]], pipes: list[str], s: Settings) -> tuple[Heads, DataFrame]:
    """Heads fitted on packets (x, y, kind, split, pipes), and all packets with p and p_<pipe>.

    The binary head weighs packets by source and class and is calibrated on `cal`; its threshold is the best on `val`.
    Pipes are learnt from positives of real triggers, weighted by how rare their set of pipes is, times balance.
    """
    scratch = Scratch(rows.sparkSession)
    names = [n for n, _ in words]
    train, cal = rows.where("split = 'train'"), rows.where("split = 'cal'")
    weighted = scratch.cut(packets.source_weights(train, "y", "kind"))
    if s.boosted:
        every = heads.boosted_head(weighted, rows, "x", "y", s.rounds, "weight")
        every = scratch.cut(every)
        every = heads.calibrated(every.where("split = 'cal'"), every).withColumnRenamed("p", "p_raw").withColumnRenamed("p_cal", "p")
        binary = None
    else:
        mine = set(features.select_features(names, "binary")) or set(names)
        place = {n: i for i, n in enumerate(names)}
        pool = [n for n in names if n in mine]
        chosen = linear.strongest(picked(weighted, place, pool), pool, ["y"], s.most, "z")
        binary = scratch.cut(linear.fit(picked(weighted, place, chosen), chosen, ["y"], "weight", cal=picked(cal, place, chosen), vector="z"))
        every = linear.score(rows, binary, "p_any_", names, "x").withColumnRenamed("p_any_y", "p")
    every = scratch.cut(every)
    best = metrics.best_threshold(every.where("split = 'val'").withColumn("all", F.lit(1)), "p", "y", "all", s.min_recall).first()
    threshold = best["threshold"] if best else 0.5
    kept = None
    if pipes:
        place = {n: i for i, n in enumerate(names)}
        mine = set(features.select_features(names, "localiser")) or set(names)
        pool = [n for n in names if n in mine] or names
        positive = weighted.drop("weight").where("y = 1 and sampled_negative = 0").withColumn("signature", F.concat(*[F.col(c).cast("string") for c in pipes]))
        positive = scratch.cut(packets.signature_weights(positive, "signature"))
        chosen = linear.strongest(picked(positive, place, pool), pool, pipes, s.most, "z")
        kept = scratch.cut(linear.fit(picked(positive, place, chosen), chosen, pipes, "weight", balanced=True, vector="z"))
        every = scratch.cut(linear.score(every, kept, "p_", names, "x"))
        targets = [c for c in ("leak_mag_total", "leak_count") if c in rows.columns]
        if s.regression and targets and not positive.isEmpty():
            for c in targets:
                every = scratch.cut(heads.regression_head(positive.where(F.col(c).isNotNull()), every, "x", c, s.rounds))
    return Heads(words, binary, kept, threshold), every


def picked(rows: DataFrame, place: dict[str, int], names: list[str]) -> DataFrame:
    """rows with z: the named features of x."""
    at = F.array(*[F.lit(place[n]) for n in names]).cast("array<int>")
    return rows.withColumn("z", F.transform(at, lambda i: F.get(F.col("x"), i)))


def apply(long: DataFrame, fitted: Heads) -> DataFrame:
    """trigger, x, p, p_<pipe>, decision of new packets' long features, by the kept heads alone."""
    x = features.vectors(long, fitted.words)
    out = linear.score(x, fitted.binary, "p_any_", fitted.names, "x").withColumnRenamed("p_any_y", "p")
    if fitted.pipes is not None:
        out = linear.score(out, fitted.pipes, "p_", fitted.names, "x")
    return out.withColumn("decision", (F.col("p") >= fitted.threshold).cast("int"))


def importance(rows: DataFrame, fitted: Heads, s: Settings) -> DataFrame:
    """feature, importance, family: how much average precision on `val` falls if a feature of the kept binary head is dealt anew."""
    place = {n: i for i, n in enumerate(fitted.names)}
    chosen = linear.coefficients(fitted.binary)["y"][0]
    wide = rows.where("split = 'val'").select("y", *[F.get("x", F.lit(place[n])).alias(f"f{i}") for i, n in enumerate(chosen)])
    columns = {f"f{i}": n for i, n in enumerate(chosen)}
    head = fitted.binary.replace({n: c for c, n in columns.items()}, subset=["feature"])
    metric = lambda t, copy: metrics.ranking(t, "p", "y", copy).select(copy, F.col("average_precision").alias("metric"))
    told = features.permutation_importance(wide, list(columns), "y", lambda t: linear.score(t, head, "p_any_").withColumnRenamed("p_any_y", "p"), metric, s.important, s.shuffles)
    return told.replace(columns, subset=["feature"]).withColumn("family", features.family(F.col("feature")))


@dataclass
class Outcome:
    """All tables of a run."""

    detector: detect.Fitted
    results: DataFrame
    triggers: DataFrame
    fitted: Heads
    predictions: DataFrame
    binary: DataFrame
    localisation: DataFrame | None
    accepted: DataFrame
    reasons: DataFrame
    counts: DataFrame
    importance: DataFrame | None


def learn(table: DataFrame, panel: DataFrame, pipes: list[str], test_from, base: detect.Settings, s: Settings = Settings(), compact: bool = False) -> Outcome:
    """The whole run over one table (ts, pipes and what any_leak() reads) and its long panel (series, kind, ts, value)."""
    scratch = Scratch(table.sparkSession)
    known = scratch.cut(truth(table, pipes))
    end = fit_end(known, F.col("y") == 1, s.healthy_share)
    leaks = tables.known_intervals(table.where(F.col("ts") <= end), pipes, 1, (1800, 1800)).select("start_ts", "end_ts")
    fit, find = (detect.fit_tiny, detect.detect_tiny) if compact else (detect.fit_full, detect.detect_full)
    detector = fit(panel.where(F.col("ts") <= end), base, leaks)
    after = panel.where(F.col("ts") > end)
    results, evidence = map(scratch.cut, find(after, detector))
    triggers = scratch.cut(detect.trigger_rows(results, detector.settings, compact))
    rows = scratch.cut(packet_rows(triggers, results, known, test_from, s, base.step_s))
    # a time of two packets has the same features in both, so they are told by time
    long = scratch.cut(packet_features(rows, after, results, evidence, s, base.step_s))
    train = rows.where("split = 'train'").select(F.col("ts").alias("trigger")).distinct()
    words = [(r["feature"], r["fill"]) for r in features.numbered(long.join(train, "trigger", "left_semi"), train.count()).orderBy("place").collect()]
    if not words:
        raise ValueError("no feature varies over the packets to learn from")
    x = features.vectors(long, words).withColumnRenamed("trigger", "ts")
    made = scratch.cut(rows.join(x, "ts").join(known, "ts"))
    fitted, every = fit_heads(made, words, pipes, s)
    val, test = every.where("split = 'val'"), every.where("split = 'test'")
    binary = judged({"val_mixed": val, "val_actual": val.where("sampled_negative = 0"), "test": test}, s, fitted.threshold)
    called = every.withColumn("decision", (F.col("p") >= fitted.threshold).cast("int"))
    told = features.predictions(called.drop("decision"), pipes, fitted.threshold) if pipes else called
    predictions = scratch.cut(told.drop("x").where("split in ('val', 'test')"))
    local = located(val, pipes, "val").unionByName(located(test, pipes, "test")) if pipes else None
    accepted = None
    for name in ("val", "test"):
        a = metrics.acceptance(called.where(F.col("split") == name), "decision", "sampled_negative", "kind").withColumn("part", F.lit(name))
        accepted = a if accepted is None else accepted.unionByName(a)
    reasons = called.where("sampled_negative = 0 and split in ('val', 'test')").groupBy("split", "reason").agg(F.count_if(F.col("decision") == 1).alias("accepted"), F.count_if(F.col("decision") == 0).alias("rejected"))
    counts = every.groupBy("split", "kind").agg(F.count("*").alias("n"), F.sum("y").alias("positives"))
    return Outcome(detector, results, triggers, fitted, predictions, binary, local, accepted, reasons, counts, None if fitted.binary is None else importance(every, fitted, s))
