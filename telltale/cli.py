"""python -m telltale.cli: fits a detector on one year of a table and applies it to another."""

import argparse
import dataclasses
import json

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from telltale.operators import confirm, detect, linear, metrics, panel
from telltale.scratch import Scratch
from telltale.sources import sinks, tables


def arguments(argv=None):
    a = argparse.ArgumentParser(description=__doc__)
    g = a.add_mutually_exclusive_group(required=True)
    g.add_argument("--data-root", help="folder of yearly tables")
    g.add_argument("--merged", help="one merged table, csv or parquet")
    a.add_argument("--timestamp-col")
    a.add_argument("--train-year", type=int, default=2018)
    a.add_argument("--test-year", type=int, default=2019)
    a.add_argument("--leak-report", help="text with times of repaired leaks")
    a.add_argument("--config", help="JSON object of settings")
    a.add_argument("--compact", action="store_true", help="the compact detector")
    a.add_argument("--stage2", action="store_true", help="learn and judge the second stage on one merged table too: the train year gives packets, the test year is judged")
    a.add_argument("--boosted", action="store_true", help="boosted trees instead of a linear head that is kept")
    a.add_argument("--output-dir", required=True)
    return a.parse_args(argv)


def long_panel(table, groups):
    """(series, kind, ts, value) of a wide table, on the times that it has."""
    kinds = {c: k for k, cs in groups.items() for c in cs if k != "label"}
    kind = F.create_map(*[F.lit(x) for kv in kinds.items() for x in kv])
    return panel.long(table, "ts", sorted(kinds)).withColumn("kind", kind[F.col("series")]).select("series", "kind", "ts", "value")


def confirmed(spark: SparkSession, args) -> sinks.Run:
    """Packets to predictions: detector, packets, features, kept heads, predictions and all that judges them, under one folder."""
    if not args.merged:
        raise ValueError("the second stage needs a merged table")
    table, groups = tables.read_merged(spark, args.merged, args.timestamp_col)
    pipes = [c for c in table.columns if c.startswith("pipe_") and c.endswith("_bin")] or [c for c in table.columns if c.startswith("pipe_")]
    base = detect.Settings(slots="auto") if args.compact else detect.Settings()
    settings = tables.settings_from_json(args.config, base, spark) if args.config else base
    scratch = Scratch(spark)
    start = F.lit(f"{args.test_year}-01-01 00:00:00").cast("timestamp_ntz")
    both = scratch.cut(tables.in_year(table, args.train_year).unionByName(tables.in_year(table, args.test_year)))
    second = dataclasses.replace(confirm.Settings(), boosted=args.boosted)
    o = confirm.learn(both, scratch.cut(long_panel(both, groups)), pipes, start, settings, second, args.compact)
    out = sinks.Run(spark, args.output_dir)
    told = {
        "predictions": (o.predictions, "probabilities, decisions and pipes of packets of val and test"), "binary_metrics": (o.binary, "confirmation"), "localisation_metrics": (o.localisation, "pipes"), "acceptance": (o.accepted, "share of packets accepted"),
        "reasons": (o.reasons, "accepted and rejected triggers by reason"), "packet_counts": (o.counts, "packets by part and kind"), "importance": (o.importance, "features of the binary head"),
    }
    sections = {}
    for name, (df, about) in told.items():
        if df is not None:
            out.table(df, name, about, "parquet" if name == "predictions" else "json")
            sections[about.capitalize()] = sinks.markdown(df.drop(*[c for c in df.columns if c.startswith("p_")]))
    if o.importance is not None:
        kept = spark.read.json(f"{out.folder}/importance")
        out.table(metrics.group_importance(kept, F.col("family"), "importance"), "family_importance", "importance by family", "json")
    out.table(o.triggers, "triggers", "when the second stage is asked", "csv")
    out.table(spark.createDataFrame(o.fitted.words, "feature string, fill double"), "features", "features and what fills them")
    for name, head in (("binary_head", o.fitted.binary), ("pipe_heads", o.fitted.pipes)):
        if head is not None:
            linear.keep(head, f"{out.folder}/{name}")
            out.note(name, "parquet", "label, feature, weight of raw features")
    if o.fitted.binary is not None:
        out.text(sinks.stage2_header(linear.coefficients(o.fitted.binary)), "stage2.h", "the confirming head as C")
    out.json({"stage1": sinks.metadata(o.detector), "stage2": second, "threshold": o.fitted.threshold}, "metadata.json", "settings and thresholds")
    out.close("Stage 2", sections)
    return out


def run(spark: SparkSession, args) -> sinks.Run:
    if args.stage2:
        return confirmed(spark, args)

    def load(year):
        if args.merged:
            table, groups = tables.read_merged(spark, args.merged, args.timestamp_col)
            return tables.in_year(table, year), groups
        table = tables.read_split(spark, args.data_root, year)
        return table, tables.column_groups(table.columns)

    train, groups = load(args.train_year)
    test, _ = load(args.test_year)
    labels = [c for c in train.columns if c.startswith("pipe_") and not c.endswith("_bin")] or groups["label"]
    leaks = tables.leak_report(spark, args.leak_report) if args.leak_report else tables.known_intervals(train, labels).select("start_ts", "end_ts")
    base = detect.Settings(slots="auto") if args.compact else detect.Settings()
    settings = tables.settings_from_json(args.config, base, spark) if args.config else base
    fit, find, summarise = (detect.fit_tiny, detect.detect_tiny, lambda r: detect.summarise_tiny(r, settings.step_s)) if args.compact else (detect.fit_full, detect.detect_full, detect.summarise_full)
    fitted = fit(long_panel(train, groups), settings, leaks)
    results, evidence = find(long_panel(test, groups), fitted)
    out = sinks.Run(spark, args.output_dir)
    out.table(results, "scores", "scores and states by time")
    done = spark.read.parquet(f"{out.folder}/scores")
    out.table(evidence, "evidence", "evidence by sensor and time")
    out.table(summarise(done), "events", "one row for each event", "json")
    triggers = detect.trigger_rows(done, settings, args.compact)
    out.table(triggers, "triggers", "when the second stage is asked", "csv", report=True)
    out.json(sinks.metadata(fitted), "metadata.json", "settings, thresholds and series")
    if args.compact:
        out.json(sinks.parameters(fitted), "parameters.json", "all that a device needs")
        out.text(sinks.stage1_header(fitted), "stage1.h", "the same as C")
    sections = {"Settings": json.dumps(sinks.metadata(fitted)["thresholds"], sort_keys=True)}
    if labels:
        truth = test.select("ts", tables.any_leak(test, labels).cast("int").alias("leak"))
        told = detect.evaluate(done, truth, None if args.compact else 0.0)
        out.table(told, "metrics", "confusion by row", "json")
        sections["Metrics"] = sinks.markdown(told)
    out.close("Stage 1", sections)
    return out


if __name__ == "__main__":
    run(SparkSession.builder.appName("telltale").getOrCreate(), arguments())
