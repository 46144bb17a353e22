"""Streams of late, shuffled and repeated rows give what the batch operators give on the ordered table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from telltale.operators import detect, sequence
from telltale.streaming import compact, detector

READING = "network string, series string, kind string, ts timestamp, value double"
SETTINGS = detect.Settings(slots="daily_hour", smooth=3, pair_anchors=1, least_top=2, slope_rows=6, week_rows=168, vote=2.0, quiet=4, merge=6, burst_confirm=(3, 2), incipient_confirm=(6, 3), least_rows=100, step_s=3600, recheck_h=12.0, shift_min=180.0, jaccard=0.5)


def readings(seed: int, days: int = 24) -> pd.DataFrame:
    """Three pressures and two flows by the hour, a quarter of a second off it; a leak of two days, some missing values."""
    rng = np.random.default_rng(seed)
    ts = pd.date_range("2024-01-01 00:00:00.25", periods=days * 24, freq="h")
    day, load = np.sin(2 * np.pi * ts.hour / 24), rng.normal(0, 1, len(ts)).cumsum() * 0.03
    t = pd.DataFrame({f"press_{k}": 50 + 3 * day * (k + 1) + load * (1 + 0.3 * k) + rng.normal(0, 0.3, len(ts)) for k in range(3)}, index=ts)
    t["flow_0"], t["flow_1"] = 20 - 2 * day - load + rng.normal(0, 0.5, len(ts)), 8 + day + rng.normal(0, 0.5, len(ts))
    leak = (ts >= "2024-01-18") & (ts < "2024-01-20")
    t.loc[leak, ["press_0", "press_1"]] -= 6
    t.loc[leak, "flow_0"] += 6
    t.iloc[5, 0] = t.iloc[77, 3] = t.iloc[430, 1] = t.iloc[431, 1] = t.iloc[432, 1] = np.nan
    long = t.stack(future_stack=True).rename("value").reset_index().set_axis(["ts", "series", "value"], axis=1)
    long["kind"] = np.where(long["series"].str.startswith("press"), "pressure", "flow")
    return long


def by_arrival(rows: pd.DataFrame, files: int, seed: int = 1, late_h: float = 9.0) -> list[pd.DataFrame]:
    """Rows in files in the order in which they come: up to late_h hours behind, every tenth twice."""
    rng = np.random.default_rng(seed)
    rows = pd.concat([rows, rows.iloc[::10]])
    came = rows["ts"] + pd.to_timedelta(rng.uniform(0, late_h, len(rows)), unit="h")
    rows = rows.iloc[np.argsort(came.to_numpy(), kind="stable")]
    return [rows.iloc[part] for part in np.array_split(np.arange(len(rows)), files)]


def as_stream(spark, parts, schema, folder):
    for p in parts:
        p = p.assign(ts=p["ts"].dt.tz_localize("UTC"))
        p = p.assign(value=p["value"].astype(object).where(p["value"].notna(), None)) if "value" in p else p
        spark.createDataFrame(p[[c.split()[0] for c in schema.split(", ")]], schema).coalesce(1).write.mode("append").parquet(f"file://{folder}")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"file://{folder}")


def test_compact_stream_equals_batch(spark, tmp_path):
    """Two networks with fits of their own; a restart in the middle of the stream goes on from the checkpoint."""
    panels, frames, fits = {}, {}, {}
    for k, name in enumerate(("north", "south")):
        panels[name] = readings(5 + k)
        df = spark.createDataFrame(panels[name].assign(value=panels[name]["value"].astype(object).where(panels[name]["value"].notna(), None)), "ts timestamp_ntz, series string, value double, kind string")
        frames[name] = df
        fits[name] = detect.fit_tiny(df.where("ts < '2024-01-17'"), SETTINGS)
    rows = pd.concat([p.assign(network=n) for n, p in panels.items()])
    end = pd.DataFrame([{"network": n, "series": "press_0", "kind": "pressure", "ts": pd.Timestamp("2025-01-01"), "value": 1.0} for n in panels])
    stranger = pd.DataFrame([{"network": "north", "series": "unknown", "kind": "pressure", "ts": pd.Timestamp("2024-01-02"), "value": 1.0}, {"network": "none", "series": "press_0", "kind": "pressure", "ts": pd.Timestamp("2024-01-02"), "value": 1.0}])
    parts = by_arrival(rows, 4)
    parts[0] = pd.concat([parts[0], stranger])
    for some in (parts[:2], [*parts[2:], end]):
        src = as_stream(spark, some, READING, f"{tmp_path}/in")
        out = compact.detect_stream(src, fits, "10 hours")
        detector.run(out, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").where("ts < '2024-12-01'").orderBy("network", "ts").toPandas()
    for name, p in panels.items():
        want, _ = detect.detect_tiny(frames[name], fits[name])
        told = detect.trigger_rows(want, SETTINGS, tiny=True).toPandas().set_index("ts")["reason"].to_dict()
        want, mine = want.orderBy("ts").toPandas(), got[got["network"] == name].reset_index(drop=True)
        assert list(mine["ts"]) == list(want["ts"])
        for c in ("burst_cusum", "score_incipient", "score_final"):
            off = np.flatnonzero(~np.isclose(mine[c], want[c], rtol=1e-9, atol=1e-9))
            assert not len(off), (c, off[:5], mine[c][off[:5]].tolist(), want[c][off[:5]].tolist())
        for c in ("leak_state", "event_id", "votes"):
            assert list(mine[c]) == list(want[c]), c
        assert [list(x) for x in mine["top"]] == [list(x) for x in want["top"]]
        assert {t: r for t, r in zip(mine["ts"], mine["reason"], strict=True) if r} == told
        assert want["leak_state"].sum() > 20 and len(told) > 2


@pytest.mark.parametrize("provisional", [True, False])
def test_merged_events(spark, tmp_path, provisional):
    """Gaps of exactly max_gap rows are closed, longer ones not; an event at the end is final when its gap has passed."""
    gap, step = 3, 0.5
    flags = [0, 1, 1] + [0] * gap + [1] + [0] * (gap + 1) + [1, 0, 1] + [0] * 9 + [1, 1, 1, 0, 0, 0]
    ts = pd.Timestamp("2024-03-01") + pd.to_timedelta(np.arange(len(flags)) * 300, unit="s")
    table = pd.DataFrame({"network": "n", "ts": ts, "state": flags})
    schema = "network string, ts timestamp, state int"
    end = pd.DataFrame({"network": ["other"], "ts": [pd.Timestamp("2024-03-02")], "state": [0]})
    stream = as_stream(spark, [*by_arrival(table, 3, late_h=step), end], schema, f"{tmp_path}/in")
    out = compact.merged_events(stream, gap, 300, late="35 minutes", provisional=provisional)
    if provisional:
        write = out.writeStream.foreachBatch(lambda d, k: d.withColumn("batch", F.lit(k)).write.mode("append").parquet(f"file://{tmp_path}/out")).outputMode("update")
        write.option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    else:
        detector.run(out, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").toPandas()
    batch = spark.createDataFrame(table, "network string, ts timestamp_ntz, state int").withColumnRenamed("network", "series")
    batch = sequence.event_ids(sequence.merge_gaps(batch, "state", gap), "merged").where("event_id > 0")
    want = batch.groupBy("event_id").agg(F.min("ts"), F.max("ts"), F.count("*")).orderBy("event_id").collect()
    final = got[got["final"]].sort_values("event_id")
    assert [tuple(r) for r in final[["event_id", "start_ts", "end_ts", "n_rows"]].itertuples(index=False)] == [tuple(r) for r in want]
    assert len(want) == 3 and want[0][3] == 6
    if provisional:
        early = got[~got["final"]]
        assert len(early) and (early.groupby("event_id")["batch"].max() <= final.set_index("event_id")["batch"]).all()


def test_late_rows_and_missing_values(spark, tmp_path):
    """A row behind the watermark is left out, one without a time too; of two values of a time the smaller known one counts."""
    rows = pd.DataFrame({"network": "n", "ts": pd.to_datetime(["2024-03-01 00:00", "2024-03-01 00:05", "2024-03-01 00:05", "2024-03-01 06:00", None]), "state": [1, 1, 0, 0, 1]})
    late = pd.DataFrame({"network": "n", "ts": pd.to_datetime(["2024-03-01 00:10", "2024-03-01 06:00:00.5"], format="ISO8601"), "state": [1, 1]})
    end = pd.DataFrame({"network": "other", "ts": pd.to_datetime(["2024-03-02"]), "state": [0]})
    stream = as_stream(spark, [rows, end.assign(ts=pd.Timestamp("2024-03-01 05:30")), late, end], "network string, ts timestamp, state int", f"{tmp_path}/in")
    detector.run(compact.merged_events(stream, 2, 300, late="1 hour", provisional=False), f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.parquet(f"file://{tmp_path}/out").orderBy("event_id").collect()
    assert [(r["start_ts"].strftime("%H:%M:%S.%f")[:10], r["n_rows"]) for r in got] == [("00:00:00.0", 1), ("06:00:00.5", 1)]
