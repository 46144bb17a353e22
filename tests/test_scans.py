"""Parallel scans: endless events over many blocks, and the same answers however rows are cut into blocks."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from telltale.operators import scan, state


def run_hysteresis(flags, quiet):
    on, silent, out = False, 0, []
    for start, hold in flags:
        if not on:
            on, silent = bool(start), 0
        elif hold:
            silent = 0
        else:
            silent += 1
            on = silent < quiet
        out.append(int(on))
    return out


def run_schedule(rows, recheck, shift, threshold):
    since, last, out = None, frozenset(), []
    for clock, names in rows:
        names = frozenset(names)
        if since is None:
            reason = "event_start"
        elif clock - since >= recheck:
            reason = "periodic_recheck"
        else:
            reason = "sensor_shift" if clock - since >= shift and scan.jaccard(names, last) < threshold else None
        if reason:
            since, last = clock, names
        out.append(reason)
    return out


def test_maps_of_blocks():
    rng = np.random.default_rng(3)
    for quiet in (1, 2, 7):
        machine = scan.Hysteresis(quiet)
        codes = rng.choice(4, size=700, p=[0.5, 0.05, 0.4, 0.05])
        want = run_hysteresis([(c & 1, c & 2) for c in codes], quiet)
        whole = np.arange(quiet + 1)
        got, enter = [], 0
        for at in range(0, 700, 90):
            part = codes[at : at + 90]
            got += machine.states(part, enter)
            enter = scan.after(machine.behind(part), enter)
            whole = scan.composed(whole, machine.behind(part))
        assert got == want and int(whole[0]) == enter and (enter > 0) == want[-1]


def test_hysteresis_of_an_endless_event(spark):
    """The state never calms: one event over all rows but the first, as in long-running networks; blocks of 50 rows, three levels of maps."""
    n, quiet = 70_000, 12
    rng = np.random.default_rng(8)
    hold = rng.random(n) < 0.3
    hold[::11] = True
    df = pd.DataFrame({"series": "all", "ts": pd.Timestamp("2018-01-01") + pd.to_timedelta(np.arange(n) * 5, unit="min"), "start": np.arange(n) == 1, "hold": hold})
    other = df.head(3000).assign(series="b", hold=rng.random(3000) < 0.15, start=rng.random(3000) < 0.05)
    frame = spark.createDataFrame(pd.concat([df, other])).repartition(7).withColumn("rank", F.lit(1)).withColumn("block", F.lit(1))
    got = state.hysteresis(frame, quiet, block_rows=50).toPandas().sort_values(["series", "ts"])
    assert list(got.columns) == [*frame.columns, "state"]
    for name, part in (("all", df), ("b", other)):
        assert got[got["series"] == name]["state"].tolist() == run_hysteresis(list(zip(part["start"], part["hold"], strict=True)), quiet)
    assert got[got["series"] == "all"]["state"].sum() == n - 1


def test_schedule_of_an_endless_event(spark):
    """One event of many rows with gaps and shifts; clocks by time and by rows, short and long blocks."""
    n = 20_000
    rng = np.random.default_rng(9)
    minutes = np.cumsum(rng.choice([1, 5, 5, 5, 700], size=n, p=[0.1, 0.3, 0.3, 0.297, 0.003]))
    pool = [["a", "b", "c"], ["a", "b", "d"], ["x", None, ""], [], ["c", "b", "a"]]
    names = [pool[k] for k in np.repeat(rng.integers(0, 5, size=n // 10), 10)]
    df = pd.DataFrame({"all": 1, "event_id": 7, "ts": pd.Timestamp("2018-01-01") + pd.to_timedelta(minutes, unit="min"), "names": names})
    few = df.head(40).assign(event_id=8)
    frame = spark.createDataFrame(pd.concat([df, few]), "`all` int, event_id int, ts timestamp_ntz, names array<string>").repartition(5)
    sets = [{x for x in s[:3] if x} for s in names]
    for by_rows, recheck, shift, clock, blocks in ((False, 6 * 3600, 1800, minutes * 60, 1), (False, 6 * 3600, 1800, minutes * 60, 16), (True, 72, 6, np.arange(n), 2), (True, 12, 12, np.arange(n), 1)):
        got = state.schedule(frame, recheck, shift, 0.6, ["all", "event_id"], 3, by_rows, blocks).toPandas()
        for event, size in ((7, n), (8, 40)):
            want = run_schedule(list(zip(clock[:size].tolist(), sets[:size], strict=True)), recheck, shift, 0.6)
            told = got[got["event_id"] == event].sort_values("ts")
            assert list(zip(told["ts"], told["reason"], strict=True)) == [(t, r) for t, r in zip(df["ts"], want, strict=False) if r]
    assert {"event_start", "periodic_recheck", "sensor_shift"} == set(got["reason"]) | {"sensor_shift"}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "series string, ts timestamp_ntz, start boolean, hold boolean, names array<string>, event_id int")
    assert state.hysteresis(empty, 3).count() == 0 and state.schedule(empty, 10, 5, 0.5, ["series", "event_id"]).count() == 0


def test_rows_within_a_second_are_kept(spark, tmp_path):
    from telltale.streaming import detector, stateful

    schema = "network string, ts timestamp, value double, names array<string>"
    rows = pd.DataFrame({"network": "n", "ts": pd.Timestamp("2024-01-01", tz="UTC") + pd.to_timedelta(np.arange(50) * 100, unit="ms"), "value": 1.0, "names": [["a"]] * 50})
    spark.createDataFrame(rows.sample(frac=1, random_state=1), schema).coalesce(1).write.parquet(f"file://{tmp_path}/in")
    out = stateful.follow(spark.readStream.schema(schema).parquet(f"file://{tmp_path}/in"), recheck_s=2, min_shift_s=1)
    detector.run(out, f"file://{tmp_path}/out", f"file://{tmp_path}/c").awaitTermination()
    got = spark.read.schema(stateful.OUT).parquet(f"file://{tmp_path}/out").orderBy("ts").toPandas()
    assert len(got) == 50 and got["ts"].is_unique
    start = got.index[got["reason"] == "event_start"][0]
    assert got.index[got["reason"] == "periodic_recheck"].tolist() == list(range(start + 20, 50, 20))
