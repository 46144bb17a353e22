"""What the second stage does with many rows: events are read once, packets are dealt over tasks, parts are judged together."""

import math

import duckdb
from pyspark.sql import functions as F

from telltale.operators import confirm, features, metrics
from telltale.plans import network


def test_network_reads_events_once(spark, tmp_path):
    """Events are summed before anything is made of them; rows without a user, a type or a value count as in the SQL."""
    e = spark.sql("SELECT id AS event_id, CAST(timestamp'2024-01-01 00:10:00' + make_dt_interval(0, CAST(id % 7 * (id % 7) AS INT)) AS timestamp_ntz) AS ts, IF(id % 11 = 0, NULL, id % 9 - 2) AS user_id, IF(id % 13 = 0, NULL, element_at(array('view', 'click', 'purchase', 'error'), CAST(id % 4 + 1 AS INT))) AS event_type, IF(id % 5 = 0 OR id % 7 = 3, NULL, id * 0.5D) AS value FROM range(400)")
    e.where("user_id IS NOT NULL").write.parquet(f"{tmp_path}/events.parquet")
    n = network.network(spark, str(tmp_path))
    assert not [f for f in n.inputFiles() if "events.parquet" in f]
    c = duckdb.connect()
    c.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    theirs = {(s, k, t): v for s, k, t, v in c.execute(f"WITH {network.NET} SELECT series, kind, ts, value FROM net").fetchall()}
    ours = {(r["series"], r["kind"], r["ts"]): r["value"] for r in n.collect()}
    assert ours.keys() == theirs.keys() and any(v is None for v in theirs.values())
    assert all(v == theirs[k] or math.isclose(v, theirs[k]) for k, v in ours.items())


def test_packets_of_a_series_are_dealt(spark):
    """One series of few bytes: its packets are worked on by several tasks, and are what a plain loop gives."""
    stamp = F.expr("CAST(timestamp_seconds(1704067200 + id * 3600) AS TIMESTAMP_NTZ)").alias("ts")
    panel = spark.range(0, 600, 1, 1).select(F.lit("s").alias("series"), stamp, F.when(F.col("id") % 10 != 3, (F.col("id") * 7 % 31).cast("double")).alias("value"))
    triggers = spark.range(0, 600, 3, 1).select(stamp)
    got = features.packet_summaries(triggers, panel, features.positions(panel), (4, 12), 60.0)
    tasks = got.withColumn("task", F.spark_partition_id()).groupBy("task").count().count()
    assert tasks > 2
    values = [None if i % 10 == 3 else float(i * 7 % 31) for i in range(600)]
    start = got.agg(F.min("trigger")).first()[0]
    rows = got.collect()
    assert len(rows) == 400 and "__block" not in got.columns
    for r in rows:
        i = int((r["trigger"] - start).total_seconds() // 3600)
        known = sorted(v for v in values[max(0, i - r["horizon"] + 1) : i + 1] if v is not None)
        assert (r["min"], r["max"], r["mean"]) == (known[0], known[-1], sum(known) / len(known)) if known else r["min"] is None and r["median"] is None
        for name, q in (("median", 0.5), ("q10", 0.1), ("q90", 0.9)):
            if known:
                at = q * (len(known) - 1)
                low = known[int(at)]
                assert math.isclose(r[name], low + (known[min(int(at) + 1, len(known) - 1)] - low) * (at - int(at)), abs_tol=1e-9)


def test_parts_are_judged_as_one_table(spark):
    """All parts together give what each gives alone; a part without rows has no row."""
    rows = spark.sql("SELECT id, CAST(id % 3 = 0 AS INT) AS y, (id * 37 % 101) / 101.0D AS p FROM range(100)")
    parts = {"a": rows.where("id < 60"), "b": rows.where("id >= 60"), "none": rows.where("id < 0")}
    s = confirm.Settings(precisions=(0.3, 0.5))
    got = {r["part"]: r.asDict() for r in confirm.judged(parts, s, 0.5).collect()}
    assert got.keys() == {"a", "b"}
    for name in got:
        one = parts[name].withColumn("part", F.lit(name))
        for t in s.precisions:
            assert got[name][f"recall_at_{round(100 * t)}"] == metrics.recall_at_precision(one, "p", "y", "part", t).first()["recall_at_precision"]
        assert got[name]["average_precision"] == metrics.ranking(one, "p", "y", "part").first()["average_precision"]
        assert got[name]["n"] == one.count()
