"""Keyed state on a stream that sees the rows of a key in order of event time, in whatever order they come.

Rows wait in the state until the watermark has passed them, a timer then hands them over in order. Rows behind the
watermark are left out by Spark. Of rows of a key with equal times the one of the smallest known value counts, so
repeated files and any order of arrival give the same results.
"""

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from telltale.shipping import ship

#: What keyed state of this kind needs of a session.
STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
}


def prepare(spark: SparkSession) -> None:
    """Sets the state store (before a query starts) and makes the package known to Python workers."""
    for k, v in STORE.items():
        spark.conf.set(k, v)
    ship(spark)


class InOrder(StatefulProcessor):
    """Subclasses say what they read (READS: the columns behind `at`, a value first), keep (KEEPS) and do with rows in order (step).

    What is kept of a key is its rows of the time that the watermark lags behind, and KEEPS.
    """

    READS = "value double"
    KEEPS = "n long"
    OUT = "key string, ts timestamp"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", f"at long, {self.READS}")
        self.kept = handle.getValueState("kept", self.KEEPS)
        self.timer = handle.getValueState("timer", "at_ms long")

    def fresh(self) -> tuple:
        """What is kept of a key before its first row."""
        raise NotImplementedError

    def step(self, kept: tuple, rows: list[tuple], key: tuple) -> tuple[tuple, list[tuple]]:
        """Takes rows (at, *READS) in order of time; gives what to keep and rows of OUT without the key, times as microseconds."""
        raise NotImplementedError

    def passed(self, kept: tuple, upto: int, key: tuple) -> tuple[tuple, list[tuple], int | None]:
        """Called when all rows up to a time are seen; may give more rows, and a time to be called at again."""
        return kept, [], None

    def wake(self, at: int) -> None:
        """A timer for a time in microseconds, unless an earlier one is set."""
        ms = -(-at // 1000)
        if not self.timer.exists() or ms < self.timer.get()[0]:
            self.handle.registerTimer(ms)
            self.timer.update((ms,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        names = ["at", *[c.split()[0] for c in self.READS.split(", ")]]
        new = []
        for g in rows:
            new += zip(*[[x.tolist() if hasattr(x, "tolist") else x for x in g[n].tolist()] for n in names], strict=True)
        if new:
            self.waiting.appendList(new)
            self.wake(min(r[0] for r in new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted((tuple(r) for r in self.waiting.get()), key=lambda r: (r[0], missing(r[1]), 0.0 if missing(r[1]) else r[1]))
        now, later = [], []
        for r in rows:
            if r[0] > upto:
                later.append(r)
            elif not now or now[-1][0] != r[0]:
                now.append(r)
        self.waiting.put(later) if later else self.waiting.clear()
        kept, out = self.step(tuple(self.kept.get()) if self.kept.exists() else self.fresh(), now, key)
        kept, more, again = self.passed(kept, upto, key)
        self.kept.update(kept)
        self.timer.clear()
        for at in [r[0] for r in later[:1]] + ([again] if again is not None else []):
            self.wake(at)
        if out or more:
            told = pd.DataFrame([(*key, *r) for r in out + more], columns=[c.split()[0] for c in self.OUT.split(", ")])
            for c in self.OUT.split(", "):
                if c.endswith(" timestamp"):
                    told[c.split()[0]] = pd.to_datetime(told[c.split()[0]], unit="us", utc=True)
            yield told


def missing(x) -> bool:
    return x is None or x != x


def run_in_order(stream: DataFrame, keys: list[str], processor: InOrder, mode: str = "append", timed: str = "ts") -> DataFrame:
    """Rows of a stream (keys, ts with a watermark, what the processor reads) through a processor. Rows without a time are left out.

    timed: the column of the result that later operators take as event time.
    """
    prepare(stream.sparkSession)
    told = stream.where(F.col("ts").isNotNull()).withColumn("at", F.unix_micros("ts"))
    return told.groupBy(*keys).transformWithStateInPandas(processor, processor.OUT, mode, "EventTime", eventTimeColumnName=timed)
