"""Sequential operators: hysteresis states and trigger schedulers as parallel scans of blocks, and greedy peaks."""

import bisect
import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators import scan
from telltale.operators.ranks import ranked
from telltale.operators.scan import jaccard  # noqa: F401  (told with the schedule)
from telltale.scratch import Scratch
from telltale.shipping import ship

#: Rows of a block of the hysteresis, and how many rechecks a block of the scheduler spans.
BLOCK_ROWS, BLOCK_RECHECKS = 4096, 16


def kept_rows(df: DataFrame, keys: list[str], **more: Column) -> tuple[DataFrame, list[str]]:
    """keys under names of their own, ts, what else is asked for, and the whole row as a struct."""
    own = [f"__key{k}" for k in range(len(keys))]
    return df.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], "ts", *[c.alias(n) for n, c in more.items()], F.struct(*df.columns).alias("__row")), own


def hysteresis(df: DataFrame, quiet: int, keys: str = "series", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Adds `state` to rows with start and hold flags: on at a start, off on the `quiet`-th row in a row without hold.

    The row that turns off is off already, so an event has quiet - 1 rows of silence at its end; a start while it is on
    says nothing. A series is cut into blocks of block_rows rows. Each becomes a map from the state before it to the
    state behind it, maps are composed (scan.entering), then all blocks are run through side by side: no task holds more
    than a block, however long an event is.
    """
    scratch = Scratch(df.sparkSession)
    ship(df.sparkSession)
    flag = lambda c: F.coalesce(F.col(c).cast("boolean"), F.lit(False)).cast("int")
    rows, key = kept_rows(df, [keys], code=flag("start") + 2 * flag("hold"))
    rows = ranked(rows, key, ["ts"]).withColumn("block", F.floor((F.col("rank") - 1) / block_rows)).withColumn("place", (F.col("rank") - 1 - F.col("block") * block_rows).cast("int")).drop("rank", "group_rows")
    rows = scratch.cut(rows)
    blocks = scratch.cut(rows.groupBy(*key, "block").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "code"))), lambda x: x["code"]).alias("codes")))
    machine = scan.Hysteresis(quiet)
    maps = scratch.cut(scan.each(blocks, key, lambda r: (machine.behind(np.asarray(r.codes)).tolist(),), "behind array<int>"))
    entered = blocks.join(scan.entering(maps, key, scratch), [*key, "block"])
    states = scan.each(entered, key, lambda r: (machine.states(np.asarray(r.codes), r.enter),), "states array<int>")
    return rows.join(states, [*key, "block"]).select("__row.*", F.col("states")[F.col("place")].alias("state"))


def schedule(df: DataFrame, recheck: float, min_shift: float, threshold: float, keys: list[str], top: int = 5, by_rows: bool = False, block_rechecks: int = BLOCK_RECHECKS) -> DataFrame:
    """Triggers of each event (rows: keys, ts, names; the last key numbers events): its first row, then a recheck, or a shift of names.

    A recheck comes `recheck` seconds after the last trigger, a shift where the Jaccard similarity of the current names
    and those of the last trigger is under `threshold`, at least min_shift seconds later (by_rows: both in rows of the
    event). Any trigger restarts both clocks; two empty sets are alike. An event is cut into blocks of block_rechecks
    rechecks. What triggers in a block depends on the last trigger in the block before, so a block is a map from that to
    its own last trigger: maps are composed, then all blocks are run through side by side.
    """
    scratch = Scratch(df.sparkSession)
    ship(df.sparkSession)
    said = F.filter(F.slice(F.coalesce(F.col("names").cast("array<string>"), F.array().cast("array<string>")), 1, top), lambda n: n.isNotNull() & (n != ""))
    rows, key = kept_rows(df, keys, said=said)
    unit = 1 if by_rows else 1_000_000
    if by_rows:
        rows = ranked(rows, key, ["ts"]).withColumnRenamed("rank", "clock").drop("group_rows")
    else:
        rows = rows.withColumn("clock", F.unix_micros(F.col("ts").cast("timestamp")))
    recheck, min_shift = math.ceil(recheck * unit), math.ceil(min_shift * unit)
    rows = rows.withColumn("block", F.floor(F.col("clock") / max(1, recheck * block_rechecks)))
    rows = scratch.cut(rows.withColumn("place", F.row_number().over(Window.partitionBy(*key, "block").orderBy("ts")) - 1))
    blocks = scratch.cut(rows.groupBy(*key, "block").agg(F.array_sort(F.collect_list(F.struct("place", "clock", "said"))).alias("rows")))
    opening = blocks.groupBy(*key).agg(F.min("block").alias("opening"))
    before = blocks.select(*key, (F.col("block") + 1).alias("block"), F.col("rows").alias("before"))
    blocks = scratch.cut(blocks.join(before, [*key, "block"], "left").join(opening, key).withColumn("before", F.coalesce("before", F.array().cast(blocks.schema["rows"].dataType))))
    plan = scan.Schedule(recheck, min_shift, threshold)

    def block(r) -> scan.Schedule:
        return plan.of(*[[(x["clock"], x["said"]) for x in part] for part in (r.before, r.rows)])

    maps = scratch.cut(scan.each(blocks, key, lambda r: (block(r).behind(),), "behind array<int>"))
    entered = blocks.join(scan.entering(maps, key, scratch), [*key, "block"])

    def told(r) -> tuple:
        found = block(r).triggers(r.enter, r.block == r.opening)
        return [k for k, _ in found], [why for _, why in found]

    found = scan.each(entered, key, told, "places array<int>, reasons array<string>")
    found = found.select(*key, "block", F.explode(F.arrays_zip("places", "reasons")).alias("t")).select(*key, "block", F.col("t.places").alias("place"), F.col("t.reasons").alias("reason"))
    return rows.join(found, [*key, "block", "place"]).select("__row.*", "reason")


def suppress_peaks(df: DataFrame, min_gap_s: int, limit: int, keys: str = "series", block_gaps: int = 4096) -> DataFrame:
    """Greatest first (ties: earliest), a peak is taken if it is min_gap_s from all taken, until `limit`.

    Whether a peak is taken depends on greater ones near it only, so blocks of time decide theirs side by side: what
    depends on rows beyond a block's ends waits for a round in which the blocks lie half a block further. Rounds end
    when nothing waits; the greatest that wait are decided in two rounds at most. A task holds a block's peaks.
    `limit` is by rank, as those taken first are the greatest. Rows without a time are no peaks; a null value comes last.
    """
    if block_gaps < 4:
        raise ValueError("a block is four gaps at least")
    scratch = Scratch(df.sparkSession)
    gap, half = min_gap_s * 1_000_000, block_gaps * min_gap_s * 1_000_000 // 2
    if gap <= 0:
        return first_peaks(df, limit, keys)
    rows = df.where("ts is not null").withColumn("__at", F.unix_micros(F.col("ts").cast("timestamp"))).withColumn("__taken", F.lit(False))
    rows, shift = scratch.cut(rows), 0

    def decide(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["value", "__at"], ascending=[False, True], na_position="last")
        low = g["__block"].iloc[0] * 2 * half - g["__shift"].iloc[0]
        high, taken, waiting, keep, told = low + 2 * half, [], [], [], []
        for at in g.loc[g["__taken"], "__at"]:
            bisect.insort(taken, at)
        near = lambda where, at: (i := bisect.bisect_left(where, at - gap + 1)) < len(where) and where[i] < at + gap
        for at, done in zip(g["__at"], g["__taken"], strict=True):
            wait = False
            if not done:
                if near(taken, at):
                    keep.append(False)
                    continue
                wait = near(waiting, at) or at - low < gap or high - at <= gap
                bisect.insort(waiting if wait else taken, at)
            keep.append(True)
            told.append(not wait)
        out = g[keep].copy()
        out["__taken"] = told
        return out.drop(columns=["__block", "__shift"])

    while not rows.where("not __taken").isEmpty():
        placed = rows.withColumn("__shift", F.lit(shift)).withColumn("__block", F.floor((F.col("__at") + shift) / (2 * half)))
        now = scratch.cut(placed.groupBy(keys, "__block").applyInPandas(decide, rows.schema))
        scratch.drop(rows)
        rows, shift = now, half - shift
    return first_peaks(rows.drop("__at", "__taken"), limit, keys)


def first_peaks(df: DataFrame, limit: int, keys: str) -> DataFrame:
    """The `limit` greatest of each group, ties by time."""
    low = df.withColumn("__low", -F.col("value"))
    return ranked(low, [keys], ["__low", "ts"]).where(F.col("rank") <= limit).drop("__low", "rank", "group_rows")
