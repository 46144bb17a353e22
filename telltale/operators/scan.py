"""Parallel scans of state machines: a block of rows is a map from the state before it to the state behind it, and maps can be composed in any grouping."""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.scratch import Scratch
from telltale.shipping import ship

#: So many maps, one after the other, become one in each round.
FAN = 256


def after(behind: np.ndarray, state: int) -> int:
    """The state behind a block for a state before it. A state that the map doesn't list is like state 0."""
    return int(behind[state if state < len(behind) else 0])


def composed(first: np.ndarray, then: np.ndarray) -> np.ndarray:
    return then[np.where(first < len(then), first, 0)]


def entering(maps: DataFrame, keys: list[str], scratch: Scratch) -> DataFrame:
    """(keys, block, enter): the state that each block is entered with; the first block of a key with state 0.

    maps, a written table: (keys, block, behind), with blocks numbered in their order, gaps allowed. No task holds more
    than FAN maps of a key at a time: rounds of compositions go up until a key has one map, then states come down again.
    """
    ship(maps.sparkSession)
    key = [f"`{k}` {t}" for k, t in maps.dtypes if k in keys]
    schema = ", ".join([*key, "block long", "behind array<int>"])

    def up(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        whole = np.asarray(g["behind"].iloc[0])
        for then in g["behind"].iloc[1:]:
            whole = composed(whole, np.asarray(then))
        return g.iloc[:1].assign(block=g["up"].iloc[0], behind=[whole.tolist()])[[*keys, "block", "behind"]]

    def down(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("block")
        state, out = int(g["enter"].iloc[0]), []
        for behind in g["behind"]:
            out.append(state)
            state = after(np.asarray(behind), state)
        return g.assign(enter=out)[[*keys, "block", "enter"]]

    levels = [maps]
    while (levels[-1].groupBy(*keys).count().agg(F.max("count")).first()[0] or 0) > 1:
        level = levels[-1].withColumn("up", F.floor(F.col("block") / FAN))
        levels.append(scratch.cut(level.groupBy(*keys, "up").applyInPandas(up, schema)))
    states = levels.pop().select(*keys, "block", F.lit(0).alias("enter"))
    for level in reversed(levels):
        above = states.select(*keys, F.col("block").alias("up"), "enter")
        both = level.withColumn("up", F.floor(F.col("block") / FAN)).join(above, [*keys, "up"])
        states = both.groupBy(*keys, "up").applyInPandas(down, ", ".join([*key, "block long", "enter int"]))
    return states


class Hysteresis:
    """States of the machine: 0 is off, 1 + j is on after j rows in a row without hold. A row's code is start + 2 * hold."""

    def __init__(self, quiet: int):
        off, waits = np.zeros(quiet + 1, np.int64), np.arange(1, quiet + 2)
        waits[0], waits[quiet] = 0, 0
        self.step = [waits.copy(), waits.copy(), np.ones(quiet + 1, np.int64), np.ones(quiet + 1, np.int64)]
        self.step[1][0], self.step[2][0] = 1, 0
        self.start = np.arange(quiet + 1) + off

    def behind(self, codes: np.ndarray) -> np.ndarray:
        """The map of a block. All states soon lead to the same one, from where on one is enough."""
        states = self.start
        for k, code in enumerate(codes.tolist()):
            states = self.step[code][states]
            if k % 64 == 63 and (states == states[0]).all():
                last = int(states[0])
                for c in codes[k + 1 :].tolist():
                    last = int(self.step[c][last])
                return np.full(len(states), last)
        return states

    def states(self, codes: np.ndarray, enter: int) -> list[int]:
        out, table = [], [t.tolist() for t in self.step]
        for code in codes.tolist():
            enter = table[code][enter]
            out.append(int(enter > 0))
        return out


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b) if a or b else 1.0


class Schedule:
    """Triggers in one block of an event, from its rows and those of the block before: clocks and sets of names.

    The state is the last trigger: 0 if it is older than the block before (so a recheck is due at once) or there is
    none, k for the k-th row of the block before. Which row triggers next depends on the last trigger only.
    """

    def __init__(self, recheck: int, min_shift: int, threshold: float):
        self.recheck, self.min_shift, self.threshold = recheck, min_shift, threshold

    def of(self, before: list, rows: list) -> "Schedule":
        """A copy for a block; rows are (clock, names)."""
        out = Schedule(self.recheck, self.min_shift, self.threshold)
        number: dict[frozenset, int] = {}
        out.clock = np.array([r[0] for r in rows], np.int64)
        out.names = np.array([number.setdefault(frozenset(r[1]), len(number)) for r in rows], np.int64)
        out.clock_before = [r[0] for r in before]
        out.names_before = [number.setdefault(frozenset(r[1]), len(number)) for r in before]
        out.sets, out.shifted, out.known = list(number), {}, {}
        return out

    def following(self, clock: int, names: int, start: int = 0) -> int:
        """The first row from start on that triggers after a trigger with this clock and these names; the number of rows if none does."""
        end = int(np.searchsorted(self.clock, clock + self.recheck))
        start = max(start, int(np.searchsorted(self.clock, clock + self.min_shift)))
        if start < end:
            if names not in self.shifted:
                self.shifted[names] = np.array([jaccard(s, self.sets[names]) < self.threshold for s in self.sets])
            hits = np.flatnonzero(self.shifted[names][self.names[start:end]])
            if len(hits):
                return start + int(hits[0])
        return max(start, end) if start > end else end

    def first(self, state: int) -> int:
        return 0 if state == 0 or state > len(self.clock_before) else self.following(self.clock_before[state - 1], self.names_before[state - 1])

    def onward(self, row: int) -> int:
        if row not in self.known:
            self.known[row] = self.following(int(self.clock[row]), int(self.names[row]), row + 1)
        return self.known[row]

    def behind(self) -> list[int]:
        n, last = len(self.clock), {}

        def end(row: int) -> int:
            path = []
            while row < n and row not in last:
                path.append(row)
                row = self.onward(row)
            to = last[row] if row < n else path[-1]
            for p in path:
                last[p] = to
            return to

        return [end(f) + 1 if (f := self.first(s)) < n else 0 for s in range(len(self.clock_before) + 1)]

    def triggers(self, state: int, opens: bool) -> list[tuple[int, str]]:
        """(row, reason) of all triggers; opens: whether the block is its event's first."""
        out, row = [], self.first(state)
        clock = None if state == 0 or state > len(self.clock_before) else self.clock_before[state - 1]
        while row < len(self.clock):
            reason = "event_start" if clock is None and opens else "periodic_recheck" if clock is None or self.clock[row] - clock >= self.recheck else "sensor_shift"
            out.append((row, reason))
            clock, row = int(self.clock[row]), self.onward(row)
        return out


def each(rows: DataFrame, keys: list[str], make, schema: str) -> DataFrame:
    """mapInPandas row by row: make gets a row as a named tuple and gives the values of `schema` behind the keys and the block."""
    key = [f"`{k}` {t}" for k, t in rows.dtypes if k in [*keys, "block"]]
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            made = [make(r) for r in g.itertuples(index=False)]
            out = g[[*keys, "block"]].copy()
            for k, name in enumerate(names):
                out[name] = [m[k] for m in made]
            yield out

    return rows.mapInPandas(run, ", ".join([*key, schema]))
