"""Huber regressions of many models at once, over one matrix row (all series) for each time.

Small tables are broadcast and each model is fitted in one task; larger ones are passed over as often as there are steps,
each pass adding up the weighted squares of all models and narrowing down the exact medians of their residuals.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.scratch import Scratch
from telltale.shipping import ship

#: Makes a median absolute deviation a standard deviation.
MAD = 1.4826
#: A matrix of so many bytes at most is broadcast.
BROADCAST_BYTES = 64_000_000
#: Bits of a value that one pass narrows a quantile down by.
BITS = 11
#: Partial sums of so many tasks are added in one call.
TOGETHER = 64


class Model:
    """One regression: its columns in the matrix and what is known of it so far."""

    def __init__(self, name: str, target: int, columns: list[int]):
        self.name, self.target, self.columns = name, target, np.array(columns, np.int64)
        self.center, self.scale = np.zeros(len(columns)), np.ones(len(columns))
        self.beta, self.sigma, self.middle, self.trim = None, 1.0, 0.0, None

    def raw(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and target of the complete rows."""
        x, y = m[:, self.columns], m[:, self.target]
        whole = ~np.isnan(y) & ~np.isnan(x).any(1)
        return x[whole], y[whole]

    def design(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scaled features behind a 1, and the target; only of rows within the trim, once there is one."""
        x, y = self.raw(m)
        z = np.column_stack([np.ones(len(x)), (x - self.center) / self.scale])
        if self.trim:
            beta, sigma, most = self.trim
            near = np.abs(y - z @ beta) / sigma <= most
            z, y = z[near], y[near]
        return z, y

    def residuals(self, m: np.ndarray) -> np.ndarray:
        z, y = self.design(m)
        return y - z @ self.beta

    def squares(self, m: np.ndarray, delta: float | None) -> np.ndarray:
        """Z'WZ and, as a last column, Z'Wy; without delta all weights are 1."""
        z, y = self.design(m)
        w = np.ones(len(y)) if delta is None else np.minimum(1.0, delta * max(self.sigma, 1e-3) / (np.abs(y - z @ self.beta) + 1e-9))
        zw = z * w[:, None]
        return np.column_stack([z.T @ zw, zw.T @ y])


#: What quantiles are taken of: a matrix of values, a column each.
QUANTITIES: dict[str, Callable[[Model, np.ndarray], np.ndarray]] = {
    "x": lambda k, m: k.raw(m)[0],
    "x off": lambda k, m: np.abs(k.raw(m)[0] - k.center),
    "r": lambda k, m: k.residuals(m)[:, None],
    "r off": lambda k, m: np.abs(k.residuals(m) - k.middle)[:, None],
    "r size": lambda k, m: (np.abs(k.residuals(m)) / max(k.sigma, 1e-3))[:, None],
}


def sigma_of(mad: np.ndarray, std: np.ndarray) -> np.ndarray:
    return np.where(mad * MAD > 1e-9, mad * MAD, np.maximum(std, 1.0))


class Local:
    """The whole matrix is here."""

    def __init__(self, m: np.ndarray):
        self.m = m

    def squares(self, models: list[Model], delta: float | None) -> list[np.ndarray]:
        return [k.squares(self.m, delta) for k in models]

    def quantiles(self, models: list[Model], of: str, q: float) -> list[np.ndarray]:
        return [np.quantile(v, q, axis=0) if len(v := QUANTITIES[of](k, self.m)) else np.zeros(v.shape[1]) for k in models]

    def moments(self, models: list[Model], of: str) -> list[tuple]:
        """Count, and standard deviation by column."""
        return [(len(v), v.std(0) if len(v) else np.zeros(v.shape[1])) for k in models for v in [QUANTITIES[of](k, self.m)]]


def order_key(x: np.ndarray) -> np.ndarray:
    """Unsigned integers in the order of the values."""
    b = (x + 0.0).view(np.uint64)  # no negative zero
    return np.where(b >> np.uint64(63), ~b, b | np.uint64(1 << 63))


def of_order_key(k: np.ndarray) -> np.ndarray:
    return np.where(k >> np.uint64(63), k & np.uint64((1 << 63) - 1), ~k).view(np.float64)


class Spread:
    """Rows of the matrix are spread over tasks; a pass adds up an array for each model."""

    def __init__(self, rows: DataFrame):
        self.rows, self.n = rows, None

    def summed(self, models: list[Model], make: Callable[[Model, np.ndarray, int], np.ndarray]) -> list[np.ndarray]:
        """The sum over all rows of what make says of a model and a part of the matrix."""
        shared = self.rows.sparkSession.sparkContext.broadcast(models)

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = None
            for batch in batches:
                for blob, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    m = np.frombuffer(blob).reshape(-1, width)
                    now = [make(k, m, i) for i, k in enumerate(shared.value)]
                    total = now if total is None else [a + b for a, b in zip(total, now, strict=True)]
            for i, t in enumerate(total or []):
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([np.ascontiguousarray(t, np.float64).tobytes()], pa.binary())], ["model", "sums"])

        def add(g: pd.DataFrame) -> pd.DataFrame:
            total = sum(np.frombuffer(b) for b in g["sums"])
            return pd.DataFrame({"model": g["model"].iloc[:1], "sums": [total.tobytes()]})

        sums = self.rows.mapInArrow(part, "model int, sums binary").withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(1 << 30)))
        sums = sums.groupBy("model", F.floor(F.col("deal") / TOGETHER)).applyInPandas(lambda g: add(g), "model int, sums binary")
        found = {r["model"]: np.frombuffer(r["sums"]) for r in sums.groupBy("model").applyInPandas(lambda g: add(g), "model int, sums binary").toLocalIterator()}
        return [found.get(i) for i in range(len(models))]

    def squares(self, models: list[Model], delta: float | None) -> list[np.ndarray]:
        sums = self.summed(models, lambda k, m, i: k.squares(m, delta))
        return [s.reshape(1 + len(k.columns), -1) for k, s in zip(models, sums, strict=True)]

    def moments(self, models: list[Model], of: str) -> list[tuple]:
        def make(k: Model, m: np.ndarray, i: int) -> np.ndarray:
            v = QUANTITIES[of](k, m)
            return np.concatenate([[len(v)], v.sum(0), (v * v).sum(0)])

        out = []
        for s in self.summed(models, make):
            n, w = s[0], (len(s) - 1) // 2
            mean = s[1 : 1 + w] / max(n, 1)
            out.append((int(n), np.sqrt(np.maximum(s[1 + w :] / max(n, 1) - mean * mean, 0))))
        return out

    def quantiles(self, models: list[Model], of: str, q: float) -> list[np.ndarray]:
        """Exact, with values between two rows by proportion: each pass narrows both rows' values down by some bits."""
        counts = [n for n, _ in self.moments(models, of)]
        width = [1 if of[0] == "r" else len(k.columns) for k in models]
        at = [q * max(n - 1, 0) for n in counts]
        ranks = [np.tile(np.array([int(np.floor(a)), int(np.ceil(a))], np.int64), (w, 1)) for a, w in zip(at, width, strict=True)]
        prefix = [np.zeros((w, 2), np.uint64) for w in width]
        left = 64
        while left:
            bits = min(BITS if max(width, default=1) == 1 else 6, left)

            def make(k: Model, m: np.ndarray, i: int, left=left, bits=bits) -> np.ndarray:
                keys = order_key(QUANTITIES[of](k, m))
                out = np.zeros((width[i], 2, 1 << bits))
                for c in range(width[i]):
                    high = keys[:, c] >> np.uint64(left) if left < 64 else np.zeros(len(keys), np.uint64)
                    digit = (keys[:, c] >> np.uint64(left - bits)) & np.uint64((1 << bits) - 1)
                    for side in range(2):
                        out[c, side] = np.bincount(digit[high == prefix[i][c, side]].astype(np.int64), minlength=1 << bits)
                return out

            for i, s in enumerate(self.summed(models, make)):
                below = np.cumsum(s.reshape(width[i], 2, -1), axis=2)
                digit = np.minimum((below <= ranks[i][:, :, None]).sum(2), (1 << bits) - 1)
                before = np.where(digit > 0, np.take_along_axis(below, np.maximum(digit - 1, 0)[:, :, None], 2)[:, :, 0], 0)
                ranks[i] = ranks[i] - before.astype(np.int64)
                prefix[i] = (prefix[i] << np.uint64(bits)) | digit.astype(np.uint64)
            left -= bits
        out = []
        for a, p, n in zip(at, prefix, counts, strict=True):
            v = of_order_key(p) if n else np.zeros(p.shape)
            out.append(v[:, 0] + (v[:, 1] - v[:, 0]) * (a - np.floor(a)))
        return out


def spread_of(data, models: list[Model]) -> None:
    """Sets each model's middle and sigma by its residuals."""
    for k, v in zip(models, data.quantiles(models, "r", 0.5), strict=True):
        k.middle = float(v[0])
    off, std = data.quantiles(models, "r off", 0.5), data.moments(models, "r")
    for k, v, (_, s) in zip(models, off, std, strict=True):
        k.sigma = float(sigma_of(v, s)[0])


def huber(data, models: list[Model], delta: float, ridge: float, steps: int) -> None:
    """Iterated weighted least squares, for all models that still move."""
    for k, s in zip(models, data.squares(models, None), strict=True):
        k.beta = np.linalg.pinv(s[:, :-1]) @ s[:, -1]
    moving = list(models)
    for _ in range(steps):
        if not moving:
            break
        spread_of(data, moving)
        still = []
        for k, s in zip(moving, data.squares(moving, delta), strict=True):
            beta = np.linalg.solve(s[:, :-1] + np.diag([0.0] + [ridge] * len(k.columns)), s[:, -1])
            if np.linalg.norm(beta - k.beta) > 1e-6 * (1 + np.linalg.norm(k.beta)):
                still.append(k)
            k.beta = beta
        moving = still
    spread_of(data, models)


def fit(data, models: list[Model], delta: float, ridge: float, steps: int, trim: float) -> list[Model]:
    """Scaling, a first fit, and a second one on rows within the trim quantile of the first. Models without complete rows are left out."""
    models = [k for k, (n, _) in zip(models, data.moments(models, "x"), strict=True) if n]
    if not models:
        return []
    for k, v in zip(models, data.quantiles(models, "x", 0.5), strict=True):
        k.center = v
    off, std = data.quantiles(models, "x off", 0.5), data.moments(models, "x")
    for k, v, (_, s) in zip(models, off, std, strict=True):
        k.scale = sigma_of(v, s)
    huber(data, models, delta, ridge, steps)
    for k, v in zip(models, data.quantiles(models, "r size", trim), strict=True):
        k.trim = (k.beta, max(k.sigma, 1e-3), float(v[0]))
    huber(data, models, delta, ridge, steps)
    return models


def matrix_rows(panel: DataFrame, names: list[str]) -> DataFrame:
    """(part of the matrix as bytes, its width): a row for each time, a column for each name, nan where nothing is known."""
    width = len(names)
    ids = panel.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "series string, i int")
    rows = panel.where("value is not null").join(F.broadcast(ids), "series").groupBy("ts").agg(F.collect_list(F.struct("i", F.col("value").cast("double").alias("v"))).alias("v"))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells = batch.column("v")
            m, flat = np.full((len(cells), width), np.nan), cells.flatten()
            m[np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy()), flat.field("i").to_numpy()] = flat.field("v").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array([m.tobytes()], pa.binary()), pa.array([width], pa.int32())], ["part", "width"])

    return rows.select("v").mapInArrow(made, "part binary, width int")


FITTED = "model string, features array<string>, center array<double>, scale array<double>, beta array<double>, sigma double"


def fitted(panel: DataFrame, features: DataFrame, delta: float, ridge: float, steps: int, trim: float, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Coefficients of the models in features (model, target, feature) that have complete rows. The models' names and coefficients are on the driver, rows only if they fit into broadcast_bytes."""
    spark, scratch = panel.sparkSession, Scratch(panel.sparkSession)
    ship(spark)
    told = features.groupBy("model", "target").agg(F.array_sort(F.collect_list("feature")).alias("features")).collect()
    names = sorted({n for r in told for n in (r["target"], *r["features"])})
    place = {n: i for i, n in enumerate(names)}
    models = [Model(r["model"], place[r["target"]], [place[f] for f in r["features"]]) for r in told]

    def row(k: Model) -> tuple:
        return k.name, [names[c] for c in k.columns], k.center.tolist(), k.scale.tolist(), k.beta.tolist(), max(k.sigma, 1e-3)

    rows = scratch.cut(matrix_rows(panel, names))
    if (rows.agg(F.sum(F.octet_length("part"))).first()[0] or 0) > broadcast_bytes:
        out = [row(k) for k in fit(Spread(rows), models, delta, ridge, steps, trim)]
        return spark.createDataFrame(out, FITTED)
    parts = [np.frombuffer(r["part"]).reshape(-1, r["width"]) for r in rows.toLocalIterator()]
    shared = spark.sparkContext.broadcast((np.concatenate(parts) if parts else np.zeros((0, max(1, len(names)))), models))

    def alone(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for g in batches:
            m, every = shared.value
            out = [row(k) for i in g["i"] for k in fit(Local(m), [every[i]], delta, ridge, steps, trim)]
            yield pd.DataFrame(out, columns=["model", "features", "center", "scale", "beta", "sigma"])

    tasks = max(1, min(len(models), 4 * spark.sparkContext.defaultParallelism))
    return scratch.cut(spark.range(0, len(models), 1, tasks).select(F.col("id").cast("int").alias("i")).mapInPandas(alone, FITTED))


def residuals(panel: DataFrame, models: DataFrame) -> DataFrame:
    """model, target, ts, resid (null where the target is), sigma, for each row of a model's target. A missing feature counts as its centre.

    The models' coefficients are broadcast; a time's row of the matrix meets all models in one task, so nothing is
    joined by feature.
    """
    ship(panel.sparkSession)
    told = models.select("model", "target", "features", "center", "scale", "beta", "sigma").collect()  # coefficients, no rows
    names = sorted({n for r in told for n in (r["target"], *r["features"])})
    place, width = {n: i for i, n in enumerate(names)}, len(names)
    made = []
    for r in told:
        k = Model(r["model"], place[r["target"]], [place[f] for f in r["features"]])
        k.center, k.scale, k.beta, k.sigma = np.array(r["center"], float), np.array(r["scale"], float), np.array(r["beta"], float), r["sigma"]
        made.append((k, r["target"]))
    shared = panel.sparkSession.sparkContext.broadcast(made)
    ids = panel.sparkSession.createDataFrame([(n, i) for i, n in enumerate(names)], "series string, i int")
    rows = panel.select("ts", "series", F.col("value").cast("double").alias("value")).join(F.broadcast(ids), "series").groupBy("ts").agg(F.collect_list(F.struct("i", F.col("value").alias("v"))).alias("v"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cells, ts = batch.column("v"), batch.column("ts")
            m, there = np.full((len(cells), width), np.nan), np.zeros((len(cells), width), bool)
            flat, at = cells.flatten(), np.repeat(np.arange(len(cells)), cells.value_lengths().to_numpy())
            i = flat.field("i").to_numpy()
            m[at, i] = flat.field("v").to_numpy(zero_copy_only=False)
            there[at, i] = True
            for k, target in shared.value:
                x = m[:, k.columns]
                pull = (np.where(np.isnan(x), 0.0, x - k.center) / k.scale) @ k.beta[1:]
                own = np.flatnonzero(there[:, k.target])
                r = (m[:, k.target] - k.beta[0] - pull)[own]
                n = len(own)
                yield pa.RecordBatch.from_arrays([pa.array([k.name] * n), pa.array([target] * n), ts.take(pa.array(own)), pa.array(r, mask=np.isnan(r)), pa.array(np.full(n, k.sigma))], ["model", "target", "ts", "resid", "sigma"])

    return rows.select("ts", "v").mapInArrow(score, f"model string, target string, ts {dict(panel.dtypes)['ts']}, resid double, sigma double")
