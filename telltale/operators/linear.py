"""Linear heads that are kept: all labels fitted together, scaling and calibration folded into coefficients of the raw features.

A kept head is a table (label, feature, weight) with one row for each feature and one, named '', for the intercept. It
can be written, read, printed as a header, and applied to any batch or stream that has the features.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale.functions.scalar import sigmoid
from telltale.scratch import Scratch

KEPT = "label string, feature string, weight double"
#: Bytes of second derivatives that a task holds at a time; labels beyond that wait for a pass of their own.
HESSIANS = 64 << 20
#: Sums that reach the driver in a pass.
SUMS = 4
#: Log odds of a label that all rows have; of one that none has, its negative.
CERTAIN = 50.0


def numbers(rows: DataFrame, features: list[str], vector: str | None) -> Column:
    """The features of each row as one array: columns of their names, or the array that `vector` names, in the features' order. Null or NaN is 0."""
    known = lambda c: F.coalesce(F.nanvl(c.cast("double"), F.lit(0.0)), F.lit(0.0))
    if vector:
        return F.transform(F.col(f"`{vector}`"), known)
    return F.array(*[known(F.col(f"`{c}`")) for c in features]).cast("array<double>")


def matrix(rows: DataFrame, features: list[str], labels: list[str], weight: str | None, vector: str | None = None) -> DataFrame:
    """x (features), y (labels; null is 0), w (1 without a weight) of each row."""
    number = lambda c: F.coalesce(F.nanvl(F.col(f"`{c}`").cast("double"), F.lit(0.0)), F.lit(0.0))
    return rows.select(numbers(rows, features, vector).alias("x"), F.array(*[number(c) for c in labels]).alias("y"), (number(weight) if weight else F.lit(1.0)).alias("w"))


def summed(rows: DataFrame, make, width: int) -> np.ndarray:
    """Sum over all rows of `make` (a batch's x, y, w as arrays to one array of `width` numbers): one array a task, added up in two rounds."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            if b.num_rows:
                x, y = (b.column(c).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) for c in ("x", "y"))
                total += make(x, y, b.column("w").to_numpy(zero_copy_only=False))
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for b in batches:
            for s in b.column("s"):
                total += np.frombuffer(s.as_py())
        yield pa.RecordBatch.from_pydict({"s": [total.tobytes()]})

    parts = rows.mapInArrow(partial, "s binary").repartition(SUMS).mapInArrow(added, "s binary")
    return sum((np.frombuffer(r["s"]) for r in parts.collect()), np.zeros(width))


def moments(m: DataFrame, p: int, k: int) -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    """Rows, means and population deviations of the features (1 where there is none), rows of each label: two passes, the second about the means."""
    s = summed(m, lambda x, y, w: np.concatenate([[len(x)], x.sum(0), (y > 0.5).sum(0)]), 1 + p + k)
    n = int(s[0])
    mean = s[1 : p + 1] / max(n, 1)
    sd = np.sqrt(summed(m, lambda x, y, w: ((x - mean) ** 2).sum(0), p) / max(n, 1))
    return n, mean, np.where(sd > 0, sd, 1.0), s[p + 1 :]


def newton(m: DataFrame, design, chosen: list[int], class_weights: np.ndarray, penalty: np.ndarray, steps: int, tolerance: float) -> np.ndarray:
    """Coefficients (one row for each chosen label) that minimise the weighted logistic loss plus half the penalised squares.

    A step is one pass for all labels. design(x, label) are the columns that a label's head sees. A step that makes the
    loss greater is halved until it doesn't.
    """
    k, p = len(chosen), len(penalty)
    beta, move, best = np.zeros((k, p)), np.zeros((k, p)), np.full(k, np.inf)
    gradient, curvature = np.zeros((k, p)), np.zeros((k, p, p))
    for _ in range(steps):
        tried = beta + move

        def sums(x, y, w, tried=tried):
            out = []
            for i, label in enumerate(chosen):
                z, hit = design(x, label), y[:, label] > 0.5
                f = z @ tried[i]
                v = w * np.where(hit, class_weights[label, 1], class_weights[label, 0])
                q = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
                out += [[(v * (np.logaddexp(0, f) - hit * f)).sum()], z.T @ (v * (q - hit)), ((z * (v * q * (1 - q))[:, None]).T @ z).ravel()]
            return np.concatenate(out)

        s = summed(m, sums, k * (1 + p + p * p)).reshape(k, 1 + p + p * p)
        loss = s[:, 0] + 0.5 * (penalty * tried**2).sum(1)
        ahead = 0.0
        for i in range(k):
            if loss[i] <= best[i] + 1e-12 * abs(best[i]) or not np.isfinite(best[i]):
                beta[i], best[i] = tried[i], loss[i]
                gradient[i] = s[i, 1 : p + 1] + penalty * beta[i]
                curvature[i] = s[i, p + 1 :].reshape(p, p) + np.diag(penalty)
                move[i] = -np.linalg.lstsq(curvature[i], gradient[i], rcond=None)[0]
            else:
                move[i] /= 2
            ahead = max(ahead, float(np.abs(move[i]).max()))
        if ahead < tolerance:
            break
    return beta


def fit(train: DataFrame, features: list[str], labels: list[str], weight: str | None = None, balanced: bool = False, cal: DataFrame | None = None, c: float = 1.0, steps: int = 50, tolerance: float = 1e-9, vector: str | None = None) -> DataFrame:
    """A kept head for each 0/1 label, fitted on standardised features with a penalty of half the squared coefficients (the intercept's too) against c times the summed loss.

    weight: a column of row weights; balanced: times rows / (2 * rows of the class), so that a label's classes weigh the
    same. vector: the column that holds the features as one array, in their order, where they aren't columns. cal: rows on which a logistic curve on the log odds is fitted and folded in, for labels of two kinds there.
    A label of one kind gives that answer for certain, and so does an empty table for no. What goes through the driver
    is a sum of (features + 1)^2 numbers a label; the widest labels take passes of their own.
    """
    if not features or not labels:
        raise ValueError("a head needs features and labels")
    spark = train.sparkSession
    scratch = Scratch(spark)
    m = scratch.cut(matrix(train, features, labels, weight, vector))
    p, k = len(features), len(labels)
    n, mean, sd, hits = moments(m, p, k)
    each = np.ones((k, 2))
    if balanced:
        each = np.stack([n / np.maximum(2 * (n - hits), 1), n / np.maximum(2 * hits, 1)], axis=1)
    raw = np.zeros((k, p + 1))
    mixed = [i for i in range(k) if 0 < hits[i] < n]
    for i in range(k):
        raw[i, 0] = CERTAIN if n and hits[i] == n else -CERTAIN
    at_once = max(1, HESSIANS // (8 * (p + 1) ** 2))
    for a in range(0, len(mixed), at_once):
        some = mixed[a : a + at_once]
        beta = newton(m, lambda x, label: np.column_stack([np.ones(len(x)), (x - mean) / sd]), some, each * c, np.ones(p + 1), steps, tolerance)
        for i, b in zip(some, beta, strict=True):
            raw[i] = np.concatenate([[b[0] - (b[1:] * mean / sd).sum()], b[1:] / sd])
    scratch.drop(m)
    if cal is not None and mixed:
        told = scratch.cut(matrix(cal, features, labels, None, vector))
        n_cal, _, _, hits_cal = moments(told, p, k)
        two = [i for i in mixed if 0 < hits_cal[i] < n_cal]
        if two:
            # log odds as a bounded probability gives them
            odds = lambda x, label: np.column_stack([np.ones(len(x)), np.clip(raw[label, 0] + x @ raw[label, 1:], -CERTAIN, CERTAIN)])
            curve = newton(told, odds, two, np.ones((k, 2)), np.array([0.0, 1.0]), steps, tolerance)
            for i, (b, slope) in zip(two, curve, strict=True):
                raw[i] = slope * raw[i]
                raw[i, 0] += b
        scratch.drop(told)
    rows = [(label, name, float(x)) for label, r in zip(labels, raw, strict=True) for name, x in zip(["", *features], r, strict=True)]
    return spark.createDataFrame(rows, KEPT)


def keep(heads: DataFrame, folder: str) -> None:
    heads.select("label", "feature", "weight").coalesce(1).write.mode("overwrite").parquet(folder)


def kept(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(KEPT).parquet(folder)


def coefficients(heads: DataFrame) -> dict[str, tuple[list[str], list[float], float]]:
    """label to (features, weights, intercept), as `sinks.stage2_header` prints them: a row for each label and feature."""
    out: dict = {}
    for r in heads.orderBy("label", "feature").collect():
        names, weights, _ = out.setdefault(r["label"], ([], [], [0.0]))
        if r["feature"]:
            names.append(r["feature"])
            weights.append(r["weight"])
        else:
            out[r["label"]][2][0] = r["weight"]
    return {k: (names, weights, b[0]) for k, (names, weights, b) in out.items()}


def strongest(rows: DataFrame, features: list[str], labels: list[str], most: int, vector: str | None = None) -> list[str]:
    """The `most` features of greatest absolute correlation with any of the labels, in the order of `features`; ties go to the earlier. Three sums of a pass, and those about the means in a second."""
    m = matrix(rows, features, labels, None, vector)
    p, k = len(features), len(labels)
    s = summed(m, lambda x, y, w: np.concatenate([[len(x)], x.sum(0), y.sum(0)]), 1 + p + k)
    mean, rate = s[1 : p + 1] / max(s[0], 1), s[p + 1 :] / max(s[0], 1)

    def about(x, y, w):
        x, y = x - mean, y - rate
        return np.concatenate([(x**2).sum(0), (y**2).sum(0), (x.T @ y).ravel()])

    s = summed(m, about, p + k + p * k)
    both = np.sqrt(np.outer(s[:p], s[p : p + k]))
    r = np.where(both > 0, np.abs(s[p + k :].reshape(p, k)) / np.where(both > 0, both, 1.0), 0.0).max(axis=1)
    first = sorted(range(p), key=lambda i: (-round(float(r[i]), 12), i))[:most]
    return [features[i] for i in sorted(first)]


def score(rows: DataFrame, heads: DataFrame, prefix: str = "p_", features: list[str] | None = None, vector: str | None = None) -> DataFrame:
    """rows (a batch or a stream) with <prefix><label>: the head's probability. A missing feature counts as 0, as in the fit.

    vector: an array of the given features, in their order, instead of columns; it may hold more than a head asks for.
    """
    made = {}
    for label, (names, weights, intercept) in coefficients(heads).items():
        if vector:
            at = {name: i for i, name in enumerate(features)}
            x = F.transform(F.array(*[F.lit(at[n]) for n in names]).cast("array<int>"), lambda i: F.coalesce(F.nanvl(F.get(F.col(f"`{vector}`"), i).cast("double"), F.lit(0.0)), F.lit(0.0)))
        else:
            x = numbers(rows, names, None)
        w = F.array(*[F.lit(v) for v in weights]).cast("array<double>")
        made[prefix + label] = sigmoid(F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(float(intercept)), lambda a, b: a + b))
    return rows.withColumns(made)
