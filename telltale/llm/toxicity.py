"""Toxicity: two Kneser-Ney models of characters, of toxic and of ordinary texts, with shared backoff counts."""

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.decontamination import split_words
from telltale.llm.shared import Scratch, WordIds, small_batches

DISCOUNT = 0.75
#: Characters of an n-gram. Up to SHARED of them, both classes use the same counts.
ORDER, SHARED = 5, 2
#: Windows, in words, whose highest mean log ratio tells short toxic passages in long texts.
SPANS = (1, 3, 20)
#: Numbers of words, the most toxic ones of a text wherever they stand, whose mean log ratio tells scattered expressions from a single chance one.
TOPS = (2, 3, 4, 6, 10)


def grams(word: str) -> list[str]:
    """The n-gram that ends at each character of a word; "^" marks its start, "$" its end."""
    word = f"^{word}$"
    return [word[max(0, i + 1 - ORDER) : i + 1] for i in range(1, len(word))]


class KneserNey:
    """Log ratio of a word's probabilities under the toxic and the ordinary character model.

    counts: n-gram to (n0, n1), how often ordinary and toxic texts have it. Lower orders count in how many n-grams
    they occur (continuations). What a class has not seen falls back to shorter histories, in the end to counts that
    both classes share, so rare expressions say little. `value` has the log ratio of each n-gram seen in either class,
    `back` that of the backoff weights of its history.
    """

    def __init__(self, counts: dict[str, tuple[int, int]]):
        types: list[dict] = [{}, {}]
        for k in (0, 1):
            types[k] = {g: n[k] for g, n in counts.items() if n[k]}
        for length in range(ORDER, 1, -1):
            for k in (0, 1):
                for g in [g for g in types[k] if len(g) == length]:
                    types[k][g[1:]] = types[k].get(g[1:], 0) + 1
        pool = {g: types[0].get(g, 0) + types[1].get(g, 0) for g in {*types[0], *types[1]} if len(g) <= SHARED}
        for k in (0, 1):
            types[k] = {g: n for g, n in types[k].items() if len(g) > SHARED} | pool
        sums: list[dict] = [{}, {}]
        for k in (0, 1):
            for g, n in types[k].items():
                total, distinct = sums[k].get(g[:-1], (0, 0))
                sums[k][g[:-1]] = total + n, distinct + 1
        weight = [{h: DISCOUNT * d / t for h, (t, d) in s.items()} for s in sums]
        p: list[dict] = [{}, {}]
        base = 1 / (len({g for g in pool if len(g) == 1}) + 1)
        for g in sorted({*types[0], *types[1]}, key=len):
            h = g[:-1]
            for k in (0, 1):
                lower = p[k].get(g[1:], base) if len(g) > 1 else base
                if h in sums[k]:
                    p[k][g] = max(types[k].get(g, 0) - DISCOUNT, 0) / sums[k][h][0] + weight[k][h] * lower
                else:
                    p[k][g] = lower
        self.value = {g: float(np.log(p[1][g] / p[0][g])) for g in p[1]}
        self.back = {h: float(np.log(weight[1].get(h, 1.0) / weight[0].get(h, 1.0))) for h in {*weight[0], *weight[1]}}

    def ratio(self, word: bytes) -> float:
        total = 0.0
        for g in grams(word.decode()):
            while g and g not in self.value:
                total += self.back.get(g[:-1], 0.0)
                g = g[1:]
            total += self.value.get(g, 0.0)
        return total


def summary(ratios: np.ndarray) -> list[float]:
    """Length-normalised log ratio of the text, the highest of its windows, the means of its most toxic words, and the log of its length."""
    n = len(ratios)
    if not n:
        return [0.0] * (2 + len(SPANS) + len(TOPS))
    sums = np.concatenate([[0.0], np.cumsum(ratios)])
    k = min(n, max(TOPS))
    high = np.zeros(max(TOPS))  # a text of fewer words says nothing with those it lacks
    high[:k] = np.sort(np.partition(ratios, n - k)[n - k :])[::-1]
    spans = [float((sums[min(s, n) :] - sums[: n + 1 - min(s, n)]).max()) / min(s, n) for s in SPANS]
    return [sums[-1] / n, *spans, *(float(high[:t].mean()) for t in TOPS), float(np.log(n))]


def train(rows: DataFrame, least: int = 1) -> KneserNey:
    """rows: text (binary), y. Words, then their n-grams, are counted in Spark; n-grams seen less than `least` times are left out."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in (0, 1):
                count = Counter(w for t, y in zip(*(c.to_pylist() for c in batch.columns), strict=True) if y == k for w in split_words(t))
                yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in count], pa.string()), pa.array(np.full(len(count), k, np.int32)), pa.array(count.values(), pa.int64())], ["w", "y", "n"])

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count = Counter()
            for w, y, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                for g in grams(w):
                    count[g, y] += n
            yield pa.RecordBatch.from_arrays([pa.array([g for g, _ in count], pa.string()), pa.array([y for _, y in count], pa.int32()), pa.array(count.values(), pa.int64())], ["g", "y", "n"])

    seen = rows.select("text", "y").mapInArrow(words, "w string, y int, n long").groupBy("w", "y").agg(F.sum("n").alias("n"))
    of = lambda k: F.sum(F.when(F.col("y") == k, F.col("n")).otherwise(0))
    table = seen.mapInArrow(split, "g string, y int, n long").groupBy("g").agg(of(0).alias("n0"), of(1).alias("n1")).where(F.col("n0") + F.col("n1") >= least)
    # bounded by the labelled sample
    return KneserNey({g: (a, b) for g, a, b in zip(*(c.to_pylist() for c in table.toArrow().columns), strict=True)})


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    z, w = np.hstack([np.ones((len(x), 1)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        w += np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (y - p) - ridge * w)
    return w


def score_texts(docs: DataFrame, model, weights=None) -> DataFrame:
    """doc_id and either the summary x of each text or, with weights, its score. model: a broadcast KneserNey."""
    kinds = {"x": "array<double>"} if weights is None else {"score": "double"}
    cols = docs.columns[:-1]

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        ratios = WordIds(of=m.ratio)
        for batch in batches:
            x = [summary(np.array([ratios[w] for w in split_words(t)])) for t in batch.column("text").to_pylist()]
            if weights is None:
                out = pa.array(x, pa.list_(pa.float64()))
            else:
                out = pa.array(1 / (1 + np.exp(-np.clip(np.array(x) @ weights[1:] + weights[0], -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.select(cols).columns, out], [*cols, *kinds])

    schema = [f"`{c}` {k}" for c, k in docs.dtypes[:-1]] + [f"{c} {k}" for c, k in kinds.items()]
    return docs.mapInArrow(apply, ", ".join(schema))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> DataFrame:
    """At most per_class rows of each label, those of least hash: text, y, half (0: language models, 1: calibration)."""
    few = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    picks = [few.where(F.col("y") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for k in (0, 1)]
    few = F.broadcast(picks[0].unionByName(picks[1]))  # at most 2 * per_class rows
    return docs.join(few, "doc_id").select("y", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(4)) == 0).cast("int").alias("half"), F.col("text").cast("binary").alias("text"))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 6000) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for each document; labels must hold no rows that are held out.

    Models and calibration are fitted on at most 2 * per_class labelled documents; every document is scored over its
    whole text. Null and empty texts have no words and get the score of a neutral text; n-grams never seen say nothing;
    without labels of both kinds every score is 0; repeated rows are scored once each; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    docs = docs.select("doc_id", "text")
    rows = scratch.cut(labelled_sample(docs, labels, per_class))
    seen = {tuple(r) for r in rows.select("y", "half").distinct().collect()}
    if len(seen) < 4:
        return docs.select(F.col("doc_id").cast("long"), F.lit(0.0).alias("score"), F.lit(0).alias("predicted"))
    model = spark.sparkContext.broadcast(train(rows.where("half = 0")))
    known = score_texts(rows.where("half = 1").select("y", "text"), model).collect()
    weights = fit_logistic(np.array([r["x"] for r in known]), np.array([r["y"] for r in known], float))
    # the sample holds as many of both labels as it can get; the share of each among all labels is put back
    share = {r["y"]: r["n"] for r in labels.where("toxic is not null").groupBy(F.col("toxic").cast("int").alias("y")).agg(F.count("*").alias("n")).collect()}
    weights[0] += np.log(share[1] / share[0]) - np.log(sum(r["y"] == 1 for r in known) / sum(r["y"] == 0 for r in known))
    scored = score_texts(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")), model, weights)
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
