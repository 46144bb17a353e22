"""Quality classifier: document evidence combined with shrunken posteriors of its host and path."""

from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, free, key, named, small_batches

#: Classes of bytes: 0 lower case or not ASCII, 1 upper case, 2 digit, 3 blank, 4 line end, 5 sentence marks, 6 other signs.
BYTE_CLASS = np.array([1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 4 if c in (10, 13) else 3 if c in (9, 11, 12, 32) else 5 if c in b".,;:?'\"-()" else 6 if c < 97 or 123 <= c < 128 else 0 for c in range(256)], np.uint8)
FEATURES = ("words", "word_bytes", "distinct", "repeats", "top_word", "upper", "digit", "marks", "signs", "lines", "same_lines", "line_words", "stops", "titles", "short_words", "long_words")


def evidence(text: bytes | None) -> list[float]:
    """FEATURES of a text; zeros for an empty one."""
    text = text or b""
    words = text.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    kinds = np.bincount(BYTE_CLASS[np.frombuffer(text, np.uint8)], minlength=7)
    solid = kinds.sum() - kinds[3] - kinds[4]
    counts = Counter(words)
    lines = [x for x in text.split(b"\n") if x.strip()]
    return [
        float(np.log(n)), solid / n, len(counts) / n**0.7, sum(map(eq, words, words[1:])) / n, max(counts.values()) / n,
        kinds[1] / solid, kinds[2] / solid, kinds[5] / n, kinds[6] / n, len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        text.count(b".") / n, sum(map(bytes.istitle, words)) / n, sum(v for k, v in counts.items() if len(k) <= 3) / n, sum(v for k, v in counts.items() if len(k) >= 15) / n,
    ]


class Additive:
    """Logistic regression on quantile bins of each feature: a sum of step functions, fitted by Newton steps."""

    def __init__(self, x: np.ndarray, y: np.ndarray, bins: int = 16, ridge: float = 1.0, steps: int = 25):
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
        z = self.bins(x)
        self.w = np.zeros(z.shape[1])
        penalty = np.full(z.shape[1], ridge)
        penalty[0] = 1e-6
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ self.w, -30, 30)))
            hessian = (z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty)
            move = np.linalg.solve(hessian, z.T @ (y - p) - penalty * self.w)
            self.w += move
            if np.abs(move).max() < 1e-6:
                break

    def bins(self, x: np.ndarray) -> np.ndarray:
        parts = [np.ones((len(x), 1))]
        for c, e in zip(x.T, self.edges, strict=True):
            parts.append(np.eye(len(e) + 1)[np.searchsorted(e, c, "right")])
        return np.hstack(parts)

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.w[0])
        at = 1
        for c, e in zip(x.T, self.edges, strict=True):
            out += self.w[at + np.searchsorted(e, c, "right")]
            at += len(e) + 1
        return np.clip(out, -20, 20)


def document_evidence(docs: DataFrame) -> DataFrame:
    """doc_id, host, path, text_hash and the features of each document."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [evidence(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["text"]).columns, pa.array(rows, pa.list_(pa.float64()))], ["doc_id", "host", "path", "text_hash", "x"])

    small_batches(docs.sparkSession)
    few = docs.select(key(docs).alias("doc_id"), F.col("source").alias("host"), F.col("lang").alias("path"), F.xxhash64("text").alias("text_hash"), F.col("text").cast("binary").alias("text"))
    return few.mapInArrow(measure, "doc_id long, host string, path string, text_hash long, x array<double>")


def shrunk(groups: DataFrame, prior: F.col, keys: list[str], name: str) -> DataFrame:
    """Posterior mean of each group: its mean pulled to `prior` by as many pseudo-rows as the spread between groups says."""
    # one row: the strength of the prior by the method of moments
    m = groups.agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("n")).alias("ss"), F.count("*").alias("k")).first()
    if not m["n"]:
        strength = 1.0
    else:
        mean = min(max(m["s"] / m["n"], 1e-4), 1 - 1e-4)
        between = max((m["ss"] - m["n"] * mean**2) / m["n"] - mean * (1 - mean) * m["k"] / m["n"], 1e-6)
        strength = min(max(mean * (1 - mean) / between - 1, 1.0), 1e6)
    return groups.withColumn(name, (F.col("s") + F.lit(strength) * prior) / (F.col("n") + F.lit(strength)))


def score(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.4) -> DataFrame:
    """scored_rows() with null doc_ids as they were."""
    return scored_rows(docs, labels, sample, threshold).withColumn("doc_id", named("doc_id"))


def scored_rows(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.4) -> DataFrame:
    """doc_id (never null), text_hash, doc_score, host_score, path_score, score, keep for each document.

    Document evidence: a logistic model of text features, fitted on at most `sample` labelled rows (those of least
    hash). Its scores are averaged by host (source) and path in the host (lang), both over all documents; each
    posterior is shrunk to the level above (path to host, host to all), more so where a site has few documents. The
    final log odds are the document's plus what its path says beyond the global prior.
    Null and empty texts have all features 0; a null host or path is a site of its own; repeated rows each get a score
    and count each; without labels of both kinds every document gets the score 1; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    known = scratch.cut(document_evidence(docs))
    few = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    rows = known.join(few, "doc_id").select("doc_id", "text_hash", "x", "y").dropDuplicates(["doc_id"]).select("x", "y").toLocalIterator()
    rows = list(rows)
    y = np.array([r["y"] for r in rows])
    if not len(y) or y.min() == y.max():
        return known.select("doc_id", "text_hash", *[F.lit(1.0).alias(c) for c in ("doc_score", "host_score", "path_score", "score")], F.lit(True).alias("keep"))
    model = spark.sparkContext.broadcast(Additive(np.array([r["x"] for r in rows]), y))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["x"]).columns, pa.array(1 / (1 + np.exp(-model.value.logit(x))))], ["doc_id", "host", "path", "text_hash", "doc_score"])

    scored = scratch.cut(known.mapInArrow(apply, "doc_id long, host string, path string, text_hash long, doc_score double"))
    scratch.drop(known)
    paths = scored.groupBy("host", "path").agg(F.sum("doc_score").alias("s"), F.count("*").alias("n"))
    hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    total = hosts.agg(F.sum("s"), F.sum("n")).first()
    overall = min(max(total[0] / total[1], 1e-4), 1 - 1e-4)
    hosts = shrunk(hosts, F.lit(overall), ["host"], "host_score").select(F.col("host").alias("h"), "host_score")
    paths = paths.join(hosts, paths["host"].eqNullSafe(hosts["h"])).drop("h")
    paths = shrunk(paths, F.col("host_score"), ["host", "path"], "path_score").select(F.col("host").alias("h"), F.col("path").alias("p"), "host_score", "path_score")
    out = scored.join(paths, scored["host"].eqNullSafe(paths["h"]) & scored["path"].eqNullSafe(paths["p"]))
    logit = lambda c: F.log(c / (F.lit(1.0) - c))
    odds = logit(F.col("doc_score")) + logit(F.col("path_score")) - logit(F.lit(overall))
    out = out.withColumn("score", F.lit(1.0) / (F.lit(1.0) + F.exp(-odds)))
    return out.select("doc_id", "text_hash", "doc_score", "host_score", "path_score", "score", (F.col("score") >= threshold).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, sample: int = 20_000, threshold: float = 0.4) -> DataFrame:
    """docs, all columns (whatever their names), without the rows that score() rejects.

    Null and empty texts are judged like any other by their features (all 0); a row is found again by doc_id (null
    like any other) and text, so repeated rows stay or go together; an empty table stays empty.
    """
    doc, text = free(docs, "doc", "hash")
    bad = scored_rows(docs, labels, sample, threshold).where("not keep").select(F.col("doc_id").alias(doc), F.col("text_hash").alias(text)).distinct()
    return docs.join(bad, (key(docs) == bad[doc]) & (F.xxhash64(docs["text"]) == bad[text]), "left_anti")
