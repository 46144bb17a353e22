"""Substring dedup by recompression: equal passages get equal symbols, and shared symbols lead to repeats that are then verified."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.shared import MULTIPLIER, Scratch, WordIds, key, mix, named, small_batches, uid, windows

RUN, PAIR = np.uint64(0x52554E), np.uint64(0x50414952)
INVERSE = np.uint64(pow(int(MULTIPLIER), -1, 1 << 64))


def runs(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of one symbol become a symbol: names, and first places with the end.

    A run is named without its length, so that a passage's outermost run has one name however far it goes on outside.
    """
    first = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    long = np.diff(np.append(first, len(symbols))) > 1
    return np.where(long, mix(symbols[first] * MULTIPLIER + RUN), symbols[first]), np.append(first, len(symbols))


def pairs(symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours, the left one of one half of the alphabet and the right one of the other, become a symbol.

    A name is a hash of what it stands for, so it is the same in every document and on every executor.
    """
    left = (mix(symbols + MULTIPLIER) & np.uint64(1)).astype(bool)
    at = np.flatnonzero(left[:-1] & ~left[1:])  # never overlap
    symbols = symbols.copy()
    symbols[at] = mix(symbols[at] * MULTIPLIER + mix(symbols[at + 1] + PAIR))
    stay = np.ones(len(symbols), bool)
    stay[at + 1] = False
    return symbols[stay], np.append(starts[:-1][stay], starts[-1])


class Anchors:
    """For each window of a text the chain of symbols that stands for it: of those inside, the one of least name.

    In each copy of a passage the symbols are the same but for what its two outermost runs on either side belong to:
    the outermost may go on outside, and pair with its neighbour or not. The chains between stand in every copy, so
    the one of least name is the same in all. Without runs a window has at least `least` symbols there; windows with
    fewer, which only runs can bring about, have no chain and are compared in any case.
    """

    def __init__(self, window: int, chain: int = 3):
        self.window, self.chain, self.least = window, chain, (window - 4) // 2
        if self.least < chain:
            raise ValueError("the window is too short for its anchors")

    def __call__(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Names (0: none), and the first and the last start of the windows that each stands for."""
        run, places = runs(ids)
        symbols, starts = pairs(run, places)
        names = np.maximum(windows(symbols, self.chain), np.uint64(1))
        of = np.repeat(np.arange(len(run)), np.diff(places))
        s = np.arange(len(ids) - self.window + 1)
        low = places[np.minimum(of[s] + 2, len(run))]
        high = places[np.maximum(of[s + self.window - 1] - 1, 0)]
        begins = np.zeros(len(ids) + 1, int)
        begins[starts] = 1
        upto = np.cumsum(begins)
        first, wide = (upto - begins)[low], upto[high] - 1 - (upto - begins)[low]
        rich = wide >= self.least
        wide = np.where(rich, wide - self.chain + 1, 1)
        # least name of each range of chains, from those of two ranges whose length is a power of two
        best, level, out = np.arange(len(names)), 0, np.full(len(s), -1)
        while len(best):
            now = np.flatnonzero(rich & (wide >> level == 1))
            a, b = best[first[now]], best[first[now] + wide[now] - (1 << level)]
            out[now] = np.where(names[a] <= names[b], a, b)
            n = len(best) - (1 << level)
            if n <= 0 or not (wide >> (level + 1)).any():
                break
            a, b = best[:n], best[1 << level :]
            best, level = np.where(names[a] <= names[b], a, b), level + 1
        edge = np.flatnonzero(np.append(True, out[1:] != out[:-1]))
        chosen = out[edge]
        return np.where(chosen >= 0, np.append(names, 0)[chosen], 0).astype(np.uint64), edge, np.append(edge[1:], len(s)) - 1


def stretches(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of what stands in each ids[low:high], from prefix sums: 64 and 31 bits."""
    power, back = (np.multiply.accumulate(np.append(np.uint64(1), np.full(len(ids), m))) for m in (MULTIPLIER, INVERSE))

    def of(values: np.ndarray) -> np.ndarray:
        upto = np.append(np.uint64(0), np.cumsum(values * power[:-1]))
        return mix((upto[high] - upto[low]) * back[low] + (high - low).astype(np.uint64))

    return of(ids), of(mix(ids)) >> np.uint64(33)


def sha(words: list[bytes]) -> str:
    return hashlib.sha256(b" ".join(words)).hexdigest()


def counted(texts: DataFrame) -> DataFrame:
    """doc_id, th, number of words and digest of the words of each row."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [(text or b"").split() for text in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.select(["doc_id", "th"]).columns, pa.array(map(len, words), pa.int64()), pa.array(map(sha, words), pa.string())], ["doc_id", "th", "n", "whole"])

    return texts.mapInArrow(look, "doc_id long, th long, n long, whole string")


def anchored(texts: DataFrame, window: int) -> DataFrame:
    """doc_id, uid and text to a row for each anchor: its name, the windows that it stands for, two hashes of the words that they cover.

    starts has the first start of these windows in its upper half and the last one in its lower half.
    """

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, anchors = WordIds(), Anchors(window)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                ids = known.array(text.split())
                names, low, high = anchors(ids)
                found.append((names, *stretches(ids, low, high + window), (low << 32) + high))
            name, one, two, starts = (np.concatenate(x) for x in zip(*found, strict=True))
            whose = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [pa.array(name.view(np.int64)), pa.array(one.view(np.int64)), pa.array(two.astype(np.int32)), *batch.select(["doc_id", "uid"]).take(pa.array(whose)).columns, pa.array(starts)]
            yield pa.RecordBatch.from_arrays(columns, ["name", "one", "two", "doc_id", "uid", "starts"])

    return texts.select("doc_id", "uid", "text").mapInArrow(look, "name long, one long, two int, doc_id long, uid long, starts long")


def repeated(docs: DataFrame, window: int = 20) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for each document: what stays when repeats of `window` words go.

    A word goes when a window that covers it starts earlier too: in a document of smaller doc_id, or before in the
    same one; windows are those of the input. Texts with the same words as a smaller doc_id's lose all of them (if
    they have a window) and take no further part. For the others, recompression names symbols, and equal windows have
    chains of symbols of one name. Names that occur twice mark the stretches that may repeat: of equal stretches all
    but the first go. Where one name has different stretches (at the ends of a repeat), the windows of the first of
    each are compared, over the whole table. Words are compared by two hashes (95 bits). Null and empty texts have no
    words; rows that share a doc_id are one document at the same place, so they take nothing from each other; null
    doc_ids are such rows too, and come after all others; an empty table gives no rows; other columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(key(docs).alias("doc_id"), F.xxhash64("text").alias("th"), F.col("text").cast("binary").alias("text"))
    known = scratch.cut(uid(counted(texts)))
    heads = known.where(F.col("n") >= window).groupBy("whole").agg(F.min("doc_id").alias("head"))
    rows = scratch.cut(known.join(heads, "whole", "left"))
    scratch.drop(known)
    # equal rows of one doc_id have one uid
    whose = rows.where("doc_id = head").groupBy(F.col("doc_id").alias("__doc"), F.col("th").alias("__th")).agg(F.min("uid").alias("uid"))
    at_home = lambda other: (F.col("doc_id") == other["__doc"]) & (F.col("th") == other["__th"])
    marks = scratch.cut(anchored(texts.join(whose, at_home(whose)), window))
    twice = marks.where("name <> 0").groupBy("name").agg(F.count("*").alias("c")).where("c > 1").select("name")
    found = scratch.cut(marks.where("name <> 0").join(twice, "name", "left_semi").unionByName(marks.where("name = 0")))
    scratch.drop(marks)
    place = F.struct("doc_id", F.shiftright("starts", 32).alias("start"))
    kinds = scratch.cut(found.groupBy("name", "one", "two").agg(F.min(place).alias("f"), F.count("*").alias("c")))
    # within one stretch no window is like another, but where there is no name
    chained = kinds.where("name <> 0")
    mixed = chained.groupBy("name").agg(F.count("*").alias("k")).where("k > 1").select("name", F.lit(True).alias("mixed"))
    kinds_of = chained.join(mixed, "name", "left").withColumn("mixed", F.coalesce("mixed", F.lit(False)))
    # what has no name is not joined by it
    kinds_of = kinds_of.unionByName(kinds.where("name = 0").withColumn("mixed", F.lit(True))).where("mixed or c > 1")
    seats = found.join(kinds_of, ["name", "one", "two"]).select("uid", "starts", (place > F.col("f")).alias("later"), "mixed").where("later or mixed")
    seats = scratch.cut(seats)
    scratch.drop(found, kinds)
    # a document's own places, at most one for each of its words
    places = seats.where("not later").groupBy("uid").agg(F.collect_list("starts").alias("places")).join(whose, "uid")
    places = scratch.cut(places.select("__doc", "__th", "places"))

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds()
        for batch in batches:
            found = []
            for text, spans in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                ids, spans = known.array(text.split()), np.array(spans)
                n = len(ids) - window + 1
                step = np.bincount(spans >> 32, minlength=n + 1) - np.bincount((spans & 0xFFFFFFFF) + 1, minlength=n + 1)
                start = np.flatnonzero(np.cumsum(step)[:n])
                found.append((start, *stretches(ids, start, start + window)))
            start, one, two = (np.concatenate(x) for x in zip(*found, strict=True))
            of = np.repeat(np.arange(len(found)), [len(f[0]) for f in found])
            columns = [*batch.select(["doc_id", "th"]).take(pa.array(of)).columns, pa.array(start.astype(np.int32)), pa.array(one.view(np.int64)), pa.array(two.astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "th", "start", "one", "two"])

    seen = texts.join(places, at_home(places)).select("doc_id", "th", "text", "places").mapInArrow(hashes, "doc_id long, th long, start int, one long, two int")
    seen = scratch.cut(seen)
    first = seen.groupBy("one", "two").agg(F.min(F.struct("doc_id", "start")).alias("f"), F.count("*").alias("c")).where("c > 1").select("one", "two", "f")
    start = F.col("start").cast("long")
    later = seen.join(first, ["one", "two"]).where(F.struct("doc_id", "start") > F.col("f")).select(F.col("doc_id").alias("__doc"), F.col("th").alias("__th"), (F.shiftleft(start, 32) + start).alias("starts"))
    later = later.unionByName(seats.where("later").join(whose, "uid").select("__doc", "__th", "starts"))
    gone = scratch.cut(later.groupBy("__doc", "__th").agg(F.collect_list("starts").alias("starts")))
    scratch.drop(seen, places, seats)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, th, text, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = text.split()
                starts = np.array(starts)
                step = np.bincount(starts >> 32, minlength=len(words) + 1) - np.bincount((starts & 0xFFFFFFFF) + window, minlength=len(words) + 1)
                cut = np.cumsum(step)[:-1] > 0
                out.append((doc, th, int(cut.sum()), sha([w for w, c in zip(words, cut, strict=True) if not c])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.string()))], ["doc_id", "th", "n_removed", "kept_sha256"])

    stripped = texts.join(gone, at_home(gone)).select("doc_id", "th", "text", "starts").mapInArrow(strip, "doc_id long, th long, n_removed long, kept_sha256 string").dropDuplicates(["doc_id", "th"])
    rest = rows.where("head is null or head >= doc_id").join(stripped, ["doc_id", "th"], "left")
    rest = rest.select("doc_id", F.col("n").alias("n_words"), F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"))
    copies = rows.where("head < doc_id").select("doc_id", F.col("n").alias("n_words"), F.col("n").alias("n_removed"), F.sha2(F.lit("").cast("binary"), 256).alias("kept_sha256"))
    return rest.unionByName(copies).withColumn("doc_id", named("doc_id"))
