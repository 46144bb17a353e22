"""Phrase collocation mining: a sketch bounds how often phrases occur, delimiter-guarded automata count those that may occur often enough."""

import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import compress, islice
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from telltale.llm.lm_scoring import packed, runs, unpacked
from telltale.llm.shared import Scratch, WordIds, mix, small_batches, windows

#: Tokens of one chunk, which has an automaton of its own; and phrases whose cells are counted at once for the sketch.
CHUNK_TOKENS, CHUNK_CELLS = 500_000, 12_000_000
#: Cells of the sketch, as a power of 2: least and most (2^30 cells are 128 MB when broadcast). They are added up in 2^RANGES ranges.
LEAST_BITS, MOST_BITS, RANGES = 20, 30, 7
#: Counts in the sketch stop here.
FULL = 255
#: Stands between pieces. It is a delimiter itself, so it is never a word.
BREAK = b"."
#: For bytes.translate: A-Z to a-z, tabs to spaces, delimiters to BREAK.
PIECES = bytes(ord(BREAK) if chr(c) in ".,;:!?\n\v\f\r" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_id(word: bytes) -> int:
    return 0 if word == BREAK else xxhash.xxh3_64_intdigest(word) | 1


def chunks(batches: Iterator[pa.RecordBatch], size: int = CHUNK_TOKENS) -> Iterator[tuple[str, list[bytes]]]:
    """(lang, tokens of some of its documents); between pieces and documents there is a BREAK.

    When twice `size` tokens are held, those of the language that has most go, or all if no language has many.
    """
    held: dict[str, list[bytes]] = {}
    n = 0
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            tokens = text.translate(PIECES).replace(BREAK, b" . ").split()
            if tokens:
                held.setdefault(lang, []).extend([*tokens, BREAK])
                n += len(tokens) + 1
            if n >= 2 * size:
                first = max(held, key=lambda x: len(held[x]))
                go = [first] if len(held[first]) >= size // 4 else list(held)
                for x in go:
                    n -= len(held[x])
                    yield x, held.pop(x)
    yield from held.items()


def phrase_cells(lang: str, ids: np.ndarray, longest: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For phrases of 1, 2, ... words: the sketch's cell of the phrase that starts at each token, and which tokens start one inside a piece."""
    seed = np.uint64(xxhash.xxh3_64_intdigest(lang.encode()))
    inside = ids != 0
    for size in range(1, longest + 1):
        n = max(0, len(ids) - size + 1)
        whole = np.ones(n, bool)
        for k in range(size):
            whole &= inside[k : k + n]
        yield mix(windows(ids, size) ^ seed) >> np.uint64(64 - bits), whole


def sketch(texts: DataFrame, longest: int, least: int, bits: int) -> np.ndarray:
    """A bit for each cell: whether all phrases in it together occur `least` times or more."""
    width = bits - RANGES

    def told(parts: list[np.ndarray]) -> pa.RecordBatch:
        cells, n = runs(np.concatenate(parts))
        at, size = runs(cells >> np.uint32(width))
        ends = np.cumsum(size)
        offset, n = cells & np.uint32((1 << width) - 1), np.minimum(n, FULL)
        blobs = [packed((3, 1), np.diff(offset[a:b], prepend=np.uint32(0)), n[a:b]) for a, b in zip(ends - size, ends, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "n", "cells"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, held = WordIds(400_000, word_id), [], 0
        for lang, tokens in chunks(batches):
            for cell, whole in phrase_cells(lang, ids.array(tokens), longest, bits):
                parts.append(cell[whole].astype(np.uint32))
                held += len(parts[-1])
            if held >= CHUNK_CELLS:
                yield told(parts)
                parts, held = [], 0
        if held:
            yield told(parts)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made():
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(total >= min(least, FULL)).tobytes()], pa.binary())], ["part", "marks"])

        part, total = None, None
        for batch in batches:
            for now, n, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now != part:
                    if part is not None:
                        yield made()
                    part, total = now, np.zeros(1 << width, np.int32)
                step, count_ = unpacked((3, 1), blob, n)
                total[np.cumsum(step).astype(np.int64)] += count_.astype(np.int32)
        if part is not None:
            yield made()

    dealt = texts.mapInArrow(count, "part int, n int, cells binary").repartition("part").sortWithinPartitions("part")
    marks = np.zeros(1 << (bits - 3), np.uint8)
    for part, blob in dealt.mapInArrow(add, "part int, marks binary").toLocalIterator():
        marks[part << (width - 3) : (part + 1) << (width - 3)] = np.frombuffer(blob, np.uint8)
    return marks


class Scan:
    """Counts, chunk by chunk, all occurrences of the phrases that the sketch leaves, by one automaton for the chunk.

    What it counted is told by buckets of phrases (their hashes): phrases in order, one a line, and their counts.
    """

    schema = "bucket int, lang string, phrases binary, n int, counts binary"

    def __init__(self, marks, bits: int, longest: int, buckets: int):
        self.marks, self.bits, self.longest, self.buckets = marks, bits, longest, buckets

    def candidates(self, lang: str, tokens: list[bytes], ids: np.ndarray) -> dict[bytes, int]:
        """Phrases of the chunk whose cell, and whose parts' cells, are marked; with their numbers of words."""
        marks, found, shorter = self.marks.value, {}, None
        for size, (cell, whole) in enumerate(phrase_cells(lang, ids, self.longest, self.bits), 1):
            keep = whole & ((marks[(cell >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1).astype(bool)
            if shorter is not None:
                keep &= shorter[: len(keep)] & shorter[1 : len(keep) + 1]
            chosen = keep.tolist()
            words = zip(*[compress(islice(tokens, k, None), chosen) for k in range(size)], strict=False)
            found |= dict.fromkeys(map(b" ".join, words), size)
            shorter = keep
        return found

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordIds(400_000, word_id)
        for lang, tokens in chunks(batches):
            ids = known.array(tokens)
            phrases = sorted(self.candidates(lang, tokens, ids))
            counts: Counter = Counter()
            if phrases:
                automaton = ahocorasick.Automaton()
                for k, phrase in enumerate(phrases):
                    automaton.add_word(f" {phrase.decode('latin-1')} ", k)
                automaton.make_automaton()
                # bytes stand as characters of the same number: the automaton reads text, not bytes
                counts.update(map(itemgetter(1), automaton.iter(f" {b' '.join(tokens).decode('latin-1')} ")))
                del automaton
            told = [([], []) for _ in range(self.buckets)]
            told[0][0].append(b"")
            told[0][1].append(int((ids != 0).sum()))
            for k, phrase in enumerate(phrases):
                to = told[zlib.crc32(phrase) % self.buckets]
                to[0].append(phrase)
                to[1].append(counts[k])
            rows = [(k, lang, zstandard.compress(b"\n".join(names), 3), len(n), packed((5,), np.array(n))) for k, (names, n) in enumerate(told) if n]
            del phrases, told
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.binary()), strict=True)], ["bucket", "lang", "phrases", "n", "counts"])


class Add:
    """Adds up what Scan told of each bucket and language, whose rows follow each other; phrases with few occurrences go."""

    schema = "lang string, words int, phrase string, n long"

    def __init__(self, least: int):
        self.least = least

    def rows(self, lang: str, total: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
        kept = [(p, n) for p, n in total.items() if n >= self.least or not p]
        for at in range(0, len(kept), 1 << 14):
            part = kept[at : at + (1 << 14)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(part)), pa.array([p.count(b" ") + 1 if p else 0 for p, _ in part], pa.int32()), pa.array([p for p, _ in part], pa.binary()).cast(pa.string()), pa.array([n for _, n in part], pa.int64())], ["lang", "words", "phrase", "n"])

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, total = None, defaultdict(int)
        for batch in batches:
            for bucket, lang, phrases, n, counts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, lang) != at:
                    if at:
                        yield from self.rows(at[1], total)
                    at, total = (bucket, lang), defaultdict(int)
                for phrase, k in zip(zstandard.decompress(phrases).split(b"\n"), unpacked((5,), counts, n)[0].tolist(), strict=True):
                    total[phrase] += k
        if at:
            yield from self.rows(at[1], total)


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, bits: int | None = None) -> DataFrame:
    """(lang, words, phrase, n): exact counts of all phrases of 1 to `longest` words that occur `least` times or more in
    their language, and of all words together (words 0, phrase empty).

    The sketch has a cell for four bytes of text, 2^30 cells at most (or 2^bits). Counts don't depend on its size: where
    it is small for a corpus, it only leaves more phrases to be counted.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    texts = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    if bits is None:
        bits = min(MOST_BITS, max(LEAST_BITS, int(size // 4).bit_length()))
    marks = spark.sparkContext.broadcast(sketch(texts, longest, least, bits))
    told = texts.mapInArrow(Scan(marks, bits, longest, buckets := max(32, size >> 26)), Scan.schema)
    return scratch.cut(told.repartition(buckets, "bucket").sortWithinPartitions("bucket", "lang").mapInArrow(Add(least), Add.schema))


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, cover: int = 50, top: int = 2000, bits: int | None = None) -> DataFrame:
    """Each language's first `top` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count, l and r those of its two parts at the cut with the lowest score
    floor(1000000 * a * a / (l * r)) (the first such cut), n that of all words of the language. Phrases of which a longer
    phrase has `cover` percent of the occurrences or more are dropped. Ties in score and a go by the phrase's bytes.

    Null texts are empty; documents without lang are "und"; empty texts and tables give no rows; repeated documents count
    each time; null doc_ids don't matter, and further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    counts = phrase_counts(docs, longest, least, bits)
    some = counts.where("words between 2 and " + str(longest)).select("lang", "words", "phrase", F.col("n").alias("a"))
    word = F.split("phrase", " ", -1)
    part = counts.where("words > 0").select("lang", "phrase", "n")
    cuts = some.withColumn("w", word).withColumn("k", F.explode(F.sequence(F.lit(1), F.col("words") - 1)))
    cuts = cuts.select("lang", "words", "phrase", "a", "k", F.concat_ws(" ", F.expr("slice(w, 1, k)")).alias("left"), F.concat_ws(" ", F.expr("slice(w, k + 1, words - k)")).alias("right"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("n").alias("l")), ["lang", "left"]).join(part.select("lang", F.col("phrase").alias("right"), F.col("n").alias("r")), ["lang", "right"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    # whole numbers of up to 38 digits, so the quotient is exact
    cuts = cuts.withColumn("top", (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("low", (wide("l") * wide("r")).cast("decimal(38,0)"))
    cuts = cuts.withColumn("score", F.expr("top div low"))
    worst = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    inner = some.where("words > 2").withColumn("w", word).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("words") - 1))).withColumn("at", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("size") + 1)))
    inner = inner.groupBy("lang", F.concat_ws(" ", F.expr("slice(w, at, size)")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = worst.join(inner, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < cover * F.col("a"), F.lit(True)))
    # the first of each language among the first of its parts, so no task ranks a whole language
    row = kept.select("lang", F.struct((-F.col("c.score")).alias("score"), (-F.col("a")).alias("a"), "phrase").alias("order"), "phrase", "a", "c.l", "c.r", "c.score", F.pmod(F.xxhash64("phrase"), F.lit(64)).alias("deal"))
    row.createOrReplaceTempView(view := f"telltale_phrases_{id(row)}")
    first = docs.sparkSession.sql(f"select * from (select *, row_number() over (partition by lang, deal order by order) as rank from {view}) where rank <= {top}").drop("rank")
    scratch.cut(first).createOrReplaceTempView(view)
    ranked = docs.sparkSession.sql(f"select *, row_number() over (partition by lang order by order) as rank from {view}").where(F.col("rank") <= top)
    total = counts.where("words = 0").select("lang", "n")
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
