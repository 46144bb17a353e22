"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows scans the training texts."""

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from telltale.llm.shared import ALNUM_WORDS, MULTIPLIER, Scratch, WordIds, free, mix, quoted, small_batches, windows

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPANS, ITEMS = "array<struct<start:int,end:int>>", "array<string>"


def split_words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(ALNUM_WORDS).split()


def benchmark_windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(hash, window, n, item): each distinct window of each item, its words joined by a space. An item without an id has the empty one."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = WordIds()
        for batch in batches:
            rows = set()
            for item, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words = split_words(text)
                n = min(size, len(words))
                if n:
                    hashes = windows(ids.array(words), n).view(np.int64).tolist()
                    rows |= {(h, b" ".join(words[i : i + n]), n, item) for i, h in enumerate(hashes)}
            rows = list(rows)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.binary(), pa.int32(), pa.string()))], ["hash", "window", "n", "item"])

    few = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")), F.col("text").cast("binary"))
    return few.mapInArrow(make, "hash long, window binary, n int, item string")


class Matcher:
    """Finds the windows of one block in texts. Equal hashes are only candidates: their words are compared.

    Windows of one length lie in order of their hashes, so the time for a document hardly grows with the benchmark.
    """

    BITS = 20

    def __init__(self, rows: list[tuple[int, bytes, int, str]]):
        by_length: dict[int, list] = {}
        for h, window, n, item in rows:
            by_length.setdefault(n, []).append((h & (1 << 64) - 1, bytes(window), item))
        self.blocks, self.maybe = {}, {}
        for n, found in sorted(by_length.items()):
            found.sort()
            self.blocks[n] = np.array([h for h, _, _ in found], np.uint64), [w for _, w, _ in found], [i for _, _, i in found]

    def filters(self) -> None:
        """A bit for each beginning of a hash, made where it is used."""
        for n, (keys, _, _) in self.blocks.items():
            self.maybe[n] = np.zeros(1 << self.BITS, bool)
            self.maybe[n][keys >> np.uint64(64 - self.BITS)] = True

    def find(self, texts: list[list[bytes]], ids: WordIds) -> dict[int, tuple[list[tuple[int, int]], set]]:
        """Spans and items of each text (by its place) in which anything is found; all texts' words are hashed in one go."""
        if not self.maybe:
            self.filters()
        words = list(chain.from_iterable(texts))
        starts = np.cumsum([0, *map(len, texts)])
        numbers, out = ids.array(words), {}
        h = np.zeros(len(words), np.uint64)
        for n in range(1, max(self.blocks, default=0) + 1):
            if len(words) < n:
                break
            h = h[: len(words) - n + 1] * MULTIPLIER + numbers[n - 1 :]
            if n not in self.blocks:
                continue
            keys, windows_, items = self.blocks[n]
            full = mix(h)
            at = np.flatnonzero(self.maybe[n][full >> np.uint64(64 - self.BITS)])
            place = np.searchsorted(keys, full[at])
            same = (place < len(keys)) & (keys[np.minimum(place, len(keys) - 1)] == full[at])
            at, place = at[same], place[same]
            doc = np.searchsorted(starts, at, "right") - 1
            for i, p, d in zip(at.tolist(), place.tolist(), doc.tolist(), strict=True):
                first = int(starts[d])
                if i + n > starts[d + 1]:
                    continue
                text = b" ".join(words[i : i + n])
                known = {items[k] for k in range(p, int(np.searchsorted(keys, keys[p], "right"))) if windows_[k] == text}
                if known:
                    spans, had = out.setdefault(d, ([], set()))
                    spans.append((i - first, i - first + n))
                    had |= known
        return out


def covered(spans: list[tuple[int, int]], n: int) -> np.ndarray:
    """Which of n words lie in any span."""
    step = np.zeros(n + 1, np.int64)
    for a, b in spans:
        step[a] += 1
        step[b] -= 1
    return np.cumsum(step)[:n] > 0


def find_hits(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 32_000_000, keep: list[str] | None = None, then=None) -> DataFrame:
    """docs with two more columns, word ranges that match and the benchmark items found, or what `then` makes of them.

    One set of windows of about block_bytes (with the items' names) is broadcast at a time: a larger benchmark is dealt
    into blocks by a hash of window and item, and the documents pass once by each block. Null and empty texts have no
    words and no hits.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    keep = keep or docs.columns
    # names of their own inside: Python functions can't be given columns with dots in their names
    own = [f"c{k}" for k in range(len(keep))]
    plain = docs.select(*[quoted(c).alias(o) for c, o in zip(keep, own, strict=True)])
    known = scratch.cut(benchmark_windows(benchmark, size))
    size_of = F.octet_length("window") + F.octet_length("item") + 16
    blocks = max(1, -(-(known.agg(F.sum(size_of)).first()[0] or 0) // block_bytes))
    dealt = known.withColumn("block", F.pmod(F.xxhash64("window", "item"), F.lit(blocks)))
    spans_name, items_name = free(docs, "spans", "items")
    out = plain.withColumn(spans_name, F.array().cast(SPANS)).withColumn(items_name, F.array().cast(ITEMS))
    text_at = keep.index("text")
    for block in range(blocks):
        rows = [tuple(r) for r in dealt.where(F.col("block") == block).select("hash", "window", "n", "item").toLocalIterator()]
        shared = spark.sparkContext.broadcast(Matcher(rows))
        last = block == blocks - 1

        def scan(batches: Iterator[pa.RecordBatch], shared=shared, last=last, block=block) -> Iterator[pa.RecordBatch]:
            matcher, ids = shared.value, WordIds()
            for batch in batches:
                texts = batch.column(text_at).cast(pa.binary()).to_pylist()
                words = [split_words(t) for t in texts]
                hits = matcher.find(words, ids)
                spans, items = ([[] for _ in texts] for _ in range(2))
                for k, (was, had) in enumerate(zip(*(batch.column(c).to_pylist() for c in (spans_name, items_name)), strict=True) if block else ()):
                    spans[k], items[k] = [(x["start"], x["end"]) for x in was], had
                for k, (s, i) in hits.items():
                    spans[k], items[k] = spans[k] + s, sorted({*items[k], *i})
                texts = [(t, len(w)) for t, w in zip(texts, words, strict=True)]
                base = batch.select(own).rename_columns(keep if last and then else own)
                if last and then:
                    yield from then(base, texts, spans, items)
                else:
                    yield pa.RecordBatch.from_arrays(
                        [*base.columns, pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), pa.array(items, pa.list_(pa.string()))],
                        [*own, spans_name, items_name],
                    )

        schema = then.schema if last and then else T.StructType([*plain.schema.fields, *out.schema.fields[-2:]])
        out = out.mapInArrow(scan, schema)
        if not last:
            out = scratch.cut(out)
    return out if then else out.toDF(*keep, spans_name, items_name)


class Report:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for each document."""

    schema = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"

    def __call__(self, base, texts, spans, items):
        hit = [int(covered(s, n).sum()) if s else 0 for s, (_, n) in zip(spans, texts, strict=True)]
        yield pa.RecordBatch.from_arrays(
            [base.column("doc_id").cast(pa.int64()), pa.array([n for _, n in texts], pa.int64()), pa.array(hit, pa.int64()), pa.array([len(i) for i in items], pa.int64()), pa.array([hashlib.sha256(",".join(i).encode()).hexdigest() for i in items]), pa.array([h > 0 for h in hit], pa.bool_())],
            ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
        )


class Cleaned:
    """The documents without the contaminated ones, or (spans=True) without the words that are hit."""

    def __init__(self, schema, spans: bool):
        self.schema, self.spans = schema, spans

    def __call__(self, base, texts, spans, items):
        if not self.spans:
            yield base.filter(pa.array([not s for s in spans], pa.bool_()))
            return
        out = []
        for (text, n), s in zip(texts, spans, strict=True):
            if s:
                hit = covered(s, n)
                parts, at = [], 0
                for k, m in enumerate(WORD.finditer(text)):
                    if hit[k]:
                        parts.append(text[at : m.start()])
                        at = m.end()
                text = b"".join([*parts, text[at:]])
            out.append(text)
        at = base.schema.get_field_index("text")
        yield base.set_column(at, "text", pa.array(out, pa.binary()).cast(base.schema.field(at).type))


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = 10, block_bytes: int = 32_000_000) -> DataFrame:
    """One row for each document: how much of it lies in windows of the benchmark.

    A null text has no words (n_words 0, not contaminated); items without words are never found; repeated rows are
    reported once each; an item without an id counts as one with an empty id; an empty benchmark contaminates nothing; further columns of docs are ignored.
    """
    return find_hits(docs, benchmark, size, block_bytes, ["doc_id", "text"], Report())


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10, remove: str = "document", block_bytes: int = 32_000_000) -> DataFrame:
    """docs, all columns (whatever their names), without contaminated documents (remove="document") or without the hit words (remove="span").

    Rows are judged one by one by their own text: null and empty texts stay as they are, repeated rows are all judged
    alike, a null doc_id is like any other; an empty table stays empty, and an empty benchmark takes nothing away.
    """
    return find_hits(docs, benchmark, size, block_bytes, docs.columns, Cleaned(docs.schema, remove == "span"))
