"""LM scoring: per-token difference of the cross-entropies of a target and a background n-gram model."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, WordIds, mix, small_batches

#: A chunk of documents ends at so many words or documents.
CHUNK_WORDS, CHUNK_DOCS = 500_000, 1 << 15
#: So many buckets of keys at least.
LEAST_BUCKETS = 32
#: Bits of a word's number; numbers are hot words', from 1 on. 0 is the start of a text.
BITS = np.uint64(20)
#: Cold words stand as hashes with this bit.
COLD = np.uint64(1 << 63)
#: Bytes of the columns of a request (key, counts in all and in target documents), of an answer (both sums) and of words.
REQUEST, ANSWER, WORDS = (8, 4, 4), (6, 6), (8,)


def runs(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order, and how often each occurs."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])) if len(values) else np.zeros(0, np.int64)
    return values[first], np.diff(np.append(first, len(values)))


def tally(values: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, and how often each occurs in all and with a flag."""
    at, every = runs(values)
    some, n = runs(values[flags])
    marked = np.zeros(len(at), np.int64)
    marked[np.searchsorted(at, some)] = n
    return at, np.stack([every, marked])


def packed(planes: tuple, *columns: np.ndarray) -> bytes:
    """Unsigned columns as compressed byte planes."""
    return zstandard.compress(b"".join(np.ascontiguousarray(c.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :k].T).tobytes() for c, k in zip(columns, planes, strict=True)), 1)


def unpacked(planes: tuple, blob: bytes, n: int) -> list[np.ndarray]:
    raw, out, at = np.frombuffer(zstandard.decompress(blob), np.uint8), [], 0
    for k in planes:
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :k] = raw[at : at + n * k].reshape(k, n).T
        out.append(wide.view("<u8").ravel())
        at += n * k
    return out


class Chunk:
    """Words of some documents one after the other, which document each is in, and each document's target flag."""

    def __init__(self, words: np.ndarray, lengths: np.ndarray, flags: np.ndarray):
        self.words, self.lengths, self.flags = words, lengths, flags
        self.at = np.repeat(np.arange(len(lengths), dtype=np.uint64), lengths)
        self.marked = flags.astype(bool)[self.at.astype(np.int64)]

    def numbers(self, other: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The word before each, each word, both as numbers, and which are cold; all cold words are the number `other`."""
        cold = self.words >= COLD
        word = np.where(cold, np.uint64(other), self.words)
        before = np.concatenate([np.zeros(min(1, len(word)), np.uint64), word[:-1]])
        before[np.append(True, self.at[1:] != self.at[:-1])[: len(word)]] = 0
        return before, word, cold

    def keys(self, other: int) -> tuple[np.ndarray, np.ndarray]:
        """What must be counted over all chunks: each pair of numbers and each cold word, with its flags."""
        before, word, cold = self.numbers(other)
        return np.concatenate([(before << BITS) + word, self.words[cold]]), np.concatenate([self.marked, self.marked[cold]])


def chunks(batches: Iterator[pa.RecordBatch], ids: WordIds, size: int = CHUNK_WORDS) -> Iterator[tuple[int, list, Chunk]]:
    """(number of the first row, doc_ids, words as `ids` has them) of bounded numbers of documents."""

    def made():
        return rows[0][0], [r[1] for r in rows], Chunk(np.concatenate(words), np.array([len(w) for w in words]), np.array(flags))

    rows, words, flags, n = [], [], [], 0
    for batch in batches:
        for uid, doc, target, text in zip(*(batch.column(c).to_pylist() for c in ("uid", "doc_id", "target", "text")), strict=True):
            w = ids.array((text or b"").lower().split())
            rows.append((uid, doc))
            words.append(w)
            flags.append(target)
            n += len(w)
            if n >= size or len(rows) >= CHUNK_DOCS:
                yield made()
                rows, words, flags, n = [], [], [], 0
    if rows:
        yield made()


def word_totals(docs: DataFrame) -> DataFrame:
    """(key, background, target): how often each word occurs in all and in target documents; key 0 counts texts that have words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, _, chunk in chunks(batches, WordIds(), 2 * CHUNK_WORDS):
            at, sums = tally(chunk.words, chunk.marked)
            full = chunk.lengths > 0
            keys, sums = np.append(at, np.uint64(0)), np.append(sums, [[full.sum()], [(full * chunk.flags).sum()]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), *map(pa.array, sums)], ["key", "background", "target"])

    return docs.mapInArrow(count, "key long, background long, target long").groupBy("key").agg(F.sum("background").alias("background"), F.sum("target").alias("target"))


class Model:
    """Counts of hot words for both models, in order of their numbers, with the start first and all cold words together last."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, totals: np.ndarray, starts: np.ndarray, back: float, cold_words: int):
        self.keys, self.back, self.totals, self.cold_words = keys, back, totals, cold_words
        self.counts = np.hstack([starts[:, None], counts, totals[:, None] - counts.sum(1, keepdims=True)])
        self.other = len(keys) + 1

    def ids(self) -> WordIds:
        """Hot words' numbers and cold words' hashes."""
        numbers = {k: n for n, k in enumerate(self.keys.tolist(), 1)}

        def number(word: bytes) -> int:
            key = xxhash.xxh3_64_intdigest(word)
            return numbers.get(key) or key | 1 << 63

        return WordIds(of=number)

    def losses(self, chunk: Chunk, keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Background and target loss of each document, by the counts of the chunk's keys (sorted) over all chunks."""
        before, word, cold = chunk.numbers(self.other)
        n = len(chunk.lengths)
        pairs, times = runs((chunk.at << (BITS + BITS)) + (before << BITS) + word)
        own, often = runs((chunk.at << BITS) + word)
        doc, a, b = pairs >> (BITS + BITS), (pairs >> BITS) & ((np.uint64(1) << BITS) - np.uint64(1)), pairs & ((np.uint64(1) << BITS) - np.uint64(1))
        own_b, own_a = often[np.searchsorted(own, (doc << BITS) + b)], np.ones(len(pairs), np.int64)
        own_a[a > 0] = often[np.searchsorted(own, ((doc << BITS) + a)[a > 0])]
        pair = counts[:, np.searchsorted(keys, (a << BITS) + b)]
        names, inverse = np.unique(chunk.words[cold], return_inverse=True)
        rare, rare_times = runs((chunk.at[cold] << np.uint64(32)) + inverse.astype(np.uint64))
        rare_doc = (rare >> np.uint64(32)).astype(np.int64)
        known = counts[:, np.searchsorted(keys, names)][:, (rare & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        doc, a, b = doc.astype(np.int64), a.astype(np.int64), b.astype(np.int64)
        out = []
        for k in (0, 1):
            inside, rare_inside = (np.ones(len(x), bool) if k == 0 else chunk.flags.astype(bool)[x] for x in (doc, rare_doc))
            p = (np.maximum(self.counts[k][b] - inside * own_b, 0) + 0.5) / (self.totals[k] + 0.5 * self.other)
            both, context = np.maximum(pair[k] - inside * times, 0), np.maximum(self.counts[k][a] - inside * own_a, 0)
            loss = -times * np.log((both + self.back * p) / (np.maximum(context, both) + self.back))
            among = (np.maximum(known[k] - rare_inside * rare_times, 0) + 0.5) / (self.counts[k][-1] + 0.5 * self.cold_words)
            both = np.bincount(doc, loss, n) + np.bincount(rare_doc, -rare_times * np.log(among), n)
            out.append(both.astype(float))  # without any word bincount gives integers
        return np.stack(out)


def in_buckets(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets that keys go to, in order, and the order of the keys."""
    bucket = (mix(keys) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)
    order = np.argsort(bucket, kind="stable")
    return bucket[order], order


def lm_scores(docs: DataFrame, target: Column, back: float = 2.0, hot_share: float = 2.0**-19, bucket_words: int = 1_000_000) -> DataFrame:
    """doc_id, n_tokens, target_loss, background_loss, score (their difference; lower: more like the target).

    The background model counts every document, the target model those for which the condition `target` holds; both
    share all words and smooth alike: a pair's probability is (count + back * word's probability) / (context + back).
    Hot words, those of at least `hot_share` of all words and so fewer than 1 / hot_share whatever the input, have pair
    counts of their own. Cold words are one class in pairs and are told apart in it by how often each occurs; all
    counts are exact, and all words count.

    Texts are read twice: for the words' counts, and to be cut into chunks. A chunk asks for each of its pairs and cold
    words once, with its own counts, in the bucket of the key; the bucket adds up what all chunks have and answers each
    in the order it asked. So a key comes in as many rows as there are chunks at most, however frequent it is, and no
    table of pairs is held or sent anywhere. Only the hot words' counts are broadcast. Words stand as 64-bit hashes.
    A document's own counts are taken from the words, contexts and pairs it is scored by, not from the total number
    of words. Null and empty texts have no tokens and null losses; repeated rows count and are scored once each; an
    empty target leaves the target model uniform; an empty table gives no rows; other columns are ignored.
    """
    if not 2.0**-19 <= hot_share:
        raise ValueError("hot words' numbers have 20 bits")
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    flagged = docs.select(F.monotonically_increasing_id().alias("uid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"), F.coalesce(target, F.lit(False)).cast("int").alias("target"))
    counts = scratch.cut(word_totals(flagged))
    words = counts.where("key != 0")
    *sums, distinct = words.agg(F.sum("background"), F.sum("target"), F.count("*")).first()
    start = counts.where("key = 0").agg(F.sum("background"), F.sum("target")).first()
    totals, starts = (np.array([x or 0 for x in r], float) for r in (sums, start))
    hot = words.where(F.col("background") >= F.lit(float(totals[0] * hot_share))).toArrow()  # fewer than 1 / hot_share rows
    keys = hot.column("key").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    known = np.stack([hot.column(c).to_numpy() for c in ("background", "target")])[:, order].astype(float)
    scratch.drop(counts)
    model = spark.sparkContext.broadcast(Model(keys[order], known, totals, starts, back, distinct - len(keys) + 1))
    buckets = max(LEAST_BUCKETS, int(totals[0] // bucket_words))
    fields = [("chunk", pa.int64()), ("bucket", pa.int64()), ("n", pa.int64()), ("data", pa.binary()), ("docs", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("flags", pa.list_(pa.int64()))]
    schema = "chunk long, bucket long, n long, data binary, docs array<long>, lengths array<long>, flags array<long>"

    def record(*columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], [x for x, _ in fields])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For each chunk one row with its words (bucket null) and one for each bucket that it asks."""
        other = model.value.other
        for name, ids, chunk in chunks(batches, model.value.ids()):
            yield record([name], [None], [len(chunk.words)], [packed(WORDS, chunk.words)], [ids], [chunk.lengths], [chunk.flags])
            asked, sums = tally(*chunk.keys(other))
            bucket, order = in_buckets(asked, buckets)
            edges = np.append(np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])), len(bucket)) if len(bucket) else [0]
            for group in range(0, len(edges) - 1, 64):
                cuts = [order[slice(*edges[k : k + 2])] for k in range(group, min(group + 64, len(edges) - 1))]
                where = [int(bucket[edges[k]]) for k in range(group, group + len(cuts))]
                yield record([name] * len(cuts), where, [len(c) for c in cuts], [packed(REQUEST, asked[c], *sums[:, c]) for c in cuts], *[[None] * len(cuts)] * 3)

    def answer(table: pa.Table) -> pa.Table:
        """What all chunks have of a bucket's keys, to each chunk in its order."""
        lengths = table.column("n").to_numpy()
        asked, *found = (np.concatenate(c) for c in zip(*(unpacked(REQUEST, x.as_py(), n) for x, n in zip(table.column("data"), lengths, strict=True)), strict=True))
        _, inverse = np.unique(asked, return_inverse=True)
        sums = [np.bincount(inverse, x) for x in found]
        ends = np.cumsum(lengths)
        data = [packed(ANSWER, *(s[inverse[e - n : e]] for s in sums)) for e, n in zip(ends, lengths, strict=True)]
        return pa.table({"chunk": table.column("chunk"), "bucket": table.column("bucket"), "n": table.column("n"), "data": pa.array(data, pa.binary())})

    def score(rows: pa.Table, answers: pa.Table) -> pa.Table:
        """The documents of a chunk with their losses."""
        parts, m = [], model.value
        for row in rows.to_pylist():  # one
            chunk = Chunk(*unpacked(WORDS, row["data"], row["n"]), np.array(row["lengths"], np.int64), np.array(row["flags"], np.int64))
            asked = np.unique(chunk.keys(m.other)[0])
            _, order = in_buckets(asked, buckets)
            told = [unpacked(ANSWER, answers.column("data")[i].as_py(), answers.column("n")[i].as_py()) for i in np.argsort(answers.column("bucket").to_numpy())]
            sums = np.zeros((2, len(asked)))
            if told:
                sums[:, order] = np.hstack([np.stack(t) for t in told])
            background, target = m.losses(chunk, asked, sums)
            parts.append(pa.table({"doc_id": pa.array(row["docs"], pa.int64()), "n_tokens": pa.array(chunk.lengths), "b": pa.array(background), "t": pa.array(target)}))
        return pa.concat_tables(parts)

    held, asked = scratch.split(flagged.mapInArrow(deal, schema), F.col("bucket").isNotNull())
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), buckets // 4)
    asking = asked.select("chunk", "bucket", "n", "data").repartition(parts, "bucket").groupBy("bucket")
    answers = scratch.cut(asking.applyInArrow(answer, "chunk long, bucket long, n long, data binary"))
    scratch.drop(asked)
    held, answers = held.drop("bucket").repartition(parts, "chunk"), answers.repartition(parts, "chunk")
    whole = held.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(score, "doc_id long, n_tokens long, b double, t double")
    per = lambda c: F.when(F.col("n_tokens") > 0, F.col(c) / F.col("n_tokens"))
    return whole.select("doc_id", "n_tokens", per("t").alias("target_loss"), per("b").alias("background_loss"), (per("t") - per("b")).alias("score"))
