"""Best-fit packing: tokenised documents go whole into as few sequences as bin completion finds."""

import bisect
import functools
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, WordIds, small_batches

#: Strings of the vocabulary's special tokens: a text that holds one is encoded whole.
SPECIAL = (b"<|startoftext|>", b"<|endoftext|>")


#: How the vocabulary cuts a lower-case word of printable ASCII (fixed value, from its file).
ASCII_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")


class Encoder:
    """Text (bytes) to little-endian 32-bit ids.

    The vocabulary never joins words across white space, and merges within the pieces of a word only, so words and
    pieces are encoded once each and kept; both stores are bounded.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge, self.normal, self.cut = self.tokenizer.model.tokenize, self.tokenizer.normalizer.normalize_str, self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.pieces = WordIds(limit=400_000, of=lambda p: np.array([t.id for t in self.merge(p)], "<u4").tobytes())
        self.words = WordIds(limit=600_000, of=self.word)

    def word(self, word: bytes) -> bytes:
        text = word.decode()
        if text.isascii() and text.isprintable():
            return b"".join(map(self.pieces.__getitem__, ASCII_PIECES.findall(text.lower())))
        return b"".join([self.pieces[p] for p, _ in self.cut(self.normal(text))])

    def __call__(self, text: bytes) -> bytes:
        if any(s in text for s in SPECIAL):
            return np.array(self.tokenizer.encode(text.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(map(self.words.__getitem__, text.split()))


@functools.cache
def encoder(path: str) -> Encoder:
    """One for each Python worker, with what it knows from tasks before."""
    return Encoder(path)


def tokenise(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most capacity ids: doc_id, piece, start, length, ids_crc32 (and ids). Null text: only the end id."""
    small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int32()))] if keep_ids else []

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary)
        for batch in batches:
            rows = []
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                ids = encode(text or b"") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part), *([np.frombuffer(part, "<i4")] if keep_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(fields)], [n for n, _ in fields])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(cut, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * keep_ids)


def lower_bound(histogram: dict[int, int], capacity: int) -> int:
    """No plan has fewer sequences: lengths over capacity - k are alone among those of k or more, and what others over half leave is all that lengths from k to half can use without new sequences."""
    lengths = sorted(histogram)
    best = -(-sum(k * n for k, n in histogram.items()) // capacity)
    for k in (x for x in lengths if 2 * x <= capacity):
        alone = sum(histogram[x] for x in lengths if x > capacity - k)
        large = [x for x in lengths if capacity // 2 < x <= capacity - k]
        small = sum(x * histogram[x] for x in lengths if k <= x <= capacity // 2)
        spare = sum(histogram[x] * (capacity - x) for x in large)
        best = max(best, alone + sum(histogram[x] for x in large) + max(0, -(-(small - spare) // capacity)))
    return best


def best_fit(histogram: dict[int, int], capacity: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Longest first, each into the sequence whose room is the tightest: (filling, number of equal sequences) pairs."""
    rooms: dict[int, list] = {}
    order: list[int] = []

    def put(room: int, filling: tuple, n: int) -> None:
        if n:
            if room not in rooms:
                bisect.insort(order, room)
            rooms.setdefault(room, []).append((filling, n))

    def use(filling: tuple, room: int, n: int, length: int, left: int) -> int:
        """Puts `left` pieces into n equal sequences, each filled up before the next; returns what is left over."""
        each = room // length
        full, rest = min(n, left // each), 0
        put(room - each * length, (*filling, (length, each)), full)
        if full < n and left - full * each:
            rest = left - full * each
            put(room - rest * length, (*filling, (length, rest)), 1)
        put(room, filling, n - full - bool(rest))
        return left - full * each - rest

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left:
            i = bisect.bisect_left(order, length)
            if i == len(order):
                use((), capacity, -(-left // (capacity // length)), length, left)
                break
            room = order[i]
            filling, n = rooms[room].pop()
            if not rooms[room]:
                del rooms[room]
                order.pop(i)
            left = use(filling, room, n, length, left)
    return [(list(f), n) for found in rooms.values() for f, n in found]


class Fillings:
    """The fillings of a room by lengths that are left, best ones first.

    Bit t of reach[i] says whether the i shortest lengths can fill exactly t. So the least waste is read off, not
    searched for, and branches that can't end in it are never entered. Of fillings with one total only the one with the
    longest pieces is undominated: it leaves the shorter ones, which fit wherever a longer one does.
    """

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.counts, self.capacity = {k: n for k, n in histogram.items() if n}, capacity
        self.lengths, self.reach, self.mask = sorted(self.counts), [1], (1 << (capacity + 1)) - 1

    def usable(self, length: int) -> int:
        return min(self.counts[length], self.capacity // length)

    def take(self, length: int, n: int) -> None:
        i, before = bisect.bisect_left(self.lengths, length), self.usable(length)
        self.counts[length] -= n
        if self.usable(length) != before:
            del self.reach[i + 1 :]
        if not self.counts[length]:
            del self.counts[length]
            self.lengths.pop(i)

    def upto(self, i: int) -> int:
        while len(self.reach) <= i:
            length, bits = self.lengths[len(self.reach) - 1], self.reach[-1]
            n, step = self.usable(length), 1
            while n > 0:
                bits |= bits << (length * min(step, n)) & self.mask
                n, step = n - step, step * 2
            self.reach.append(bits & self.mask)
        return self.reach[i]

    def best(self, room: int, skip: int = 0) -> list[tuple[int, int]]:
        """(length, copies) pairs, longest first, of the total that is the skip-th nearest to the room."""
        i = bisect.bisect_right(self.lengths, room)
        totals = self.upto(i) & ((1 << (room + 1)) - 1)
        for _ in range(skip):
            if totals.bit_count() > 1:
                totals ^= 1 << (totals.bit_length() - 1)
        total, out = totals.bit_length() - 1, []
        while total:
            i -= 1
            length = self.lengths[i]
            n = min(self.usable(length), total // length)
            while n and not self.upto(i) >> (total - n * length) & 1:
                n -= 1
            if n:
                out.append((length, n))
                total -= n * length
        return out


def complete(histogram: dict[int, int], capacity: int, waste: int, astray: int | None = None) -> list[tuple[list[tuple[int, int]], int]] | None:
    """Bin completion: the longest piece left opens a sequence, its best filling closes it, as often as the counts allow.

    The branch ends (None) as soon as more than `waste` is left empty. `astray`: the step that takes its second best filling.
    """
    left, out, step = Fillings(histogram, capacity), [], 0
    while left.lengths:
        longest = left.lengths[-1]
        left.take(longest, 1)
        filling = left.best(capacity - longest, int(step == astray))
        need = dict(filling)
        need[longest] = need.get(longest, 0) + 1
        times = min((left.counts.get(x, 0) + (x == longest)) // n for x, n in need.items())
        for x, n in need.items():
            gone = n * times - (x == longest)
            if gone:
                left.take(x, gone)
        waste -= times * (capacity - sum(x * n for x, n in need.items()))
        if waste < 0:
            return None
        out.append((sorted(need.items(), reverse=True), times))
        step += 1
    return out


def plan(histogram: dict[int, int], capacity: int, tries: int = 8) -> list[tuple[list[tuple[int, int]], int]]:
    """(filling, number of equal sequences) pairs that use up the histogram, by branch and bound over bin completions.

    The incumbent is the best-fit plan. A branch must waste less than the incumbent would with one sequence less, or it
    is cut; a branch that ends becomes the incumbent. The search is over when the incumbent meets the lower bound, or
    after the best completions and `tries` branches that go astray once, at one of the first steps: which plan is the
    best of all can't be told in reasonable time in general. All work is on counts of lengths, so it depends on the
    capacity, not on the number of documents.
    """
    total, least = sum(k * n for k, n in histogram.items()), lower_bound(histogram, capacity)
    incumbent = best_fit(histogram, capacity)
    for astray in (None, *range(tries)):
        size = sum(n for _, n in incumbent)
        if size <= least:
            break
        incumbent = complete(histogram, capacity, (size - 1) * capacity - total, astray) or incumbent
    return incumbent


def segments(patterns: list, shift: int = 40) -> dict[str, np.ndarray]:
    """For each length, which of its ranks go to which sequences and where in them; sorted by length and first rank."""
    used, rows, base = {}, [], 0
    for filling, times in patterns:
        offset = 0
        for length, n in filling:
            rows.append(((length << shift) + used.get(length, 0), n, base, offset))
            used[length] = used.get(length, 0) + n * times
            offset += n * length
        base += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 4)
    return dict(zip(("key", "copies", "base", "offset"), table.T.copy(), strict=True))


def pack(docs: DataFrame, vocabulary: str, capacity: int = 4096, end_id: int = 1, keep_ids: bool = False, rows_per_salt: int = 50_000) -> DataFrame:
    """Pieces with sequence_id and offset: every document, in sequences of at most capacity ids.

    Only a histogram of piece lengths (at most capacity rows) reaches the driver. Pieces are ranked within length and
    a salt, so that no length, however common, is ranked in one task. Null and empty texts give a piece of one id;
    repeated rows are packed once each; an empty table gives no rows; further columns are ignored.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    pieces = scratch.cut(tokenise(docs, vocabulary, capacity, end_id, keep_ids))
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    salts = max(16, sum(histogram.values()) // rows_per_salt)
    table = spark.sparkContext.broadcast(segments(plan(histogram, capacity)))
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    # at most `capacity` lengths times the salts, which are few beside the rows
    before = before.withColumn("before", F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).drop("n")
    ranked = salted.withColumn("rank", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")))
    ranked = ranked.join(before, ["length", "salt"]).select(*pieces.columns, (F.col("before") + F.col("rank") - 1).alias("rank"))

    kinds = pieces.dtypes
    cols = [c for c, _ in kinds]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = table.value
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "rank"))
            at = np.searchsorted(t["key"], (length << 40) + rank, "right") - 1
            turn, slot = np.divmod((length << 40) + rank - t["key"][at], t["copies"][at])
            yield pa.RecordBatch.from_arrays([*batch.select(cols).columns, pa.array(t["base"][at] + turn), pa.array(t["offset"][at] + slot * length)], [*cols, "sequence_id", "offset"])

    return ranked.mapInArrow(place, ", ".join(f"{c} {k}" for c, k in kinds) + ", sequence_id long, offset long")
