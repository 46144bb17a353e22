"""Spelling variants: automata find the halves of words in other words, hits that fit in place and length are verified."""

from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, ship

#: Letters of a run; each has one code point, and one byte in Latin-1.
LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Words whose halves one automaton holds.
SHARD_WORDS = 25_000


def spelled(docs: DataFrame, shortest: int = 7, often: int = 2, every: int = 31) -> DataFrame:
    """(word, n): words of at least `shortest` letters that occur `often` times or more, after every `every`-th run (by a hash of document and run) has lost a letter."""
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.expr(f"regexp_extract_all(text, '[{LETTERS}]{{{shortest},}}', 0)")).alias("run"))
    runs = runs.select("id", F.translate("run", UPPER, LOWER).alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat_ws(":", "id", "run").cast("binary"))).withColumn("at", (F.col("h") % F.length("run")).cast("int"))
    word = F.when(F.col("h") % every == 0, F.concat(F.expr("substring(run, 1, at)"), F.expr("substring(run, at + 2)"))).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= often)


def halves(word: str) -> tuple[str, str]:
    return word[: len(word) // 2], word[len(word) // 2 :]


def one_apart(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced character makes b of a."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k:] == b[k + 1 :] if len(a) < len(b) else a[k + 1 :] == b[k + 1 :]


class Shard:
    """An automaton of halves. A left half is guarded by the word's start, a right half by its end.

    Behind each half are its words, by the length and by the halves of what is left of them: what is left of two words
    that are one edit apart differs by one edit too, so it shares a half again. Only such words are verified.
    """

    def __init__(self):
        self.owners: dict[tuple, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        self.automaton = None

    def hold(self, word: str, n: int, left: bool) -> None:
        a, b = halves(word)
        half, rest = (a, b) if left else (b, a)
        c, d = halves(rest)
        found = self.owners[half, left]
        found[len(word), 0, c].append((word, n))
        found[len(word), 1, d].append((word, n))

    def close(self) -> None:
        self.automaton = ahocorasick.Automaton()
        for (half, left), found in self.owners.items():
            self.automaton.add_word(f"^{half}" if left else f"{half}$", (len(half), left, found))
        if len(self.automaton):
            self.automaton.make_automaton()

    def near(self, word: str) -> Iterator[tuple[str, int]]:
        """Held words that are one edit apart from word. A right half counts only where the left one doesn't fit, so each is told once."""
        if not len(self.automaton):
            return
        n = len(word)
        for _, (size, left, found) in self.automaton.iter(f"^{word}$"):
            rest = word[size:] if left else word[: n - size]
            for length in (n - 1, n, n + 1):
                if (length // 2 if left else length - length // 2) != size:
                    continue
                # the owner's rest is as long as its word without the half; its own halves stand at the rest's start or end
                c = (length - size) // 2
                d = length - size - c
                for other, k in found.get((length, 0, rest[:c]), ()):
                    if one_apart(other, word) and (left or not word.startswith(halves(other)[0])):
                        yield other, k
                if d <= len(rest):
                    for other, k in found.get((length, 1, rest[len(rest) - d :]), ()):
                        other_rest = other[size:] if left else other[: length - size]
                        if rest[:c] != other_rest[:c] and one_apart(other, word) and (left or not word.startswith(halves(other)[0])):
                            yield other, k


class Scan:
    """Partitions hold rows of one shard after the other, the shard's halves (role 0) before the words to be scanned."""

    schema = "word string, n_near long, best_n long, best string"

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, held = None, None
        for batch in batches:
            out = []
            for at, role, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "role", "word", "n")), strict=True):
                if at != shard:
                    shard, held = at, Shard()
                if role < 2:
                    held.hold(word, n, role == 0)
                    continue
                if held.automaton is None:
                    held.close()
                if near := list(held.near(word)):
                    k, best = min((-k, other) for other, k in near)
                    out.append((word, len(near), -k, best))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])


def near_words(words: DataFrame, shards: int, salts: int = 8) -> DataFrame:
    """(word, n_near, best_n, best): how many words are one edit apart from each, and the most frequent of them.

    A half is held by the shard of its hash; a word goes to the shards of the halves that a word one edit apart may have.
    What a shard scans is dealt over `salts` tasks that hold the same halves, so a half that very many words share
    doesn't make one task.
    """
    size = F.length("word")
    side = lambda left, part: F.pmod(F.xxhash64(F.lit(left), part), F.lit(shards))
    first = lambda k: F.substring("word", F.lit(1), k)
    last = lambda k: F.substring("word", size - k + 1, k)
    half = F.floor(size / 2).cast("int")

    def dealt(role: Column, shard: Column, salt: Column) -> Column:
        return F.struct(role.cast("int").alias("role"), shard.alias("shard"), salt.cast("int").alias("salt"))

    every = F.sequence(F.lit(0), F.lit(salts - 1))
    own = lambda role, shard: F.transform(every, lambda s: dealt(F.lit(role), shard, s))
    held = F.concat(own(0, side(True, first(half))), own(1, side(False, last(size - half))))
    lengths = [size - 1, size, size + 1]
    to = F.array_distinct(F.array(*[side(True, first(F.floor(k / 2).cast("int"))) for k in lengths], *[side(False, last((k - F.floor(k / 2)).cast("int"))) for k in lengths]))
    scanned = F.transform(to, lambda shard: dealt(F.lit(2), shard, F.pmod(F.xxhash64("word"), F.lit(salts))))
    rows = words.select("word", "n", F.explode(F.concat(held, scanned)).alias("d")).select("word", "n", "d.role", "d.shard", "d.salt")
    rows = rows.repartition(shards * salts, "shard", "salt").sortWithinPartitions("shard", "salt", "role")
    rows = rows.withColumn("shard", F.col("shard") * salts + F.col("salt"))
    found = rows.select("shard", "role", "word", "n").mapInArrow(Scan(), Scan.schema)
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.n")).alias("best_n"), F.col("b.word").alias("best"))


def spelling_variants(docs: DataFrame, shortest: int = 7, often: int = 2, every: int = 31, ratio: int = 10, shard_words: int = SHARD_WORDS) -> DataFrame:
    """word, n, n_near, form, form_n, root for each word that `spelled` gives.

    form is the most frequent word one edit apart (of equally frequent ones the first in code-point order), if it is at
    least `ratio` times as frequent; root is where following forms ends. A form is more frequent than what leads to it,
    so paths end.

    Null and empty texts have no words, a null doc_id hashes as an empty one; repeated rows count each time; an empty
    table gives no rows; further columns are ignored.
    """
    scratch = Scratch(docs.sparkSession)
    ship(docs.sparkSession)
    words = scratch.cut(spelled(docs.select("doc_id", "text"), shortest, often, every))
    shards = max(1, -(-words.count() // shard_words))
    near = near_words(words, shards, salts=min(8, shards))
    formed = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), *[F.when(F.col("best_n") >= ratio * F.col("n"), F.col(c)).alias(to) for c, to in (("best", "form"), ("best_n", "form_n"))])
    formed = scratch.cut(formed)
    steps = scratch.cut(formed.where("form is not null").select("word", F.col("form").alias("root")))
    while True:  # each round doubles the length of the paths followed
        onward = steps.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = scratch.cut(steps.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        moved = longer.where("moved").limit(1).count()
        scratch.drop(steps)
        steps = longer.select("word", "root")
        steps.scratch_path = longer.scratch_path
        if not moved:
            break
    return formed.join(steps, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("root", "word").alias("root"))
