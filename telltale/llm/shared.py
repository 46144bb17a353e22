"""Helpers of the text operators: tables in the shared folder, word splitting and word hashing."""

import gc

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from telltale import scratch
from telltale.shipping import ship

#: Rows in one Arrow batch, so that a batch of very long texts stays small.
BATCH_ROWS = 256


class Scratch(scratch.Scratch):
    """The same, for tables of texts: a cut also lets go of the shuffle files that led to it, or disks fill up."""

    def named(self, path: str, schema) -> DataFrame:
        gc.collect()
        self.spark._jvm.System.gc()  # Spark deletes the shuffle files of plans that the driver has forgotten
        return super().named(path, schema)


def small_batches(spark: SparkSession) -> None:
    """Ships the package to Python workers and keeps Arrow batches small enough for long texts in small executors. The setting stays: results are computed after the call."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


#: Stands for a null doc_id inside an operator, so that it is the last in order and joins with itself.
NO_ID = 2**63 - 1


def key(df: DataFrame) -> Column:
    """doc_id as a long that is never null; named() puts null back."""
    return F.coalesce(df["doc_id"].cast("long"), F.lit(NO_ID))


def named(column: str) -> Column:
    return F.nullif(F.col(column), F.lit(NO_ID))


def free(df: DataFrame, *names: str) -> list[str]:
    """These names, changed until df has no column of that name (upper and lower case are one to Spark)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def quoted(name: str) -> Column:
    """The column of that name, also if there are dots in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def uid(df: DataFrame, name: str = "uid") -> DataFrame:
    """Adds a row number that tells rows of equal doc_id apart; fix it with Scratch.cut before it is used twice."""
    return df.withColumn(name, F.monotonically_increasing_id())


def join_hot(big: DataFrame, small: DataFrame, key: str, n: str, total: int) -> DataFrame:
    """Left join of big with small, a written table with a row for each (text) key, its n the rows of big that it has at most.

    Keys of a thousandth of all `total` rows or more are at most 1000 and broadcast. The rows that have them don't meet
    in one task when the others are shuffled by their keys.
    """
    values = [c for c in small.columns if c != key]
    is_hot = F.col(n) * 1000 >= total
    hot = small.where(is_hot).select(key, F.struct(*values).alias("__hot"))
    cold = small.where(~is_hot).select(F.col(key).alias("__key"), F.struct(*values).alias("__cold"))
    out = big.join(F.broadcast(hot), key, "left")
    own = F.when(F.col("__hot").isNull(), F.col(key))
    own = F.coalesce(own, F.concat(F.lit("no key "), F.monotonically_increasing_id().cast("string")))
    out = out.withColumn("__own", own).join(cold, F.col("__own") == F.col("__key"), "left")
    return out.select(*big.columns, *[F.coalesce(f"__hot.{c}", f"__cold.{c}").alias(c) for c in values])


class WordIds(dict):
    """Word (bytes) to what `of` makes of it, a 64-bit id by default. Its memory is bounded: when full, it keeps what it had as an older store, from which words that come again are taken over, and forgets the older store before."""

    def __init__(self, limit: int = 200_000, of=xxhash.xxh3_64_intdigest):
        self.limit, self.of, self.old = limit // 2, of, {}

    def __missing__(self, word):
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        value = self.old.get(word)
        if value is None:
            value = self.of(word)
        self[word] = value
        return value

    def array(self, words: list) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: For bytes.translate: A-Z to a-z and every other ASCII character that is no digit or letter to a space.
ALNUM_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values (the finisher of splitmix64)."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each run of size ids; empty if there are fewer."""
    n = len(ids) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h * MULTIPLIER + ids[k : k + n]
    return mix(h)
