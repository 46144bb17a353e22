"""Exact deduplication as a stateful stream: digest-keyed state on disk, never expired, hits compared byte by byte."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, free, key, named

#: The characters that are deleted before texts are compared (fixed values): space, tab, line feed, vertical tab, form feed, carriage return.
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")

#: State lives in RocksDB, which keeps it on the executor's disk and its change log in the checkpoint folder.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "200",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no space set aside for logs
}
ARRIVAL = "key long, ident long, digest string, points int, locator string, row long"


def normalised(text: Column) -> Column:
    out = F.coalesce(text.cast("string"), F.lit(""))
    for c in SPACES:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def sha(whole: Column) -> Column:
    return F.sha2(whole, 256)


def arrivals(docs: DataFrame, digest=sha) -> DataFrame:
    """What the stream reads of each row: doc_id (never null), digest, length in code points, a stable identifier and a content locator.

    The identifier is a hash of doc_id and the original text, the same in every run however the rows are dealt; the
    locator is the file that holds the content (empty for rows that come from no file). `row` only tells rows apart
    that are equal in doc_id and text.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    few = docs.select(key(docs).alias("key"), "text", F.input_file_name().alias("locator"))
    return few.select("key", F.xxhash64("key", "text").alias("ident"), digest(normalised(F.col("text"))).alias("digest"), F.char_length(text).alias("points"), "locator", F.monotonically_increasing_id().alias("row"))


class Deduplicator:
    """Keyed state in a folder. Arrivals are added to it, and a run takes in what no run has taken in before.

    For each digest the state retains the row that stays (most code points, then least doc_id): its identifier and
    locator, and the number of rows. It has no watermark, so nothing expires: a copy is found however late it comes.
    A run that is stopped, by a lost driver or by `triggers`, goes on where it ended when the same folder is given again.
    """

    def __init__(self, spark, folder: str):
        self.spark, self.folder = spark, folder

    def add(self, docs: DataFrame, digest=sha) -> None:
        arrivals(docs, digest).write.mode("append").parquet(f"{self.folder}/arrivals")

    def arrived(self) -> DataFrame:
        return self.spark.read.schema(ARRIVAL).parquet(f"{self.folder}/arrivals")

    def run(self, files_per_trigger: int | None = None, triggers: int | None = None) -> None:
        """Takes in all arrivals, or those of so many triggers."""
        source = self.spark.readStream.schema(ARRIVAL)
        if files_per_trigger:
            source = source.option("maxFilesPerTrigger", files_per_trigger)
        best = F.struct("points", (-F.col("key")).alias("minus_key"), "ident", "locator")
        state = source.parquet(f"{self.folder}/arrivals").groupBy("digest").agg(F.max(best).alias("best"), F.count("*").alias("group_size"))
        done = 0

        def emit(batch: DataFrame, number: int) -> None:
            nonlocal done
            if triggers is not None and done >= triggers:
                raise StopIteration("enough triggers")
            batch.write.mode("overwrite").parquet(f"{self.folder}/changed/trigger={number}")
            done += 1

        before = {k: self.spark.conf.get(k, None) for k in STATE}
        try:
            for k, v in STATE.items():
                self.spark.conf.set(k, v)
            query = state.writeStream.outputMode("update").foreachBatch(emit).option("checkpointLocation", f"{self.folder}/state").trigger(availableNow=True).start()
            query.awaitTermination()
        except Exception:
            if triggers is None or done < triggers:
                raise
        finally:
            for k, v in before.items():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)

    def groups(self) -> DataFrame:
        """digest, keep (doc_id of the row that stays), keep_ident, keep_locator, group_size: of each digest what the last trigger that changed it wrote."""
        out = self.spark.read.schema("digest string, best struct<points:int,minus_key:long,ident:long,locator:string>, group_size long, trigger long").parquet(f"{self.folder}/changed")
        if out.select("trigger").distinct().count() > 1:
            out = out.groupBy("digest").agg(F.max_by(F.struct("best", "group_size"), "trigger").alias("x")).select("digest", "x.best", "x.group_size")
        return out.select("digest", (-F.col("best.minus_key")).alias("keep"), F.col("best.ident").alias("keep_ident"), F.col("best.locator").alias("keep_locator"), "group_size")


def clashes(docs: DataFrame, groups: DataFrame, scratch: Scratch, digest=sha) -> DataFrame | None:
    """The digests that different texts share, from a comparison of the full bytes of all texts whose digest was hit more than once."""
    texts = docs.select(normalised(F.col("text")).alias("whole")).withColumn("digest", digest(F.col("whole")))
    hits = texts.join(groups.where("group_size > 1").select("digest"), "digest", "left_semi")
    # both ends of each group, found with partial aggregation: equal ends mean that all its texts are equal
    wrong = hits.groupBy("digest").agg(F.min("whole").alias("low"), F.max("whole").alias("high")).where("low <> high").select("digest")
    return None if wrong.isEmpty() else scratch.cut(wrong)


def mark_copies(docs: DataFrame, verify: bool = True, files_per_trigger: int | None = None, digest=sha) -> DataFrame:
    """One row for each document: doc_id, ident, keep_id, keep_locator, group_size, kept, text_sha256.

    Texts are equal when they are identical without white space; of equal ones the row with the most code points in
    the original text, then the smallest doc_id (then the one of greatest ident) stays; of rows that are equal in
    doc_id and text too, one. Null counts as empty, and all empty texts are one group; a null doc_id comes after all
    others; an empty table gives no rows; further columns are ignored. With `verify` the full normalised texts of each
    group that has copies are compared; texts that differ though their digests are equal are grouped by their bytes.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    state = Deduplicator(spark, scratch.dir + "/dedup")
    state.add(docs, digest)
    known = state.arrived()
    if known.isEmpty():
        return spark.createDataFrame([], "doc_id long, ident long, keep_id long, keep_locator string, group_size long, kept boolean, text_sha256 string")
    state.run(files_per_trigger)
    groups = state.groups()
    wrong = clashes(docs, groups, scratch, digest) if verify else None
    told = known
    if wrong is not None:
        # few texts, if any: those that share a digest with another one are told apart by their bytes
        texts = docs.select(key(docs).alias("key"), F.col("text"), normalised(F.col("text")).alias("whole"))
        apart = texts.select("key", F.xxhash64("key", "text").alias("ident"), F.char_length(F.coalesce("text", F.lit(""))).alias("points"), digest(F.col("whole")).alias("digest"), "whole").join(wrong, "digest", "left_semi")
        new = F.concat_ws("/", "digest", F.sha2("whole", 512)).alias("named")
        best = F.max(F.struct("points", (-F.col("key")).alias("minus_key"), "ident")).alias("best")
        anew = apart.groupBy(new, "digest", "whole").agg(best, F.count("*").alias("group_size"))
        anew = anew.select(F.col("named").alias("digest"), (-F.col("best.minus_key")).alias("keep"), F.col("best.ident").alias("keep_ident"), F.lit("").alias("keep_locator"), "group_size")
        groups = groups.join(wrong, "digest", "left_anti").unionByName(anew)
        names = apart.select("key", "ident", new).distinct()
        told = known.join(names, ["key", "ident"], "left").withColumn("digest", F.coalesce("named", "digest")).drop("named")
    out = told.join(groups, "digest")
    stays = (F.col("key") == F.col("keep")) & (F.col("ident") == F.col("keep_ident"))
    # the join's partitioning by digest serves this window too
    first = F.row_number().over(Window.partitionBy("digest", "key", "ident").orderBy("row")) == 1
    return out.select(named("key").alias("doc_id"), "ident", named("keep").alias("keep_id"), "keep_locator", "group_size", (stays & first).alias("kept"), F.substring_index("digest", "/", 1).alias("text_sha256"))


def exact_dedup(docs: DataFrame) -> DataFrame:
    """docs, all columns (whatever their names), with one row of each group of equal texts.

    A dropped row is found again by doc_id and digest, a null doc_id like any other. Rows that repeat both differ in
    white space at most; of them the longest, then any of the identical ones, stays.
    """
    marks, scratch = mark_copies(docs), Scratch(docs.sparkSession)
    doc, digest, keep, rows, n = free(docs, "doc", "digest", "keep", "rows", "n")
    drop = marks.groupBy(F.coalesce("doc_id", F.lit(2**63 - 1)).alias(doc), F.col("text_sha256").alias(digest)).agg(F.bool_or("kept").alias(keep), F.count("*").alias(rows))
    drop = scratch.cut(drop.where(~F.col(keep) | (F.col(rows) > 1)))
    told = docs.withColumn(digest, sha(normalised(F.col("text"))))
    told = told.join(drop, (key(docs) == drop[doc]) & (told[digest] == drop[digest]), "left")
    columns = [docs["`" + c.replace("`", "``") + "`"] for c in docs.columns]
    once = told.where(F.col(rows).isNull()).select(*columns)
    if drop.where(F.col(keep)).isEmpty():  # no doc_id is repeated with its text
        return once
    again = told.where(F.col(keep)).select(*columns)
    order = Window.partitionBy("doc_id", sha(normalised(F.col("text")))).orderBy(F.char_length("text").desc_nulls_last())
    again = again.withColumn(n, F.row_number().over(order)).where(F.col(n) == 1).drop(n)
    return once.unionByName(again)
