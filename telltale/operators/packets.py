"""Splits, samples and weights of packets (rows to learn from or to judge)."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.operators.ranks import ranked

#: Weights of a packet by where it is from (fixed values).
SOURCE_WEIGHTS = {"easy_negative": 0.55, "hard_negative": 0.90, "real_negative": 1.25}


def sizes(n: Column, train: float = 0.6, cal: float = 0.2) -> tuple[Column, Column]:
    """Rows of the first two parts of n: shares rounded half to even, at least one each, and one left for the third from 3 rows on."""
    a = F.when(n <= 2, F.least(n, F.lit(1))).otherwise(F.greatest(F.lit(1), F.bround(n * F.lit(train))))
    b = F.greatest(F.lit(1), F.bround(n * F.lit(cal)))
    b = F.when(n <= 2, n - a).otherwise(F.when(a + b >= n, F.greatest(F.lit(1), n - a - 1)).otherwise(b))
    a = F.when((n > 2) & (a + b >= n), F.greatest(F.lit(1), n - b - 1)).otherwise(a)
    return a.cast("long"), b.cast("long")


def split_three(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `split`: in order of time the first 60 % of each group are train, the next 20 % cal, the rest val."""
    t = ranked(df, [key], order)
    a, b = sizes(F.col("group_rows"))
    split = F.when(F.col("rank") <= a, "train").when(F.col("rank") <= a + b, "cal").otherwise("val")
    return t.withColumn("split", split).drop("rank", "group_rows")


def split_at(df: DataFrame, key: str, order: list[str], fraction: float) -> DataFrame:
    """Adds `split`: floor(fraction * n) rows of each group, in order of time, are first, the rest second; each part gets a row if there are two."""
    t = ranked(df, [key], order)
    cut = F.least(F.greatest(F.floor(F.col("group_rows") * F.lit(fraction)), F.lit(1)), F.greatest(F.col("group_rows") - 1, F.lit(1)))
    return t.withColumn("split", F.when(F.col("rank") <= cut, "first").otherwise("second")).drop("rank", "group_rows")


def thirds(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `part`, 1 to 3: thirds in order of time, the first ones larger by one where n isn't a multiple of 3."""
    t = ranked(df, [key], order)
    n, k = F.col("group_rows"), F.col("rank")
    whole, more = F.floor(n / 3), n % 3
    large = more * (whole + 1)
    part = F.when(k <= large, F.ceil(k / (whole + 1))).otherwise(more + F.ceil((k - large) / F.greatest(whole, F.lit(1))))
    return t.withColumn("part", part.cast("int")).drop("rank", "group_rows")


def small_temporal(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Adds `split` to few rows: a single one is val, two are cal and val, more are thirds train, cal and val."""
    t = ranked(df, [key], order).withColumnRenamed("rank", "__k").withColumnRenamed("group_rows", "__n")
    three = thirds(t, key, order)
    split = F.when(F.col("__n") == 1, "val").when(F.col("__n") == 2, F.when(F.col("__k") == 1, "cal").otherwise("val")).otherwise(F.element_at(F.array(F.lit("train"), F.lit("cal"), F.lit("val")), F.col("part")))
    return three.withColumn("split", split).drop("part", "__k", "__n")


def stratified(df: DataFrame, strata: list[str], order: list, fraction: float) -> DataFrame:
    """round(n * fraction) rows of each stratum, the first in a stated (say hashed) order."""
    w = Window.partitionBy(*strata)
    t = df.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    return t.where(F.col("__k") <= F.bround(F.col("__n") * F.lit(fraction))).drop("__k", "__n")


def stratified_to(df: DataFrame, strata: list[str], order: list, n: int) -> DataFrame:
    """Exactly n rows (all, if there are fewer): each stratum's share of them, then topped up or trimmed in the stated order."""
    total = df.count()
    w = Window.partitionBy(*strata)
    t = df.withColumn("__k", F.row_number().over(w.orderBy(*order))).withColumn("__n", F.count("*").over(w))
    spare = (F.col("__k") > F.bround(F.col("__n") * F.lit(min(1.0, n / max(total, 1))))).cast("int")
    return t.withColumn("__spare", spare).orderBy("__spare", *order).limit(n).drop("__k", "__n", "__spare")


def sample_rows(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of least hash of the key: the same ones on every run."""
    return df.orderBy(F.xxhash64(key, F.lit(seed)), key).limit(n)


def source_weights(df: DataFrame, label: str, source: str) -> DataFrame:
    """Adds `weight`: balanced by label, times the source's weight (1 for any other)."""
    table = F.create_map(*[F.lit(x) for kv in SOURCE_WEIGHTS.items() for x in kv])
    return class_weights(df, label).withColumn("weight", F.col("weight") * F.coalesce(F.try_element_at(table, F.col(source)), F.lit(1.0)))


def pseudo_triggers(times: DataFrame, kind: str) -> DataFrame:
    """Trigger rows for times without an event: event_id -1, a negative, of no area."""
    return times.select("ts", F.lit(-1).cast("long").alias("event_id"), F.lit(kind).alias("reason"), F.lit("unknown").alias("area"), F.lit(1).alias("sampled_negative"))


def healthy_block(df: DataFrame, leak: Column, share: float = 0.6, least: int = 20, fallback: float = 0.2, open_end: bool = True) -> DataFrame:
    """One row: first_leak, healthy_rows (those before it) and fit_rows: `share` of them, or `fallback` of all if they are fewer than `least`.

    open_end: without a leak all rows are healthy; otherwise none is, because no row is before a leak.
    """
    first = df.agg(F.min(F.when(leak, F.col("ts"))).alias("first_leak"), F.count("*").alias("__all"))
    n = df.join(F.broadcast(first)).agg(F.first("first_leak").alias("first_leak"), F.first("__all").alias("__all"), F.count_if((F.col("first_leak").isNull() & F.lit(open_end)) | (F.col("ts") < F.col("first_leak"))).alias("healthy_rows"))
    fit = F.when(F.col("healthy_rows") >= least, F.floor(F.col("healthy_rows") * F.lit(share))).otherwise(F.floor(F.col("__all") * F.lit(fallback)))
    return n.select("first_leak", "healthy_rows", F.greatest(fit, F.lit(1)).cast("long").alias("fit_rows"))


def packet_set(positives: DataFrame, real_negatives: DataFrame, peaks: DataFrame, calm: DataFrame, hard_share: float = 0.25, hard_least: int = 24, easy_share: float = 0.35) -> DataFrame:
    """ts, event_id, reason, kind, split: all packets to learn from.

    Positives are split 60/20/20 in time, real negatives by thirds. `peaks` (ts, value: scores of healthy times) give
    the hard negatives, max(hard_least, round(hard_share * positives)) of the greatest; `calm` (ts) the easy ones,
    round(easy_share * positives), stratified by month and hour.
    """
    n = positives.count()
    one = F.lit(1).alias("all")
    cols = ["ts", "event_id", "reason"]
    pos = split_three(positives.select(*cols, one), "all", ["ts"]).withColumn("kind", F.lit("positive"))
    real = small_temporal(real_negatives.select(*cols, one), "all", ["ts"]).withColumn("kind", F.lit("real_negative"))
    hard = pseudo_triggers(peaks.orderBy(F.desc("value"), "ts").limit(max(hard_least, round(hard_share * n))), "hard_negative")
    rest = calm.join(hard.select("ts"), "ts", "left_anti").withColumn("month", F.month("ts")).withColumn("hour", F.hour("ts"))
    easy = pseudo_triggers(stratified_to(rest, ["month", "hour"], [F.xxhash64("ts", F.lit(42)), "ts"], round(easy_share * n)), "easy_negative")
    parts = [pos, real] + [split_three(x.select(*cols, one), "all", ["ts"]).withColumn("kind", F.lit(k)) for x, k in ((hard, "hard_negative"), (easy, "easy_negative"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select(*cols, "kind", "split")


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Adds balanced weights n / (k * n_c)."""
    c = df.groupBy(label).agg(F.count("*").alias("__c"))
    t = c.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    table = c.join(F.broadcast(t)).select(label, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(table, label)


def signature_weights(df: DataFrame, signature: str) -> DataFrame:
    """Adds weights 1 / count(signature), scaled to a mean of 1."""
    c = df.groupBy(signature).agg(F.count("*").alias("__c"))
    t = c.agg(F.sum("__c").alias("__n"), F.count("*").alias("__k"))
    table = c.join(F.broadcast(t)).select(signature, (F.col("__n") / (F.col("__k") * F.col("__c"))).alias("weight"))
    return df.join(table, signature)


def actual(df: DataFrame, label: str, value: int = 1) -> DataFrame:
    """Packets of real triggers with a label: those that were not sampled."""
    return df.where((F.col("sampled_negative") == 0) & (F.col(label) == value))
