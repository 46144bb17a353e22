"""Sharding by balanced label propagation: equal texts move towards one shard under capacity quotas."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from telltale.llm.shared import Scratch, uid


def unit(*cols) -> Column:
    """A hash of the columns in [0, 1)."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 30)) / F.lit(float(1 << 30))


def propagate(cells: DataFrame, shards: int, target: float, seed: int) -> DataFrame:
    """One round on cells (grp, size, shard, n): members drift to the shard that holds most of their group.

    What may move from one shard to another is limited by what moves back plus the room left there, so loads stay
    level; of a cell that share moves, in whole rows, rounded up or down by a hash.
    """
    most = cells.groupBy("grp").agg(F.max_by("shard", F.struct("n", F.xxhash64("grp", "shard"))).alias("to"))
    wish = cells.join(most, "grp")
    flow = wish.where("shard <> to").groupBy("shard", "to").agg(F.sum(F.col("n") * F.col("size")).cast("double").alias("want"))
    load = cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load"))
    back = flow.select(F.col("to").alias("shard"), F.col("shard").alias("to"), F.col("want").alias("back"))
    room = load.select(F.col("shard").alias("to"), (F.greatest(F.lit(target) - F.col("load"), F.lit(0.0)) / F.lit(shards)).alias("room"))
    # at most shards * shards rows
    quota = flow.join(back, ["shard", "to"], "left").join(room, "to", "left")
    quota = quota.select("shard", "to", F.least(F.lit(1.0), (F.coalesce("back", F.lit(0.0)) + F.coalesce("room", F.lit(target / shards))) / F.col("want")).alias("share"))
    moved = wish.join(F.broadcast(quota), ["shard", "to"], "left")
    go = F.floor(F.col("n") * F.coalesce("share", F.lit(0.0)) + unit("grp", "shard", F.lit(seed))).cast("long")
    moved = moved.withColumn("go", F.when(F.col("shard") == F.col("to"), 0).otherwise(F.least("n", go)))
    both = moved.select("grp", "size", F.explode(F.array(F.struct("shard", (F.col("n") - F.col("go")).alias("n")), F.struct(F.col("to").alias("shard"), F.col("go").alias("n")))).alias("x"))
    return both.select("grp", "size", "x.shard", "x.n").where("n > 0").groupBy("grp", "size", "shard").agg(F.sum("n").alias("n"))


def level(classes: dict[int, tuple[int, float]], loads: list[float]) -> dict[int, list[int]]:
    """For each size class (rows, mean size), how many of its rows each shard gets: largest first, to the emptiest."""
    import heapq

    heap, out = [(x, k) for k, x in enumerate(loads)], {}
    for size_class in sorted(classes, reverse=True):
        n, mean = classes[size_class]
        share = [0] * len(loads)
        if n > 8 * len(loads):  # most of a large class in one go: up to the level that all shards reach
            low = {k: x for x, k in heap}
            order, spare = sorted(low.values()), (n - 2 * len(loads)) * mean
            water = order[0]
            for i, x in enumerate(order):
                nxt = order[i + 1] if i + 1 < len(order) else float("inf")
                if (nxt - x) * (i + 1) >= spare:
                    water = x + spare / (i + 1)
                    break
                spare -= (nxt - x) * (i + 1)
            for k, x in low.items():
                share[k] = min(n - sum(share), max(0, int((water - x) / mean)))
                low[k] = x + share[k] * mean
            heap = [(x, k) for k, x in low.items()]
            n -= sum(share)
        heapq.heapify(heap)
        for _ in range(n):
            x, k = heap[0]
            share[k] += 1
            heapq.heapreplace(heap, (x + mean, k))
        out[size_class] = share
    return out


def shard(docs: DataFrame, shards: int = 24, rounds: int = 3, rows_per_salt: int = 50_000) -> DataFrame:
    """Every document with a shard (0 to shards-1) and a slot in it; sizes of the shards are near equal in bytes.

    Equal texts are linked. Rows of a group start at a hash of doc_id and move by label propagation; a group larger
    than a shard spreads over several. Only counts by group and shard move between rounds. What overfills a shard, and
    the rows without links, then fill the shards up, size class by size class, by counts that the driver levels (at
    most some hundred classes). Ranks are taken within a salt, never over a whole group, class or shard.
    Null texts are one group of size 8; repeated rows get a place each; an empty table gives no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    text = F.encode(F.col("text"), "UTF-8")
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 8).cast("long")
    rows = uid(docs.select("doc_id", "text")).select("doc_id", "uid", size.alias("size"), F.coalesce(F.crc32(text), F.lit(0)).alias("text_crc32"), F.unhex(F.md5(F.coalesce(text, F.encode(F.lit("\x00null"), "UTF-8")))).alias("grp"))
    rows = scratch.cut(rows)
    total, n_rows = rows.agg(F.sum("size"), F.count("*")).first()
    salts, target = max(32, n_rows // rows_per_salt), (total or 0) / shards
    salt = F.pmod(F.xxhash64("uid", "doc_id"), F.lit(salts)).cast("int")
    # the first cells: a shard by hash for each row
    cells = rows.groupBy("grp", "size", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("shard")).agg(F.count("*").alias("n"))
    sizes = cells.groupBy("grp").agg(F.sum("n").alias("members")).where("members > 1")
    cells = scratch.cut(cells.join(sizes.select("grp"), "grp", "left_semi"))
    for k in range(rounds):
        old, cells = cells, scratch.cut(propagate(cells, shards, target, k))
        scratch.drop(old)
    load = {r["shard"]: float(r["load"]) for r in cells.groupBy("shard").agg(F.sum(F.col("n") * F.col("size")).alias("load")).collect()}
    # what overfills a shard joins the rows without links; the shard is left a little room for levelling
    keep = F.create_map(*[F.lit(x) for k in range(shards) for x in (k, min(1.0, target / load[k]) if load.get(k) else 1.0)])
    stay = F.least("n", F.floor(F.col("n") * keep[F.col("shard")] + unit("grp", "shard", F.lit("stay"))).cast("long"))
    settled = cells.withColumn("n", stay).where("n > 0")
    upto = F.sum("n").over(Window.partitionBy("grp").orderBy("shard"))  # at most `shards` rows in a group
    ranges = settled.withColumn("upto", upto).groupBy("grp").agg(F.array_sort(F.collect_list(F.struct("upto", "shard"))).alias("ranges"))
    # ranks of rows in their groups, by salt
    linked = rows.join(sizes.select("grp"), "grp", "left_semi").withColumn("salt", salt)
    counts = linked.groupBy("grp", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("grp").orderBy("salt")) - F.col("n"))
    guide = before.join(ranges, "grp", "left").select("grp", "salt", "before", "ranges")
    ranked = linked.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "salt").orderBy("doc_id", "uid")))
    ranked = ranked.join(guide, ["grp", "salt"]).withColumn("rank", F.col("rank") + F.col("before"))
    home = F.try_element_at(F.filter("ranges", lambda r: r["upto"] >= F.col("rank")), F.lit(1))["shard"]
    placed = ranked.select("doc_id", "uid", "size", "text_crc32", home.alias("shard"))
    single = rows.join(sizes.select("grp"), "grp", "left_anti").select("doc_id", "uid", "size", "text_crc32", F.lit(None).cast("int").alias("shard"))
    placed = scratch.cut(placed.unionByName(single))
    # size classes: exact below 128, then 64 to each doubling
    power = F.greatest(F.floor(F.log2("size")) - 6, F.lit(0)).cast("int")
    step = F.floor(F.col("size") / F.pow(F.lit(2.0), power)).cast("long")
    placed = placed.withColumn("class", power.cast("long") * 1000 + step).withColumn("salt", salt)
    free = placed.where("shard is null")
    by_salt = free.groupBy("class", "salt").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    classes = {r["class"]: (r["n"], r["bytes"] / r["n"]) for r in by_salt.groupBy("class").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).collect()}
    fixed = {r["shard"]: float(r["load"]) for r in placed.where("shard is not null").groupBy("shard").agg(F.sum("size").alias("load")).collect()}
    shares = level(classes, [fixed.get(k, 0.0) for k in range(shards)])
    table = []
    for c, share in shares.items():
        upto, ends = 0, []
        for k, n in enumerate(share):
            upto += n
            if n:
                ends.append((upto, k))
        table.append((c, ends))
    # the classes of 64-bit sizes are at most 4000 rows
    ends = F.broadcast(spark.createDataFrame(table, "class long, ends array<struct<upto:long,shard:int>>"))
    before = by_salt.withColumn("before", F.sum("n").over(Window.partitionBy("class").orderBy("salt")) - F.col("n")).select("class", "salt", "before")
    ranked = free.drop("shard").withColumn("rank", F.row_number().over(Window.partitionBy("class", "salt").orderBy("doc_id", "uid")))
    ranked = ranked.join(before, ["class", "salt"]).join(ends, "class").withColumn("rank", F.col("rank") + F.col("before"))
    filled = ranked.withColumn("shard", F.element_at(F.filter("ends", lambda r: r["upto"] >= F.col("rank")), 1)["shard"])
    cols = ["doc_id", "uid", "size", "text_crc32", "shard", "salt"]
    whole = scratch.cut(filled.select(*cols).unionByName(placed.where("shard is not null").select(*cols)))
    counts = whole.groupBy("shard", "salt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).drop("n")
    slots = whole.withColumn("rank", F.row_number().over(Window.partitionBy("shard", "salt").orderBy("doc_id", "uid")))
    return slots.join(before, ["shard", "salt"]).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("rank") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
